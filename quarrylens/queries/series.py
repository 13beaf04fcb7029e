"""Series, process control and finance over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import finance, series, smoothing
from quarrylens.queries.registry import query

DAILY = "SELECT o_orderdate AS day, sum(o_totalprice) AS total FROM {orders} GROUP BY o_orderdate"
DAILY_SQL = "d AS (" + DAILY.replace("{orders}", "orders") + ")"
MONTHLY = """
SELECT o_orderpriority AS priority, year(o_orderdate) * 12 + month(o_orderdate) AS month, sum(o_totalprice) AS total
FROM {orders} GROUP BY 1, 2
"""
MONTHLY_SQL = "m AS (" + MONTHLY.replace("{orders}", "orders") + ")"


@query("q1_capability", """
WITH b AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY event_type)
SELECT event_type, n, mean, std, 0.0 AS lsl, 250.0 AS usl, 250.0 / (6 * std) AS cp, (250.0 - mean) / (3 * std) AS cpu,
       mean / (3 * std) AS cpl, least((250.0 - mean) / (3 * std), mean / (3 * std)) AS cpk,
       3 * least((250.0 - mean) / (3 * std), mean / (3 * std)) AS sigma_level,
       CASE WHEN least((250.0 - mean) / (3 * std), mean / (3 * std)) >= 1.33 THEN 'Capable'
            WHEN least((250.0 - mean) / (3 * std), mean / (3 * std)) >= 1.0 THEN 'Marginal' ELSE 'Not capable' END AS verdict
FROM b
""", approx="mean std lsl usl cp cpu cpl cpk sigma_level")
def capability(t):
    return series.capability(t.events, "value", ["event_type"], 0.0, 250.0).drop("dpmo")


@query("q1_capability_dpmo", """
SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, avg(value) - 3 * stddev_pop(value) AS lsl,
       avg(value) + 3 * stddev_pop(value) AS usl, 1.0 AS cp, 1.0 AS cpu, 1.0 AS cpl, 1.0 AS cpk, 3.0 AS sigma_level,
       2699.796063260187 AS dpmo FROM events GROUP BY event_type
""", approx="mean std lsl usl cp cpu cpl cpk sigma_level dpmo")
def capability_dpmo(t):
    """Default limits lie three deviations out: the two tails of the normal distribution."""
    return series.capability(t.events, "value", ["event_type"]).drop("verdict")


XBAR_SQL = """
WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY event_type) AS n, least(10, greatest(2, count(*) OVER (PARTITION BY event_type) // 20)) AS size FROM events),
g AS (SELECT event_type, size, pos // size AS subgroup, avg(value) AS mean FROM i WHERE (pos // size + 1) * size {op} n GROUP BY 1, 2, 3),
c AS (SELECT event_type, avg(mean) AS center FROM g GROUP BY 1), s AS (SELECT event_type, stddev_pop(value) AS std FROM events GROUP BY 1)
SELECT event_type, CAST(subgroup AS BIGINT) AS subgroup, mean, center, center + 3 * std / sqrt(size) AS ucl,
       center - 3 * std / sqrt(size) AS lcl, abs(mean - center) > 3 * std / sqrt(size) AS out_of_control
FROM g JOIN c USING (event_type) JOIN s USING (event_type)
"""


@query("q2_xbar_chart", XBAR_SQL.replace("{op}", "<="), approx="mean center ucl lcl")
def xbar_chart(t):
    return series.xbar_chart(t.events, "value", ["ts", "event_id"], ["event_type"])


@query("q2_xbar_chart_parity", XBAR_SQL.replace("{op}", "<"), approx="mean center ucl lcl")
def xbar_chart_parity(t):
    return series.xbar_chart(t.events, "value", ["ts", "event_id"], ["event_type"], drop_last=True)


@query("q3_trend", """
WITH i AS (SELECT l_quantity AS y, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS x FROM lineitem)
SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM i
""", approx="slope intercept r2", digits=4)
def trend(t):
    out = series.trend(t.lineitem, "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return out.select("n", "slope", "intercept", "r2")


@query("q3_detrended", f"""
WITH {DAILY_SQL}, i AS (SELECT day, total, row_number() OVER (ORDER BY day) - 1 AS x FROM d),
f AS (SELECT regr_slope(total, x) AS b, regr_intercept(total, x) AS a FROM i)
SELECT day, total, a + b * x AS trend, round(total - (a + b * x), 3) AS detrended FROM i, f
""", approx="total trend")
def detrended(t):
    out = series.detrended(t.sql(DAILY, "orders"), "total", ["day"])
    return out.withColumn("detrended", F.round("detrended", 3) + F.lit(0.0))


ACF_SQL = f"""
WITH {DAILY_SQL}, i AS (SELECT total, row_number() OVER (ORDER BY day) - 1 AS x, count(*) OVER () AS n FROM d),
a AS (SELECT p.n AS n, CAST(l.lag AS INTEGER) AS lag, corr(p.total, q.total) AS acf
      FROM i p, (SELECT unnest(range(1, 41)) AS lag) l, i q
      WHERE q.x = p.x - l.lag AND l.lag <= p.n // 4 GROUP BY 1, 2)
"""


@query("q4_acf", ACF_SQL + "SELECT n, lag, round(acf, 8) AS acf, 1.96 / sqrt(n) AS band FROM a UNION ALL SELECT DISTINCT n, 0, 1.0, 1.96 / sqrt(n) FROM a", approx="band")
def acf(t):
    out = series.acf(t.sql(DAILY, "orders"), "total", ["day"])
    return out.withColumn("acf", F.round("acf", 8) + F.lit(0.0))


@query("q5_ljung_box", ACF_SQL + """
SELECT sum(CAST(n AS DOUBLE) * (n + 2) * acf * acf / (n - lag)) AS q FROM a WHERE lag <= 19
""", approx="q", digits=7)
def ljung_box(t):
    return series.ljung_box(series.acf(t.sql(DAILY, "orders"), "total", ["day"])).select("q")


@query("q6_holt", f"""
WITH RECURSIVE {MONTHLY_SQL},
i AS (SELECT priority, total AS x, row_number() OVER (PARTITION BY priority ORDER BY month) - 1 AS pos,
             count(*) OVER (PARTITION BY priority) AS n FROM m),
s AS (SELECT a.priority, CAST(0 AS BIGINT) AS pos, a.n, a.x AS level, b.x - a.x AS trend
      FROM i a JOIN i b ON a.priority = b.priority AND a.pos = 0 AND b.pos = 1
      UNION ALL
      SELECT s.priority, i.pos, s.n, 0.5 * i.x + 0.5 * (s.level + s.trend),
             0.3 * (0.5 * i.x + 0.5 * (s.level + s.trend) - s.level) + 0.7 * s.trend
      FROM s JOIN i ON i.priority = s.priority AND i.pos = s.pos + 1)
SELECT priority, CAST(h.step AS INTEGER) AS step, level + h.step * trend AS forecast
FROM s, (SELECT unnest(range(1, 13)) AS step) h WHERE pos = n - 1 AND h.step <= n // 5
""", approx="forecast", digits=8)
def holt(t):
    return series.holt(t.sql(MONTHLY, "orders"), "total", ["month"], ["priority"])


# Sums of squared one-step errors of every pair of parameters, walked month by month.
WALK = """
SELECT g.priority, g.alpha, g.beta, a.pos + 1 AS pos, a.x AS level, b.x - a.x AS trend, CAST(0 AS DOUBLE) AS sse
FROM {grid} g JOIN i a ON a.priority = g.priority AND a.pos = 0 JOIN i b ON b.priority = g.priority AND b.pos = 1
UNION ALL
SELECT s.priority, s.alpha, s.beta, s.pos + 1, s.level + s.trend + s.alpha * (i.x - s.level - s.trend),
       s.trend + s.alpha * s.beta * (i.x - s.level - s.trend), s.sse + (i.x - s.level - s.trend) * (i.x - s.level - s.trend)
FROM {name} s JOIN i ON i.priority = s.priority AND i.pos = s.pos
"""


@query("q6_holt_fitted", f"""
WITH RECURSIVE {MONTHLY_SQL},
i AS (SELECT priority, CAST(total AS DOUBLE) AS x, CAST(row_number() OVER (PARTITION BY priority ORDER BY month) - 1 AS BIGINT) AS pos,
             count(*) OVER (PARTITION BY priority) AS n FROM m),
d AS (SELECT DISTINCT priority, n FROM i),
v AS (SELECT CAST(round(0.05 + 0.1 * k, 2) AS DOUBLE) AS v FROM (SELECT unnest(range(0, 10)) AS k)),
g1 AS (SELECT priority, a.v AS alpha, b.v AS beta FROM d, v a, v b),
s1 AS ({WALK.format(grid="g1", name="s1")}),
b1 AS (SELECT s1.priority, arg_min(alpha, sse) AS alpha, arg_min(beta, sse) AS beta FROM s1 JOIN d ON d.priority = s1.priority AND d.n = s1.pos GROUP BY 1),
w AS (SELECT 0.02 * k AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
g2 AS (SELECT DISTINCT priority, CAST(least(0.99, greatest(0.01, round(alpha + a.w, 2))) AS DOUBLE) AS alpha,
              CAST(least(0.99, greatest(0.01, round(beta + b.w, 2))) AS DOUBLE) AS beta FROM b1, w a, w b),
s2 AS ({WALK.format(grid="g2", name="s2")}),
e AS (SELECT s2.*, d.n FROM s2 JOIN d ON d.priority = s2.priority AND d.n = s2.pos QUALIFY row_number() OVER (PARTITION BY s2.priority ORDER BY sse) = 1)
SELECT priority, alpha, beta, sse, CAST(h.step AS INTEGER) AS step, level + h.step * trend AS forecast
FROM e, (SELECT unnest(range(1, 13)) AS step) h WHERE h.step <= n // 5
""", approx="sse forecast", digits=7)
def holt_fitted(t):
    return smoothing.fitted_holt(t.sql(MONTHLY, "orders"), "total", ["month"], ["priority"])


@query("q6_trend_forecast", f"""
WITH {MONTHLY_SQL}, i AS (SELECT priority, total, row_number() OVER (PARTITION BY priority ORDER BY month) - 1 AS x FROM m),
f AS (SELECT priority, count(*) AS n, regr_slope(total, x) AS b, regr_intercept(total, x) AS a FROM i GROUP BY 1)
SELECT priority, CAST(h.step AS INTEGER) AS step, a + b * (n - 1 + h.step) AS forecast
FROM f, (SELECT unnest(range(1, 13)) AS step) h WHERE h.step <= n // 5
""", approx="forecast", digits=8)
def trend_forecast(t):
    return series.trend_forecast(t.sql(MONTHLY, "orders"), "total", ["month"], ["priority"])


HOURLY = """
SELECT event_type, CAST(date_trunc('hour', ts) AS {ntz}) AS hour, sum(value) AS total FROM {events} GROUP BY 1, 2
"""
SPECTRUM_SQL = "WITH h AS (" + HOURLY.replace("{events}", "events").replace("{ntz}", "TIMESTAMP") + """),
i AS (SELECT event_type, total AS x, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS pos,
             count(*) OVER (PARTITION BY event_type) AS n FROM h),
p AS (SELECT event_type, CAST(k.bin AS INTEGER) AS bin, n, pow(sum(x * cos(2 * pi() * ((k.bin * pos) % n) / n)), 2)
             + pow(sum(x * sin(2 * pi() * ((k.bin * pos) % n) / n)), 2) AS power
      FROM i, (SELECT unnest(range(0, (SELECT max(n) // 2 FROM i))) AS bin) k WHERE k.bin < n // 2 GROUP BY 1, 2, 3)
"""


def hourly(t):
    return t.sql(HOURLY.replace("{ntz}", "TIMESTAMP_NTZ"), "events")


@query("q7_periodogram", SPECTRUM_SQL + """
SELECT event_type, bin, bin * 24.0 / n AS frequency, power FROM p
""", approx="frequency power", digits=7)
def periodogram(t):
    return series.periodogram(hourly(t), "total", ["hour"], by=["event_type"], fs=24.0)


@query("q7_dominant_frequency", SPECTRUM_SQL + """
SELECT event_type, arg_max(bin * 24.0 / n, power) AS frequency, max(power) AS power FROM p WHERE bin > 0 GROUP BY 1
""", approx="frequency power", digits=7)
def dominant_frequency(t):
    spectrum = series.periodogram(hourly(t), "total", ["hour"], by=["event_type"], fs=24.0)
    return series.dominant_frequency(spectrum, ["event_type"])


# The mean price of each order day: one series of over two thousand points.
DAY_MEANS = "SELECT o_orderdate AS day, avg(o_totalprice) AS total FROM {orders} GROUP BY 1"


@query("q7_full_spectrum", "WITH i AS (SELECT total AS x, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (" + DAY_MEANS.replace("{orders}", "orders") + """)),
p AS (SELECT k.bin, n, sum(x * cos(2 * pi() * ((k.bin * pos) % n) / n)) AS re, sum(x * sin(2 * pi() * ((k.bin * pos) % n) / n)) AS im
      FROM i, (SELECT unnest(range(0, (SELECT max(n) // 2 FROM i))) AS bin) k GROUP BY 1, 2)
SELECT CAST(bin AS INTEGER) AS bin, bin / n AS frequency, re * re + im * im AS power FROM p
""", approx="frequency power", digits=5)
def full_spectrum(t):
    """Every bin of one long series, in tasks that hold few of its points; a prime length goes through the chirp."""
    return series.periodogram(t.sql(DAY_MEANS, "orders"), "total", ["day"], points=256)


# A customer is a project, the order year its period; the first year is the outlay.
FLOWS = """
SELECT o_custkey AS project, year(o_orderdate) - 1995 AS t,
       CASE WHEN year(o_orderdate) = 1995 THEN -2 * o_totalprice ELSE o_totalprice END AS cf FROM {orders}
"""
FLOWS_SQL = "flow AS (" + FLOWS.replace("{orders}", "orders") + ")"


def flows(t):
    return t.sql(FLOWS, "orders")


@query("f1_npv", f"""
WITH {FLOWS_SQL}, s AS (SELECT project, sum(cf / pow(1.1, t)) AS npv, abs(sum(CASE WHEN t = 0 THEN cf END)) AS outlay FROM flow GROUP BY 1)
SELECT project, round(npv, 4) AS npv, round((npv + outlay) / nullif(outlay, 0), 8) AS profitability_index FROM s
""")
def npv(t):
    out = finance.npv(flows(t), "project", "t", "cf", 0.1)
    return out.select(
        "project", (F.round("npv", 4) + F.lit(0.0)).alias("npv"),
        (F.round("profitability_index", 8) + F.lit(0.0)).alias("profitability_index"),
    )


@query("f2_payback", f"""
WITH {FLOWS_SQL}, p AS (SELECT project, t, sum(cf) AS cf FROM flow GROUP BY 1, 2),
c AS (SELECT *, abs(first_value(cf) OVER (PARTITION BY project ORDER BY t)) AS outlay,
             sum(CASE WHEN t > 0 THEN cf ELSE 0 END) OVER (PARTITION BY project ORDER BY t) AS inflow FROM p)
SELECT project, round(coalesce(arg_min(t - 1 + (outlay - (inflow - cf)) / cf, t) FILTER (t > 0 AND inflow >= outlay),
       CAST(count(*) AS DOUBLE)), 7) AS payback FROM c GROUP BY project
""")
def payback(t):
    out = finance.payback(flows(t), "project", "t", "cf")
    return out.withColumn("payback", F.round("payback", 7) + F.lit(0.0))


@query("f1_irr", f"""
WITH RECURSIVE {FLOWS_SQL}, p AS (SELECT project % 25 AS project, t, sum(cf) AS cf FROM flow GROUP BY 1, 2),
s AS (SELECT project, CAST(0 AS BIGINT) AS step, CAST(-0.9 AS DOUBLE) AS lo, CAST(10.0 AS DOUBLE) AS hi FROM p GROUP BY project
      HAVING sum(cf / pow(0.1, t)) * sum(cf / pow(11.0, t)) < 0
      UNION ALL
      SELECT project, step + 1, CASE WHEN sign(v) = sign(w) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sign(v) = sign(w) THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT s.project, s.step, s.lo, s.hi, sum(cf / pow(1 + (s.lo + s.hi) / 2, t)) AS v, sum(cf / pow(0.1, t)) AS w
            FROM s JOIN p ON s.project = p.project WHERE s.step < 60 GROUP BY 1, 2, 3, 4))
SELECT i.project, round((lo + hi) / 2, 8) AS irr FROM (SELECT DISTINCT project FROM p) i LEFT JOIN s ON i.project = s.project AND step = 60
""")
def internal_rate(t):
    grouped = flows(t).withColumn("project", F.col("project") % 25)
    return finance.irr(grouped, "project", "t", "cf").withColumn("irr", F.round("irr", 8))


@query("f3_npv_curve", f"""
WITH {FLOWS_SQL}, g AS (SELECT o_custkey % 25 AS project, t, cf FROM flow JOIN (SELECT DISTINCT o_custkey FROM orders) ON project = o_custkey),
r AS (SELECT 0.01 + k * (0.35 - 0.01) / 199 AS rate FROM (SELECT unnest(range(0, 200)) AS k))
SELECT project, rate, sum(cf / pow(1 + rate, t)) AS npv FROM g, r GROUP BY 1, 2
""", approx="rate npv", digits=7)
def npv_curve(t):
    grouped = flows(t).withColumn("project", F.col("project") % 25)
    return finance.npv_curve(grouped, "project", "t", "cf")


ASSETS = ("click", "error", "purchase", "signup", "view")
# One row per hour, one price column per event type; hours without an event have no price.
PRICE_TABLE = "SELECT CAST(date_trunc('hour', ts) AS {ntz}) AS hour, " + ", ".join(
    f"100 + avg(CASE WHEN event_type = '{a}' THEN value END) AS {a}" for a in ASSETS
) + " FROM {events} GROUP BY 1"


def price_table(t):
    return t.sql(PRICE_TABLE.replace("{ntz}", "TIMESTAMP_NTZ"), "events")


RETURN_SQL = "WITH w AS (" + PRICE_TABLE.replace("{events}", "events").replace("{ntz}", "TIMESTAMP") + "), f AS (SELECT hour, " + ", ".join(
    f"last_value({a} IGNORE NULLS) OVER (ORDER BY hour) AS {a}" for a in ASSETS
) + " FROM w), r AS (SELECT " + ", ".join(
    f"{a} / lag({a}) OVER (ORDER BY hour) - 1 AS {a}" for a in ASSETS
) + " FROM f), k AS (SELECT * FROM r WHERE " + " AND ".join(f"{a} IS NOT NULL" for a in ASSETS) + ")\n"


@query("f4_return_mean", RETURN_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS asset, avg({a}) * 252 AS mu FROM k" for a in ASSETS), approx="mu", digits=8)
def return_mean(t):
    return finance.return_stats(price_table(t), ["hour"], ASSETS)[0]


@query("f4_return_mean_six", RETURN_SQL + "SELECT 'copy' AS asset, avg(view) * 252 AS mu FROM k UNION ALL " + " UNION ALL ".join(
    f"SELECT '{a}' AS asset, avg({a}) * 252 AS mu FROM k" for a in ASSETS), approx="mu", digits=8)
def return_mean_six(t):
    """Six assets give six rows."""
    return finance.return_stats(price_table(t).withColumn("copy", F.col("view")), ["hour"], [*ASSETS, "copy"])[0]


COV_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) * 252 AS cov FROM k" for a in ASSETS for b in ASSETS)


@query("f4_return_covariance", RETURN_SQL + COV_SQL, approx="cov", digits=6)
def return_covariance(t):
    return finance.return_stats(price_table(t), ["hour"], ASSETS)[1]


GRID_SETS = 3000
GRID_SQL = "g AS (SELECT CAST(unnest(range(0, 3000)) AS BIGINT) AS set_id), u AS (SELECT set_id, " + ", ".join(
    f"CAST((set_id * {31 + 7 * i}) % 9973 + 1 AS DOUBLE) AS {a}" for i, a in enumerate(ASSETS)
) + " FROM g), n AS (SELECT set_id, " + ", ".join(f"{a} / ({' + '.join(ASSETS)}) AS {a}" for a in ASSETS) + " FROM u)"
PORTFOLIO_SQL = RETURN_SQL.rstrip() + ", " + GRID_SQL + ", mu AS (SELECT " + ", ".join(
    f"avg({a}) * 252 AS {a}" for a in ASSETS) + " FROM k), cv AS (SELECT " + ", ".join(
    f"covar_samp({a}, {b}) * 252 AS {a}_{b}" for a in ASSETS for b in ASSETS) + " FROM k), o AS (SELECT set_id, " + " + ".join(
    f"n.{a} * mu.{a}" for a in ASSETS) + " AS ret, sqrt(" + " + ".join(
    f"n.{a} * n.{b} * cv.{a}_{b}" for a in ASSETS for b in ASSETS) + ") AS vol FROM n, mu, cv)\n"


def grid_weights(t):
    raw = [((F.col("id") * (31 + 7 * i)) % 9973 + 1).cast("double") for i in range(len(ASSETS))]
    total = sum(raw[1:], raw[0])
    return t.spark.range(GRID_SETS).select(F.col("id").alias("set_id"), F.array(*[x / total for x in raw]).alias("weights"))


@query("f5_portfolio_search", PORTFOLIO_SQL + "SELECT set_id, ret, vol, ret / vol AS sharpe FROM o",
       approx="ret vol sharpe", digits=7)
def portfolio_search(t):
    mu, cov = finance.return_stats(price_table(t), ["hour"], ASSETS)
    return finance.portfolio_search(mu, cov, ASSETS, grid_weights(t)).drop("weights")


@query("f5_best_portfolios", PORTFOLIO_SQL + """
SELECT 'max_sharpe' AS pick, arg_max(set_id, ret / vol) AS set_id FROM o
UNION ALL SELECT 'min_volatility', arg_min(set_id, vol) FROM o
""")
def best_portfolios(t):
    mu, cov = finance.return_stats(price_table(t), ["hour"], ASSETS)
    return finance.best_portfolios(finance.portfolio_search(mu, cov, ASSETS, grid_weights(t)))


DRAWS_SQL = "g AS (SELECT CAST(unnest(range(0, 3000)) AS BIGINT) AS set_id), u AS (SELECT set_id, " + ", ".join(
    f"-ln((CAST(('0x' || substr(md5(concat_ws('-', set_id, {i}, 42)), 1, 12)) AS BIGINT) + 1) / 281474976710656.0) AS {a}"
    for i, a in enumerate(ASSETS, 1)
) + " FROM g), n AS (SELECT set_id, " + ", ".join(f"{a} / ({' + '.join(ASSETS)}) AS {a}" for a in ASSETS) + " FROM u)"


@query("f5_random_portfolios", PORTFOLIO_SQL.replace(GRID_SQL, DRAWS_SQL) + (
    "SELECT o.set_id, ret, vol, ret / vol AS sharpe, " + ", ".join(f"n.{a} AS w_{a}" for a in ASSETS) + " FROM o JOIN n ON o.set_id = n.set_id"
), approx="ret vol sharpe " + " ".join(f"w_{a}" for a in ASSETS), digits=6)
def random_portfolios(t):
    mu, cov = finance.return_stats(price_table(t), ["hour"], ASSETS)
    found = finance.portfolio_search(mu, cov, ASSETS, finance.random_weights(t.spark, len(ASSETS)))
    return found.select("set_id", "ret", "vol", "sharpe", *[F.col("weights")[i].alias(f"w_{a}") for i, a in enumerate(ASSETS)])


@query("f6_ticker_summary", """
WITH e AS (SELECT o_orderpriority AS ticker, max(o_orderdate) AS last FROM orders GROUP BY 1),
r AS (SELECT o_orderpriority AS ticker, o_orderdate AS ts, max(o_totalprice) AS close FROM orders GROUP BY 1, 2)
SELECT ticker, arg_max(close, ts) AS last_close, max(close) AS high_52w, min(close) AS low_52w
FROM r JOIN e USING (ticker) WHERE ts > last - INTERVAL 364 DAY GROUP BY ticker
""", approx="last_close high_52w low_52w")
def ticker_summary(t):
    daily = t.orders.groupBy("o_orderpriority", "o_orderdate").agg(F.max("o_totalprice").alias("close"))
    return finance.ticker_summary(daily, "o_orderpriority", "o_orderdate", "close")
