"""Chart datasets of the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarrylens.operators import charts
from quarrylens.operators.profiling import semantic_profile
from quarrylens.plans.dashboard import dashboard
from quarrylens.queries.cleaning import NAMED_NATIONS, NAMED_SQL
from quarrylens.queries.registry import query


def lines_with_parts(t, *more: str):
    """lineitem with the brand and type of its part."""
    part = t.part.select("p_partkey", "p_brand", "p_type")
    columns = ["l_extendedprice", "l_quantity", *more]
    return t.lineitem.select("l_partkey", *columns).join(part, F.col("l_partkey") == F.col("p_partkey"))


@query("d1_kpi", """
SELECT 'o_totalprice' AS "column", 'Avg' AS label, avg(o_totalprice) AS value FROM orders
UNION ALL SELECT 'o_orderkey', 'Total', sum(o_orderkey) FROM orders
UNION ALL SELECT 'open_event', 'Rate %', round(avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) * 100, 1) FROM orders
""", approx="value")
def kpi(t):
    df = t.orders.withColumn("open_event", (F.col("o_orderstatus") == "O").cast("int"))
    return charts.kpi(df, {"o_totalprice": "mean", "o_orderkey": "sum", "open_event": "rate"})


@query("d2_kpi_columns", """
SELECT * FROM (VALUES (1, 'late_event'), (2, 'l_extendedprice'), (3, 'l_orderkey'), (4, 'l_partkey'), (5, 'l_linenumber')
) AS v(rank, "column")
""")
def kpi_columns(t):
    df = t.lineitem.drop("l_suppkey").withColumn("late_event", (F.col("l_tax") > 0.04).cast("int"))
    names = charts.kpi_columns(semantic_profile(df))
    return t.spark.createDataFrame(list(enumerate(names, 1)), "rank int, column string")


@query("d3_find_target", """
SELECT * FROM (VALUES ('with_event', 'late_event', TRUE), ('with_rate', 'tax_rate', FALSE),
  ('plain', 'l_orderkey', FALSE)) AS v(variant, target, is_binary)
""")
def find_target(t):
    event = t.lineitem.withColumn("late_event", (F.col("l_tax") > 0.04).cast("int"))
    rate = t.lineitem.withColumnRenamed("l_tax", "tax_rate")
    rows = [
        (name, *charts.find_target(semantic_profile(df)))
        for name, df in (("with_event", event), ("with_rate", rate), ("plain", t.lineitem))
    ]
    return t.spark.createDataFrame(rows, "variant string, target string, is_binary boolean")


@query("d4_kpi_trend", """
WITH i AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx,
                  greatest(count(*) OVER () // 10, 1) AS seg, count(*) OVER () AS n FROM lineitem),
m AS (SELECT avg(l_quantity) FILTER (idx < seg) AS qa, avg(l_quantity) FILTER (idx >= n - seg) AS qb,
             avg(l_extendedprice) FILTER (idx < seg) AS pa, avg(l_extendedprice) FILTER (idx >= n - seg) AS pb FROM i)
SELECT 'l_quantity' AS "column", qa AS first_mean, qb AS last_mean, round((qb - qa) / abs(qa) * 100, 6) AS trend_pct,
       abs((qb - qa) / abs(qa) * 100) <= 200 AS show_delta FROM m
UNION ALL SELECT 'l_extendedprice', pa, pb, round((pb - pa) / abs(pa) * 100, 6), abs((pb - pa) / abs(pa) * 100) <= 200 FROM m
""", approx="first_mean last_mean")
def kpi_trend(t):
    out = charts.kpi_trend(
        t.lineitem, ["l_quantity", "l_extendedprice"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    )
    return out.withColumn("trend_pct", F.round("trend_pct", 6))


@query("d5_format_kpi", """
WITH v AS (SELECT 'p_retailprice' AS "column", 'Avg' AS label, avg(p_retailprice) AS value FROM part
  UNION ALL SELECT 'p_partkey', 'Total', sum(p_partkey) FROM part UNION ALL SELECT 'p_size', 'Avg', avg(p_size) FROM part)
SELECT *, CASE WHEN abs(value) >= 1e9 THEN printf('%.2fB', value / 1e9) WHEN abs(value) >= 1e6 THEN printf('%.2fM', value / 1e6)
  WHEN abs(value) >= 1e3 THEN printf('%.1fK', value / 1e3)
  WHEN "column" = 'p_retailprice' THEN printf('$%.2f', value) ELSE printf('%.2f', value) END AS text FROM v
""", approx="value")
def format_kpi(t):
    rules = {"p_retailprice": "mean", "p_partkey": "sum", "p_size": "mean"}
    return charts.format_kpi(charts.kpi(t.part, rules), list(rules))


@query("d6_record_count", "SELECT count(*) AS total_records FROM lineitem")
def record_count(t):
    return charts.record_count(t.lineitem)


@query("d6_top_values", "\nUNION ALL ".join(
    f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM {src} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    for c, src in (("p_brand", "part"), ("p_type", "part"), ("p_name", "part"))))
def top_values(t):
    return charts.top_values(t.part, ["p_brand", "p_type", "p_name"])


@query("d7_value_counts", """
SELECT p_brand, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 15
""")
def value_counts(t):
    return charts.value_counts(lines_with_parts(t), "p_brand", 15)


@query("d8_monthly_counts", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24
""")
def monthly_counts(t):
    return charts.monthly_counts(t.orders, "o_orderdate")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("d9_crosstab", "SELECT c_mktsegment, " + ", ".join(
    f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES
) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def crosstab(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return charts.crosstab(df, "c_mktsegment", "o_orderpriority")


@query("d10_target_over_time", """
SELECT o_orderdate, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderdate
""", approx="o_totalprice")
def target_over_time(t):
    return charts.target_over_time(t.orders, "o_orderdate", "o_totalprice", "mean")


@query("d11_target_by", """
SELECT p_brand, round(avg(l_extendedprice), 2) AS l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 15
""")
def target_by(t):
    return charts.target_by(lines_with_parts(t), "p_brand", "l_extendedprice", "mean")


@query("d12_target_by_second", """
SELECT n_name, round(sum(o_totalprice), 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 15
""", approx="o_totalprice")
def target_by_second(t):
    df = (
        t.orders.select("o_custkey", "o_totalprice")
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return charts.target_by(df, "n_name", "o_totalprice", "sum")


@query("d13_scatter_ols", """
SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
       regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY l_returnflag
""", approx="slope intercept", digits=6)
def scatter_ols(t):
    return charts.scatter_ols(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("d13_scatter_points", """
SELECT l_quantity, l_extendedprice FROM lineitem
ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000
""")
def scatter_points(t):
    return charts.scatter_points(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("d14_corr_matrix", "\nUNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in CORR for b in CORR
))
def corr_matrix(t):
    return charts.corr_matrix(t.lineitem, CORR).withColumn("r", F.round("r", 8) + F.lit(0.0))


@query("d15_waterfall", """
WITH g AS (SELECT o_orderdate, sum(o_totalprice) AS total FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
SELECT o_orderdate, total, coalesce(total - lag(total) OVER (ORDER BY o_orderdate), total) AS delta FROM g
""", approx="total delta")
def waterfall(t):
    return charts.waterfall(t.orders, "o_orderdate", "o_totalprice")


@query("d16_by_country", NAMED_SQL + """
SELECT code AS iso3, sum(c_acctbal) AS c_acctbal FROM named JOIN iso ON lower(named.country) = iso.country GROUP BY code
""", approx="c_acctbal")
def by_country(t):
    df = t.sql(NAMED_NATIONS, "customer")
    assert charts.country_column(df, ["country"]) == "country"
    return charts.by_country(df, "country", "c_acctbal")


@query("d16_late_country", NAMED_SQL + """
SELECT code AS iso3, sum(c_acctbal) AS c_acctbal FROM named JOIN iso ON lower(named.country) = iso.country GROUP BY code
""", approx="c_acctbal")
def late_country(t):
    """The country column is found although the first rows hold none."""
    df = t.sql(NAMED_NATIONS, "customer").withColumn("kind", F.lit("none"))
    first = t.customer.limit(60).select(F.lit(None).cast("bigint").alias("c_custkey"), F.lit(0.0).alias("c_acctbal"),
                                        F.lit("?").alias("country"), F.lit("none").alias("kind"))
    df = first.unionByName(df)
    return charts.by_country(df, charts.country_column(df, ["kind", "country"]), "c_acctbal")


LONG = "a label that is longer than twenty characters: "


@query("d11_long_labels", f"""
SELECT concat('{LONG}', o_orderpriority) AS label, round(avg(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1
""", approx="o_totalprice")
def long_labels(t):
    df = t.orders.select(F.concat(F.lit(LONG), "o_orderpriority").alias("label"), "o_totalprice")
    return charts.target_by(df, "label", "o_totalprice", "mean")


@query("d17_treemap", """
SELECT p_brand, sum(l_quantity) AS l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 20
""")
def treemap(t):
    return charts.treemap(lines_with_parts(t), "p_brand", "l_quantity")


HISTOGRAM_SQL = """
SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins} - 1) AS INTEGER) AS bin,
       count(*) AS count FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2
"""


@query("d18_histogram", "\nUNION ALL ".join(
    HISTOGRAM_SQL.replace("{c}", c).replace("{bins}", "25") for c in ("l_quantity", "l_extendedprice", "l_tax")
))
def histogram(t):
    return charts.histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).select("column", "bin", "count")


# A price per event: base value by hour position, the same text on both sides.
PRICES = """
SELECT event_id, ts, event_type, 100 + value AS open, 100 + value * 1.25 AS high, 100 + value * 0.5 AS low,
       100 + value / 0.97 AS close, value AS volume FROM {events}
"""
PRICES_SQL = "WITH p AS (" + PRICES.replace("{events}", "events") + ")\n"


def prices(t):
    return t.sql(PRICES, "events")


@query("d19_ohlc_weekly", PRICES_SQL + """
SELECT CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, ts) AS close FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 200
""", approx="open high low close")
def ohlc_weekly(t):
    df = prices(t)
    names = charts.price_columns(df)
    return charts.ohlc_weekly(df, "ts", *[names[k] for k in ("open", "high", "low", "close")], tie=["event_id"])


@query("d20_moving_avg", PRICES_SQL + """
SELECT event_id, event_type, avg(close) OVER (w ROWS 49 PRECEDING) AS ma50, avg(close) OVER (w ROWS 199 PRECEDING) AS ma200
FROM p WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""".replace("OVER (w ROWS", "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS").replace(
    "FROM p WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)", "FROM p"), approx="ma50 ma200")
def moving_avg(t):
    df = prices(t).select("event_id", "event_type", "ts", "close")
    out = charts.moving_avg(df, ["ts", "event_id"], "close", partition_by=["event_type"])
    return out.select("event_id", "event_type", "ma50", "ma200")


@query("d21_monthly_sum", """
SELECT CAST(last_day(l_shipdate) AS TIMESTAMP) AS month_end, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1
""", approx="l_quantity")
def monthly_sum(t):
    return charts.monthly_sum(t.lineitem, "l_shipdate", "l_quantity")


RETURNS_SQL = PRICES_SQL + """,
r AS (SELECT event_id, (close / lag(close) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) * 100 AS return_pct FROM p)
"""


@query("d22_returns", RETURNS_SQL + "SELECT event_id, return_pct FROM r WHERE return_pct BETWEEN -20 AND 20",
       approx="return_pct")
def returns(t):
    out = charts.returns(prices(t), ["ts", "event_id"], "close", partition_by=["event_type"])
    return out.select("event_id", "return_pct")


@query("d22_returns_histogram", RETURNS_SQL + """,
k AS (SELECT return_pct AS x FROM r WHERE return_pct BETWEEN -20 AND 20)
SELECT 'return_pct' AS "column", CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS count
FROM k, (SELECT min(x) AS lo, max(x) AS hi FROM k) GROUP BY 2
""")
def returns_histogram(t):
    out = charts.returns(prices(t), ["ts", "event_id"], "close", partition_by=["event_type"])
    return charts.histogram(out, ["return_pct"], 50).select("column", "bin", "count")


PLACES = """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE (c_custkey * 37) % 180 - 90.0 END AS latitude,
       (c_custkey * 91) % 360 - 180.0 AS longitude FROM {customer}
"""


def places(t):
    return t.sql(PLACES, "customer").withColumns(
        {c: F.col(c).cast("double") for c in ("latitude", "longitude")}
    )


@query("d23_geo_points", """
SELECT c_custkey, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude
FROM (""" + PLACES.replace("{customer}", "customer") + """)
WHERE latitude IS NOT NULL ORDER BY c_custkey LIMIT 2000
""")
def geo_points(t):
    df = places(t)
    return charts.geo_points(df, *charts.coordinate_columns(df), key=["c_custkey"])


@query("d23_geo_grid", """
SELECT CAST(floor(latitude / 10) * 10 AS DOUBLE) AS latitude, CAST(floor(longitude / 10) * 10 AS DOUBLE) AS longitude,
       count(*) AS count FROM (""" + PLACES.replace("{customer}", "customer") + """)
WHERE latitude IS NOT NULL GROUP BY 1, 2
""")
def geo_grid(t):
    return charts.geo_grid(places(t), "latitude", "longitude", 10.0)


SPEC_SQL = {
    "sum": "sum(l_quantity)", "mean": "avg(l_quantity)", "count": "count(l_quantity)",
    "max": "max(l_quantity)", "min": "min(l_quantity)",
}


@query("d24_chart_spec", "\nUNION ALL ".join(
    f"(SELECT '{agg}' AS agg, p_brand, CAST({sql} AS DOUBLE) AS l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey "
    f"GROUP BY p_brand ORDER BY 3 DESC, 2 LIMIT 7)" for agg, sql in SPEC_SQL.items()
), approx="l_quantity")
def chart_spec(t):
    df = lines_with_parts(t)
    parts = [
        charts.chart(df, {"x": "p_brand", "y": "l_quantity", "agg": agg, "top_n": 7, "type": "bar"}).select(
            F.lit(agg).alias("agg"), "p_brand", F.col("l_quantity").cast("double").alias("l_quantity")
        )
        for agg in SPEC_SQL
    ]
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("d24_chart_box", """
SELECT l_returnflag, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q1,
       quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3,
       max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag
""", approx="min q1 median q3 max")
def chart_box(t):
    return charts.chart(t.pick("lineitem", "l_returnflag", "l_extendedprice"), {"x": "l_returnflag", "y": "l_extendedprice", "type": "box"})


@query("d24_chart_first_rows", "SELECT p_name, p_brand FROM part ORDER BY p_partkey LIMIT 12")
def chart_first_rows(t):
    return charts.chart(t.part, {"x": "p_name", "y": "p_brand", "agg": "sum", "top_n": 12}, key=["p_partkey"])


@query("d25_default_chart", """
SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15
""", approx="c_acctbal")
def default_chart(t):
    df = t.customer.select("c_acctbal", "c_mktsegment")
    return charts.default_chart(df, semantic_profile(df))


MEASURES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("d26_dashboard_values", "\nUNION ALL ".join([
    "SELECT 'records' AS chart, 'total' AS label, CAST(count(*) AS DOUBLE) AS value FROM lineitem",
    *[f"SELECT 'kpi', '{c}', {agg}({c}) FROM lineitem" for c, agg in
      (("l_extendedprice", "avg"), ("l_orderkey", "sum"), ("l_partkey", "sum"), ("l_suppkey", "avg"))],
    "SELECT 'target_by', l_returnflag, sum(l_orderkey) FROM lineitem GROUP BY 2",
    "SELECT 'donut', l_returnflag, count(*) FROM lineitem GROUP BY 2",
    "SELECT 'treemap', l_returnflag, sum(l_orderkey) FROM lineitem GROUP BY 2",
    "SELECT 'target_by_second', l_linestatus, sum(l_orderkey) FROM lineitem GROUP BY 2",
    "SELECT 'scatter_line', l_returnflag, regr_slope(l_partkey, l_orderkey) FROM lineitem GROUP BY 2",
    "SELECT 'target_over_time', CAST(CAST(l_shipdate AS DATE) AS VARCHAR), sum(l_orderkey) FROM lineitem GROUP BY 2",
    *[f"SELECT 'correlation', '{a}/{b}', round(corr({a}, {b}), 8) FROM lineitem" for a in MEASURES for b in MEASURES],
]), approx="value", digits=6)
def dashboard_values(t):
    """The values of the charts of the whole dashboard of lineitem."""
    made = dashboard(t.lineitem, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    shown = {
        "records": (F.lit("total"), "total_records"), "kpi": (F.col("column"), "value"),
        "target_by": (F.col("l_returnflag"), "l_orderkey"), "donut": (F.col("l_returnflag"), "count"),
        "treemap": (F.col("l_returnflag"), "l_orderkey"), "target_by_second": (F.col("l_linestatus"), "l_orderkey"),
        "scatter_line": (F.col("l_returnflag"), "slope"),
        "target_over_time": (F.col("l_shipdate").cast("date").cast("string"), "l_orderkey"),
        "correlation": (F.concat("x", F.lit("/"), "y"), F.round("r", 8) + F.lit(0.0)),
    }
    parts = [
        made[n].select(F.lit(n).alias("chart"), label.alias("label"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"))
        for n, (label, v) in shown.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("d26_dashboard", """
WITH n AS (SELECT count(DISTINCT l_shipdate) AS days, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS states FROM lineitem),
h AS (""" + "\nUNION ALL ".join(
    HISTOGRAM_SQL.replace("{c}", c).replace("{bins}", "25") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
) + """)
SELECT 'records' AS chart, CAST(1 AS BIGINT) AS rows UNION ALL SELECT 'kpi', 4 UNION ALL SELECT 'kpi_trend', 4
UNION ALL SELECT 'target_over_time', days FROM n UNION ALL SELECT 'target_by', least(flags, 15) FROM n
UNION ALL SELECT 'donut', least(flags, 8) FROM n UNION ALL SELECT 'treemap', least(flags, 20) FROM n
UNION ALL SELECT 'target_by_second', least(states, 15) FROM n UNION ALL SELECT 'scatter_line', flags FROM n
UNION ALL SELECT 'correlation', 64 UNION ALL SELECT 'waterfall', least(days, 12) FROM n
UNION ALL SELECT 'histograms', (SELECT count(*) FROM h)
""")
def full_dashboard(t):
    """Names and row counts of every chart of the whole dashboard of lineitem."""
    made = dashboard(t.lineitem, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("chart"), "rows") for n, df in made.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
