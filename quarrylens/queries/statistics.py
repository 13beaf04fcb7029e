"""Statistics over whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quarrylens.operators import statistics as st
from quarrylens.operators.profiling import describe
from quarrylens.queries.registry import per_column, query

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("e1_ols", """
WITH f AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
  regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem)
SELECT CAST(n AS BIGINT) AS n, slope, intercept, r2, sqrt(syy * (1 - r2) / (n - 2) / sxx) AS stderr,
       slope / sqrt(syy * (1 - r2) / (n - 2) / sxx) AS t FROM f
""", approx="slope intercept r2 stderr t", digits=6)
def ols(t):
    return st.ols(t.lineitem, "l_quantity", "l_extendedprice").drop("p", "ci95")


# The tail by Simpson's rule on the density, the 97.5% point by its expansion in 1 / degrees of freedom.
T_SQL = """
WITH f AS (SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
  regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY l_returnflag),
g AS (SELECT *, CAST(n - 2 AS DOUBLE) AS v, sqrt(syy * (1 - r2) / (n - 2) / sxx) AS se FROM f),
h AS (SELECT *, slope / se AS t, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) AS c FROM g),
s AS (SELECT l_returnflag, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + pow(abs(t) * k / 2000, 2) / v, -(v + 1) / 2)) * abs(t) / 2000 / 3 AS area
      FROM h, (SELECT unnest(range(0, 2001)) AS k) GROUP BY l_returnflag, t),
z AS (SELECT 1.959963984540054 AS z)
SELECT h.l_returnflag, CAST(n AS BIGINT) AS n, slope, intercept, r2, se AS stderr, t, 1 - 2 * c * area AS p,
       se * (z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
       + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3))) AS ci95
FROM h JOIN s ON h.l_returnflag = s.l_returnflag, z
"""


@query("e1_ols_p", T_SQL, approx="slope intercept r2 stderr t p ci95", digits=6)
def ols_p(t):
    return st.ols(t.lineitem, "l_quantity", "l_extendedprice", by=["l_returnflag"])


@query("e2_ols_residuals", """
WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part)
SELECT p_partkey, round(p_retailprice - (a + b * p_size), 6) AS residual FROM part, f
""")
def ols_residuals(t):
    out = st.ols_residuals(t.part, "p_size", "p_retailprice")
    return out.select("p_partkey", (F.round("residual", 6) + F.lit(0.0)).alias("residual"))


@query("e3_anova", """
WITH j AS (SELECT p_brand AS g, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
gr AS (SELECT g, count(x) AS n, avg(x) AS m, sum(x) AS s FROM j GROUP BY g HAVING count(*) > 2),
w AS (SELECT sum((x - m) * (x - m)) AS within FROM j JOIN gr USING (g)),
a AS (SELECT avg(x) AS grand FROM j),
b AS (SELECT count(*) AS k, sum(n) AS n, sum(n * pow(m - grand, 2)) AS between FROM gr, a)
SELECT CAST(k AS BIGINT) AS groups, CAST(n AS BIGINT) AS n, (between / (k - 1)) / (within / (n - k)) AS f,
       between / (within + between) AS eta2, CASE WHEN between / (within + between) > 0.14 THEN 'Large'
       WHEN between / (within + between) > 0.06 THEN 'Medium' ELSE 'Small' END AS effect FROM b, w
""", approx="f eta2", digits=7)
def anova(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return st.anova(df, "p_brand", "l_extendedprice").drop("df1", "df2", "p")


@query("e4_five_number", """
SELECT o_orderpriority, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1,
       quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max
FROM orders GROUP BY o_orderpriority
""", approx="min q1 median q3 max")
def five_number(t):
    return st.five_number(t.pick("orders", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")


def shipping_times(t):
    """Days from order to shipment; a finished line ('F') counts as the event."""
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.abs(F.datediff("l_shipdate", "o_orderdate"))
    return df.select(
        days.alias("days"), (F.col("l_linestatus") == "F").cast("int").alias("done"),
        F.col("l_returnflag").alias("flag"),
    )


SURVIVAL_SQL = """
WITH d AS (SELECT abs(date_diff('day', o_orderdate, l_shipdate)) AS t, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS e,
                  l_returnflag AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT g, t, sum(e) AS deaths, count(*) AS leaving FROM d GROUP BY g, t),
r AS (SELECT g, t, deaths, sum(leaving) OVER (PARTITION BY g ORDER BY t DESC) AS at_risk FROM s),
c AS (SELECT *, CASE WHEN min(at_risk - deaths) OVER w = 0 THEN 0.0
             ELSE exp(sum(CASE WHEN at_risk > deaths THEN ln(1 - deaths / at_risk) ELSE 0 END) OVER w) END AS survival
      FROM r WINDOW w AS (PARTITION BY g ORDER BY t))
"""


@query("e5_kaplan_meier", SURVIVAL_SQL + """
SELECT g AS "group", CAST(t AS INTEGER) AS time, CAST(at_risk AS BIGINT) AS at_risk, CAST(deaths AS BIGINT) AS deaths,
       round(survival, 8) AS survival FROM c
""")
def kaplan_meier(t):
    out = st.kaplan_meier(shipping_times(t), "days", "done", "flag")
    return out.withColumn("survival", F.round("survival", 8) + F.lit(0.0))


@query("e5_median_survival", SURVIVAL_SQL + """
SELECT g AS "group", CAST(min(t) FILTER (survival <= 0.5 + 1e-12) AS INTEGER) AS median_survival FROM c GROUP BY g
""")
def median_survival(t):
    return st.median_survival(st.kaplan_meier(shipping_times(t), "days", "done", "flag"))


def _pairs(table, cols, method="corr"):
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {method}({a}, {b}) AS r FROM {table}" for a, b in combinations(cols, 2)
    )


STRENGTH = "CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength"


@query("e6_pearson", f"""
SELECT x, y, round(r, 8) AS r, {STRENGTH} FROM ({_pairs("lineitem", (*NUMBERS, "l_linenumber"))}) ORDER BY abs(r) DESC LIMIT 8
""")
def pearson(t):
    out = st.correlations(t.lineitem, [*NUMBERS, "l_linenumber"])
    return out.withColumn("r", F.round("r", 8) + F.lit(0.0))


def _rank(c):
    return (
        f"(rank() OVER (ORDER BY {c}) + rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    )


@query("e6_spearman", f"""
WITH k AS (SELECT {", ".join(_rank(c) for c in NUMBERS)} FROM lineitem)
SELECT x, y, round(r, 8) AS r, {STRENGTH} FROM ({_pairs("k", NUMBERS)})
""")
def spearman(t):
    out = st.correlations(t.pick("lineitem", *NUMBERS), NUMBERS, "spearman")
    return out.withColumn("r", F.round("r", 8) + F.lit(0.0))


@query("e7_describe", per_column(NUMBERS, """
SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS sd,
       min({c}) AS min, max({c}) AS max, round(skewness({c}), 7) AS skewness, round(kurtosis({c}), 7) AS kurtosis
""", "lineitem"), approx="mean median sd min max")
def descriptives(t):
    out = describe(t.pick("lineitem", *NUMBERS), NUMBERS)
    return out.withColumns({c: F.round(c, 7) + F.lit(0.0) for c in ("skewness", "kurtosis")})


@query("e8_normality", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", n, n / 6.0 * (s * s + k * k / 4) AS jarque_bera FROM (
  SELECT count({c}) AS n, kurtosis_pop({c}) AS k,
         skewness({c}) * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1)) AS s FROM {src})
""" for c, src in (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_tax", "lineitem"))),
       approx="jarque_bera", digits=6)
def normality(t):
    return st.normality(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).drop("p")


# The normal distribution function by its power series: every term is positive.
CDF = """0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80),
  lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"""


@query("e8_order_test", "WITH v AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")
) + f"""),
f AS (SELECT "column", count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM v GROUP BY 1),
g AS (SELECT v."column", x, count(*) AS c, sum(count(*)) OVER (PARTITION BY v."column" ORDER BY x) AS upto FROM v GROUP BY 1, 2),
z AS (SELECT g."column", n, c, 2 * upto - c AS r, (x - m) / s AS z FROM g JOIN f ON f."column" = g."column"),
p AS (SELECT *, {CDF} AS p FROM z)
SELECT "column", n, -n - sum(c * (r * ln(p) + (2 * n - r) * ln(1 - p))) / n AS a2 FROM p GROUP BY "column", n
""", approx="a2", digits=5)
def order_test(t):
    return st.order_normality(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).drop("p")


@query("e9_density", """
WITH a AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w, count(*) AS n,
                  avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count FROM orders, a GROUP BY 1)
SELECT 'o_totalprice' AS "column", bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count,
       count / (n * w) AS density,
       exp(-pow((lo + (bin + 0.5) * w - m) / s, 2) / 2) / (s * sqrt(2 * pi())) AS normal FROM a, b
""", approx="low high density normal")
def density(t):
    return st.density(t.orders, "o_totalprice")


def scored_labels(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")


ROC_SQL = """
WITH j AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM j GROUP BY s),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM g)
"""


@query("e10_roc", ROC_SQL + """
SELECT CAST(s AS DOUBLE) AS threshold, fp / (SELECT sum(neg) FROM g) AS fpr, tp / (SELECT sum(pos) FROM g) AS tpr FROM c
UNION ALL SELECT NULL, 0.0, 0.0
""", approx="fpr tpr")
def roc(t):
    return st.roc(scored_labels(t), "quality", "n_chars")


@query("e10_auc", ROC_SQL + """
SELECT auc, CASE WHEN auc > 0.9 THEN 'Excellent' WHEN auc > 0.8 THEN 'Good' WHEN auc > 0.7 THEN 'Fair' ELSE 'Poor' END AS grade
FROM (SELECT sum(neg * (tp - pos / 2)) / (sum(neg) * sum(pos)) AS auc FROM c)
""", approx="auc")
def auc(t):
    return st.auc(scored_labels(t), "quality", "n_chars")


LINKED = """
SELECT l_quantity, l_extendedprice, l_quantity * 2 + l_tax AS twice, l_quantity * l_extendedprice AS volume FROM {lineitem}
"""
LINKED_COLS = ("l_quantity", "l_extendedprice", "twice", "volume")


@query("e11_strong_pairs", f"""
WITH d AS ({LINKED.replace("{lineitem}", "lineitem")}), k AS (SELECT {", ".join(_rank(c) for c in LINKED_COLS)} FROM d),
lin AS ({_pairs("d", LINKED_COLS)}), mon AS ({_pairs("k", LINKED_COLS)})
SELECT 'linear' AS kind, x, y, round(r, 8) AS r FROM lin WHERE abs(r) > 0.7
UNION ALL SELECT 'monotonic', x, y, round(r, 8) FROM mon WHERE abs(r) > 0.7
UNION ALL SELECT 'redundant', x, y, round(r, 8) FROM lin WHERE abs(r) > 0.95
""")
def strong_pairs(t):
    out = st.strong_pairs(t.sql(LINKED, "lineitem"), LINKED_COLS)
    return out.withColumn("r", F.round("r", 8))


def _bin_sql(c):
    return " + ".join(f"CASE WHEN {c} > (SELECT quantile_cont({c}, {k / 10}) FROM d) THEN 1 ELSE 0 END" for k in range(1, 10))


MI_COLS = ("l_quantity", "l_extendedprice", "volume")


@query("e12_mutual_information", f"""
WITH d AS (SELECT * FROM ({LINKED.replace("{lineitem}", "lineitem")})),
b AS (SELECT {", ".join(f"{_bin_sql(c)} AS {c}" for c in MI_COLS)} FROM d),
j AS ({" UNION ALL ".join(f"SELECT '{p}' AS x, '{q}' AS y, {p} AS a, {q} AS b, count(*) AS n FROM b GROUP BY {p}, {q}" for p, q in combinations(MI_COLS, 2))}),
m AS (SELECT *, sum(n) OVER (PARTITION BY x, y, a) AS na, sum(n) OVER (PARTITION BY x, y, b) AS nb,
             sum(n) OVER (PARTITION BY x, y) AS nt FROM j)
SELECT x, y, round(sum(n / nt * ln(n * nt / (na * nb))), 8) AS mutual_information FROM m GROUP BY x, y
""")
def mutual_information(t):
    out = st.mutual_information(t.sql(LINKED, "lineitem"), MI_COLS)
    return out.withColumn("mutual_information", F.round("mutual_information", 8))
