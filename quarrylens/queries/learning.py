"""Clustering, components and driver models over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import learning
from quarrylens.queries.registry import query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DRIVERS = ["l_quantity", "l_discount", "l_tax", "retail", "l_linenumber"]


def priced(t):
    """Lines with an outcome that really depends on some of the drivers."""
    part = t.part.select("p_partkey", F.col("p_retailprice").alias("retail"))
    df = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return df.withColumns(
        {
            "revenue": F.col("l_quantity") * F.col("retail") * (1 - F.col("l_discount")),
            "list_value": F.col("l_quantity") * F.col("retail"),
        }
    )


@query("m1_standardize", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in MEASURES
) + " FROM lineitem")
def standardize(t):
    out = learning.standardize(t.lineitem, MEASURES).select("l_orderkey", "l_linenumber", *MEASURES)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in MEASURES})


@query("m2_kmeans_elbow")
def kmeans_elbow(t):
    return learning.kmeans_elbow(t.pick("lineitem", *MEASURES), MEASURES)


@query("m3_kmeans_sizes")
def kmeans_sizes(t):
    return learning.cluster_sizes(learning.kmeans(t.pick("lineitem", *MEASURES), MEASURES))


@query("m4_cluster_profiles")
def cluster_profiles(t):
    return learning.cluster_profiles(learning.kmeans(t.pick("lineitem", *MEASURES), MEASURES), MEASURES)


# Three far groups of lines: their numbers, centres and spread are known without clustering.
PLANTED = "SELECT l_orderkey, l_linenumber % 3 AS g, (l_linenumber % 3) * 1000 + l_quantity AS x, pow(l_linenumber % 3, 2) * 500 - l_tax AS y FROM {lineitem}"
PLANTED_SQL = "WITH p AS (" + PLANTED.replace("{lineitem}", "lineitem") + ")"


def planted(t):
    return t.sql(PLANTED, "lineitem")


@query("m2_planted_elbow", PLANTED_SQL + """, c AS (SELECT g, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy FROM p GROUP BY g)
SELECT CAST(3 AS INTEGER) AS k, sum(n * vx) / (SELECT var_pop(x) FROM p) + sum(n * vy) / (SELECT var_pop(y) FROM p) AS inertia FROM c
""", approx="inertia", digits=4)
def planted_elbow(t):
    """Inertia at the planted number of clusters: the spread inside the groups."""
    return learning.kmeans_elbow(planted(t), ["x", "y"], kmax=3).where("k = 3")


@query("m3_planted_sizes", PLANTED_SQL + " SELECT count(*) AS samples, count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY g", approx="share")
def planted_sizes(t):
    return learning.cluster_sizes(learning.kmeans(planted(t), ["x", "y"], k=3)).drop("prediction")


@query("m4_planted_profiles", PLANTED_SQL + """, c AS (SELECT avg(x) AS x, avg(y) AS y FROM p GROUP BY g)
SELECT x, y, (x - (SELECT avg(x) FROM c)) / (SELECT stddev_pop(x) FROM c) AS x_z, (y - (SELECT avg(y) FROM c)) / (SELECT stddev_pop(y) FROM c) AS y_z FROM c
""", approx="x y x_z y_z", digits=6)
def planted_profiles(t):
    return learning.cluster_profiles(learning.kmeans(planted(t), ["x", "y"], k=3), ["x", "y"]).drop("prediction")


LINKED = "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * l_extendedprice AS volume FROM {lineitem}"
LINKED_SQL = "WITH d AS (" + LINKED.replace("{lineitem}", "lineitem") + ")"


@query("m5_two_components", LINKED_SQL + """, r AS (SELECT abs(corr(l_quantity, volume)) AS r FROM d)
SELECT 'PC1' AS component, (1 + r) / 2 AS explained, (1 + r) / 2 AS cumulative, TRUE AS within_90 FROM r
UNION ALL SELECT 'PC2', (1 - r) / 2, 1.0, (1 + r) / 2 < 0.9 FROM r
""", approx="explained cumulative", digits=6)
def two_components(t):
    """Two standardised columns: the shares follow from their correlation."""
    return learning.pca_variance(t.sql(LINKED, "lineitem"), ["l_quantity", "volume"])


@query("m6_first_component", LINKED_SQL + """
SELECT l_orderkey, l_linenumber, round(((l_quantity - (SELECT avg(l_quantity) FROM d)) / (SELECT stddev_pop(l_quantity) FROM d)
  + (volume - (SELECT avg(volume) FROM d)) / (SELECT stddev_pop(volume) FROM d)) / sqrt(2), 5) AS pc1 FROM d
""")
def first_component(t):
    out = learning.pca_scores(t.sql(LINKED, "lineitem"), ["l_quantity", "volume"], k=1, key=["l_orderkey", "l_linenumber"])
    return out.withColumn("pc1", F.round("pc1", 5) + F.lit(0.0))


@query("m5_pca_variance")
def pca_variance(t):
    return learning.pca_variance(t.lineitem, [*MEASURES, "l_linenumber"])


@query("m6_pca_scores")
def pca_scores(t):
    return learning.pca_scores(t.lineitem, MEASURES, key=["l_orderkey", "l_linenumber"])


@query("m7_forest_classify")
def forest_classify(t):
    return learning.forest_classify(t.pick("lineitem", "l_returnflag", *MEASURES), "l_returnflag", MEASURES, trees=20)


@query("m7_best_feature", """
SELECT f AS feature, TRUE AS separates FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) v(f), (
  SELECT abs(corr(l_quantity, y)) AS q, abs(corr(l_extendedprice, y)) AS e, abs(corr(l_discount, y)) AS d, abs(corr(l_tax, y)) AS t
  FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y FROM lineitem)) r
WHERE CASE f WHEN 'l_quantity' THEN q WHEN 'l_extendedprice' THEN e WHEN 'l_discount' THEN d ELSE t END = greatest(q, e, d, t)
""")
def best_feature(t):
    """A class that one column decides: it leads, and the holdout is all but perfect."""
    df = t.lineitem.withColumn("high", F.col("l_discount") > 0.05)
    out = learning.forest_classify(df, "high", MEASURES, trees=20).limit(1)
    return out.select("feature", ((F.col("holdout_accuracy") > 0.99) & (F.col("importance") > 0.5)).alias("separates"))


FILTER_SQL = """
WITH d AS (SELECT l_quantity * p_retailprice * (1 - l_discount) AS revenue, l_quantity, l_discount, l_tax,
           p_retailprice AS retail, l_quantity * p_retailprice AS list_value FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


@query("m8_filter_drivers", FILTER_SQL + "\nUNION ALL ".join(
    f"SELECT '{c}' AS driver, round(corr(revenue, {c}), 7) AS r, abs(corr(revenue, {c})) <= 0.8 AS kept FROM d"
    for c in ("l_quantity", "l_discount", "l_tax", "retail", "list_value")))
def filter_drivers(t):
    out = learning.filter_drivers(priced(t), "revenue", ["l_quantity", "l_discount", "l_tax", "retail", "list_value"])
    return out.withColumn("r", F.round("r", 7) + F.lit(0.0))


@query("m9_driver_model")
def driver_model(t):
    return learning.driver_model(priced(t), "revenue", DRIVERS, trees=30)[1]


@query("m9_driver_order", FILTER_SQL + """, r AS (SELECT abs(corr(revenue, l_quantity)) AS l_quantity, abs(corr(revenue, l_discount)) AS l_discount,
  abs(corr(revenue, l_tax)) AS l_tax, abs(corr(revenue, retail)) AS retail FROM d)
SELECT driver FROM (UNPIVOT r ON l_quantity, l_discount, l_tax, retail INTO NAME driver VALUE size) ORDER BY size DESC LIMIT 1
""")
def driver_order(t):
    """The driver with the largest importance is the one that moves most with the outcome."""
    return learning.driver_model(priced(t), "revenue", DRIVERS, trees=30)[1].limit(1).select(F.col("feature").alias("driver"))


@query("m11_clear_labels", """
SELECT * FROM (VALUES ('l_quantity', 'strong'), ('l_tax', 'limited')) v(driver, influence) WHERE (SELECT count(*) FROM lineitem) > 0
""")
def clear_labels(t):
    """Revenue is a multiple of the quantity and does not depend on the tax."""
    df = priced(t)
    model, _ = learning.driver_model(df, "revenue", DRIVERS, trees=30)
    labelled = learning.label_drivers(learning.what_if(df, model, DRIVERS))
    return labelled.where(F.col("driver").isin("l_quantity", "l_tax")).select("driver", "influence")


@query("m10_what_if")
def what_if(t):
    df = priced(t)
    model, _ = learning.driver_model(df, "revenue", DRIVERS, trees=30)
    return learning.what_if(df, model, DRIVERS)


@query("m11_label_drivers")
def label_drivers(t):
    df = priced(t)
    model, _ = learning.driver_model(df, "revenue", DRIVERS, trees=30)
    return learning.label_drivers(learning.what_if(df, model, DRIVERS))
