"""Profile, roles, quality, semantic schema, insights, structure, trust, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import profiling
from quarrylens.operators.merging import relationships
from quarrylens.queries.registry import per_column, query

ORDERS_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice")
ORDERS_ALL = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LINE_ALL = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_NUMERIC = LINE_ALL[:8]


@query("c1_detect_schema", per_column(ORDERS_NUMERIC, """
SELECT '{c}' AS "column", 'numeric' AS type, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median,
       stddev_samp({c}) AS std, NULL AS min_date, NULL AS max_date, NULL AS unique_values, CAST(NULL AS BIGINT) AS unique_count
""", "orders") + """
UNION ALL SELECT 'o_orderdate', 'datetime', NULL, NULL, NULL, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'),
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), NULL, NULL FROM orders
""" + "".join(f"""
UNION ALL SELECT '{c}', 'categorical', NULL, NULL, NULL, NULL, NULL,
       string_agg(DISTINCT {c}, '|' ORDER BY {c}), NULL FROM orders
""" for c in ("o_orderstatus", "o_orderpriority")), approx="mean median std")
def detect_schema(t):
    out = profiling.detect_schema(t.orders).drop("position")
    return out.withColumn("unique_values", F.array_join("unique_values", "|"))


ROLE_SQL = """
SELECT '{c}' AS "column", CASE
  WHEN count(DISTINCT {c}) = count(*) AND count({c}) = count(*) THEN 'Primary Key'
  WHEN count(DISTINCT {c}) / count(*) > 0.1 AND count(DISTINCT {c}) / count(*) < 0.95 THEN 'Potential Foreign Key'
  WHEN {numeric} THEN 'Numeric Feature / Possible Target'
  WHEN count(DISTINCT {c}) < 20 THEN 'Categorical Feature' ELSE 'Text / Identifier' END AS role
"""


@query("c2_detect_roles", "\nUNION ALL ".join(
    ROLE_SQL.replace("{c}", c).replace("{numeric}", f"stddev_samp({c}) > 0" if c in LINE_NUMERIC else "FALSE")
    + " FROM lineitem" for c in LINE_ALL))
def detect_roles(t):
    return profiling.detect_roles(t.lineitem)


@query("c3_quality", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", 1 - count({c}) / count(*) AS missing_ratio, count(DISTINCT {c}) / count(*) AS unique_ratio,
       {f'round(skewness({c}), 8)' if c in LINE_NUMERIC else 'NULL'} AS skewness,
       {f'var_samp({c})' if c in LINE_NUMERIC else 'NULL'} AS variance FROM lineitem
""" for c in LINE_ALL), approx="missing_ratio unique_ratio variance")
def quality(t):
    out = profiling.quality(t.lineitem, digits=None)
    return out.withColumn("skewness", F.round("skewness", 8) + F.lit(0.0))


@query("c4_fingerprint", per_column(LINE_NUMERIC, """
SELECT '{c}' AS "column", {i} AS position, '{c}' AS name, count(DISTINCT {c}) AS nunique, count({c}) AS n,
       min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std, sum({c}) AS sum
""", "lineitem").join(["""
SELECT "column", CAST(position AS INTEGER) AS position,
  CASE WHEN name IN ('l_partkey', 'l_suppkey', 'l_orderkey', 'l_linenumber')
            AND nunique > 0.95 * (SELECT count(*) FROM lineitem) THEN 'id'
       WHEN nunique <= 2 THEN 'binary' ELSE 'measure' END AS role,
  CASE WHEN name IN ('l_extendedprice', 'l_discount') THEN 'mean'
       WHEN name = 'l_quantity' THEN 'sum'
       WHEN min >= 0 AND max <= 100 AND abs(mean) < 50 THEN 'mean' ELSE 'sum' END AS agg,
  nunique, n, min, max, mean, std, sum FROM (""", """)
UNION ALL SELECT 'l_returnflag', 8, 'dimension', 'sum', count(DISTINCT l_returnflag), count(l_returnflag), NULL, NULL, NULL, NULL, NULL FROM lineitem
UNION ALL SELECT 'l_linestatus', 9, 'dimension', 'sum', count(DISTINCT l_linestatus), count(l_linestatus), NULL, NULL, NULL, NULL, NULL FROM lineitem
UNION ALL SELECT 'l_shipdate', 10, 'temporal', 'sum', count(DISTINCT l_shipdate), count(l_shipdate), NULL, NULL, NULL, NULL, NULL FROM lineitem
"""]), approx="min max mean std sum")
def fingerprint(t):
    return profiling.fingerprint(t.lineitem, sample_size=0).drop("sample", "dtype")


def _sample_sql(column: str, source: str) -> str:
    texts = f"SELECT DISTINCT left(CAST({column} AS VARCHAR), 64) AS v FROM {source} WHERE {column} IS NOT NULL ORDER BY v LIMIT 3"
    return f"(SELECT string_agg(v, '|' ORDER BY v) FROM ({texts}))"


@query("c4_fingerprint_sample", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, {_sample_sql(c, 'documents')} AS sample"
    for c, kind in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
))
def fingerprint_sample(t):
    """Types and the smallest few values of every column; whole texts are not shuffled."""
    found = profiling.fingerprint(t.documents, sample_size=3)
    return found.select("column", "dtype", F.array_join("sample", "|").alias("sample"))


@query("c5_agg_type", """
WITH r AS (SELECT min(p_size) AS lo, max(p_size) AS hi, avg(p_size) AS m FROM part)
SELECT 'p_partkey' AS "column", 'sum' AS agg UNION ALL SELECT 'p_retailprice', 'mean'
UNION ALL SELECT 'p_size', CASE WHEN lo >= 0 AND hi <= 100 AND abs(m) < 50 THEN 'mean' ELSE 'sum' END FROM r
UNION ALL SELECT 'made_year', 'year' UNION ALL SELECT 'stock', 'year'
""")
def aggregation_rules(t):
    df = t.part.withColumns(
        {"made_year": F.lit(1990) + F.col("p_size") % 20, "stock": F.lit(1980) + F.col("p_size") % 10}
    )
    return profiling.aggregation_rules(df)


@query("c6_quality_overview", """
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS cols, CAST(1 AS BIGINT) AS measures, CAST(1 AS BIGINT) AS dimensions,
       CAST(1 AS BIGINT) AS temporals, CAST(0 AS BIGINT) AS entities,
       round(100 * ((1 - count(value) / count(*)) + (1 - count(kind) / count(*))) / 6, 1) AS missing_pct
FROM (SELECT CASE WHEN event_id % 3 = 1 THEN NULL ELSE value END AS value,
             CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS kind FROM events)
""")
def quality_overview(t):
    df = t.events.select(
        F.concat(F.lit("e"), "event_id").alias("event_key"), "ts",
        F.when(F.col("event_id") % 3 != 1, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 4 != 1, F.col("event_type")).alias("kind"),
        F.col("event_id").alias("event_number"),
        (F.col("user_id") % 2).alias("odd"),
    )
    return profiling.quality_overview(df)


@query("c7_smart_stats", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'avg' AS metric, avg({c}) AS value, quantile_cont({c}, 0.5) AS median,
       CAST(NULL AS DOUBLE) AS avg, max({c}) AS max FROM lineitem""" if rule == "mean" else
    f"""SELECT '{c}' AS "column", 'total' AS metric, sum({c}) AS value, CAST(NULL AS DOUBLE) AS median,
       avg({c}) AS avg, max({c}) AS max FROM lineitem"""
    for c, rule in (("l_orderkey", "sum"), ("l_partkey", "sum"), ("l_linenumber", "mean"),
                    ("l_quantity", "sum"), ("l_extendedprice", "mean"), ("l_discount", "mean"), ("l_tax", "mean"))
), approx="value median avg max")
def smart_stats(t):
    return profiling.smart_stats(t.lineitem.drop("l_suppkey"))


@query("c8_suggest", """
SELECT * FROM (VALUES
  (1, 'Top 10 l_returnflag by l_quantity'), (2, 'l_quantity trend over l_shipdate'),
  (3, 'l_quantity vs l_extendedprice'), (4, 'Correlation'), (5, 'Distribution of l_quantity'),
  (6, 'Six Sigma l_quantity'), (7, 'Regression: l_extendedprice ~ l_quantity'), (8, 'Build dashboard')
) AS v(rank, suggestion)
""")
def suggest(t):
    return profiling.suggest(
        t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    )


@query("c9_preview", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10
""", approx="o_totalprice")
def preview(t):
    return profiling.preview(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query("c10_semantic_types", """
SELECT * FROM (VALUES ('o_orderkey', 'identifier'), ('o_custkey', 'identifier'),
  ('o_orderstatus', 'categorical_or_text'), ('o_totalprice', 'monetary'), ('o_orderdate', 'datetime'),
  ('o_orderpriority', 'categorical_or_text'), ('tax_rate', 'percentage'), ('contact', 'phone')
) AS v("column", semantic_type)
""")
def semantic_types(t):
    df = t.orders.withColumns(
        {
            "tax_rate": F.col("o_orderkey") % 7 / 10.0,
            "contact": F.concat(F.lit("+49 30 "), F.lpad(F.col("o_custkey").cast("string"), 7, "0")),
        }
    )
    return profiling.semantic_types(df)


@query("c11_insights", """
SELECT 'o_custkey' AS "column", 'duplicate_identifier' AS insight, count(DISTINCT o_custkey) / count(*) AS value
FROM orders HAVING count(DISTINCT o_custkey) < count(*)
UNION ALL SELECT 'burst', 'high_skew', skewness(exp(o_totalprice / 40000.0)) FROM orders
  HAVING abs(skewness(exp(o_totalprice / 40000.0))) > 2
UNION ALL SELECT NULL, 'no_missing_values', NULL
""", approx="value", digits=7)
def insights(t):
    df = t.orders.withColumn("burst", F.exp(F.col("o_totalprice") / 40000.0))
    return profiling.insights(df)


@query("c12_low_variability", """
SELECT * FROM (
  SELECT 'l_quantity' AS "column", stddev_samp(l_quantity) AS value FROM lineitem
  UNION ALL SELECT 'l_linenumber', stddev_samp(l_linenumber) FROM lineitem
  UNION ALL SELECT 'l_discount', stddev_samp(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', stddev_samp(l_tax) FROM lineitem) WHERE value < 2
""", approx="value")
def low_variability(t):
    df = t.lineitem.select("l_quantity", "l_linenumber", "l_discount", "l_tax")
    return profiling.insights(df).where(F.col("insight") == "low_variability").drop("insight")


@query("c13_low_information", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column" FROM lineitem HAVING count(DISTINCT {c}) / count(*) < 0.01
""" for c in LINE_ALL))
def low_information(t):
    return profiling.structure(t.lineitem).where("low_information").select("column")


@query("c14_structure", """
WITH low AS (SELECT count(DISTINCT p_size) / count(*) < 0.01 AS size, count(DISTINCT p_name) / count(*) < 0.01 AS name,
                    count(DISTINCT p_brand) / count(*) < 0.01 AS brand, count(DISTINCT p_retailprice) / count(*) < 0.01 AS price,
                    count(DISTINCT p_size * p_retailprice) / count(*) < 0.01 AS stock,
                    var_samp(p_size * p_retailprice) > var_samp(p_retailprice) AS wide FROM part)
SELECT 'p_partkey' AS "column", 'identifier' AS structure, FALSE AS low_information, FALSE AS is_outcome, FALSE AS is_driver
UNION ALL SELECT 'p_name', 'dimension', name, FALSE, FALSE FROM low
UNION ALL SELECT 'p_brand', 'dimension', brand, FALSE, FALSE FROM low
UNION ALL SELECT 'p_size', CASE WHEN size THEN 'low_information' ELSE 'metric' END, size, FALSE, NOT size FROM low
UNION ALL SELECT 'p_retailprice', 'metric', price, NOT wide, wide FROM low
UNION ALL SELECT 'stock_value', 'metric', stock, wide, NOT wide FROM low
UNION ALL SELECT 'size_pct', 'derived_metric', size, FALSE, FALSE FROM low
""")
def structure(t):
    df = t.part.select(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
        (F.col("p_size") * F.col("p_retailprice")).alias("stock_value"),
        (F.col("p_size") / 50.0).alias("size_pct"),
    )
    return profiling.structure(df)


@query("c15_trust", """
WITH d AS (SELECT c_custkey % 30 AS ref, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS bal,
                  pow(c_acctbal / 1000, 3) AS cube, c_name FROM customer),
m AS (SELECT quantile_cont(ref, 0.5) AS r, quantile_cont(bal, 0.5) AS b, quantile_cont(cube, 0.5) AS c FROM d),
g AS (SELECT abs(ref - r) AS ref, abs(bal - b) AS bal, abs(cube - c) AS cube FROM d, m),
s AS (SELECT 3 * 1.4826 * quantile_cont(ref, 0.5) AS r, 3 * 1.4826 * quantile_cont(bal, 0.5) AS b,
             3 * 1.4826 * quantile_cont(cube, 0.5) AS c FROM g),
o AS (SELECT (count(*) FILTER (ref > r) + count(*) FILTER (bal > b) + count(*) FILTER (cube > c))
             / (count(ref) + count(bal) + count(cube)) AS share FROM g, s),
x AS (SELECT 75.0 AS schema_score, 100 * (1 - (SELECT (1 - count(bal) / count(*)) / 4 FROM d)) AS null_score,
             100 * (1 - share) AS outlier_score,
             (SELECT 100.0 * count(*) FILTER (ref IN (SELECT n_nationkey FROM nation)) / count(*) FROM d) AS relationship_score,
             100.0 AS text_structure_score FROM o)
SELECT *, (schema_score + null_score + outlier_score + relationship_score + text_structure_score) / 5 AS overall_score FROM x
""", approx="schema_score null_score outlier_score relationship_score text_structure_score overall_score")
def trust(t):
    df = t.customer.select(
        (F.col("c_custkey") % 30).alias("ref"),
        F.when(F.col("c_custkey") % 10 != 3, F.col("c_acctbal")).alias("bal"),
        F.pow(F.col("c_acctbal") / 1000, 3).alias("cube"),
        "c_name",
    )
    return profiling.trust(df, references=[("ref", t.nation, "n_nationkey")])


STAR = (
    ("region", "r_regionkey r_name"), ("nation", "n_nationkey n_name n_regionkey"),
    ("customer", "c_custkey c_name c_nationkey c_mktsegment"), ("orders", "o_orderkey o_custkey o_orderstatus"),
    ("lineitem", "l_orderkey l_linenumber l_returnflag"),
)


def _relationship_sql() -> str:
    columns = [(tab, c) for tab, cs in STAR for c in cs.split()]
    text = {"r_name", "n_name", "c_name", "c_mktsegment", "o_orderstatus", "l_returnflag"}
    parts = []
    for pt, pc in columns:
        for ct, cc in columns:
            if pt == ct or (pc in text) != (cc in text):
                continue
            parts.append(f"""
SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column,
       (SELECT count(*) FROM (SELECT DISTINCT {cc} AS v FROM {ct}) WHERE v IN (SELECT {pc} FROM {pt}))
       / (SELECT count(DISTINCT {cc}) FROM {ct}) AS containment
WHERE (SELECT count(DISTINCT {pc}) = count(*) FROM {pt})""")
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE containment >= 0.95"


@query("c16_relationships", _relationship_sql(), approx="containment")
def find_relationships(t):
    return relationships({name: getattr(t, name).select(*cols.split()) for name, cols in STAR})


@query("e13_feature_ranking", per_column(LINE_NUMERIC, """
SELECT '{c}' AS "column", var_samp({c}) * count(DISTINCT {c}) / count(*) AS score
""", "lineitem"), approx="score")
def feature_ranking(t):
    return profiling.feature_ranking(t.lineitem)
