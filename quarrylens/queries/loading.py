"""Sources and sinks, as round trips of whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from quarrylens.operators.profiling import quality
from quarrylens.plans.report import write_report
from quarrylens.queries.registry import query
from quarrylens.session import scratch_folder
from quarrylens.sources.files import export, load, load_many, malformed_lines, parse_json
from quarrylens.sources.text_table import text_to_table


def fresh_path(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}/{name}"


def write_lines(rows, path: str, header: str) -> None:
    """Write the text column ``value`` as lines; every task writes a file of its own, which begins with the header."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:  # the same fields as above, whatever may be null
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    rows.select("value").mapInArrow(headed, "value string").write.text(path)


@query("a1_csv_scan", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
""", approx="p_retailprice")
def csv_scan(t):
    path = fresh_path(t.spark, "part.csv")
    t.part.write.option("header", True).csv(path)
    return load(t.spark, path, "csv").withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("a1_csv_quoted_breaks", """
SELECT doc_id, text, lang FROM documents WHERE text <> ''
""")
def csv_quoted_breaks(t):
    """Texts with line breaks, quotes and separators, in quoted fields."""
    path = fresh_path(t.spark, "documents.csv")
    docs = t.pick("documents", "doc_id", "text", "lang").where("text <> ''")
    whole = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(**whole).csv(path)
    return load(t.spark, path, "csv").withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("a2_csv_quoted_breaks_malformed", """
SELECT CASE WHEN doc_id % 7 = 0 THEN 'malformed' ELSE 'whole' END AS kind, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents WHERE text <> '' GROUP BY 1
""")
def csv_quoted_breaks_malformed(t):
    """Records over several lines, some with a field too many: those are left out whole and listed whole."""
    path = fresh_path(t.spark, "documents.csv")
    record = F.concat(F.col("doc_id"), F.lit(';"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'), F.when(F.col("doc_id") % 7 == 0, ";x").otherwise(""))
    write_lines(t.documents.where("text <> ''").select(record.alias("value")), path, "key;words")
    good = load(t.spark, path, "csv", sep="auto").agg(
        F.lit("whole").alias("kind"), F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("words")).alias("chars")
    )
    # a listed record is a key, two separators, two quotes, a mark and the text with its quotes doubled
    line = F.regexp_replace(F.regexp_extract("line", '(?s)^[0-9]+;"(.*)";x$', 1), '""', '"')
    bad = malformed_lines(t.spark, path).agg(
        F.lit("malformed").alias("kind"), F.count(F.lit(1)).alias("rows"), F.sum(F.char_length(line)).alias("chars")
    )
    return good.unionByName(bad)


@query("a2_csv_sniffed", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
""", approx="o_totalprice")
def csv_sniffed(t):
    path = fresh_path(t.spark, "orders.csv")
    t.orders.drop("o_orderdate").write.option("header", True).option("sep", ";").csv(path)
    keys = {c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")}
    return load(t.spark, path, "csv", sep="auto").withColumns(keys)


@query("a3_json_flattened", """
SELECT event_id AS "id", event_type AS "what.type", value AS "what.value",
       CAST(json_extract(props, '$.k') AS BIGINT) AS "what.props.k"
FROM events
""", approx="what.value")
def json_flattened(t):
    path = fresh_path(t.spark, "events.jsonl")
    nested = t.events.select(
        F.col("event_id").alias("id"),
        F.struct(
            F.col("event_type").alias("type"), "value",
            F.from_json("props", "k bigint").alias("props"),
        ).alias("what"),
    )
    nested.write.json(path)
    return load(t.spark, path, "json")


@query("a3_json_column", """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events
""")
def json_column(t):
    return parse_json(t.events.select("event_id", "user_id", "props"), "props", "k bigint")


@query("a2_csv_malformed", """
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'malformed' WHEN o_orderkey % 5 = 0 THEN 'short' ELSE 'whole' END AS kind, count(*) AS rows,
       CAST(sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END) AS BIGINT) AS custkeys
FROM orders GROUP BY 1
""")
def csv_malformed(t):
    """Lines with too many fields are left out and counted; short ones end in NULLs."""
    line = F.concat_ws(";", "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderstatus")).otherwise(line)
    path = fresh_path(t.spark, "orders.csv")
    write_lines(t.orders.select(line.alias("value")), path, "key;custkey;priority")
    good = load(t.spark, path, "csv", sep="auto")
    kind = F.when(F.col("priority").isNull(), "short").otherwise("whole")
    counted = good.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.sum("custkey").cast("bigint").alias("custkeys"))
    bad = malformed_lines(t.spark, path).agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(bad.select(F.lit("malformed").alias("kind"), "rows", F.lit(None).cast("bigint").alias("custkeys")))


@query("a3_json_lines", """
SELECT event_id, event_type, value FROM events
""", approx="value")
def json_lines(t):
    """One value per line, whatever the file is called."""
    path = fresh_path(t.spark, "events.json")
    t.events.select("event_id", "event_type", "value").write.json(path)
    return load(t.spark, path, "json")


@query("a1_csv_late_encoding", """
SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'Müller' ELSE o_orderpriority END AS name FROM orders
""")
def csv_late_encoding(t):
    """A Latin-1 letter in the last line decides the encoding."""
    path = fresh_path(t.spark, "names.csv")
    last = t.orders.agg(F.max("o_orderkey")).scalar()
    name = F.when(F.col("o_orderkey") == last, "Müller").otherwise(F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", name.alias("name")).orderBy("o_orderkey")
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return load(t.spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("a4_text_to_table", """
SELECT c_custkey AS "CustomerID", c_name AS "Name", c_mktsegment AS "Segment", c_acctbal AS "Balance"
FROM customer
""", approx="Balance")
def key_value_text(t):
    line = F.concat(
        F.lit("CustomerID: "), F.col("c_custkey"), F.lit(" | Name: "), "c_name",
        F.lit(" | Segment: "), "c_mktsegment", F.lit(" | Balance: "), F.col("c_acctbal"),
    )
    path = fresh_path(t.spark, "customer.txt")
    t.customer.select(line.alias("value")).write.text(path)
    return text_to_table(t.spark.read.text(path))


@query("a5_load_many", """
SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def many_files(t):
    root = fresh_path(t.spark, "many")
    for name in ("nation", "region"):
        getattr(t, name).write.option("header", True).csv(f"{root}/{name}.csv")
    tables = load_many(t.spark, [f"{root}/nation.csv", f"{root}/region.csv"])
    joined = tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))


@query("a6_clean_csv_sink", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""", approx="c_acctbal")
def csv_sink(t):
    paths = export(t.customer, None, fresh_path(t.spark, "customer"))
    return t.spark.read.option("header", True).schema(t.customer.schema).csv(paths["clean"])


@query("a7_report_json_sink", """
SELECT 'c_mktsegment' AS "column", 0.0 AS missing_ratio,
       round(count(DISTINCT c_mktsegment) / count(*), 4) AS unique_ratio FROM customer
UNION ALL
SELECT 'c_acctbal', 0.0, round(count(DISTINCT c_acctbal) / count(*), 4) FROM customer
""", approx="missing_ratio unique_ratio")
def report_sink(t):
    df = t.customer.select("c_mktsegment", "c_acctbal")
    paths = export(df, quality(df), fresh_path(t.spark, "customer"))
    return t.spark.read.json(paths["report"]).select("column", "missing_ratio", "unique_ratio")


@query("a8_parquet_scan", """
SELECT l_shipdate, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07
""", approx="l_extendedprice")
def parquet_scan(t):
    df = load(t.spark, f"{t.directory}/lineitem.parquet", "parquet")
    return df.where(
        (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07)
    ).select("l_shipdate", "l_extendedprice")


@query("a7_table_report")
def full_report(t):
    """The whole command-line flow on a table, written and read back: rows per section."""
    part = t.part.select("p_partkey", F.col("p_retailprice").alias("unit_price"))
    lines = t.pick("lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    df = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    sales = F.col("l_quantity") * F.col("unit_price") * (1 - F.col("l_discount"))
    paths = write_report(df.withColumn("sales", sales), fresh_path(t.spark, "lineitem"), trees=10)
    report = t.spark.read.schema("section string, entry string").json(paths["report"])
    return report.groupBy("section").agg(F.count(F.lit(1)).alias("entries"))
