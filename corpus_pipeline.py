"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import fresh, keyed, small
from quarrylens.llm.decontaminate import find_leaks
from quarrylens.llm.line_dedup import dedup_lines
from quarrylens.llm.near_dedup import near_duplicates
from quarrylens.llm.packing import pack
from quarrylens.llm.quality import keep_good
from quarrylens.session import materialize, scratch_folder, table


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``gone``."""
    return docs.join(small(materialize(gone.select(F.col("doc_id").alias(key)).distinct()), 16), key, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Every row is judged by its own text alone, null, empty, repeated or very long; an empty
    table stays empty.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their duplicate lines; a document that loses all its lines goes.

    Rows with a null id come after all others, and rows that share an id have lines of
    their own; of rows equal in id and text, each keeps what the others keep. Texts without
    a line (null, empty, blank) stay as they are.
    """
    keyed_docs, key = keyed(docs)
    lines, dropped = fresh(keyed_docs, "lines"), fresh(keyed_docs, "dropped_lines")
    found = dedup_lines(keyed_docs, id_column=key, lines_column=lines, dropped_column=dropped)
    found = found.where((F.col(lines) == 0) | (F.col(dropped) < F.col(lines)))
    if "n_chars" in found.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(found.schema["n_chars"].dataType))
    return found.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at five-word shingles and 0.8: the one of the smallest id.

    Rows that share an id are compared as documents of their own, rows with a null id come
    after all others, and of rows equal in id and text one stays. Null, empty and blank
    texts are alike to nothing and stay.
    """
    keyed_docs, key = keyed(docs)
    twice = keyed_docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        keyed_docs = keyed_docs.dropDuplicates([key])
    gone = near_duplicates(keyed_docs, size=5, percent=80, id_column=key).where("NOT kept")
    return without(keyed_docs, key, gone).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; a row goes by its own text, whatever its id.

    Null and empty texts stay; a text of any length is searched whole.
    """
    keyed_docs, key = keyed(docs)
    leaks = find_leaks(keyed_docs, table(spark, sf_dir, "benchmark"), id_column=key)
    return without(keyed_docs, key, leaks).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents by training sequence; every row is packed once, a null text as its end id alone."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Packing encodes with a tokenizer's merges and assigns greedily, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
