"""Catalogue ranking, text routing, sequences, emissions, run history."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.keywords import keyword_hits
from quarrylens.functions.lexicon import (
    CODONS,
    DOMAIN_KEYWORDS,
    EMISSION_FACTORS,
    RESOURCE_TYPES,
    TITLE_HINTS,
    TREE_TONNES,
    TRUSTED_DOMAINS,
    TYPE_WEIGHTS,
)
from quarrylens.session import quoted


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Does a short text contain any of a few words?"""
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of a few words a short text contains; many words or long texts are for ``keyword_hits``."""
    return reduce(Column.__add__, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


# --- search ------------------------------------------------------------------------------


def resource_type_of(url: Column) -> Column:
    lowered = F.lower(url)
    out = F.lit("Web")
    for name, words in reversed(RESOURCE_TYPES):
        out = F.when(any_of(lowered, words), name).otherwise(out)
    return out


def resource_type(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn("type", resource_type_of(quoted(url)))


def html_title(html: str) -> Column:
    return F.regexp_extract(quoted(html), r"<title>([^<]*)</title>", 1)


def relevance(df: DataFrame, title: str, url: str, query: str) -> DataFrame:
    """Score of each row for a query, with its resource type."""
    t, u = F.lower(quoted(title)), F.lower(quoted(url))
    words = sorted(set(query.lower().split()))
    weights = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair])
    typed = df.withColumn("type", resource_type_of(quoted(url)))
    score = (
        2.0 * hits(t, words)
        + 0.5 * hits(u, words)
        + 0.8 * F.try_element_at(weights, F.col("type"))
        + F.when(any_of(u, TRUSTED_DOMAINS), 3.0).otherwise(0.0)
        + 0.4 * hits(t, TITLE_HINTS)
    )
    return typed.withColumn("score", F.coalesce(score, F.lit(0.0)))


def search(
    df: DataFrame, query: str, title: str, url: str, key: str, file_type: str = "ALL",
    n: int = 20, offset: int = 0,
) -> DataFrame:
    """Best ``n`` rows after ``offset``: the first row (by ``key``) per URL, by score."""
    first = F.min_by(quoted(title), quoted(key)).alias(title)  # a hot URL shrinks to one row per task
    unique = df.groupBy(quoted(url).alias(url)).agg(first)
    scored = relevance(unique, title, url, query)
    if file_type != "ALL":
        scored = scored.where(F.col("type") == file_type)
    return scored.orderBy(F.desc("score"), url).offset(offset).limit(n)


# --- routing -----------------------------------------------------------------------------


def route(
    df: DataFrame, text: str, keywords: Mapping[str, Sequence[str]] = DOMAIN_KEYWORDS,
    default: str = "statistics",
) -> DataFrame:
    """Domain with the most keywords in each whole text (2 points each; first domain on ties).

    All vocabularies are looked up in one walk over the text.
    """
    names = F.array(*[F.lit(d) for d in keywords])
    found = fresh("_hits", df)
    most = F.array_max(found)
    counted = df.withColumn(found, keyword_hits(F.lower(quoted(text)), list(keywords.values())))
    return counted.withColumns(
        {
            "domain": F.when(most > 0, F.get(names, F.array_position(found, most).cast("int") - 1)).otherwise(default),
            "domain_score": 2 * most,
        }
    ).drop(found)


def fresh(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def table_context(df: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """Business context of a table by its column names; one row, ``detected_context``."""
    names = df.sparkSession.createDataFrame([(" ".join(df.columns).lower().replace("_", " "),)], "names string")
    return route(names, "names", vocabulary, default="general").select(
        F.col("domain").alias("detected_context"), F.col("domain_score").alias("score")
    )


# --- sequences ---------------------------------------------------------------------------


def sequence_stats(df: DataFrame, seq: str) -> DataFrame:
    """Base counts, GC share, Wallace melting temperature, complement and its reverse."""
    s = quoted(seq)
    size = F.length(s)
    count = lambda b: size - F.length(F.translate(s, b, ""))
    out = df.withColumns({"length": size, "a": count("A"), "t": count("T"), "g": count("G"), "c": count("C")})
    complement = F.translate(s, "ATCG", "TAGC")
    return out.withColumns(
        {
            "gc_pct": (F.col("g") + F.col("c")) / F.greatest(size, F.lit(1)) * 100,
            "tm": 2 * (F.col("a") + F.col("t")) + 4 * (F.col("g") + F.col("c")),
            "complement": complement,
            "reverse_complement": F.reverse(complement),
        }
    )


def codon_counts(df: DataFrame, seq: str) -> DataFrame:
    """Codons of all whole sequences with their residue; unknown codons show "?"."""
    residues = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t[: len(t) // 3 * 3] for t in batch.column(0).to_pylist() if t]
            units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<U3")
            codons, counts = np.unique(units, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codons.tolist(), pa.string()), pa.array(counts, pa.int64())], ["codon", "count"])

    counted = df.select(quoted(seq).cast("string")).mapInArrow(count, "codon string, count bigint").groupBy("codon").agg(F.sum("count").alias("count"))
    return counted.withColumn("residue", F.coalesce(F.try_element_at(residues, F.col("codon")), F.lit("?")))


# --- emissions ---------------------------------------------------------------------------


def emissions(
    activity: DataFrame, group: str, source: str, amount: str,
    factors: Mapping[str, float] | DataFrame = EMISSION_FACTORS,
) -> DataFrame:
    """Kilograms per group, tonnes, and trees needed to offset them.

    Activity is summed per (group, source) before the factors are applied.
    """
    if not isinstance(factors, DataFrame):
        factors = activity.sparkSession.createDataFrame(list(factors.items()), "source string, factor double")
    summed = activity.groupBy(quoted(group).alias(group), quoted(source).alias("source")).agg(
        F.sum(quoted(amount).cast("double")).alias("amount")
    )
    kg = F.sum(F.col("amount") * F.col("factor"))
    return summed.join(factors, "source").groupBy(group).agg(kg.alias("kg")).withColumns(
        {"tonnes": F.col("kg") / 1000, "trees": F.col("kg") / 1000 / TREE_TONNES}
    )


# --- run history -------------------------------------------------------------------------


def benchmark_compare(run: DataFrame, history: DataFrame | None) -> DataFrame:
    """Each metric of a run (context, metric, value) against the mean of past runs of its context."""
    if history is None:
        return run.withColumns(
            {"past_runs": F.lit(0).cast("bigint"), "past_mean": F.lit(None).cast("double"), "change_pct": F.lit(None).cast("double")}
        )
    past = history.groupBy("context", "metric").agg(
        F.count(F.lit(1)).alias("past_runs"), F.avg("value").alias("past_mean")
    )
    change = (F.col("value") - F.col("past_mean")) / F.abs(F.when(F.col("past_mean") != 0, F.col("past_mean"))) * 100
    return (
        run.join(past, ["context", "metric"], "left")
        .withColumn("past_runs", F.coalesce("past_runs", F.lit(0)))
        .withColumn("change_pct", change)
    )


def benchmark_store(run: DataFrame, path: str) -> None:
    """Append a run to the history."""
    run.select("context", "metric", "value").write.mode("append").parquet(path)
