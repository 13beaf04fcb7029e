"""SQL over registered tables, and joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.frames import block_ranges
from quarrylens.operators.ordering import asof_join, with_index
from quarrylens.session import is_numeric, materialize, quoted


def table_name(name: str) -> str:
    """A name for SQL: no extension, at most 30 signs, and ``_`` for any that is no letter, digit or ``_``."""
    stem = name[: name.rfind(".")] if "." in name else name
    return "".join(sign if sign.isalnum() else "_" for sign in stem[:30])


def run_sql(tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Register the tables under their cleaned names and run SQL text on them.

    Two tables whose names are cut to the same one are an error: the text could mean either.
    """
    if not tables:
        raise ValueError("no tables to query")
    names: dict[str, str] = {}
    for name in tables:
        other = names.setdefault(table_name(name).lower(), name)
        if other != name:
            raise ValueError(f"tables {other!r} and {name!r} would both be called {table_name(name)!r}")
    for name, df in tables.items():
        df.createOrReplaceTempView(table_name(name))
    return next(iter(tables.values())).sparkSession.sql(sql)


def result_preview(df: DataFrame, order_by: Sequence, n: int = 25) -> DataFrame:
    """First rows of a result, by its first non-numeric and first numeric column."""
    label = next((f.name for f in df.schema if not is_numeric(f)), None)
    value = next((f.name for f in df.schema if is_numeric(f)), None)
    if label is None or value is None:
        raise ValueError("needs a numeric and a non-numeric column")
    return df.orderBy(*order_by).limit(n).select(quoted(label), quoted(value))


def range_join(
    left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, salt: int = 1,
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Rows of ``left`` whose ``value`` is in [low, high) of a ``right`` row.

    Intervals are cut into bins of ``width``, so the join is an equi-join on the bin
    and not a nested loop. ``salt`` splits a crowded bin into that many parts.

    ``totals`` maps a new column to a function (count, sum) and a column of ``left``: each
    right row with a match then comes once, with totals over all its left rows. No pair is
    made for them, so they cost what the two tables cost and not what their pairs would.
    """
    if totals is not None:
        return _range_totals(left, right, value, low, high, totals)
    bin_of = lambda c: F.floor(quoted(c) / width)
    spread = F.pmod(F.xxhash64(*[quoted(c) for c in left.columns]), F.lit(salt))
    rows = left.withColumns({"_bin": bin_of(value), "_salt": spread})
    pieces = right.where(quoted(low) < quoted(high)).withColumn(
        "_bin", F.explode(F.sequence(bin_of(low), bin_of(high)))
    )
    pieces = pieces.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
    joined = rows.join(pieces, ["_bin", "_salt"])
    return joined.where((quoted(value) >= quoted(low)) & (quoted(value) < quoted(high))).drop("_bin", "_salt")


def _range_totals(
    left: DataFrame, right: DataFrame, value: str, low: str, high: str, totals: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Right rows with totals over the left rows in their interval.

    Equal values are one point; an interval is a stretch of points, and a stretch is a few
    nodes of a binary tree over the points. Totals are only ever added, never subtracted.
    """
    first, names = {"count": F.count, "sum": F.sum}, {f"_t{i}": of for i, of in enumerate(totals.values())}
    summed = {name: F.sum(name) for name in names}
    points = left.where(quoted(value).isNotNull()).groupBy(quoted(value).alias("_at")).agg(
        *[first[function](quoted(c)).alias(name) for name, (function, c) in names.items()]
    )
    indexed = materialize(with_index(points, ["_at"]))
    bands = right.where(quoted(low) < quoted(high))
    edges = bands.select(F.explode(F.array(quoted(low), quoted(high))).alias("_at")).distinct()
    known = indexed.select("_at", F.col("idx").alias("_i"), F.col("_at").alias("_value"))
    found = asof_join(edges, known, "_at", [], ["_i", "_value"])
    below = F.coalesce(F.col("_i") + F.when(F.col("_value") < F.col("_at"), 1).otherwise(0), F.lit(0))  # points below the edge
    places = materialize(found.select("_at", below.alias("_below")))
    starts = places.select(F.col("_at").alias("_low"), F.col("_below").alias("_x"))
    ends = places.select(F.col("_at").alias("_high"), (F.col("_below") - 1).alias("_y"))
    placed = bands.withColumns({"_low": quoted(low), "_high": quoted(high)}).join(starts, "_low").join(ends, "_high")
    placed = placed.where("_x <= _y").drop("_low", "_high")
    nodes = indexed.select(F.col("idx").alias("_i"), *names)
    stretches = block_ranges(nodes, placed, [], summed)
    out = placed.join(stretches, ["_x", "_y"])
    return out.select(*[quoted(c) for c in right.columns], *[F.col(name).alias(c) for name, c in zip(names, totals)])
