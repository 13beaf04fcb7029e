"""Frames by order value (RANGE) for keys and frames too large for one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.ordering import BLOCK_ROWS, asof_join, join_keys, with_index
from quarrylens.session import is_datetime, materialize, quoted

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def _distance(x: float | timedelta, whole: bool) -> int | float:
    if isinstance(x, timedelta):
        return round(x.total_seconds() * 1_000_000)
    return int(x) if whole else float(x)


def block_ranges(nodes: DataFrame, ranges: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Totals of whole blocks x to y of a key: each range is a few nodes of a binary tree over the blocks."""
    top = nodes.agg(F.max("_i")).first()[0] or 0
    level, levels = nodes, [nodes.withColumn("_j", F.lit(0))]
    while top >> len(levels):
        level = materialize(level.groupBy(*keys, F.floor(F.col("_i") / 2).alias("_i")).agg(*[e.alias(c) for c, e in totals.items()]))
        levels.append(level.withColumn("_j", F.lit(len(levels))))
    tree = reduce(DataFrame.unionByName, levels)
    j = F.col("_j")
    wide = F.pow(F.lit(2.0), j)
    low, high = F.ceil(F.col("_x") / wide), F.floor((F.col("_y") + 1) / wide)  # nodes low to high - 1 of a level lie inside
    odd = lambda c: c % 2 == 1
    after = low + F.when(odd(low), 1).otherwise(0)
    pieces = ranges.select(*keys, "_x", "_y").distinct().withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    taken = F.array(F.when((low < high) & odd(low), low), F.when((after < high) & odd(high), high - 1))
    pieces = pieces.select(*keys, "_x", "_y", "_j", F.explode(F.filter(taken, lambda i: i.isNotNull())).alias("_i"))
    return join_keys(pieces, tree, [*keys, "_j", "_i"]).groupBy(*keys, "_x", "_y").agg(*[e.alias(c) for c, e in totals.items()])


def range_frames(
    df: DataFrame,
    order_by: str,
    outputs: Mapping[str, tuple[str, str]],
    before: float | timedelta = 0,
    after: float | timedelta = 0,
    partition_by: Sequence[str] = (),
    block_points: int = BLOCK_ROWS,
) -> DataFrame:
    """Aggregates over the rows of a key whose order value lies between ``before`` below and ``after`` above the row's.

    ``outputs`` maps a new column to a function (count, sum, avg, min, max) and its column.
    ``order_by`` is a number, or a date or time with time spans for distances. Rows without
    an order value form a frame of their own, as in SQL.

    Equal order values are one point first. Points of a key are dealt into blocks in their
    order. A frame is what it covers of its own block, the end of the block it starts in,
    the start of the block it ends in, and whole blocks between, which come from a binary
    tree of block totals. Edges are looked up only for frames that leave their block, so a
    frame may span the whole table and a key may hold all rows; no task has more than a block.
    """
    if bad := {f for f, _ in outputs.values()} - set(FUNCTIONS):
        raise ValueError(f"unknown functions {sorted(bad)}")
    keys, field = list(partition_by), df.schema[order_by]
    whole = is_datetime(field) or isinstance(field.dataType, T.IntegralType)
    value = F.unix_micros(quoted(order_by).cast("timestamp")) if is_datetime(field) else quoted(order_by).cast("bigint" if whole else "double")
    back, ahead = _distance(before, whole), _distance(after, whole)
    columns = list(dict.fromkeys(c for _, c in outputs.values()))
    named = {f"_{kind}{i}": (kind, c) for i, c in enumerate(columns) for kind in ("n", "s", "lo", "hi")}
    numeric = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in columns}
    named = {name: (kind, c) for name, (kind, c) in named.items() if kind != "s" or numeric[c]}
    first = {"n": F.count, "s": F.sum, "lo": F.min, "hi": F.max}
    again = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}
    totals = {name: again[kind](F.col(name)) for name, (kind, _) in named.items()}

    def over(window) -> list[Column]:
        return [totals[name].over(window) for name in named]

    rows = df.withColumn("_v", value)
    points = rows.groupBy(*keys, "_v").agg(*[first[kind](quoted(c)).alias(name) for name, (kind, c) in named.items()])
    lone = points.where("_v IS NULL")
    indexed = with_index(points.where("_v IS NOT NULL"), ["_v"], keys)
    block = Window.partitionBy(*keys, "_home")
    ordered = block.orderBy("_v")
    if whole:
        near = ordered.rangeBetween(-back, ahead)
        frame = [c.alias(name) for name, c in zip(named, over(near))]
    else:
        spec = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in [*keys, '_home'])} ORDER BY _v RANGE BETWEEN {back!r}D PRECEDING AND {ahead!r}D FOLLOWING)"
        sql = {"n": "sum", "s": "sum", "lo": "min", "hi": "max"}
        frame = [F.expr(f"{sql[kind]}({name}) {spec}").alias(name) for name, (kind, _) in named.items()]
    struct = lambda cells, name: F.struct(*[c.alias(n) for n, c in zip(named, cells)]).alias(name)
    to_here, from_here = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    placed = materialize(
        indexed.withColumn("_home", F.floor(F.col("idx") / block_points)).select(
            *keys, "_v", "_home", F.struct(*frame).alias("_own"), struct(over(to_here), "_upto"), struct(over(from_here), "_from"),
            struct([F.col(n) for n in named], "_self"), F.min("_v").over(block).alias("_least"), F.max("_v").over(block).alias("_most"),
        )
    )

    def edge(sign: int, reach, leaves: Column, part: str) -> DataFrame:
        """The part of the block in which a frame ends on one side, for frames that leave their own block there."""
        asked = placed.where(leaves).select(*keys, "_v", "_home", (sign * (F.col("_v") + sign * F.lit(reach))).alias("_at"))
        known = placed.select(*keys, (sign * F.col("_v")).alias("_at"), F.col("_home").alias("_end"), F.col(part).alias("_part"))
        found = asof_join(asked, known, "_at", keys, ["_end", "_part"], ["_v"])
        return materialize(found.where(sign * (F.col("_end") - F.col("_home")) > 0))

    parts = [placed.select(*keys, "_v", "_own.*")]
    right = edge(1, ahead, F.col("_v") + F.lit(ahead) > F.col("_most"), "_upto")
    left = edge(-1, back, F.col("_v") - F.lit(back) < F.col("_least"), "_from")
    ranges = left.select(*keys, "_v", (F.col("_end") + 1).alias("_x"), (F.col("_home") - 1).alias("_y"))
    ranges = ranges.unionByName(right.select(*keys, "_v", (F.col("_home") + 1).alias("_x"), (F.col("_end") - 1).alias("_y"))).where("_x <= _y")
    nodes = placed.select(*keys, F.col("_home").alias("_i"), "_self.*").groupBy(*keys, "_i").agg(*[e.alias(c) for c, e in totals.items()])
    between = block_ranges(materialize(nodes), ranges, keys, totals)
    parts += [right.select(*keys, "_v", "_part.*"), left.select(*keys, "_v", "_part.*")]
    parts.append(join_keys(ranges, between, [*keys, "_x", "_y"]).drop("_x", "_y"))
    parts.append(lone)
    found = reduce(DataFrame.unionByName, parts).groupBy(*keys, "_v").agg(*[e.alias(c) for c, e in totals.items()])

    def output(function: str, column: str) -> Column:
        at = columns.index(column)
        if function == "avg":
            return F.col(f"_s{at}") / F.col(f"_n{at}")
        return F.col({"count": "_n", "sum": "_s", "min": "_lo", "max": "_hi"}[function] + str(at))

    joined = join_keys(rows, found, [*keys, "_v"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[output(*o).alias(name) for name, o in outputs.items()])
