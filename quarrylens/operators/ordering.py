"""Row order without moving a table, or one hot key, into a single task.

Order-sensitive operators need a dense row index, rows before the current row,
or running totals. A plain window would put a whole key group into one task, so
the table is range-partitioned on (key, order), which splits hot keys, and the
window then runs on blocks of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.session import materialize, quoted

SLOT_BITS = 33  # monotonically_increasing_id(): partition number above, row below
BLOCK_ROWS = 1 << 16


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets NULL keys match, keeping the left key columns."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    added = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *added)


PARTITION_BYTES = 128 << 20
UNKNOWN_BYTES = 1 << 60  # Spark's own guess for inputs that are no files is larger


def range_partitions(df: DataFrame) -> int:
    """Partitions of a range shuffle: the session's number, or more for a table that would not fit them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(n for n in sizes if n < UNKNOWN_BYTES)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-read // PARTITION_BYTES))


def with_index(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Add the 0-based position of each row in (partition_by, order_by) order.

    The position runs over the whole table; keys are contiguous in it. One range
    shuffle; the only thing gathered is one row count per partition. A hash of the
    row breaks ties, so rows that share an order value can still be split and the
    result does not depend on their placement.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    keys = [*partition_by, *order_by, "_tie"]
    placed = materialize(
        df.withColumn("_tie", F.xxhash64(*[quoted(c) for c in hashable]))
        .repartitionByRange(range_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", SLOT_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # one row per shuffle partition: bounded by the partition count, not by the data
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)))
        .drop("_part", "_slot", "_offset")
    )


def key_position(indexed: DataFrame, partition_by: Sequence[str], name: str = "pos") -> DataFrame:
    """Turn the table-wide ``idx`` into a 0-based position inside each key, plus key size."""
    if not partition_by:
        size = indexed.agg(F.count(F.lit(1))).scalar()
        return indexed.withColumn(name, F.col("idx")).withColumn("key_rows", size)
    keys = list(partition_by)
    starts = indexed.groupBy(*keys).agg(
        F.min("idx").alias("_start"), F.count(F.lit(1)).alias("key_rows")
    )
    placed = join_keys(indexed, starts, keys)
    return placed.withColumn(name, F.col("idx") - F.col("_start")).drop("_start")


def neighbours(
    indexed: DataFrame,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    partition_by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` ahead, in ``idx`` order.

    Each block also receives the rows next to its edges from the blocks around it, so
    results equal those of one window over the whole key.
    """
    size = max(block_rows, 4 * max(before, after))
    block, place = F.floor(F.col("idx") / size), F.col("idx") % size
    copies = F.array(
        block,
        F.when(place >= size - before, block + 1),
        F.when((place < after) & (block > 0), block - 1),
    )
    window = Window.partitionBy(*partition_by, "_block").orderBy("idx")
    blocked = indexed.withColumn("_block", F.explode(F.filter(copies, lambda b: b.isNotNull())))
    return (
        blocked.withColumns(dict(columns(window)))
        .where(F.col("_block") == block)
        .drop("_block")
    )


def preceding(
    indexed: DataFrame,
    before: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    partition_by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """:func:`neighbours` looking back only."""
    return neighbours(indexed, columns, before, 0, partition_by, block_rows)


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    sums: Mapping[str, Column | str],
    partition_by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inclusive running sums per key. ``order_by`` must be unique within a key."""
    keys = list(partition_by)
    inputs = {f"_in_{out}": F.col(e) if isinstance(e, str) else e for out, e in sums.items()}
    indexed = with_index(df.withColumns(inputs), order_by, keys)
    blocked = indexed.withColumn("_block", F.floor(F.col("idx") / block_rows))
    totals = blocked.groupBy(*keys, "_block").agg(
        *[F.sum(f"_in_{out}").alias(f"_t_{out}") for out in sums]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = totals.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_b_{out}") for out in sums],
    )
    here = (
        Window.partitionBy(*keys, "_block")
        .orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return join_keys(blocked, bases, [*keys, "_block"]).withColumns(
        {out: F.col(f"_b_{out}") + F.sum(f"_in_{out}").over(here) for out in sums}
    ).drop("_block", "idx", *inputs, *[f"_b_{out}" for out in sums])


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column and distinct value: column, value, average rank (1-based).

    All columns share one pass and one sort. Ties are collapsed before anything is
    ordered, so a value shared by a third of the rows is one row here.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns
    ]
    long = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    return running_totals(counts, ["value"], {"_upto": "_n"}, ["column"]).select(
        "column", "value", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("rank")
    )


def rank_rows(
    df: DataFrame,
    order_by: str,
    partition_by: Sequence[str] = (),
    tie: Sequence[str] = (),
    tiles: int = 4,
) -> DataFrame:
    """row_number, rank, dense_rank and ntile for keys too large for one task."""
    keys = list(partition_by)
    placed = key_position(with_index(df, [order_by, *tie], keys), keys)
    size, extra = F.floor(F.col("key_rows") / tiles), F.col("key_rows") % tiles
    wide = extra * (size + 1)  # rows in the tiles that hold one row more
    tile = F.when(F.col("pos") < wide, F.floor(F.col("pos") / (size + 1))).otherwise(
        extra + F.floor((F.col("pos") - wide) / F.when(size > 0, size))
    )
    # one order serves all four: rank is the place of the latest new value, dense_rank their number
    new = lambda w: {"_new": (F.col("pos") == 0) | ~F.lag(quoted(order_by)).over(w).eqNullSafe(quoted(order_by))}
    flagged = neighbours(placed, new, 1, 0, keys).withColumn("_block", F.floor(F.col("idx") / BLOCK_ROWS))
    starts, count = F.when(F.col("_new"), F.col("pos") + 1), F.col("_new").cast("bigint")
    totals = flagged.groupBy(*keys, "_block").agg(F.max(starts).alias("_last"), F.sum(count).alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *keys, "_block", F.max("_last").over(earlier).alias("_rank"), F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_dense")
    )
    here = Window.partitionBy(*keys, "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = join_keys(flagged, bases, [*keys, "_block"])
    return rows.withColumns(
        {
            "row_number": F.col("pos") + 1, "ntile": tile + 1,
            "rank": F.coalesce(F.max(starts).over(here), F.col("_rank")),
            "dense_rank": F.col("_dense") + F.sum(count).over(here),
        }
    ).drop("idx", "pos", "key_rows", "_new", "_block", "_rank", "_dense")


def carry_forward(
    indexed: DataFrame,
    columns: Mapping[str, str],
    partition_by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Last non-NULL value up to and including each row, per key in ``idx`` order.

    ``columns`` maps an output name to its input column.
    """
    keys = [*partition_by, "_block"]
    blocked = indexed.withColumn("_block", F.floor(F.col("idx") / block_rows))
    lasts = blocked.groupBy(*keys).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(f"_l_{out}")
            for out, c in columns.items()
        ]
    )
    earlier = (
        Window.partitionBy(*partition_by)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = lasts.select(
        *keys, *[F.last(f"_l_{out}", True).over(earlier).alias(f"_b_{out}") for out in columns]
    )
    here = (
        Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    )
    return join_keys(blocked, bases, keys).withColumns(
        {
            out: F.coalesce(F.last(c, True).over(here), F.col(f"_b_{out}"))
            for out, c in columns.items()
        }
    ).drop("_block", *[f"_b_{out}" for out in columns])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    values: Sequence[str],
    tie: Sequence[str] = (),
) -> DataFrame:
    """Each left row with the latest right ``values`` at or before its ``on``, per ``by`` key.

    Both sides are ordered together once and right values are carried forward, so a
    hot key is split across blocks like any other stretch of rows. ``tie`` names left
    columns that make the left order unique.
    """
    kept = left.withColumn("_side", F.lit(1))
    # wrapped, so that a NULL right value counts as the latest value, too
    rows = right.select(*by, on, F.lit(0).alias("_side"), F.struct(*values).alias("_row"))
    merged = kept.unionByName(rows, allowMissingColumns=True)
    indexed = with_index(merged, [on, "_side", *tie], by)
    filled = carry_forward(indexed, {"_latest": "_row"}, by)
    return filled.where("_side = 1").select(
        *left.columns, *[F.col(f"_latest.{v}").alias(v) for v in values]
    )
