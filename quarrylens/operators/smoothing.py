"""Holt's additive trend with fitted parameters, for series of any length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylens.operators.ordering import join_keys
from quarrylens.operators.series import positioned
from quarrylens.session import materialize, quoted

#: Values that one task folds, and blocks that are joined at a time.
BLOCK, FAN = 4096, 64
COARSE = [round(0.05 + 0.1 * i, 2) for i in range(10)]
FINE = [round(0.02 * i, 2) for i in range(-4, 5)]
LEAST, MOST = 0.01, 0.99


def grid(centre: tuple[float, float] | None) -> np.ndarray:
    """Pairs (alpha, beta): the coarse ones, or the fine ones around a coarse one."""
    if centre is None:
        axes = [COARSE, COARSE]
    else:
        axes = [[min(MOST, max(LEAST, round(c + d, 2))) for d in FINE] for c in centre]
    return np.array([(a, b) for a in axes[0] for b in axes[1]])


def folded(values: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a run of values does to (1, level, trend), and the sum of its squared one-step errors as a quadratic form of it, per pair."""
    maps = np.broadcast_to(np.eye(3), (len(pairs), 3, 3)).copy()
    cost = np.zeros((len(pairs), 3, 3))
    alpha, link = pairs[:, 0, None], (pairs[:, 0] * pairs[:, 1])[:, None]
    for x in values.tolist():
        ahead = maps[:, 1] + maps[:, 2]
        error = -ahead
        error[:, 0] += x
        maps[:, 1] = ahead + alpha * error
        maps[:, 2] += link * error
        cost += error[:, :, None] * error[:, None, :]
    return maps, cost


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs one after the other, as one."""
    maps, cost = parts[0]
    for after, more in parts[1:]:
        cost = cost + np.swapaxes(maps, 1, 2) @ more @ maps
        maps = after @ maps
    return maps, cost


def _packed(maps: np.ndarray, cost: np.ndarray) -> list[float]:
    return np.concatenate([maps.ravel(), cost.ravel()]).tolist()


def _unpacked(numbers: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    both = numbers.values.to_numpy().reshape(2, -1, 3, 3)
    return both[0], both[1]


def _best(rows: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """*keys, n, alpha, beta, sse, level, trend of the pair with the least error, of each series.

    Runs of BLOCK values fold to one matrix per pair; FAN of those at a time are joined
    until a series has one. ``rows`` has its series' centre (c_alpha, c_beta) or nulls.
    """
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_block", T.LongType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("run", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)

    def table(group: pa.Table, block: int, centre, run) -> pa.Table:
        return pa.table([*[group[k][:1] for k in keys], [block], pa.array([centre], pa.list_(pa.float64())), pa.array([run], pa.list_(pa.float64()))], names=out.names).cast(arrow)

    def first(group: pa.Table) -> pa.Table:
        centre = group["centre"][0].as_py()
        order = np.argsort(group["pos"].to_numpy())
        return table(group, group["_block"][0].as_py(), centre, _packed(*folded(group["x"].to_numpy()[order], grid(centre))))

    def next_(group: pa.Table) -> pa.Table:
        order = np.argsort(group["_block"].to_numpy())
        run = joined([_unpacked(group["run"][int(i)]) for i in order])
        return table(group, group["_block"][0].as_py() // FAN, group["centre"][0].as_py(), _packed(*run))

    runs = materialize(rows.withColumn("_block", F.floor(F.col("pos") / BLOCK)).groupBy(*keys, "_block").applyInArrow(first, out))
    while (runs.agg(F.max("_block")).first()[0] or 0) > 0:
        runs = materialize(runs.groupBy(*keys, F.floor(F.col("_block") / FAN).alias("_group")).applyInArrow(next_, out))

    fields = ("alpha", "beta", "sse", "level", "trend")
    chosen = T.StructType([*[rows.schema[k] for k in keys], T.StructField("n", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in fields]])

    def choose(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                maps, cost = _unpacked(batch.column("run")[i])
                pairs = grid(batch.column("centre")[i].as_py())
                start = np.array([1.0, batch.column("x0")[i].as_py(), batch.column("x1")[i].as_py() - batch.column("x0")[i].as_py()])
                sse = start @ cost @ start
                at = int(np.argmin(sse))
                found.append((*pairs[at], sse[at], *(maps[at] @ start)[1:]))
            numbers = [pa.array([r[j] for r in found], pa.float64()) for j in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("n"), *numbers], names=chosen.names)

    return join_keys(runs, starts, keys).mapInArrow(choose, chosen)


def fitted_holt(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] = (), steps: int = 12) -> DataFrame:
    """*by, alpha, beta, sse, step, forecast for min(steps, n / 5) periods of every series of five values or more.

    Level and trend start at the first value and the first difference. The smoothing
    parameters are those with the least sum of squared one-step errors on a coarse grid,
    then on a fine one around it; both grids are tried in one pass each. The state is
    linear in the values and the error a quadratic form of the state, so blocks of a
    series fold apart from each other and are then joined: no series is walked in one task.
    """
    keys = list(by) or ["_all"]
    rows = positioned(df, col, order_by, by).where("key_rows >= 5").withColumn("x", quoted(col).cast("double"))
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    rows = materialize(rows.select(*keys, "pos", "x", F.col("key_rows").alias("n")))
    first = [F.max(F.when(F.col("pos") == i, F.col("x"))).alias(f"x{i}") for i in (0, 1)]
    starts = materialize(rows.groupBy(*keys).agg(F.max("n").cast("bigint").alias("n"), *first))
    values = rows.where("pos > 0").drop("n")
    coarse = materialize(_best(values.withColumn("centre", F.lit(None).cast("array<double>")), starts, keys))
    centred = join_keys(values, coarse.select(*keys, F.array("alpha", "beta").alias("centre")), keys)
    fine = materialize(_best(centred, starts, keys))
    ahead = F.least(F.lit(steps), F.floor(F.col("n") / 5)).cast("int")
    out = fine.withColumn("step", F.explode(F.sequence(F.lit(1), ahead)))
    return out.select(*by, "alpha", "beta", "sse", "step", (F.col("level") + F.col("step") * F.col("trend")).alias("forecast"))
