"""Lloyd's steps for several numbers of clusters at once: one scan per step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.session import materialize

#: Rows of the sample that the steps start from (those of the smallest hashes); the steps themselves read all rows.
SAMPLE = 4096
STARTS, STEPS, TOLERANCE = 5, 20, 1e-4
#: Points whose distances are taken at once, so that they stay in a core's cache.
CHUNK = 2048
#: Bytes of a stored block of points; a batch of ten thousand of them fits a task.
BLOCK_BYTES = 4096


def spread_centres(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k points, each drawn with a chance that grows with its squared distance to those before."""
    chosen = [points[random.integers(len(points))]]
    distance = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = distance.sum()
        chosen.append(points[random.choice(len(points), p=distance / total) if total > 0 else random.integers(len(points))])
        distance = np.minimum(distance, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def assigned(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every point, and the squared distance to it."""
    distance = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
    nearest = distance.argmin(axis=1)
    return nearest, ((points - centres[nearest]) ** 2).sum(axis=1)


def local_start(points: np.ndarray, sizes: Sequence[int], seed: int) -> dict[int, np.ndarray]:
    """The best of a few fits on the sample, for every size; a larger one starts with the centres of a smaller one."""
    random, best = np.random.default_rng(seed), {}
    for _ in range(STARTS):
        sequence = spread_centres(points, max(sizes), random)
        for k in sizes:
            centres = sequence[:k].copy()
            for _ in range(STEPS):
                nearest, cost = assigned(points, centres)
                counts = np.bincount(nearest, minlength=k)
                sums = np.column_stack([np.bincount(nearest, points[:, j], k) for j in range(points.shape[1])])
                centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
            cost = assigned(points, centres)[1].sum()
            if k not in best or cost < best[k][0]:
                best[k] = (cost, centres)
    return {k: centres for k, (_, centres) in best.items()}


def packed(points: DataFrame) -> DataFrame:
    """Points stored as blocks of their bytes, so that a scan moves blocks and not values one by one."""
    wide = len(points.columns)
    size = max(1, BLOCK_BYTES // (8 * wide))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns]).astype(np.float64)
            blocks = [rows[at : at + size].tobytes() for at in range(0, len(rows), size)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    return materialize(points.mapInArrow(pack, "block binary"))


def chunks(batch: pa.RecordBatch, wide: int) -> Iterator[np.ndarray]:
    """The points of a batch of blocks, some at a time."""
    rows = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, wide)
    for at in range(0, len(rows), CHUNK):
        yield rows[at : at + CHUNK]


def nearest_sums(points: np.ndarray, places: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """For the centres of several fits (of ``sizes``, one below the other): rows, sums and squared distances of the points nearest to each.

    All distances are one product of matrices and all sums another. The squared distances
    of a fit stand at its first centre.
    """
    scores = (places**2).sum(axis=1)[:, None] / 2 - places @ points.T  # half the squared distance, less what a point has in all
    chosen, cost, at = np.empty(scores.shape), np.zeros(len(places)), 0
    for k in sizes:
        part, here = scores[at : at + k], chosen[at : at + k]
        hits = part == part.min(axis=0)
        if np.count_nonzero(hits) != len(points):  # ties go to the first centre
            hits &= np.cumsum(hits, axis=0) == 1
        here[:] = hits
        apart = points - here.T @ places[at : at + k]
        cost[at] = np.vdot(apart, apart)
        at += k
    return np.column_stack([cost, chosen @ np.column_stack([np.ones(len(points)), points])])


def step(blocks: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of every size: rows per centre, sums per centre and the cost, from one scan of blocks. One row per centre and task is shuffled."""
    sizes, places = list(centres), np.vstack(list(centres.values()))
    names = ["cost", "n", *[f"s{j}" for j in range(places.shape[1])]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(places), len(names)))
        for batch in batches:
            for rows in chunks(batch, places.shape[1]):
                total += nearest_sums(rows, places, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(places)), pa.int32()), *map(pa.array, total.T)], ["c", *names])

    summed = blocks.mapInArrow(partial, "c int, " + ", ".join(f"{s} double" for s in names)).groupBy("c").agg(*[F.sum(s).alias(s) for s in names])
    total = np.zeros((len(places), len(names)))
    for r in summed.collect():  # one row per centre
        total[r["c"]] = [r[s] for s in names]
    parts = np.split(total, np.cumsum(sizes)[:-1])
    return {k: (part[:, 1], part[:, 2:], float(part[:, 0].sum())) for k, part in zip(sizes, parts)}


def fit_centres(points: DataFrame, sizes: Sequence[int], seed: int = 42) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost for every number of clusters in ``sizes``, on all rows of a table of doubles.

    All sizes that still move take their step in one scan, so there are as many scans as
    the slowest size has steps, and one for the costs. Sizes over the number of rows are
    left out; empty clusters keep their centre.
    """
    columns = points.columns
    order = F.xxhash64(*columns)
    sample = np.array([tuple(r) for r in points.orderBy(order, *columns).limit(SAMPLE).collect()], float).reshape(-1, len(columns))
    sizes = sorted({k for k in sizes if 0 < k <= len(sample)})
    if not sizes:
        return {}
    centres = local_start(sample, sizes, seed)
    moving, blocks = set(sizes), packed(points)
    for _ in range(STEPS):
        for k, (counts, sums, _) in step(blocks, {k: centres[k] for k in sorted(moving)}).items():
            new = centres[k].copy()
            new[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
            if np.sqrt(((new - centres[k]) ** 2).sum(axis=1)).max() <= TOLERANCE:
                moving.discard(k)
            centres[k] = new
        if not moving:
            break
    return {k: (centres[k], cost) for k, (_, _, cost) in step(blocks, centres).items()}


def nearest(columns: Sequence[Column], centres: np.ndarray) -> Column:
    """Number of the nearest centre; the first one on ties."""
    distances = F.array(*[sum(((c - F.lit(float(x))) * (c - F.lit(float(x))) for c, x in zip(columns, centre)), F.lit(0.0)) for centre in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
