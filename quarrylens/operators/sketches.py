"""Bottom-k sketches of columns: the smallest hashes of their distinct values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 4096
SALTS = 64
#: A share seen in SEEN values or more is off by MARGIN with a probability of exp(-2 * SEEN * MARGIN ** 2), 1.5e-13.
SEEN, MARGIN = 1024, 0.12
#: A cut sketch of k hashes tells the number of distinct values to one in the root of k; this is twelve times that.
LEAST_UNIQUE = 0.8


@dataclass(frozen=True)
class Sketch:
    """Rows and values of a column, its smallest distinct hashes in order, and whether those are all."""

    rows: int
    present: int
    hashes: np.ndarray
    whole: bool

    def distinct(self) -> float:
        if self.whole:
            return len(self.hashes)
        return (len(self.hashes) - 1) / ((int(self.hashes[-1]) + 2**63) / 2**64)

    def can_be_unique(self) -> bool:
        if self.present < self.rows or not self.rows:
            return False
        return len(self.hashes) == self.rows if self.whole else self.distinct() >= LEAST_UNIQUE * self.rows

    def can_lie_in(self, other: Sketch, threshold: float) -> bool:
        """False only where fewer than ``threshold`` of the values can be in ``other``.

        Up to the last hash of a cut sketch it is known of every value whether the other
        column has it. What a whole sketch misses is counted; a cut one is a sample.
        """
        seen = self.hashes if other.whole else self.hashes[: np.searchsorted(self.hashes, other.hashes[-1], side="right")]
        missing = int((~np.isin(seen, other.hashes, assume_unique=True)).sum())
        if self.whole:
            return missing <= (1 - threshold) * len(self.hashes) + 1e-9
        return len(seen) < SEEN or missing / len(seen) <= 1 - threshold + MARGIN


def column_sketches(df: DataFrame, values: Mapping[str, Column], k: int = SKETCH) -> dict[str, Sketch]:
    """The sketch of every named expression (equal values give equal hashes in any table), from one pass.

    Every task keeps the k smallest hashes of each column; those are what is shuffled, and
    one sketch per column is what reaches the driver.
    """
    names = list(values)
    hashed = df.select(*[F.when(e.isNotNull(), F.xxhash64(e)).alias(f"c{i}") for i, e in enumerate(values.values())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, present, rows = [np.empty(0, np.int64) for _ in names], [0] * len(names), 0
        for batch in batches:
            rows += batch.num_rows
            for i, column in enumerate(batch.columns):
                new = column.drop_null().to_numpy()
                present[i] += len(new)
                if len(kept[i]) == k + 1:
                    new = new[new < kept[i][-1]]
                if len(new):
                    kept[i] = np.union1d(kept[i], new)[: k + 1]
        for i, hashes in enumerate(kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (len(hashes) + 1), pa.int32()), pa.array([None, *hashes.tolist()], pa.int64()),
                 pa.array([rows] + [0] * len(hashes), pa.int64()), pa.array([present[i]] + [0] * len(hashes), pa.int64())],
                ["i", "h", "rows", "present"],
            )

    parts = hashed.mapInArrow(sketch, "i int, h bigint, rows bigint, present bigint").groupBy("i", "h").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"))
    least = parts
    for keys in (["i", F.pmod(F.xxhash64("h"), F.lit(SALTS))], ["i"]):  # many tasks' hashes do not meet at once
        least = least.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= k + 2)
    found: dict[int, list] = {i: [] for i in range(len(names))}
    for r in least.orderBy("i", "h").collect():  # the null hash, which has the counts, comes first
        found[r["i"]].append(r)
    out = {}
    for i, rows in found.items():
        hashes = np.array([r["h"] for r in rows if r["h"] is not None], np.int64)
        counts = next(((r["rows"], r["present"]) for r in rows if r["h"] is None), (0, 0))
        out[names[i]] = Sketch(*counts, hashes[:k], len(hashes) <= k)
    return out
