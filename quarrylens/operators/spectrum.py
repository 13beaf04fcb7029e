"""The discrete Fourier transform of series of any length, in two shuffles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylens.session import materialize

#: Points that one task transforms at a time; a shorter series is transformed whole.
POINTS = 1 << 19


def factor_of(n: int, points: int) -> int:
    """1 if a task holds n points; else the largest factor up to the root of n that leaves two parts it can hold, or 0."""
    if n <= points:
        return 1
    candidates = np.arange(max(2, -(-n // points)), min(math.isqrt(n), points) + 1)
    found = candidates[n % candidates == 0] if len(candidates) else candidates
    return int(found[-1]) if len(found) else 0


def factors(n: Column, points: int) -> Column:
    @F.arrow_udf("bigint")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lengths, places = np.unique(batch.to_numpy(zero_copy_only=False), return_inverse=True)
            yield pa.array(np.array([factor_of(int(x), points) for x in lengths], np.int64)[places])

    return found(n)


def transformed(rows: DataFrame, by: Sequence[str], sign: int, points: int, cut: bool = True) -> DataFrame:
    """*by, n, pos, re, im: the transform of each series of n = n1 * n2 points, from *by, n, n1, pos, re, im.

    Missing positions are zero. Position n2 * j1 + j2 goes to frequency k1 + n1 * k2. Points
    that share j2 are transformed over j1 and turned by their part of the circle, then points
    that share k1 are transformed over j2: two shuffles, of groups of at most ``points``
    points. With n1 = 1 there is nothing to do in the first; without ``cut`` that is known of
    all series. ``sign`` -1 goes forward; +1 back, without the division by n.
    """
    fields = [rows.schema[c] for c in (*by, "n", "n1")]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType() if c == "pos" else T.DoubleType()) for c in ("pos", "re", "im")]])
    groups = [*by, "n", "n1"]

    def stage(df: DataFrame, first: bool) -> DataFrame:
        def fft(table: pa.Table) -> pa.Table:
            n, n1 = table["n"][0].as_py(), table["n1"][0].as_py()
            n2 = n // n1
            pos = table["pos"].to_numpy()
            outer, inner = (pos % n2, pos // n2) if first else (pos // n2, pos % n2)
            kept = np.unique(outer)
            grid = np.zeros((len(kept), n1 if first else n2), complex)
            grid[np.searchsorted(kept, outer), inner] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
            width = grid.shape[1]
            grid = np.fft.fft(grid, axis=1) if sign < 0 else np.fft.ifft(grid, axis=1) * width
            along = np.arange(width)
            if first:  # k1 along; stays with its j2
                grid *= np.exp(sign * 2j * np.pi * (kept[:, None] * along % n) / n)
                out = along * n2 + kept[:, None]
            else:  # k2 along
                out = kept[:, None] + n1 * along
            keys = [pa.repeat(table[c][0], grid.size) for c in groups]
            return pa.table([*keys, pa.array(out.ravel()), pa.array(grid.real.ravel()), pa.array(grid.imag.ravel())], names=[*groups, "pos", "re", "im"])

        n2 = F.expr("n div n1")
        held, place = (F.col("n1"), F.col("pos") % n2) if first else (n2, F.floor(F.col("pos") / n2))
        group = F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(points) / held))).alias("_group")
        return df.groupBy(*groups, group).applyInArrow(lambda table: fft(table).cast(arrow), schema)

    rows = rows.select(*groups, F.col("pos").cast("bigint").alias("pos"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    arrow = to_arrow_schema(schema)
    if cut:
        rows = stage(rows.where("n1 > 1"), True).unionByName(rows.where("n1 = 1"))
    return stage(rows, False).drop("n1")


def chirp(place: Column, n: Column) -> tuple[Column, Column]:
    """Cosine and sine of pi * place ** 2 / n."""
    square = F.pmod(place.cast("decimal(19,0)") * place.cast("decimal(19,0)"), (2 * n).cast("decimal(19,0)")).cast("double")
    return F.cos(F.pi() * square / n), F.sin(F.pi() * square / n)


def spectra(rows: DataFrame, by: Sequence[str], points: int = POINTS) -> DataFrame:
    """*by, n, pos (the bin), re, im of every series, from *by, n, pos and x.

    A length without two factors that fit is turned into a convolution with a chirp, whose
    length is a power of two: two transforms forward and one back.
    """
    rows = materialize(
        rows.select(*by, F.col("n").cast("bigint").alias("n"), "pos", F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"), factors(F.col("n"), points).alias("n1"))
    )
    kinds = rows.agg(F.bool_or(F.col("n1") > 1), F.bool_or(F.col("n1") == 0)).first()
    direct = transformed(rows.where("n1 > 0"), by, -1, points, bool(kinds[0]))
    if not kinds[1]:
        return direct
    prime = rows.where("n1 = 0")
    bits = F.ceil(F.log2(2 * F.col("length") - 1)).cast("int")
    sized = [F.pow(F.lit(2.0), power).cast("bigint").alias(name) for name, power in (("n", bits), ("n1", F.floor(bits / 2)))]
    cos, sin = chirp(F.col("pos"), F.col("length"))
    x = F.col("re")
    signal = prime.withColumnRenamed("n", "length").select(*by, "length", *sized, "pos", (x * cos).alias("re"), (-x * sin).alias("im"))
    # one filter per length, made in runs of places
    run = 1 << 16
    runs = prime.select(F.col("n").alias("length")).distinct().select("length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(run))).alias("start"))
    places = runs.repartition("length", "start").select(
        "length", *sized, F.explode(F.sequence("start", F.least(F.col("start") + run, F.col("length")) - 1)).alias("pos")
    )
    wave = places.select("length", "n", "n1", "pos", cos.alias("re"), sin.alias("im"))
    wave = wave.unionByName(wave.where("pos > 0").withColumn("pos", F.col("n") - F.col("pos")))
    a = transformed(signal, [*by, "length"], -1, points)
    b = transformed(wave, ["length"], -1, points).select("length", "pos", F.col("re").alias("c"), F.col("im").alias("d"))
    product = a.join(b, ["length", "pos"]).select(
        *by, "length", *sized, "pos", (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"),
        (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"),
    )
    back = transformed(product, [*by, "length"], 1, points).where("pos < length")
    re, im = F.col("re") / F.col("n"), F.col("im") / F.col("n")
    turned = back.select(*by, F.col("length").alias("n"), "pos", (re * cos + im * sin).alias("re"), (im * cos - re * sin).alias("im"))
    return direct.unionByName(turned)
