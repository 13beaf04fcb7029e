"""Ordered series: trend, autocorrelation, forecast, spectrum.

Every function takes an explicit order; add a unique tie-breaker to it.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.tails import chi2_sf, normal_sf, t_two_sided, tail_udf
from quarrylens.operators.ordering import join_keys, key_position, preceding, with_index
from quarrylens.operators.spectrum import POINTS, spectra
from quarrylens.operators.statistics import fit
from quarrylens.session import quoted


def positioned(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Non-missing values with table index, 0-based position in their series, and series length."""
    names = dict.fromkeys([*by, *order_by, col])
    slim = df.where(quoted(col).isNotNull()).select(*[quoted(c) for c in names])
    return key_position(with_index(slim, order_by, by), by)


def trend(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Linear trend on the row position: n, slope, intercept, r2, stderr, t, p."""
    line = fit(positioned(df, col, order_by, by), "pos", col, by)
    dof = F.when(F.col("n") > 2, (F.col("n") - 2).cast("double"))
    return line.withColumn("p", tail_udf(t_two_sided)(F.col("t"), dof))


def detrended(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``trend`` and ``detrended``."""
    rows = positioned(df, col, order_by, by)
    line = fit(rows, "pos", col, by)
    if by:
        fitted = join_keys(rows, line.select(*by, "slope", "intercept"), by)
    else:
        fitted = rows.withColumn("_f", line.select(F.struct("slope", "intercept").alias("f")).scalar())
        fitted = fitted.withColumns({"slope": F.col("_f.slope"), "intercept": F.col("_f.intercept")})
    level = F.col("intercept") + F.col("slope") * F.col("pos")
    return fitted.withColumns({"trend": level, "detrended": quoted(col) - level}).select(
        *dict.fromkeys([*by, *order_by, col]), "trend", "detrended"
    )


def acf(
    df: DataFrame, col: str, order_by: Sequence[str], max_lag: int = 40, by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows earlier, from lag 0 (1) up to min(max_lag, n / 4).

    Each row is read once with its ``max_lag`` predecessors, not joined to them.
    """
    rows = positioned(df, col, order_by, by)
    lagged = preceding(
        rows, max_lag,
        lambda w: {f"_x{k}": F.lag(quoted(col), k).over(w) for k in range(1, max_lag + 1)},
        by,
    )
    cells = [
        F.struct(F.lit(k).alias("lag"), quoted(col).alias("x"), F.col(f"_x{k}").alias("y"))
        for k in range(1, max_lag + 1)
    ]
    wanted = F.filter(
        F.array(*cells), lambda s: s["y"].isNotNull() & (s["lag"] <= F.floor(F.col("key_rows") / 4))
    )
    long = lagged.select(*by, F.col("key_rows").alias("n"), F.inline(wanted))
    later = long.groupBy(*by, "n", "lag").agg(F.corr("x", "y").alias("acf"))
    itself = rows.select(*by, F.col("key_rows").alias("n")).distinct().select(*by, "n", F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))
    return itself.unionByName(later).withColumn("band", 1.96 / F.sqrt("n"))


def ljung_box(acf_rows: DataFrame, lags: int = 19, df: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Ljung-Box Q over the first ``lags`` against chi-square with ``df`` degrees of freedom."""
    n = F.col("n")
    q = F.sum(n * (n + 2) * F.pow("acf", 2) / (n - F.col("lag")))
    return (
        acf_rows.where(F.col("lag").between(1, lags))
        .groupBy(*by)
        .agg(q.alias("q"))
        .withColumn("p", tail_udf(chi2_sf)(F.col("q"), F.lit(float(df))))
    )


# --- Holt forecast -----------------------------------------------------------------------


def _mode_weights(first: float, second: float, a: complex, b: complex, j: Column) -> Column:
    """Term j of the sequence with the given first two terms and characteristic roots a, b."""
    if abs(a - b) < 1e-12:
        root = a.real
        slope = second / root - first if root else 0.0
        return (F.lit(first) + F.lit(slope) * j) * F.pow(F.lit(root), j)
    if abs(a.imag) > 1e-15:  # conjugate pair: a damped wave
        size, angle = abs(a), cmath.phase(a)
        wave = (second / size - first * math.cos(angle)) / math.sin(angle)
        return F.pow(F.lit(size), j) * (F.lit(first) * F.cos(j * angle) + F.lit(wave) * F.sin(j * angle))
    p = (second - first * b.real) / (a.real - b.real)
    return F.lit(p) * F.pow(F.lit(a.real), j) + F.lit(first - p) * F.pow(F.lit(b.real), j)


def holt(
    df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] = (),
    alpha: float = 0.5, beta: float = 0.3, steps: int = 12,
) -> DataFrame:
    """Additive-trend exponential smoothing forecast for min(steps, n / 5) periods.

    The final level and trend are linear in the data: each value enters with a weight
    that depends only on its distance from the end. So a series of any length is one
    weighted sum with a partial aggregate, not a loop over its rows.
    """
    keep, link = 1 - alpha, alpha * beta
    step = ((keep, keep), (-link, 1 - link))  # (level, trend) -> next, before the new value
    half = (2 - alpha - link) / 2
    spread = cmath.sqrt(half * half - keep)
    roots = (half + spread, half - spread)

    def powers(vector, j):
        """Both components of step^j applied to ``vector``."""
        after = [row[0] * vector[0] + row[1] * vector[1] for row in step]
        return [_mode_weights(vector[i], after[i], *roots, j) for i in range(2)]

    rows = positioned(df, col, order_by, by)
    x, last = quoted(col).cast("double"), F.col("key_rows") - 1
    news = powers((alpha, link), last - F.col("pos"))
    level0, trend0 = powers((1.0, 0.0), last), powers((0.0, 1.0), last)
    parts = []
    for i in range(2):
        weight = (
            F.when(F.col("pos") == 0, level0[i] - trend0[i])
            .when(F.col("pos") == 1, trend0[i] + news[i])
            .otherwise(news[i])
        )
        parts.append(F.sum(weight * x))
    state = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), parts[0].alias("level"), parts[1].alias("trend")
    )
    ahead = F.least(F.lit(steps), F.floor(F.col("n") / 5)).cast("int")
    return (
        state.where((F.col("n") >= 5))
        .select(*by, "level", "trend", F.explode(F.sequence(F.lit(1), ahead)).alias("step"))
        .select(*by, "step", (F.col("level") + F.col("step") * F.col("trend")).alias("forecast"))
    )


def trend_forecast(
    df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] = (), steps: int = 12
) -> DataFrame:
    """Straight continuation of the fitted trend."""
    line = fit(positioned(df, col, order_by, by), "pos", col, by).where(F.col("n") >= 5)
    ahead = F.least(F.lit(steps), F.floor(F.col("n") / 5)).cast("int")
    return line.select(
        *by, "n", "slope", "intercept", F.explode(F.sequence(F.lit(1), ahead)).alias("step")
    ).select(
        *by, "step",
        (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"),
    )


# --- spectrum ----------------------------------------------------------------------------


def periodogram(
    df: DataFrame, col: str, order_by: Sequence[str], n_bins: int | None = None, by: Sequence[str] = (), fs: float = 1.0,
    points: int = POINTS,
) -> DataFrame:
    """Power of the frequency bins 0 .. n/2 - 1 of each series of more than ten values, or of the first ``n_bins``.

    All bins of a series come from one transform (:func:`spectra`): two shuffles of its
    values, in groups of at most ``points``, whatever its length.
    """
    rows = positioned(df, col, order_by, by).where("key_rows > 10")
    found = spectra(rows.select(*by, F.col("key_rows").alias("n"), "pos", quoted(col).cast("double").alias("x")), by, points)
    found = found.where(F.col("pos") < F.floor(F.col("n") / 2))
    if n_bins is not None:
        found = found.where(F.col("pos") < n_bins)
    return found.select(
        *by, F.col("pos").cast("int").alias("bin"), (F.col("pos") * fs / F.col("n")).alias("frequency"),
        (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"),
    )


def dominant_frequency(spectrum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frequency of the largest power, the constant bin left out."""
    return (
        spectrum.where(F.col("bin") > 0)
        .groupBy(*by)
        .agg(F.max_by("frequency", "power").alias("frequency"), F.max("power").alias("power"))
    )


# --- process control ---------------------------------------------------------------------


def capability(
    df: DataFrame, col: str, by: Sequence[str] = (), lsl: float | None = None, usl: float | None = None
) -> DataFrame:
    """Process capability against limits (default: mean -+ 3 population deviations)."""
    x = quoted(col).cast("double")
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    low = F.lit(lsl).cast("double") if lsl is not None else F.col("mean") - 3 * F.col("std")
    high = F.lit(usl).cast("double") if usl is not None else F.col("mean") + 3 * F.col("std")
    per = lambda a, k: F.when(F.col("std") > 0, a / (k * F.col("std"))).otherwise(0.0)
    out = base.withColumns({"lsl": low, "usl": high}).withColumns(
        {
            "cp": per(F.col("usl") - F.col("lsl"), 6),
            "cpu": per(F.col("usl") - F.col("mean"), 3),
            "cpl": per(F.col("mean") - F.col("lsl"), 3),
        }
    )
    cpk = F.least("cpu", "cpl")
    out = out.withColumns({"cpk": cpk, "sigma_level": cpk * 3})
    tail = tail_udf(normal_sf)(F.when(F.col("cpk") > 0, F.col("sigma_level")))
    return out.withColumns(
        {
            "dpmo": F.coalesce(tail * 2e6, F.lit(500000.0)),
            "verdict": F.when(F.col("cpk") >= 1.33, "Capable").when(F.col("cpk") >= 1.0, "Marginal").otherwise("Not capable"),
        }
    )


def xbar_chart(
    df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] = (), drop_last: bool = False
) -> DataFrame:
    """Subgroup means in row order with control limits and an out-of-control flag.

    Subgroups hold min(10, max(2, n / 20)) rows; an incomplete last one is left out.
    ``drop_last`` also leaves out a last subgroup that ends exactly at the last row.
    """
    rows = positioned(df, col, order_by, by)
    size = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("key_rows") / 20)))
    x = quoted(col).cast("double")
    sized = rows.withColumn("size", size.cast("int"))
    full = (F.floor(F.col("pos") / F.col("size")) + 1) * F.col("size")
    inside = full < F.col("key_rows") if drop_last else full <= F.col("key_rows")
    groups = (
        sized.where(inside)
        .groupBy(*by, F.floor(F.col("pos") / F.col("size")).alias("subgroup"), "size")
        .agg(F.avg(x).alias("mean"))
    )
    spread = df.groupBy(*by).agg(F.stddev_pop(x).alias("std"))
    center = groups.groupBy(*by).agg(F.avg("mean").alias("center"))
    if by:
        joined = join_keys(groups, join_keys(center, spread, by), by)
    else:
        joined = groups.withColumn("_c", center.scalar()).withColumn("_s", spread.scalar())
        joined = joined.withColumns({"center": F.col("_c"), "std": F.col("_s")}).drop("_c", "_s")
    reach = 3 * F.col("std") / F.sqrt("size")
    return joined.select(
        *by, "subgroup", "mean", "center", (F.col("center") + reach).alias("ucl"),
        (F.col("center") - reach).alias("lcl"),
        (F.abs(F.col("mean") - F.col("center")) > reach).alias("out_of_control"),
    )
