"""All frequency bins against a local transform, whole, in two stages and through the chirp."""

import numpy as np
import pytest

from quarrylens.operators import series
from quarrylens.operators.spectrum import factor_of

LENGTHS = {"a": 720, "b": 11, "c": 12, "d": 101, "e": 1009, "f": 64, "short": 10, None: 360, "h": 2 * 499}


@pytest.mark.parametrize("points", [8, 40, 1 << 19])
def test_every_bin_of_any_length(spark, points):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(size=n) for k, n in LENGTHS.items()}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("a", 5000, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(5)
    got = {}
    for r in series.periodogram(df, "x", ["i"], by=["k"], points=points).collect():
        got.setdefault(r["k"], {})[r["bin"]] = (r["frequency"], r["power"])
    assert set(got) == set(LENGTHS) - {"short"}
    for k, bins in got.items():
        n = LENGTHS[k]
        assert sorted(bins) == list(range(n // 2))
        want = np.abs(np.fft.fft(data[k])) ** 2
        assert np.allclose([bins[i][1] for i in range(n // 2)], want[: n // 2], rtol=1e-9, atol=1e-9 * want.max())
        assert np.allclose([bins[i][0] for i in range(n // 2)], np.arange(n // 2) / n)


def test_first_bins_only_and_no_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "i int, x double")
    assert [r["bin"] for r in series.periodogram(df, "x", ["i"], 3).orderBy("bin").collect()] == [0, 1, 2]
    assert series.periodogram(df.where("i < 0"), "x", ["i"]).count() == 0


def test_factors():
    for n in range(1, 400):
        for points in (4, 16, 500):
            f = factor_of(n, points)
            fits = [d for d in range(2, n) if n % d == 0 and d <= points and n // d <= points and d * d <= n]
            assert f == (1 if n <= points else max(fits, default=0))
