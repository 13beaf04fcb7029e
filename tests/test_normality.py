"""The Anderson-Darling test against its plain formula and its published limits."""

import math

import numpy as np
import pytest

from quarrylens.functions.tails import log_normal_cdf
from quarrylens.operators.statistics import order_normality


def plain(x):
    x = np.sort(x)
    n, z = len(x), (x - x.mean()) / x.std(ddof=1)
    i = np.arange(1, n + 1)
    below, above = (np.log([0.5 * math.erfc(s * v / math.sqrt(2)) for v in z]) for s in (-1, 1))
    return -n - ((2 * i - 1) * (below + above[::-1])).sum() / n


def test_statistic_and_verdict(spark):
    rng = np.random.default_rng(4)
    n = 3000
    data = {
        "normal": rng.normal(3, 2, n), "ties": np.round(rng.normal(0, 2, n)), "skewed": rng.exponential(size=n),
        "uniform": rng.random(n), "flat": np.ones(n),
    }
    rows = [tuple(float(x[i]) for x in data.values()) for i in range(n)] + [(None,) * len(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    got = {r["column"]: r for r in order_normality(df, list(data)).collect()}
    for c, x in data.items():
        if c == "flat":
            assert got[c]["a2"] is None and got[c]["p"] is None
            continue
        assert got[c]["n"] == n and got[c]["a2"] == pytest.approx(plain(x), rel=1e-7, abs=1e-7)
    assert got["normal"]["p"] > 0.05 > 1e-6 > max(got["skewed"]["p"], got["uniform"]["p"])


def test_few_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(7)], "x double")
    assert order_normality(df, ["x"]).first()["a2"] is None
    assert order_normality(df.where("x < 0"), ["x"]).count() == 0


def test_log_of_small_tails():
    z = np.array([-40.0, -30.0, -29.999, -8.0, 0.0, 5.0])
    got = log_normal_cdf(z)
    assert got[1] == pytest.approx(got[2], abs=0.05) and got[4] == pytest.approx(math.log(0.5))
    assert got[0] == pytest.approx(-804.608442, abs=1e-5) and got[3] == pytest.approx(-35.013437, abs=1e-5)
