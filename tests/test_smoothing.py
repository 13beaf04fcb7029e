"""Fitted smoothing against a walk along every series."""

import numpy as np
import pytest

from quarrylens.operators import smoothing
from quarrylens.operators.smoothing import fitted_holt, grid


def walk(x, pairs):
    out = []
    for a, b in pairs:
        level, trend, sse = x[0], x[1] - x[0], 0.0
        for value in x[1:]:
            error = value - level - trend
            sse += error * error
            level, trend = level + trend + a * error, trend + a * b * error
        out.append((sse, level, trend))
    return out


@pytest.mark.parametrize("block,fan", [(4096, 64), (7, 3)])
def test_best_pair_and_forecast(spark, monkeypatch, block, fan):
    monkeypatch.setattr(smoothing, "BLOCK", block)
    monkeypatch.setattr(smoothing, "FAN", fan)
    rng = np.random.default_rng(5)
    data = {"walk": np.cumsum(rng.normal(size=200)) + 50, "line": np.arange(40) * 2.0 + rng.normal(size=40) * 0.1, None: rng.normal(size=61), "short": np.arange(4.0), "flat": np.full(9, 3.0)}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("walk", 999, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(4)
    got = {}
    for r in fitted_holt(df, "x", ["i"], ["k"]).collect():
        got.setdefault(r["k"], {})[r["step"]] = r
    assert set(got) == set(data) - {"short"}
    for k, steps in got.items():
        x = data[k]
        assert sorted(steps) == list(range(1, min(12, len(x) // 5) + 1))
        coarse = grid(None)
        best = coarse[int(np.argmin([s for s, _, _ in walk(x, coarse)]))]
        fine = grid(tuple(best))
        found = walk(x, fine)
        sse, level, trend = found[int(np.argmin([s for s, _, _ in found]))]
        assert steps[1]["sse"] == pytest.approx(sse, abs=1e-8) and sse <= min(s for s, _, _ in walk(x, coarse)) + 1e-8
        if k != "flat":  # every pair is as good there
            for step, r in steps.items():
                assert r["forecast"] == pytest.approx(level + step * trend, rel=1e-7, abs=1e-7)
        else:
            assert all(r["forecast"] == pytest.approx(3.0) for r in steps.values())


def test_one_series_without_a_key(spark):
    df = spark.createDataFrame([(i, float(i % 5 + i)) for i in range(30)], "i int, x double")
    assert fitted_holt(df, "x", ["i"]).count() == 6
    assert fitted_holt(df.where("i < 0"), "x", ["i"]).count() == 0
