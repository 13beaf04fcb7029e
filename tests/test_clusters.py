"""Clusters of all sizes in the same scans, against planted groups and a local fit."""

import numpy as np
import pytest

from quarrylens.operators import clusters, learning
from quarrylens.operators.clusters import assigned, fit_centres


def planted(spark, n=900):
    rng = np.random.default_rng(2)
    middles = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    points = middles[np.arange(n) % 4] + rng.normal(size=(n, 2)) * 0.3
    return points, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double").repartition(5)


def test_every_size_ends_where_no_row_changes(spark):
    points, df = planted(spark)
    for k, (centres, cost) in fit_centres(df.select("x", "y"), [1, 2, 4, 7]).items():
        nearest, own = assigned(points, centres)
        assert cost == pytest.approx(own.sum())
        if k in (1, 2, 4):
            for c in range(k):
                assert points[nearest == c].mean(axis=0) == pytest.approx(centres[c], abs=1e-3)
        if k == 4:
            assert all(len(set((np.arange(len(points)) % 4)[nearest == c])) == 1 for c in range(4))


def test_scans_are_the_steps_of_the_slowest_size(spark, monkeypatch):
    _, df = planted(spark, 200)
    seen = []
    whole = clusters.step
    monkeypatch.setattr(clusters, "step", lambda points, centres: seen.append(sorted(centres)) or whole(points, centres))
    fit_centres(df.select("x", "y"), range(2, 8))
    assert len(seen) <= clusters.STEPS + 1 and seen[0] == seen[-1] == [2, 3, 4, 5, 6, 7]
    assert all(set(b) <= set(a) for a, b in zip(seen[:-1], seen[1:-1]))


def test_elbow_and_labels(spark):
    points, df = planted(spark)
    elbow = {r["k"]: r["inertia"] for r in learning.kmeans_elbow(df, ["x", "y"], 6).collect()}
    assert sorted(elbow) == [2, 3, 4, 5, 6] and elbow[4] < 0.05 * elbow[3]
    labelled = learning.kmeans(df, ["x", "y"], 4, key=["i"]).collect()
    groups = {}
    for r in labelled:
        groups.setdefault(r["i"] % 4, set()).add(r["prediction"])
    assert sorted(x for g in groups.values() for x in g) == [0, 1, 2, 3]


def test_few_missing_and_equal_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert learning.kmeans_elbow(df, ["x", "y"]).count() == 0
    assert {r["prediction"] for r in learning.kmeans(df, ["x", "y"], 2).collect()} == {0}
    with pytest.raises(ValueError):
        learning.kmeans(df, ["x", "y"], 3)


def test_points_move_in_blocks(spark, monkeypatch):
    """A scan gets blocks of many points; ties, and blocks and chunks that do not come out even, change nothing."""
    _, df = planted(spark, 700)
    monkeypatch.setattr(clusters, "BLOCK_BYTES", 16 * 9)
    blocks = clusters.packed(df.select("x", "y"))
    assert blocks.count() <= 700 // 9 + 5
    points = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [5.0, 5.0]])
    centres = {1: np.array([[0.0, 0.0]]), 3: np.array([[1.0, 0.0], [-1.0, 0.0], [5.0, 5.0]])}
    got = clusters.nearest_sums(points, np.vstack(list(centres.values())), list(centres))
    assert got.tolist() == [[52, 4, 5, 5], [1, 2, 1, 0], [0, 1, -1, 0], [0, 1, 5, 5]]
    every = {k: np.array([[0.0, 0.0], [9.0, 9.0], [9.0, 0.0]])[:k] for k in (2, 3)}
    rows = np.array(df.select("x", "y").collect())
    for k, (counts, sums, cost) in clusters.step(blocks, every).items():
        nearest, own = assigned(rows, every[k])
        assert counts.tolist() == np.bincount(nearest, minlength=k).tolist() and cost == pytest.approx(own.sum())
        assert sums == pytest.approx(np.array([rows[nearest == c].sum(axis=0) for c in range(k)]))
