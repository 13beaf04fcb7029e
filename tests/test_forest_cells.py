"""Forests of large tables on weighted cells of binned rows, beside the forests of the rows themselves."""

import random

import pytest
from pyspark.ml import PipelineModel

from quarrylens.operators import learning

ROWS = 4000


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(ROWS):
        a, b, c = rng.uniform(0, 100), rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, 5.0]), rng.uniform(-1, 1)
        rows.append((a, b, None if rng.random() < 0.02 else c, a * (1 + b) + rng.gauss(0, 1), "high" if a > 60 else "low"))
    return spark.createDataFrame(rows, "a double, b double, c double, y double, g string").repartition(3).persist()


def test_edges_part_few_values_and_what_follows_a_frequent_one(lines):
    edges = learning.bin_edges(lines, ["a", "b"])
    assert edges["b"] == [0.5, 1.5, 3.5] and len(edges["a"]) == learning.BINS - 1 == len(set(edges["a"]))


def test_weighted_rows_keep_the_sum_and_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(learning, "FOREST_ROWS", 50)
    cells = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 997, 3000])], "cell int, n long")
    got = learning.weighted(cells, ROWS).collect()
    assert abs(sum(r["weight"] for r in got) - ROWS) < 1e-6 and len(got) <= 4 + 50 and max(r["weight"] for r in got) <= ROWS / 50


def test_classes_from_cells(lines, monkeypatch):
    rows = {r["feature"]: r for r in learning.forest_classify(lines, "g", ["a", "b", "c"], trees=8).collect()}
    monkeypatch.setattr(learning, "FOREST_ROWS", 500)
    seen = []
    monkeypatch.setattr(learning, "weighted", lambda cells, n, real=learning.weighted: seen.append(real(cells, n)) or seen[-1])
    cells = {r["feature"]: r for r in learning.forest_classify(lines, "g", ["a", "b", "c"], trees=8).collect()}
    assert seen[0].agg({"weight": "sum"}).first()[0] == pytest.approx(ROWS)
    assert max(cells, key=lambda f: cells[f]["importance"]) == "a"
    for f in rows:
        assert cells[f]["importance"] == pytest.approx(rows[f]["importance"], abs=0.12)
        assert cells[f]["holdout_accuracy"] == pytest.approx(rows[f]["holdout_accuracy"], abs=0.04)
        assert cells[f]["cv_accuracy"] == pytest.approx(rows[f]["cv_accuracy"], abs=0.04)


def test_drivers_from_cells(lines, monkeypatch):
    cols = ["a", "b", "c"]
    model, report = learning.driver_model(lines, "y", cols, trees=10)
    rows, effects = {r["feature"]: r for r in report.collect()}, {r["driver"]: r for r in learning.what_if(lines, model, cols).collect()}
    monkeypatch.setattr(learning, "FOREST_ROWS", 500)
    model, report = learning.driver_model(lines, "y", cols, trees=10)
    assert isinstance(model, PipelineModel)
    for r in report.collect():
        assert r["importance"] == pytest.approx(rows[r["feature"]]["importance"], abs=0.12)
        assert r["r2"] == pytest.approx(rows[r["feature"]]["r2"], abs=0.15)
    for r in learning.what_if(lines, model, cols).collect():
        assert r["base_prediction"] == pytest.approx(effects[r["driver"]]["base_prediction"], rel=0.1)
        assert r["increase_effect"] == pytest.approx(effects[r["driver"]]["increase_effect"], abs=3)
    scored = {r["driver"]: r for r in learning.what_if(lines, model, cols).collect()}["a"]
    plain = model.transform(lines.dropna().withColumn("a", lines["a"] * 1.1)).agg({"prediction": "avg"}).first()[0]
    assert (plain / scored["base_prediction"] - 1) * 100 == pytest.approx(scored["increase_effect"], rel=1e-6)
