"""RANGE frames in blocks against one window over the whole key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylens.operators.frames import range_frames

OUT = {"n": ("count", "x"), "total": ("sum", "x"), "mean": ("avg", "x"), "least": ("min", "x"), "most": ("max", "x"), "name": ("max", "s")}


def rows_of(kind):
    rng = random.Random(6)
    if kind == "clusters":
        at = [rng.choice([0, 1000, 5000]) + rng.randrange(40) for _ in range(500)]
    elif kind == "ties":
        at = [rng.choice([3, 3, 3, 4, 900]) for _ in range(300)]
    else:
        at = [rng.randrange(3000) for _ in range(600)]
    out = [(i, "hot" if rng.random() < 0.8 else rng.choice(["a", None]), a, rng.choice([None, rng.randrange(100)]), f"s{rng.randrange(50):02}") for i, a in enumerate(at)]
    return out + [(10_000 + i, k, None, i, "z") for i, k in enumerate(["hot", "hot", None, "only"])] + [(20_000, "one", 5, None, None)]


@pytest.mark.parametrize("kind,before,after,points", [
    ("uniform", 30, 10, 4), ("uniform", 2000, 0, 4), ("clusters", 100, 3, 4), ("clusters", 0, 100_000, 16), ("ties", 1, 1, 4), ("uniform", 0, 0, 1 << 16),
])
def test_whole_numbers(spark, kind, before, after, points):
    df = spark.createDataFrame(rows_of(kind), "id int, key string, at int, x int, s string").repartition(6)
    df.createOrReplaceTempView("frame_rows")
    window = f"OVER (PARTITION BY key ORDER BY at RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    want = spark.sql(f"SELECT id, count(x) {window} AS n, sum(x) {window} AS total, avg(x) {window} AS mean, min(x) {window} AS least, max(x) {window} AS most, max(s) {window} AS name FROM frame_rows")
    got = range_frames(df, "at", OUT, before, after, ["key"], points)
    assert got.columns == [*df.columns, *OUT]
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_times_and_fractions_without_a_key(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rng.randrange(9000)), rng.random() * 50, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz, d double, x int")
    got = range_frames(df, "t", {"n": ("count", "x"), "total": ("sum", "x")}, timedelta(minutes=10), timedelta(seconds=5), block_points=16)
    for r in got.collect():
        near = [x for _, t, _, x in rows if r["t"] - timedelta(minutes=10) <= t <= r["t"] + timedelta(seconds=5)]
        assert (r["n"], r["total"]) == (len(near), sum(near))
    for r in range_frames(df, "d", {"n": ("count", "x"), "most": ("max", "x")}, 1.5, 0.25, block_points=16).collect():
        near = [x for _, _, d, x in rows if r["d"] - 1.5 <= d <= r["d"] + 0.25]
        assert (r["n"], r["most"]) == (len(near), max(near))


def test_no_rows_and_unknown_functions(spark):
    df = spark.createDataFrame([(1, 2)], "at int, x int")
    assert range_frames(df.where("at < 0"), "at", {"n": ("count", "x")}, 1).count() == 0
    with pytest.raises(ValueError):
        range_frames(df, "at", {"n": ("median", "x")}, 1)
