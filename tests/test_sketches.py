"""Reference search with sketches against sets, and the sketches themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import merging, sketches
from quarrylens.operators.sketches import Sketch, column_sketches


def plain(tables, threshold):
    found = set()
    for parent, prows in tables.items():
        for j in range(len(prows[0])):
            values = [r[j] for r in prows]
            if None in values or len(set(values)) < len(values):
                continue
            for child, crows in tables.items():
                for i in range(len(crows[0])):
                    mine = {r[i] for r in crows} - {None}
                    same = mine and isinstance(next(iter(mine)), str) == isinstance(values[0], str)
                    if child != parent and same and len(mine & set(values)) >= threshold * len(mine):
                        found.add((child, f"c{i}", parent, f"c{j}"))
    return found


@pytest.mark.parametrize("k", [8, 4096])
@pytest.mark.parametrize("threshold", [0.95, 0.5, 1.0])
def test_no_reference_is_lost(spark, monkeypatch, k, threshold):
    monkeypatch.setattr(sketches, "SKETCH", k)
    monkeypatch.setattr(merging, "column_sketches", lambda df, values: column_sketches(df, values, k))
    rng = random.Random(8)
    tables = {
        "a": [(i, f"n{i}") for i in range(300)],
        "b": [(rng.randrange(300), f"n{rng.randrange(320)}") for _ in range(500)],
        "c": [(rng.randrange(290, 320) if rng.random() < 0.04 else rng.randrange(300), rng.choice([None, "n1", "n2"])) for _ in range(400)],
        "d": [(i + 150, str(i)) for i in range(300)],
        "e": [(None, "x")] * 3,
    }
    dfs = {n: spark.createDataFrame(rows, "c0 int, c1 string").repartition(3) for n, rows in tables.items()}
    got = {tuple(r)[:4] for r in merging.relationships(dfs, threshold).collect()}
    assert got == plain(tables, threshold)


def test_pairs_that_cannot_reach_are_not_compared(spark, monkeypatch):
    compared = []
    monkeypatch.setattr(merging, "column_values", lambda df, *rest: compared.extend(df.columns) or whole(df, *rest))
    a = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") + 10**6).alias("far"))
    b = spark.range(9000).select((F.col("id") % 5000).alias("ref"), (F.col("id") * 7 + 1).alias("other"))
    got = merging.relationships({"a": a, "b": b}).collect()
    assert [tuple(r)[:4] for r in got] == [("b", "ref", "a", "key")]
    assert sorted(compared) == ["key", "ref"]


whole = merging.column_values


def test_sketch_of_a_column(spark):
    df = spark.range(20_000).select((F.col("id") % 9000).alias("x"), F.when(F.col("id") < 5, F.col("id")).alias("y")).repartition(7)
    found = column_sketches(df, {"x": F.col("x"), "y": F.col("y")}, 500)
    hashes = sorted(r[0] for r in spark.range(9000).select(F.xxhash64("id")).collect())
    assert found["x"].hashes.tolist() == hashes[:500] and not found["x"].whole and abs(found["x"].distinct() / 9000 - 1) < 0.2
    assert (found["y"].rows, found["y"].present, len(found["y"].hashes), found["y"].whole) == (20_000, 5, 5, True)
    assert not found["y"].can_be_unique()
    assert column_sketches(df.where("x < 0"), {"x": F.col("x")})["x"].rows == 0


def test_certain_bounds():
    of = lambda values, whole=True: Sketch(100, 100, np.array(sorted(values), np.int64), whole)
    assert of(range(100)).can_lie_in(of(range(95)), 0.95) and not of(range(100)).can_lie_in(of(range(94)), 0.95)
    # only the first 50 hashes of the other column are known: 6 of those seen are missing
    assert not of(range(100)).can_lie_in(of([*range(6, 50)], False), 0.95) and of(range(100)).can_lie_in(of([*range(5, 50)], False), 0.95)
