"""Ordered and quantile operators against brute force, with blocks small enough to matter."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import cleaning, ordering, quantiles, relational, series
from quarrylens.operators.statistics import auc, kaplan_meier, mutual_information


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows, one value repeats, and some values are missing."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        value = None if rng.random() < 0.1 else (5.0 if rng.random() < 0.3 else rng.uniform(0, 100))
        rows.append((i, key, rng.randrange(400), value))
    return pd.DataFrame(rows, columns=["id", "key", "at", "x"])


@pytest.fixture(scope="module")
def table(spark, skewed):
    rows = [(int(r.id), r.key, int(r.at), None if pd.isna(r.x) else float(r.x)) for r in skewed.itertuples()]
    return spark.createDataFrame(rows, "id long, key string, at long, x double").repartition(6).persist()


def ordered(skewed):
    return skewed.sort_values(["key", "at", "id"]).reset_index(drop=True)


def test_index_is_dense_and_in_order(table, skewed):
    got = ordering.with_index(table, ["at", "id"], ["key"]).toPandas().sort_values("idx")
    assert list(got["idx"]) == list(range(len(skewed)))
    assert list(got["id"]) == list(ordered(skewed)["id"])


def test_neighbours_equal_one_window(table, skewed):
    indexed = ordering.with_index(table, ["at", "id"], ["key"])
    columns = lambda w: {
        "mean": F.avg("x").over(w.rowsBetween(-9, 0)), "next": F.lead("id", 2).over(w), "prev": F.lag("id").over(w)
    }
    got = ordering.neighbours(indexed, columns, 9, 2, ["key"], block_rows=50).toPandas().set_index("id")
    want = ordered(skewed)
    by = want.groupby("key")
    want["mean"] = by["x"].transform(lambda s: s.rolling(10, min_periods=1).mean())
    want["next"], want["prev"] = by["id"].shift(-2), by["id"].shift(1)
    got = got.loc[want["id"]]
    assert len(got) == len(want)
    for c in ("mean", "next", "prev"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)


def test_running_totals_across_blocks(table, skewed):
    got = ordering.running_totals(table.na.fill(0.0), ["at", "id"], {"total": "x"}, ["key"], block_rows=40)
    got = got.toPandas().set_index("id")
    want = ordered(skewed)
    want["total"] = want["x"].fillna(0).groupby(want["key"]).cumsum()
    np.testing.assert_allclose(got.loc[want["id"]]["total"], want["total"], rtol=1e-9)


def test_carry_forward_across_blocks(table, skewed):
    sparse = table.withColumn("x", F.when(F.col("id") % 50 == 0, F.col("x")))
    got = ordering.carry_forward(ordering.with_index(sparse, ["at", "id"], ["key"]), {"last": "x"}, ["key"], block_rows=20)
    got = got.toPandas().set_index("id")
    want = ordered(skewed)
    want["x"] = want["x"].where(want["id"] % 50 == 0)
    want["last"] = want.groupby("key")["x"].ffill()
    np.testing.assert_allclose(got.loc[want["id"]]["last"].astype(float), want["last"], rtol=1e-12)


def test_average_ranks(table, skewed):
    got = ordering.average_ranks(table, ["id", "x"]).where("column = 'x'").toPandas().set_index("value")["rank"]
    want = skewed["x"].dropna().rank()
    for value, rank in zip(skewed["x"].dropna(), want):
        assert got[value] == rank


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("margin,slots", [(quantiles.MARGIN, 1024), (0.02, 1024), (0.02, 3), (0.2, 1)])
def test_quantiles_are_exact(table, skewed, monkeypatch, by, margin, slots):
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    monkeypatch.setattr(quantiles, "SLOTS", slots)
    probs = [0.0, 0.1, 0.5, 0.98, 1.0]
    got = quantiles.exact_quantiles(table, ["x", "at"], probs, by).toPandas()
    for column in ("x", "at"):
        part = got[got["column"] == column]
        groups = skewed.groupby("key") if by else [(None, skewed)]
        for key, rows in groups:
            mine = part[part["key"] == key] if by else part
            mine = mine.set_index("prob")["value"]
            for p in probs:
                assert mine[p] == pytest.approx(rows[column].quantile(p), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 100, 5001])
def test_quantiles_of_few_rows(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("a"))
    got = {r["prob"]: r["value"] for r in quantiles.exact_quantiles(df, ["a"], [0.02, 0.25, 0.5, 0.98]).collect()}
    want = pd.Series([float(i * i) for i in range(n)])
    assert got == pytest.approx({p: want.quantile(p) for p in (0.02, 0.25, 0.5, 0.98)})


def test_a_sketch_that_is_wrong_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 2)
    df = spark.range(100_000).select(F.sqrt("id").alias("a"))
    with pytest.raises(Exception, match="outside its bracket"):
        quantiles.exact_quantiles(df, ["a"], [0.3, 0.7]).collect()


def test_outliers_of_a_mostly_constant_column(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 100 == 0, F.col("id") + 50.0).otherwise(1.0).alias("a"), F.lit(1.0).alias("b"))
    kept = cleaning.drop_outliers(df, 0.01, cols=["a", "b"])
    assert kept.agg(F.max("a")).first()[0] == 1.0


def test_quantiles_of_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert quantiles.medians(df, ["a", "b"]) == {"a": 1.5}


def test_range_join_equals_nested_loop(spark, table, skewed):
    bands = pd.DataFrame({"band": range(30), "low": np.linspace(-5, 90, 30)})
    bands["high"] = bands["low"] + np.where(bands["band"] % 3 == 0, 40.0, 0.7)
    got = relational.range_join(table, spark.createDataFrame(bands), "x", "low", "high", 3.0, salt=3)
    pairs = {(r["id"], r["band"]) for r in got.select("id", "band").collect()}
    want = {
        (int(r.id), int(b.band))
        for r in skewed.itertuples() for b in bands.itertuples() if b.low <= r.x < b.high
    }
    assert pairs == want and got.count() == len(want)


def test_range_totals_make_no_pairs(spark):
    """A sum that is small beside those around it stays exact; equal, empty and missing bands and values."""
    values = [1e15, -1e15 + 0.5, 0.25, 0.25, 0.5, None, 3.0, -4.0, 0.0, 7.5] + [float(i) for i in range(100, 160)]
    bands = [(1, 0.25, 3.0), (1, 0.25, 3.0), (2, 0.5, 3.5), (3, -1e16, 1e16), (4, 8.0, 9.0), (5, 3.0, 3.0), (6, None, 1.0), (None, 100.0, 130.5)]
    left, right = spark.createDataFrame([(v,) for v in values], "x double"), spark.createDataFrame(bands, "band int, low double, high double")
    got = relational.range_join(left, right, "x", "low", "high", 1e-9, totals={"n": ("count", "x"), "s": ("sum", "x")})
    want = []
    for band, low, high in bands:
        hit = [v for v in values if v is not None and low is not None and low <= v < high]
        if hit:
            want.append((band, low, high, len(hit), math.fsum(hit)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_asof_join(spark, table, skewed):
    right = skewed[skewed["id"] % 7 == 0][["key", "at", "id", "x"]].drop_duplicates(["key", "at"])
    left = skewed[skewed["id"] % 7 != 0][["key", "at", "id"]]
    quotes = spark.createDataFrame(
        [(r.key, int(r.at), int(r.id)) for r in right.itertuples()], "key string, at long, quote long"
    )
    rows = spark.createDataFrame([(r.key, int(r.at), int(r.id)) for r in left.itertuples()], "key string, at long, id long")
    got = ordering.asof_join(rows, quotes, "at", ["key"], ["quote"], tie=["id"]).toPandas().set_index("id")["quote"]
    want = pd.merge_asof(
        left.sort_values("at"), right.rename(columns={"id": "quote"}).sort_values("at"), on="at", by="key"
    ).set_index("id")["quote"]
    assert len(got) == len(want)
    np.testing.assert_array_equal(got.loc[want.index].astype(float), want.astype(float))


def test_rank_rows(table, skewed):
    filled = table.na.fill(-1.0)
    got = ordering.rank_rows(filled, "x", ["key"], ["id"], tiles=7).toPandas().set_index("id")
    want = skewed.fillna(-1.0).sort_values(["key", "x", "id"])
    by = want.groupby("key")
    assert (got.loc[want["id"]]["row_number"].values == (by.cumcount() + 1).values).all()
    assert (got.loc[want["id"]]["rank"].values == by["x"].rank("min").values).all()
    assert (got.loc[want["id"]]["dense_rank"].values == by["x"].rank("dense").values).all()
    assert set(got["ntile"]) == set(range(1, 8))


@pytest.mark.parametrize("alpha,beta", [(0.5, 0.3), (0.9, 0.05), (0.2, 0.8), (1.0, 0.5)])
def test_holt_equals_recursion(table, skewed, alpha, beta):
    got = series.holt(table, "x", ["at", "id"], ["key"], alpha, beta).toPandas()
    for key, rows in ordered(skewed).dropna().groupby("key"):
        x = rows["x"].tolist()
        level, trend = x[0], x[1] - x[0]
        for v in x[1:]:
            new = alpha * v + (1 - alpha) * (level + trend)
            level, trend = new, beta * (new - level) + (1 - beta) * trend
        mine = got[got["key"] == key].set_index("step")["forecast"]
        assert len(mine) == min(12, len(x) // 5)
        for h, value in mine.items():
            assert value == pytest.approx(level + h * trend, rel=1e-6, abs=1e-6)


def test_acf_equals_shifted_slices(table, skewed):
    got = series.acf(table, "x", ["at", "id"], 15).toPandas().set_index("lag")["acf"]
    x = skewed.sort_values(["at", "id"])["x"].dropna().to_numpy()
    for k in range(1, 16):
        assert got[k] == pytest.approx(np.corrcoef(x[:-k], x[k:])[0, 1], rel=1e-9)


def test_periodogram_equals_fft(table, skewed):
    got = series.periodogram(table, "x", ["at", "id"], 2000, ["key"]).toPandas()
    for key, rows in ordered(skewed).dropna().groupby("key"):
        x = rows["x"].to_numpy()
        power = np.abs(np.fft.fft(x)[: len(x) // 2]) ** 2
        mine = got[got["key"] == key].sort_values("bin")["power"].to_numpy()
        np.testing.assert_allclose(mine, power, rtol=1e-6, atol=1e-4)


def test_auc_equals_rank_statistic(table, skewed):
    labelled = table.withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    x = skewed["x"].fillna(skewed["x"].mean())
    y = skewed["id"] % 3 == 0
    ranks, p = x.rank(), y.sum()
    want = (ranks[y].sum() - p * (p + 1) / 2) / (p * (~y).sum())
    assert auc(labelled, "y", "x").first()["auc"] == pytest.approx(want, rel=1e-9)


def test_kaplan_meier_extremes(spark):
    censored = spark.createDataFrame([(t, 0) for t in range(1, 6)], "t long, e int")
    assert {r["survival"] for r in kaplan_meier(censored, "t", "e").collect()} == {1.0}
    dead = spark.createDataFrame([(3, 1)] * 4, "t long, e int")
    assert [(r["at_risk"], r["survival"]) for r in kaplan_meier(dead, "t", "e").collect()] == [(4, 0.0)]


def test_joint_bins_are_counted_once(spark, table):
    """Marginals come from the stored counts: the plan reads those and not the table four times."""
    found = mutual_information(table.withColumn("y", F.col("at") * 2.0), ["x", "y", "at"])
    plan = found._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    assert {leaves.apply(i).nodeName() for i in range(leaves.size())} == {"LogicalRelation"} and "InMemoryRelation" not in plan.toString()
    assert found.count() == 3


def test_quantiles_of_many_columns_run_in_compiled_code(spark, monkeypatch):
    """Java compiles no method of over 8,000 bytes: brackets and pairs of columns are counted by short code, whatever their number."""
    from quarrylens.operators import statistics
    from quarrylens.session import materialize

    seen = []

    def kept(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(
            df.select("*")._jdf.queryExecution().executedPlan()
        )
        seen.extend(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        return materialize(df)

    monkeypatch.setattr(quantiles, "materialize", kept)
    monkeypatch.setattr(statistics, "materialize", kept)
    cols = [f"c{i}" for i in range(8)]
    df = spark.range(2000).selectExpr(*[f"IF(id % {50 + i} = 0, NULL, (id * {7 + i}) % {97 + i} / 4) AS {c}" for i, c in enumerate(cols)])
    pdf = df.toPandas()
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.exact_quantiles(df, cols, [k / 10 for k in range(11)]).collect()}
    assert got == pytest.approx({(c, k / 10): pdf[c].quantile(k / 10) for c in cols for k in range(11)})
    pairs = statistics.mutual_information(df, cols).collect()
    assert len(pairs) == 28 and len(seen) > 4 and max(seen) < 8000

    def plain(x, y):
        both = pdf[[x, y]].dropna()
        bins = lambda c: sum((both[c] > pdf[c].quantile(k / 10)).astype(int) for k in range(1, 10))
        n = both.assign(a=bins(x), b=bins(y)).groupby(["a", "b"]).size() / len(both)
        a, b = n.groupby("a").sum(), n.groupby("b").sum()
        return sum(p * math.log(p / (a[i] * b[j])) for (i, j), p in n.items())

    assert {(r["x"], r["y"]): r["mutual_information"] for r in pairs[:5]} == pytest.approx({(r["x"], r["y"]): plain(r["x"], r["y"]) for r in pairs[:5]})
