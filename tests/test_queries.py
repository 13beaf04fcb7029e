"""Every registered query runs; those with SQL give the same rows as the SQL."""

import math

import duckdb
import pytest

from quarrylens.queries import load_all
from quarrylens.session import TABLES

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{data}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    result = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    mine = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine == sorted_rows(result.columns, result.fetchall())
    assert mine


def rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_isolation_forest_drops_two_percent(spark, data):
    total = spark.read.parquet(f"{data}/lineitem.parquet").count()
    kept = len(rows(spark, data, "b12_drop_outliers_iforest"))
    assert 0.97 * total <= kept < total


def test_dashboard_has_its_charts(spark, data):
    made = {r["chart"]: r["rows"] for r in rows(spark, data, "d26_dashboard")}
    assert {"kpi", "kpi_trend", "target_by", "donut", "treemap", "correlation", "histograms", "waterfall"} <= set(made)
    assert all(made.values())


def test_scatter_points_are_whole_and_bounded(spark, data):
    assert len(rows(spark, data, "d13_scatter_points")) == 1000


def test_regression_tails(spark, data):
    for r in rows(spark, data, "e1_ols_p"):
        assert 0 <= r["p"] <= 1 and r["ci95"] > 1.95 * r["stderr"]


def test_default_limits_are_marginal(spark, data):
    for r in rows(spark, data, "q1_capability_dpmo"):
        assert abs(r["cpk"] - 1.0) < 1e-9 and abs(r["dpmo"] - 2699.796) < 0.01


def test_random_portfolios_lie_on_the_simplex(spark, data):
    found = rows(spark, data, "f5_random_portfolios")
    assert len(found) == 3000
    for r in found:
        weights = [r[c] for c in r.asDict() if c.startswith("w_")]
        assert abs(sum(weights) - 1) < 1e-5 and min(weights) >= 0 and r["vol"] > 0


def test_inertia_falls_with_k(spark, data):
    inertia = [r["inertia"] for r in sorted(rows(spark, data, "m2_kmeans_elbow"), key=lambda r: r["k"])]
    assert len(inertia) == 9 and inertia[-1] < inertia[0]


def test_cluster_shares(spark, data):
    assert abs(sum(r["share"] for r in rows(spark, data, "m3_kmeans_sizes")) - 1) < 1e-9
    profiles = rows(spark, data, "m4_cluster_profiles")
    assert abs(sum(r["l_quantity_z"] for r in profiles)) < 1e-9


def test_components(spark, data):
    parts = rows(spark, data, "m5_pca_variance")
    assert abs(parts[-1]["cumulative"] - 1) < 1e-9
    scores = rows(spark, data, "m6_pca_scores")
    assert abs(sum(r["pc1"] for r in scores)) < 1e-6 * len(scores)


def test_forests(spark, data):
    for name in ("m7_forest_classify", "m9_driver_model"):
        assert abs(sum(r["importance"] for r in rows(spark, data, name)) - 1) < 1e-9
    best = rows(spark, data, "m9_driver_model")[0]
    assert best["feature"] == "l_quantity" and best["r2"] > 0.8


def test_what_if_labels(spark, data):
    labels = {r["driver"]: r for r in rows(spark, data, "m11_label_drivers")}
    assert labels["l_quantity"]["influence"] == "strong"
    assert labels["l_tax"]["influence"] == "limited"
    effects = {r["driver"]: r for r in rows(spark, data, "m10_what_if")}
    assert effects["l_quantity"]["increase_effect"] > 0 > effects["l_quantity"]["decrease_effect"]
