"""Edge cases: empty, constant, all-missing, thresholds, ties, odd names."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarrylens.functions import tails
from quarrylens.functions.lexicon import CODONS
from quarrylens.operators import catalog, charts, cleaning, finance, merging, profiling, series, statistics
from quarrylens.operators.ordering import rank_rows
from quarrylens.session import nan_to_null
from quarrylens.operators.relational import run_sql
from quarrylens.sources.files import flatten_struct, load, malformed_lines, sniff_encoding, sniff_separator
from quarrylens.sources.text_table import text_to_table


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize("good,kind", [(59, "string"), (60, "string"), (61, "double")])
def test_numeric_share(spark, good, kind):
    values = ["$1,234", "€5", "1 2"] * 20 + ["7"]
    df = strings(spark, values[:good] + ["x"] * (100 - good))
    assert dict(cleaning.coerce_numeric(df).dtypes)["v"] == kind


def test_numbers_are_parsed(spark):
    df = strings(spark, ["$1,234", "€5", "1 2", "1e3", "-.5", "1d", None, "NaN"])
    got = [r[0] for r in df.select(cleaning.parsed_number(F.col("v"))).collect()]
    assert got == [1234.0, 5.0, 12.0, 1000.0, -0.5, None, None, None]


@pytest.mark.parametrize("good,kind", [(69, "string"), (70, "string"), (71, "timestamp_ntz")])
def test_date_share(spark, good, kind):
    df = strings(spark, ["2024-02-29"] * good + ["soon"] * (100 - good))
    assert dict(cleaning.coerce_dates(df).dtypes)["v"] == kind


def test_digit_strings_are_not_dates(spark):
    assert dict(cleaning.coerce_dates(strings(spark, ["2024"] * 5), gate=False).dtypes)["v"] == "string"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string, c timestamp")
    assert [r["n_rows"] for r in profiling.column_stats(df).collect()] == [0, 0, 0]
    assert profiling.quality_overview(df).first()["rows"] == 0
    assert cleaning.impute(df).count() == 0
    assert charts.histogram(df, ["a"]).count() == 0


def test_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"))] * 4, "a double, b double, c double")
    df = nan_to_null(df)
    rows = {r["column"]: r for r in profiling.column_stats(df, shape=True).collect()}
    assert rows["a"]["skewness"] == 0.0 and rows["a"]["nunique"] == 1
    assert rows["b"]["n"] == rows["c"]["n"] == rows["c"]["nunique"] == 0
    assert cleaning.drop_empty_columns(df).columns == ["a"]
    assert [r["count"] for r in charts.histogram(df, ["a"]).collect()] == [4]
    assert cleaning.drop_outliers(df.withColumn("d", F.lit(2))).count() == 4


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A b", "a.b", "%", " a b "])
    assert cleaning.snake_case_columns(df).columns == ["a_b", "a_b_2", "col_2", "a_b_3"]


def test_columns_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "y")], ["a.b c", "d`e"])
    assert [r[0] for r in cleaning.impute(df).collect()] == [1.0, 2.0, 3.0]
    assert {r["column"] for r in profiling.quality(df).collect()} == {"a.b c", "d`e"}


def test_clip_negatives(spark):
    df, issues = cleaning.validate_numeric(spark.createDataFrame([(-280, 1), (5, 2)], "n int, m int"))
    assert [r["n"] for r in df.collect()] == [0, 5]
    assert [(r["column"], r["min"]) for r in issues.collect()] == [("n", -280.0)]


@pytest.mark.parametrize("match", [False, True])
def test_merge_of_missing_keys(spark, match):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "key int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z"), (None, "w")], "key int, l string")
    out = merging.smart_merge([left, right], match_nulls=match)
    assert out.columns == ["key", "l", "l_t2"]
    nulls = {(None, "b", "y"), (None, "b", "w")} if match else {(None, "b", None)}
    assert {(r["key"], r["l"], r["l_t2"]) for r in out.collect()} == {(1, "a", "x"), (1, "a", "z"), (2, "c", None)} | nulls
    assert merging.pair_count(left, right, "key", "key", match) == (4 if match else 2)
    with pytest.raises(ValueError):
        merging.smart_merge([left, right], match_nulls=match, max_pairs=1)


def test_sketched_overlap_finds_the_same_keys(spark):
    orders = spark.range(3000).select("id", (F.col("id") % 500).alias("buyer"))
    buyers = spark.range(500).select(F.col("id").alias("buyer"), (F.col("id") * 1000 + 7).alias("code"))
    found = [
        {(r["child_table"], r["child_column"], r["parent_column"]) for r in merging.relationships(
            {"orders": orders, "buyers": buyers}, 0.9, approx
        ).collect()}
        for approx in (False, True)
    ]
    assert found[0] == found[1] == {("orders", "buyer", "buyer"), ("buyers", "buyer", "id")}
    assert merging.best_pair(orders, buyers, approx=True)[1:3] == ("buyer", "buyer")


def test_missing_keys_keep_their_rows(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r["k"], r["x"]): (r["row_number"], r["rank"]) for r in rank_rows(df, "x", ["k"]).collect()}
    assert got == {(None, 1.0): (1, 1), (None, 3.0): (2, 2), ("a", None): (1, 1), ("a", 2.0): (2, 2)}


def test_isolation_forest_finds_the_odd_row(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    odd = df.unionAll(spark.createDataFrame([(999, 500.0, -500.0)], df.schema))
    best = cleaning.isolation_scores(odd, ["a", "b"]).orderBy(F.desc("isolation_score")).first()
    assert best["id"] == 999


def test_flatten_and_separators(spark, tmp_path):
    df = spark.createDataFrame([((1, ("x",)),)], "o struct<a: int, b: struct<c: string>>")
    assert flatten_struct(df).columns == ["o.a", "o.b.c"]
    for sep in (",", "\t", "|", ";"):
        path = str(tmp_path / f"t{ord(sep)}.csv")
        with open(path, "w") as f:
            f.write(f"a{sep}b{sep}c\n1{sep}x{sep}2.5\n2{sep}y{sep}3.5\n")
        assert sniff_separator(spark, path) == sep
        assert load(spark, path, "csv", sep="auto").columns == ["a", "b", "c"]
    with pytest.raises(ValueError):
        load(spark, path, "xlsx")


def test_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    with open(path, "w") as f:
        f.write("key;n;text\n" + "".join(f"{i};{i};a\n" for i in range(10)) + '11;12\n1;2;"x;y"\n5;6;b;c\n7;8;d;e;f\n')
    good = load(spark, path, "csv", sep="auto")
    assert good.count() == len(good.collect()) == good.select("n").count() == len(good.select("key").collect()) == 12
    assert sorted(r["line"] for r in malformed_lines(spark, path).collect()) == ["5;6;b;c", "7;8;d;e;f"]
    assert malformed_lines(spark, path).count() == 2


def test_json_lines_under_any_name(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text("".join(f'{{"a": {i}}}\n' for i in range(1000)))
    assert load(spark, str(path), "json").count() == 1000
    path.write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert load(spark, str(path), "json", multiline=True).count() == 2


def test_late_latin_letter(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes("id,name\n".encode() + b"1,a\n" * 5000 + "2,Müller\n".encode("latin-1"))
    assert sniff_encoding(spark, str(path)) == "ISO-8859-1"
    assert load(spark, str(path), "csv").where("id = 2").first()["name"] == "Müller"


def test_name_clash(spark):
    long = "x" * 30
    with pytest.raises(ValueError):
        run_sql({long + "_a": spark.range(1), long + "_b": spark.range(2)}, f"SELECT * FROM {long}")


def test_date_order_from_the_whole_column(spark):
    for texts, month in ((["1/2/2024"] * 9 + ["13/2/2024"], 2), (["1/2/2024"] * 9 + ["2/13/2024"], 1)):
        got = cleaning.coerce_dates(strings(spark, texts), gate=False)
        assert {r["v"].month for r in got.limit(9).collect()} == {month}


def test_scatter_without_a_key(spark):
    df = spark.range(30).select("id", (F.col("id") % 7).alias("y"))
    assert charts.chart(df, {"x": "id", "y": "y", "type": "scatter", "top_n": 12}).count() == 12


def test_encodings(spark, tmp_path):
    for encoding, sniffed in (("utf-8", "UTF-8"), ("latin-1", "ISO-8859-1")):
        path = str(tmp_path / f"{encoding}.csv")
        with open(path, "w", encoding=encoding) as f:
            f.write("id,name\n1,Müller\n2,Peña\n")
        assert sniff_encoding(spark, path) == sniffed
        assert [r["name"] for r in load(spark, path, "csv").orderBy("id").collect()] == ["Müller", "Peña"]


def test_unstructured_text(spark):
    with pytest.raises(ValueError):
        text_to_table(strings(spark, ["no keys here", "none either"]), "v")
    with pytest.raises(ValueError):
        text_to_table(strings(spark, ["a: 1 | b: 2", "c: 1", "d: 2"]), "v")
    got = text_to_table(strings(spark, ["at: 10:30 | n: 1", "at: 11:00 | n: 2.5", "junk", "n: 3 | at: 12:15"]), "v")
    assert {(r["at"], r["n"]) for r in got.collect()} == {("10:30", 1.0), ("11:00", 2.5), ("12:15", 3.0)}


def test_trend_from_zero(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 2 else 1.0) for i in range(20)], "i int, v double")
    row = charts.kpi_trend(df, ["v"], ["i"]).first()
    assert row["first_mean"] == 0.0 and not row["show_delta"]


def test_anova_skips_small_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0), ("c", 100.0), ("c", 100.0)]
    row = statistics.anova(spark.createDataFrame(rows, "g string, x double"), "g", "x").first()
    assert row["groups"] == 2 and row["f"] == pytest.approx(2.4) and row["p"] == pytest.approx(0.19626, abs=1e-4)


def test_spearman_uses_complete_pairs(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 3.0), (3.0, 1.0, 2.0), (4.0, 5.0, 9.0), (9.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = df.toPandas().corr(method="spearman")
    for r in statistics.correlations(df, ["a", "b", "c"], "spearman").collect():
        assert r["r"] == pytest.approx(want.loc[r["x"], r["y"]])


@pytest.mark.parametrize("sent", [0, 500_000])
def test_spearman_shuffles_rows_once_per_column(spark, monkeypatch, sent):
    """Ties, a constant column and names with dots; no shuffle holds value pairs, whether ranks are broadcast or not."""
    monkeypatch.setattr(statistics, "RANKS_SENT", sent)
    rows = [(float(i % 7), float(i * i % 50), 0.0 if i % 3 else float(-i), 5.0) for i in range(200)]
    df = spark.createDataFrame(rows, "`a.b` double, c double, d double, e double").repartition(4)
    want = df.toPandas().corr(method="spearman")
    got = statistics.correlations(df, ["a.b", "c", "d", "e"], "spearman", None)
    for r in got.collect():
        assert (r["r"] is None) if "e" in (r["x"], r["y"]) else r["r"] == pytest.approx(want.loc[r["x"], r["y"]])
    assert "vx" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_control_chart_full_last_group(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(40)], "i int, v double")
    assert series.xbar_chart(df, "v", ["i"]).count() == 20
    assert series.xbar_chart(df, "v", ["i"], drop_last=True).count() == 19


def test_payback(spark):
    flows = [("p", 0, -100.0), ("p", 1, 60.0), ("p", 2, 80.0), ("q", 0, -100.0), ("q", 1, 10.0)]
    df = spark.createDataFrame(flows, "project string, t int, cf double")
    got = {r["project"]: r["payback"] for r in finance.payback(df, "project", "t", "cf").collect()}
    assert got == {"p": 1.5, "q": 2.0}
    value = {r["project"]: r["npv"] for r in finance.npv(df, "project", "t", "cf", 0.1).collect()}
    assert value["p"] == pytest.approx(-100 + 60 / 1.1 + 80 / 1.21)


def test_missing_prices_are_carried(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, None, 10.0), (3, 20.0, 10.0)], "i int, a double, b double")
    got = [(r["a"], r["b"]) for r in finance.asset_returns(df, ["i"], ["a", "b"]).collect()]
    assert sorted(got) == [(0.0, 1.0), (1.0, 0.0)]


def test_routing_ties_and_default(spark):
    df = strings(spark, ["Cluster the Portfolio", "hello", None, "ANOVA and regression vs npv"])
    assert [r["domain"] for r in catalog.route(df, "v").collect()] == ["ml", "statistics", "statistics", "statistics"]
    df = strings(spark, ["beam deflection of a concrete column", "npv of cpk", "voltage across a capacitor", "```r\nx"])
    assert [r["domain"] for r in catalog.route(df, "v").collect()] == ["structural", "manufacturing", "electrical", "code"]


def test_table_context(spark):
    df = spark.createDataFrame([(1, 2.0)], "order_id int, unit_price double")
    row = catalog.table_context(df, {"web": ["url", "page"], "retail": ["price", "order"]}).first()
    assert (row["detected_context"], row["score"]) == ("retail", 4)


def test_codons():
    assert len(CODONS) == 64
    assert [CODONS[c] for c in ("ATG", "TAA", "TGG", "GAT", "AAA")] == ["Met(Start)", "Stop", "Trp", "Asp", "Lys"]


def test_sequences(spark):
    row = catalog.sequence_stats(strings(spark, ["ATGC"]), "v").first()
    assert (row["gc_pct"], row["tm"], row["complement"], row["reverse_complement"]) == (50.0, 12, "TACG", "GCAT")


def test_benchmark_without_history(spark):
    run = spark.createDataFrame([("a", "r2", 0.8)], "context string, metric string, value double")
    row = catalog.benchmark_compare(run, None).first()
    assert row["past_runs"] == 0 and row["change_pct"] is None


def test_suggestions_in_other_languages(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(9)], "sales double, shop string")
    assert profiling.suggest(df, lang="de").collect()[0]["suggestion"] == "Top 10 shop nach sales"


def test_tails():
    assert tails.normal_sf(1.959963985) == pytest.approx(0.025, rel=1e-6)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert tails.f_sf(3.0, 2, 20) == pytest.approx(0.0725381503, rel=1e-8)
    assert tails.chi2_sf(31.410432844, 20) == pytest.approx(0.05, rel=1e-8)


@pytest.mark.parametrize("n", [1e6, 1e8, 1e10, 1e12, 1e14])
def test_tails_of_many_rows(n):
    """Against the expansion of the t tail in 1 / n, and F with one degree as its square."""
    for t in (0.5, 2.0, 3.5):
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        second = density * t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / (48 * n * n)
        want = math.erfc(t / math.sqrt(2)) + density * t * (t * t + 1) / (2 * n) + second
        assert tails.t_two_sided(t, n) == pytest.approx(want, rel=1e-10)
        assert tails.f_sf(t * t, 1, n) == pytest.approx(want, rel=1e-10)
    assert tails.t_quantile(0.975, n) == pytest.approx(1.959963984540054 * (1 + (1.959963984540054**2 + 1) / (4 * n)), rel=1e-10)
    assert 0 < tails.t_two_sided(30.0, n) < 1e-190
    assert tails.f_sf(2.0, 4, n) == pytest.approx(math.exp(-4.0) * (1 + 4.0), rel=20 / n + 1e-12)  # the chi-square limit


def test_tails_take_arrays_and_report_no_convergence(monkeypatch):
    got = tails.t_two_sided(np.array([0.0, 2.228138852, 1.0]), np.array([3.0, 10.0, 1e9]))
    assert got == pytest.approx([1.0, 0.05, 0.3173105], rel=1e-6)
    monkeypatch.setattr(tails, "ROUNDS", 2)
    with pytest.raises(ArithmeticError):
        tails.t_two_sided(2.0, 1000.0)


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_udf_helpers_travel_by_value(tmp_path):
    code = "import pickle, sys; print(pickle.load(open(sys.argv[1], 'rb'))(3.0, 2.0, 20.0))"
    path = tmp_path / "f.pkl"
    path.write_bytes(cloudpickle.dumps(tails.f_sf))
    done = subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, capture_output=True, text=True)
    assert float(done.stdout) == pytest.approx(0.0725381503, rel=1e-8), done.stderr
