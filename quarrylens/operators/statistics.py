"""Tests, fits and dependence measures, each from aggregates over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.moments import ratio
from quarrylens.functions.tails import f_sf, log_normal_cdf, t_quantile, t_two_sided, tail_udf
from quarrylens.operators.charts import box as five_number  # noqa: F401
from quarrylens.operators.charts import histogram
from quarrylens.operators.ordering import average_ranks, running_totals
from quarrylens.operators.quantiles import exact_quantiles
from quarrylens.session import materialize, quoted


def grade(value, *levels: tuple[float, str], otherwise: str):
    """First label whose limit the value exceeds."""
    out = F.lit(otherwise)
    for limit, label in reversed(levels):
        out = F.when(value > limit, label).otherwise(out)
    return F.when(value.isNotNull(), out)


# --- regression and group comparison -----------------------------------------------------


def fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x: n, slope, intercept, r2, standard error and t of the slope."""
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    sums = df.groupBy(*by).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"),
        F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"),
    )
    residual = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0))
    error = F.when(F.col("n") > 2, F.sqrt(residual / (F.col("n") - 2) / F.when(F.col("sxx") > 0, F.col("sxx"))))
    return sums.withColumn("stderr", error).withColumn("t", ratio("slope", "stderr")).drop("sxx", "syy")


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`fit` with the two-sided p-value and the 95% half-width of the slope."""
    dof = F.when(F.col("n") > 2, (F.col("n") - 2).cast("double"))
    p = tail_udf(lambda t, d: t_two_sided(t, d))
    quantile = tail_udf(lambda d: t_quantile(0.975, d))
    return fit(df, x, y, by).withColumns({"p": p(F.col("t"), dof), "ci95": quantile(dof) * F.col("stderr")})


def ols_residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with both values plus ``residual``; the fitted line is a scalar subquery."""
    line = fit(df, x, y).select(F.struct("slope", "intercept").alias("line")).scalar()
    return (
        df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
        .withColumn("_line", line)
        .withColumn("residual", quoted(y) - (F.col("_line.intercept") + F.col("_line.slope") * quoted(x)))
        .drop("_line")
    )


def anova(df: DataFrame, group: str, col: str, min_rows: int = 3) -> DataFrame:
    """One-way analysis of variance over groups of at least ``min_rows`` rows.

    F compares the kept groups with each other; eta squared measures them against
    the mean of all rows.
    """
    x = quoted(col).cast("double")
    groups = df.groupBy(quoted(group).alias("g")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("m"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"),
    )
    groups = materialize(groups)  # read twice below, aggregated from the table once
    kept = F.col("g").isNotNull() & (F.col("rows") >= min_rows) & (F.col("n") > 0)
    mean = lambda cond: F.sum(F.when(cond, F.col("n") * F.col("m"))) / F.sum(F.when(cond, F.col("n")))
    centers = groups.agg(F.struct(mean(F.lit(True)).alias("all"), mean(kept).alias("kept")).alias("c")).scalar()
    sums = groups.where(kept).withColumn("c", centers).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("c.kept"), 2)).alias("between"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("c.all"), 2)).alias("between_all"),
    )
    df1 = F.when(F.col("k") > 1, F.col("k") - 1).cast("double")
    df2 = F.when(F.col("n") > F.col("k"), F.col("n") - F.col("k")).cast("double")
    tested = sums.select(
        F.col("k").alias("groups"), "n",
        ratio(F.col("between") / df1, F.col("within") / df2).alias("f"),
        ratio("between_all", F.col("within") + F.col("between_all")).alias("eta2"),
        df1.alias("df1"), df2.alias("df2"),
    )
    return tested.withColumns(
        {
            "p": tail_udf(f_sf)("f", "df1", "df2"),
            "effect": grade(F.col("eta2"), (0.14, "Large"), (0.06, "Medium"), otherwise="Small"),
        }
    )


# --- survival ----------------------------------------------------------------------------


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """Survival curve: group, time, at_risk, deaths, survival. ``event`` is 1 for a death."""
    g = quoted(group) if group else F.lit("all")
    t, e = quoted(time), quoted(event).cast("int")
    steps = (
        df.where(t.isNotNull() & e.isNotNull() & g.isNotNull())
        .groupBy(g.alias("group"), t.alias("time"))
        .agg(F.sum(e).cast("bigint").alias("deaths"), F.count(F.lit(1)).alias("leaving"))
    )
    # latest time first: the running total of those leaving is the number still at risk
    reverse = steps.withColumn("_later", -F.col("time"))
    risk = running_totals(reverse, ["_later"], {"at_risk": "leaving"}, ["group"]).drop("_later")
    share = F.col("deaths") / F.col("at_risk")
    terms = risk.withColumns(
        {
            "_log": F.when(share < 1, F.log1p(-share)).otherwise(0.0),
            "_all": (share >= 1).cast("int"),
        }
    )
    totals = running_totals(terms, ["time"], {"_sum": "_log", "_dead": "_all"}, ["group"])
    return totals.select(
        "group", "time", "at_risk", "deaths",
        F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_sum")).alias("survival"),
    )


def median_survival(curve: DataFrame) -> DataFrame:
    """First time at which survival is at most one half; NULL when it never is."""
    reached = F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))
    return curve.groupBy("group").agg(F.min(reached).alias("median_survival"))


# --- dependence --------------------------------------------------------------------------


def _pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[tuple[str, str]]) -> DataFrame:
    row = df.agg(*[F.corr(quoted(a).cast("double"), quoted(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(names)
    ]
    return row.select(F.inline(F.array(*cells)))


RANKS_SENT = 500_000  # ranks of a column, 16 bytes each, that are broadcast; more are joined by a shuffle of slim rows


def _spearman(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlation of column pairs over rows that have all of ``cols``.

    Rows go through the columns one by one and each value gives way to its rank, so a row is
    shuffled once per column at most and not once per pair; the products of all pairs come
    from the rows of ranks. Columns of few values, whose values many rows share, are not
    shuffled at all.
    """
    values = [f"_v{i}" for i in range(len(cols))]
    out = df.select(*[quoted(c).cast("double").alias(v) for c, v in zip(cols, values)])
    ranks = materialize(average_ranks(out, values))
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}  # one row per column
    # the mean rank of n rows is (n + 1) / 2 in every column
    middle = (out.count() + 1) / 2.0
    ranked = out
    for v in sorted(values, key=lambda v: sizes.get(v, 0)):
        mine = ranks.where(F.col("column") == v).select(F.col("value").alias(v), (F.col("rank") - middle).alias("_rank"))
        joined = ranked.join(F.broadcast(mine) if sizes.get(v, 0) <= RANKS_SENT else mine, v)
        ranked = joined.select(*[F.col("_rank").alias(v) if v == u else F.col(u) for u in values])
    at = {c: F.col(v) for c, v in zip(cols, values)}
    squares = [F.sum(at[c] * at[c]).alias(f"s{i}") for i, c in enumerate(cols)]
    row = ranked.agg(*squares, *[F.sum(at[a] * at[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    size = {c: F.col(f"s{i}") for i, c in enumerate(cols)}
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), ratio(F.col(f"p{i}"), F.sqrt(size[a] * size[b])).alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def correlations(
    df: DataFrame, cols: Sequence[str], method: str = "pearson", top: int | None = 8, max_columns: int | None = None
) -> DataFrame:
    """Column pairs by absolute correlation: x, y, r, strength.

    Spearman ranks are taken over the rows complete for each pair.
    """
    cols = list(cols)[:max_columns]
    pairs = list(combinations(cols, 2))
    if method == "pearson":
        out = _pearson(df, pairs, pairs)
    elif method == "spearman":
        nulls = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        whole = [c for i, c in enumerate(cols) if not nulls[f"n{i}"]]
        shared = list(combinations(whole, 2))
        parts = [_spearman(df, whole, shared)] if shared else []
        for a, b in pairs:
            if (a, b) not in shared:
                complete = df.where(quoted(a).isNotNull() & quoted(b).isNotNull())
                parts.append(_spearman(complete, [a, b], [(a, b)]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
    else:
        raise ValueError(f"unknown method {method!r}")
    size = F.abs("r")
    out = out.withColumn("strength", grade(size, (0.7, "Strong"), (0.4, "Moderate"), otherwise="Weak"))
    ordered = out.orderBy(F.desc_nulls_last(F.abs("r")), "x", "y")
    return ordered.limit(top) if top else ordered


def strong_pairs(df: DataFrame, cols: Sequence[str], thr: float = 0.7, redundant: float = 0.95) -> DataFrame:
    """Strong linear, strong monotonic and redundant pairs (thresholds inferred)."""
    linear = correlations(df, cols, "pearson", None, len(cols)).where(F.abs("r") > thr)
    monotonic = correlations(df, cols, "spearman", None, len(cols)).where(F.abs("r") > thr)
    kinds = [
        linear.select(F.lit("linear").alias("kind"), "x", "y", "r"),
        monotonic.select(F.lit("monotonic").alias("kind"), "x", "y", "r"),
        linear.where(F.abs("r") > redundant).select(F.lit("redundant").alias("kind"), "x", "y", "r"),
    ]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


def mutual_information(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of column pairs over quantile bins.

    Only joint bin counts are shuffled: bins x bins per pair.
    """
    probs = [k / bins for k in range(1, bins)]
    edges: dict[str, list[float]] = {c: [] for c in cols}
    for r in exact_quantiles(df, cols, probs).collect():  # bins - 1 numbers per column
        if r["value"] is not None:
            edges[r["column"]].append(r["value"])

    def binned(c):
        x = quoted(c).cast("double")
        return F.when(x.isNotNull(), sum([(x > e).cast("int") for e in edges[c]], F.lit(0)))

    codes = df.select(*[binned(c).alias(f"b{i}") for i, c in enumerate(cols)])
    pairs = list(combinations(range(len(cols)), 2))
    cells = [(F.lit(k) * bins + F.col(f"b{i}")) * bins + F.col(f"b{j}") for k, (i, j) in enumerate(pairs)]  # null if either is
    counted = codes.select(F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    pair = F.floor(F.col("cell") / (bins * bins)).cast("int")
    x, y = (F.get(F.array(*[F.lit(cols[p[end]]) for p in pairs]), pair) for end in (0, 1))
    joint = materialize(  # bins x bins per pair, read four times below
        counted.select(x.alias("x"), y.alias("y"), F.floor(F.col("cell") / bins % bins).cast("int").alias("a"), (F.col("cell") % bins).alias("b"), "n")
    )
    row = joint.groupBy("x", "y", "a").agg(F.sum("n").alias("na"))
    column = joint.groupBy("x", "y", "b").agg(F.sum("n").alias("nb"))
    total = joint.groupBy("x", "y").agg(F.sum("n").alias("nt"))
    cell = joint.join(row, ["x", "y", "a"]).join(column, ["x", "y", "b"]).join(total, ["x", "y"])
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb")))
    return cell.groupBy("x", "y").agg(F.sum(term).alias("mutual_information"))


# --- distribution shape ------------------------------------------------------------------


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Jarque-Bera test over all rows; its p-value has a closed form (two degrees of freedom)."""
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("x")) for c in cols]
    shape = df.select(F.inline(F.array(*cells))).groupBy("column").agg(
        F.count("x").alias("n"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt")
    )
    jb = F.col("n") / 6.0 * (F.pow("skew", 2) + F.pow("kurt", 2) / 4)
    return shape.select("column", "n", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p"))


def order_normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Anderson-Darling test of normality over all rows: column, n, a2, p.

    The test compares the whole ordered column with the fitted normal. Equal values are
    one point first and all columns share one sort over all tasks; what each point adds
    depends on its rank alone. ``p`` is for mean and deviation taken from the column. Columns
    of fewer than eight values or without spread have no statistic.
    """
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("x")) for c in cols]
    long = df.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull())
    points = materialize(long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("c")))
    weight = F.sum("c")
    fitted = points.groupBy("column").agg(weight.alias("n"), (F.sum(F.col("c") * F.col("x")) / weight).alias("mean"))
    around = points.join(F.broadcast(fitted), "column")  # one row per column
    spread = around.groupBy("column").agg((F.sum(F.col("c") * F.pow(F.col("x") - F.col("mean"), 2)) / (F.max("n") - 1)).alias("var"))
    placed = running_totals(points, ["x"], {"upto": "c"}, ["column"]).join(F.broadcast(fitted), "column").join(F.broadcast(spread), "column")
    z = (F.col("x") - F.col("mean")) / F.sqrt(F.when(F.col("var") > 0, F.col("var")))
    log_cdf = tail_udf(log_normal_cdf)
    scored = placed.withColumn("z", z).withColumns({"below": log_cdf(F.col("z")), "above": log_cdf(-F.col("z"))})
    # ranks r + 1 .. r + c of a point: sums of 2i - 1 and of 2(n - i) + 1
    ranks = 2 * F.col("upto") - F.col("c")
    part = F.col("c") * (ranks * F.col("below") + (2 * F.col("n") - ranks) * F.col("above"))
    found = scored.groupBy("column").agg(F.max("n").alias("n"), F.sum(part).alias("s"))
    a2 = F.when(F.col("n") >= 8, -F.col("n") - F.col("s") / F.col("n"))
    a = F.col("a2") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    known = found.withColumn("a2", a2).withColumn("a", F.when(a < 150, a).when(a >= 150, 150.0))
    # Coefficients of the p-value by size of the statistic.
    p = (
        F.when(F.col("a") >= 0.6, F.exp(1.2937 - 5.709 * F.col("a") + 0.0186 * F.col("a") * F.col("a")))
        .when(F.col("a") >= 0.34, F.exp(0.9177 - 4.279 * F.col("a") - 1.38 * F.col("a") * F.col("a")))
        .when(F.col("a") >= 0.2, 1 - F.exp(-8.318 + 42.796 * F.col("a") - 59.938 * F.col("a") * F.col("a")))
        .otherwise(1 - F.exp(-13.436 + 101.14 * F.col("a") - 223.73 * F.col("a") * F.col("a")))
    )
    return known.select("column", "n", "a2", F.when(F.col("a").isNotNull(), p).alias("p"))


def density(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Density histogram with the fitted normal density at each bin's middle."""
    x = quoted(col).cast("double")
    whole = df.agg(F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))).scalar()
    z = (F.col("low") + F.col("high") - 2 * F.col("_w.m")) / 2 / F.col("_w.s")
    normal = F.exp(-z * z / 2) / (F.col("_w.s") * F.sqrt(2 * F.pi()))
    return (
        histogram(df, [col], bins)
        .withColumn("_w", whole)
        .withColumns(
            {"density": ratio("count", F.col("_w.n") * (F.col("high") - F.col("low"))), "normal": normal}
        )
        .drop("_w")
    )


# --- ROC ---------------------------------------------------------------------------------


def _roc_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative true and false positives per distinct score, highest score first."""
    s = quoted(score).cast("double")
    mean = df.agg(F.avg(s)).scalar()
    filled = df.select(
        F.coalesce(quoted(label).cast("int"), F.lit(0)).alias("y"), F.coalesce(s, mean).alias("score")
    )
    steps = filled.groupBy("score").agg(
        F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")
    )
    ordered = steps.withColumn("_down", -F.col("score"))
    return running_totals(ordered, ["_down"], {"tp": "pos", "fp": "neg"}).drop("_down")


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC points (threshold, fpr, tpr): the origin (threshold NULL), then one per distinct score."""
    y = F.coalesce(quoted(label).cast("int"), F.lit(0))
    whole = df.agg(F.struct(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))).scalar()
    points = _roc_steps(df, label, score).withColumn("_w", whole).select(
        F.col("score").alias("threshold"),
        ratio("fp", "_w.n").alias("fpr"), ratio("tp", "_w.p").alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(points)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve (trapezoids) with its grade."""
    steps = _roc_steps(df, label, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    out = steps.agg(ratio(area, F.sum("neg") * F.sum("pos")).alias("auc"))
    return out.withColumn(
        "grade", grade(F.col("auc"), (0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair"), otherwise="Poor")
    )
