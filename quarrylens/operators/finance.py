"""Cash flows, returns, portfolios and price summaries over tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.moments import ratio
from quarrylens.operators.ordering import carry_forward, preceding, with_index
from quarrylens.session import materialize, quoted

TRADING_DAYS = 252
PERIOD_CHUNK = 1024
RATE_GRID = tuple(0.01 + k * (0.35 - 0.01) / 199 for k in range(200))


def cash_flows(df: DataFrame, project: str, t: str, cf: str) -> DataFrame:
    """Net flow per project and period: a hot project shrinks to its number of periods."""
    return df.groupBy(quoted(project).alias("project"), quoted(t).alias("t")).agg(
        F.sum(quoted(cf).cast("double")).alias("cf")
    )


def npv(df: DataFrame, project: str, t: str, cf: str, rate: float = 0.1) -> DataFrame:
    """Net present value and profitability index per project; period 0 is the outlay."""
    period, flow = quoted(t), quoted(cf).cast("double")
    sums = df.groupBy(quoted(project).alias("project")).agg(
        F.sum(flow / F.pow(F.lit(1.0 + rate), period)).alias("npv"),
        F.abs(F.sum(F.when(period == 0, flow))).alias("_outlay"),
    )
    return sums.select(
        "project", "npv", ratio(F.col("npv") + F.col("_outlay"), "_outlay").alias("profitability_index")
    )


def payback(df: DataFrame, project: str, t: str, cf: str) -> DataFrame:
    """Periods until inflows cover the outlay, interpolated; the number of periods if never."""
    flows = cash_flows(df, project, t, cf)
    order = Window.partitionBy("project").orderBy("t")
    outlay = F.abs(F.first("cf").over(order))
    inflow = F.sum(F.when(F.col("t") > 0, F.col("cf")).otherwise(0.0)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    steps = flows.withColumns({"_outlay": outlay, "_inflow": inflow})
    point = F.col("t") - 1 + (F.col("_outlay") - (F.col("_inflow") - F.col("cf"))) / F.col("cf")
    covered = (F.col("t") > 0) & (F.col("_inflow") >= F.col("_outlay"))
    return steps.groupBy("project").agg(
        F.coalesce(
            F.min_by(point, F.when(covered, F.col("t"))), F.count(F.lit(1)).cast("double")
        ).alias("payback")
    )


def npv_curve(
    df: DataFrame, project: str, t: str, cf: str, rates: Sequence[float] = RATE_GRID
) -> DataFrame:
    """Net present value of each project over a grid of discount rates.

    Flows are gathered only after they are summed per whole period, and at most
    ``PERIOD_CHUNK`` periods at a time; the grid is applied to that short list, so no
    row is multiplied before the shuffle.
    """
    chunk = F.floor(F.col("t") / PERIOD_CHUNK).alias("chunk")
    flows = cash_flows(df.withColumn(t, quoted(t).cast("bigint")), project, t, cf)
    lists = flows.groupBy("project", chunk).agg(F.collect_list(F.struct("t", "cf")).alias("flows"))
    grid = F.array(*[F.lit(float(r)) for r in rates])
    value = lambda r: F.aggregate(
        "flows", F.lit(0.0), lambda acc, f: acc + f["cf"] / F.pow(1 + r, f["t"])
    )
    partial = lists.select("project", F.transform(grid, value).alias("values"))
    pairs = F.zip_with(grid, "values", lambda r, v: F.struct(r.alias("rate"), v.alias("npv")))
    return partial.select("project", F.inline(pairs)).groupBy("project", "rate").agg(F.sum("npv").alias("npv"))


def irr(
    df: DataFrame, project: str, t: str, cf: str, low: float = -0.9, high: float = 10.0, steps: int = 60
) -> DataFrame:
    """Rate per project at which its flows are worth nothing, by halving [low, high] ``steps`` times.

    NULL where the value has the same sign at both ends. Flows are summed per period
    first, and the values of a grid point are sums, so no project meets in one row: each
    step is one aggregate over the periods, with one row per project in between.
    """
    flows = materialize(cash_flows(df, project, t, cf))
    at = lambda r: F.sum(F.col("cf") / F.pow(1 + r, F.col("t")))
    state = flows.groupBy("project").agg(at(F.lit(low)).alias("at_low"), at(F.lit(high)).alias("at_high"))
    state = state.select("project", "at_low", (F.signum("at_low") * F.signum("at_high") < 0).alias("found"))
    # several halvings per pass: the values at all their possible middles
    depth, width = 6, 1 << 6
    bounds = state.select("project", "at_low", "found", F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    for _ in range(-(-steps // depth)):
        grid = F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / width)
        points = flows.join(bounds.where("found").withColumn("grid", grid), "project").select(
            "project", "lo", "hi", "at_low", F.posexplode("grid").alias("k", "rate"), "t", "cf"
        )
        values = points.groupBy("project", "lo", "hi", "at_low", "k").agg(F.sum(F.col("cf") / F.pow(1 + F.col("rate"), F.col("t"))).alias("v"))
        # the last middle in a row from the low end that has the low end's sign
        same = F.signum("v") == F.signum("at_low")
        step = values.groupBy("project", "lo", "hi", "at_low").agg(F.coalesce(F.min(F.when(~same, F.col("k"))), F.lit(width - 1)).alias("k"))
        cell = (F.col("hi") - F.col("lo")) / width
        bounds = materialize(step.select(
            "project", "at_low", F.lit(True).alias("found"),
            (F.col("lo") + cell * F.col("k")).alias("lo"), (F.col("lo") + cell * (F.col("k") + 1)).alias("hi"),
        ))
    return state.select("project").join(bounds.select("project", ((F.col("lo") + F.col("hi")) / 2).alias("irr")), "project", "left")


def asset_returns(df: DataFrame, order_by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Relative change per column between ordered rows, missing prices carried forward."""
    slim = df.select(*dict.fromkeys([*order_by, *cols]))
    filled = carry_forward(with_index(slim, order_by), {f"_p_{c}": c for c in cols})
    change = lambda w: {
        f"_r_{c}": ratio(F.col(f"_p_{c}"), F.lag(f"_p_{c}").over(w)) - 1 for c in cols
    }
    out = preceding(filled, 1, change).select(*[F.col(f"_r_{c}").alias(c) for c in cols])
    return out.dropna(how="any")


def return_stats(
    df: DataFrame, order_by: Sequence[str], cols: Sequence[str], periods: int = TRADING_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Yearly mean return (asset, mu) and covariance (a, b, cov) of the assets."""
    cols = list(cols)
    rows = asset_returns(df, order_by, cols)
    pairs = list(combinations_with_replacement(cols, 2))
    means = [(F.avg(quoted(c)) * periods).alias(f"m{i}") for i, c in enumerate(cols)]
    covs = [(F.covar_samp(quoted(a), quoted(b)) * periods).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    wide = rows.agg(*means, *covs)
    mu = [F.struct(F.lit(c).alias("asset"), F.col(f"m{i}").alias("mu")) for i, c in enumerate(cols)]
    cov = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cov.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("cov")))
    return wide.select(F.inline(F.array(*mu))), wide.select(F.inline(F.array(*cov)))


def random_weights(spark, assets: int, sets: int = 3000, seed: int = 42) -> DataFrame:
    """Repeatable uniform draws from the simplex: (set_id, weights). A draw is the head of a digest."""
    digest = lambda i: F.md5(F.concat_ws("-", F.col("id").cast("string"), i.cast("string"), F.lit(str(seed))))
    unit = lambda i: (F.conv(F.substring(digest(i), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    draws = F.transform(F.sequence(F.lit(1), F.lit(assets)), lambda i: -F.log(unit(i)))
    total = F.aggregate("draws", F.lit(0.0), lambda a, x: a + x)
    raw = spark.range(sets).select(F.col("id").alias("set_id"), draws.alias("draws"))
    return raw.select("set_id", F.transform("draws", lambda x: x / total).alias("weights"))


def portfolio_search(mu: DataFrame, cov: DataFrame, assets: Sequence[str], weights: DataFrame) -> DataFrame:
    """Return, volatility and Sharpe ratio of each weight set (weights in ``assets`` order).

    ``mu`` and ``cov`` hold one number per asset and per pair; they reach the rows as
    scalar subqueries, so nothing is joined or shuffled.
    """
    def lookup(table: DataFrame, cond: Column, value: str):
        return F.max(F.when(cond, F.col(value)))

    means = mu.agg(F.array(*[lookup(mu, F.col("asset") == a, "mu") for a in assets])).scalar()
    matrix = cov.agg(
        F.array(*[
            F.array(*[lookup(cov, (F.col("a") == a) & (F.col("b") == b), "cov") for b in assets])
            for a in assets
        ])
    ).scalar()
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    risk = dot("weights", F.transform("_cov", lambda line: dot("weights", line)))
    out = (
        weights.withColumns({"_mu": means, "_cov": matrix})
        .withColumns({"ret": dot("weights", "_mu"), "vol": F.sqrt(risk)})
        .drop("_mu", "_cov")
    )
    return out.withColumn("sharpe", ratio("ret", "vol"))


def best_portfolios(portfolios: DataFrame) -> DataFrame:
    """The sets of the highest Sharpe ratio and of the lowest volatility."""
    pick = lambda label, f: portfolios.agg(f.alias("set_id")).select(F.lit(label).alias("pick"), "set_id")
    return pick("max_sharpe", F.max_by("set_id", "sharpe")).unionAll(
        pick("min_volatility", F.min_by("set_id", "vol"))
    )


def ticker_summary(df: DataFrame, ticker: str, ts: str, close: str, weeks: int = 52) -> DataFrame:
    """Last close, and highest and lowest close of the last 52 weeks of each ticker."""
    rows = df.where(quoted(close).isNotNull()).select(
        quoted(ticker).alias("ticker"), quoted(ts).alias("ts"), quoted(close).alias("close")
    )
    ends = rows.groupBy("ticker").agg(F.max("ts").alias("end"))
    recent = rows.join(ends, "ticker").where(
        F.col("ts") > F.col("end") - F.expr(f"INTERVAL {weeks * 7} DAYS")
    )
    return recent.groupBy("ticker").agg(
        F.max_by("close", "ts").alias("last_close"),
        F.max("close").alias("high_52w"),
        F.min("close").alias("low_52w"),
    )
