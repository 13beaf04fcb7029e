"""Chart datasets: indicators, groupings, histograms, price bars, maps.

Every function aggregates all rows; only the result is cut to what a chart shows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.lexicon import (
    BINARY_TARGET_WORDS,
    KPI_WORDS,
    MEASURE_TARGET_WORDS,
    MONEY_FORMAT_WORDS,
    PERCENT_FORMAT_WORDS,
)
from quarrylens.functions.moments import ratio
from quarrylens.operators.cleaning import map_country
from quarrylens.operators.ordering import preceding, with_index
from quarrylens.operators.profiling import Profile
from quarrylens.operators.quantiles import quantile_columns
from quarrylens.session import materialize, quoted

LABELS = {"mean": "Avg", "sum": "Total", "rate": "Rate %"}


# --- indicators --------------------------------------------------------------------------


def rule_value(col: str, rule: str) -> Column:
    """Aggregate of ``col`` by its semantic rule; ``rate`` is a percentage with 1 decimal."""
    x = quoted(col).cast("double")
    if rule == "mean":
        return F.avg(x)
    return F.round(F.avg(x) * 100, 1) if rule == "rate" else F.sum(x)


def kpi(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """One row per indicator: column, label, value. All indicators come from one pass."""
    row = df.agg(*[rule_value(c, r).alias(f"v{i}") for i, (c, r) in enumerate(rules.items())])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(LABELS[r]).alias("label"), F.col(f"v{i}").alias("value"))
        for i, (c, r) in enumerate(rules.items())
    ]
    return row.select(F.inline(F.array(*cells)))


def word_rank(name: str, groups: Sequence[Sequence[str]]) -> int:
    """Number of the first group with a word in the name; the number of groups if none has."""
    return min([i for i, words in enumerate(groups) if any(w in name.lower() for w in words)], default=len(groups))


def kpi_columns(profile: Profile, n: int = 5) -> list[str]:
    """Indicators of a table: its best binary column, then the best four of its first six measures."""
    shown = {"binary": profile.role("binary"), "measure": profile.role("measure")[:6]}
    order = sorted((role != "binary", word_rank(c, KPI_WORDS), i, c) for role, names in shown.items() for i, c in enumerate(names))
    binary, measures = [x[-1] for x in order if not x[0]], [x[-1] for x in order if x[0]]
    return [*binary[:1], *measures[:4]][:n]


def find_target(profile: Profile) -> tuple[str | None, bool]:
    """The column a table is about, and whether it is binary: named so, or else the first measure."""
    wanted = {"binary": [BINARY_TARGET_WORDS], "measure": [MEASURE_TARGET_WORDS, [""]]}
    order = [
        (role != "binary", word_rank(c, groups), i, c)
        for role, groups in wanted.items() for i, c in enumerate(profile.role(role)) if word_rank(c, groups) < len(groups)
    ]
    return (min(order)[-1], not min(order)[0]) if order else (None, False)


def kpi_trend(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], share: float = 0.1, limit: float = 200.0
) -> DataFrame:
    """Mean of the last ``share`` of the rows against the first, as a percent change."""
    slim = df.select(*dict.fromkeys([*order_by, *cols]))
    rows = slim.count()
    part = max(int(rows * share), 1)
    indexed = with_index(slim, order_by)
    early, late = F.col("idx") < part, F.col("idx") >= rows - part
    means = []
    for i, c in enumerate(cols):
        means += [F.avg(F.when(early, quoted(c))).alias(f"a{i}"), F.avg(F.when(late, quoted(c))).alias(f"b{i}")]
    wide = indexed.where(early | late).agg(*means)
    cells = []
    for i, c in enumerate(cols):
        first, last = F.col(f"a{i}"), F.col(f"b{i}")
        change = F.when(first != 0, (last - first) / F.abs(first) * 100)
        cells.append(
            F.struct(
                F.lit(c).alias("column"), first.alias("first_mean"), last.alias("last_mean"),
                F.coalesce(change, F.lit(0.0)).alias("trend_pct"),
                F.coalesce(F.abs(change) <= limit, F.lit(False)).alias("show_delta"),
            )
        )
    return wide.select(F.inline(F.array(*cells)))


def format_number_kpi(value: Column, name: str) -> Column:
    """Compact text: B/M/K from a thousand up, $ or % by column name below."""
    size, lowered = F.abs(value), name.lower()
    if any(w in lowered for w in MONEY_FORMAT_WORDS):
        small = F.concat(F.lit("$"), F.format_number(value, 2))
    elif any(w in lowered for w in PERCENT_FORMAT_WORDS):
        small = F.format_string("%.1f%%", value)
    else:
        small = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return (
        F.when(size >= 1e9, F.format_string("%.2fB", value / 1e9))
        .when(size >= 1e6, F.format_string("%.2fM", value / 1e6))
        .when(size >= 1e3, F.format_string("%.1fK", value / 1e3))
        .when(value.isNotNull(), small)
    )


def format_kpi(indicators: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``text`` to the output of :func:`kpi`."""
    text = F.lit(None).cast("string")
    for name in names:
        text = F.when(F.col("column") == name, format_number_kpi(F.col("value"), name)).otherwise(text)
    return indicators.withColumn("text", text)


# --- counts ------------------------------------------------------------------------------


def value_counts_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) of several columns in one job."""
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_values(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    """Most frequent value of each column (of the first ``n`` if given), ties to the smaller value."""
    best = F.min_by(F.struct("value", "count"), F.struct(-F.col("count"), F.col("value")))
    rows = value_counts_of(df, list(cols)[:n]).groupBy("column").agg(best.alias("b"))
    return rows.select("column", F.col("b.value").alias("value"), F.col("b.count").alias("count"))


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def value_counts(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    c = quoted(col)
    return (
        df.where(c.isNotNull())
        .groupBy(c.alias(col))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), quoted(col))
        .limit(n)
    )


def month_label(ts: str) -> Column:
    return F.date_format(quoted(ts), "yyyy-MM")


def monthly_counts(df: DataFrame, ts: str, last: int = 24) -> DataFrame:
    return (
        df.where(quoted(ts).isNotNull())
        .groupBy(month_label(ts).alias("month"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("month"))
        .limit(last)
    )


def crosstab(df: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Counts of the first ``n`` x ``n`` labels in label order; absent pairs are 0."""
    both = df.where(quoted(a).isNotNull() & quoted(b).isNotNull())
    counted = both.groupBy(quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted)  # used three times; the table is read once
    columns = [r["b"] for r in counted.select("b").distinct().orderBy("b").limit(n).collect()]
    rows = counted.select("a").distinct().orderBy("a").limit(n)
    return (
        counted.join(rows, "a", "left_semi")
        .groupBy(F.col("a").alias(a))
        .pivot("b", columns)
        .agg(F.sum("n"))
        .na.fill(0, [str(c) for c in columns])
    )


# --- target by time and dimension --------------------------------------------------------


def target_over_time(df: DataFrame, t: str, target: str, rule: str) -> DataFrame:
    return (
        df.where(quoted(t).isNotNull())
        .groupBy(quoted(t).alias(t))
        .agg(rule_value(target, rule).alias(target))
        .orderBy(quoted(t))
    )


def target_by(df: DataFrame, dim: str, target: str, rule: str, n: int = 15) -> DataFrame:
    """Target per dimension value by the target's rule, largest first."""
    value = rule_value(target, rule)
    grouped = df.where(quoted(dim).isNotNull()).groupBy(quoted(dim).alias(dim))
    return (
        grouped.agg((value if rule == "rate" else F.round(value, 2)).alias(target))
        .orderBy(F.desc(target), quoted(dim))
        .limit(n)
        .select(quoted(dim).cast("string").alias(dim), quoted(target))
    )


def treemap(df: DataFrame, dim: str, col: str, n: int = 20) -> DataFrame:
    return (
        df.where(quoted(dim).isNotNull() & quoted(col).isNotNull())
        .groupBy(quoted(dim).alias(dim))
        .agg(F.sum(quoted(col).cast("double")).alias(col))
        .orderBy(F.desc(col), quoted(dim))
        .limit(n)
        .select(quoted(dim).cast("string").alias(dim), quoted(col))
    )


def default_chart(df: DataFrame, profile: Profile, n: int = 15) -> DataFrame:
    """First measure summed by the first entity or dimension."""
    groups, measures = profile.role("entity", "dimension"), profile.role("measure")
    if not groups or not measures:
        raise ValueError("needs a measure and an entity or dimension")
    return target_by(df, groups[0], measures[0], "sum", n)


def waterfall(df: DataFrame, t: str, col: str, last: int = 12) -> DataFrame:
    """Change of the total between the last time points; the first shows its own total."""
    points = (
        df.where(quoted(t).isNotNull())
        .groupBy(quoted(t).alias(t))
        .agg(F.sum(quoted(col).cast("double")).alias("total"))
        .orderBy(F.desc(t))
        .limit(last)
    )
    previous = F.lag("total").over(Window.orderBy(quoted(t)))  # at most ``last`` rows
    return points.withColumn("delta", F.coalesce(F.col("total") - previous, F.col("total")))


# --- distributions and relations ---------------------------------------------------------


def scatter_ols(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Fitted line per colour group over all rows."""
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull())
    groups = [quoted(color).alias(color)] if color else []
    if color:
        both = both.where(quoted(color).isNotNull())
    return both.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
    )


def scatter_points(df: DataFrame, cols: Sequence[str], key: Sequence[str], n: int = 1000) -> DataFrame:
    """A repeatable sample of ``n`` complete rows: those with the least digests of the key."""
    complete = df.dropna(subset=list(cols))
    digest = F.md5(F.concat_ws("|", *[quoted(k).cast("string") for k in key]))
    return complete.orderBy(digest, *[quoted(k) for k in key]).limit(n).select(*[quoted(c) for c in cols])


def corr_matrix(df: DataFrame, cols: Sequence[str], max_columns: int | None = None) -> DataFrame:
    """Pairwise Pearson correlation as (x, y, r), both triangles and the diagonal; all columns unless limited."""
    cols = list(cols)[:max_columns]
    xs = {c: quoted(c).cast("double") for c in cols}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.corr(xs[cols[i]], xs[cols[j]]).alias(f"r{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        for a, b in {(i, j), (j, i)}:
            cells.append(
                F.struct(F.lit(cols[a]).alias("x"), F.lit(cols[b]).alias("y"), F.col(f"r{i}_{j}").alias("r"))
            )
    return row.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 25) -> DataFrame:
    """Equal-width bins (column, bin, low, high, count); the last bin is closed; empty bins are absent."""
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("x")) for c in cols]
    bounds = [F.struct(F.min(quoted(c).cast("double")).alias("lo"), F.max(quoted(c).cast("double")).alias("hi")) for c in cols]
    edges = df.agg(*[b.alias(f"e{i}") for i, b in enumerate(bounds)]).first()
    low, width = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, c in enumerate(cols):
        lo, hi = edges[f"e{i}"]["lo"], edges[f"e{i}"]["hi"]
        if lo is not None:
            low = F.when(F.col("column") == c, F.lit(lo)).otherwise(low)
            width = F.when(F.col("column") == c, F.lit((hi - lo) / bins)).otherwise(width)
    long = df.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull())
    number = F.when(width > 0, F.least(F.floor((F.col("x") - low) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    counted = long.groupBy("column", number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "column", "bin", (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"), "count",
    )


def box(df: DataFrame, group: str, col: str) -> DataFrame:
    """Exact five-number summary per group."""
    kept = df.where(quoted(group).isNotNull() & quoted(col).isNotNull())
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantile_columns(kept.select(quoted(group), quoted(col)), col, probs, [group])


# --- prices ------------------------------------------------------------------------------


def price_columns(df: DataFrame) -> dict[str, str] | None:
    """open, high, low, close columns by name, when at least three are there."""
    found = {c.lower(): c for c in df.columns if c.lower() in ("open", "high", "low", "close")}
    return found if len(found) >= 3 else None


def ohlc_weekly(
    df: DataFrame, ts: str, o: str, h: str, l: str, c: str, tie: Sequence[str] = (), last: int = 200  # noqa: E741
) -> DataFrame:
    """Weekly bars labelled by their Sunday: first, highest, lowest and last price."""
    when = F.struct(quoted(ts), *[quoted(k) for k in tie])
    week = F.date_add(F.date_trunc("week", quoted(ts)).cast("date"), 6).cast("timestamp_ntz")
    kept = df.dropna(subset=[ts, o, h, l, c])
    return (
        kept.groupBy(week.alias(ts))
        .agg(
            F.min_by(quoted(o), when).alias("open"), F.max(quoted(h)).alias("high"),
            F.min(quoted(l)).alias("low"), F.max_by(quoted(c), when).alias("close"),
        )
        .orderBy(F.desc(ts))
        .limit(last)
    )


def moving_avg(
    df: DataFrame, order_by: Sequence[str], col: str, windows: Sequence[int] = (50, 200),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Trailing means over the last n rows (fewer at the start), as ``ma<n>``."""
    indexed = with_index(df.where(quoted(col).isNotNull()), order_by, partition_by)
    means = lambda w: {
        f"ma{n}": F.avg(quoted(col)).over(w.rowsBetween(-(n - 1), 0)) for n in windows
    }
    return preceding(indexed, max(windows) - 1, means, partition_by).drop("idx")


def monthly_sum(df: DataFrame, ts: str, col: str) -> DataFrame:
    """Total per calendar month, labelled by the month's last day."""
    return (
        df.where(quoted(ts).isNotNull() & quoted(col).isNotNull())
        .groupBy(F.last_day(quoted(ts)).cast("timestamp_ntz").alias("month_end"))
        .agg(F.sum(quoted(col)).alias(col))
    )


def returns(
    df: DataFrame, order_by: Sequence[str], col: str, cap: float = 20.0, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Percent change from row to row within +-``cap``; the row order is explicit."""
    slim = df.where(quoted(col).isNotNull()).select(*dict.fromkeys([*partition_by, *order_by, col]))
    indexed = with_index(slim, order_by, partition_by)
    change = lambda w: {"return_pct": (ratio(quoted(col), F.lag(quoted(col)).over(w)) - 1) * 100}
    changed = preceding(indexed, 1, change, partition_by).drop("idx")
    return changed.where(F.col("return_pct").between(-cap, cap))


# --- maps --------------------------------------------------------------------------------


def country_column(df: DataFrame, columns: Sequence[str], share: float = 1 / 6) -> str | None:
    """First text column of whose values more than ``share`` are countries; all rows, one pass."""
    columns = list(columns)
    if not columns:
        return None
    cells = [F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
    found = map_country(values, "v").groupBy("i").agg(F.count("iso3").alias("hits"), F.count(F.lit(1)).alias("n"))
    best = found.where(F.col("hits") > share * F.col("n")).agg(F.min("i")).first()[0]
    return None if best is None else columns[best]


def by_country(df: DataFrame, country: str, col: str) -> DataFrame:
    """Sum per ISO3 code; unknown countries are left out."""
    return (
        map_country(df, country, "iso3")
        .where(F.col("iso3").isNotNull())
        .groupBy("iso3")
        .agg(F.sum(quoted(col)).alias(col))
    )


def coordinate_columns(df: DataFrame) -> tuple[str, str] | None:
    """Latitude and longitude columns by name."""
    lat = next((c for c in df.columns if "lat" in c.lower()), None)
    lon = next((c for c in df.columns if "lon" in c.lower()), None)
    return (lat, lon) if lat and lon else None


def geo_points(df: DataFrame, lat: str, lon: str, key: Sequence[str], n: int = 2000) -> DataFrame:
    """The first ``n`` rows, in key order, that have both coordinates."""
    return df.dropna(subset=[lat, lon]).orderBy(*key).limit(n)


def geo_grid(df: DataFrame, lat: str, lon: str, step: float = 1.0) -> DataFrame:
    """Point counts per grid cell over all rows."""
    cell = lambda c: (F.floor(quoted(c) / step) * step).cast("double")
    return (
        df.dropna(subset=[lat, lon])
        .groupBy(cell(lat).alias(lat), cell(lon).alias(lon))
        .agg(F.count(F.lit(1)).alias("count"))
    )


# --- chart from a specification ----------------------------------------------------------

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}


def chart(df: DataFrame, spec: Mapping, key: Sequence[str] = ()) -> DataFrame:
    """Dataset of a chart given as {x, y, color, agg, top_n, type}.

    Groups and ranks when ``agg`` is known and ``y`` is numeric, else the first rows
    in ``key`` order. ``histogram`` bins x, ``box`` summarises y per x.
    """
    x, y, kind, top = spec["x"], spec.get("y"), spec.get("type", "bar"), spec.get("top_n", 15)
    if kind == "histogram":
        return histogram(df, [x], 30)
    if kind == "box":
        return box(df, x, y)
    if kind == "scatter":
        names = [c for c in (x, y, spec.get("color")) if c]
        order = list(key) or [quoted(c) for c in dict.fromkeys(names)]
        return df.orderBy(*order).select(*[quoted(c) for c in dict.fromkeys(names)]).limit(spec.get("top_n", 500))
    how = AGGREGATES.get(spec.get("agg", "sum"))
    if how is not None and dict(df.dtypes)[y] not in ("string", "date", "timestamp", "timestamp_ntz", "boolean"):
        out = (
            df.where(quoted(x).isNotNull())
            .groupBy(quoted(x).alias(x))
            .agg(how(quoted(y)).alias(y))
            .orderBy(F.desc(y), quoted(x))
        )
        return out.limit(top) if top else out
    names = [c for c in (x, y, spec.get("color")) if c]
    return df.orderBy(*(key or names)).select(*[quoted(c) for c in dict.fromkeys(names)]).limit(top)
