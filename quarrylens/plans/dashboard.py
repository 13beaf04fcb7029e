"""The full dashboard of a table: which charts to compute, from its semantic profile."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from quarrylens.operators import charts
from quarrylens.operators.profiling import Profile, semantic_profile
from quarrylens.session import string_columns


class Charts(Mapping):
    """Chart datasets by name; one that needs a job of its own to be planned runs it when it is first asked for."""

    def __init__(self):
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def add(self, name: str, make: Callable[..., DataFrame], *args, **options) -> None:
        self._makers[name] = lambda: make(*args, **options)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def dashboard(
    df: DataFrame,
    order_by: Sequence[str],
    profile: Profile | None = None,
    max_histograms: int | None = None,
    max_counts: int | None = None,
) -> Charts:
    """Name -> chart dataset. ``max_histograms`` and ``max_counts`` limit the columns charted one by one.

    ``order_by`` is the row order that trend and price charts refer to. Each chart reads
    only the columns it needs; store ``df`` before the call when it is expensive to derive.
    Building the plan reads the profile and, for text columns, the share of country names.
    """
    profile = profile if profile is not None else semantic_profile(df)
    out = Charts()
    out.add("records", charts.record_count, df)
    measures, binaries = profile.role("measure"), profile.role("binary")
    dimensions = profile.role("dimension")
    times = profile.role("year_col") + profile.role("temporal")
    groups = profile.role("entity") + dimensions
    if not measures:
        _count_charts(out, df, groups[:max_counts], times)
        return out

    kpis = charts.kpi_columns(profile)
    rules = {c: "rate" if c in binaries else profile.rule(c) for c in kpis}
    out.add("kpi", lambda: charts.format_kpi(charts.kpi(df, rules), kpis))
    out.add("kpi_trend", charts.kpi_trend, df, kpis, order_by)
    target, binary = charts.find_target(profile)
    rule = "rate" if binary else profile.rule(target)
    prices = charts.price_columns(df)
    if prices and times and len(prices) == 4:
        bars = [prices[k] for k in ("open", "high", "low", "close")]
        out.add("ohlc", charts.ohlc_weekly, df, times[0], *bars, tie=order_by)
        out.add("moving_avg", charts.moving_avg, df, order_by, prices["close"])
        out.add("returns", charts.returns, df, order_by, prices["close"])
        volume = next((c for c in df.columns if c.lower() == "volume"), None)
        if volume:
            out.add("volume", charts.monthly_sum, df, times[0], volume)
    elif times:
        out.add("target_over_time", charts.target_over_time, df, times[0], target, rule)
    if groups:
        out.add("target_by", charts.target_by, df, groups[0], target, rule)
        out.add("donut", charts.value_counts, df, groups[0], 8)
        out.add("treemap", charts.treemap, df, groups[0], measures[0])
    if len(groups) > 1:
        out.add("target_by_second", charts.target_by, df, groups[1], target, rule)
    others = [m for m in measures if m != target]
    if others and (not binary or len(others) > 1):
        x, y = (others[0], others[1]) if binary else (target, others[0])
        out.add("scatter_line", charts.scatter_ols, df, x, y, groups[0] if groups else None)
    if len(measures) >= 3:
        out.add("correlation", charts.corr_matrix, df, measures)
    if profile.role("temporal"):
        out.add("waterfall", charts.waterfall, df, profile.role("temporal")[0], measures[0])
    country = charts.country_column(df, string_columns(df))
    if country:
        out.add("by_country", charts.by_country, df, country, measures[0])
    place = charts.coordinate_columns(df)
    if place:
        out.add("geo_points", charts.geo_points, df, *place, key=order_by)
    out.add("histograms", charts.histogram, df, measures[:max_histograms])
    return out


def _count_charts(out: Charts, df: DataFrame, groups: list[str], times: list[str]) -> None:
    """Tables without a measure are charted by counts."""
    if groups:
        out.add("top_values", charts.top_values, df, groups)
        out.add("donut", charts.value_counts, df, groups[0], 8)
    for c in groups:
        out.add(f"counts_{c}", charts.value_counts, df, c)
    if times:
        out.add("monthly_counts", charts.monthly_counts, df, times[0])
    if len(groups) > 1:
        out.add("crosstab", charts.crosstab, df, groups[0], groups[1])
