"""Column statistics, roles, quality, insights and trust of a table.

One wide aggregate reads the table once; everything else works on its result,
one row per column, which is metadata.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.lexicon import (
    DATE_WORDS,
    ID_WORDS,
    MEAN_WORDS,
    SUGGESTION_WORDS,
    SUM_WORDS,
    YEAR_WORDS,
    has_word,
)
from quarrylens.functions.moments import adjusted_kurtosis, adjusted_skewness, ratio
from quarrylens.operators.cleaning import parsed_timestamp, robust_scales
from quarrylens.operators.quantiles import exact_quantiles, medians
from quarrylens.session import is_datetime, is_numeric, materialize, quoted

PHONE = r"^\+?[0-9][0-9 ()./-]{6,}$"


def kind_of(field: T.StructField) -> str:
    if is_numeric(field) or isinstance(field.dataType, T.BooleanType):
        return "numeric"
    if is_datetime(field):
        return "datetime"
    return "string" if isinstance(field.dataType, T.StringType) else "other"


# --- rules over one row per column ---------------------------------------------------------

Rules = Sequence[tuple[str, Column]]


def key() -> Column:
    return F.lower(F.replace(F.col("column"), F.lit(" "), F.lit("_")))


def named(words: Sequence[str]) -> Column:
    """Does the column's name hold one of the words?"""
    return key().rlike("|".join(re.escape(w) for w in words))


def year_named() -> Column:
    """Is one of the words the name, or its first or last part between underscores?"""
    words = "|".join(re.escape(w) for w in YEAR_WORDS)
    return key().rlike(f"^({words})(_|$)|(^|_)({words})$")


def first_rule(rules: Rules, otherwise: str) -> Column:
    """Label of the first rule that holds; a rule about missing statistics does not."""
    out = F.lit(otherwise)
    for label, holds in reversed(rules):
        out = F.when(holds, label).otherwise(out)
    return out


def aggregation() -> Column:
    """Aggregation of a numeric column: its name decides, then its range."""
    c = F.col
    return first_rule(
        [
            ("year", year_named() & (c("year_share") > 0.9)),
            ("mean", named(MEAN_WORDS)),
            ("sum", named(SUM_WORDS)),
            ("mean", (c("min") >= 0) & (c("max") <= 100) & (F.abs("mean") < 50)),
            ("year", (c("min") >= 1900) & (c("max") <= 2100) & (c("std") < 20)),
        ],
        "sum",
    )


def semantic_role() -> Column:
    """What a column means, by type, name and number of values."""
    c = F.col
    number, distinct, rows = c("kind") == "numeric", c("nunique"), c("n_rows")
    many = (distinct > 50) & (distinct > 0.8 * rows)
    return first_rule(
        [
            ("temporal", c("kind") == "datetime"),
            ("temporal", (c("kind") == "string") & named(DATE_WORDS) & (c("date_share") > 0.7)),
            ("id", number & named(ID_WORDS) & ((distinct == rows) | (distinct > 0.95 * rows))),
            ("binary", number & (distinct <= 2)),
            ("year_col", number & (aggregation() == "year")),
            ("measure", number),
            ("id", many & named(ID_WORDS)),
            ("entity", many & (c("upper_share") > 0.5)),
            ("text", many),
            ("dimension", distinct <= 30),
        ],
        "text",
    )


def _number(field: T.StructField):
    c = quoted(field.name)
    return c.cast("int").cast("double") if isinstance(field.dataType, T.BooleanType) else c.cast("double")


def _melt_stats(
    df: DataFrame, fields: list[T.StructField], approx_distinct: bool, shape: bool, text: bool
) -> DataFrame:
    """One row per column position, from one pass with a partial aggregate per task.

    Columns are turned into rows first: a few aggregates over a long table compile
    to one tight loop, several per column over a wide one do not.
    """
    cells = []
    for i, f in enumerate(fields):
        c, kind = quoted(f.name), kind_of(f)
        cell = {
            "position": F.lit(i),
            "present": c.isNotNull(),
            "x": _number(f) if kind == "numeric" else F.lit(None).cast("double"),
            "d": c.cast("timestamp_ntz") if kind == "datetime" else F.lit(None).cast("timestamp_ntz"),
            "s": c if kind == "string" else F.lit(None).cast("string"),
        }
        if approx_distinct:
            cell["h"] = F.when(c.isNotNull(), F.xxhash64(c))
        cells.append(F.struct(*[e.alias(k) for k, e in cell.items()]))
    x, s = F.col("x"), F.col("s")
    aggs = {
        "n_rows": F.count(F.lit(1)),
        "n": F.count_if("present"),
        "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.sqrt(F.var_samp(x)),
        "variance": F.var_samp(x), "sum": F.sum(x),
        "min_date": F.min("d"), "max_date": F.max("d"),
    }
    if shape:
        aggs |= {"skewness": adjusted_skewness(x), "kurtosis": adjusted_kurtosis(x)}
    aggs["year_share"] = F.avg(x.between(1800, 2100).cast("int"))
    if text and any(kind_of(f) == "string" for f in fields):
        aggs["date_share"] = F.count_if(parsed_timestamp(s).isNotNull()) / F.count(F.lit(1))
        aggs["upper_share"] = F.avg(F.when(s != "", s.rlike(r"^\p{Lu}").cast("int")))
        aggs["phone_share"] = F.avg(F.trim(s).rlike(PHONE).cast("int"))
    if approx_distinct:
        aggs["nunique"] = F.approx_count_distinct("h")
    melted = df.select(F.inline(F.array(*cells)))
    return melted.groupBy("position").agg(*[e.alias(k) for k, e in aggs.items()])


LONG_TEXT = 64


def short_form(c):
    """A text, or the digest of a long one: equal exactly when the texts are, and short to shuffle."""
    return F.when(F.octet_length(c) > LONG_TEXT, F.concat(F.lit("\0sha256:"), F.sha2(c.cast("binary"), 256))).otherwise(c)


def distinct_counts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Exact distinct counts of all columns, from values deduplicated before the shuffle.

    Columns of one storage type form one narrow (position, value) table, so each group
    key is two fields wide and every column is still read once.
    """
    families: dict[str, list] = {}
    for i, f in enumerate(fields):
        c = quoted(f.name)
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            family, value = "bigint", c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            family, value = "double", c.cast("double")
        elif is_datetime(f):
            family, value = "timestamp_ntz", c.cast("timestamp_ntz")
        else:
            family, value = "string", short_form(c.cast("string"))
        families.setdefault(family, []).append(F.struct(F.lit(i).alias("position"), value.alias("v")))
    parts = []
    for cells in families.values():
        values = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()).distinct()
        parts.append(values.groupBy("position").agg(F.count(F.lit(1)).alias("nunique")))
    return reduce(lambda a, b: a.unionAll(b), parts)


STAT_FIELDS = (
    "n_rows bigint, n bigint, nunique bigint, min double, max double, mean double, std double, "
    "variance double, sum double, skewness double, kurtosis double, min_date string, "
    "max_date string, year_share double, date_share double, upper_share double, phone_share double"
)


def column_stats(
    df: DataFrame,
    distinct: str | None = "exact",
    shape: bool = False,
    text: bool = False,
) -> DataFrame:
    """One row per column with the statistics the profile layers need.

    ``distinct`` is "exact", "approx" (a sketch, which leaves nothing to shuffle but
    one row per column and task) or None; ``shape`` adds skewness and kurtosis;
    ``text`` adds the shares of date-like, phone-like and capitalised strings.
    """
    fields = df.schema.fields
    meta = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), kind_of(f)) for i, f in enumerate(fields)],
        "column string, position int, dtype string, kind string",
    )
    stats = _melt_stats(df, fields, distinct == "approx", shape, text)
    if distinct == "exact":
        stats = stats.join(F.broadcast(distinct_counts(df, fields)), "position", "left")
    joined = meta.join(F.broadcast(stats), "position", "left")  # one row per column
    out = []
    for spec in T.StructType.fromDDL(STAT_FIELDS).fields:
        value = F.col(spec.name) if spec.name in stats.columns else F.lit(None)
        if spec.name in ("n_rows", "n", "nunique"):
            value = F.coalesce(value, F.lit(0))
        elif spec.name in ("min_date", "max_date"):
            label = value.cast("string")
            value = F.when(F.col("dtype") == "date", F.substring(label, 1, 10)).otherwise(label)
        out.append(value.cast(spec.dataType).alias(spec.name))
    return joined.select("column", "position", "dtype", "kind", *out)


def table_stats(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """All statistics, computed once and stored, to share among the functions below as ``stats``."""
    how = "exact" if exact_distinct else "approx"
    return materialize(column_stats(df, how, shape=True, text=True))


def _stats(df: DataFrame, given: DataFrame | None, exact_distinct: bool, shape=False, text=False) -> DataFrame:
    if given is not None:
        return given
    return column_stats(df, "exact" if exact_distinct else "approx", shape, text)


def stat_rows(stats: DataFrame) -> list[Row]:
    """The statistics on the driver: one small row per column."""
    return stats.orderBy("position").collect()


def _local(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


# --- physical schema, relational roles, quality ------------------------------------------


def detect_schema(df: DataFrame, max_values: int = 20, stats: DataFrame | None = None) -> DataFrame:
    """Physical type per column with its describing values."""
    stats = stat_rows(_stats(df, stats, True))
    middle = medians(df, [s["column"] for s in stats if s["kind"] == "numeric"])
    listed = [s["column"] for s in stats if s["kind"] == "string" and s["nunique"] < max_values]
    values = {}
    if listed:  # at most max_values - 1 values each, known from the statistics
        row = df.agg(*[F.sort_array(F.collect_set(quoted(c))).alias(f"v{i}") for i, c in enumerate(listed)]).first()
        values = {c: row[f"v{i}"] for i, c in enumerate(listed)}
    out = []
    for s in stats:
        name = s["column"]
        if s["kind"] == "numeric":
            kind = "numeric"
        elif s["kind"] == "datetime":
            kind = "datetime"
        else:
            kind = "categorical" if s["nunique"] < max_values else "text"
        out.append(
            (
                name, s["position"], kind, s["mean"], middle.get(name), s["std"], s["min_date"],
                s["max_date"], values.get(name), s["nunique"] if kind == "text" else None,
            )
        )
    return _local(
        df, out,
        "column string, position int, type string, mean double, median double, std double, "
        "min_date string, max_date string, unique_values array<string>, unique_count bigint",
    )


def detect_roles(df: DataFrame, exact_distinct: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """Relational role per column, by uniqueness, tested in a fixed order."""
    share = F.col("nunique") / F.col("n_rows")
    role = (
        F.when((F.col("nunique") == F.col("n_rows")) & (F.col("n") == F.col("n_rows")), "Primary Key")
        .when((share > 0.1) & (share < 0.95), "Potential Foreign Key")
        .when((F.col("kind") == "numeric") & (F.col("std") > 0), "Numeric Feature / Possible Target")
        .when(F.col("nunique") < 20, "Categorical Feature")
        .otherwise("Text / Identifier")
    )
    return _stats(df, stats, exact_distinct).select("column", role.alias("role"))


def quality(
    df: DataFrame, exact_distinct: bool = True, digits: int | None = 4, stats: DataFrame | None = None
) -> DataFrame:
    """Missing and unique shares, adjusted skewness and variance."""
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return _stats(df, stats, exact_distinct, shape=True).select(
        "column",
        shown(1 - ratio("n", "n_rows")).alias("missing_ratio"),
        shown(ratio("nunique", "n_rows")).alias("unique_ratio"),
        shown(F.col("skewness")).alias("skewness"),
        shown(F.col("variance")).alias("variance"),
    )


def feature_ranking(df: DataFrame, exact_distinct: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """Numeric columns by variance times unique share, descending."""
    score = F.col("variance") * F.col("nunique") / F.col("n_rows")
    return (
        _stats(df, stats, exact_distinct)
        .where((F.col("kind") == "numeric") & F.col("variance").isNotNull())
        .select("column", score.alias("score"))
        .orderBy(F.desc("score"), "column")
    )


# --- semantic schema ---------------------------------------------------------------------


class Profile(list):
    """Semantic schema on the driver: one dict per column, in column order."""

    def role(self, *roles: str) -> list[str]:
        return [p["column"] for p in self if p["role"] in roles]

    def rule(self, column: str) -> str:
        return next(p["agg"] for p in self if p["column"] == column)

    def get(self, column: str) -> dict:
        return next(p for p in self if p["column"] == column)


def semantic_profile(df: DataFrame, exact_distinct: bool = True, stats: DataFrame | None = None) -> Profile:
    """Role and aggregation rule of every column, with its statistics."""
    judged = _stats(df, stats, exact_distinct, text=True).withColumn("role", semantic_role())
    rule = F.when(F.col("role") == "measure", aggregation()).when(F.col("role") == "year_col", "mean").otherwise("sum")
    return Profile(s.asDict() for s in stat_rows(judged.withColumn("agg", rule)))


FINGERPRINT_FIELDS = (
    "column string, position int, role string, agg string, dtype string, nunique bigint, n bigint, "
    "sample array<string>, min double, max double, mean double, std double, sum double"
)


def fingerprint(df: DataFrame, sample_size: int = 5, exact_distinct: bool = True) -> DataFrame:
    """The semantic schema as a DataFrame; ``sample`` holds the smallest few values as text, a long one by its first LONG_TEXT characters."""
    samples: dict[str, list[str]] = {}
    profile = semantic_profile(df, exact_distinct)
    if sample_size:
        cells = [
            F.struct(F.lit(p["position"]).alias("i"), F.left(quoted(p["column"]).cast("string"), F.lit(LONG_TEXT)).alias("v")) for p in profile
        ]
        values = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
        # short texts, deduplicated in every task before they are shuffled; then a top-k per column
        found = values.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("v")))
        for r in found.where(F.col("rank") <= sample_size).orderBy("i", "rank").collect():
            samples.setdefault(profile[r["i"]]["column"], []).append(r["v"])
    return _local(
        df,
        [
            (
                p["column"], p["position"], p["role"], p["agg"], p["dtype"], p["nunique"], p["n"],
                samples.get(p["column"]), p["min"], p["max"], p["mean"], p["std"], p["sum"],
            )
            for p in profile
        ],
        FINGERPRINT_FIELDS,
    )


def aggregation_rules(df: DataFrame) -> DataFrame:
    """Aggregation rule (year, mean, sum) of every numeric column."""
    return _stats(df, None, True).where("kind = 'numeric'").select("column", aggregation().alias("agg"))


def quality_overview(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Rows, columns, count per role and the mean missing share in percent."""
    profile = profile if profile is not None else semantic_profile(df)
    rows = profile[0]["n_rows"] if profile else 0
    missing = [1 - p["n"] / rows for p in profile] if rows else []
    share = round(100 * sum(missing) / len(missing), 1) if missing else None
    count = lambda role: len(profile.role(role))
    return _local(
        df,
        [(rows, len(profile), count("measure"), count("dimension"), count("temporal"), count("entity"), share)],
        "rows bigint, cols bigint, measures bigint, dimensions bigint, temporals bigint, "
        "entities bigint, missing_pct double",
    )


def smart_stats(df: DataFrame, profile: Profile | None = None, max_columns: int | None = None) -> DataFrame:
    """Average, median and maximum, or total, average and maximum, by each measure's rule."""
    profile = profile if profile is not None else semantic_profile(df)
    measures = [m for m in profile.role("measure")[:max_columns] if profile.get(m)["n"]]
    middle = medians(df, [m for m in measures if profile.rule(m) == "mean"])
    rows = []
    for m in measures:
        p = profile.get(m)
        if p["agg"] == "mean":
            rows.append((m, "avg", p["mean"], middle[m], None, p["max"]))
        else:
            rows.append((m, "total", p["sum"], None, p["mean"], p["max"]))
    return _local(df, rows, "column string, metric string, value double, median double, avg double, max double")


#: Questions by the columns they name; a field with the format .0 is needed but not shown.
SUGGESTIONS = (
    "{top} {entity0} {by} {measure0}",
    "{top} {dimension0} {by} {measure0}",
    "{measure0} {trend} {temporal0}",
    "{measure0} {vs} {measure1}",
    "{corr}{measure2:.0}",
    "{dist} {measure0}",
    "{six} {measure0}",
    "{reg}: {measure1} ~ {measure0}",
    "{dash}",
)


def suggest(df: DataFrame, profile: Profile | None = None, lang: str = "en") -> DataFrame:
    """Up to eight questions the table can answer: the templates whose columns it has, in order."""
    profile = profile if profile is not None else semantic_profile(df)
    known = dict(SUGGESTION_WORDS.get(lang, SUGGESTION_WORDS["en"]))
    for role in ("measure", "dimension", "temporal", "entity"):
        known |= {f"{role}{i}": name for i, name in enumerate(profile.role(role))}
    fields = lambda t: {name for _, name, _, _ in Formatter().parse(t) if name}
    texts = [t.format(**known) for t in SUGGESTIONS if fields(t) <= known.keys()]
    return _local(df, list(enumerate(texts[:8], 1)), "rank int, suggestion string")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First rows in an explicit order (a top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


# --- semantic types, insights, structure, trust (rules inferred from published outputs) ---


def semantic_type(s: Mapping | Row) -> str:
    name = s["column"].strip().lower()
    if s["kind"] == "datetime":
        return "datetime"
    if s["kind"] != "numeric" and (has_word(name, ("date", "time")) or (s["date_share"] or 0) > 0.7):
        return "datetime"
    if name.endswith("id") or name.endswith("key"):
        return "identifier"
    if s["kind"] == "numeric":
        if any(w in name for w in ("price", "amount", "revenue")):
            return "monetary"
        if any(w in name for w in ("rate", "percent", "pct")):
            return "percentage"
        return "numeric_metric"
    if "phone" in name or ((s["phone_share"] or 0) > 0.7 and not has_word(name, ("address",))):
        return "phone"
    return "categorical_or_text"


def semantic_types(df: DataFrame, exact_distinct: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """identifier, datetime, monetary, percentage, phone, numeric_metric or categorical_or_text."""
    rows = [(s["column"], semantic_type(s)) for s in stat_rows(_stats(df, stats, exact_distinct, text=True))]
    return _local(df, rows, "column string, semantic_type string")


def insights(
    df: DataFrame, max_skew: float = 2.0, min_std: float = 2.0, exact_distinct: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Rule findings: duplicate identifiers, high skew, low variability, completeness."""
    stats, rows = stat_rows(_stats(df, stats, exact_distinct, shape=True, text=True)), []
    for s in stats:
        if semantic_type(s) == "identifier" and s["nunique"] < s["n_rows"]:
            rows.append((s["column"], "duplicate_identifier", s["nunique"] / s["n_rows"]))
        if s["skewness"] is not None and abs(s["skewness"]) > max_skew:
            rows.append((s["column"], "high_skew", s["skewness"]))
        if s["kind"] == "numeric" and s["std"] is not None and s["std"] < min_std:
            rows.append((s["column"], "low_variability", s["std"]))
    if not any(r[1] in ("duplicate_identifier", "high_skew") for r in rows):
        rows.append((None, "structurally_healthy", None))
    if all(s["n"] == s["n_rows"] for s in stats):
        rows.append((None, "no_missing_values", None))
    return _local(df, rows, "column string, insight string, value double")


def structure(
    df: DataFrame, low_information: float = 0.01, exact_distinct: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Split columns into identifiers, dimensions, metrics and derived metrics.

    A metric column carrying too little information takes no further part; the
    outcome is the metric with the largest variance, the drivers are the others.
    """
    rows = []
    for s in stat_rows(_stats(df, stats, exact_distinct, text=True)):
        kind = semantic_type(s)
        low = s["nunique"] / max(s["n_rows"], 1) < low_information
        if kind == "identifier":
            group = "identifier"
        elif s["kind"] != "numeric":
            group = "datetime" if kind == "datetime" else "dimension"
        elif kind == "percentage":
            group = "derived_metric"
        else:
            group = "low_information" if low else "metric"
        rows.append([s["column"], group, low, s["variance"]])
    metrics = [r for r in rows if r[1] == "metric" and r[3] is not None]
    outcome = max(metrics, key=lambda r: r[3])[0] if metrics else None
    return _local(
        df,
        [(c, g, low, c == outcome, g == "metric" and c != outcome) for c, g, low, _ in rows],
        "column string, structure string, low_information boolean, is_outcome boolean, is_driver boolean",
    )


def outlier_share(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> float:
    """Share of numeric values further than ``limit`` robust deviations from the median."""
    narrow = materialize(df.select(*[quoted(c) for c in cols]))
    scales = robust_scales(narrow, cols)
    if not scales:
        return 0.0
    far = [F.sum((F.abs(quoted(c) - center) > limit * scale).cast("long")) for c, (center, scale) in scales.items()]
    seen = [F.count(quoted(c)) for c in scales]
    row = narrow.agg(sum(far[1:], far[0]).alias("far"), sum(seen[1:], seen[0]).alias("seen")).first()
    return row["far"] / row["seen"] if row["seen"] else 0.0


def trust(
    df: DataFrame,
    references: Sequence[tuple[str, DataFrame, str]] = (),
    text_confidence: float = 1.0,
    exact_distinct: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Scores from 0 to 100 (own definition; only perfect scores are published).

    schema: share of typed columns; null: 100 less the mean missing share; outlier:
    100 less the share of values beyond 3 robust deviations; relationship: share of
    reference values found in their parent table; overall: the mean.
    """
    stats = stat_rows(_stats(df, stats, exact_distinct))
    rows = stats[0]["n_rows"] if stats else 0
    typed = [s for s in stats if s["kind"] in ("numeric", "datetime") or s["nunique"] < 20]
    schema_score = 100.0 * len(typed) / max(len(stats), 1)
    missing = sum(1 - s["n"] / rows for s in stats) / len(stats) if rows else 0.0
    numeric = [s["column"] for s in stats if s["kind"] == "numeric"]
    outliers = outlier_share(df, numeric) if numeric else 0.0
    found = []
    for child, parent, key in references:
        values = df.where(quoted(child).isNotNull()).select(quoted(child).alias("k"))
        keys = parent.select(quoted(key).alias("k")).distinct().withColumn("hit", F.lit(1))
        # pre-aggregated, so a hot reference value is one row in the join
        counted = values.groupBy("k").count().join(keys, "k", "left")
        found.append(counted.agg((F.sum(F.when(F.col("hit") == 1, F.col("count"))) / F.sum("count")).alias("s")).first()["s"] or 0.0)
    relation = 100.0 * sum(found) / len(found) if found else 100.0
    scores = [schema_score, 100.0 * (1 - missing), 100.0 * (1 - outliers), relation, 100.0 * text_confidence]
    return _local(
        df,
        [(*scores, sum(scores) / len(scores))],
        "schema_score double, null_score double, outlier_score double, relationship_score double, "
        "text_structure_score double, overall_score double",
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N, mean, median, deviation, range, adjusted skewness and kurtosis per column."""
    stats = column_stats(df.select(*[quoted(c) for c in cols]), distinct=None, shape=True)
    middle = exact_quantiles(df, cols, [0.5]).select("column", F.col("value").alias("median"))
    return stats.join(middle, "column", "left").select(
        "column", "n", "mean", "median", F.col("std").alias("sd"), "min", "max", "skewness", "kurtosis"
    )
