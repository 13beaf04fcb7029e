"""Merging tables on their best column pair, and finding references between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.profiling import distinct_counts, short_form
from quarrylens.operators.sketches import Sketch, column_sketches
from quarrylens.session import is_datetime, is_numeric, materialize, quoted


def type_family(field: T.StructField) -> str:
    if is_numeric(field):
        return "number"
    return "date" if is_datetime(field) else "text"


def comparable(field: T.StructField) -> Column:
    """Text form under which equal values of one family are equal, whatever their width."""
    c = quoted(field.name)
    if isinstance(field.dataType, T.StringType):
        return short_form(c)
    if not is_numeric(field):
        return c.cast("string")
    if isinstance(field.dataType, T.IntegralType):
        return c.cast("string")
    whole = (F.abs(c) < 1e15) & (c == F.floor(c))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("double").cast("string"))


def _scalar_fields(df: DataFrame) -> list[T.StructField]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f for f in df.schema if not isinstance(f.dataType, nested)]


def column_values(df: DataFrame, side: str, repeated: bool = False) -> DataFrame:
    """(family, value, "side:position") of every scalar column, in one pass; distinct unless ``repeated``."""
    cells = [
        F.struct(
            F.lit(type_family(f)).alias("family"),
            comparable(f).alias("value"),
            F.lit(f"{side}:{df.columns.index(f.name)}").alias("owner"),
        )
        for f in _scalar_fields(df)
    ]
    values = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    return values if repeated else values.distinct()


def shared_values(parts: Sequence[DataFrame], approx: bool = False) -> DataFrame:
    """How many distinct values each (owner, other) column pair has in common.

    Values are deduplicated per column first, so a group holds at most one row per
    column and the pairs formed per value are bounded by the number of columns.
    ``approx`` estimates the same from one sketch per column, without a shuffle of
    values; its error is a few percent of the larger column.
    """
    values = parts[0]
    for part in parts[1:]:
        values = values.unionAll(part)
    if approx:
        return _shared_estimates(values)
    owners = values.groupBy("family", "value").agg(F.collect_list("owner").alias("owners"))
    pairs = owners.where(F.size("owners") > 1).select(F.explode("owners").alias("owner"), "owners")
    pairs = pairs.select("owner", F.explode("owners").alias("other")).where(F.col("owner") != F.col("other"))
    return pairs.groupBy("owner", "other").agg(F.count(F.lit(1)).alias("shared"))


def _shared_estimates(values: DataFrame) -> DataFrame:
    sketch = F.hll_sketch_agg("value", 14).alias("sketch")
    columns = values.groupBy("family", "owner").agg(sketch)
    peers = columns.groupBy("family").agg(F.collect_list(F.struct("owner", "sketch")).alias("peers"))
    pairs = peers.select("peers", F.inline("peers")).select(
        "owner", "sketch", F.explode("peers").alias("peer")
    )
    both = F.hll_sketch_estimate(F.hll_union("sketch", "peer.sketch"))
    size = lambda c: F.hll_sketch_estimate(c)
    shared = F.greatest(size("sketch") + size("peer.sketch") - both, F.lit(0))
    return pairs.where(F.col("owner") != F.col("peer.owner")).select(
        "owner", F.col("peer.owner").alias("other"), shared.alias("shared")
    )


def best_pair(
    left: DataFrame, right: DataFrame, symmetric: bool = False, approx: bool = False
) -> tuple[float, str, str, bool, bool] | None:
    """Best column pair by name likeness and value overlap, half each.

    Returns the score, both names, and whether each is unique in its table.
    """
    overlap = {
        (r["owner"], r["other"]): r["shared"]
        for r in shared_values([column_values(left, "l", approx), column_values(right, "r", approx)], approx)
        .where(F.col("owner").startswith("l:") & F.col("other").startswith("r:"))
        .collect()  # one row per column pair
    }
    (rows_l, size_l), (rows_r, size_r) = _distinct_counts(left), _distinct_counts(right)
    best = None
    for lf in _scalar_fields(left):
        for rf in _scalar_fields(right):
            pair = (f"l:{left.columns.index(lf.name)}", f"r:{right.columns.index(rf.name)}")
            base = max(size_l[lf.name], 1)
            if symmetric:
                base = max(base, size_r[rf.name])
            name = SequenceMatcher(None, lf.name.lower(), rf.name.lower()).ratio()
            score = 0.5 * name + 0.5 * overlap.get(pair, 0) / base
            if best is None or score > best[0]:
                best = (score, lf.name, rf.name, size_l[lf.name] == rows_l, size_r[rf.name] == rows_r)
    return best


def _distinct_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of a table and distinct values per scalar column, values deduplicated before the shuffle."""
    fields = _scalar_fields(df)
    counts = {r["position"]: r["nunique"] for r in distinct_counts(df, fields).collect()} if fields else {}
    return df.count(), {f.name: counts.get(i, 0) for i, f in enumerate(fields)}


HOW = {(True, True): "inner", (True, False): "left", (False, True): "right", (False, False): "left"}


def smart_merge(
    dfs: Sequence[DataFrame],
    names: Sequence[str] | None = None,
    threshold: float = 0.3,
    symmetric: bool = False,
    approx: bool = False,
    match_nulls: bool = False,
    max_pairs: int | None = None,
) -> DataFrame:
    """Fold tables together: join on the best column pair, else stack the rows.

    The join type follows the cardinality of the keys; clashing right columns get the
    suffix ``_<name>``. A NULL key matches nothing: such rows stay only where the join
    type keeps unmatched rows. ``match_nulls`` pairs every NULL key with every other.
    With ``max_pairs`` the pairs of a join are counted first, and more are an error.
    Each fold but the last is stored, so that the next one does not repeat it.
    """
    names = list(names) if names else [f"t{i + 1}" for i in range(len(dfs))]
    merged = dfs[0]
    for right, name in zip(dfs[1:], names[1:]):
        best = best_pair(merged, right, symmetric, approx)
        if best is not None and best[0] > threshold:
            _, lk, rk, unique_l, unique_r = best
            if max_pairs is not None and (pairs := pair_count(merged, right, lk, rk, match_nulls)) > max_pairs:
                raise ValueError(f"joining on {lk!r} and {rk!r} makes {pairs} pairs, over {max_pairs}")
            merged = _join(merged, right, lk, rk, HOW[(unique_l, unique_r)], name, match_nulls)
        else:
            merged = merged.unionByName(right, allowMissingColumns=True)
        if right is not dfs[-1]:
            merged = materialize(merged)
    return merged


def pair_count(left: DataFrame, right: DataFrame, lk: str, rk: str, match_nulls: bool = False) -> int:
    """How many row pairs share a key, from the key counts of both sides."""
    a = left.groupBy(quoted(lk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = right.groupBy(quoted(rk).alias("q")).agg(F.count(F.lit(1)).alias("m"))
    same = F.col("k").eqNullSafe(F.col("q")) if match_nulls else F.col("k") == F.col("q")
    return a.join(b, same).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _join(left: DataFrame, right: DataFrame, lk: str, rk: str, how: str, name: str, match_nulls: bool) -> DataFrame:
    same = lk == rk
    renamed = {
        c: f"{c}_{name}" if c in left.columns and not (same and c == rk) else c for c in right.columns
    }
    l, r = left.alias("l"), right.alias("r")
    a, b = F.col(f"l.`{lk}`"), F.col(f"r.`{rk}`")
    both = l.join(r, a.eqNullSafe(b) if match_nulls else a == b, how)
    side = "r" if how == "right" else "l"
    out = [
        F.col(f"{side if same and c == lk else 'l'}.`{c}`").alias(c) for c in left.columns
    ]
    out += [F.col(f"r.`{c}`").alias(renamed[c]) for c in right.columns if not (same and c == rk)]
    return both.select(*out)


def _reaching(sketches: Mapping[str, Mapping[str, Sketch]], threshold: float) -> set[tuple[str, str]]:
    """(table, column) of both ends of the pairs that the sketches do not rule out."""
    ends = [(name, c, s) for name, columns in sketches.items() for c, s in columns.items() if s.present]
    out: set[tuple[str, str]] = set()
    for parent in ends:
        if parent[2].can_be_unique():
            for child in ends:
                if child[0] != parent[0] and child[2].can_lie_in(parent[2], threshold):
                    out |= {parent[:2], child[:2]}
    return out


def relationships(
    tables: Mapping[str, DataFrame], threshold: float = 0.95, approx: bool = False
) -> DataFrame:
    """Child columns whose distinct values are contained in a unique column of another table.

    Only whole-number and text columns take part. All pairs above the threshold are
    reported: small integer keys overlap by chance. Sketches of all columns come first, one
    pass per table; values are shuffled only of columns in pairs that can reach the
    threshold (:class:`Sketch`). ``approx`` estimates every pair from other sketches instead.
    """
    keys, sketches = {}, {}
    for name, df in tables.items():
        fields = [f for f in _scalar_fields(df) if isinstance(f.dataType, (T.IntegralType, T.StringType))]
        keys[name] = df.select(*[quoted(f.name) for f in fields])
        if not approx and fields:
            # equal texts of two families never meet
            values = {f.name: F.when(quoted(f.name).isNotNull(), F.concat(F.lit(f"{type_family(f)}:"), comparable(f))) for f in fields}
            sketches[name] = column_sketches(keys[name], values)
    if not approx:
        needed = _reaching(sketches, threshold)
        keys = {name: df.select(*[quoted(c) for c in df.columns if (name, c) in needed]) for name, df in keys.items()}
        keys = {name: df for name, df in keys.items() if df.columns}
    parts, owners, unique = [], {}, set()
    for name, df in keys.items():
        parts.append(column_values(df, name, approx))
        total, distinct = _distinct_counts(df)
        for i, c in enumerate(df.columns):
            owners[f"{name}:{i}"] = (name, c, distinct[c])
            if total and distinct[c] == total:
                unique.add(f"{name}:{i}")
    found = []
    for r in shared_values(parts, approx).collect() if parts else ():  # one row per column pair
        child, parent = owners[r["owner"]], owners[r["other"]]
        contained = min(r["shared"] / max(child[2], 1), 1.0)
        if r["other"] in unique and child[0] != parent[0] and contained >= threshold:
            found.append((child[0], child[1], parent[0], parent[1], contained))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        found,
        "child_table string, child_column string, parent_table string, parent_column string, "
        "containment double",
    ).orderBy(F.desc("containment"), "child_table", "child_column", "parent_table", "parent_column")
