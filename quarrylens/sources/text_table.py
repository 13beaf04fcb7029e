"""Key-value text lines (``K: v | K: v``) to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import quoted


def text_to_table(df: DataFrame, col: str = "value", min_confidence: float = 0.5) -> DataFrame:
    """Columns are the keys of the most common line shape; values get the tightest type.

    Confidence is the share of non-blank lines of that shape. Raises ValueError when
    it is below ``min_confidence`` or when nothing can be extracted.
    """
    lines = df.where(F.trim(quoted(col)) != "").select(
        F.filter(F.split(quoted(col), r"\|"), lambda p: p.contains(":")).alias("parts")
    )
    key = lambda p: F.trim(F.substring_index(p, ":", 1))
    shaped = lines.withColumn("keys", F.transform("parts", key))
    total = F.sum("n").alias("total")
    shapes = shaped.groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    top = shapes.agg(
        total,
        F.max(F.when(F.size("keys") > 0, F.struct("n", "keys"))).alias("best"),
    ).first()
    if top["best"] is None or top["best"]["n"] / top["total"] < min_confidence:
        raise ValueError("no repeated key-value structure in the text")
    names = list(dict.fromkeys(top["best"]["keys"]))

    def value(name):
        mine = F.filter("parts", lambda p: key(p) == name)
        part = F.try_element_at(mine, F.lit(1))
        text = F.trim(F.substring(part, F.instr(part, ":") + F.lit(1), F.length(part)))
        return F.when(text != "", text)

    rows = shaped.where(F.arrays_overlap("keys", F.array(*[F.lit(n) for n in names]))).select(
        *[value(n).alias(n) for n in names]
    )
    checks = []
    for i, n in enumerate(names):
        c = quoted(n)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count(c.try_cast("bigint")).alias(f"l{i}"),
            F.count(c.try_cast("double")).alias(f"d{i}"),
        ]
    found = rows.agg(*checks).first()
    out = []
    for i, n in enumerate(names):
        if found[f"n{i}"] and found[f"l{i}"] == found[f"n{i}"]:
            out.append(quoted(n).try_cast("bigint").alias(n))
        elif found[f"n{i}"] and found[f"d{i}"] == found[f"n{i}"]:
            out.append(quoted(n).try_cast("double").alias(n))
        else:
            out.append(quoted(n))
    return rows.select(*out)
