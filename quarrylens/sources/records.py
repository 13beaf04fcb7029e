"""Delimited records that may hold line breaks inside quotes, read from file splits in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.session import materialize

SCANNED = (
    "file string, block bigint, seq bigint, line binary, "
    "before0 boolean, before1 boolean, after0 boolean, after1 boolean, starts0 bigint, starts1 bigint"
)


def suspicious(line: Column) -> Column:
    """Lines after which a quote may be open: an odd number of quotes, or one inside a bare field."""
    odd = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return odd | line.rlike('[^,;|\t"]"[^,;|\t"\r]')


class Quotes:
    """Is a quoted field open after a line? A quote opens one only at the start of a field."""

    def __init__(self, sep: str):
        self.sep = sep.encode()
        other, inside = b"[^" + re.escape(self.sep) + b"]", rb'(?:[^"]++|"")*+'
        field = rb'(?:"' + inside + rb'"' + other + rb"*+|(?!\")" + other + rb"++|)"
        self.inside = re.compile(inside)
        self.outside = re.compile(rb"(?:" + field + re.escape(self.sep) + rb')*+"' + inside + rb"\Z")

    def opens(self, line: bytes, start: int = 0) -> bool:
        """From a place outside of quotes."""
        return self.outside.match(line, start) is not None

    def stays(self, line: bytes) -> bool:
        """From inside of quotes."""
        end = self.inside.match(line).end()
        if end == len(line):
            return True
        after = line.find(self.sep, end + 1)
        return after >= 0 and self.opens(line, after + 1)


def scanned_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Every line with its place (file, block, seq), and what holds if its block starts outside (0) or inside (1) of quotes.

    ``before`` and ``after`` say whether a quote is open there, ``starts`` how many records
    have started in the block so far. A block is a file split; no line leaves its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(sep)
        split, state, starts, seq = None, [False, True], [0, 0], 0
        for batch in batches:
            lines, blocks, files = batch.column("line"), batch.column("block"), batch.column("file")
            code = files.dictionary_encode().indices.to_numpy().astype(np.int64)
            numbers = blocks.to_numpy()
            changes = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (code[1:] != code[:-1])])[: batch.num_rows]
            quoted = pa.compute.match_substring(lines.cast(pa.large_binary()), b'"').to_numpy(zero_copy_only=False)
            for begin, end in zip(changes.tolist(), [*changes[1:].tolist(), batch.num_rows]):
                here = (files[begin].as_py(), int(numbers[begin]))
                if here != split:
                    split, state, starts, seq = here, [False, True], [0, 0], 0
                n = end - begin
                marks = np.flatnonzero(quoted[begin:end]).tolist()
                texts = [lines[begin + i].as_py() for i in marks]
                columns = []
                for h in (0, 1):
                    after = np.zeros(n, bool)
                    at, now = 0, state[h]
                    for i, text in zip(marks, texts):
                        after[at:i] = now
                        now = quotes.stays(text) if now else quotes.opens(text)
                        at = i
                    after[at:] = now
                    before = np.r_[state[h], after[:-1]]
                    count = starts[h] + np.cumsum(~before)
                    state[h], starts[h] = bool(now), int(count[-1])
                    columns.append((before, after, count))
                (b0, a0, s0), (b1, a1, s1) = columns
                yield pa.RecordBatch.from_arrays(
                    [files.slice(begin, n), blocks.slice(begin, n), pa.array(np.arange(seq, seq + n)), lines.slice(begin, n),
                     *map(pa.array, (b0, b1, a0, a1, s0, s1))],
                    ["file", "block", "seq", "line", "before0", "before1", "after0", "after1", "starts0", "starts1"],
                )
                seq += n

    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    return materialize(placed.mapInArrow(run, SCANNED))


def block_states(lines: DataFrame) -> DataFrame:
    """Per block: whether it starts inside of quotes, the record that is open there, and the one that is open at the file's end.

    A block turns the state at its start into that at its end: it keeps it, turns it
    around, or sets it. The last block that sets it, and the turns since, give the state at
    any block: sums over one row per file split.
    """
    blocks = lines.groupBy("file", "block").agg(
        F.max_by("after0", "seq").alias("end0"), F.max_by("after1", "seq").alias("end1"), F.max("starts0").alias("n0"), F.max("starts1").alias("n1")
    )
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("end0") & ~F.col("end1")).cast("int")
    sets = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").cast("int").alias("to"), F.sum(turns).over(upto).alias("turns")))
    last = F.last(sets, ignorenulls=True).over(earlier)
    state = F.coalesce(last["to"], F.lit(0)) + F.coalesce(F.sum(turns).over(earlier), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    known = blocks.withColumn("inside", F.pmod(state, F.lit(2)) == 1)
    n = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    started = F.when(n > 0, F.struct(F.col("block").alias("block"), n.alias("record")))
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.last(F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0"))).over(whole)
    return known.select(
        "file", "block", "inside", F.last(started, ignorenulls=True).over(earlier).alias("carried"),
        F.when(ends, F.last(started, ignorenulls=True).over(whole)).alias("unclosed"),
    )


def csv_records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, record, text, closed): one row per record, whatever line breaks its quoted fields hold.

    The first record of a file is number 1 of block 0. Lines that are records by
    themselves stay in their tasks; only the lines of longer records meet, one record at a
    time. A quote that the file never closes makes no record: the lines from its start on
    come one by one, with ``closed`` false. Empty lines outside of quotes are left out.
    """
    lines = scanned_lines(spark, path, sep)
    known = lines.join(materialize(block_states(lines)), ["file", "block"])
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    own = F.struct(F.col("block").alias("block"), pick("starts").alias("record"))
    text = F.decode("line", encoding)
    rows = known.select(
        "file", "block", "seq", text.alias("text"), pick("before").alias("before"), pick("after").alias("after"), "unclosed",
        F.when(pick("starts") > 0, own).otherwise(F.col("carried")).alias("r"),
    )
    open_ = F.col("unclosed").isNotNull() & (F.col("r") >= F.col("unclosed"))
    alone = ~F.col("before") & ~F.col("after")
    whole = rows.where(alone).select("file", "r.block", "r.record", "text", F.lit(True).alias("closed"))
    lost = rows.where(~alone & open_).select("file", "r.block", "r.record", "text", F.lit(False).alias("closed"))
    parts = rows.where(~alone & ~open_).groupBy("file", "r").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    several = parts.select("file", "r.block", "r.record", joined.alias("text"), F.lit(True).alias("closed"))
    found = whole.unionByName(several).unionByName(lost)
    found = found.withColumn("text", F.regexp_replace("text", "\r$", ""))
    return found.where((F.trim("text") != "") | ~F.col("closed"))


def field_count(record: Column, sep: str) -> Column:
    """Fields of a record: separators outside of quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1


def typed(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest of integer, long, double, date, timestamp and boolean that reads every value."""
    integer, number = "^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    kinds = {
        "int": integer, "bigint": integer, "double": f"({number})|^[+-]?(Infinity|NaN)$", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
        "timestamp": "^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:", "boolean": "(?i)^(true|false)$",
    }
    cells = {
        (c, kind): F.count_if(F.col(f"`{c}`").isNotNull() & ~(F.col(f"`{c}`").rlike(form) & F.col(f"`{c}`").try_cast(kind).isNotNull()))
        for c in df.columns for kind, form in kinds.items()
    }
    if not cells:
        return df
    misses = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)], *[e.alias(f"m{i}") for i, e in enumerate(cells.values())]).first()
    best = {}
    for i, (c, kind) in enumerate(cells):
        if misses[f"m{i}"] == 0 and misses[f"n{df.columns.index(c)}"]:
            best.setdefault(c, kind)
    return df.select(*[F.col(f"`{c}`").cast(best.get(c, "string")).alias(c) for c in df.columns])
