"""Repeated byte strings by fingerprints of anchors, of whole stretches and of the ends of repeats.

Prefix doubling would sort one row per byte of the corpus. Three observations leave one
doubling step for a small part of the positions and keep the result exact:

* A document equal to an earlier one is removed whole and adds no first occurrence.
* Every string of LENGTH bytes holds an anchor: the half-length gram with the least name.
  Equal strings have equal anchors, so a string whose anchor gram is unique is unique.
  This is the first rank, of sampled positions only; unique ones drop out.
* Consecutive strings share an anchor. If the whole stretch they cover equals an earlier
  stretch, all of them repeat and are settled together.

What is left are the strings around the ends of repeats. Each of these positions gets the
pair of ranks of its two halves; Spark groups the pairs, and a pair seen twice is past the
threshold. Ranks are named by fingerprints of the bytes, so that the rank at an offset
needs no look-up, and only equality of ranks is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, keyed, per_worker, slices, small
from quarrylens.session import materialize

LENGTH = 100
SLICE = 512 << 10
#: Sampled positions that one group of the first count holds, about.
GROUP_GRAMS = 500_000
TASK_GRAMS = 8_000_000
BROADCAST = 64 << 20
PLACE_BITS = 31
BASE = 0xD6E8FEB86659FD93
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Names:
    """64-bit names of all substrings of a byte buffer: equal strings have equal names."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        if len(data) > 2 * SLICE:
            up, self.down = powers(len(data))
        else:
            up, self.down = per_worker(("powers",), lambda: powers(2 * SLICE))
        values = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Names of the strings of one size at every place."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def anchors(names: Names, ends: np.ndarray, length: int):
    """Document, first and last start, and place of each anchor.

    A string's anchor is the gram of length // 2 bytes inside it with the least name, the
    leftmost on ties; the strings of one anchor start side by side.
    """
    gram = length // 2
    n = len(names.sums) - length  # places where a string can start
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    least = names.every(gram)
    least = (least >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(least), dtype=np.uint64)
    wide, width = length - gram + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    place = (least[:n] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    document = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[:n]
    inside = np.flatnonzero(np.arange(n) + length <= ends[document])
    place = place[inside]
    if not len(place):
        return (np.empty(0, np.int64),) * 4
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:] - 1, len(place) - 1]
    return document[inside[new]], inside[new], inside[last], place[new]


def repeats(*keys: np.ndarray) -> np.ndarray:
    """Whether a row's keys occurred in an earlier row."""
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] = same  # lexsort is stable: equal rows stay in their order
    return out


def buffers(batches: Iterator[pa.RecordBatch]):
    """(slice of rows, bytes of its texts, end of each text) of every slice."""
    for part in slices(batches, limit=SLICE):
        texts = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
        yield part, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def longs(*arrays) -> list[pa.Array]:
    return [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays]


def repeated_grams(rows: DataFrame, length: int, groups: int) -> DataFrame:
    """(g) of every anchor gram that occurs twice or more.

    A task sends each gram once, or twice if it has seen it so often, in one array per
    group: a gram is never more than two entries per task, however common it is.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found = np.repeat(found, np.minimum(times, 2))
            group = (found >> np.uint64(33)).astype(np.int64) % groups
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            parts = [found[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), pa.array(parts, pa.binary())], ["part", "grams"])

        held, n = [], 0
        for _, data, ends in buffers(batches):
            names = Names(data)
            _, _, _, place = anchors(names, ends, length)
            held.append(names(place, place + length // 2))
            n += len(place)
            if n >= TASK_GRAMS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def count(group: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]])
        grams.sort()
        twice = np.unique(grams[1:][grams[1:] == grams[:-1]])
        return pa.table({"g": pa.array(twice.view(np.int64))})

    return rows.mapInArrow(collect, "part bigint, grams binary").groupBy("part").applyInArrow(count, "g bigint")


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """One row per anchor: gram, name of the stretch its strings cover, document, first start,
    number of strings, and whether the same stretch came before in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in buffers(batches):
            names = Names(data)
            document, low, high, place = anchors(names, ends, length)
            g = names(place, place + length // 2)
            c = mixed(names(low, high + length) + (place - low).astype(np.uint64))
            begin = np.r_[0, ends[:-1]][document] if len(document) else document
            ids = part.column("doc").to_numpy()[document]
            yield pa.RecordBatch.from_arrays(
                [*longs(g, c, ids, low - begin, high - low + 1), pa.array(repeats(g, c, document))],
                ["g", "c", "doc", "low", "n", "again"],
            )

    return rows.mapInArrow(run, "g bigint, c bigint, doc bigint, low bigint, n bigint, again boolean")


def position_rows(rows: DataFrame, length: int) -> DataFrame:
    """One row per open position: the ranks of its halves as one 96-bit name, document, place.

    ``rows`` have the stretches of their document, as first start * 2 ** 32 + number.
    """
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in buffers(batches):
            names, other = Names(data), Names(data, seed=1)
            begins = np.r_[0, ends[:-1]]
            starts, owner = [], []
            for d, packed in enumerate(part.column("stretches")):
                packed = np.sort(packed.values.to_numpy())
                first, n = packed >> 32, packed & 0xFFFFFFFF
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                starts.append(at + begins[d])
                owner.append(np.full(len(at), d))
            at, owner = np.concatenate(starts), np.concatenate(owner)
            left, right = names(at, at + half), names(at + half, at + length)
            rank = mixed(left * MULTIPLIER + right)
            check = (other(at, at + length) >> np.uint64(33)).astype(np.int64)
            ids = part.column("doc").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [*longs(rank, check, ids, at - begins[owner]), pa.array(repeats(rank, check, owner))],
                ["rank", "check", "doc", "place", "again"],
            )

    return rows.mapInArrow(run, "rank bigint, check bigint, doc bigint, place bigint, again boolean")


def cut(rows: DataFrame, length: int) -> DataFrame:
    """Spans to remove, merged, and what is left, of texts with their marked stretches."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
    names = ["doc_id", "n_bytes", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 * SLICE):
            sizes, spans, kept = [], [], []
            for text, marks, copy in zip(part.column("text"), part.column("marks"), part.column("copy").to_pylist()):
                text = text.as_py().encode("utf-8", "surrogatepass")
                sizes.append(len(text))
                if copy:
                    found = [(0, len(text))] if len(text) >= length else []
                elif not marks.is_valid:
                    found = []
                else:
                    packed = np.sort(marks.values.to_numpy())
                    start, stop = packed >> 32, np.minimum((packed >> 32) + (packed & 0xFFFFFFFF), len(text))
                    reach = np.maximum.accumulate(stop)
                    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                    found = list(zip(start[new].tolist(), reach[np.r_[new[1:] - 1, len(reach) - 1]].tolist()))
                spans.append([{"start": a, "stop": b} for a, b in found])
                edges = [0, *(x for s in found for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [part.column("doc_id"), sizes, spans, kept]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(run, SCHEMA)


def packed(start, n):
    return F.shiftleft(F.col(start), 32).bitwiseOR(n)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, the spans to remove and the bytes that are left, of every row.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a
    document of a smaller id, or before in the same one. Strings are judged on the input;
    spans are maximal; matches never cross documents.

    Sampled positions are counted in arrays with at most two entries per gram and task;
    rows are shuffled only for positions that can repeat, and groups of equal strings are
    reduced to their smallest document before they meet their members again.

    A null text is empty. A null id comes before all others. Rows that share an id are
    documents of their own, in the order of a hash of their texts; rows equal in id and
    text are one document, each with its marks. Texts under ``length`` bytes
    keep all; very long texts are read whole; an empty table gives no rows.
    """
    rows, key = keyed(id_and_text(docs, id_column, text_column), nulls_first=True)
    rows = rows.withColumnRenamed(key, "doc")
    named = rows.select(
        "doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
        F.octet_length("text").cast("bigint").alias("n"),
    )
    equal = named.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    equal = materialize(equal)
    total = equal.agg(F.sum("n")).first()[0] or 0
    copies = materialize(
        named.join(small(equal.where("rows > 1").select("h1", "h2", "first"), 32), ["h1", "h2"])
        .where("doc > first").select("doc").distinct()
    )
    single = rows.join(small(copies, 16), "doc", "left_anti").select("doc", "text")

    groups = max(1, 4 * total // length // GROUP_GRAMS)
    grams = materialize(repeated_grams(single, length, groups))
    found = materialize(anchor_rows(single, length).join(small(grams, 16, BROADCAST), "g"))
    classes = materialize(found.groupBy("g", "c").agg(F.min("doc").alias("first")))
    several = classes.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g", F.lit(True).alias("open"))
    classes = classes.join(several, "g", "left")
    later = F.col("again") | (F.col("doc") > F.col("first"))
    found = materialize(found.join(classes, ["g", "c"]).select("doc", "low", "n", later.alias("settled"), "open"))
    settled = found.where("settled").select("doc", packed("low", F.col("n") + (length - 1)).alias("mark"))
    left = found.where("NOT settled AND open").groupBy("doc").agg(F.collect_list(packed("low", F.col("n"))).alias("stretches"))
    left = materialize(left)

    positions = position_rows(single.join(small(left, 160, BROADCAST), "doc"), length)
    ranks = positions.groupBy("rank", "check").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    ranks = materialize(ranks.select("rank", "check", "first"))
    again = positions.join(ranks, ["rank", "check"]).where(later)
    marks = settled.unionByName(again.select("doc", packed("place", F.lit(length)).alias("mark")))
    marks = materialize(marks.groupBy("doc").agg(F.collect_list("mark").alias("marks")))
    # only texts with something to remove meet their marks
    touched = small(marks.select("doc"), 16)
    marked = rows.join(touched, "doc", "left_semi").join(marks, "doc").unionByName(
        rows.join(touched, "doc", "left_anti").withColumn("marks", F.lit(None).cast("array<bigint>"))
    )
    marked = marked.join(small(copies.withColumn("copy", F.lit(True)), 16), "doc", "left")
    return cut(marked.select("doc_id", "text", "marks", "copy"), length)
