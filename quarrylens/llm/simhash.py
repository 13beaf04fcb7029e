"""Near-duplicate documents by SimHash, with candidates from pigeonring chains of segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, slices, small
from quarrylens.llm.components import components
from quarrylens.session import materialize

SEED = 42
#: Bits that may differ, and the segments of a fingerprint, in a ring.
DISTANCE, SEGMENTS = 3, 8
WIDTH = 64 // SEGMENTS
#: Differences that a chain of 1, 2, ... segments may hold: its share of DISTANCE.
BUDGETS = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]
CHAIN = 5  # segments of a chain that give the keys
#: Shingles hashed at once, and fingerprints that one side of a comparison holds, about.
BLOCK, PART = 1 << 16, 4096
#: Copies of one fingerprint from which its rows meet their component by broadcast.
HOT = 1000


def keys_of_a_chain(budgets: list[int], chain: int) -> list[tuple[int, ...]]:
    """Sets of places of a chain of which one, at least, is free of differences if the chain keeps its budgets.

    All sets are as large as the places that the budget of the whole chain leaves free; the
    ones that no allowed pattern of differences needs are left out.
    """
    worst = [
        dirty for dirty in combinations(range(chain), budgets[chain - 1])
        if all(sum(d < length for d in dirty) <= budgets[length - 1] for length in range(1, chain + 1))
    ]
    return sorted({tuple(p for p in range(chain) if p not in dirty) for dirty in worst})


def fingerprint(text: str, size: int = 3) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it; a text without words has none set."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        hashes = (xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(start, stop))
        found = np.fromiter(hashes, "<u8", stop - start).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(found, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, print) of every row, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, size) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def ring_keys() -> Column:
    """Keys of a fingerprint: for every start in the ring and every set of places, the segments there, under their number."""
    mask = (1 << WIDTH) - 1
    segment = [F.shiftrightunsigned("print", WIDTH * i).bitwiseAND(F.lit(mask)) for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        for places in keys_of_a_chain(BUDGETS, CHAIN):
            key = F.lit(len(keys)).cast("bigint")
            for place in places:
                key = F.shiftleft(key, WIDTH).bitwiseOR(segment[(start + place) % SEGMENTS])
            keys.append(key)
    return F.array(*keys)


def chained(differing: np.ndarray, start: int) -> np.ndarray:
    """Places of the differences whose chain from segment ``start`` keeps every budget, the last being the full distance."""
    turned = (differing >> np.uint64(WIDTH * start)) | (differing << np.uint64((64 - WIDTH * start) % 64))
    at = np.arange(len(turned))
    for length, budget in enumerate(BUDGETS, 1):
        part = np.uint64((1 << WIDTH * length) - 1)
        fits = np.bitwise_count(turned & part) <= budget
        at, turned = at[fits], turned[fits]
    return at


def spanning(start: int, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` (or inside ``left``), as few as join what they join."""
    points = left if right is None else np.concatenate([left, right])
    label = np.arange(len(points))
    links = []
    for i in range(len(left)):
        first = i + 1 if right is None else len(left)
        open_ = first + np.flatnonzero(label[first:] != label[i])
        for j in open_[chained(points[open_] ^ points[i], start)].tolist():
            if label[j] != label[i]:
                links.append((int(points[i]), int(points[j])))
                label[label == label[j]] = label[i]
    return links


def links_of(buckets: DataFrame) -> DataFrame:
    """(a, b): links inside the buckets, enough to join all that their pairs join.

    A bucket of more than PART fingerprints is dealt into parts; every two parts are one
    comparison, so a task holds two parts and only links leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_start = len(keys_of_a_chain(BUDGETS, CHAIN))

        def flush(group, prints, sides):
            start = (group[0] >> WIDTH * (CHAIN - BUDGETS[CHAIN - 1])) // per_start
            prints, sides = np.array(prints, np.int64).view(np.uint64), np.array(sides)
            one = group[1] == group[2]
            return spanning(start, prints if one else prints[sides == 0], None if one else prints[sides == 1])

        group, prints, sides, links = None, [], [], []
        for batch in batches:
            for key, i, j, side, x in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "print")]):
                if (key, i, j) != group:
                    if len(prints) > 1:
                        links += flush(group, prints, sides)
                    group, prints, sides = (key, i, j), [], []
                prints.append(x)
                sides.append(side)
            if links:
                yield pairs(links)
                links = []
        if len(prints) > 1:
            yield pairs(flush(group, prints, sides))

    def pairs(links):
        found = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], ["a", "b"])

    parts = F.ceil(F.col("members") / PART).cast("int")
    mine = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    dealt = buckets.withColumn("parts", parts).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "print"
    )
    group = ["key", "i", "j"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_duplicates(
    docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Two fingerprints are linked if at most DISTANCE bits differ; a component is named by
    the smallest doc_id that links reach. Rows of one fingerprint are one point.

    A fingerprint is a ring of SEGMENTS segments. If a pair differs in DISTANCE bits at
    most, there is a start from which every chain of consecutive segments holds no more
    than its share of them. The budgets of the first CHAIN segments leave 32 equal bits in
    one of a few sets of places: those are the keys by which candidates meet. In a bucket
    the whole chain is checked, segment by segment, up to the full distance. No pair is lost.

    A null text, or one without words, has fingerprint zero and is linked like any other; a
    text of fewer than ``size`` words is one shingle. A null id is linked with nothing and
    its component is null. Rows that share an id are linked by their own texts alone. Very
    long texts are hashed whole, in blocks; an empty table gives no rows.
    """
    signed = materialize(fingerprints(id_and_text(docs, id_column, text_column), size))
    known = signed.where("doc_id IS NOT NULL")
    classes = materialize(known.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    keys = classes.select("print", F.explode(ring_keys()).alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    buckets = keys.join(small(shared, 16), "key")
    labels = materialize(components(materialize(links_of(buckets))).withColumnRenamed("id", "print"))
    smallest = labels.join(classes, "print").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = labels.join(smallest, "component").select("print", "component_id")
    named = classes.join(linked, "print", "left").select("print", "copies", F.coalesce("component_id", "least").alias("component_id"))
    named = materialize(named)
    # fingerprints of very many rows come to them; the rest meet by shuffle
    hot = materialize(named.where(F.col("copies") >= HOT).select("print", F.col("component_id").alias("known")))
    met = known.join(small(hot, 16), "print", "left")
    rest = met.where("known IS NULL").drop("known").join(named.where(F.col("copies") < HOT).drop("copies"), "print")
    done = met.where("known IS NOT NULL").withColumnRenamed("known", "component_id")
    nobody = signed.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint"))
    out = rest.unionByName(done).unionByName(nobody)
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
