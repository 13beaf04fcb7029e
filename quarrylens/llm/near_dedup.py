"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, slices, small
from quarrylens.llm.components import components
from quarrylens.llm.shingles import MinHash, shingle_set
from quarrylens.session import materialize

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = 384
#: Estimates this far below the threshold are still verified: about five and a half standard errors.
MARGIN = 0.12
SALTS = 16
#: Shingles of the members that one side of a tile holds, about; a member counts as so many more.
PART_SHINGLES, MEMBER_COST = 1 << 20, 256
SIGNATURES = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<bigint>, bands array<bigint>"


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """Set size, 128-bit fingerprint of the set, packed low bits and band keys of every row."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
         ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        tool = MinHash(BANDS, ROWS, MINIMA, BITS)
        for part in slices(batches):
            counts, prints, sigs, bands = [], [], [], []
            for text in part.column("text").to_pylist():
                found = shingle_set(text, size)
                minima = tool.minima(found)
                counts.append(len(found))
                prints.append(xxh3_128_digest(found.tobytes()))
                sigs.append(tool.signature(minima))
                bands.append(tool.band_keys(minima) if len(found) else minima[:0].view(np.int64))
            pairs = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                 pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                schema=schema,
            )

    return rows.mapInArrow(run, SIGNATURES)


def estimate(a: str, b: str) -> Column:
    """Similarity from the equal b-bit minima, less the share that is equal by chance."""
    total = MINIMA
    differing = F.lit(0)
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    for word in range(total * BITS // 64):
        x = F.col(a)[word].bitwiseXOR(F.col(b)[word])
        step = 1
        while step < BITS:  # gather every minimum's differing bits in its lowest one
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differing / total) - chance) / (1 - chance)


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of class representatives whose estimate does not rule them out."""
    sig = classes.select("rep", "sig")
    return (
        pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        .where(estimate("sig_a", "sig_b") >= threshold - MARGIN)
        .select("a", "b")
    )


def shingle_rows(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, members): the full sets, as sorted unsigned 64-bit integers, of the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [shingle_set(t, size).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "members"])

    ids = small(materialize(ids.distinct()), 16)
    return rows.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, members binary")


def verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs for which 100 * intersection >= percent * union, on the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = materialize(pairs)
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    full = materialize(shingle_rows(rows, needed, size))
    joined = pairs.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b")
    return materialize(joined.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a bigint, b bigint").distinct())


def unsettled_links(
    buckets: DataFrame, labels: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int
) -> DataFrame:
    """Links between components in the buckets that still hold several.

    The members of these buckets are dealt into parts by their largest bucket, a part
    being as large as a task can hold, and every two parts that meet in a bucket are one
    group. There, members of different components whose estimate does not rule them out
    are compared on their full sets, likeliest first; a link joins their components for
    the rest of the group. Only links leave a group.
    """
    labelled = (
        buckets.where("members > 2")  # a bucket of two is settled by its one pair
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("band", "rep", "members", F.coalesce("component", "rep").alias("label"))
    )
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    members = materialize(labelled.join(mixed, "band", "left_semi"))
    home = members.groupBy("rep", "label").agg(F.max(F.struct("members", "band")).alias("h")).select("rep", "label", F.col("h.band").alias("home"))
    known = materialize(home.join(classes.select("rep", "n_shingles", "sig"), "rep"))
    parts = known.groupBy("home").agg(F.ceil(F.sum(F.col("n_shingles") + MEMBER_COST) / PART_SHINGLES).alias("parts"))
    sets = shingle_rows(rows, known.select(F.col("rep").alias("doc_id")), size).withColumnRenamed("doc_id", "rep")
    part = F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")).alias("part")
    placed = materialize(known.join(parts, "home").join(sets, "rep").select("rep", "label", "sig", "members", part))
    meeting = members.join(placed.select("rep", "part"), "rep").select("band", "part").distinct()
    tiles = meeting.join(meeting.withColumnRenamed("part", "other"), "band").where("part <= other")
    tiles = materialize(tiles.select(F.col("part").alias("i"), F.col("other").alias("j")).distinct())
    columns = ["i", "j", "side", "rep", "label", "sig", "members"]
    sides = [
        tiles.join(placed, F.col(end) == F.col("part")).withColumn("side", F.lit(side)).select(*columns)
        for side, end in ((0, "i"), (1, "j"))
    ]
    chance, least = 2.0**-BITS, percent / 100 - MARGIN

    def compare(group: pa.Table) -> pa.Table:
        reps, names, digits, members = [], [], [], []
        for side in (0, 1):
            part = group.filter(pa.compute.equal(group["side"], side)).combine_chunks()
            sig = part["sig"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).view(np.uint8)
            digits.append(np.concatenate([sig & 15, sig >> 4], axis=1))
            reps.append(part["rep"].to_numpy())
            names.append(part["label"].to_numpy().copy())
            members.append([np.frombuffer(x.as_buffer(), np.uint64) for x in part["members"]])
        counts = np.array([len(x) for x in members[1]])
        left, right = [], []
        for i, mine in enumerate(members[0]):
            fits = 100 * np.minimum(counts, len(mine)) >= percent * np.maximum(counts, len(mine))
            at = np.flatnonzero(fits & (names[1] != names[0][i]))
            similar = ((digits[1][at] == digits[0][i]).mean(axis=1) - chance) / (1 - chance)
            for j in at[np.argsort(-similar, kind="stable")[: int((similar >= least).sum())]]:
                a, b = names[0][i], names[1][j]
                if a == b:
                    continue
                shared = len(np.intersect1d(mine, members[1][j], assume_unique=True))
                if 100 * shared >= percent * (len(mine) + counts[j] - shared):
                    left.append(reps[0][i])
                    right.append(reps[1][j])
                    for side in names:
                        side[side == b] = a
        lo, hi = np.minimum(left, right), np.maximum(left, right)
        return pa.table({"a": pa.array(lo, pa.int64()), "b": pa.array(hi, pa.int64())})

    return materialize(sides[0].unionByName(sides[1]).groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint").distinct())


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if the sets of their shingles of ``size`` words have a
    similarity (intersection over union) of ``percent`` or more; a component is named by
    its smallest id, which is the one kept.

    Rows with equal sets are one class. Classes meet in bands of ROWS minima. First every
    member of a bucket is compared with the member that shares most buckets with others:
    packed low bits of the minima give an estimate corrected for chance, and what it does
    not rule out is verified on the full sets. In buckets that still hold several
    components, members of different ones are compared in parts of bounded size; pairs
    inside a component are never needed.
    Pairs at a threshold of 0.8 miss every band with a probability of 4.8e-8 and are ruled
    out by their estimate with one of 4.3e-8, below 1e-7 together.

    A null text, or one without words, has an empty set and is linked with nothing. A
    shorter text than ``size`` words is one shingle. A null id is linked with nothing and
    kept. Rows that share an id are one document for the links. Very long texts are
    hashed whole; an empty table gives no rows.
    """
    threshold = percent / 100
    rows = id_and_text(docs, id_column, text_column)
    signed = materialize(signatures(rows, size))
    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(
        linkable.groupBy("f1", "f2")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("least"))
        .select("f1", "f2", F.col("least.doc_id").alias("rep"), "least.n_shingles", "least.sig", "least.bands")
    )
    exploded = classes.select("rep", F.explode("bands").alias("band"))
    shared = materialize(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    buckets = materialize(exploded.join(small(shared, 16), "band"))
    popular = buckets.groupBy("rep").agg(F.sum("members").alias("popularity"))
    middle = (
        buckets.join(popular, "rep").groupBy("band")
        .agg(F.max(F.struct("popularity", "rep")).alias("top")).select("band", F.col("top.rep").alias("pivot"))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    stars = buckets.withColumn("s", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(middle, ["band", "s"])
    pairs = stars.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    links = verified(likely(pairs, classes, threshold), rows, size, percent)
    labels = materialize(components(links))
    more = unsettled_links(buckets, labels, classes, rows, size, percent)
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)))

    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component_id")
    )
    unlinked = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return (
        signed.select("doc_id", "n_shingles", "f1", "f2")
        .join(named, ["f1", "f2"], "left")
        .withColumn("component_id", F.when(unlinked, F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
