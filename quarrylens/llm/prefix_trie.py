"""Prefix trie of conversations by van Emde Boas recursion: cut at half depth, solve upper trie and lower forests together, graft."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.ordering import key_position, range_partitions, with_index
from quarrylens.session import materialize, quoted

#: Turns that one row holds, a power of two; longer sequences are rows of several blocks.
BLOCK_BITS = 4
BLOCK = 1 << BLOCK_BITS
#: Ids that one piece of an id list holds.
RUN_IDS = 1 << 14
NAME = ["na", "nb"]
PARENT = ["pa", "pb"]


def numbered(
    conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """conv, pos (from 0), key_rows, 128 bits of role and text (h1, h2) and bytes of every turn; texts are not shuffled."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    turns = conversations.select(
        quoted(conv_column).cast("bigint").alias("conv"), quoted(turn_column).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("bigint").alias("bytes"),
    ).where("conv IS NOT NULL")
    return materialize(key_position(with_index(turns, ["turn", "role"], ["conv"]), ["conv"]).drop("turn", "role", "idx"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as sequences: (conv, length) and (conv, at, length, h1, h2, bytes), with ``at`` from 1."""
    convs = turns.groupBy("conv").agg(F.max("key_rows").alias("length"))
    return convs, turns.select("conv", (F.col("pos") + 1).alias("at"), F.col("key_rows").alias("length"), "h1", "h2", "bytes")


def with_shared_starts(turns: DataFrame, siblings: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Numbered turns rebuilt: conversation c starts with the first h turns of c - c % siblings, h = crc32(c) % most.

    Its own turns after the first h follow. An absent conversation gives no turns.
    """
    sizes = turns.groupBy("conv").agg(F.max("key_rows").alias("own"))
    convs = sizes.select(
        "conv", "own", (F.col("conv") - F.col("conv") % siblings).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"),
    )
    convs = convs.join(sizes.toDF("base", "there"), "base", "left")
    lead = F.least("h", F.coalesce("there", F.lit(0)))
    convs = materialize(convs.select("conv", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    heads = (
        turns.where(F.col("pos") < most - 1).withColumnRenamed("conv", "base")
        .join(convs.where("lead > 0"), "base").where("pos < lead").withColumn("at", F.col("pos") + 1)
    )
    tails = turns.join(convs, "conv").where("pos >= h").withColumn("at", F.col("lead") + F.col("pos") - F.col("h") + 1)
    columns = ["conv", "at", "length", "h1", "h2", "bytes"]
    return convs.select("conv", "length"), heads.select(*columns).unionByName(tails.select(*columns))


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv, block, length, path): up to BLOCK turns in a row, each with the names from the block's start.

    The name of a run of turns is the exclusive or of 128 hashed bits of each (place, role,
    text), so names of neighbouring runs combine into that of both.
    """
    block = F.shiftright(F.col("at") - 1, BLOCK_BITS).alias("block")
    hashed = turns.select(
        "conv", "at", "length", "bytes", block,
        F.xxhash64(F.lit(1), "at", "h1", "h2").alias("a"), F.xxhash64(F.lit(2), "at", "h2", "h1").alias("b"),
    )
    upto = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # at most BLOCK rows
    named = hashed.withColumns({"na": F.bit_xor("a").over(upto), "nb": F.bit_xor("b").over(upto)})
    path = F.sort_array(F.collect_list(F.struct("at", "na", "nb", "bytes")))
    return named.groupBy("conv", "block").agg(F.max("length").alias("length"), path.alias("path"))


def block_names(long: DataFrame) -> DataFrame:
    """(conv, block, ta, tb): the name of the prefix before each block, for sequences of several blocks.

    Sequences are cut at half their blocks, again and again: the lower half's prefix is the
    prefix of the whole and the upper half together. Spans double on the way up, names
    halve on the way down; each level is half as many rows, spread by place.
    """
    end = F.element_at("path", -1)
    blocks = F.shiftright(F.col("length") - 1, BLOCK_BITS) + 1
    level = materialize(long.select("conv", F.col("block").alias("i"), blocks.alias("blocks"), end["na"].alias("a"), end["nb"].alias("b")))
    most = level.agg(F.max("blocks")).first()[0] or 0
    levels = [level]
    while 1 << len(levels) < most:
        level = materialize(
            level.groupBy("conv", F.shiftright("i", 1).alias("i")).agg(F.max("blocks").alias("blocks"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        )
        levels.append(level)
    zero = F.lit(0).cast("bigint")
    names = levels[0].where("i = 0").select("conv", "blocks", "i", zero.alias("ta"), zero.alias("tb"))
    for j in range(len(levels) - 1, -1, -1):
        upper = levels[j].where("i % 2 = 0").select("conv", F.shiftright("i", 1).alias("i"), "a", "b")
        lower = F.struct((F.col("i") * 2 + 1).alias("i"), F.col("ta").bitwiseXOR(F.col("a")).alias("ta"), F.col("tb").bitwiseXOR(F.col("b")).alias("tb"))
        halves = F.array(F.struct((F.col("i") * 2).alias("i"), "ta", "tb"), F.when(F.shiftleft(F.col("i") * 2 + 1, j) < F.col("blocks"), lower))
        names = materialize(names.join(upper, ["conv", "i"]).select("conv", "blocks", F.inline(F.filter(halves, lambda x: x.isNotNull()))))
    return names.select("conv", F.col("i").alias("block"), "ta", "tb")


def placed_blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, length, ta, tb, path): every block under the name of the prefix before it, its places under their own."""
    blocks = materialize(blocks_of(turns))
    several = F.col("length") > BLOCK
    zero = F.lit(0).cast("bigint")
    short = blocks.where(~several).withColumns({"ta": zero, "tb": zero})
    long = blocks.where(several)
    long = long.join(block_names(long), ["conv", "block"])
    whole = lambda x: F.struct(x["at"].alias("at"), x["na"].bitwiseXOR(F.col("ta")).alias("na"), x["nb"].bitwiseXOR(F.col("tb")).alias("nb"), x["bytes"].alias("bytes"))
    return materialize(long.withColumn("path", F.transform("path", whole)).unionByName(short))


def merged(rows: DataFrame) -> DataFrame:
    """Equal runs under one prefix are one row: how many conversations, the smallest, and how many end there."""
    return rows.groupBy("ta", "tb", "ea", "eb").agg(
        F.first("path").alias("path"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("ended").alias("ended")
    )


def trie_nodes(placed: DataFrame) -> DataFrame:
    """(na, nb, pa, pb, depth, bytes, n, conv, ended) of every node but the root.

    Each round cuts all runs at half their height. The upper runs of all tries are solved
    together with the lower runs, which are tries of their own under the name of the cut.
    Runs that have become equal merge before the next round.
    """
    end = F.element_at("path", -1)
    rows = placed.select(
        "ta", "tb", end["na"].alias("ea"), end["nb"].alias("eb"), "path", F.lit(1).cast("bigint").alias("n"), "conv",
        (end["at"] == F.col("length")).cast("bigint").alias("ended"),
    )
    rows = merged(rows)
    half = BLOCK >> 1
    while half:
        cut, middle = F.size("path") > half, F.col("path")[half - 1]
        none = F.lit(0).cast("bigint")
        upper = F.struct(
            "ta", "tb", F.when(cut, middle["na"]).otherwise(F.col("ea")).alias("ea"), F.when(cut, middle["nb"]).otherwise(F.col("eb")).alias("eb"),
            F.slice("path", 1, half).alias("path"), "n", "conv", F.when(cut, none).otherwise(F.col("ended")).alias("ended"),
        )
        lower = F.struct(
            middle["na"].alias("ta"), middle["nb"].alias("tb"), "ea", "eb", F.slice("path", half + 1, half).alias("path"), "n", "conv", "ended"
        )
        rows = rows.select(F.inline(F.filter(F.array(upper, F.when(cut, lower)), lambda x: x.isNotNull())))
        if half > 1:
            rows = merged(rows)
        half >>= 1
    turn = F.col("path")[0]
    rows = rows.select(
        F.col("ea").alias("na"), F.col("eb").alias("nb"), F.col("ta").alias("pa"), F.col("tb").alias("pb"),
        turn["at"].alias("depth"), turn["bytes"].alias("bytes"), "n", "conv", "ended",
    )
    return rows.groupBy(*NAME, *PARENT, "depth", "bytes").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("ended").alias("ended"))


def grafted(nodes: DataFrame, placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(na, nb, one column per sum): parts whose total per node is the sum over its subtree.

    Level j knows the totals inside tries of height 2**j. What hangs below the places where
    they were cut is summed per cut and passed to the 2**j nodes above it, which makes
    totals of tries twice as high. The nodes above come from the blocks of one
    conversation that goes through the cut.
    """
    names = list(sums)
    own = nodes.select(*NAME, *PARENT, "depth", "conv", *[e.cast("bigint").alias(s) for s, e in sums.items()])
    parts = [materialize(own)]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = [F.sum(s).alias(s) for s in names]
    j = 0
    while 1 << j < deepest:
        height = 1 << j
        hanging = [p.where((F.col("depth") - 1).bitwiseAND(F.lit(2 * height - 1)) == height) for p in parts]
        cuts = (
            reduce(DataFrame.unionByName, hanging).groupBy(*PARENT)
            .agg(F.min("conv").alias("conv"), (F.min("depth") - 1).alias("cut"), *totals)
            .withColumn("block", F.explode(F.sequence(F.shiftright(F.col("cut") - height, BLOCK_BITS), F.shiftright(F.col("cut") - 1, BLOCK_BITS))))
        )
        # a node above, and its own parent: the place before it, or the prefix of the block
        above = F.transform(
            "path",
            lambda x, i: F.struct(
                x["na"].alias("na"), x["nb"].alias("nb"), x["at"].alias("depth"),
                F.when(i == 0, F.col("ta")).otherwise(F.get("path", i - 1)["na"]).alias("pa"),
                F.when(i == 0, F.col("tb")).otherwise(F.get("path", i - 1)["nb"]).alias("pb"),
            ),
        )
        reached = F.filter(above, lambda x: (x["depth"] > F.col("cut") - height) & (x["depth"] <= F.col("cut")))
        found = cuts.drop(*PARENT).join(placed.select("conv", "block", "ta", "tb", "path"), ["conv", "block"])
        found = found.select("conv", *names, F.inline(reached))
        parts.append(materialize(found.groupBy(*NAME, *PARENT, "depth").agg(F.min("conv").alias("conv"), *totals)))
        j += 1
    return reduce(DataFrame.unionByName, [p.select(*NAME, *names) for p in parts])


def id_digests(ends: DataFrame) -> DataFrame:
    """(na, nb, ends_sha256): SHA-256 of the ascending comma-joined decimal ids of every name.

    Ids are sorted over all tasks, so a name with very many is spread; each task joins runs
    of ids into strings, and only those strings meet, streamed in order through the digest.
    """

    def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in columns])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(done):
            a, b, first, texts = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(texts)], ["na", "nb", "start", "ids"])

        done, held, name = [], [], None
        for a, b, conv in rows(batches, "na", "nb", "conv"):
            if held and (name != (a, b) or len(held) == RUN_IDS):
                done.append((*name, held[0], ",".join(map(str, held))))
                held = []
                if len(done) == RUN_IDS:
                    yield flush(done)
                    done = []
            name = (a, b)
            held.append(conv)
        if held:
            done.append((*name, held[0], ",".join(map(str, held))))
        if done:
            yield flush(done)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(done):
            a, b, found = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found)], ["na", "nb", "ends_sha256"])

        done, name, state = [], None, hashlib.sha256()
        for a, b, ids in rows(batches, "na", "nb", "ids"):
            if name == (a, b):
                state.update(b"," + ids.encode())
                continue
            if name:
                done.append((*name, state.hexdigest()))
                if len(done) == RUN_IDS:
                    yield flush(done)
                    done = []
            name, state = (a, b), hashlib.sha256(ids.encode())
        if name:
            done.append((*name, state.hexdigest()))
        if done:
            yield flush(done)

    order = [*NAME, "conv"]
    sorted_ids = ends.select(*order).repartitionByRange(range_partitions(ends), *order).sortWithinPartitions(*order)
    runs = sorted_ids.mapInArrow(join, "na bigint, nb bigint, start bigint, ids string")
    return runs.repartition(*NAME).sortWithinPartitions(*NAME, "start").mapInArrow(digest, "na bigint, nb bigint, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = as_they_are,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per node of the prefix trie of all conversations.

    conv_id (the smallest conversation through the node), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves (childless nodes in the subtree), saved_tokens
    (over the subtree, (n_convs - 1) * bytes of the node's text) and ends_sha256 (of the
    ids of the conversations that end there). Turns are in the order of ``turn``, null
    first; ``rebuild`` makes sequences of the numbered turns.

    Sequences are cut at half depth; cut prefixes get names; upper tries and lower forests
    are solved in the same round; totals are grafted upward in as many rounds as the depth
    has bits. Nodes are told apart by 128 hashed bits of their turns. No row holds more
    than BLOCK turns, and equal runs are one row after the first round, so neither a very
    long conversation nor one that was copied very often meets in one task.

    A null role or text is empty; a null conversation id is no conversation and its rows
    are left out. Turns of one number are ordered by role, then by a hash of the row;
    repeated rows are turns of their own. Texts of any length count by their bytes and
    hash only. A conversation without turns ends at the root. An empty table gives no rows.
    """
    turns = numbered(conversations, conv_column, turn_column, role_column, text_column)
    convs, sequences = rebuild(turns)
    convs = materialize(convs)
    placed = placed_blocks(sequences)
    nodes = materialize(trie_nodes(placed))
    sums = {"n_leaves": F.col("n") == F.col("ended"), "saved_tokens": (F.col("n") - 1) * F.col("bytes")}
    parts = grafted(nodes, placed, sums)

    zero = F.lit(0).cast("bigint")
    last = F.element_at("path", -1)
    ends = placed.where(last["at"] == F.col("length")).select(last["na"].alias("na"), last["nb"].alias("nb"), "conv")
    ends = ends.unionByName(convs.where("length = 0").select(zero.alias("na"), zero.alias("nb"), "conv"))
    # the whole table is the root's subtree; two rows of totals reach the driver
    below = nodes.agg(F.count(F.lit(1)).alias("nodes"), *[F.sum(e.cast("bigint")).alias(s) for s, e in sums.items()]).first()
    first, n = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    top = convs.sparkSession.range(1 if n else 0)
    leaves, saved = (below["n_leaves"], below["saved_tokens"]) if below["nodes"] else (1, 0)

    columns = {
        "conv": "bigint", "depth": "bigint", "pa": "bigint", "pb": "bigint", "n_convs": "bigint",
        "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string",
    }

    def facts(df: DataFrame, name: tuple[Column, Column], **known: Column | str) -> DataFrame:
        values = [(known[c] if c in known else F.lit(None)) for c in columns]
        values = [F.col(v) if isinstance(v, str) else v for v in values]
        return df.select(name[0].alias("na"), name[1].alias("nb"), *[v.cast(t).alias(c) for v, (c, t) in zip(values, columns.items())])

    name, parent, root = (F.col("na"), F.col("nb")), (F.col("pa"), F.col("pb")), (zero, zero)
    known = [
        facts(nodes, name, conv="conv", depth="depth", pa="pa", pb="pb", n_convs="n"),
        facts(nodes.groupBy(*PARENT).count(), parent, n_children="count"),
        facts(parts, name, n_leaves="n_leaves", saved_tokens="saved_tokens"),
        facts(id_digests(ends), name, ends_sha256="ends_sha256"),
        facts(top, root, conv=F.lit(first), depth=zero, n_convs=F.lit(n), n_leaves=F.lit(leaves), saved_tokens=F.lit(saved)),
    ]
    total = {"n_children", "n_leaves", "saved_tokens"}
    found = reduce(DataFrame.unionByName, known).groupBy(*NAME).agg(*[(F.sum(c) if c in total else F.max(c)).alias(c) for c in columns])
    found = materialize(found)
    deep = found.where("depth > 1").join(nodes.select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv").alias("parent")), PARENT)
    shallow = found.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(first)).cast("bigint"))
    nothing = hashlib.sha256(b"").hexdigest()
    return deep.unionByName(shallow).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
