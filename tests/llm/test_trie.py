"""The prefix trie against sets of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import prefix_trie as trie
from quarrylens.llm.prefix_trie import as_they_are, prefix_trie, with_shared_starts

from .fixtures import CLASHES

SCHEMA = "conv_id bigint, turn int, role string, text string"


def sequences(rows, shared):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in convs.items()}
    if not shared:
        return convs
    starts = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - int(math.fmod(c, 5)), [])[:h] + convs[c][h:] for c, h in starts.items()}


def plain(rows, shared):
    new = sequences(rows, shared)
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, inside in members.items():
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children[prefix]
            saved[prefix[:d]] += (len(inside) - 1) * len(prefix[-1][1].encode()) if prefix else 0
    out = []
    for prefix, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(new[c]) == len(prefix))
        out.append((min(inside), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(inside), children[prefix],
                    leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some(seed, lengths=(0, 1, 2, 3, 9, 16, 17, 33, 70, 130)):
    """Conversations of a few texts, so that they share starts of any length; some null, negative and long ones."""
    rng, rows = random.Random(seed), []
    for c in [*range(60), 2**62, -3, None]:
        n, k, late = rng.choice(lengths), rng.randrange(3), rng.choice([20, 60])
        for i in range(n):
            text = f"t{k if i < n - 1 else rng.randrange(2)}é"
            rows.append((c, None if i == 0 and c == 7 else i, rng.choice(["u", None]) if i > late else "u", rng.choice([text, text, None]) if i > 90 else text))
    return rows


ONE_START = [(c, t, "user", f"{t if t < 40 else c * 100 + t}") for c in range(30) for t in range(45)]
COPIES = [(c, t, "user", "same " * 300) for c in range(200) for t in range(3)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit(i) for i, name in enumerate([*CLASHES, "conv", "pos", "at", "na", "pa", "path", "depth"])})


@pytest.mark.parametrize("rows", [some(1), some(2, (1, 2, 8)), ONE_START, COPIES, [], [(None, 0, "a", "b")], [(4, 0, None, None)], [(7, 0, "a", "b")]])
@pytest.mark.parametrize("shared", [False, True])
def test_prefix_trie(spark, rows, shared):
    got = prefix_trie(frame(spark, rows), with_shared_starts if shared else as_they_are).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, shared)


def test_turns_of_one_number_and_repeated_rows(spark):
    """Their order is fixed by role and a hash; repeated rows are turns of their own."""
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")]
    got = {(r["depth"], r["conv_id"], r["n_convs"]) for r in prefix_trie(frame(spark, rows)).collect()}
    assert got == {(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2)}


def test_digests_in_pieces(spark, monkeypatch):
    ids = [*range(-20, 500), 10**17]
    df = spark.createDataFrame([(i % 2, 0, c) for i, c in enumerate(ids)], "na bigint, nb bigint, conv bigint")
    want = {k: hashlib.sha256(",".join(map(str, ids[k::2])).encode()).hexdigest() for k in (0, 1)}
    assert {r["na"]: r["ends_sha256"] for r in trie.id_digests(df.repartition(7)).collect()} == want
