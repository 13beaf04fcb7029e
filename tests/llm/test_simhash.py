"""SimHash components against all pairs, and the keys of the chains."""

import itertools
import random

import numpy as np
import pytest

from quarrylens.llm import simhash
from quarrylens.llm.simhash import BUDGETS, CHAIN, SEGMENTS, WIDTH, chained, keys_of_a_chain, simhash_duplicates, spanning

from .fixtures import awkward, documents, frame, prose, words_of
from .test_copies import Union, copies_of


def plain_print(text):
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    prints, union = [plain_print(text or "") for _, text in rows], Union()
    known = sorted({p for (i, _), p in zip(rows, prints) if i is not None})
    for a, b in itertools.combinations(known, 2):
        if (a ^ b).bit_count() <= 3:
            union.join(a, b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[union.find(p)] = min(i, least.get(union.find(p), i))
    return sorted(((i, f"{p:016x}", None if i is None else least[union.find(p)]) for (i, _), p in zip(rows, prints)), key=repr)


def tiny_edits(n):
    """Long texts one word apart: fingerprints a few bits apart, many in one bucket."""
    rng, words = random.Random(5), prose(9, 900).split()
    return [(i, " ".join([*words[: (k := rng.randrange(900))], f"w{rng.randrange(9)}", *words[k + 1 :]])) for i in range(n)]


@pytest.mark.parametrize("part,hot", [(simhash.PART, simhash.HOT), (3, 2)])
@pytest.mark.parametrize("source", ["awkward", "copies", "edits", "data", "empty"])
def test_components(spark, data, monkeypatch, source, part, hot):
    rows = {
        "awkward": lambda: awkward() + [(1, "an unrelated text under the first id")], "copies": lambda: copies_of(3, 60, 12) + copies_of(4, 40, 5),
        "edits": lambda: tiny_edits(150), "data": lambda: documents(data), "empty": list,
    }[source]()
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "HOT", hot)
    got = simhash_duplicates(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_every_close_pair_shares_a_key_and_keeps_its_chain():
    assert BUDGETS == [0, 0, 1, 1, 1, 2, 2, 3]
    rng = random.Random(2)
    for _ in range(5000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        dirty = [x >> WIDTH * i & (1 << WIDTH) - 1 != 0 for i in range(SEGMENTS)]
        starts = {s for s in range(SEGMENTS) for places in keys_of_a_chain(BUDGETS, CHAIN) if not any(dirty[(s + p) % SEGMENTS] for p in places)}
        assert any(len(chained(np.array([x], np.uint64), s)) for s in starts)


def test_spanning_links_join_what_pairs_join():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(52))
    union, found = Union(), Union()
    for a, b in itertools.combinations(points.tolist(), 2):
        if (a ^ b).bit_count() <= 3 and len(chained(np.array([a ^ b], np.uint64), 0)):
            union.join(a, b)
    links = spanning(0, points, None)
    for a, b in links:
        found.join(a, b)
    assert len(links) < len(points) and all(found.find(p) == union.find(p) for p in points.tolist())
