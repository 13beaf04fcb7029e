"""Line dedup over every character, and parts of benchmark texts."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylens.llm import near_dedup
from quarrylens.llm.decontaminate import find_leaks
from quarrylens.llm.line_dedup import dedup_lines
from quarrylens.llm.quality import FEATURES

from .fixtures import awkward, by_id, documents, frame
from .test_copies import Union, copies_of, edited


def windows_of(line):
    return {line[i : i + 10] for i in range(max(1, len(line) - 9))}


def plain_lines(rows):
    places = defaultdict(set)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if i is not None and line.strip(" \t\x0b\x0c\r"):
                places[line].add((i, k))
    found, union = {x: windows_of(x) for x in places}, Union()
    for a, b in itertools.combinations(sorted(places), 2):
        x, y = found[a], found[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            union.join(a, b)
    groups, drop = defaultdict(set), defaultdict(set)
    for line, where in places.items():
        groups[union.find(line)] |= where
    for where in groups.values():
        for i, k in sorted(where)[1:]:
            drop[i].add(k)
    return lambda i, text: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop[i])


@pytest.mark.parametrize("source", ["awkward", "copies", "data"])
def test_line_dedup_of_every_place(spark, data, source):
    rows = {"awkward": awkward, "copies": lambda: copies_of(5, 50, 8), "data": lambda: documents(data)}[source]()
    rows += [(10**6 + i, "https://example.com/a/one" + "x" * i + "\n2024-01-01,ABC,5,12.50\r") for i in range(3)] + [(10**7, "q\x1c\u0085")]
    judge, want = plain_lines(rows), defaultdict(list)
    for i, t in rows:
        want[i].append((judge(i, t),))
    got = dedup_lines(frame(spark, rows)).collect()
    assert by_id(got, "text") == {k: sorted(v, key=repr) for k, v in want.items()}


def test_pipeline_keeps_spaceless_lines_that_differ_late(spark, data):
    lines = ["https://example.com/a/one", "https://example.org/b/two", "2024-01-01,ABC,5,12.50", "2024-01-01,XYZ,9,77.10"]
    lines += ["这是一个很长的句子开头今天天气非常好", "这是一个很长的句子开头明天我们去北京"]
    copy = "https://example.net/" + "abcdefghijklmnopqrstuvwxyz" * 4
    rows = list(enumerate([*lines, copy, copy + "0"]))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), data).collect()}
    assert got == dict(rows[:-1])


def test_leaks_of_any_part(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfgk" for b in "aeiou" for c in ["l", "n", "rt", "st"]]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(20, 120))) for i in range(40)]
    docs, want = [], set()
    for d in range(300):
        item, whole = rng.choice(items)
        size = rng.randint(63, min(170, len(whole)))
        start = rng.randrange(len(whole) - size + 1)
        part = whole[start : start + size]
        if size > 80:
            part = edited(part, 1, rng)
        docs.append((d, text(rng.randint(0, 100)) + "\n" + part + " " + text(rng.randint(0, 100))))
        want.add((d, item))
    got = find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_leaks_keep_whole_probes(spark):
    """Edits that crowd every short probe of a text, but fit in the text."""
    item = copies_of(7, 1, 0)[0][1][:100]
    doc = item[:42] + "".join("#" if i % 2 else c for i, c in enumerate(item[42:56])) + item[56:]
    got = find_leaks(frame(spark, [(1, doc)]), spark.createDataFrame([(3, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(1, 3, 7)]


def test_leaks_of_short_items(spark):
    items = [(1, "Who wrote  Hamlet?"), (2, "7 x 8"), (3, "他是谁"), (4, "who wrote hamlet?"), (5, ""), (6, None), (7, "x" * 39), (8, "café")]
    docs = [
        (1, "He asked: who WROTE\nHamlet?\" twice"), (2, "who wrote hamlets?"), (3, "17 x 8 and 7 x 80"), (4, "(7 x 8)"), (5, "请问他是谁呢"),
        (6, "x" * 40), (7, "-" + "X" * 39), (8, "7 x 8"), (9, ""), (10, "cafés"), (11, "two cafés, one café"),
    ]
    got = find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (1, 4), (4, 2), (5, 3), (7, 7), (8, 2), (11, 8)]
    assert {r["doc_id"]: (r["start"], r["stop"], r["matched"]) for r in got}[11] == (15, 19, "café")


@pytest.mark.parametrize("text,repeated", [("a b c d e f g h", 0), ("a b c d a b c x y", 6), ("a a a a", 4), ("a b c x a b d x c b a", 0)])
def test_repeated_words_count_no_equal_hashes(spark, monkeypatch, text, repeated):
    with monkeypatch.context() as patch:
        patch.setattr(F, "xxhash64", lambda *columns: F.lit(1).cast("bigint"))
        found = FEATURES["n_repeat_words"](F.col("text"))
    assert frame(spark, [(1, text)]).select(found.alias("n")).first()["n"] == repeated


def test_near_duplicates_lose_few_links():
    """Binomial tail of the estimate and miss of all bands, for a pair at the threshold."""
    n, chance = near_dedup.MINIMA, 2.0**-near_dedup.BITS
    equal, least = 0.8 + 0.2 * chance, 0.8 - near_dedup.MARGIN
    ruled_out = sum(
        math.comb(n, k) * equal**k * (1 - equal) ** (n - k) for k in range(n + 1) if (k / n - chance) / (1 - chance) < least
    )
    missed = (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS
    assert ruled_out < missed and ruled_out + missed < 1e-7
