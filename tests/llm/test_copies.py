"""Line dedup, near-dedup, suffix dedup and decontamination against all-pairs versions."""

import hashlib
import itertools
import random
import re
import time
from collections import defaultdict

import pytest

from quarrylens.llm import decontaminate
from quarrylens.llm.components import components
from quarrylens.llm.decontaminate import find_leaks
from quarrylens.llm.line_dedup import dedup_lines
from quarrylens.llm.near_dedup import near_duplicates
from quarrylens.llm.suffix_dedup import remove_repeats

from .fixtures import awkward, by_id, documents, expected, frame, prose, words_of


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def copies_of(seed, n, edits):
    """A text and edited copies of it, ids from seed * 1000."""
    rng, base = random.Random(seed), prose(seed, 90).split()
    out = [(seed * 1000, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
        out.append((seed * 1000 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)] + [(500, 501)]])
def test_components(spark, links):
    union = Union()
    for a, b in links:
        if None not in (a, b) and a != b:
            union.join(a, b)
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: union.find(x) for x in list(union)}
    assert len(got) == len(union)


def sets(text, size):
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@pytest.mark.parametrize("size,source", [(2, "awkward"), (5, "awkward"), (2, "copies"), (5, "data")])
def test_near_duplicates(spark, data, size, source):
    rows = {"awkward": awkward, "copies": lambda: copies_of(3, 60, 12) + copies_of(4, 40, 5), "data": lambda: documents(data)}[source]()
    texts = {i: t or "" for i, t in rows if i is not None}
    found, union = {i: sets(t, size) for i, t in texts.items()}, Union()
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = found[a], found[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            union.join(a, b)

    def judge(i, text):
        component = i if i is None else union.find(i)
        return len(sets(text, size)), component, i == component

    got = near_duplicates(frame(spark, rows), size=size).collect()
    assert by_id(got, "n_shingles", "component_id", "kept") == expected(rows, judge)


def plain_lines(rows):
    mark = re.compile(r"[^ \t\n\x0b\x0c\r]")
    shingles = lambda line: {line[i : i + 10] for i in range(max(1, len(line) - 9))}
    places = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for k, line in enumerate((text or "").split("\n")):
                if mark.search(line):
                    places[line].add((i, k))
    found, union = {x: shingles(x) for x in places}, Union()
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

    def judge(i, text):
        lines = (text or "").split("\n")
        counted = sum(bool(mark.search(x)) for x in lines)
        if text is None:
            return 0, 0, None
        return counted, len(drop[i]), "\n".join(x for k, x in enumerate(lines) if k not in drop[i])

    return judge


UNBROKEN = [
    (1, "https://example.com/a/one\nhttps://example.org/b/two"), (2, "2024-01-01,ABC,5,12.50\n2024-01-01,XYZ,9,77.10"),
    (3, "x" * 700 + "A" + "y" * 700), (4, "x" * 700 + "B" + "y" * 700), (5, "".join(f"{i:04}" for i in range(400))), (6, "".join(f"{i:04}" for i in range(400)) + "!"),
    (7, "日本語の長い行です、最初の十文字は同じ。終わりだけ違う"), (8, "日本語の長い行です、最初の十文字は同じ。別の終わり方をする"), (9, "short"), (10, "shorT"), (11, "short"),
]


@pytest.mark.parametrize("source", ["awkward", "copies", "unbroken", "data"])
def test_line_dedup(spark, data, source):
    rows = {"awkward": awkward, "copies": lambda: copies_of(5, 50, 8), "unbroken": lambda: UNBROKEN, "data": lambda: documents(data)}[source]()
    df = frame(spark, rows)
    got = dedup_lines(df)
    assert got.columns == df.columns + ["lines", "dropped_lines"]
    judge = plain_lines(rows)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(judge(i, t))
    assert by_id(got.collect(), "lines", "dropped_lines", "text") == {k: sorted(v, key=repr) for k, v in want.items()}


def plain_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted({(i if i is not None else -1, t or "") for i, t in rows}):
        data, mark = text.encode(), [False] * len(text.encode())
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                mark[p : p + length] = [True] * length
            seen.add(data[p : p + length])
        out[i, text] = data, mark
    return lambda i, text: summary(*out[i if i is not None else -1, text])


def summary(data, mark):
    kept = bytes(b for b, m in zip(data, mark) if not m)
    runs = sum(m and not before for m, before in zip(mark, [False, *mark]))
    return len(data), sum(mark), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("source", ["awkward", "copies", "data"])
def test_suffix_dedup(spark, data, source):
    rows = {"awkward": awkward, "copies": lambda: copies_of(6, 40, 6) + [(9000, "ab" * 500), (9001, "é" * 99), (9002, "é" * 120)], "data": lambda: documents(data)}[source]()
    rows = [r for r in rows if r[0] is not None or r[1] is not None]
    got = []
    for r in remove_repeats(frame(spark, rows)).collect():
        kept = bytes(r["kept"])
        got.append(dict(doc_id=r["doc_id"], n=r["n_bytes"], gone=r["n_bytes"] - len(kept), runs=len(r["spans"]), sha=hashlib.sha256(kept).hexdigest()))
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(kept)
    assert by_id(got, "n", "gone", "runs", "sha") == expected(rows, plain_repeats(rows))


def edited(text, edits, rng):
    text = list(text)
    for _ in range(edits):
        p = rng.randrange(len(text))
        text[p] = rng.choice(["", "q", text[p] + "z"])
    return "".join(text)


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfgk" for b in "aeiou" for c in ["l", "n", "rt", "st"]]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(12, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "too short"), (None, text(30)), (0, text(40))]
    docs, want = [], set()
    for d in range(150):
        body = text(rng.randint(0, 300))
        if d % 3 == 0:
            item, passage = rng.choice([x for x in items if x[1] and len(x[1]) > 40])
            passage = edited(passage, rng.randint(0, len(passage) // 40), rng).upper()
            cut = rng.randrange(len(body) + 1)
            body = body[:cut] + " \n" + passage + "\t " + body[cut:]
            want.add((d, item))
        docs.append((d, body))
    docs += [(None, items[1][1]), (500, None), (501, "")]
    want.add((None, 1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(frame(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want)
    for r in got:
        plain = " ".join(b"".join([dict(docs)[r["doc_id"]].encode().lower()]).decode().split())
        assert plain[r["start"] : r["stop"]] == r["matched"]


def test_leaks_in_blocks(spark, monkeypatch):
    """The same rows, however many blocks there are: equal, missing and repeated ids on both sides."""
    rows = [(i if i % 5 else None, prose(i, 60)) for i in range(40)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1]), (None, rows[9][1]), (50, rows[1][1] + " in between " + rows[12][1]), (51, None)]
    items = [(i % 7 or None, rows[i][1][: 60 + 13 * i]) for i in range(20)] + [(3, rows[25][1]), (3, rows[25][1]), (99, "under"), (99, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, find_leaks(frame(spark, rows), bench).collect()), key=repr)
    assert len(whole) > 40
    for size in (1500, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(map(tuple, find_leaks(frame(spark, rows), bench).collect()), key=repr) == whole


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    """A unique text stays, though another row of its id is a copy."""
    a, b = prose(41, 60), prose(42, 60)
    got = remove_repeats(frame(spark, [(1, a), (2, a), (2, b), (None, prose(43, 60)), (None, prose(44, 60))])).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"]) == r["n_bytes"]) for r in got) == [(0, True), (0, True), (1, True), (2, False), (2, True)]


def test_nothing(spark):
    none = frame(spark, [])
    assert dedup_lines(none).count() == near_duplicates(none).count() == remove_repeats(none).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(none, bench).count() == find_leaks(frame(spark, awkward()), bench).count() == 0


def test_line_dedup_has_no_python_by_row(spark, data):
    plan = dedup_lines(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowConverters", "")


def test_line_names_are_those_of_spark(spark):
    from quarrylens.llm.line_dedup import Signer

    lines = ["", "a", "été 日本 😀", "x" * 100, "\0"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("line", "xxhash64(line) AS h1", "xxhash64(1, line) AS h2")
    seed = spark.sql("SELECT xxhash64(1)").first()[0] % 2**64
    assert {r["line"]: (r["h1"], r["h2"]) for r in rows.collect()} == {x: (int(a), int(b)) for x, a, b in zip(lines, *Signer(seed).names(lines))}


def test_line_dedup_holds_little_between_its_steps(spark, monkeypatch):
    """No shuffle file outlives the step that reads it, and lines to compare are held as texts, not as their many shingles."""
    from pathlib import Path

    from quarrylens.llm import line_dedup

    rows = [(i, f"{i} " + prose(60 + i % 90, 600)) for i in range(360)]
    held, drop = [], line_dedup.Scratch.drop
    blocks = [Path(d.toString()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p for d in blocks for p in d.rglob("shuffle_*.data")}
    before = shuffled()

    def measured(scratch):
        held.append(sum(p.stat().st_size for p in Path(scratch.folder).rglob("*.parquet")))
        drop(scratch)

    monkeypatch.setattr(line_dedup.Scratch, "drop", measured)
    got = dedup_lines(frame(spark, rows, clashes=False))
    assert held[0] < 2 * sum(len(t) for _, t in rows)
    for _ in range(50):  # they are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert spark.conf.get(line_dedup.CLEANUP) == "false"
    assert sum(r["lines"] - r["dropped_lines"] for r in got.collect()) == 90


def test_line_dedup_has_no_python_in_any_step(spark, monkeypatch):
    """Every table written between the steps comes from DataFrame functions; copies, near copies and short lines are linked."""
    from quarrylens.llm import line_dedup

    plans, store = [], line_dedup.Scratch.store

    def seen(scratch, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(scratch, df)

    monkeypatch.setattr(line_dedup.Scratch, "store", seen)
    rows = copies_of(8, 30, 6) + [(1, "-" * 40), (2, "-" * 300), (3, "0123456789"), (4, "0123456789"), (5, "012345678"), (6, "😀" * 12 + "é")]
    got = {r["doc_id"]: r["dropped_lines"] for r in dedup_lines(frame(spark, rows, clashes=False)).collect()}
    assert len(plans) > 10 and not [p for p in plans if "MapInArrow" in p or "GroupsInArrow" in p or "Python" in p]
    assert got == {i: plain_lines(rows)(i, t)[1] for i, t in rows} and (got[1], got[2], got[4]) == (0, 1, 1)


def test_long_lines_are_signed_by_a_sample_and_unlike_ones_ruled_out_by_sketch(spark, monkeypatch):
    """Only lines with few spaces are hashed at every place for signatures, and pairs below the threshold are seldom verified."""
    from quarrylens.llm import line_dedup

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    base = [word() for _ in range(120)]

    def variant(changes):
        out = list(base)
        for i in rng.sample(range(len(out)), changes):
            out[i] = word()
        return " ".join(out)

    rows = [(i, variant(8)) for i in range(60)] + [(100, " ".join(base)), (101, "x" * 300), (102, " ".join(base[:5])), (103, "x" * 299 + "y")]
    rows += [(104, " ".join(base[:20])), (105, " ".join(base[:21]))]  # one of many spaces, one of few
    seen, check = [], line_dedup.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    df = frame(spark, rows, clashes=False)
    signed = {r["doc_id"]: (r["s0"] is not None, r["p0"] is not None) for r in line_dedup.signed(line_dedup.lines_of(df)).collect()}
    assert signed[100] == signed[0] == (True, False) and signed[101] == signed[102] == (False, True) and signed[104] == (True, True)
    judge = plain_lines(rows)
    assert {r["doc_id"]: r["dropped_lines"] for r in dedup_lines(df).collect()} == {i: judge(i, t)[1] for i, t in rows}
    assert sum(seen[1:]) < 60  # of 1,770 pairs of variants, all of which are alike by over 0.6

    texts = spark.createDataFrame(rows, "id long, line string")
    sets = {i: {t[k : k + 10] for k in range(max(1, len(t) - 9))} for i, t in rows}
    found = {r["id"]: r for r in line_dedup.sketches(texts).collect()}
    assert {i: r["shingles"] for i, r in found.items()} == {i: len(x) for i, x in sets.items()}
    bits = lambda r: sum((r[f"t{i}"] % (1 << 64)) << 64 * i for i in range(line_dedup.LONGS))
    for a, b in [(0, 1), (2, 100), (3, 102), (101, 103)]:
        assert 0 < (bits(found[a]) ^ bits(found[b])).bit_count() <= len(sets[a] ^ sets[b])
