"""Scoring, license scan and quality rules against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from quarrylens.llm import quality as rules
from quarrylens.llm.common import tokenizer_path
from quarrylens.llm.license_scan import BASE_PHRASES, EDIT_SHARE, NOTICES, Scanner, scan_licenses
from quarrylens.llm.scoring import MARK, Lattice, Pieces, score_documents

from .fixtures import awkward, by_id, documents, expected, frame, prose, words_of


@pytest.fixture(scope="module")
def pieces():
    return Pieces(tokenizer_path("piece_bpe_32k.model"))


def plain_lattice(pieces, logs, word):
    index = {}
    for text, log in zip(pieces.texts, logs):
        if text is not None:
            index.setdefault(text, []).append(log)
    total = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 48), j):
            for log in index.get(word[i:j], ()):
                total[j] = np.logaddexp(total[j], total[i] + log)
    return total[-1]


def test_lattice_sums_all_segmentations(pieces):
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces.texts))))
    words = [MARK + w.encode() for w in ["the", "thehestion", "日本é", "a" * 60, "", "\0ÿ", "x" * 3000]]
    got = Lattice(pieces.texts, logs).score(words)
    for word, value in zip(words, got):
        assert abs(plain_lattice(pieces, logs, word) - value) < 1e-8 * max(1, len(word))


@pytest.mark.parametrize("source", ["awkward", "data"])
def test_scores(spark, data, pieces, source):
    rows = awkward() if source == "awkward" else documents(data)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t in rows if not held(i) for w in words_of(t or ""))
    docs = sum(not held(i) for i, _ in rows)
    tokens, types = sum(train.values()) + docs, len(train) + 1
    # the model, plainly: piece frequencies by the library, then the sum over segmentations
    found = np.ones(len(pieces.texts))
    for word, n in train.items():
        for i in pieces.library.encode(word.decode()):
            found[i] += n
    total = found.sum() - len(found) + docs + len(found) + 1
    logs, end = np.log(found / total), math.log10((docs + 1) / total)
    words = sorted({w for _, t in rows for w in words_of(t or "")})
    value = dict(zip(words, Lattice(pieces.texts, logs).score([MARK + w for w in words]) / math.log(10)))

    def judge(i, text):
        w = words_of(text)
        base = sum(math.log10((train[x] + 1) / (tokens + types + 1)) for x in w) + math.log10((docs + 1) / (tokens + types + 1))
        return held(i), len(w) + 1, sum(x in train for x in w) + 1, tokens, round(base, 5), round(sum(value[x] for x in w) + end, 5)

    got = [r.asDict() for r in score_documents(frame(spark, rows)).collect()]
    for r in got:
        r["base_score"], r["score"] = round(r["base_score"], 5), round(r["score"], 5)
    assert by_id(got, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score") == expected(rows, judge)


def test_scores_of_nothing(spark):
    assert score_documents(frame(spark, [])).count() == 0


def test_trained_pieces_beat_equal_ones(spark, data, pieces):
    """Held-out texts are likelier under the trained weights than under equal ones."""
    rows = documents(data)
    got = {r["doc_id"]: r for r in score_documents(frame(spark, rows)).collect()}
    equal = Lattice(pieces.texts, np.full(len(pieces.texts), -math.log(len(pieces.texts) + 1)))
    better = [got[i]["score"] > equal.score([MARK + w for w in words_of(t)]).sum() / math.log(10) for i, t in rows if got[i]["held_out"] and len(t) > 200]
    assert better and all(better)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("source", ["awkward", "data"])
def test_license_phrases(spark, data, source):
    rows = awkward() if source == "awkward" else documents(data)
    rows = rows + [(900, "gnu general public license gnu general public license"), (901, "Licensed CC-BY\nCC BY; Apache License.")]

    def judge(_, text):
        words = plain_words(text)
        places = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        return len(words), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places})

    got = scan_licenses(frame(spark, rows)).collect()
    assert by_id(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == expected(rows, judge)
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in got)
    assert scan_licenses(frame(spark, [])).count() == 0


def test_license_notices_with_edits():
    """Whatever a search without seeds finds, the seeded one finds, with the edits it reports."""
    scanner = Scanner(BASE_PHRASES, NOTICES, EDIT_SHARE)
    import random

    rng = random.Random(4)
    for notice, label in NOTICES.items():
        for _ in range(40):
            edits, text = rng.randint(0, len(notice) // EDIT_SHARE), list(notice)
            for _ in range(edits):
                p = rng.randrange(len(text))
                text[p] = rng.choice(["", "q", text[p] + "z"])
            whole = prose(rng.random(), 40) + " " + "".join(text) + " " + prose(rng.random(), 40)
            padded = " " + " ".join(plain_words(whole)) + " "
            plain = regex.search(f"(?b)(?:{notice}){{e<={len(notice) // EDIT_SHARE}}}", padded)
            spans = [s for s in scanner.scan(whole)["spans"] if s["notice"] == notice]
            assert bool(plain) == bool(spans)
            if spans:
                assert min(s["edits"] for s in spans) <= sum(plain.fuzzy_counts)
                words = plain_words(whole)
                for s in spans:
                    assert " ".join(words[s["first_word"] : s["last_word"] + 1]).find(s["matched"]) >= 0


def plain_quality(_, text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars, symbols = sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text))
    n, again, same = len(words), len(covered), len(lines) - len(set(lines))
    failed = n < 50 or 100 * again > 50 * n
    bad = failed or 10 * symbols > n or 2 * same > len(lines) or 10 * len(regex.findall(r"\p{Lu}", text)) > 4 * chars or 2 * text.count("!") > n
    return n, chars, symbols, same, again, failed, not bad


@pytest.mark.parametrize("source", ["awkward", "data"])
def test_quality(spark, data, source):
    rows = awkward() if source == "awkward" else documents(data)
    df = frame(spark, rows)
    got = rules.quality(df)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    assert by_id(got.collect(), *names) == expected(rows, plain_quality)
    kept = rules.keep_good(df)
    assert kept.columns == df.columns
    want = sorted((i, t) for i, t in ((i, t) for i, t in rows if i is not None) if plain_quality(i, t or "")[-1])
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == want


def test_quality_order_does_not_matter(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    feature = lambda name: rules.FEATURES[name](F.col("text"))
    for order in (list(rules.RULES), list(rules.RULES)[::-1]):
        kept = docs.where(rules.first_rejection(feature, rules.RULES, order).isNull()).count()
        assert kept == rules.keep_good(docs).count()


def test_quality_of_nothing_and_native(spark, data):
    assert rules.quality(frame(spark, [])).count() == rules.keep_good(frame(spark, [])).count() == 0
    plan = rules.quality(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
