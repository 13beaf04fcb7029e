"""Aligned tokenizers against both libraries, token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quarrylens.llm.alignment import A, B, Aligner, align_tokenizers, byte_characters, gallop, token_groups
from quarrylens.llm.common import tokenizer_path

from .fixtures import awkward, documents, frame

ODD = ["a▁b c", " lead", "trail ", "a  b", "a \n b", "<s> </s> <unk> <0x41>", "▁", "é 힣 😀", "\0a b\0", " ", "\n\n", "a b 　c", "﻿x", "ﬁ ½"]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    left, right, of = Tokenizer.from_file(tokenizer_path(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B)), byte_characters()
    left.encode_special_tokens = True

    def a(text):
        ids = left.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(of[c] for c in left.id_to_token(i)) for i in ids]

    def b(text):
        ids = right.encode(text)
        return ids, [bytes([int(right.id_to_piece(i)[3:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return a, b


def plain_groups(sides, text):
    """[(a ids, b ids)] of every group; none for a text that a side does not give back."""
    found = [side(text) for side in sides] if text else []
    if not text or any(b"".join(tokens) != b" " + text.encode() for _, tokens in found):
        return []
    ends = [np.cumsum([len(t) for t in tokens]).tolist() for _, tokens in found]
    cuts = [[0] + [e.index(x) + 1 for x in sorted(set(ends[0]) & set(ends[1]))] for e in ends]
    return [tuple(ids[c[g - 1] : c[g]] for (ids, _), c in zip(found, cuts)) for g in range(1, len(cuts[0]))]


def plain(sides, rows):
    groups = [plain_groups(sides, text or "") for _, text in rows]
    links = [[(a[-1], b[-1]) for a, b in g] for g in groups]
    counts, most = Counter(x for pairs in links for x in pairs), Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), g, pairs in zip(rows, groups, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs), sum(counts[p] == most[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("source", ["awkward", "data", "empty"])
def test_alignment(spark, data, sides, source):
    rows = {"awkward": lambda: awkward() + [(100 + i, t) for i, t in enumerate(ODD)], "data": lambda: documents(data), "empty": list}[source]()
    df = frame(spark, rows).repartition(5)
    got = align_tokenizers(df).collect()
    assert sorted(map(tuple, got), key=repr) == plain(sides, rows)


def test_groups_are_ranges_of_both_sides(spark, sides):
    rows = awkward()
    for r in token_groups(frame(spark, [x for x in rows if x[0]])).collect():
        cuts = [list(zip([0, *r[e]], r[e])) for e in ("a_ends", "b_ends")]
        found = [(r["a_ids"][i:j], r["b_ids"][k:m]) for (i, j), (k, m) in zip(*cuts)]
        assert found in [plain_groups(sides, t or "") for i, t in rows if i == r["doc_id"]]


def test_gallop_finds_the_first_place_from_anywhere():
    rng = np.random.default_rng(0)
    for _ in range(500):
        into, keys = np.unique(rng.integers(0, 300, rng.integers(1, 80))), np.sort(rng.integers(-3, 310, rng.integers(0, 50)))
        assert (gallop(keys, into, rng.integers(0, len(into), len(keys))) == np.searchsorted(into, keys)).all()


def test_pairs_are_bounded_by_the_vocabularies():
    """Of two tokens that end together one is the end of the other: what the broadcast counts can hold at most."""
    tool = Aligner(tokenizer_path(A), tokenizer_path(B))
    a, b = Counter(tool.a_bytes), Counter(tool.b_bytes)
    pairs = sum(n * b[t[i:]] for t, n in a.items() for i in range(len(t))) + sum(n * a[t[i:]] for t, n in b.items() for i in range(1, len(t)))
    assert pairs <= 2 * int(tool.a_sizes.sum() + tool.b_sizes.sum()) and pairs * 16 < 16 << 20


def test_words_are_checked_by_their_bytes_all_at_once():
    """A word that its tokens do not give back is found, by length or by bytes, and those next to it still fit."""
    tool = Aligner(tokenizer_path(A), tokenizer_path(B))
    words = ["plain", "a▁b", "words", "日本", "x", "😀"]
    expected = np.frombuffer("".join(" " + w for w in words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) + 1 for w in words])
    for side, coded in enumerate((tool.left._chunks(words), tool._words(words))):
        given = [np.frombuffer(ids, "<u4").astype(np.int64) for ids in coded]
        given[2] = given[0]  # as long as its word, other bytes
        want = [tool._same(ids.astype("<u4").tobytes(), (tool.a_bytes, tool.b_bytes)[side], w) for ids, w in zip(given, words)]
        assert want == [True, side == 0, False, True, True, True]
        got = tool._fitting(side, np.concatenate(given), np.array([len(ids) for ids in given]), expected, sizes)
        assert got.tolist() == want
