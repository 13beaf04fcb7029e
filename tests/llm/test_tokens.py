"""Token files, counts and packing against the libraries, and exact round trips."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm.common import tokenizer_path
from quarrylens.llm.packing import assign, capacities, pack
from quarrylens.llm.token_counts import Merger, count_tokens
from quarrylens.llm.token_files import BLOCK, pack_bits, token_table, unpack

from .fixtures import awkward, by_id, documents, expected, frame


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: [*tool.encode(text, add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 24, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 2 * BLOCK + 77).astype("<u4")
    payload, offsets = pack_bits(ids, width)
    assert len(payload) <= len(ids) * width // 8 + len(offsets)
    for a, b in [(0, len(ids)), (BLOCK - 3, BLOCK + 3), (5, 5), (len(ids) - 1, len(ids))]:
        assert (unpack(payload, width, offsets, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("source", ["awkward", "data"])
def test_token_files(spark, data, encode, source):
    rows = awkward() if source == "awkward" else documents(data)
    got = token_table(frame(spark, rows)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert by_id(got, "n_tokens", "crc") == expected(rows, lambda _, t: (len(encode(t)), crc(encode(t))))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_of_nothing(spark):
    assert token_table(frame(spark, [])).count() == 0


@pytest.mark.parametrize("source", ["awkward", "data"])
def test_counts_are_the_library_s(spark, data, source):
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = awkward() if source == "awkward" else documents(data)
    got = count_tokens(frame(spark, rows)).collect()

    def judge(_, text):
        n = len(tool.encode(text))
        return len(text.encode()), n, n > 4096

    assert by_id(got, "n_bytes", "n_tokens", "over_limit") == expected(rows, judge)
    assert count_tokens(frame(spark, [])).count() == 0


def test_merging_in_every_order():
    """Pieces that a later merge would overtake, ties, overlaps and bytes."""
    import random

    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    tool, mine = sentencepiece.SentencePieceProcessor(model_file=path), Merger(path)
    rng = random.Random(5)
    parts = ["th", "he", "ing", "ti", "on", "was", "jQuery", "=", "==", "----", " ", "  ", "▁", "é", "日", "😀", "\n", "<s>", "a"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(2000)] + ["ha" * 500, " " * 77, "aaa" * 99]
    assert mine.count_texts(texts) == [len(x) for x in tool.encode(texts)]


@pytest.mark.parametrize("source", ["awkward", "data"])
def test_packing(spark, data, encode, source):
    rows = awkward() if source == "awkward" else documents(data)
    got = pack(frame(spark, rows)).collect()
    texts, sequences = {}, {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in rows:
        ids = encode(text or "")
        pieces = {(r["start"], r["length"], bytes(r["ids"])) for r in texts[doc_id]}
        # rows that share an id may be cut at different places: each token must be there
        assert sum(r["length"] for r in texts[doc_id]) == sum(len(encode(t or "")) for i, t in rows if i == doc_id)
        if sum(i == doc_id for i, _ in rows) == 1:
            joined = b"".join(x for _, _, x in sorted(pieces))
            assert np.frombuffer(joined, "<u4").tolist() == ids and texts[doc_id][0]["doc_tokens"] == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] * 4 == len(r["ids"])
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0  # nothing to pad


def test_packing_balances_cost():
    lengths = [1000, 24, 600, 424, 500, 524] + [64] * 160
    room, pieces = capacities(sum(lengths), 1024), assign(lengths, 1024, 1 / 1024)
    cost = [0.0] * len(room)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 1024
    full = [c for c, r in zip(cost, room) if r == 1024]
    assert sum(r for r in room) == sum(lengths) and max(full) < 2 * min(full)


def test_packing_nothing(spark):
    assert pack(frame(spark, [])).count() == 0


def test_packing_takes_no_memory_of_other_operators_along(spark):
    """A Python worker is used by one stage after another; what an earlier one has built goes before packing builds its own."""
    import sys

    from quarrylens.llm.packing import ARROW, pack

    ran = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            ran.append(run)

    kept = sys.__dict__.setdefault("_quarrylens_kept", {})
    before = dict(kept)
    kept.update(probes=("a", object()), aligner=("b", object()))
    pack(Rows())

    class Context:
        partitionId = staticmethod(lambda: 0)

    import pyarrow as pa
    from pyspark import TaskContext

    get, TaskContext.get = TaskContext.get, classmethod(lambda cls: Context)
    try:
        out = list(ran[0]([pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["one two"])})]))
        assert out[0].schema == ARROW and set(kept) == {"encoder"}
    finally:
        TaskContext.get = get
        kept.clear()
        kept.update(before)
