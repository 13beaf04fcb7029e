"""Document probability under a subword unigram model, summed over all segmentations."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, per_worker, slices, tokenizer_path
from quarrylens.session import materialize

#: Text a block holds: the distinct words of a block and its texts are one task's working set.
BLOCK_BYTES = 8 << 20
WORDS_AT_ONCE = 200_000
CHUNK = 16_384
MARK = "▁".encode()
SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Pieces:
    """The pieces of an existing subword vocabulary, and the segmentation its library gives."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.texts: list[bytes | None] = []
        for i in range(n):
            if self.library.is_byte(i):
                self.texts.append(bytes([int(self.library.id_to_piece(i)[3:-1], 16)]))
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.texts.append(None)
            else:
                self.texts.append(self.library.id_to_piece(i).encode())

    def counts(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece occurs if word i occurs times[i] times."""
        out = np.zeros(len(self.texts), np.int64)
        ids = self.library.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        np.add.at(out, flat, np.repeat(times, sizes))
        return out


class Lattice:
    """Forward recursion over the pieces of every segmentation of a word, in log space."""

    PAD = 256

    def __init__(self, texts: list[bytes | None], logs: np.ndarray):
        states: dict[bytes, int] = {b"": 0}
        ends: dict[int, float] = {}
        links = []
        for text, log in zip(texts, logs):
            # lower-cased words never hold these
            if text is None or any(0x41 <= b <= 0x5A for b in text):
                continue
            for i in range(1, len(text) + 1):
                if text[:i] not in states:
                    states[text[:i]] = len(states)
                    links.append((states[text[: i - 1]], text[i - 1], states[text[:i]]))
            at = states[text]
            ends[at] = np.logaddexp(ends[at], log) if at in ends else log
        kind = np.uint16 if len(states) < 1 << 16 else np.uint32
        self.next = np.zeros((len(states), 257), kind)
        left, byte, right = np.array(links).T
        self.next[left, byte] = right
        self.log = np.full(len(states), -np.inf)
        self.log[list(ends)] = list(ends.values())

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each byte string."""
        out = np.empty(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            width = int(sizes[order[min(at + CHUNK, len(order)) - 1]])
            rows = max(1, min(CHUNK, (1 << 22) // max(1, width)))
            chosen = order[at : at + rows]
            width = int(sizes[chosen[-1]])
            grid = np.full((len(chosen), width), self.PAD, np.uint16)
            inside = np.arange(width) < sizes[chosen][:, None]
            grid[inside] = np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8)
            out[chosen] = self._forward(grid, sizes[chosen])
            at += len(chosen)
        return out

    def _forward(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, width = grid.shape
        total = np.full((width + 1, n), -np.inf)
        total[0] = 0
        columns = np.ascontiguousarray(grid.T)
        for i in range(width):
            rows = np.flatnonzero((sizes > i) & (total[i] > -np.inf))
            state = np.zeros(len(rows), self.next.dtype)
            for j in range(i, width):
                state = self.next[state, columns[j][rows]]
                alive = state > 0
                if not alive.all():
                    rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                log = self.log[state]
                ended = log > -np.inf
                whole = ended.all()
                r, gain = (rows, log) if whole else (rows[ended], log[ended])
                total[j + 1, r] = np.logaddexp(total[j + 1, r], total[i, r] + gain)
        return total[sizes, np.arange(n)]


def pieces_in(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def in_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Record batches joined until they hold ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def score_documents(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    folds: int = 7,
    held_out_fold: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``base_score`` is an add-one word unigram. ``score`` is the log10 probability of the
    text under a unigram model of subword pieces, summed over every way to cut each word
    into pieces of an existing vocabulary (its bytes among them), then one end. The
    vocabulary is given; the weights of its pieces are their add-one relative frequencies
    in the training documents, those whose crc32(id) mod ``folds`` is not ``held_out_fold``.

    Texts are dealt into blocks of about BLOCK_BYTES by a hash of the row. A block sends
    each distinct word once; a word is counted, segmented and scored once for the whole
    corpus, and its figures go back to the blocks that hold it. No row of the exchange is
    per document and word, and a word has at most one row per block. The driver sees the
    totals and one count per piece of the vocabulary.

    A null or empty text is the end alone. A null id belongs to the training documents.
    Equal rows are counted and scored each. A very long text makes its block as long. An
    empty table gives no rows; without training documents all pieces weigh the same.
    """
    path = model if os.path.isabs(model) else None
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out_fold, F.lit(False))
    rows = id_and_text(docs, id_column, text_column).withColumn("held_out", held)
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint")), F.sum(F.when(~held, 1).otherwise(0))).first()
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES))
    train_documents = size[1] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def count(group: pa.Table) -> pa.Table:
        train, other = Counter(), set()
        for batch in group.to_batches():
            for part in slices([batch]):
                for text, out in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist()):
                    (other if out else train).update(words_of(text))
        other.difference_update(train)
        words = [*train, *other]
        return pa.table(
            {
                "block": pa.array([group["block"][0].as_py()] * len(words), pa.int64()),
                "word": pa.array(words, pa.binary()),
                "n": pa.array([*train.values(), *[0] * len(other)], pa.int64()),
            }
        )

    in_block = materialize(rows.groupBy("block").applyInArrow(count, "block bigint, word binary, n bigint"))
    counted = materialize(in_block.groupBy("word").agg(F.sum("n").alias("n")))
    totals = counted.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens = (totals[0] or 0) + train_documents
    types = totals[1] + (train_documents > 0)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or tokenizer_path(model)
        pieces = per_worker(("pieces", place), lambda: Pieces(place))
        found = np.zeros(len(pieces.texts), np.int64)
        for group in in_groups(batches, WORDS_AT_ONCE):
            for part in group.to_batches(max_chunksize=CHUNK):
                found += pieces.counts(part.column("word").to_pylist(), part.column("n").to_numpy())
        ids = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found[ids], pa.int64())], ["piece", "n"])

    by_piece = counted.where("n > 0").mapInArrow(segment, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n"))
    found = np.array([tuple(r) for r in by_piece.collect()], np.int64).reshape(-1, 2)  # at most the vocabulary
    piece_tokens = int(found[:, 1].sum()) + train_documents

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or tokenizer_path(model)
        pieces = per_worker(("pieces", place), lambda: Pieces(place))
        n = np.ones(len(pieces.texts))
        n[found[:, 0]] += found[:, 1]
        lattice = Lattice(pieces.texts, np.log(n / (piece_tokens + len(n) + 1)))
        for group in in_groups(batches, WORDS_AT_ONCE):
            words = group["word"].to_pylist()
            logs = lattice.score([MARK + w for w in words]) / np.log(10)
            for batch in group.append_column("log", pa.array(logs)).combine_chunks().to_batches():
                yield batch

    # control pieces are in the size of the vocabulary too: their share is never used
    vocabulary = pieces_in(path or tokenizer_path(model))
    end_log = float(np.log10((train_documents + 1) / (piece_tokens + vocabulary + 1)))
    scored = materialize(counted.mapInArrow(score_words, "word binary, n bigint, log double"))
    figures = in_block.select("block", "word").join(scored.hint("shuffle_hash"), "word")

    def score(texts: pa.Table, figures: pa.Table) -> pa.Table:
        index = {w: i for i, w in enumerate(figures["word"].to_pylist())}
        n, log = figures["n"].to_numpy(), figures["log"].to_numpy()
        base = np.log10((n + 1) / (tokens + types + 1))
        seen = n > 0
        out = []
        for batch in texts.to_batches():
            for part in slices([batch]):
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    out.append(
                        (
                            len(words) + 1,
                            int(seen[at].sum()) + (train_documents > 0),
                            float(base[at].sum() + np.log10((train_documents + 1) / (tokens + types + 1))),
                            float(log[at].sum() + end_log),
                        )
                    )
        n_tokens, n_known, base_score, total = zip(*out) if out else ([], [], [], [])
        return pa.table(
            {
                "doc_id": texts["doc_id"], "held_out": texts["held_out"],
                "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(out), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()), "score": pa.array(total, pa.float64()),
            }
        )

    return rows.groupBy("block").cogroup(figures.groupBy("block")).applyInArrow(score, SCHEMA)
