"""Token counts by byte-pair merging on ragged numpy arrays."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylens.llm.common import id_and_text, per_worker, slices, tokenizer_path

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
KEPT_WORDS = 500_000
LONG_WORD = 64
NEVER = np.iinfo(np.int32).max
SPACE = "▁"
#: A run of spaces and the run of other characters after it.
WORD = re.compile(r" *[^ ]+| +")


class Merger:
    """Counts the pieces that a byte-pair model of the sentencepiece library leaves of a word.

    Two neighbouring symbols merge if their concatenation is a piece, the best score
    first and the leftmost on ties. Characters without a piece fall back to bytes.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models without text normalisation, with a leading space, are supported")
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only byte-pair models with byte fallback and no user-defined pieces are supported")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("a piece reaches over the start of a word")
        order = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        ids = {p: i for i, p in enumerate([*score, *sorted({c for p in score for c in p} - score.keys())])}
        pieces, shared = len(score), {r for r, n in zip(*np.unique(list(rank.values()), return_counts=True)) if n > 1}
        keys, made, ranks = [], [], []
        one_by_one = {p for p in score if rank[p] in shared}
        for piece in score:
            for i in range(1, len(piece)):
                left, right = piece[:i], piece[i:]
                if left in ids and right in ids:
                    keys.append(ids[left] * len(ids) + ids[right])
                    made.append(ids[piece])
                    ranks.append(rank[piece])
                    # a merge that can make a better one possible must not run ahead of it
                    one_by_one.update(p for p in (left, right) if p in rank and rank[p] >= rank[piece])
        by_key = np.argsort(np.array(keys))
        self.keys, self.made, self.ranks = (np.array(x)[by_key] for x in (keys, made, ranks))
        self.ranks = self.ranks.astype(np.int32)
        self.n_ids, self.unknown = len(ids), len(ids)
        self.one_by_one = np.zeros(len(ids) + 1, bool)
        self.one_by_one[[ids[p] for p in one_by_one]] = True
        self.is_piece = np.zeros(len(ids) + 1, bool)
        self.is_piece[:pieces] = True
        chars = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.char_codes, self.char_ids = (np.array(x) for x in zip(*chars))
        self.known: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; NEVER where it makes no piece."""
        key = left * self.n_ids + right
        key[(left == self.unknown) | (right == self.unknown)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NEVER), self.made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word; a word is a non-empty string with its leading marks."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        symbol = np.where(self.char_codes[at] == codes, self.char_ids[at], self.unknown)
        owner = np.repeat(np.arange(len(words)), sizes)
        # a character without a piece costs its bytes; merging it away gives them back
        cost = np.where(self.is_piece[symbol], 1, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        total = np.zeros(len(words), np.int64)
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.empty(0, bool)
        rank, made = self._pairs(symbol, np.r_[symbol[1:], self.unknown])
        rank[last] = NEVER
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            going = best != NEVER
            if not going.all():
                total[owner[starts[~going]]] = np.add.reduceat(cost, starts)[~going]
                keep = np.repeat(going, sizes)
                symbol, owner, cost, rank, made = (x[keep] for x in (symbol, owner, cost, rank, made))
                best, sizes = best[going], sizes[going]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            whose = owner[hit]
            first = np.r_[True, whose[1:] != whose[:-1]]
            # overlapping hits: every second one of a run of neighbours, from its left end
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | first[1:]]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            even = (np.arange(len(hit)) - begin) % 2 == 0
            hit = hit[first | (even & ~self.one_by_one[made[hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]]])]
            symbol[hit] = made[hit]
            cost[hit] = 1
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            touched = place[hit]
            symbol, owner, cost, rank, made = (x[keep] for x in (symbol, owner, cost, rank, made))
            touched = np.unique(np.r_[touched, touched[touched > 0] - 1])
            after = np.minimum(touched + 1, len(symbol) - 1)
            new_rank, new_made = self._pairs(symbol[touched], symbol[after])
            new_rank[(after == touched) | (owner[after] != owner[touched])] = NEVER
            rank[touched], made[touched] = new_rank, new_made
        return total

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Words are keyed without the one leading space each has."""
        cut = []
        for text in texts:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            if not text:
                cut.append([])
            elif "  " in text or text[0] == " ":
                cut.append([w[1:] for w in WORD.findall(" " + text)])
            else:
                cut.append(text.split(" "))
        needed = set().union(*cut) if cut else set()
        missing = list(needed - self.known.keys())
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known, missing = {}, list(needed)
        if missing:
            self.known.update(zip(missing, self.count([SPACE + w.replace(" ", SPACE) for w in missing]).tolist()))
        get = self.known.__getitem__
        counts = [sum(map(get, words)) for words in cut]
        for word in missing:
            if len(word) > LONG_WORD:
                del self.known[word]
        return counts


def merger(name: str) -> Merger:
    """The merger of an installed model file (or of a path), one per Python worker."""
    path = name if os.path.isabs(name) else tokenizer_path(name)
    return per_worker(("merger", path), lambda: Merger(path))


def count_tokens(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    limit: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they exceed ``limit``, for every row.

    The distinct words of a slice of texts are merged together in ragged arrays: each
    round, every word merges its lowest-rank pair. No shuffle; a task holds one slice.

    A null or empty text has no bytes and no tokens. A word of any length is merged whole.
    Equal rows are counted each; an empty table gives no rows; a null id stays null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(model)
        for part in slices(batches):
            text = part.column("text")
            counts = tool.count_texts(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.compute.binary_length(text).cast(pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                schema=schema,
            )

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SCHEMA)
