"""Alignment of two tokenizers by galloping intersection of their token ends."""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, per_worker, release, slices, tokenizer_path
from quarrylens.llm.encoding import BARE, Encoder
from quarrylens.session import materialize

KEPT_WORDS, LONG_WORD = 200_000, 64
SLICE = 2 << 20
#: Links weighed at once.
LINKS = 1 << 18
MARK = "▁"


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible ones stand for themselves, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def gallop(keys: np.ndarray, into: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First place in the sorted ``into`` whose value is not below each key, searched from ``at``.

    Steps double away from the first guess until they pass the key; then the last step is halved.
    """
    n = len(into)
    low, high = np.full(len(keys), -1), np.full(len(keys), n)  # into[low] < key <= into[high]
    below = into[at] < keys
    low[below], high[~below] = at[below], at[~below]
    for going, sign in ((np.flatnonzero(below), 1), (np.flatnonzero(~below), -1)):
        step = 1
        while len(going):
            near, far = (low, high) if sign > 0 else (high, low)
            place = near[going] + sign * step
            inside = (place >= 0) & (place < n)
            going, place = going[inside], place[inside]  # past the end: -1 or n is already there
            goes_on = (into[place] < keys[going]) == (sign > 0)
            near[going[goes_on]] = place[goes_on]
            far[going[~goes_on]] = place[~goes_on]
            going = going[goes_on]
            step *= 2
    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) // 2
        less = into[middle] < keys[wide]
        low[wide[less]] = middle[less]
        high[wide[~less]] = middle[~less]
        wide = wide[high[wide] - low[wide] > 1]
    return high


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


def flat_ids(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words or texts in one array, and how many each has."""
    return np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


class Aligned(NamedTuple):
    """Tokens of the texts of a slice, one after the other, and the groups that their common ends cut.

    ``a_of`` and ``b_of`` are where each text's tokens start (one more at the end), ``groups_of``
    where its groups do; ``a_last`` and ``b_last`` are the last tokens of each group.
    """

    a: np.ndarray
    a_of: np.ndarray
    b: np.ndarray
    b_of: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    groups_of: np.ndarray


class Aligner:
    """Encodes texts by a byte-level tokenizer (A) and a sentencepiece model (B), and aligns them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.left = Encoder(a_path, KEPT_WORDS)
        self.left.tokenizer.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_characters()
        self.a_bytes = [b""] * self.left.size
        for name, i in self.left.tokenizer.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(map(of.__getitem__, name)) if all(c in of for c in name) else name.encode()
        lib = self.right
        self.b_bytes = [
            bytes([int(lib.id_to_piece(i)[3:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(lib.get_piece_size())
        ]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.data = [np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes)]  # of all tokens of a side
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        # no piece reaches over the start of a word and nothing is rewritten: words can be encoded by themselves
        self.by_word = (
            self.left.cuts and spec.add_dummy_prefix and spec.escape_whitespaces
            and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces)
            and not any(p.type == 4 or p.type == 1 and MARK in p.piece.lstrip(MARK) for p in model.pieces)
        )
        self.known: dict[str, bytes] = {}
        numbers = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        a, b = numbers[: len(self.a_bytes)], numbers[: len(self.b_bytes)]
        #: decimal ids with what follows them: a comma, or the sign after the last one of a side of a group
        self.written = [x for i in a for x in (i + b",", i + b"|")] + [x for i in b for x in (i + b",", i + b";")]

    def forget(self) -> None:
        """Drop the kept words; a worker may go on with other work."""
        self.known, self.left.known = {}, {}
        release()

    def _pieces(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.right.encode(texts, num_threads=1)] if texts else []

    def _words(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        missing = [word for word, ids in zip(words, out) if ids is None]
        new = self._pieces(missing)
        filling = iter(new)
        out = [next(filling) if ids is None else ids for ids in out] if new else out
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, missing, new = {}, words, out  # start again from this slice, which has the frequent ones
        self.known.update(compress(zip(missing, new), map(LONG_WORD.__ge__, map(len, missing))))
        return out

    def _same(self, ids: bytes, table: list[bytes], text: str) -> bool:
        return b"".join(map(table.__getitem__, array("I", ids))) == b" " + text.encode("utf-8", "surrogatepass")

    def _fitting(self, side: int, ids: np.ndarray, many: np.ndarray, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words their tokens give back; ``many`` tokens and ``sizes`` bytes of each, one after the other."""
        of = (self.a_sizes, self.b_sizes)[side]
        word = np.repeat(np.arange(len(many)), many)
        fits = np.bincount(word, of[ids], len(many)).astype(np.int64) == sizes
        ids = ids[fits[word]]
        found = self.data[side][runs((np.cumsum(of) - of)[ids], of[ids])]
        fitting = np.flatnonzero(fits)
        differing = np.flatnonzero(found != expected[np.repeat(fits, sizes)])
        fits[np.repeat(fitting, sizes[fitting])[differing]] = False
        return fits

    def _encoded(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of all texts and how many each has; none on either side of a text that one of them does not give back."""
        pc = pa.compute
        whole = np.ones(len(texts), bool)
        #: per side: the ids of some texts, one after the other, how many each has, and which texts they are
        parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]
        if self.by_word:
            split = pc.split_pattern(texts, " ")
            ends = split.offsets.to_numpy().astype(np.int64)
            coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            ends = ends - ends[0]
            words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            # white space next to a space: both sides read the text whole
            trimmed = pc.utf8_trim_whitespace(words)
            odd = pc.or_(pc.or_(pc.not_equal(trimmed, words), pc.equal(trimmed, "")), pc.starts_with(words, BARE))
            odd = odd.to_numpy(zero_copy_only=False)
            whole = np.logical_or.reduceat(odd[index], ends[:-1])
            needed = np.unique(index[np.repeat(~whole, np.diff(ends))])
            names = words.take(pa.array(needed))
            sizes = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            names = names.to_pylist()
            expected = np.frombuffer("".join([" " + name for name in names]).encode("utf-8", "surrogatepass"), np.uint8)
            found = [flat_ids(ids) for ids in (self.left._chunks(names) if names else [], self._words(names))]
            good = np.ones(len(words), bool)
            for side, (ids, many) in enumerate(found):
                good[needed] &= self._fitting(side, ids, many, expected, sizes)
            plain = ~whole & np.logical_and.reduceat(good[index], ends[:-1])
            place = np.zeros(len(words), np.int64)
            place[needed] = np.arange(len(needed))
            chosen = place[index[np.repeat(plain, np.diff(ends))]]
            first = np.r_[0, np.cumsum(np.diff(ends)[plain])]
            for side, (ids, many) in enumerate(found):
                before = np.r_[0, np.cumsum(many[chosen])][first]
                parts[side].append((ids[runs((np.cumsum(many) - many)[chosen], many[chosen])], np.diff(before), np.flatnonzero(plain)))
        rest = np.flatnonzero(whole & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if len(rest):
            plain = [texts[i].as_py() for i in rest.tolist()]
            pairs = [
                (x, y) if self._same(x, self.a_bytes, text) and self._same(y, self.b_bytes, text) else (b"", b"")
                for text, x, y in zip(plain, self.left._library([" " + t for t in plain]), self._pieces(plain))
            ]
            for side in (0, 1):
                parts[side].append((*flat_ids([pair[side] for pair in pairs]), rest))
        out = []
        for found in parts:
            many, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            ids, before = [np.zeros(0, np.int64)], 0
            for flat, counts, which in found:
                many[which], start[which] = counts, before + np.cumsum(counts) - counts
                ids.append(flat)
                before += len(flat)
            out.append((np.concatenate(ids)[runs(start, many)], many))
        return out

    def align(self, texts: pa.Array) -> Aligned:
        """Tokens and groups of a string array without nulls."""
        if not len(texts):
            none = np.zeros(0, np.int64)
            return Aligned(none, none[:1], none, none[:1], none, none, none[:1])
        flat, of, ends = [], [], []
        for (ids, many), sizes in zip(self._encoded(texts), (self.a_sizes, self.b_sizes)):
            flat.append(ids)
            of.append(np.r_[0, np.cumsum(many)])
            ends.append(np.cumsum(sizes[flat[-1]]))  # over all texts: both sides give back the same bytes
        if any(len(e) and np.diff(e, prepend=0).min() < 1 for e in ends):
            raise ValueError("a token without bytes has no place of its own")
        many = [np.diff(o) for o in of]
        last: list[list[np.ndarray]] = [[], []]
        for short, docs in ((0, many[0] <= many[1]), (1, many[0] > many[1])):
            long = 1 - short
            mine = np.flatnonzero(np.repeat(docs, many[short]))
            if not len(mine):
                continue
            doc = np.repeat(np.arange(len(texts)), many[short])[mine]
            # first guess: the same share of the way through the longer list
            guess = of[long][doc] + (mine - of[short][doc]) * many[long][doc] // many[short][doc]
            at = gallop(ends[short][mine], ends[long], guess)
            met = at < len(ends[long])
            met[met] = ends[long][at[met]] == ends[short][mine[met]]
            last[short].append(mine[met])
            last[long].append(at[met])
        a_last, b_last = (np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in last)
        return Aligned(flat[0], of[0], flat[1], of[1], a_last, b_last, np.searchsorted(a_last, of[0]))

    def digests(self, found: Aligned) -> list[str]:
        """SHA-256 of the groups of every text, as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        n = len(found.a), len(found.b)
        ends = [np.zeros(k, np.int64) for k in n]
        ends[0][found.a_last], ends[1][found.b_last] = 1, 1
        group = [np.cumsum(e) - e for e in ends]
        # a token comes after those of its own side and of the groups before; B after its group's A
        order = np.zeros(sum(n), np.int64)
        order[np.arange(n[0]) + np.r_[0, found.b_last + 1][group[0]]] = found.a * 2 + ends[0]
        order[np.arange(n[1]) + (np.r_[found.a_last, 0] + 1)[group[1]]] = 2 * len(self.a_bytes) + found.b * 2 + ends[1]
        tokens, of = order.tolist(), (found.a_of + found.b_of).tolist()
        text = self.written.__getitem__
        return [
            hashlib.sha256(b"".join(map(text, tokens[i:j]))[:-1]).hexdigest() if j > i else "" for i, j in zip(of, of[1:])
        ]

    def links(self, found: Aligned) -> np.ndarray:
        """Every A-B pair of tokens that end together, as a * (ids of B) + b."""
        return found.a[found.a_last] * len(self.b_bytes) + found.b[found.b_last]


def aligner(a: str, b: str) -> Aligner:
    """The aligner of two installed tokenizer files (or paths), one per Python worker."""
    paths = [name if os.path.isabs(name) else tokenizer_path(name) for name in (a, b)]
    return per_worker(("aligner", *paths), lambda: Aligner(*paths))


def ragged(values: np.ndarray, of: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(of, pa.int64()), pa.array(values).cast(kind)).cast(pa.list_(kind))


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def token_groups(docs: DataFrame, a: str = A, b: str = B, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, a_ids and b_ids, and a_ends and b_ends: how many tokens of each side lie before the end of each group.

    Group g overlaps the tokens a_ends[g - 1] to a_ends[g] - 1 of A, and likewise of B.
    Rows and texts as in :func:`align_tokenizers`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a, b)
        for part in slices(batches, limit=SLICE):
            found = tool.align(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows), np.diff(found.groups_of))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), ragged(found.a, found.a_of, pa.int32()), ragged(found.b, found.b_of, pa.int32()),
                 ragged(found.a_last + 1 - found.a_of[doc], found.groups_of, pa.int32()),
                 ragged(found.b_last + 1 - found.b_of[doc], found.groups_of, pa.int32())],
                ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"],
            )

    kinds = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    return id_and_text(docs, id_column, text_column).mapInArrow(run, f"doc_id bigint, {kinds}")


def align_tokenizers(docs: DataFrame, a: str = A, b: str = B, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``a`` is a byte-level tokenizers file that reads a space and the text, ``b`` a
    sentencepiece model that adds the space itself; the strings of special tokens are plain
    text. Offsets where tokens of both sides end cut them into groups: the ends of the
    side with fewer tokens are searched in the other's by galloping. Two tokens that end
    together are linked; the count of an id pair is the number of its links in all texts,
    and a link is best if no other A id has a higher count with its B id.

    Texts are encoded and aligned once; their links are written with the counts of the
    tokens. Pairs are counted over all rows, and the counts go back to every task: of two
    tokens that end together the shorter is the end of the longer, so there are no more
    pairs than both vocabularies have bytes (times the pieces that share their bytes, one
    or two), whatever the size of the input.

    A null or empty text, and one that either side does not give back byte by byte, has no
    tokens and the digest ''. Very long texts are aligned whole. Equal rows are aligned and
    counted each; a null id stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a, b)
        for part in slices(batches, limit=SLICE):
            found = tool.align(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(np.diff(x)) for x in (found.a_of, found.b_of, found.groups_of)],
                 pa.array(tool.digests(found)), ragged(tool.links(found), found.groups_of, pa.int64())],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )

    columns = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>"
    aligned = materialize(id_and_text(docs, id_column, text_column).mapInArrow(run, columns))
    counted = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).toArrow()
    order = np.argsort(counted["pair"].to_numpy())
    pairs, counts = counted["pair"].to_numpy()[order], counted["n"].to_numpy()[order]
    known = docs.sparkSession.sparkContext.broadcast((pairs, counts))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = known.value
        tool = aligner(a, b)
        tool.forget()
        n_b = len(tool.b_bytes)
        most = np.zeros(n_b, np.int64)
        np.maximum.at(most, pairs % n_b, counts)
        best = counts == most[pairs % n_b]
        for batch in batches:
            links = batch.column("links").flatten()
            of = np.r_[0, np.cumsum(batch.column("n_groups").to_numpy())]
            totals = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for at in range(0, len(links), LINKS):
                place = np.searchsorted(pairs, links.slice(at, LINKS).to_numpy())
                # rows that these links reach, and where each begins and ends among them
                first, last = np.searchsorted(of, [at, at + len(place) - 1], "right") - 1
                edge = np.clip(of[first : last + 2] - at, 0, len(place))
                for total, value in zip(totals, (best[place], counts[place])):
                    total[first : last + 1] += np.diff(np.r_[0, np.cumsum(value, dtype=np.int64)][edge])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], batch.column("n_groups"), *map(pa.array, totals), batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    figures = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return aligned.mapInArrow(weigh, figures)
