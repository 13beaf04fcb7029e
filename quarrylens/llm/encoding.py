"""Token ids of whole texts, with one library call per distinct space-led chunk."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from quarrylens.llm.common import per_worker, tokenizer_path

KEPT_CHUNKS = 1_000_000
LONG_CHUNK = 64
BARE = "\0"
#: Punctuation after a letter is a token boundary for the pattern; words share what precedes it.
TAIL = ".,;:!?"


class Encoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit integers in bytes.

    A byte-level tokenizer's pattern always breaks between a non-space character and a
    single space that another non-space character follows, and nothing left of that break
    changes the tokens right of it. Texts in which every space is such a break are cut
    there; the distinct chunks of a slice are encoded once, and kept. Any other text, and any other kind of
    tokenizer, goes to the library whole.
    """

    def __init__(self, path: str, kept_chunks: int = KEPT_CHUNKS):
        self.kept_chunks = kept_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        )
        self.sizes = np.zeros(self.size, np.int64)  # bytes of each token, for a byte-level tokenizer
        for name, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(name)
        for token in spec["added_tokens"]:
            self.sizes[token["id"]] = len(token["content"].encode())
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, keys: list[str]) -> list[bytes]:
        """Ids of chunks; a key is a chunk without its space, or BARE and a chunk that has none."""
        out = list(map(self.known.get, keys))
        holes = [i for i, ids in enumerate(out) if ids is None]
        if not holes:
            return out
        missing = [keys[i] for i in holes]
        # one call with all of them as the words of one input; a byte-level token stands for
        # as many bytes as its name has characters, which tells where each word ends
        words = [k[1:] if k[:1] == BARE else " " + k for k in missing]
        found = self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.cumsum(pa.compute.binary_length(pa.array(words)).to_numpy(), dtype=np.int64)
        cuts = np.searchsorted(np.r_[0, np.cumsum(self.sizes[ids])], ends).tolist()
        tokens = ids.tobytes()
        new = [tokens[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts)]
        for i, ids in zip(holes, new):
            out[i] = ids
        if len(self.known) + len(new) > self.kept_chunks:
            # start again from this slice, which has the frequent ones
            self.known, missing, new = {}, keys, out
        self.known.update((k, ids) for k, ids in zip(missing, new) if len(k) <= LONG_CHUNK)
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a string array without nulls."""
        if not len(texts) or not self.cuts:
            return self._library(texts.to_pylist())
        pc = pa.compute
        parts = pc.split_pattern(texts, " ")
        ends = parts.offsets.to_numpy()
        coded = parts.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        chunks, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # white space next to a space, or the mark of a chunk without one: not a plain break
        trimmed = pc.utf8_trim_whitespace(chunks)
        odd = pc.or_(pc.not_equal(trimmed, chunks), pc.equal(trimmed, ""))
        odd = pc.or_(odd, pc.starts_with(trimmed, BARE)).to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduceat(odd[index], ends[:-1])
        starts = np.flatnonzero(~whole)

        stems = pc.utf8_rtrim(chunks, TAIL)
        size = pc.binary_length(chunks).to_numpy()
        tail = size - pc.binary_length(stems).to_numpy()
        letter = pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, -1)).to_numpy(zero_copy_only=False)
        tail[~letter | odd | (tail > 7)] = 0
        stems = pc.if_else(pa.array(tail > 0), stems, chunks).dictionary_encode()
        # a tail as a number, its last character lowest
        data = np.frombuffer(chunks.buffers()[2], np.uint8)
        stop = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset + 1 : chunks.offset + 1 + len(chunks)].astype(np.int64)
        number = np.zeros(len(chunks), np.int64)
        for j in range(int(tail.max(initial=0))):
            has = np.flatnonzero(tail > j)
            number[has] |= data[stop[has] - 1 - j].astype(np.int64) << 8 * j
        numbers, which = np.unique(number, return_inverse=True)
        tails = [int(n).to_bytes(7, "big").lstrip(b"\0").decode() for n in numbers]

        # keys: stems, then tails, then the texts' first chunks; a text is two places per chunk
        first = [chunks[i].as_py() for i in index[ends[:-1]][starts].tolist()]
        keys = [*stems.dictionary.to_pylist(), *(BARE + t for t in tails), *(BARE + c for c in first)]
        n = len(stems.dictionary)
        place = np.zeros((len(chunks) + len(texts), 2), np.int64)
        place[: len(chunks), 0] = stems.indices.to_numpy()
        place[: len(chunks), 1] = n + which
        place[len(chunks) :, 1] = n + int(np.flatnonzero(numbers == 0)[0]) if (numbers == 0).any() else len(keys)
        place[len(chunks) + starts, 0] = n + len(tails) + np.arange(len(starts))
        index[ends[:-1]] = len(chunks) + np.arange(len(texts))
        ids = [*self._chunks(keys), b""]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        tokens = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(sizes) - sizes
        chosen = place[index[np.repeat(~whole, np.diff(ends))]].ravel()
        many = sizes[chosen]
        stop = np.cumsum(many)
        flat = tokens[np.repeat(begin[chosen] - stop + many, many) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = np.r_[0, stop][np.r_[0, 2 * np.cumsum(np.diff(ends)[~whole])]]
        out: list[bytes] = [b""] * len(texts)
        for i, a, b in zip(starts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = flat[a:b].tobytes()
        rest = np.flatnonzero(whole).tolist()
        for i, ids in zip(rest, self._library([texts[i].as_py() for i in rest]) if rest else []):
            out[i] = ids
        return out


def encoder(name: str, kept_chunks: int = KEPT_CHUNKS) -> Encoder:
    """The encoder of an installed tokenizer file (or of a path), one per Python worker."""
    path = name if os.path.isabs(name) else tokenizer_path(name)
    return per_worker(("encoder", path, kept_chunks), lambda: Encoder(path, kept_chunks))
