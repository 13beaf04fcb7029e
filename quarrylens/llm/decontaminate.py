"""Benchmark passages in documents, with a few edits: q-gram counting, then banded alignment."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, per_worker, slices
from quarrylens.operators.ordering import join_keys
from quarrylens.session import materialize, quoted

Q = 8
#: A benchmark text is looked for in probes of this many characters, each starting half a probe after the last.
PROBE = 120
#: And in short probes of PART characters, each starting STRIDE after the last: PART + STRIDE - 1 characters hold one.
PART, STRIDE = 60, 4
#: Characters of a probe for one edit: 9 edits in a whole probe, 4 in a short one.
CHARS_PER_EDIT = 13
#: Shorter texts are looked for exactly.
MIN_CHARS = 40
#: Scripts without spaces between words: every place is a border.
UNSPACED = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)]
#: Benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 1 << 20
SLICE = 1 << 20
GAP = 0x110000  # no character
BITS = 22
HITS = 1 << 18
#: Regions that are aligned at a time.
ALIGNED = 1 << 14
FACTOR = 0xC2B2AE3D27D4EB4F
SCHEMA = "doc_id bigint, h1 bigint, h2 bigint, item_id bigint, probes int, probes_found int, start bigint, stop bigint, edits int, matched string"


def codes_of(text: str) -> np.ndarray:
    """Code points of a text with A-Z lower-cased and ASCII white space collapsed to one space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.frombuffer(b" ".join(words).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from every position, by doubling."""
    h, width = codes.astype(np.uint64), 1
    while width < Q:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[width:] + np.uint64(width)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(31)
        width *= 2
    return h


class Texts:
    """Benchmark texts of MIN_CHARS characters or more, and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        items = [(item, whole) for item, whole in items if len(whole) >= MIN_CHARS]
        self.items = [item for item, _ in items]
        self.sizes = np.array([len(whole) for _, whole in items], np.int64)
        self.codes = np.concatenate([np.empty(0, np.uint32), *(whole for _, whole in items)])
        self.base = np.cumsum(self.sizes) - self.sizes
        self.longest = int(self.sizes.max(initial=0))
        hashes = np.concatenate([np.empty(0, np.uint64), *(gram_hashes(whole) for _, whole in items)])
        grams = self.sizes - Q + 1
        places = np.arange(len(hashes)) - np.repeat(np.cumsum(grams) - grams, grams)
        order = np.argsort(hashes, kind="stable")
        self.texts, self.places = np.repeat(np.arange(len(items)), grams)[order], places[order]
        self.grams, self.first, self.many = np.unique(hashes[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - BITS)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams that a benchmark text has, and which they are."""
        h = gram_hashes(codes)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - BITS)])
        gram = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[gram] == h[at]
        return at[same], gram[same]


def probe_starts(n: int, size: int, stride: int) -> list[int]:
    starts = list(range(0, max(1, n - size + 1), stride))
    return starts if starts[-1] + size >= n else [*starts, n - size]


class Probes:
    """Probes of ``size`` characters that start every ``stride`` of a text; ``whole``: also the texts that are shorter."""

    def __init__(self, texts: Texts, size: int, stride: int, whole: bool):
        self.known = texts
        owners, starts = [], []
        for t, n in enumerate(texts.sizes.tolist()):
            if n <= size and not whole:
                continue
            of_text = probe_starts(n, size, stride)
            owners += [t] * len(of_text)
            starts += of_text
        self.owners, self.starts = np.array(owners, np.int64), np.array(starts, np.int64)
        self.sizes = np.minimum(texts.sizes[self.owners], size)
        self.edits = self.sizes // CHARS_PER_EDIT
        # the q-gram lemma: a match with so many edits shares at least so many q-grams
        self.least = self.sizes - Q + 1 - self.edits * Q
        self.least_of_text = np.full(len(texts.sizes), np.iinfo(np.int64).max)
        np.minimum.at(self.least_of_text, self.owners, self.least)
        self.band = int(self.edits.max(initial=0)) + 1
        # the probes that hold an indexed q-gram lie next to each other
        order, low = self.owners * (texts.longest + 1) + self.starts, texts.texts * (texts.longest + 1)
        self.first = np.searchsorted(order, low + np.maximum(texts.places + Q - size, 0))
        self.many = np.searchsorted(order, low + texts.places, side="right") - self.first

    def regions(self, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, diagonal) pairs whose q-gram count reaches the probe's bound.

        Band b covers the diagonals from b to b + 2 widths, so that neighbours overlap and
        the diagonals of any match lie in one of them. Whole texts are counted first; only
        the bands in which a text reaches the bound are counted by probe.
        """
        known = self.known
        many = known.many[gram]
        ends = np.cumsum(many)

        def keys(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            n = many[lo:hi]
            entry = np.repeat(known.first[gram[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            band = (np.repeat(at[lo:hi], n) - known.places[entry] + known.longest) // self.band
            key, used = (known.texts[entry] << 40) | band, self.many[entry] > 0
            key, band, entry = key[used], band[used], entry[used]
            return np.concatenate([key, key[band > 0] - 1]), np.concatenate([entry, entry[band > 0]])

        # shared q-grams in parts of about HITS; most bands hold a few stray ones, so that
        # all are first counted by a small hash, and only crowded slots are looked at again
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, HITS), side="right"))
        parts = list(zip(cuts, [*cuts[1:], len(at)]))
        slots = lambda key: ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        crowd = sum((np.bincount(slots(keys(*p)[0]), minlength=1 << 20) for p in parts), np.zeros(1 << 20, np.int64))
        crowded = crowd >= self.least.min(initial=np.iinfo(np.int64).max)
        found = [(key[c], entry[c]) for key, entry in (keys(*p) for p in parts) for c in [crowded[slots(key)]]]
        key = np.concatenate([np.empty(0, np.int64), *(k for k, _ in found)])
        entry = np.concatenate([np.empty(0, np.int64), *(e for _, e in found)])
        order = np.argsort(key, kind="stable")
        key, entry = key[order], entry[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        counts = np.diff(np.r_[new, len(key)])
        enough = np.repeat(counts >= self.least_of_text[key[new] >> 40], counts)
        key, entry = key[enough], entry[enough]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        # a band of a text is counted in one part
        total = np.cumsum(self.many[entry])
        before = np.r_[0, total][new]
        cuts = new[np.unique(np.searchsorted(before, np.arange(0, total[-1] if len(total) else 0, HITS)).clip(max=max(0, len(new) - 1)))] if len(new) else new
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
            n = self.many[entry[lo:hi]]
            probe = np.repeat(self.first[entry[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs, count = np.unique((probe << 40) | np.repeat(key[lo:hi] & ((1 << 40) - 1), n), return_counts=True)
            pairs = pairs[count >= self.least[pairs >> 40]]
            out.append((pairs >> 40, (pairs & ((1 << 40) - 1)) * self.band - known.longest + self.starts[pairs >> 40]))
        return np.concatenate([p for p, _ in out]), np.concatenate([d for _, d in out])

    def matches(self, codes: np.ndarray, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple]:
        """Probe, edits, start and stop of every match, aligned in parts of bounded size."""
        probes, diagonals = self.regions(at, gram)
        for i in range(0, len(probes), ALIGNED):
            probe = probes[i : i + ALIGNED]
            edits, start, stop = self.align(codes, probe, diagonals[i : i + ALIGNED])
            ok = edits <= self.edits[probe]
            yield from zip(probe[ok].tolist(), edits[ok].tolist(), start[ok].tolist(), stop[ok].tolist())

    def align(self, codes: np.ndarray, probe: np.ndarray, diagonal: np.ndarray):
        """Least edits of each probe on the diagonals of its band, and where the match starts and stops."""
        slack = self.band
        wide = 2 * self.band + 2 * slack
        one = 1 << 20
        low = diagonal - slack
        columns = np.arange(wide)
        # cost above, start of the match (as an offset from low) below: the minimum carries both along
        row = np.broadcast_to(columns, (len(probe), wide)).astype(np.int64)
        best, stop = np.full(len(probe), np.iinfo(np.int64).max), np.zeros(len(probe), np.int64)
        sizes, base = self.sizes[probe], self.known.base[self.owners[probe]] + self.starts[probe]
        for i in range(int(sizes.max(initial=0))):
            place = low[:, None] + columns + i
            inside = (place >= 0) & (place < len(codes))
            text = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], GAP)
            wanted = self.known.codes[np.minimum(base + i, len(self.known.codes) - 1)]
            new = row + np.where(text == wanted[:, None], 0, one)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + one)
            row = np.minimum.accumulate(new - columns * one, axis=1) + columns * one
            done = sizes == i + 1
            if done.any():
                end = row[done].argmin(axis=1)
                best[done], stop[done] = row[done].min(axis=1), low[done] + end + i + 1
        return best // one, low + best % one, stop


def spaced() -> np.ndarray:
    """Of every code point, whether it is a letter or digit of a script that puts spaces between words."""
    out = np.fromiter((chr(i).isalnum() for i in range(GAP)), bool, GAP)
    for lo, hi in UNSPACED:
        out[lo:hi] = False
    return np.r_[out, False]


class Phrases:
    """Benchmark texts under MIN_CHARS characters, found exactly and on word borders."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        by_size: dict[int, list] = {}
        for item, whole in items:
            if 0 < len(whole) < MIN_CHARS:
                by_size.setdefault(len(whole), []).append((item, whole))
        self.sizes = {}
        self.head = min([8, *by_size])
        self.heads = np.zeros(1 << BITS, bool)
        for size, same in by_size.items():
            grid = np.array([whole for _, whole in same], np.uint32)
            hashes = (grid.astype(np.uint64) * powers(FACTOR, size)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = hashes[order], [same[i][0] for i in order], grid[order]
            self.heads[slot((grid[:, : self.head].astype(np.uint64) * powers(FACTOR, self.head)).sum(axis=1, dtype=np.uint64))] = True
        self.spaced = spaced() if by_size else None

    def matches(self, codes: np.ndarray) -> Iterator[tuple]:
        """Size, number, start and stop of every place of a phrase."""
        if not self.sizes:
            return
        inner = self.spaced[codes]
        border = np.r_[True, ~(inner[1:] & inner[:-1]), True]
        # sums of codes times powers of an odd number, whose inverse shifts any of them to its start
        total = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * powers(FACTOR, len(codes)), dtype=np.uint64)]
        back = powers(pow(FACTOR, -1, 1 << 64), len(codes))
        starts = np.flatnonzero(border[: max(0, len(codes) - self.head + 1)])
        starts = starts[self.heads[slot((total[starts + self.head] - total[starts]) * back[starts])]]
        for size, (hashes, _, grid) in self.sizes.items():
            at = starts[starts + size <= len(codes)]
            at = at[border[at + size]]
            h = (total[at + size] - total[at]) * back[at]
            lo = np.searchsorted(hashes, h)
            n = np.searchsorted(hashes, h, side="right") - lo
            number = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            same = (codes[at[:, None] + np.arange(size)] == grid[number]).all(axis=1)
            for k, a in zip(number[same].tolist(), at[same].tolist()):
                yield size, k, a, a + size


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)[:n]


def slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Searched:
    """All that is looked for of a block of benchmark texts."""

    def __init__(self, items: list[tuple[int, str]]):
        coded = [(item, codes_of(text or "")) for item, text in items]
        self.texts, self.phrases = Texts(coded), Phrases(coded)
        self.kinds = [Probes(self.texts, PROBE, PROBE // 2, True), Probes(self.texts, PART, STRIDE, False)]
        self.per_item: dict[int, int] = {}
        for kind in self.kinds:
            for t in kind.owners.tolist():
                self.per_item[self.texts.items[t]] = self.per_item.get(self.texts.items[t], 0) + 1
        for _, ids, _ in self.phrases.sizes.values():
            for item in ids:
                self.per_item[item] = self.per_item.get(item, 0) + 1

    def matches(self, codes: np.ndarray) -> Iterator[tuple]:
        """Item, probe, edits, start and stop of every match."""
        if self.texts.items:
            at, gram = self.texts.hits(codes)
            for k, kind in enumerate(self.kinds):
                for p, e, a, b in kind.matches(codes, at, gram):
                    yield self.texts.items[kind.owners[p]], (k, p), e, a, b
        for size, number, a, b in self.phrases.matches(codes):
            yield self.phrases.sizes[size][1][number], (-size, number), 0, a, b


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Documents that hold a passage of a benchmark text: one row per document and item.

    Texts are compared with A-Z lower-cased and white space collapsed. An item is cut into
    overlapping probes of PROBE characters (a shorter item is one probe), and into short
    ones of PART characters from every STRIDE: any part of PART + STRIDE - 1 characters
    holds a short probe. A probe is found where it aligns with at most one edit per
    CHARS_PER_EDIT of its characters; so parts are found from 63 characters on. An item of
    under MIN_CHARS characters is found where it stands unedited between word borders; a
    border is any place but between two letters or digits of a script with spaces. Shared
    q-grams are counted in overlapping bands of diagonals; bands that reach the bound of
    the q-gram lemma are verified by alignment inside the band. Columns: doc_id, item_id,
    probes (of the item), probes_found, start and stop (of the found probes, in characters
    of the compared text), edits (of the best probe), matched (the text from start to stop).

    The benchmark is read in blocks of BLOCK_BYTES, one after the other, each sent to all
    tasks and looked for in one pass; documents are not shuffled and there is no bound on
    matches. What is reported does not depend on the number of blocks. A null or empty text
    holds nothing, and a null or empty item is nowhere. Equal documents are reported each,
    as are documents that share an id, or have none; rows that share an item id (or have
    none) are one item. Texts of any length are searched whole; an empty table on either
    side gives no rows; null ids stay null.
    """
    items = benchmark.select(quoted(item_column).cast("bigint").alias("item_id"), quoted(item_text_column).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = id_and_text(docs, id_column, text_column)
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    found, probes = [], []
    for block in range(blocks):
        chosen = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        part = rows.mapInArrow(_search(chosen), SCHEMA)
        if blocks == 1:
            return part.drop("h1", "h2")
        found.append(materialize(part))
        probes.append(probe_counts(docs.sparkSession, chosen))
    return _joined(reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, probes), rows)


def probe_counts(spark: SparkSession, items: list[tuple[int, str]]) -> DataFrame:
    """(item_id, probes) of a block of benchmark texts."""
    counts: dict[int, int] = {}
    for item, text in items:
        n = len(codes_of(text or ""))
        long = len(probe_starts(n, PROBE, PROBE // 2)) if n >= MIN_CHARS else int(n > 0)
        counts[item] = counts.get(item, 0) + long + (len(probe_starts(n, PART, STRIDE)) if n > max(PART, MIN_CHARS - 1) else 0)
    return spark.createDataFrame(list(counts.items()), "item_id bigint, probes bigint")


def _joined(found: DataFrame, probes: DataFrame, rows: DataFrame) -> DataFrame:
    """What the blocks found, by document and item: rows of one item can lie in several blocks.

    Equal documents have equal finds in every block, so they are counted and repeated. Where
    two blocks hold parts of an item, the matched text is cut from the document again.
    """
    same = ["doc_id", "h1", "h2", "item_id"]
    by_block = found.withColumn("copy", F.struct("probes_found", "start", "stop", "edits", "matched")).groupBy(*same, "copy").agg(F.count(F.lit(1)).alias("copies"))
    merged = by_block.groupBy(*same).agg(
        F.sum("copy.probes_found").cast("int").alias("probes_found"), F.min("copy.start").alias("start"), F.max("copy.stop").alias("stop"),
        F.min("copy.edits").alias("edits"), F.first("copy.matched").alias("matched"), F.max("copies").alias("copies"), F.count(F.lit(1)).alias("blocks"),
    )
    merged = materialize(merged)
    whole = merged.where("blocks = 1")
    texts = rows.join(merged.where("blocks > 1").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    compared = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    compared = F.regexp_replace(F.regexp_replace(compared, "[ \\t\\n\\x0b\\f\\r]+", " "), "^ | $", "")
    cut = F.substring(compared, (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    several = merged.where("blocks > 1").join(texts, ["h1", "h2"]).withColumn("matched", cut).drop("text")
    every = join_keys(whole.unionByName(several), probes.groupBy("item_id").agg(F.sum("probes").cast("int").alias("probes")), ["item_id"])
    every = every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select("doc_id", "item_id", "probes", "probes_found", "start", "stop", "edits", "matched")


def _search(items: list[tuple[int, str]]):
    key = ("probes", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = per_worker(key, lambda: Searched(items))
        names = ["doc_id", "h1", "h2", "item_id", "probes", "probes_found", "start", "stop", "edits", "matched"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        gap = np.full(2 * PROBE, GAP, np.uint32)
        for part in slices(batches, limit=SLICE):
            if not searched.per_item:
                continue
            parts, starts, at = [gap], [], len(gap)
            for text in part.column("text").to_pylist():
                codes = codes_of(text)
                starts.append(at)
                parts += [codes, gap]
                at += len(codes) + len(gap)
            codes, starts = np.concatenate(parts), np.array(starts)
            ends = np.r_[starts[1:], at] - len(gap)
            best: dict[tuple, list] = {}
            for item, p, e, a, b in searched.matches(codes):
                # a match can begin in the gap before its document, but lies in it for the most part
                d = int(np.searchsorted(starts, (a + b) // 2, side="right")) - 1
                a, b = max(a, int(starts[d])), min(b, int(ends[d]))
                row = best.setdefault((d, item), [set(), a, b, e])
                row[0].add(p)
                row[1:] = [min(row[1], a), max(row[2], b), min(row[3], e)]
            ids = list(zip(*[part.column(c).to_pylist() for c in ("doc_id", "h1", "h2")]))
            out = []
            for (d, item), (hit, a, b, e) in sorted(best.items(), key=lambda x: (x[0][0], x[1][1])):
                text = codes[a:b].tobytes().decode("utf-32-le", "replace")
                out.append((*ids[d], item, searched.per_item[item], len(hit), a - int(starts[d]), b - int(starts[d]), e, text))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run
