"""License notices: exact phrases, and short notices with a few edits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylens.llm.common import id_and_text, per_worker, slices

#: Fixed values of the contract: phrases that count where their words stand consecutively.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices, found with edits. Edits allowed: one in EDIT_SHARE characters.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
EDIT_SHARE = 8

SPAN = "struct<notice:string,label:string,first_word:bigint,last_word:bigint,edits:int,matched:string>"
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    f"base_labels array<string>, labels array<string>, score double, spans array<{SPAN}>"
)
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


class Scanner:
    def __init__(self, phrases: Mapping[str, str], notices: Mapping[str, str], edit_share: int):
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        for notice, label in notices.items():
            edits = len(notice) // edit_share
            # with at most `edits` edits, one of edits + 1 pieces stands unchanged
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            seeds = [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]
            fuzzy = regex.compile(f"(?e)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")
            self.notices.append((notice, label, edits, seeds, [s.encode() for s, _ in seeds], fuzzy))

    def base(self, padded: bytes) -> list[tuple[int, str]]:
        """(index of the first word, label) of every place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            at, word, seen = padded.find(phrase), 0, 0
            while at >= 0:
                word, seen = word + padded.count(b" ", seen, at), at
                out.append((word, label))
                at = padded.find(phrase, at + 1)
        return out

    def fuzzy(self, padded: bytes) -> list[dict]:
        """Best span of each notice in every stretch of the text that holds one of its seeds."""
        out, text = [], None
        for notice, label, edits, seeds, raw, fuzzy in self.notices:
            if not any(s in padded for s in raw):
                continue
            text = padded.decode("utf-8", "replace") if text is None else text
            windows = []
            for seed, offset in seeds:
                at = text.find(seed)
                while at >= 0:
                    # where the notice can lie if this seed is a part of it
                    windows.append((max(0, at - offset - edits), at - offset + len(notice) + edits))
                    at = text.find(seed, at + 1)
            windows.sort()
            merged = []
            for a, b in windows:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                place = a
                while (m := fuzzy.search(text, place, b)) is not None:
                    start, stop = m.start(), m.end()
                    found = m.group().strip()
                    # the words joined by spaces, with one space before the first
                    first = text.count(" ", 0, text.index(found, start)) - 1
                    out.append(
                        dict(notice=notice, label=label, first_word=first, last_word=first + found.count(" "),
                             edits=sum(m.fuzzy_counts), matched=found)
                    )
                    place = max(stop, place + 1)
        return out

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()
        padded = b" " + b" ".join(words) + b" "
        base = self.base(padded)
        spans = self.fuzzy(padded)
        starts = [w for w, _ in base]
        exact = {label for _, label in base}
        best = max((1 - s["edits"] / len(s["notice"]) for s in spans), default=0.0)
        return dict(
            n_words=len(words), n_base=len(base),
            first_word=min(starts, default=None), last_word=max(starts, default=None),
            base_labels=sorted(exact), labels=sorted(exact | {s["label"] for s in spans}),
            score=1.0 if base else best, spans=spans,
        )


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE_PHRASES,
    notices: Mapping[str, str] = NOTICES,
    edit_share: int = EDIT_SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """License phrases and notices of every text, with the spans of the notices.

    Texts are compared as their words, lower-cased and joined by one space. A notice of n
    characters may hold n // edit_share edits. It is cut into one piece more than that; a
    piece found unchanged marks a stretch, in which the regex library looks for the best
    match within the bound. Columns: doc_id, n_words, n_base, first_word, last_word (of
    exact phrases), base_labels, labels (sorted arrays), score (1 for an exact phrase,
    else 1 - edits / length of the best notice, 0 without one) and spans (word positions).

    No shuffle; the lists are parameters and not data. A null or empty text has no words,
    null positions, no labels and score 0. Texts of any length are scanned whole. Equal
    rows give equal rows; an empty table gives none; a null id stays null.
    """
    lists = (tuple(phrases.items()), tuple(notices.items()), edit_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(("licenses", lists), lambda: Scanner(dict(lists[0]), dict(lists[1]), lists[2]))
        span = pa.struct([("notice", pa.string()), ("label", pa.string()), ("first_word", pa.int64()),
                          ("last_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
             ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
             ("score", pa.float64()), ("spans", pa.list_(span))]
        )
        for part in slices(batches):
            found = [scanner.scan(t) for t in part.column("text").to_pylist()]
            for row, doc_id in zip(found, part.column("doc_id").to_pylist()):
                row["doc_id"] = doc_id
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SCHEMA)
