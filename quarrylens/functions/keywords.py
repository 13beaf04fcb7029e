"""Which words of several vocabularies a text contains, from one walk over the text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def automaton(vocabularies: tuple[tuple[str, ...], ...]):
    """The automaton of all distinct words, and how often each word is in each vocabulary."""
    import ahocorasick

    words = sorted({w for words in vocabularies for w in words})
    if "" in words:
        raise ValueError("an empty word is in every text")
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(word, i)
    if words:
        found.make_automaton()
    times = np.array([[words_of.count(w) for words_of in vocabularies] for w in words], np.int32).reshape(len(words), len(vocabularies))
    return found if words else None, times


def keyword_hits(text: Column, vocabularies: Sequence[Sequence[str]]) -> Column:
    """How many words of each vocabulary the text contains, anywhere in it; a repeated word counts as often as it is given.

    The text is read once whatever the number of vocabularies. Case counts; a missing text
    contains nothing.
    """
    key = tuple(tuple(words) for words in vocabularies)
    automaton(key)  # a bad vocabulary is an error here

    @F.arrow_udf("array<int>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found, times = automaton(key)
        for texts in batches:
            out = np.zeros((len(texts), len(key)), np.int32)
            for row, value in enumerate(texts.to_pylist() if found is not None else ()):
                words = {i for _, i in found.iter(value)}
                if words:
                    out[row] = times[list(words)].sum(axis=0)
            of = np.arange(len(texts) + 1, dtype=np.int32) * len(key)
            yield pa.ListArray.from_arrays(of, out.ravel())

    return hits(F.coalesce(text, F.lit("")))
