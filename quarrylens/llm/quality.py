"""Quality rules as a short-circuit cascade, in native expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text
from quarrylens.session import materialize, quoted

#: Rows on which cost and rejections are estimated. They set the order of the rules only:
#: the verdict is the same in any order.
SAMPLE_ROWS = 1000
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

Features = Callable[[str], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def symbols_in(text: Column) -> Column:
    rest = text
    for symbol in SYMBOLS:
        rest = F.replace(rest, F.lit(symbol))
    return (F.octet_length(text) - F.octet_length(rest)).cast("bigint")


def lines_in(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.octet_length(F.trim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)


def duplicates(values: Column) -> Column:
    return let(values, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("bigint"))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    The hash of each window, with its low bits replaced by the window's place, is sorted:
    equal windows become neighbours. The words at the places of these are sorted and
    compared, so that hashes that agree by chance count nothing. The places that are left,
    in order, each cover three words less the overlap with the next. Linear space, n log n time.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))).cast("bigint"))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    def repeats(keys: Column, bits: Column, w: Column) -> Column:
        def same(key: Column, other: Column) -> Column:
            return F.coalesce(F.call_function("shiftrightunsigned", key.bitwiseXOR(other), bits) == 0, F.lit(False))

        equal = F.filter(keys, lambda k, i: same(k, F.get(keys, i + 1)) | same(k, F.get(keys, i - 1)))
        places = F.transform(equal, lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1))
        window = lambda p: F.struct(*[F.get(w, p.cast("int") + i).alias(f"w{i}") for i in range(3)], p.alias("place"))
        return let(F.sort_array(F.transform(places, window)), confirmed)

    def confirmed(found: Column) -> Column:
        same = lambda t, other: F.coalesce(reduce(Column.__and__, [t[k] == other[k] for k in ("w0", "w1", "w2")]), F.lit(False))
        equal = F.filter(found, lambda t, i: same(t, F.get(found, i + 1)) | same(t, F.get(found, i - 1)))
        return let(F.sort_array(F.transform(equal, lambda t: t["place"])), covered)

    def windows(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        keys = F.transform(
            starts,
            lambda word, i: F.call_function(
                "shiftleft",
                F.call_function("shiftrightunsigned", F.xxhash64(word, F.get(w, i + 1), F.get(w, i + 2)), bits), bits,
            ).bitwiseOR(i.cast("bigint")),
        )
        return let(F.sort_array(keys), lambda k: repeats(k, bits, w))

    return let(words, windows)


#: Figures of a text, each from the text alone.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words_in(t)).cast("bigint"),
    "word_chars": lambda t: F.char_length(F.array_join(words_in(t), "")).cast("bigint"),
    "n_symbols": symbols_in,
    "n_lines": lambda t: F.size(lines_in(t)).cast("bigint"),
    "n_dup_lines": lambda t: duplicates(lines_in(t)),
    "n_repeat_words": lambda t: repeated_words(words_in(t)),
    "n_capitals": lambda t: F.regexp_count(t, F.lit("\\p{Lu}")).cast("bigint"),
    "n_exclaims": lambda t: (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!")))).cast("bigint"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A rule is true for a text it rejects.
RULES: dict[str, Callable[[Features], Column]] = {
    "few_words": lambda f: f("n_words") < 50,
    "repeated_words": lambda f: 100 * f("n_repeat_words") > 50 * f("n_words"),
    "symbols": lambda f: 10 * f("n_symbols") > f("n_words"),
    "duplicate_lines": lambda f: 2 * f("n_dup_lines") > f("n_lines"),
    "capitals": lambda f: 10 * f("n_capitals") > 4 * f("word_chars"),
    "exclaims": lambda f: 2 * f("n_exclaims") > f("n_words"),
}


def cascade_order(rows: DataFrame, rules: dict[str, Callable[[Features], Column]], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second, both measured on a sample of the texts."""
    total = rows.count()
    share = min(1.0, 2 * sample_rows / max(1, total))
    sample = materialize((rows.sample(share, seed=7) if share < 1 else rows).select("text").limit(sample_rows))
    worth = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sample.agg(F.avg(rule(lambda feature: FEATURES[feature](F.col("text"))).cast("int"))).first()[0] or 0.0
        worth[name] = rejected / max(1e-6, time.perf_counter() - began)
    return sorted(worth, key=lambda name: (-worth[name], name))


def first_rejection(features: Features, rules: dict[str, Callable[[Features], Column]], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects; later ones are then not evaluated."""
    out = F.when(rules[order[0]](features), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(rules[name](features), F.lit(name))
    return out


def quality(
    docs: DataFrame,
    rules: dict[str, Callable[[Features], Column]] = RULES,
    sample_rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Base figures of every text and the verdict of the rules: one row per row of ``docs``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under 50 words, or over half of them repeated), failed_rule (the first
    rejecting rule in the cascade's order, else null) and kept. The figures that the
    result needs anyway are computed once; other figures only where the cascade gets there.

    Words lie between ASCII white space. A null or empty text has no words and fails.
    Texts of any length are read whole; equal rows are judged alike; an empty table gives
    no rows; a null id stays null. Everything is a projection: no shuffle, no Python.
    """
    rows = id_and_text(docs, id_column, text_column)
    order = cascade_order(rows, rules, sample_rows)
    words = rows.withColumn("words", words_in(F.col("text")))
    figures = words.select(
        "doc_id", "text", F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        FEATURES["n_symbols"](F.col("text")).alias("n_symbols"),
        FEATURES["n_dup_lines"](F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )

    def feature(name: str) -> Column:
        return F.col(name) if name in BASE else FEATURES[name](F.col("text"))

    failed = RULES["few_words"](feature) | RULES["repeated_words"](feature)
    judged = figures.select("doc_id", *BASE, failed.alias("base_failed"), first_rejection(feature, rules, order).alias("failed_rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def keep_good(
    docs: DataFrame,
    rules: dict[str, Callable[[Features], Column]] = RULES,
    sample_rows: int = SAMPLE_ROWS,
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects; a null text is rejected by the word count.

    A filter with the rules in cascade order: each figure is computed from the text where
    it is first needed, so that a rejected row costs no more than the rules up to its own.
    """
    text = F.coalesce(quoted(text_column), F.lit(""))
    order = cascade_order(docs.select(text.alias("text")), rules, sample_rows)
    return docs.where(first_rejection(lambda name: FEATURES[name](text), rules, order).isNull())
