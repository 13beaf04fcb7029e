"""Keyword counts against a search word by word."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.functions.keywords import keyword_hits
from quarrylens.functions.lexicon import CODONS, DOMAIN_KEYWORDS
from quarrylens.operators import catalog


@pytest.mark.parametrize("vocabularies", [
    list(DOMAIN_KEYWORDS.values()), [["a", "ab", "ab"], [], ["b", "bc", "abc", "c\n"]], [[]], [["é", "日本", "😀x"]],
])
def test_hits_are_those_of_every_word(spark, vocabularies):
    rng = random.Random(4)
    words = [w for ws in vocabularies for w in ws] + ["a", "b", "c", " ", "\n", "é", "日本語", "😀"]
    texts = [None, "", *("".join(rng.choice(words) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 60))) for _ in range(200)), "ab" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r["i"]: r["h"] for r in df.select("i", keyword_hits(F.col("t"), vocabularies).alias("h")).collect()}
    assert got == {i: [sum(w in (t or "") for w in ws) for ws in vocabularies] for i, t in enumerate(texts)}


def test_empty_words_are_an_error():
    with pytest.raises(ValueError):
        keyword_hits(F.col("t"), [["a", ""]])


def test_every_domain_and_the_first_on_ties(spark):
    rows = [(d, w) for d, words in DOMAIN_KEYWORDS.items() for w in words] + [("none", "qqqq"), ("none", None)]
    df = spark.createDataFrame(rows, "expected string, text string").withColumn("_hits", F.lit(1))
    for r in catalog.route(df, "text").collect():
        counts = {d: sum(w in (r["text"] or "") for w in words) for d, words in DOMAIN_KEYWORDS.items()}
        best = max(counts.values())
        assert r["domain_score"] == 2 * best and r["_hits"] == 1
        assert r["domain"] == (next(d for d, n in counts.items() if n == best) if best else "statistics")


def test_codons_of_any_text(spark):
    rows = [("ATGTAAAT",), ("ATG日本語xx",), (None,), ("",), ("AT",), ("😀ATTAA",)]
    got = {r["codon"]: (r["count"], r["residue"]) for r in catalog.codon_counts(spark.createDataFrame(rows, "s string"), "s").collect()}
    assert got == {"ATG": (2, CODONS["ATG"]), "TAA": (1, "Stop"), "日本語": (1, "?"), "😀AT": (1, "?"), "TAA": (2, "Stop")}
