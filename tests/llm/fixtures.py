"""Small tables with the awkward rows every operator must take."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string"
WORDS = "the of and to in that it is was for on as with be at by this from they which under public license river".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", ".", ","]) for _ in range(n))


def awkward():
    """Null ids and texts, empty and blank texts, a very long text and word, copies, near copies, repeated rows."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (3, base.replace("river", "lake", 1)), (4, None), (5, ""), (6, " \t\n \x0b "), (7, "word"),
        (8, "Zwei Wörter"), (9, "x" * 30_000), (10, prose(2, 8_000)), (11, "a\nb\na\nb\n\n" + base), (None, base), (None, None),
        (12, "日本語 の テキスト 😀 𝒳 é̀"), (13, "The MIT License\nthe mit license"), (14, "a  b   c   d \x1c e\u0085f"),
        (15, "<|endoftext|> x<|endoftext|> </s> <0x0A>"), (16, prose(3, 60)), (16, prose(3, 60)), (17, prose(3, 60)),
        (18, "\n".join([prose(4, 30)] * 5)), (19, "ab" * 400), (20, "\0 nul \0"),
    ]
    return rows


CLASHES = (
    "score label n_words kept block band g c doc h1 h2 id component_id lines_no start ids sig copies members place marks words _id _parts"
).split()


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(CLASHES if clashes else []):
        df = df.withColumn(name, F.lit(i))
    return df


def documents(path):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def by_id(rows, *names):
    """Sorted values per id, so that repeated rows compare."""
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(tuple(r[n] for n in names))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def expected(rows, judge):
    out = {}
    for doc_id, text in rows:
        out.setdefault(doc_id, []).append(judge(doc_id, text or ""))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def words_of(text):
    return text.encode().lower().split()
