"""What the operators share: input columns, byte-bounded slices, tokenizer files, per-worker objects."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.ordering import join_keys, with_index
from quarrylens.session import materialize, quoted

SLICE_BYTES = 4 << 20


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty.

    Other columns never reach the operator, so their names cannot clash with its own.
    """
    return docs.select(
        quoted(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(quoted(text_column), F.lit("")).alias("text"),
    )


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_worker(key: tuple, make: Callable):
    """An object that one Python worker builds once and keeps across tasks, one for each first part of a key."""
    kept = sys.__dict__.setdefault("_quarrylens_kept", {})
    if key[0] not in kept or kept[key[0]][0] != key:
        kept.pop(key[0], None)
        kept[key[0]] = (key, make())
    return kept[key[0]][1]


def keep_only(kind: str) -> None:
    """Drop what other operators have built in this Python worker, which takes their memory with it from stage to stage."""
    kept = sys.__dict__.get("_quarrylens_kept", {})
    if others := [k for k in kept if k != kind]:
        for k in others:
            del kept[k]
        release()


def release() -> None:
    """Give freed memory back: a Python worker stays while stages without Python run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already written) marked for broadcast if its rows fit in ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def keyed(docs: DataFrame, nulls_first: bool = False, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a number that names each row, and the name of its column.

    It is the id where all ids are there and differ. Else rows are numbered by id, then by
    a hash of the text: rows that share an id have numbers of their own, in the order of
    ids, with null ids before or after all others. Rows equal in id and text share one.
    """
    key = fresh(docs, "row_key")
    given = docs.withColumn(key, quoted(id_column).cast("bigint"))
    if given.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        return given, key
    names = {c: fresh(given, c) for c in ("absent_id", "h1", "h2")}
    absent = F.col(key).isNotNull() if nulls_first else F.col(key).isNull()
    text = quoted(text_column)
    given = given.withColumns({names["absent_id"]: absent, names["h1"]: F.xxhash64(text), names["h2"]: F.xxhash64(F.lit(1), text)})
    own = [names["absent_id"], key, names["h1"], names["h2"]]
    number = fresh(given, "row_number")
    numbers = materialize(with_index(given.select(*own).distinct(), own, name=number))
    numbered = join_keys(given, numbers, own).drop(*own)
    return numbered.withColumnRenamed(number, key), key
