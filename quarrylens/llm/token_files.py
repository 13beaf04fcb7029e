"""Token ids in fixed-width bit-packed segments, written and read by Spark tasks.

A token table is a Parquet folder, so Spark's committer makes lost or repeated tasks
harmless and any store Spark can write to will do. One row is one segment:

shard          number of the range of ids (ascending over the table)
first_token    tokens of the shard before this segment
n_tokens       tokens in it
width          bits of each id: the least that hold the vocabulary
block_offsets  byte offset in ``payload`` of every block of BLOCK tokens, and its end
doc_ids        the documents in it, ascending, each whole
doc_ends       end of each document, in tokens of the segment
payload        the ids, most significant bit first; a block starts on a byte

``unpack`` reads any token range from the blocks it touches, with numpy alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import id_and_text, slices
from quarrylens.llm.encoding import encoder
from quarrylens.session import scratch_folder

BLOCK = 4096
SEGMENT_TOKENS = 1 << 19
SEGMENTS = (
    "shard bigint, first_token bigint, n_tokens bigint, width int, block_offsets array<bigint>, "
    "doc_ids array<bigint>, doc_ends array<bigint>, payload binary"
)
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def pack_bits(ids: np.ndarray, width: int) -> tuple[bytes, list[int]]:
    """Bytes of ``ids`` at ``width`` bits each, and the offset of every block and of the end."""
    parts, offsets = [], [0]
    for i in range(0, len(ids), BLOCK):
        rows = ids[i : i + BLOCK].astype(">u4").view(np.uint8).reshape(-1, 4)
        if width % 8:
            parts.append(np.packbits(np.unpackbits(rows, axis=1)[:, 32 - width :]).tobytes())
        else:  # whole bytes
            parts.append(rows[:, 4 - width // 8 :].tobytes())
        offsets.append(offsets[-1] + len(parts[-1]))
    return b"".join(parts), offsets


def unpack(payload: bytes, width: int, offsets, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment, from the blocks that hold them."""
    if stop <= start:
        return np.empty(0, "<u4")
    first, last = start // BLOCK, (stop - 1) // BLOCK
    out = []
    for b in range(first, last + 1):
        data = np.frombuffer(payload, np.uint8, offsets[b + 1] - offsets[b], offsets[b])
        n = len(data) * 8 // width
        if width % 8:
            rows = np.zeros((n, 32), np.uint8)
            rows[:, 32 - width :] = np.unpackbits(data)[: n * width].reshape(n, width)
            rows = np.packbits(rows, axis=1)
        else:  # whole bytes
            rows = np.zeros((n, 4), np.uint8)
            rows[:, 4 - width // 8 :] = data.reshape(n, width // 8)
        out.append(rows.view(">u4").ravel().astype("<u4"))
    # the last block may end in less than a byte of filling, never a whole id of it
    ids = np.concatenate(out)
    return ids[start - first * BLOCK : stop - first * BLOCK]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write segments in ascending id order.

    A null or empty text is the end id alone; equal ids keep all their rows, in any order
    among themselves; a null id comes first; an empty table writes no segment. A segment
    holds whole documents, so only a very long one makes it large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = encoder(tokenizer)
        width = max(1, (max(tool.size, end_id + 1) - 1).bit_length())
        end = np.array([end_id], "<u4").tobytes()
        shard, before = TaskContext.get().partitionId(), 0

        def segment(ids, texts):
            tokens = np.frombuffer(b"".join(texts), "<u4")
            payload, offsets = pack_bits(tokens, width)
            ends = np.cumsum([len(t) // 4 for t in texts]).tolist()
            return pa.RecordBatch.from_pylist(
                [dict(shard=shard, first_token=before, n_tokens=len(tokens), width=width, block_offsets=offsets,
                      doc_ids=ids, doc_ends=ends, payload=payload)],
                schema=pa.schema(
                    [("shard", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
                     ("block_offsets", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
                     ("doc_ends", pa.list_(pa.int64())), ("payload", pa.binary())]
                ),
            )

        ids, texts, held = [], [], 0
        for part in slices(batches):
            ids += part.column("doc_id").to_pylist()
            new = [t + end for t in tool.encode(part.column("text"))]
            texts += new
            held += sum(map(len, new)) // 4
            if held >= SEGMENT_TOKENS:
                yield segment(ids, texts)
                ids, texts, before, held = [], [], before + held, 0
        if ids:
            yield segment(ids, texts)

    rows = id_and_text(docs, id_column, text_column)
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token table: doc_id, start (tokens of all documents before it), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers, the end id included.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # one row per shard: as many as the writer had partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        segments.groupBy("shard")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    )
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], r["width"], r["block_offsets"], 0, r["n_tokens"])
                starts = [0, *r["doc_ends"][:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array([r["base"] + r["first_token"] + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, r["doc_ends"])], pa.int64()),
                        pa.array([ids[s:e].tobytes() for s, e in zip(starts, r["doc_ends"])], pa.binary()),
                    ],
                    schema=schema,
                )

    return segments.join(F.broadcast(bases), "shard").mapInArrow(run, DOCUMENTS)


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as a token table in the shared folder and read it back."""
    spark = docs.sparkSession
    path = f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
