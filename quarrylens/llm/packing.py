"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylens.llm.common import id_and_text, keep_only, slices
from quarrylens.llm.encoding import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
GROUP_TOKENS = 1 << 20
KEPT_CHUNKS = 800_000  # beside them a worker holds a group of tokens
CODED_BYTES = 2 << 20  # of text, encoded at once: a worker holds many times as much meanwhile
#: monotonically_increasing_id(): partition number above, sequence number below.
SLOT_BITS = 33


def capacities(tokens: int, limit: int) -> list[int]:
    """Full sequences, then powers of two that hold what is left: their sum is ``tokens``."""
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], limit: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of one group of documents.

    A piece of n tokens costs n + quadratic * n * n: attention stays inside a piece. Whole
    sequences of long documents come first; what is left goes, longest first, to the
    sequence of the lowest cost so far that has room. Where no room is wide enough, the
    piece is cut to fill the lowest-cost sequence and the rest queues again. Capacities
    sum to the tokens, so no sequence is padded.
    """
    room = capacities(sum(lengths), limit)
    pieces, queue = [], []
    used = 0
    for d, n in enumerate(lengths):
        whole = n // limit
        for k in range(whole):
            pieces.append((d, k * limit, limit, used + k, 0))
        used += whole
        if n % limit:
            queue.append((-(n % limit), d, whole * limit))
    heapq.heapify(queue)
    # open sequences by the room they have left, each heap ordered by cost
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(limit + 1)]
    for s in range(used, len(room)):
        by_room[room[s]].append((0.0, s))
    cheapest = np.array([h[0][0] if h else np.inf for h in by_room])
    cheapest[0] = np.inf
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        r = n + int(np.argmin(cheapest[n:]))
        if cheapest[r] == np.inf:
            r = 1 + int(np.argmin(cheapest[1:]))
        take = min(n, r)
        cost, s = heapq.heappop(by_room[r])
        cheapest[r] = by_room[r][0][0] if by_room[r] else np.inf
        pieces.append((d, start, take, s, room[s] - r))
        if r > take:
            heapq.heappush(by_room[r - take], (cost + take + quadratic * take * take, s))
            cheapest[r - take] = by_room[r - take][0][0]
        if n > take:
            heapq.heappush(queue, (take - n, d, start + take))
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    max_tokens: int = 1024,
    end_id: int = 0,
    quadratic: float = 1 / 1024,
    group_tokens: int = GROUP_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of documents by training sequence: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each task encodes its documents and packs them in groups of about ``group_tokens``
    tokens; nothing is shuffled and a task holds one group. ``ids`` are little-endian
    unsigned 32-bit integers; ``sequence_id`` is unique over the table.

    A null or empty text is one token (the end id). A very long text is cut into as many
    sequences as it needs. Equal rows are packed once each; an empty table gives no rows;
    a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_only("encoder")
        encode = encoder(tokenizer, KEPT_CHUNKS).encode
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << SLOT_BITS

        def flush(ids, texts):
            nonlocal first
            lengths = [len(t) // 4 for t in texts]
            pieces = sorted(assign(lengths, max_tokens, quadratic), key=lambda p: p[3:])
            base, first = first, first + 1 + max(p[3] for p in pieces)
            d, start, length, sequence, offset = zip(*pieces)
            columns = [
                [ids[i] for i in d], start, length,
                [texts[i][4 * a : 4 * (a + n)] for i, a, n in zip(d, start, length)],
                [lengths[i] for i in d], [base + s for s in sequence], offset,
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

        ids, texts, held = [], [], 0
        for part in slices(batches):
            ids += part.column("doc_id").to_pylist()
            new = [t + end for few in slices([part], limit=CODED_BYTES) for t in encode(few.column("text"))]
            texts += new
            held += sum(map(len, new)) // 4
            if held >= group_tokens:
                yield flush(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield flush(ids, texts)

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SCHEMA)
