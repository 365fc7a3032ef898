"""Packing documents into fixed-length training sequences (op1)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: ``k`` lists of item numbers with nearly equal sums.

    A partial partition is its non-empty parts in descending order.  The two
    with the greatest imbalance are merged, the largest part of one with the
    smallest of the other, until one partition is left.
    """
    order = count()
    heap = [(-s, next(order), [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = k - len(b)  # parts of a that meet an empty part of b
        merged = a[:alone] + [(s + t, x + y) for (s, x), (t, y) in zip(a[alone:], reversed(b))]
        merged += b[: len(b) - max(0, len(a) - alone)]
        merged.sort(key=lambda part: -part[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], next(order), merged))
    return [items for _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items in windows of at most ``capacity``; a window more while one is over.

    With one window an item the capacity holds, so this ends.
    """
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        most = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if most <= capacity:
            return parts
        k += max(1, int(k * (most / capacity - 1) / 4))


def pack_documents(docs: DataFrame, vocabulary: str, seq_len: int = 2048, end_id: int = 1, block: int = 1024, grain: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut documents into pieces and lay these into sequences of ``seq_len`` ids.

    A document of ``n`` ids (its end id counted) gives ``n // seq_len`` full
    sequences; its rest, cut into pieces of ``grain`` at most, waits in a block.
    Each block of ``block`` pieces is divided by ``windows``.  Blocks belong to
    one task each, so nothing is shuffled, memory is bounded by the block, and a
    rerun of a lost task gives the same rows; ``sequence_id`` counts from
    ``partition * 2**32``.

    Null and empty texts are documents of the end id alone.  A repeated row or
    id is packed as often as it occurs.  An empty table gives no rows.  Of a very
    long text all ids are in memory at once, some 40 bytes a token.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        sequence = count(TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def flush() -> None:
            for items in windows([piece[2] for piece in waiting], seq_len):
                number, offset = next(sequence), 0
                for i in items:
                    doc, start, length, ids, total = waiting[i]
                    rows.append((doc, start, length, ids, total, number, offset))
                    offset += length
            waiting.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return batch

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(texts_of(batch, "text"))):
                raw += end
                total = len(raw) // 4
                full = total // seq_len * seq_len
                for start in range(0, full, seq_len):
                    rows.append((doc, start, seq_len, raw[4 * start : 4 * (start + seq_len)], total, next(sequence), 0))
                for start in range(full, total, grain):
                    length = min(grain, total - start)
                    waiting.append((doc, start, length, raw[4 * start : 4 * (start + length)], total))
                if len(waiting) >= block:
                    flush()
                if len(rows) >= 4096:
                    yield out()
        flush()
        if rows:
            yield out()

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text"), pack, PIECES)
