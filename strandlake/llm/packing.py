"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at every full window; each full piece is a window of its own.
What is left over is cut into pieces of at most PIECE ids. The pieces of a group are
spread over k windows by differencing: every piece is a partial partition with one
filled window; the two partial partitions of the greatest imbalance are merged, the
fullest window of the one with the emptiest of the other, until one is left. Its
windows are nearly equal; if the fullest exceeds the capacity, k rises by one.
A partial partition holds its filled windows only, and a window the first and last of
a linked list of pieces, so memory grows with the pieces and not with k.
Groups are closed within the task that encodes the texts, so nothing is shuffled and
a lost task is repeated alike.

Sequences are padded to the capacity, except those whose length is a power of two. So what
is left at the end of a task and fills no window is cut into sequences of such lengths.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, load
from .common import bounded, texts_of, tidy

PIECE = 128
#: Windows of a group, and pieces that close it as well: short documents make many pieces.
WINDOWS = 192
PIECES = 1 << 16
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0..k-1) of each size. Ties go by the order of the sizes."""
    n = len(sizes)
    follow = [-1] * n  # the next piece in the same window
    # a partial partition: its filled windows (-sum, first piece, last piece), fullest first; empty ones aren't held
    held: dict[int, list[tuple[int, int, int]]] = {i: [(-s, i, i)] for i, s in enumerate(sizes)}
    heap = [(-int(s) if k > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        a, b = held.pop(heapq.heappop(heap)[1]), held.pop(heapq.heappop(heap)[1])
        if len(a) < len(b):
            a, b = b, a
        if len(a) + len(b) <= k:  # every filled window meets an empty one
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:
            alone = k - len(b)
            both = []
            for i in range(alone, len(a)):
                s, first, last = a[i]
                t, head, tail = b[k - 1 - i]
                follow[last] = head
                both.append((s + t, first, tail))
            a = sorted([*a[:alone], *both, *b[: k - len(a)]])
        if len(a) == k and a[-1][0]:  # only differences matter
            least = a[-1][0]
            a = [(s - least, first, last) for s, first, last in a]
        held[made] = a
        heapq.heappush(heap, (a[0][0] - (a[-1][0] if len(a) == k else 0), made))
        made += 1
    out = np.zeros(n, np.int64)
    for window, (_, at, _) in enumerate(held[made - 1] if n else []):
        while at >= 0:
            out[at] = window
            at = follow[at]
    return out


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size, none over the capacity; as few windows as differencing manages."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        at = differencing(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return at
        k += 1


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows of docs(doc_id, text): COLUMNS, and the ids if asked for.

    A row's ids are those of the vocabulary file and end_id after them; null and empty
    texts have end_id alone. doc_tokens counts it. Each id lies in exactly one piece; the
    pieces of a sequence lie at offsets without gaps from 0; a sequence is as long as the capacity
    or padded to it, but for a task's last ones, whose lengths are powers of two. Repeated rows are packed
    each; null doc_ids stay; other columns are ignored; an empty table gives no piece.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load(path))
    fields = [(c.split()[0], pa.int64()) for c in COLUMNS.split(", ")]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        waiting: list[tuple] = []
        size = 0

        def piece(doc, start: int, part: bytes, total: int, offset: int, into: int) -> None:
            rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, into, offset, *([np.frombuffer(part, "<i4")] if with_ids else [])))

        def close() -> None:
            nonlocal sequence, waiting, size
            at = windows([len(w[2]) // 4 for w in waiting], capacity).tolist()
            if max(at) == 0 and size < capacity:
                return close_rest()
            filled = [0] * (max(at) + 1)
            names: dict[int, int] = {}
            for (doc, start, part, total), k in zip(waiting, at, strict=True):
                piece(doc, start, part, total, filled[k], sequence + names.setdefault(k, len(names)))
                filled[k] += len(part) // 4
            sequence += len(names)
            waiting, size = [], 0

        def close_rest() -> None:
            """Less than a window: sequences of powers of two, the longest first."""
            nonlocal sequence, waiting, size
            room, offset = 1 << size.bit_length() - 1, 0
            for doc, start, part, total in waiting:
                while part:
                    cut = min(len(part), 4 * (room - offset))
                    piece(doc, start, part[:cut], total, offset, sequence)
                    start, part, offset, size = start + cut // 4, part[cut:], offset + cut // 4, size - cut // 4
                    if offset == room:
                        sequence += 1
                        room, offset = 1 << max(size.bit_length() - 1, 0), 0
            waiting, size = [], 0

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return b

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), codec.encode(texts_of(b.column(1))), strict=True):
                raw = memoryview(np.append(ids, end_id).astype("<u4").tobytes())
                total = len(ids) + 1
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    piece(doc, start, raw[4 * start : 4 * (start + capacity)], total, 0, sequence)
                    sequence += 1
                    if len(rows) >= 20_000:
                        yield out()
                for start in range(whole, total, PIECE):
                    part = bytes(raw[4 * start : 4 * (start + PIECE)])
                    waiting.append((doc, start, part, total))
                    size += len(part) // 4
                if size >= WINDOWS * capacity or len(waiting) >= PIECES:
                    close()
                if len(rows) >= 20_000:
                    yield out()
        if waiting:
            close()
        if rows:
            yield out()

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), COLUMNS + (", ids array<int>" if with_ids else ""))
