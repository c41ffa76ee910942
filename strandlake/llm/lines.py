"""Dedup of lines that many documents hold.

A line's key is the line without white space at its ends and with A-Z lower-cased. Two Bloom filters tell
which keys can be repeated: one of keys seen once, and one of keys seen when the first already
held them. Tasks fill filters of their own, which are merged: what two tasks have both seen is
seen twice. Only lines that the second filter holds are shuffled, as keys, to be counted exactly and
to find the document that keeps them. What is confirmed goes back to the texts where they are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, batch, bounded, stored, texts_of, tidy

#: Code points that a key needs, and documents that it has to be in.
LEAST, DOCUMENTS = 40, 5
#: Bits of a filter for every key, and the largest filter as a power of two (64 MB).
BITS, LARGEST = 8, 29
#: Bytes of a filter that are merged at once.
BLOCK = 1 << 20

_BLOCKS = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_KEYS = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("sha", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """A line's key, or None if it has fewer than `least` code points."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()  # of bytes, lower() changes A-Z only
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def _keys(text: bytes, least: int) -> set[bytes]:
    """A text's distinct keys."""
    return {k for k in (key_of(x, least) for x in text.split(b"\n")) if k is not None}


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of 2^bits."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """A Bloom filter of two bits a key."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _places(hashes, self.bits)
        return ((self.data[a >> 3] >> (a & 7)) & (self.data[b >> 3] >> (b & 7)) & 1).astype(bool)

    def add(self, hashes: np.ndarray) -> None:
        for x in _places(hashes, self.bits):
            np.bitwise_or.at(self.data, x >> 3, (1 << (x & 7)).astype(np.uint8))


def _fill(bits: int, least: int):
    """A task's two filters, in blocks; blocks without a bit are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for b in batches:
            seen: list[int] = []
            for text in texts_of(b.column(0)):
                seen.extend(xxhash.xxh3_64_intdigest(k) for k in _keys(text, least))
            hashes, n = np.unique(np.array(seen, np.uint64), return_counts=True)
            twice.add(hashes[(n > 1) | once.holds(hashes)])
            once.add(hashes)
        for i in range(0, len(once.data), BLOCK):
            if once.data[i : i + BLOCK].any():
                yield batch(_BLOCKS, [i // BLOCK], [zlib.compress(once.data[i : i + BLOCK].tobytes(), 1)], [zlib.compress(twice.data[i : i + BLOCK].tobytes(), 1)])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of each block, which follow each other: bits that two tasks have set once are set twice."""
    at, once, twice = None, None, None
    for b in batches:
        for block, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = (np.frombuffer(zlib.decompress(v), np.uint8) for v in (x, y))
            if block == at:
                twice |= y | (once & x)
                once |= x
                continue
            if at is not None:
                yield batch(_BLOCKS, [at], [b""], [zlib.compress(twice.tobytes(), 1)])
            at, once, twice = block, x.copy(), y.copy()
    if at is not None:
        yield batch(_BLOCKS, [at], [b""], [zlib.compress(twice.tobytes(), 1)])


def twice_seen(docs: DataFrame, least: int = LEAST, largest: int = LARGEST) -> tuple[int, bytes] | None:
    """The filter of keys that more than one document may hold: its bits as a power of two, and its compressed bytes.

    It never misses such a key. Its size follows the number of keys, up to 2^largest bits. With over two keys a
    bit it would hold nearly everything, and None is given: every key is to be counted.
    """
    text = F.coalesce("text", F.lit(""))
    most = F.least(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.ceil((F.length(text) + 1) / (max(1, least) + 1)))
    n = docs.agg(F.sum(most.cast("long")).alias("n")).first()["n"] or 0
    if n > 2 << largest:
        return None
    bits = max(13, min(largest, (n * BITS - 1).bit_length() if n else 0))
    filled = bounded(docs).select("text").mapInArrow(tidy(_fill(bits, least)), "block int, once binary, twice binary")
    merged = filled.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_merge), "block int, once binary, twice binary")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in merged.select("block", "twice").collect():  # 64 MB at most
        part = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint8)
        whole[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return bits, zlib.compress(whole.tobytes(), 1)


def _suspects(sieve, least: int, digests: bool):
    """Each document's distinct keys that the filter holds, with the text's digest if it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        bits, data = sieve.value if sieve else (0, b"")
        known = Filter(bits, np.frombuffer(zlib.decompress(data), np.uint8)) if sieve else None
        for b in batches:
            keys: list[bytes] = []
            rows: list[int] = []
            sha: list[str | None] = []
            for i, text in enumerate(texts_of(b.column(1))):
                found = _keys(text, least)
                if found:
                    keys.extend(found)
                    rows.extend([i] * len(found))
                    sha.extend([hashlib.sha256(text).hexdigest() if digests else None] * len(found))
            keep = known.holds(np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))) if known else np.ones(len(keys), bool)
            at = np.flatnonzero(keep)
            yield batch(_KEYS, pa.array([keys[i] for i in at], pa.binary()).cast(pa.string()), b.column(0).take(pa.array([rows[i] for i in at], pa.int64())), [sha[i] for i in at])

    return run


def suspects(docs: DataFrame, sieve: tuple[int, bytes] | None, least: int = LEAST, digests: bool = False) -> DataFrame:
    """key, doc_id, sha of the distinct keys of every row that the filter holds."""
    spread = docs.sparkSession.sparkContext.broadcast(sieve) if sieve else None
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_suspects(spread, least, digests)), "key string, doc_id long, sha string")


def repeated(found: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """key, keep_id: the keys that at least so many documents hold, and the largest doc_id that does. Counted before the shuffle, then after it."""
    return found.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= documents).drop("n")


def _without(lines: list[bytes], drop, least: int) -> tuple[bytes, int]:
    kept = [x for x in lines if (k := key_of(x, least)) is None or not drop(k)]
    return b"\n".join(kept), len(lines) - len(kept)


def _kept(keep, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keep.value
        for b in batches:
            texts, n, dropped = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                lines = text.split(b"\n")
                left, gone = _without(lines, lambda k, d=doc_id: k in of and of[k] != d, least)
                texts.append(left)
                n.append(len(lines))
                dropped.append(gone)
            yield batch(_KEPT, b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), n, dropped)

    return run


def _kept_of_lists(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, dropped = [], [], []
            for text, keys in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone_keys = {k.encode() for k in keys or ()}
                left, gone = _without(lines, gone_keys.__contains__, least)
                texts.append(left)
                n.append(len(lines))
                dropped.append(gone)
            yield batch(_KEPT, b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), n, dropped)

    return run


_OUT = "doc_id long, text string, n_lines long, n_dropped long"


def without_repeated_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, largest: int = LARGEST, rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text without the lines dropped, n_lines before that, n_dropped.

    A text is split at every newline; null and empty texts are one empty line, and come back empty. Keys of at least
    `least` code points (white space is space, tab, newline, vertical tab, form feed, carriage return) that at least `documents` rows hold
    lose all their lines but in the rows of the largest doc_id that holds them; there all of them stay. A row is a document: equal
    rows, and rows of one doc_id, count one each. A null doc_id is the smallest. Other columns are ignored; an empty
    table gives an empty result. Jobs run while the result is declared.

    Confirmed keys are broadcast if there are at most `rows` of them and 32 MB of bytes. Otherwise the keys that each
    document loses are gathered by doc_id and digest, and joined to the documents by shuffles.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sieve = twice_seen(named, least, largest)
    keys = stored(repeated(suspects(named, sieve, least), documents))
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    if size["n"] <= rows and (size["bytes"] or 0) <= BROADCAST_BYTES:
        keep = {r["key"].encode(): r["keep_id"] for r in keys.collect()}
        return bounded(named).mapInArrow(tidy(_kept(docs.sparkSession.sparkContext.broadcast(keep), least)), _OUT)
    held = suspects(named, sieve, least, digests=True)
    lost = held.join(keys, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lists = lost.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(F.collect_set("key").alias("_keys"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    joined = named.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_sha")), "left")
    return bounded(joined).select("doc_id", "text", "_keys").mapInArrow(tidy(_kept_of_lists(least)), _OUT)
