"""Exact dedup by composable polynomial fingerprints.

A fingerprint of bytes is (n, H1, H2), where H = sum (byte + 1) * base^(n-1-i)
modulo a prime. Two neighbouring parts combine without their bytes:
H(xy) = H(x) * base^len(y) + H(y). So every text is hashed chunk by chunk, and the
pieces of a huge document are hashed by different tasks and combined afterwards.
Documents of equal fingerprints are then compared chunk by chunk with the one
that stays; those that differ from it are grouped again among themselves, until
every document is the same as its representative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, small, stored, texts_of, tidy

#: Two primes below 2^31 and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes that are hashed in one step, and characters of the pieces of a huge document.
CHUNK = 1 << 16
HUGE = 1 << 24

_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("text_sha256", pa.string())])
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_bytes", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])


def powers(modulus: int, base: int, n: int = CHUNK) -> np.ndarray:
    """base^(n-1) ... base^0 modulo the modulus."""
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def fingerprint(data: bytes, tables: tuple[np.ndarray, ...], moduli: tuple[int, ...], bases: tuple[int, ...] = BASES) -> list[int]:
    """H for each modulus; chunks are hashed apart and combined."""
    total = [0] * len(moduli)
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), CHUNK):
        chunk = view[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        n = len(chunk)
        for k, (p, table) in enumerate(zip(moduli, tables, strict=True)):
            total[k] = combine(total[k], int(np.dot(chunk, table[len(table) - n :])) % p, n, p, bases[k])
    return total


def combine(left: int, right: int, right_length: int, modulus: int, base: int) -> int:
    """The fingerprint of two parts set one after the other."""
    return (left * pow(base, right_length, modulus) + right) % modulus


def _hash_rows(moduli: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tuple(powers(m, b) for m, b in zip(moduli, BASES, strict=True))
        for b in batches:
            n, h, sha = [], [], []
            for t in texts_of(b.column(1)):
                n.append(len(t))
                h.append(fingerprint(t, tables, moduli))
                sha.append(hashlib.sha256(t).hexdigest())
            h = np.array(h, np.int64).reshape(-1, 2)
            yield batch(_ROWS, b.column(0), n, h[:, 0], h[:, 1], sha)

    return run


def _hash_pieces(moduli: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tuple(powers(m, b) for m, b in zip(moduli, BASES, strict=True))
        for b in batches:
            n, h = [], []
            for t in texts_of(b.column(3)):
                n.append(len(t))
                h.append([*fingerprint(t, tables, moduli), *(pow(x, len(t), m) for m, x in zip(moduli, BASES, strict=True))])
            h = np.array(h, np.int64).reshape(-1, 4)
            yield batch(_PIECES, b.column(0), b.column(1), b.column(2), n, *h.T)

    return run


def fingerprints(docs: DataFrame, moduli: tuple[int, int] = MODULI, huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, h1, h2, text_sha256), a row for every row of docs.

    Texts of over `huge` characters are cut into pieces that are hashed by any
    task and combined by length-shifted arithmetic.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > huge
    plain = docs.where(~long).mapInArrow(tidy(_hash_rows(moduli)), "doc_id long, n_bytes long, h1 long, h2 long, text_sha256 string")
    # stored, for row numbers of another evaluation may differ
    rows = stored(docs.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.encode("text", "UTF-8").alias("bytes")))
    pieces = rows.select("row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("bytes") - 1) / huge).cast("int")), lambda i: F.substring("bytes", i * huge + 1, F.lit(huge)))).alias("piece", "part"))
    hashed = pieces.repartition("row", "piece").mapInArrow(tidy(_hash_pieces(moduli)), "row long, doc_id long, piece int, n_bytes long, h1 long, h2 long, w1 long, w2 long")
    joined = hashed.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "n_bytes", "h1", "h2", "w1", "w2"))).alias("p"))
    step = lambda h, w, m: F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: (acc * x[w] + x[h]) % m)
    whole = joined.select("row", "doc_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["n_bytes"]).alias("n_bytes"), step("h1", "w1", moduli[0]).alias("h1"), step("h2", "w2", moduli[1]).alias("h2"))
    digest = rows.select("row", F.sha2("bytes", 256).alias("text_sha256"))
    return plain.unionByName(whole.join(digest, "row").drop("row"))


def exact_groups(docs: DataFrame, moduli: tuple[int, int] = MODULI, huge: int = HUGE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null texts count as
    empty. A doc_id may bear several texts, which are grouped apart; of equal rows of one doc_id
    one is kept. A null doc_id is the smallest, and its rows are compared like any other. An
    empty table gives an empty result; other columns are ignored. `moduli` may be made tiny in
    tests to force equal fingerprints. Jobs run while the result is declared.
    """
    key = ["n_bytes", "h1", "h2"]
    prints = stored(fingerprints(docs, moduli, huge).withColumn("row", F.monotonically_increasing_id()))
    best = F.max(F.struct("doc_id", "row", F.col("text_sha256").alias("sha")))
    groups = stored(prints.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("group", F.monotonically_increasing_id()))
    mine = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_sha256") == F.col("best.sha"))
    members = stored(prints.join(small(groups), key).select("group", "doc_id", F.col("text_sha256").alias("sha"), "row", mine.alias("leads")))
    split = _unequal(docs, members)
    result = prints.join(groups.select(*key, "best", "size", "group"), key, "left")
    if split is not None:
        again = split.withColumnRenamed("best", "best2").withColumnRenamed("size", "size2").withColumnRenamed("row", "row2")
        result = result.join(again.select("row2", "best2", "size2"), F.col("row") == F.col("row2"), "left").withColumn("best", F.coalesce("best2", F.struct("best.doc_id", "best.row"))).withColumn("size", F.coalesce("size2", "size"))
    return result.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def _unequal(docs: DataFrame, members: DataFrame) -> DataFrame | None:
    """Compare members(group, doc_id, sha, row, leads) with the one that leads their group, chunk by chunk.

    A member is a doc_id with a text, told from the doc_id's other texts by the digest; it has
    a number of its own. None if all are equal, as they are but for a collision of fingerprints.
    Else (row, best, size) for the members of groups that had to be divided.
    """
    numbered = stored(members.select("group", "doc_id", "sha", "leads").distinct().withColumn("member", F.monotonically_increasing_id()))
    leaders = numbered.where("leads").select("group", F.col("member").alias("rep"))
    ids = stored(numbered.join(small(leaders), "group").select("group", "member", "rep", F.col("doc_id").alias("id"), "sha"))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("bytes"), F.sha2(text, 256).alias("own"))
    last = F.greatest(F.lit(0), F.floor((F.length("bytes") - 1) / CHUNK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("bytes", i * CHUNK + 1, F.lit(CHUNK)))
    chunks = stored(texts.join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha"))).select("group", "member", "rep", F.posexplode(cut).alias("chunk", "part")))
    settled = []
    while True:
        # stored and never broadcast, for it holds texts: a join with a group of very many members is one of two shuffles, which is split where it is uneven
        theirs = stored(chunks.where("member = rep").dropDuplicates(["group", "chunk"]).select("group", "chunk", F.col("part").alias("other")))
        same = chunks.where("member <> rep").join(theirs, ["group", "chunk"]).groupBy("group", "member").agg(F.bool_and(F.col("part") == F.col("other")).alias("same"))
        unequal = stored(same.where("not same").select("group", "member"))
        if unequal.isEmpty():
            break
        settled.append(chunks.select("member", "rep").distinct().join(unequal, "member", "left_anti"))
        new = unequal.join(unequal.groupBy("group").agg(F.max("member").alias("rep")), "group").select("member", "rep")
        chunks = stored(chunks.drop("rep").join(new, "member"))
    if not settled:
        return None
    settled.append(chunks.select("member", "rep").distinct())
    of = settled[0]
    for s in settled[1:]:
        of = of.unionByName(s)
    named = ids.drop("rep").join(of, "member").select(F.col("group").alias("of"), "id", F.col("sha").alias("digest"), "rep")
    rows = stored(members.join(named, (F.col("group") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest"))).select("rep", "doc_id", "row"))
    sums = rows.groupBy("rep").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("size"))
    return rows.join(sums, "rep").select("row", "best", "size")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that exact_groups() keeps: one of every text; odd rows as there."""
    found = stored(exact_groups(docs))
    key = ["_strandlake_id", "_strandlake_sha"]
    each = found.groupBy(F.col("doc_id").alias(key[0]), F.col("text_sha256").alias(key[1])).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = stored(each.where("not kept or n > 1").withColumnsRenamed({"kept": "_strandlake_kept", "n": "_strandlake_n"}))
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    same = lambda side: docs["doc_id"].eqNullSafe(side[key[0]]) & (own == side[key[1]])
    kept = docs.join(small(odd), same(odd), "left_anti")
    again = odd.where("_strandlake_kept")
    if again.isEmpty():
        return kept
    # rows that occur several times under one doc_id: the first of them stays
    rows = docs.join(small(again), same(again)).dropDuplicates(key).select(*docs.columns)
    return kept.unionByName(rows)
