"""SimHash near-dedup with keys from the binary Golay code.

The [23, 12] Golay code is perfect: every 23-bit word lies within three bits of
exactly one of 4,096 codewords. The keys of a word are the codewords of itself and
of its 23 neighbours at one bit (six at most, all told). Two words at two bits or
fewer have a word between them that is at one bit or fewer from both, so they
always share a key.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints
differ in at most two bits, one segment at least is without an error (pigeonhole),
and the next one has two errors at most. A key is therefore an exact segment along
with one Golay index of the next segment: three times six keys at most. Equal
keys are joined and the fingerprints verified. Nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, forest, runs, small, stored, texts_of, tidy, whole_runs
from .components import components

#: The generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
#: Differing bits that still link.
DISTANCE = 2
#: Fingerprints of one key that are compared pair by pair; larger buckets go by midpoints.
BUCKET = 256
#: Shingles that are counted at once.
BLOCK = 1 << 15

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64())])


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint: ASCII lower case, words between ASCII white space, shingles of `width` words.

    Fewer words: the whole sequence is one shingle. No word: zero.
    """
    return _print(*votes(text.lower().split(), width))


def shingle_hashes(words: list[bytes], width: int) -> Iterator[list[int]]:
    """Hashes of the shingles, repeats included, BLOCK at once; fewer words are one shingle, none is none."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda x, y: x + y + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    if words and len(words) <= width:
        yield [digest(joined, SEED)]
        return
    n = len(words) - width + 1
    for at in range(0, n, BLOCK):
        yield [digest(joined[s:e], SEED) for s, e in zip(starts[at : min(at + BLOCK, n)], ends[at + width - 1 : at + BLOCK + width - 1], strict=False)]


def votes(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes have each bit, and how many there are."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words, width):
        counts += _bits(hashes)
        n += len(hashes)
    return counts, n


def _print(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit; bit 0 is the lowest."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([simhash(t) for t in texts_of(b.column(1))], np.uint64)
        yield batch(_PRINTS, b.column(0), prints.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text); null texts count as empty."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


def golay_decoder() -> np.ndarray:
    """Index (0..4095) of the codeword within three bits of every 23-bit word."""
    words = np.zeros(4096, np.int64)
    for i in range(12):
        words ^= ((np.arange(4096) >> i) & 1) * (GENERATOR << i)
    flips = [0, *(1 << i for i in range(23))]
    flips += [1 << i | 1 << j for i in range(23) for j in range(i)]
    flips += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    out = np.empty(1 << 23, np.int16)
    for f in flips:
        out[words ^ f] = np.arange(4096)
    return out


def golay_keys(words: np.ndarray, decoder: np.ndarray) -> np.ndarray:
    """Rows of six indices, the distinct ones first and -1 after them."""
    near = np.stack([decoder[words], *(decoder[words ^ (1 << i)] for i in range(23))], 1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    order = np.argsort(~first, axis=1, kind="stable")[:, :6]
    return np.where(np.take_along_axis(first, order, 1), np.take_along_axis(near, order, 1), -1)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = None
    for b in batches:
        decoder = golay_decoder() if decoder is None else decoder
        fp = b.column(0).to_numpy().view(np.uint64)
        parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
        for at in range(0, len(fp), 1 << 16):
            piece = slice(at, at + (1 << 16))
            for k in range(3):
                index = golay_keys(parts[(k + 1) % 3][piece], decoder)
                key = (k << 40) | (parts[k][piece][:, None] << 12) | index
                row, col = np.nonzero(index >= 0)
                yield batch(_KEYS, key[row, col], fp[piece][row].view(np.int64), b.column(1).to_numpy()[piece][row])


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in whole_runs(batches, ["key"]):
            key, fp, rep = (t.column(c).to_numpy() for c in ("key", "fp", "rep"))
            start, length = runs(key)
            keep = np.repeat(length > 1, length)
            key, fp, rep = key[keep], fp[keep].view(np.uint64), rep[keep]
            found = [np.zeros((0, 2), np.int64)]
            step = 1
            while True:
                at = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else np.zeros(0, np.int64)
                if not len(at):
                    break
                at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
                found.append(np.stack([at, at + step], 1))
                step += 1
            pairs = np.concatenate(found)
            if len(pairs):
                nodes, index = np.unique(rep[pairs], return_inverse=True)
                index = index.reshape(pairs.shape)
                root = forest(len(nodes), index[:, 0], index[:, 1])
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                yield batch(schema, nodes[moved], nodes[root[moved]])

    return run


def links(classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the representatives of classes(fp, rep), distinct fingerprints, at two bits or fewer."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint becomes many keys: spread them before that, so that no task counts millions
    keys = stored(classes.select("fp", "rep").repartition(n, "fp").mapInArrow(tidy(_key_rows), "key long, fp long, rep long"))
    full = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("key"))
    if full.isEmpty():
        rest, found = keys, None
    else:
        # All members of a ball of one bit are within two bits of each other: the
        # balls join a large bucket's members exactly, without comparing pairs.
        rest = keys.join(full, "key", "left_anti")
        members = stored(keys.join(full, "key", "left_semi").select("fp", "rep").distinct())
        near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        balls = members.select("rep", F.explode(near).alias("ball"))
        least = stored(balls.groupBy("ball").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("ball", "b"))
        found = balls.join(least, "ball").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    rest = rest.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(tidy(_verify(DISTANCE)), "a long, b long")
    return rest if found is None else rest.unionByName(found)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint, component_id.

    Fingerprints link at two or fewer differing bits; component_id is the smallest
    doc_id that can be reached, itself included. Equal fingerprints are one node, so
    a group of copies is never expanded. Null and empty texts have fingerprint zero
    and link like any other; a null doc_id is never a component's name unless no
    other is there. Repeated rows stay; other columns are ignored; an empty table
    gives an empty result.
    """
    prints = stored(fingerprints(docs))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    label = components(links(classes.where("rep is not null")))
    named = stored(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar_groups(): width of the shingles compared and their similarity; weak bits of a segment that keys are made with,
#: and differing bits of candidates.
VERIFY, SIMILARITY = 5, 0.8
WEAK = 3
NEAR = 16
#: Members of a bucket that are compared in one task, and pairs held at once.
FULL = 4096
HELD = 1_000_000
#: Counts of a set's hashes by their lowest bits: they tell most sets that aren't alike without a look into them.
COUNTS = 128

_PAIR = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("weak", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
_PAIR_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("weak", pa.int64()), ("n", pa.int32()), ("node", pa.int64())])
_MEMBERS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("side", pa.int8()), ("fp", pa.int64()), ("weak", pa.int64()), ("n", pa.int32()), ("node", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SETS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary())])
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], width: int = VERIFY) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(np.array([h for part in shingle_hashes(words, width) for h in part], np.uint64))


def _name(found: np.ndarray) -> tuple[int, int]:
    """A name of 128 bits for a set of hashes: two sums that don't depend on their order."""
    mixed = (found ^ (found >> np.uint64(29))) * _M
    return int(found.sum(dtype=np.uint64)), int((mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64))


def _pair_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in texts_of(b.column(1)):
            words = t.lower().split()
            counts, n = votes(words, 3)
            doubt = np.abs(2 * counts - n)
            weak = 0
            for start, width in SEGMENTS:
                for at in np.argsort(doubt[start : start + width], kind="stable")[:WEAK].tolist():
                    weak = weak << 5 | at
            found = shingles(words)
            rows.append((_print(counts, n), weak, len(found), *_name(found)))
        fp, weak, n, s1, s2 = np.array(rows, np.uint64).reshape(-1, 5).T
        yield batch(_PAIR, b.column(0), fp.view(np.int64), weak.view(np.int64), n.astype(np.int32), s1.view(np.int64), s2.view(np.int64))


def soft_keys(word: np.ndarray, weak: list[np.ndarray], decoder: np.ndarray) -> np.ndarray:
    """Golay indices of words with any of their weak bits turned: the distinct ones, and -1 instead of repeats."""
    near = [decoder[word]]
    for turned in range(1, 1 << len(weak)):
        flip = np.zeros_like(word)
        for i, at in enumerate(weak):
            if turned >> i & 1:
                flip |= np.int64(1) << at
        near.append(decoder[word ^ flip])
    index = np.sort(np.stack(near, 1).astype(np.int64), axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def pair_indices(fp: np.ndarray, weak: np.ndarray, decoder: np.ndarray) -> list[np.ndarray]:
    """The indices of each of the three segments of fingerprints, as soft_keys() gives them."""
    index = []
    for k, (s, w) in enumerate(SEGMENTS):
        places = [weak >> 5 * (WEAK * (2 - k) + i) & 31 for i in range(WEAK)]
        index.append(soft_keys((fp.view(np.uint64) >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64), places, decoder))
    return index


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """If errors in two of the three segments fall on weak bits of either text, or are few, the segments' indices agree: they give a key together."""
    decoder = None
    for whole in batches:
        decoder = golay_decoder() if decoder is None else decoder
        for at in range(0, whole.num_rows, 1 << 12):
            b = whole.slice(at, 1 << 12)
            fp, weak, n, node = (b.column(i).to_numpy() for i in range(4))
            index = pair_indices(fp, weak, decoder)
            for k in range(3):
                one, two = index[k][:, :, None], index[(k + 1) % 3][:, None, :]
                row, i, j = np.nonzero((one >= 0) & (two >= 0))
                yield batch(_PAIR_KEYS, (k << 24) | (one[row, i, 0] << 12) | two[row, 0, j], fp[row], weak[row], n[row], node[row])


def first_keys(index: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that the rows a and b share, or -1: a pair belongs to one bucket only."""
    out = np.full(len(a), -1)
    none = 1 << 12
    for at in range(0, len(a), 1 << 14):
        piece = slice(at, at + (1 << 14))
        common = []
        for x in index:
            one, two = x[a[piece]], x[b[piece]]
            there = (one[:, :, None] == two[:, None, :]).any(axis=2) & (one >= 0)
            common.append(np.where(there, one, none).min(axis=1))
        for k in (2, 1, 0):
            one, two = common[k], common[(k + 1) % 3]
            out[piece] = np.where((one < none) & (two < none), (k << 24) | (one << 12) | two, out[piece])
    return out


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the edges of the lightest spanning forest of the nodes 0..n-1; edges come in order of weight."""
    label, chosen = np.arange(n), [np.zeros(0, np.int64)]
    at = np.arange(len(a))
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return np.concatenate(chosen)
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[at]], at)
        np.minimum.at(best, label[b[at]], at)
        new = np.unique(best[best < len(a)])
        chosen.append(new)
        every = np.concatenate(chosen)
        label = forest(n, a[every], b[every])


class _Buckets:
    """Some whole buckets of _MEMBERS: their candidate pairs, a row's with those that follow in its bucket."""

    def __init__(self, t: pa.Table, decoder: np.ndarray, similarity: float):
        start, length = runs(t.column("key").to_numpy() * 1_000_003 + t.column("block").to_numpy())
        self.table = t = t.filter(pa.array(np.repeat(length > 1, length)))
        self.key, block, self.side, fp, self.weak, self.size, self.node = (t.column(c).to_numpy() for c in _MEMBERS.names)
        self.bucket, self.fp = self.key * 1_000_003 + block, fp.view(np.uint64)
        self.decoder, self.similarity = decoder, similarity

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows and their bits: near by their fingerprints, of sizes that may be alike. Rows of one block meet in one of its tasks."""
        step, at = 1, np.arange(len(self.bucket))
        while True:
            at = at[at + step < len(self.bucket)]
            at = at[self.bucket[at + step] == self.bucket[at]]
            if not len(at):
                return
            bits = np.bitwise_count(self.fp[at] ^ self.fp[at + step])
            near = np.flatnonzero(bits <= NEAR)
            a = at[near]
            b = a + step
            # sets whose sizes differ more can't be alike
            fit = np.minimum(self.size[a], self.size[b]) >= self.similarity * np.maximum(self.size[a], self.size[b])
            fit &= ((self.side[a] == 0) | (self.side[a] != self.side[b])) & (self.node[a] != self.node[b])
            yield a[fit], b[fit], bits[near][fit]
            step += 1

    def own(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs belong to their bucket."""
        if not len(a):
            return np.zeros(0, bool)
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        index = pair_indices(self.fp[rows], self.weak[rows], self.decoder)
        return first_keys(index, at[: len(a)], at[len(a) :]) == self.key[a]


def _paired(similarity: float):
    """The members of buckets that have a candidate there. Many share their bucket with others: no pair is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for t in whole_runs(batches, ["key", "block"]):
            decoder = golay_decoder() if decoder is None else decoder
            some = _Buckets(t, decoder, similarity)
            marked, held, size = np.zeros(len(some.key), bool), [], 0

            def settle(held, some=some, marked=marked):
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                own = some.own(a, b)
                marked[a[own]] = marked[b[own]] = True

            for a, b, _ in some.pairs():
                new = ~(marked[a] & marked[b])
                held.append((a[new], b[new]))
                size += int(new.sum())
                if size > 1 << 16:
                    settle(held)
                    held, size = [], 0
            if held:
                settle(held)
            if marked.any():
                yield from some.table.filter(pa.array(marked)).select(_MEMBERS.names).to_batches()

    return run


def _linked(similarity: float):
    """Links that span what the candidate pairs of a bucket link: every pair whose ends aren't linked yet is compared by its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for t in whole_runs(batches, ["key", "block"]):
            decoder = golay_decoder() if decoder is None else decoder
            some = _Buckets(t, decoder, similarity)
            sets = [np.frombuffer(x, np.uint32) for x in texts_of(some.table.column("shingles"))]
            lengths = np.array([len(x) for x in sets], np.int64)
            counts = np.array([np.bincount(x & np.uint32(COUNTS - 1), minlength=COUNTS) for x in sets], np.int32).reshape(-1, COUNTS)
            nodes, name = np.unique(some.node, return_inverse=True)
            label = np.arange(len(nodes))

            def alike(a, b, sets=sets, lengths=lengths, counts=counts):
                total = lengths[a] + lengths[b]
                # sets differ in as many hashes at least as their counts do
                apart = np.concatenate([np.abs(counts[a[k : k + 4096]] - counts[b[k : k + 4096]]).sum(axis=1) for k in range(0, len(a), 4096)])
                good = (total - apart) // 2 >= similarity * (total - (total - apart) // 2)
                for k in np.flatnonzero(good).tolist():
                    both = len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True))
                    good[k] = both >= similarity * (total[k] - both)
                return good

            def settle(held, label, some=some, name=name, alike=alike):
                a, b, bits = (np.concatenate(x) for x in zip(*held, strict=True))
                own = some.own(a, b)
                order = np.argsort(bits[own], kind="stable")
                a, b, more = a[own][order], b[own][order], 0
                while True:
                    open_ = label[name[a]] != label[name[b]]
                    a, b = a[open_], b[open_]
                    if not len(a):
                        return label
                    # a lightest forest first; if that fails, more and more of the others
                    now = np.zeros(len(a), bool)
                    now[spanning(len(label), label[name[a]], label[name[b]])] = True
                    now[:more] = True
                    good = alike(a[now], b[now])
                    label = forest(len(label), np.concatenate([np.arange(len(label)), name[a[now][good]]]), np.concatenate([label, name[b[now][good]]]))
                    a, b, more = a[~now], b[~now], 2 * more + len(name)

            held, size = [], 0
            for a, b, bits in some.pairs():
                open_ = label[name[a]] != label[name[b]]
                held.append((a[open_], b[open_], bits[open_]))
                size += int(open_.sum())
                if size > HELD:
                    label, held, size = settle(held, label), [], 0
            if size:
                label = settle(held, label)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield batch(_LINKS, nodes[moved], nodes[label[moved]])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingles(t.lower().split()) for t in texts_of(b.column(0))]
        names = np.array([_name(f) for f in found], np.uint64).reshape(-1, 2).view(np.int64)
        yield batch(_SETS, *names.T, [np.unique(f.astype(np.uint32)).tobytes() for f in found])


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, component_id, for texts linked by a Jaccard similarity of their sets of
    five-word shingles of at least `similarity`.

    Texts of equal sets are one node. Candidates are fingerprints over three words that share the Golay indices of two segments, made
    with the segments' weakest bits turned either way, and differ in NEAR bits at most; sets whose sizes rule the
    similarity out are passed over. A pair belongs to the bucket of the first key that it shares. Buckets hand on those members
    that have a candidate, and get them back with their sets: there every candidate is compared whose ends aren't in one group by
    then, however many a text has, and links that span what was found are handed on. A link is lost only if its texts share no key, or differ in more than NEAR bits.

    component_id is the smallest doc_id of a group. Null and empty texts are alike; rows without a doc_id
    link with nothing; repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stored(docs.mapInArrow(tidy(_pair_fingerprints), "doc_id long, fp long, weak long, n int, s1 long, s2 long"))
    least = F.min(F.struct("doc_id", "fp", "weak", "n")).alias("least")
    classes = prints.where("doc_id is not null").groupBy("s1", "s2").agg(least).select("s1", "s2", "least.*", F.monotonically_increasing_id().alias("node"))
    classes = stored(classes.withColumnRenamed("doc_id", "rep"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # keys are made twice, to be counted and to be joined: that costs less than storing them
    keys = classes.select("fp", "weak", "n", "node").repartition(n, "fp").mapInArrow(tidy(_pair_keys), "key long, fp long, weak long, n int, node long")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL)
    full = stored(counts.select("key", F.ceil(F.col("n") / (FULL / 2)).cast("int").alias("blocks")))
    none = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("byte").alias("side"))
    if full.isEmpty():
        keys = keys.select("*", none.alias("at"))
    else:
        # every two blocks of a full bucket meet in a task of their own; a block's own pairs in that with itself
        keys = keys.join(small(full), "key", "left")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        side = lambda i: F.when(i == own, 0).when(i > own, 1).otherwise(2).cast("byte").alias("side")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct((F.least(i, own).cast("long") * F.col("blocks") + F.greatest(i, own)).alias("block"), side(i)))
        keys = keys.withColumn("at", F.explode(F.when(F.col("blocks").isNull(), F.array(none)).otherwise(pairs)))
    keys = keys.select("key", "at.block", "at.side", "fp", "weak", "n", "node")
    dealt = lambda rows: rows.repartition(n, "key", "block").sortWithinPartitions("key", "block")
    members = stored(dealt(keys).mapInArrow(tidy(_paired(similarity)), "key long, block long, side byte, fp long, weak long, n int, node long"))

    nodes = stored(members.select("node").distinct().join(classes, "node").select("node", "rep", "s1", "s2"))
    texts = docs.join(small(nodes.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_sets), "s1 long, s2 long, shingles binary").dropDuplicates(["s1", "s2"])
    sets = stored(sets.join(small(nodes.select("node", "s1", "s2")), ["s1", "s2"]).select("node", "shingles"))
    label = components(stored(dealt(members.join(sets, "node")).mapInArrow(tidy(_linked(similarity)), "a long, b long")))
    label = stored(label)
    grouped = label.unionByName(label.select(F.col("component").alias("node"), "component").distinct()).join(classes, "node").select("component", "rep", "s1", "s2")
    named = grouped.join(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("s1", "s2", "component_id")
    named = stored(classes.select("s1", "s2", "rep").join(named, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id")))
    return prints.join(named, ["s1", "s2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but for those of a group of similar texts that don't have its smallest doc_id. Rows without a doc_id stay."""
    gone = stored(similar_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_strandlake_gone")).distinct())
    return docs.join(small(gone), docs["doc_id"] == gone["_strandlake_gone"], "left_anti")
