"""Byte-level BPE, encoded with contiguous rank arrays and decoded again.

A text is cut into words by the byte-level pattern, which is evaluated on arrays of
code point classes. A short word is a row of parts and a row of the ranks of
neighbouring parts, both contiguous: the least rank is sought from the left, its
boundary is deleted, and the ranks on either side are looked up again, until no
neighbours merge. Distinct short words of one length are worked on together, a row of
a matrix each. Long words use the same rule with a heap. Every distinct word is merged
once per cache filling; the cache only saves time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, texts_of, tidy

#: Bytes of a word that is still merged in the matrix; longer ones use a heap.
SHORT = 64
#: Distinct words that are remembered, and bytes of text that are cut at once.
CACHE = 250_000
BLOCK = 1 << 20
SPACE, BLANK, LETTER, NUMBER, OTHER, SPECIAL = range(6)
NONE = 1 << 30
#: Upper ends of the lengths that share a matrix.
WIDTHS = (6, 9, 14, 24, SHORT)

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[32] = SPACE
    return out


def load(path: str) -> dict:
    """The tables of a byte-level BPE file of the tokenizers library, as arrays; made on the driver and sent along."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_letters()
    vocab = file["model"]["vocab"]
    special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    raw = [b""] * size
    for token, i in vocab.items():
        raw[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        raw[i] = token
    single = np.zeros(256, np.int32)
    for i, t in enumerate(raw):
        if len(t) == 1:
            single[t[0]] = i
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(key, kind="stable")
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    return {
        "size": size, "single": single, "special": special, "key": key[order], "rank": order.astype(np.int32), "made": made.astype(np.int32), "classes": classes(),
        "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_at": np.concatenate([[0], np.cumsum([len(t) for t in raw])]),
    }


class Slots:
    """A hash table of arrays: 64-bit codes, already mixed, to whole numbers from 0; grows as it fills."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.code, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Values, -1 where a code isn't known."""
        slot = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.code[slot] == codes, self.value[slot], np.int32(-2))
        out[(out < 0) & (self.value[slot] < 0)] = -1
        left = np.flatnonzero(out == -2)
        while len(left):
            slot = (slot if len(slot) == len(left) else slot[left]) + 1 & (1 << self.bits) - 1
            found = np.where(self.code[slot] == codes[left], self.value[slot], np.int32(-2))
            found[self.value[slot] < 0] = -1
            out[left] = found
            go = found == -2
            left, slot = left[go], slot[go]
        return out

    def add(self, codes: np.ndarray, values: np.ndarray) -> None:
        """Distinct codes that aren't known yet."""
        self.n += len(codes)
        if self.n * 3 > 1 << self.bits:
            old = self.value >= 0
            codes, values = np.concatenate([self.code[old], codes]), np.concatenate([self.value[old], values])
            while self.n * 3 > 1 << self.bits:
                self.bits += 1
            self.code, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slot = (codes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(codes):
            free = np.flatnonzero(self.value[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.code[at], self.value[at] = codes[taken], values[taken]
            rest = np.ones(len(codes), bool)
            rest[taken] = False
            codes, values, slot = codes[rest], values[rest], slot[rest]
            slot = slot + (self.value[slot] >= 0) & (1 << self.bits) - 1


class Codec:
    """Encodes and decodes with the tables that load() gives."""

    def __init__(self, tables: dict):
        self.t = tables
        self.size = tables["size"]
        self.made = tables["made"]
        self.pairs = Slots(18)
        self.pairs.add(_mix(tables["key"].astype(np.uint64)), tables["rank"])
        one = tables["single"]
        self.first = self.ranks(np.repeat(one, 256), np.tile(one, 256)).reshape(256, 256)
        self.clear()

    def clear(self) -> None:
        self.known = Slots(20)
        self.at, self.n, self.head, self.tail, self.bytes = [np.zeros(0, np.int64) for _ in range(5)]
        self.pool = np.zeros(0, np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where the pair doesn't merge."""
        rank = self.pairs.get(_mix(a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64)))
        return np.where((rank >= 0) & (a >= 0) & (b >= 0), rank, NONE).astype(np.int32)

    def merge_short(self, words: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """words: a row of bytes each, of which the first lengths[i] count. Gives (rows, ids of those rows), -1 after the last id."""
        rows = np.arange(len(words))
        beyond = np.arange(words.shape[1]) >= lengths[:, None]
        parts = np.where(beyond, np.int32(-1), self.t["single"][words])
        rank = np.where(beyond[:, 1:], np.int32(NONE), self.first[words[:, :-1], words[:, 1:]])
        done = []
        while True:
            width = parts.shape[1]
            if width == 1:
                done.append((rows, parts))
                return done
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            over = best == NONE
            if over.any():
                done.append((rows[over], parts[over]))
                live = ~over
                rows, parts, rank, at, best = rows[live], parts[live], rank[live], at[live], best[live]
                if not len(rows):
                    return done
            parts[np.arange(len(rows)), at] = self.made[best]
            keep = np.ones(parts.shape, bool)
            keep[np.arange(len(rows)), at + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            if width == 2:
                continue
            rank = rank[keep[:, 1:]].reshape(len(rows), width - 2)
            left = np.flatnonzero(at > 0)
            right = np.flatnonzero(at < width - 2)
            row, col = np.concatenate([left, right]), np.concatenate([at[left] - 1, at[right]])
            rank[row, col] = self.ranks(parts[row, col], parts[row, col + 1])

    def merge_long(self, word: bytes) -> list[int]:
        parts = self.t["single"][np.frombuffer(word, np.uint8)]
        n = len(parts)
        rank = self.ranks(parts[:-1], parts[1:])
        heap = [(v, i) for i, v in enumerate(rank.tolist()) if v < NONE]
        heapq.heapify(heap)
        rank, parts = rank.tolist(), parts.tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank.append(NONE)

        def again(i: int) -> None:
            j = after[i]
            rank[i] = int(self.ranks(np.array([parts[i]]), np.array([parts[j]]))[0]) if j < n else NONE
            if rank[i] < NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            v, i = heapq.heappop(heap)
            if parts[i] < 0 or rank[i] != v:
                continue
            j = after[i]
            parts[i], parts[j], rank[j] = int(self.made[v]), -1, NONE
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            again(i)
            if before[i] >= 0:
                again(before[i])
        return [p for p in parts if p >= 0]

    def cut(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the words of `data`, in which texts begin at the byte offsets `starts`; and, for each, a special id or -1."""
        point = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(point)
        where = np.concatenate([[0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))])
        c = self.t["classes"][point]
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(where, starts)] = True
        edge[n] = True
        specials = []
        for token, i in self.t["special"].items():
            at = data.find(token)
            while at >= 0:
                s, e = np.searchsorted(where, [at, at + len(token)])
                if not edge[s + 1 : e].any():
                    specials.append((at, i))
                    edge[[s, e]] = True
                    c[s:e] = SPECIAL
                    at = data.find(token, at + len(token))
                else:
                    at = data.find(token, at + 1)
        blank = c <= BLANK
        begin = edge[:-1].copy()
        if n > 1:
            before, now = c[:-1], c[1:]
            was, is_ = blank[:-1], blank[1:]
            begin[1:] |= ~is_ & ~was & (now != before)
            begin[1:] |= ~is_ & was & (before == BLANK)
            begin[1:] |= is_ & ~was
            begin[:-1] |= was & ~is_ & ~edge[1:-1]  # the last blank before a word
            quote = np.flatnonzero(point == 0x27)
            quote = quote[c[quote] == OTHER]
            free = edge[quote] | (quote == 0)
            prev = c[np.maximum(quote - 1, 0)]
            quote = quote[free | ((prev != OTHER) & (prev != SPACE))]
            padded = np.concatenate([point, [0, 0, 0]])
            inner = np.concatenate([edge, [True, True]])
            one, two = padded[quote + 1], padded[quote + 2]
            single = np.isin(one, [ord(x) for x in "stmd"]) & ~inner[quote + 1]
            double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~inner[quote + 1] & ~inner[quote + 2]
            hit = quote[single | double]
            begin[hit + 1] = False
            end = np.where(single, quote + 2, quote + 3)[single | double]
            begin[end[end < n]] = True
        words = where[:-1][begin]
        kind = np.full(len(words), -1, np.int64)
        for at, i in specials:
            kind[np.searchsorted(words, at)] = i
        return words, kind

    def lookup(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The cache entry of every word, after merging those that are new."""
        padded = data + bytes(8)
        load = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        mask = np.array([0, *((1 << 8 * i) - 1 for i in range(1, 9))], np.uint64)
        head = load[starts] & mask[np.minimum(lengths, 8)]
        tail = load[np.maximum(starts + lengths - 8, starts)] & mask[np.minimum(lengths, 8)]
        code = _mix(head ^ (lengths.astype(np.uint64) << np.uint64(56)))
        live = np.flatnonzero(lengths > 8)
        step = 8
        while len(live):
            code[live] = _mix(code[live] ^ (load[starts[live] + step] & mask[np.minimum(lengths[live] - step, 8)]))
            step += 8
            live = live[lengths[live] > step]
        out = self.known.get(code)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            unique, first, inverse = np.unique(code[missing], return_index=True, return_inverse=True)
            new = missing[first]
            out[missing] = self.learn(data, starts[new], lengths[new], head[new], tail[new], unique)[inverse]
        wrong = np.flatnonzero((self.head[out] != head.view(np.int64)) | (self.tail[out] != tail.view(np.int64)) | (self.bytes[out] != lengths))
        for i in wrong.tolist():  # two words of one code: the second is merged by itself
            out[i] = self.learn(data, starts[i : i + 1], lengths[i : i + 1], head[i : i + 1], tail[i : i + 1], None)[0]
        return out

    def learn(self, data, starts, lengths, head, tail, codes) -> np.ndarray:
        view = np.frombuffer(data, np.uint8)
        n = len(starts)
        count = np.zeros(n, np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in np.array_split(rows, len(rows) * high // 4_000_000 + 1) if len(rows) else ():
                within = np.minimum(starts[part][:, None] + np.arange(high), len(view) - 1)
                pieces += [(part[r], ids) for r, ids in self.merge_short(view[within], lengths[part])]
        for r in np.flatnonzero(lengths > SHORT).tolist():
            pieces.append((np.array([r]), np.array([self.merge_long(data[starts[r] : starts[r] + lengths[r]])])))
        for r, ids in pieces:
            count[r] = (ids >= 0).sum(axis=1)
        base = len(self.pool)
        at = base + np.concatenate([[0], np.cumsum(count)[:-1]])
        pool = np.empty(int(count.sum()), np.int32)
        for r, ids in pieces:
            there = ids >= 0
            pool[((at[r] - base)[:, None] + np.arange(ids.shape[1]))[there]] = ids[there]
        old = len(self.at)
        self.pool = np.concatenate([self.pool, pool])
        self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, count])
        self.head, self.tail = np.concatenate([self.head, head.view(np.int64)]), np.concatenate([self.tail, tail.view(np.int64)])
        self.bytes = np.concatenate([self.bytes, lengths])
        entries = np.arange(old, old + n)
        if codes is not None:
            self.known.add(codes, entries)
        return entries

    def encode_block(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at `starts` in data, and where each text's ids end."""
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        if len(self.at) > CACHE:
            self.clear()
        words, kind = self.cut(data, starts)
        lengths = np.diff(np.append(words, len(data)))
        entry = self.lookup(data, words, lengths)
        count = np.where(kind >= 0, 1, self.n[entry])
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.at[entry] - (ends - count), count) + np.arange(ends[-1])] if len(ends) else np.zeros(0, np.int32)
        marked = np.flatnonzero(kind >= 0)
        ids[ends[marked] - 1] = kind[marked]
        reached = np.concatenate([[0], ends])
        text_ends = np.append(starts[1:], len(data))
        return ids, reached[np.searchsorted(words, text_ends)]

    def encode(self, texts: Iterator[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text in turn. Long texts are cut before a blank that follows a word, where no word crosses."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            if len(t) > BLOCK:
                yield from self._flush(held)
                held, size = [], 0
                yield np.concatenate([ids for part in _parts(t, self.t["special"]) for ids in self._flush([part])])
                continue
            held.append(t)
            size += len(t)
            if size > BLOCK:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if texts:
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
            ids, ends = self.encode_block(b"".join(texts), starts)
            at = 0
            for e in ends.tolist():
                yield ids[at:e]
                at = e

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, those of special tokens included; bytes that are not UTF-8 are replaced."""
        at = self.t["raw_at"]
        length = at[ids + 1] - at[ids]
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        raw = self.t["raw"][np.repeat(at[ids] - (ends - length), length) + np.arange(ends[-1])].tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(text: bytes, special: dict[bytes, int]) -> Iterator[bytes]:
    """Cut a long text before an ASCII blank that follows an ASCII letter, outside of special tokens that hold such a place."""
    risky = [s for s in special if re.search(rb"[A-Za-z][ \n]", s)]
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text):
            fits = text[cut] in b" \n" and chr(text[cut - 1]).isascii() and chr(text[cut - 1]).isalpha()
            if fits and not any(text.find(s, max(at, cut - len(s) + 1), cut + len(s) - 1) >= 0 for s in risky):
                break
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text).

    Ids are those of the file's own library without added special tokens; the name of a
    special token in a text becomes that token. Null texts count as empty and give no id;
    repeated rows and null doc_ids stay; other columns are ignored; an empty table gives an
    empty result.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for b in batches:
            n, a, z = [], [], []
            for ids in codec.encode(texts_of(b.column(1))):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                z.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield batch(_OUT, b.column(0), n, a, z)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every row's text, as an array."""
    tables = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for b in batches:
            yield batch(schema, b.column(0), [ids.astype(np.int32) for ids in codec.encode(texts_of(b.column(1)))])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of encoded(doc_id, ids); a null array counts as empty."""
    tables = encoded.sparkSession.sparkContext.broadcast(load(path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for b in batches:
            yield batch(schema, b.column(0), [codec.decode(np.array(ids or [], np.int64)).decode() for ids in b.column(1).to_pylist()])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
