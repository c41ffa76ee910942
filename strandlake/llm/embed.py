"""Embedding near-dedup with an inverted multi-index.

Unit vectors are halved and each half is quantised by a codebook of its own; the two
codes name a cell of a product grid. A query visits cells by a multi-sequence
traversal: both halves' codes are sorted by how much farther they lie than the query's
own, and cells are taken in ascending order of the sum of both until it passes the
limit that reaches the target recall. Only members of cells visited are compared, and
what comes near is verified by its cosine in double precision. A pair is looked for
from the side of the smaller cell only.

A visit per vector and cell would be sent many times, so neighbouring cells form blocks
of about BLOCK vectors: a vector goes once to every block in which it visits a cell, with
the list of these cells. Codebooks grow with the root of the table and so does the number
of blocks, so that cells visited and copies sent grow with the root as well.

The limit is calibrated on vectors turned by the angle of the threshold, in random and
in single directions. The codebooks are fitted on a bounded sample; all vectors are
indexed and all are queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, forest, runs, small, stored, tidy
from .components import components

COSINE = 0.95
RECALL = 0.9995
#: Codes of a half, and vectors a code that the codebooks are fitted on: those of the smallest hashes.
CODES = 1 << 14
SAMPLE = 8
#: Vectors that a block is meant to hold; one of over twice as many is divided.
BLOCK = 4_096
#: Queries that are routed or compared at once, and pairs verified at once.
QUERIES = 1_024
PAIRS = 1 << 17

_OUT = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def codebook(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; an empty code keeps its place."""
    centre = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        code = nearest(sample, centre)
        order = np.argsort(code, kind="stable")
        start, length = runs(code[order])
        if len(start):
            centre[code[order][start]] = np.add.reduceat(sample[order], start, axis=0) / length[:, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1), 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[at : at + QUERIES], centre).argmin(1) for at in range(0, len(x), QUERIES)] or [np.zeros(0, np.int64)])


def costs(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own code of each row, and how much farther every code lies, as a squared distance."""
    d = distances(x, centre)
    own = d.argmin(1)
    return own, d - d[np.arange(len(d)), own][:, None]


def calibrate(sample: np.ndarray, books: list[np.ndarray], recall: float, cosine: float) -> float:
    """The cost within which the cell of a vector at the threshold's angle lies with the target recall."""
    rng = np.random.default_rng(7)
    total = []
    for x in np.array_split(sample[:4096], max(1, len(sample[:4096]) // 512)):
        x = np.repeat(x, 4, axis=0)
        noise = rng.standard_normal(x.shape)
        sparse = np.zeros(x.shape)
        sparse[np.arange(len(x)), rng.integers(0, x.shape[1], len(x))] = rng.choice([-1.0, 1.0], len(x))
        noise[::2] = sparse[::2]
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        y = cosine * x + np.sqrt(1 - cosine**2) * noise
        half = x.shape[1] // 2
        cost = np.zeros(len(x))
        for part, book in zip((slice(None, half), slice(half, None)), books, strict=True):
            cost += costs(x[:, part], book)[1][np.arange(len(x)), nearest(y[:, part], book)]
        total.append(cost)
    # where codes lie within one dense group, their distances say little about what is near: no less than half the threshold's angle
    return max(float(np.quantile(np.concatenate(total), recall)), (1 - cosine) / 2)


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code 1, code 2) of the cells visited, each query's in ascending order of cost.

    Multi-sequence traversal of all queries in step: a query's frontier has one cell for each
    first code that is open, that of the next second code; the cheapest is visited, its row goes
    on, and a row's first visit opens the next one. A query ends when its cheapest cell is beyond the limit.
    """
    wide = [max(1, int((c <= limit).sum(1).max(initial=0))) for c in (first, second)]
    order = [np.argsort(c, axis=1, kind="stable")[:, :w] for c, w in zip((first, second), wide, strict=True)]
    a, b = (np.take_along_axis(c, o, 1) for c, o in zip((first, second), order, strict=True))
    end = np.full((len(a), 1), np.inf)
    a, b = np.hstack([a, end]), np.hstack([b, end])
    at = np.zeros(a.shape, np.int64)
    front = np.full(a.shape, np.inf)
    front[:, 0] = a[:, 0] + b[:, 0]
    live = np.arange(len(a))
    seen: list[tuple] = []
    while len(live):
        row = np.arange(len(live))
        i = front.argmin(1)
        on = front[row, i] <= limit
        if not on.all():
            live, front, at, a, b, i = live[on], front[on], at[on], a[on], b[on], i[on]
            row = np.arange(len(live))
            if not len(live):
                break
        j = at[row, i]
        seen.append((live, order[0][live, i], order[1][live, j]))
        at[row, i] = j + 1
        front[row, i] = a[row, i] + b[row, j + 1]
        opens = row[j == 0]
        front[opens, i[opens] + 1] = a[opens, i[opens] + 1] + b[opens, 0]
    if not seen:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*seen, strict=True))


def neighbourhoods(centre: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The group (0..n-1, n a power of two) of each code: halved again and again along the widest direction, at equal weights."""
    group = np.zeros(len(centre), np.int64)
    size = 1
    while size < n:
        for g in range(size):
            rows = np.flatnonzero(group == g)
            if len(rows) < 2:
                continue
            x = centre[rows] - centre[rows].mean(0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            order = np.argsort(along, kind="stable")
            total = np.cumsum(weight[rows][order] + 1e-9)
            group[rows[order[total > total[-1] / 2]]] += size
        size *= 2
    return group


def unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        norm = np.linalg.norm(x, axis=1)
        odd = ~((norm > 1e-150) & (norm < 1e150))
        if odd.any():  # squares leave the range of doubles
            x[odd] /= np.abs(x[odd]).max(1)[:, None]
            norm = np.linalg.norm(x, axis=1)
        return x / norm[:, None]


class Index:
    """Codebooks, limit and blocks."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float, k: int | None = None):
        dim = sample.shape[1]
        self.half, self.k = dim // 2, min(k or codes(n), len(sample))
        parts = (sample[:, : self.half], sample[:, self.half :])
        self.books = [codebook(p, self.k) for p in parts]
        self.limit = calibrate(sample, self.books, recall, cosine) if self.k > 1 else 0.0
        # blocks enough to hold about BLOCK vectors each: a power of two of groups of either half's codes
        bits = max(0, int(np.ceil(np.log2(max(1.0, n / BLOCK)))))
        self.groups = [1 << (bits + 1) // 2, 1 << bits // 2]
        self.group = [neighbourhoods(b, np.bincount(nearest(p, b), minlength=self.k), g) for p, b, g in zip(parts, self.books, self.groups, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * self.k + nearest(x[:, self.half :], self.books[1])

    def blocks(self, cells: np.ndarray) -> np.ndarray:
        return self.group[0][cells // self.k] * self.groups[1] + self.group[1][cells % self.k]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cells, and (query, cell) of the visits to larger cells."""
        (own1, cost1), (own2, cost2) = costs(x[:, : self.half], self.books[0]), costs(x[:, self.half :], self.books[1])
        own = own1 * self.k + own2
        query, code1, code2 = traverse(cost1, cost2, self.limit)
        cell = code1 * self.k + code2
        later = cell > own[query]
        return own, query[later], cell[later]


def codes(n: int) -> int:
    """Codes of a half for n vectors: cells of some four vectors."""
    return int(min(CODES, max(1, round(n**0.5 / 2))))


class Block:
    """Members of a block by cells; compares queries with those of the cells that they visit."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, weight: np.ndarray, cell: np.ndarray, cosine: float):
        order = np.argsort(cell, kind="stable")
        self.x, self.ids, self.weight, self.cosine = x[order], ids[order], weight[order], cosine
        self.near = self.x.astype(np.float32)
        self.start, self.length = runs(cell[order])
        self.cell = cell[order][self.start]

    def within(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of one cell that may be near."""
        for s, m in zip(self.start.tolist(), self.length.tolist(), strict=True):
            for at in range(s, s + m if m > 1 else s, QUERIES):
                to = min(at + QUERIES, s + m)
                for other in range(at, s + m, QUERIES):
                    end = min(other + QUERIES, s + m)
                    i, j = np.nonzero(self.near[at:to] @ self.near[other:end].T >= self.cosine - 1e-4)
                    i, j = i + at, j + other
                    yield i[i < j], j[i < j]

    def visited(self, near: np.ndarray, query: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) that may be near, of the visits (query, cell)."""
        slot = np.searchsorted(self.cell, cell)
        there = slot < len(self.cell)
        there[there] = self.cell[slot[there]] == cell[there]
        query, slot = query[there], slot[there]
        order = np.argsort(slot, kind="stable")
        query, slot = query[order], slot[order]
        start, length = runs(slot)
        for s, m in zip(start.tolist(), length.tolist(), strict=True):
            rows = query[s : s + m]
            first, number = self.start[slot[s]], self.length[slot[s]]
            part = near[rows]
            for at in range(first, first + number, QUERIES):
                i, j = np.nonzero(part @ self.near[at : min(at + QUERIES, first + number)].T >= self.cosine - 1e-4)
                if len(i):
                    yield rows[i], j + at

    def links(self, x: np.ndarray, ids: np.ndarray, weight: np.ndarray, pairs: Iterator) -> Iterator[pa.RecordBatch]:
        """Verify pairs (row of x, member); counts of both sides and spanning links."""
        held: list[tuple] = []
        size = 0
        for p in pairs:
            held.append(p)
            size += len(p[0])
            if size > PAIRS:
                yield from self._verified(x, ids, weight, held)
                held, size = [], 0
        if size:
            yield from self._verified(x, ids, weight, held)

    def _verified(self, x, ids, weight, held) -> Iterator[pa.RecordBatch]:
        i, j = (np.concatenate(h) for h in zip(*held, strict=True))
        exact = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 8192]], self.x[j[a : a + 8192]]) for a in range(0, len(i), 8192)]) >= self.cosine
        i, j = i[exact], j[exact]
        if not len(i):
            return
        nodes, index = np.unique(np.concatenate([ids[i], self.ids[j]]), return_inverse=True)
        a, b = index[: len(i)], index[len(i) :]
        total = (np.bincount(a, weights=self.weight[j], minlength=len(nodes)) + np.bincount(b, weights=weight[i], minlength=len(nodes))).astype(np.int64)
        root = forest(len(nodes), a, b)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield batch(_OUT, np.repeat(np.array([0, 1], np.int32), [len(nodes), len(moved)]), np.concatenate([nodes, nodes[moved]]), np.concatenate([total, nodes[root[moved]]]))


def links(classes: DataFrame, dim: int, cosine: float = COSINE, recall: float = RECALL, k: int | None = None) -> DataFrame:
    """(kind, a, b): kind 0, b linked vectors of representative a; kind 1, spanning links.

    classes(rep, copies, embedding): distinct vectors. `k` sets the codes of a half.
    """
    n = classes.count()
    sample = unit(classes.orderBy(F.xxhash64("rep"), "rep").limit(max(8_000, SAMPLE * codes(n))).select("embedding").toArrow().column(0), dim)
    shared = classes.sparkSession.sparkContext.broadcast(Index(sample, n, cosine, recall, k))  # its size grows with the root of the table

    kind = classes.schema["embedding"].dataType.simpleString()
    element = pa.float32() if kind == "array<float>" else pa.float64()
    routed = pa.schema([("block", pa.int64()), ("visit", pa.int8()), ("rep", pa.int64()), ("copies", pa.int64()), ("cells", pa.binary()), ("embedding", pa.list_(element))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            block, number = np.unique(index.blocks(index.cells(unit(b.column(2), dim))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(number)], ["block", "n"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                own, query, cell = index.visits(unit(b.column(2), dim))
                rows = np.concatenate([np.arange(len(own)), query])
                cell = np.concatenate([own, cell])
                visit = np.repeat(np.array([0, 1], np.int8), [len(own), len(query)])
                block = index.blocks(cell)
                order = np.lexsort((cell, block, rows, visit))
                rows, cell, visit, block = rows[order], cell[order], visit[order], block[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (block[1:] != block[:-1]) | (visit[1:] != visit[:-1])
                start = np.flatnonzero(new)
                ends = np.append(start, len(rows)).astype("<i4") * 4
                lists = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cell.astype("<u4").tobytes())])
                take = pa.array(rows[start])
                yield pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(visit[start]), b.column(0).take(take), b.column(1).take(take), lists, b.column(2).take(take)], schema=routed)

    slim = classes.select("rep", "copies", "embedding")
    # a block that is too full is spread over several; its visitors go to all of them, and its members to those after their own
    sizes = slim.mapInArrow(tidy(count), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * BLOCK)
    full = stored(sizes.select("block", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    rows = slim.mapInArrow(tidy(route), f"block long, visit byte, rep long, copies long, cells binary, embedding {kind}").join(small(full), "block", "left")
    own = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    place = lambda visit, p: F.struct(F.lit(visit).cast("byte").alias("visit"), p.alias("part"))
    member = F.concat(F.array(place(0, own)), F.transform(F.filter(every, lambda p: p > own), lambda p: place(1, p)))
    spread = rows.select("block", "rep", "copies", "cells", "embedding", F.explode(F.when(F.col("visit") == 0, member).otherwise(F.transform(every, lambda p: place(1, p)))).alias("at"))
    spread = spread.select("block", "at.part", "at.visit", "rep", "copies", "cells", "embedding")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        held: list[pa.RecordBatch] = []

        def build() -> Block:
            x = np.concatenate([unit(h.column("embedding"), dim) for h in held])
            cell = np.concatenate([cells_of(h.column("cells"))[0] for h in held])
            ids, weight = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("rep", "copies"))
            return Block(x, ids, weight, cell, cosine)

        def finish() -> Iterator[pa.RecordBatch]:
            if block is not None:
                yield from block.links(block.x, block.ids, block.weight, block.within())

        for whole in batches:
            number, part, visit = (whole.column(c).to_numpy().astype(np.int64) for c in ("block", "part", "visit"))
            new = np.ones(len(number), bool)
            new[1:] = (number[1:] != number[:-1]) | (part[1:] != part[:-1]) | (visit[1:] != visit[:-1])
            start = np.flatnonzero(new)
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(number)], strict=True):
                key = (int(number[s]), int(part[s]))
                if key != now:
                    block = build() if held else block
                    yield from finish()
                    now, block, held = key, None, []
                if visit[s] == 0:
                    held.append(whole.slice(s, e - s))
                    continue
                if held:
                    block, held = build(), []
                if block is None:  # no member here
                    continue
                for at in range(s, e, QUERIES):
                    b = whole.slice(at, min(QUERIES, e - at))
                    x, ids, weight = unit(b.column("embedding"), dim), b.column("rep").to_numpy(), b.column("copies").to_numpy()
                    cell, row = cells_of(b.column("cells"))
                    yield from block.links(x, ids, weight, block.visited(x.astype(np.float32), row, cell))
        block = build() if held else block
        yield from finish()

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "block", "part").sortWithinPartitions("block", "part", "visit").mapInArrow(tidy(verify), "kind int, a long, b long")


def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of lists in a binary column, and the row of each."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1]
    cell = np.frombuffer(data, "<u4")[at[0] // 4 : at[-1] // 4].astype(np.int64)
    return cell, np.repeat(np.arange(len(column)), np.diff(at) // 4)


def near_groups(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, k: int | None = None) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; so do vectors of different lengths with each other, and rows without a vec_id. Components keep
    their type, or become doubles if they aren't floats. Equal vectors are one
    node that counts its copies. Repeated rows are copies; other columns are ignored; an
    empty table gives an empty result. The index is built while the result is declared.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")))
    # NaN is greater than infinity in SQL; zero and minus zero are one value
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    fine = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    plus = F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1]))
    classes = stored(rows.where(fine).groupBy(plus.alias("embedding")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    found = None
    for row in classes.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect():
        part = links(classes.where(F.size("embedding") == row["dim"]), row["dim"], cosine, recall, k) if row["dim"] > 1 else _single(classes.where(F.size("embedding") == 1))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "kind int, a long, b long")
    found = stored(found)
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    label = components(found.where("kind = 1").select("a", "b"))
    named = classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.select(F.col("embedding").alias("same"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0).cast("long"))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    joined = rows.withColumn("same", F.when(fine, plus)).join(named, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _single(classes: DataFrame) -> DataFrame:
    """Vectors of one component link if their signs agree."""
    sign = F.signum(F.col("embedding")[0]).alias("sign")
    rows = classes.select("rep", "copies", sign)
    sums = rows.groupBy("sign").agg(F.sum("copies").alias("all"), F.min("rep").alias("least"))
    both = rows.join(F.broadcast(sums), "sign")  # two rows at most
    one = both.select(F.lit(0).alias("kind"), F.col("rep").alias("a"), (F.col("all") - F.col("copies")).alias("b")).where("b > 0")
    return one.unionByName(both.where("rep <> least").select(F.lit(1).alias("kind"), F.col("rep").alias("a"), F.col("least").alias("b")))
