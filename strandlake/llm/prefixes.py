"""Prefix trie of conversations.

Every turn is a pair of numbers below two primes, and a prefix is their polynomial. Prefixes come
from numpy scans over turns in order; a conversation may lie in many tasks, which scan
what they have and are put together by the lengths and polynomials of what came before. Exchanging the first
turns of a conversation for another's, and going back from a prefix to its parent, is arithmetic on
these numbers, so no turn is copied. Equal fingerprints are groups; each is checked turn by turn against
its representative, and divided where a turn or the group that it came from differs. Then nodes are rolled up:
a node belongs to its smallest member, so that a conversation owns one path, and paths hang on paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stored, tidy

#: Two primes below 2^31 and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Neighbouring conversations that share first turns, and the number of kinds of shares (0 to FIRST - 1 turns).
BLOCK, FIRST = 20, 4
#: Nodes of a path whose sums are taken in one piece.
PIECE = 4096

_SCANNED = "conv_id long, part int, i long, sha binary, n_words long, t1 long, t2 long, f1 long, f2 long, p1 long, p2 long, starts boolean, ends boolean"


def _tables(modulus: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 ... base^n and their inverses."""
    out = []
    for b in (base, pow(base, -1, modulus)):
        powers, x = np.empty(n + 1, np.int64), 1
        for i in range(n + 1):
            powers[i] = x
            x = x * b % modulus
        out.append(powers)
    return out[0], out[1]


def scan(turns: np.ndarray, first: np.ndarray, modulus: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Prefix polynomials of segments: the sum of turns[i] * base^(k - i) from the segment's first place, first[k], to k."""
    k = np.arange(len(turns))
    sums = np.concatenate([[0], np.cumsum(turns * down[k] % modulus)])
    return (sums[k + 1] - sums[first]) % modulus * up[k] % modulus


def _scan(moduli: tuple[int, int]):
    """Scan a task's sorted rows: places, prefix polynomials and powers from the place where the task's part of a conversation starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        size = 0
        tables: list[tuple[np.ndarray, np.ndarray]] = []
        held, opening = None, None
        last: tuple | None = None  # the conversation that is open, its turns, polynomials and powers
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if n > size:
                size = n
                tables = [_tables(m, x % m, n) for m, x in zip(moduli, BASES, strict=True)]
            conv = b.column(0).to_numpy()
            if opening is None:
                opening = conv[0]
            start = np.concatenate([[True], conv[1:] != conv[:-1]])
            k = np.arange(n)
            first = np.maximum.accumulate(np.where(start, k, 0))
            goes_on = last is not None and last[0] == conv[0]
            head = first == 0 if goes_on else np.zeros(n, bool)
            at = k - first + 1 + np.where(head, last[1] if goes_on else 0, 0)
            columns = []
            for j, m in enumerate(moduli):
                up, down = tables[j]
                f = scan(b.column(3 + j).to_numpy() % m, first, m, up, down)
                power = up[k - first + 1]
                if goes_on:
                    f = np.where(head, (f + last[2][j] * power) % m, f)
                    power = np.where(head, power * last[3][j] % m, power)
                columns.append((f, power))
            last = (conv[-1], int(at[-1]), [int(f[-1]) for f, _ in columns], [int(p[-1]) for _, p in columns])
            out = {
                "conv_id": b.column(0), "part": pa.array(np.full(n, part, np.int32)), "i": pa.array(at), "sha": b.column(1), "n_words": b.column(2),
                "t1": pa.array(b.column(3).to_numpy() % moduli[0]), "t2": pa.array(b.column(4).to_numpy() % moduli[1]),
                "f1": pa.array(columns[0][0]), "f2": pa.array(columns[1][0]), "p1": pa.array(columns[0][1]), "p2": pa.array(columns[1][1]),
                "starts": pa.array(conv == opening),
            }
            if held is not None:
                yield pa.RecordBatch.from_pydict({**held, "ends": pa.array(np.zeros(len(held["i"]), bool))})
            held = out
        if held is not None:
            ends = np.zeros(len(held["i"]), bool)
            ends[-1] = True
            yield pa.RecordBatch.from_pydict({**held, "ends": pa.array(ends)})

    return run


def _times(a: Column, b: Column, m: int) -> Column:
    return a * b % m


def scanned(turns: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """conv_id, i (from 1), sha, n_words, t1, t2, f1, f2, p1, p2 of turns(conv_id, turn, role, text): f is the prefix up to the turn, p is base^i.

    Turns are in order of `turn` (null first), then role, then the SHA-256 of the turn. Texts are reduced before the shuffle. Rows
    are dealt by ranges of (conv_id, turn), so that a conversation of any length is many tasks' work; what a task has
    to know of those before it is one row a task.
    """
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    short = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), sha.alias("sha"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"))
    number = lambda at: F.conv(F.substring("sha", at, 12), 16, 10).cast("long") + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = short.repartitionByRange(parts, F.col("conv_id"), F.asc_nulls_first("turn")).sortWithinPartitions(F.col("conv_id"), F.asc_nulls_first("turn"), "role", "sha")
    rows = stored(bounded(dealt.select("conv_id", F.unhex("sha").alias("sha"), "n_words", number(1).alias("t1"), number(13).alias("t2"))).mapInArrow(tidy(_scan(moduli)), _SCANNED))
    # one row a task, folded in order
    carried, before = [], None
    for r in rows.where("ends").select("conv_id", "part", "i", "starts", "f1", "f2", "p1", "p2").orderBy("part").collect():
        if before:
            carried.append((r["part"], *before))  # for the rows of the conversation that was open
        f, p, n = (r["f1"], r["f2"]), (r["p1"], r["p2"]), r["i"]
        if before and before[0] == r["conv_id"] and r["starts"]:
            f = tuple((before[2 + j] * p[j] + f[j]) % moduli[j] for j in range(2))
            p, n = tuple(before[4 + j] * p[j] % moduli[j] for j in range(2)), n + before[1]
        before = (r["conv_id"], n, *f, *p)
    table = spark.createDataFrame(carried, "_part int, _conv long, _n long, _f1 long, _f2 long, _p1 long, _p2 long")
    met = rows.join(F.broadcast(table), (F.col("part") == F.col("_part")) & (F.col("conv_id") == F.col("_conv")), "left")
    on = lambda name, value: F.when(F.col("_n").isNull(), F.col(name)).otherwise(value).alias(name)
    return met.select(
        "conv_id", on("i", F.col("i") + F.col("_n")), "sha", "n_words", "t1", "t2",
        *(on(f"f{j}", (_times(F.col(f"_f{j}"), F.col(f"p{j}"), m) + F.col(f"f{j}")) % m) for j, m in zip((1, 2), moduli, strict=True)),
        *(on(f"p{j}", _times(F.col(f"_p{j}"), F.col(f"p{j}"), m)) for j, m in zip((1, 2), moduli, strict=True)),
    )


def _borrowed(conv_id: Column, block: int, first: int) -> tuple[Column, Column]:
    """The conversation whose first turns are taken, and how many."""
    return conv_id - F.pmod(conv_id, F.lit(block)), (F.crc32(conv_id.cast("string")) % first).cast("long")


def _rebuilt(turns: DataFrame, moduli: tuple[int, int], block: int, first: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the trie and the ends of conversations.

    The rows: conv_id, depth, k1, k2 (the prefix after the exchange), q1, q2 (its parent's), sha, n_words, w (conversations that
    share this very row), up (the conversation whose row at depth - 1 is the parent). The ends: conv_id, of_conv, depth: a
    conversation ends with the row of of_conv at that depth; depth 0 is the root.
    """
    rows = stored(scanned(turns, moduli))
    heads = [F.max(F.when(F.col("i") == k, F.struct("f1", "f2"))).alias(f"h{k}") for k in range(1, first)]
    base, share = _borrowed(F.col("conv_id"), block, first)
    convs = stored(rows.groupBy("conv_id").agg(F.max("i").alias("n"), *heads).withColumns({"base": base, "h": share}))
    theirs = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"), *(F.col(f"h{k}").alias(f"_h{k}") for k in range(1, first)))
    met = convs.join(theirs, F.col("base") == F.col("_base"), "left")
    own = F.col("conv_id") == F.col("base")
    met = met.withColumn("h", F.when(own, 0).otherwise(F.col("h"))).withColumn("g", F.least("h", F.coalesce("_n", F.lit(0))))
    picked = lambda prefix, at, part: F.coalesce(*(F.when(at == k, F.col(f"{prefix}{k}.{part}")) for k in range(1, first)), F.lit(0))
    # what the first own turns came to, and what stands in for them
    plan = stored(met.select("conv_id", "base", "n", "h", "g", *(picked("h", F.col("h"), f"f{j}").alias(f"a{j}") for j in (1, 2)), *(picked("_h", F.col("g"), f"f{j}").alias(f"b{j}") for j in (1, 2))))
    depths = F.explode(F.sequence(F.lit(1), F.col("g").cast("int")))
    shared = plan.where("g > 0").select(F.col("base").alias("_to"), depths.alias("_depth")).groupBy("_to", "_depth").agg(F.count(F.lit(1)).alias("_more"))
    kept = rows.join(plan, "conv_id").where("i > h")
    inverse = [pow(x % m, -1, m) for m, x in zip(moduli, BASES, strict=True)]
    columns = []
    for j, m in zip((1, 2), moduli, strict=True):
        back = F.lit(1).cast("long")
        for k in range(1, first):
            back = F.when(F.col("h") == k, F.lit(pow(inverse[j - 1], k, m)).cast("long")).otherwise(back)
        power = _times(F.col(f"p{j}"), back, m)  # base^(i - h)
        columns.append(((F.col(f"f{j}") + F.pmod(F.col(f"b{j}") - F.col(f"a{j}"), F.lit(m)) * power) % m).alias(f"k{j}"))
    moved = kept.select("conv_id", (F.col("i") - F.col("h") + F.col("g")).alias("depth"), *columns, "t1", "t2", "sha", "n_words", "base", "g")
    parent = [(F.pmod(F.col(f"k{j}") - F.col(f"t{j}"), F.lit(m)) * inverse[j - 1] % m).alias(f"q{j}") for j, m in zip((1, 2), moduli, strict=True)]
    up = F.when(F.col("depth") - 1 > F.col("g"), F.col("conv_id")).when(F.col("g") > 0, F.col("base")).otherwise(F.col("conv_id"))
    whole = moved.join(shared, (F.col("conv_id") == F.col("_to")) & (F.col("depth") == F.col("_depth")), "left")
    trie = whole.select("conv_id", "depth", "k1", "k2", *parent, "sha", "n_words", (F.coalesce("_more", F.lit(0)) + 1).alias("w"), up.alias("up"))
    longer = F.col("n") > F.col("h")
    ends = plan.select("conv_id", F.when(longer, F.col("conv_id")).otherwise(F.col("base")).alias("of_conv"), (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("g")).alias("depth"))
    return trie, ends


_KEY = ["depth", "k1", "k2", "v"]


def _verified(trie: DataFrame) -> DataFrame:
    """The rows with v, which tells groups of one fingerprint apart, and q, their parent's v.

    A row is right in its group if its turn is that of the group's smallest member and both come from one group. All of a
    group are if the smallest and the largest of them are the same, which is summed before the shuffle. Only where a
    fingerprint collided rows are moved: those that are wrong make a group of their own, until none is.
    """
    rows = stored(trie.withColumns({"v": F.lit(0), "q": F.lit(0)}))
    mixed = lambda r: r.groupBy(*_KEY).agg(F.min(F.struct("conv_id", "sha", "q")).alias("rep"), F.min("sha").alias("a"), F.max("sha").alias("b"), F.min("q").alias("c"), F.max("q").alias("d")).where("a <> b or c <> d").select(*_KEY, "rep")
    while True:
        groups = stored(mixed(rows))
        if groups.isEmpty():
            return rows
        wrong = F.col("rep").isNotNull() & ((F.col("sha") != F.col("rep.sha")) | (F.col("q") != F.col("rep.q")))
        moved = stored(rows.join(groups, _KEY, "left").withColumn("v", F.col("v") + F.when(wrong, 1).otherwise(0)).drop("rep", "q"))
        above = moved.select(F.col("conv_id").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("v").alias("q"))
        rows = stored(moved.join(above, ["up", "depth"], "left").na.fill(0, ["q"]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for the members of each node, which follow each other in order; nothing but its state is held."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"depth": pa.array([at[0]], pa.int64()), "rep": pa.array([at[1]], pa.int64()), "ends_sha256": [state.hexdigest()]})

    for b in batches:
        depth, rep, conv = (c.to_numpy() for c in b.columns)
        cuts = np.flatnonzero((depth[1:] != depth[:-1]) | (rep[1:] != rep[:-1])) + 1
        for s, e in zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(conv)).tolist(), strict=True):
            if s == e:
                continue
            node = (int(depth[s]), int(rep[s]))
            text = ",".join(map(str, conv[s:e].tolist()))
            if node != at:
                if at is not None:
                    yield row()
                at, state = node, hashlib.sha256()
            else:
                text = "," + text
            state.update(text.encode())
    if at is not None:
        yield row()


def _suffix_sums(nodes: DataFrame, *names: str) -> DataFrame:
    """Sums of columns from a node to the end of its path, in two levels: within pieces of a path, then over the pieces after."""
    piece = F.floor(F.col("depth") / PIECE)
    rows = nodes.withColumn("_piece", piece)
    sums = rows.groupBy("rep", "_piece").agg(*(F.sum(n).alias(f"_{n}") for n in names))
    after = Window.partitionBy("rep").orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("rep", "_piece", *(F.coalesce(F.sum(f"_{n}").over(after), F.lit(0)).alias(f"_{n}") for n in names))
    within = Window.partitionBy("rep", "_piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *(F.sum(n).over(within).alias(f"_w_{n}") for n in names)).drop(*names).join(later, ["rep", "_piece"]).select(*(c for c in nodes.columns if c not in names), *((F.col(f"_w_{n}") + F.col(f"_{n}")).alias(n) for n in names))


def trie(turns: DataFrame, moduli: tuple[int, int] = MODULI, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """The nodes of the trie of turns(conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are in order of turn (null first), then role, then the turn's digest; null roles and texts are empty. With `block`
    above 1, conversation c begins with the first h turns of c - c mod block (all if it has fewer, none if it doesn't exist) in place of
    its own, h being crc32 of the decimal c modulo `first`; block 1 leaves conversations as they are. A node is a distinct sequence of first turns; its
    conv_id is its smallest member, n_convs its members; n_leaves and saved_tokens (words of the last turn times members but
    one) are summed over its subtree; ends_sha256 is of the comma-joined conv_ids that end there. The root has depth 0 and no parent.
    Rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own; an empty table has
    no node; other columns are ignored. Turns are compared by the SHA-256 of role and text. `moduli` may be made tiny in tests to force
    equal fingerprints. Jobs run while the result is declared.
    """
    spark = turns.sparkSession
    found, ended = _rebuilt(turns, moduli, block, first)
    rows = _verified(found)
    ended = stored(ended)
    merged = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.sum("w").alias("n_convs"), F.min("n_words").alias("n_words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("q").alias("q"))
    every = ended.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs")).first()
    root = spark.createDataFrame([(0, 0, 0, 0, *every, 0)] if every["n_convs"] else [], "depth long, k1 long, k2 long, v int, rep long, n_convs long, n_words long")
    root = root.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("q1", "long"), ("q2", "long"), ("q", "int"))))
    nodes = stored(merged.unionByName(root))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("q"), F.col("rep").alias("parent"))
    hung = nodes.join(parents, ["depth", "q1", "q2", "q"], "left")
    children = hung.where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("rep")).agg(F.count(F.lit(1)).alias("n_children"))
    named = hung.select("depth", "rep", "parent", "n_convs", "n_words").join(children, ["depth", "rep"], "left").na.fill(0, ["n_children"])
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    named = stored(named.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")}))
    # a path for each conversation that owns nodes, hung on the path and the depth that its first node's parent has
    paths = stored(named.groupBy("rep").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min_by(F.struct("parent", "depth"), "depth").alias("top")))
    sums = _subtree_sums(paths.select("rep", F.col("top.parent").alias("to"), "n_leaves", "saved_tokens"))
    hanging = paths.select("rep", F.col("top.parent").alias("to"), (F.col("top.depth") - 1).alias("depth")).where("to is not null").join(sums, "rep")
    added = hanging.groupBy(F.col("to").alias("rep"), "depth").agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
    own = named.join(added, ["rep", "depth"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("_l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("_s", F.lit(0))}).drop("_l", "_s")
    rolled = _suffix_sums(own, "n_leaves", "saved_tokens")
    where = ended.where("depth > 0").join(rows.select(F.col("conv_id").alias("of_conv"), *_KEY), ["of_conv", "depth"]).join(nodes.select(*_KEY, "rep"), _KEY).select("depth", "rep", "conv_id")
    at_root = ended.where("depth = 0").select("depth", F.lit(every["rep"]).cast("long").alias("rep"), "conv_id")
    members = where.unionByName(at_root).repartition("depth", "rep").sortWithinPartitions("depth", "rep", "conv_id")
    hashed = bounded(members).mapInArrow(tidy(_digests), "depth long, rep long, ends_sha256 string")
    return rolled.join(hashed, ["depth", "rep"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _subtree_sums(paths: DataFrame) -> DataFrame:
    """paths(rep, to, n_leaves, saved_tokens), `to` being the path above, with sums over all below: as many rounds as the depth has binary digits.

    After k rounds a path has the sums of all less than 2^k steps below it, and knows the one 2^k steps above.
    """
    names = ("n_leaves", "saved_tokens")
    while True:
        if paths.where("to is not null").isEmpty():
            return paths.drop("to")
        below = paths.where("to is not null").groupBy(F.col("to").alias("rep")).agg(*(F.sum(n).alias(f"_{n}") for n in names))
        above = paths.select(F.col("rep").alias("to"), F.col("to").alias("_to"))
        summed = paths.join(below, "rep", "left").select("rep", "to", *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names))
        paths = stored(summed.join(above, "to", "left").select("rep", F.col("_to").alias("to"), *names))
