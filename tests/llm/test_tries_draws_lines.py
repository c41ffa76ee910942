"""Prefix trie, importance resampling and line dedup against brute force, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import lines, prefixes, resample

# -- prefix trie -----------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, sha string"
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(spark, rows, parts=4):
    """Rows of (conv_id, turn, role, text) beside columns that bear the names of inner ones."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(parts)


def brute_trie(rows, block=20, first=4):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((-1 if turn is None else turn, role, sha, text))
    for own in convs.values():
        own.sort()
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % first
        theirs = convs.get(c - c % block, [])
        whole = [(r, t) for _, r, _, t in (own if c % block == 0 else theirs[:h] + own[h:])]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    out = []
    for prefix, members in nodes.items():
        under = [p for p in nodes if p[: len(prefix)] == prefix]
        inner = {p[:-1] for p in nodes if p}
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in under),
            sum(p not in inner for p in under), sum((len(nodes[p]) - 1) * words(p) for p in under), hashlib.sha256(",".join(map(str, sorted(ends[prefix]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*NODES).collect()), key=str)


def made_turns(seed, convs=70, vocabulary=3):
    rng = random.Random(seed)
    said = [None, "", "yes it is", "no \t not\nat all"][: vocabulary + 1]
    return [(c, t, rng.choice(["user", None]), rng.choice(said)) for c in rng.sample(range(200), convs) for t in range(rng.choice([1, 2, 3, 5, 8]))]


@pytest.mark.parametrize("block", [1, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, block):
    rows = made_turns(seed)
    assert nodes(prefixes.trie(turns_of(spark, rows), block=block)) == brute_trie(rows, block)


@pytest.mark.parametrize("moduli", [(2, 3), (5, 7)])
def test_trie_divides_collisions(spark, moduli):
    rows = made_turns(5, convs=25)
    assert nodes(prefixes.trie(turns_of(spark, rows), moduli=moduli)) == brute_trie(rows)


def test_trie_of_a_conversation_in_many_tasks(spark):
    """One conversation holds most rows; others are its copies or leave it late, each one turn after the one before."""
    long = [(40, t, "user", f"w{t % 7} a") for t in range(900)]
    leaving = [(41 + k, t, "user", f"w{t % 7} a" if t < 20 + k else f"other {k}") for k in range(12) for t in range(24 + k)]
    rows = long + leaving + [(60, t, "user", f"w{t % 7} a") for t in range(900)]
    df = turns_of(spark, rows)
    assert nodes(prefixes.trie(df)) == brute_trie(rows)


def test_scan_in_pieces():
    """Prefix polynomials of two pieces are put together by the length and the value of what came before."""
    m, base = prefixes.MODULI[0], prefixes.BASES[0]
    up, down = prefixes._tables(m, base, 50)
    values = np.random.default_rng(1).integers(1, m, 50)
    wanted, x = [], 0
    for v in values.tolist():
        x = (x * base + v) % m
        wanted.append(x)
    assert prefixes.scan(values, np.zeros(50, np.int64), m, up, down).tolist() == wanted
    left, right = (prefixes.scan(v, np.zeros(len(v), np.int64), m, up, down) for v in (values[:20], values[20:]))
    assert [(int(left[-1]) * pow(base, k + 1, m) + int(f)) % m for k, f in enumerate(right)] == wanted[20:]


def test_trie_odd_rows(spark):
    big = "long " * 50_000
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", big), (0, 0, "user", big), (0, 0, "assistant", ""), (3, 5, "user", "x"), (25, 0, "user", "only"), (-3, 0, "user", "minus")]
    assert nodes(prefixes.trie(turns_of(spark, rows))) == brute_trie(rows)
    assert nodes(prefixes.trie(turns_of(spark, []))) == []


# -- importance resampling -------------------------------------------------------------------

DOCS = "doc_id long, text string, weight string, score string, _words string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(3)


def features(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, share=25, least=20, seed=7, buckets=10_000, longest=2):
    s, t = (Counter(f % buckets for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, f = features(text, longest)
        weight = sum(gain[x % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least))
    order = sorted((-r[3], -1 if r[0] is None else r[0], r[1], k) for k, r in enumerate(out) if r[4])
    rank = {k: n for n, (*_, k) in enumerate(order[: share * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=str)


def made_documents(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "éÉ", "cat", "x1", "İstanbul", "dog", "ran-off", "und", "\x00", "far"]
    return [(i, rng.choice([" ", "_", ". "]).join(rng.choices(words, k=rng.choice([0, 5, 19, 20, 40, 90])))) for i in range(n)]


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize(("longest", "buckets", "share"), [(2, 10_000, 25), (3, 7, 100), (1, 50, 60)])
def test_resample(spark, longest, buckets, share):
    rows = made_documents(3)
    target = ["the cat ran far", "Dog und cat " * 10, None]
    found = resample.resample(documents(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), share=share, buckets=buckets, longest=longest)
    assert dict(found.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert drawn(found) == brute_resample(rows, target, share=share, buckets=buckets, longest=longest)


def test_resample_odd_rows(spark):
    same = "one two three " * 10
    rows = [(None, same), (1, None), (2, ""), (3, " \n-"), (4, "a"), *[(9, same)] * 40, (9, same + "four"), (7, "word " * 30_000), (8, "x" * 100_000)]
    target = spark.createDataFrame([("one two",)], "text string")
    assert drawn(resample.resample(documents(spark, rows), target)) == brute_resample(rows, ["one two"])
    assert drawn(resample.resample(documents(spark, rows), target, share=0)) == brute_resample(rows, ["one two"], share=0)
    assert drawn(resample.resample(documents(spark, []), target)) == []
    assert drawn(resample.resample(documents(spark, rows), target.limit(0))) == brute_resample(rows, [])


def test_draws_follow_the_target(spark):
    """Documents like the target are drawn more often, and no document twice."""
    rows = [(i, ("sun moon star " if i % 2 else "tax law court ") * 10) for i in range(400)]
    got = drawn(resample.resample(documents(spark, rows), spark.createDataFrame([("sun moon star " * 20,)], "text string")))
    chosen = [r[0] for r in got if r[4] is not None]
    assert len(chosen) == len(set(chosen)) == 100
    assert sum(i % 2 for i in chosen) > 90


# -- lines -----------------------------------------------------------------------------------


def brute_lines(rows, least=40, documents=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for i, ls in split:
        for k in {key(x) for x in ls}:
            if len(k) >= least:
                holders[k].append(-1 if i is None else i)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, ls in split:
        left = [x for x in ls if keep.get(key(x), -2) in (-2, -1 if i is None else i)]
        out.append((i, "\n".join(left), len(ls), len(ls) - len(left)))
    return sorted(out, key=str)


def made_lines(seed, n=200):
    rng = random.Random(seed)
    common = [f"{'é' * 10} All rights reserved by the {k} authors of this text" for k in range(12)] + ["é" * 39, "É" * 40, "short"]
    make = lambda: rng.choice([f"{rng.random()} a line that stands nowhere else at all", f"  {rng.choice(common)}\t", rng.choice(common).replace("All", "ALL"), "\x85" + rng.choice(common), ""])
    return [(i, "\n".join(make() for _ in range(rng.randrange(1, 9)))) for i in range(n)]


def kept(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


DROP = "doc_id long, text string, key string, keep_id string, n_lines string"


def lined(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DROP).repartition(5)


@pytest.mark.parametrize("options", [{}, {"rows": 0}, {"largest": 3}, {"largest": 13}], ids=["filters", "joined", "every key counted", "crowded filter"])
def test_lines(spark, options):
    rows = made_lines(4)
    assert kept(lines.without_repeated_lines(lined(spark, rows), **options)) == brute_lines(rows)


@pytest.mark.parametrize("options", [{}, {"rows": 0}])
def test_lines_odd_rows(spark, options):
    line = "the very same line of forty characters or more"
    rows = [(None, line), (None, None), (1, None), (2, ""), (3, "\n"), (4, line), (4, line), (5, f"{line}\n{line}\nother"), (6, line + "\n" + "x" * 200_000), (7, f" {line.upper()} \n\n"), (8, (line + "\n") * 5_000), (8, line)]
    assert kept(lines.without_repeated_lines(lined(spark, rows), **options)) == brute_lines(rows)
    few = [(None, line)] * 6
    assert kept(lines.without_repeated_lines(lined(spark, few), **options)) == brute_lines(few)
    assert kept(lines.without_repeated_lines(lined(spark, []), **options)) == []


def test_filters_miss_no_repeated_key(spark):
    rows = made_lines(6, 300)
    df = lined(spark, rows).repartition(7)
    bits, data = lines.twice_seen(df)
    sieve = lines.Filter(bits, np.frombuffer(lines.zlib.decompress(data), np.uint8))
    n = Counter(k for _, t in rows for k in lines._keys((t or "").encode(), 40))
    held = lambda k: bool(sieve.holds(np.array([lines.xxhash.xxh3_64_intdigest(k)], np.uint64))[0])
    assert all(held(k) for k, c in n.items() if c > 1)
    once = [k for k, c in n.items() if c == 1]
    assert sum(map(held, once)) < 0.1 * len(once)
    assert {r["key"].encode() for r in lines.suspects(df, (bits, data)).collect()} == {k for k in n if held(k)}
