"""Exact, SimHash, embedding and substring dedup against brute force, and their odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandlake.llm import components, embed, exact, simhash, substring
from strandlake.llm.common import forest

SCHEMA = "doc_id long, text string, lang string, kept boolean, component_id string, text_sha256 string, fp string"


def documents(spark, rows):
    """Rows of (doc_id, text) beside columns that bear the results' names."""
    return spark.createDataFrame([(i, t, "en", True, "x", "y", "z") for i, t in rows], SCHEMA)


LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "a"), (5, "a"), (6, "A"), (7, LONG), (8, LONG), (9, LONG + "x"), (10, "é \x00 ü"), (None, "a")]


def collect(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- components ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 400
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(n * seed // 4)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700)]
    a, b = np.array(links).T
    label = forest(800, a, b)
    got = dict(collect(components.components(spark.createDataFrame(links, "x long, y long").repartition(8)), "node", "component"))
    assert got == {i: int(r) for i, r in enumerate(label) if i != r}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- exact -----------------------------------------------------------------------------------


def brute_exact(rows):
    out = []
    text = lambda t: t or ""
    for k, (i, t) in enumerate(rows):
        same = [(j if j is not None else -1) for j, u in rows if text(u) == text(t)]
        keep = max(same)
        out.append((i, None if keep < 0 else keep, len(same), hashlib.sha256(text(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("moduli", "huge"), [(exact.MODULI, exact.HUGE), ((2, 3), exact.HUGE), (exact.MODULI, 100_000)])
def test_exact(spark, moduli, huge):
    docs = documents(spark, ODD)
    found = exact.exact_groups(docs, moduli, huge)
    assert collect(found, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(ODD)
    kept = [r for r in found.collect() if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len({t or "" for _, t in ODD})


def test_exact_collisions_are_divided(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["aa", "ab", "ba", "bb", "cc"])) for i in range(60)]
    assert collect(exact.exact_groups(documents(spark, rows), (2, 2)), "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(rows)


def test_doc_ids_with_several_texts(spark):
    rows = [(5, "a"), (5, "b"), (6, "a"), (7, "b"), (None, "b"), (None, "c"), (None, "a"), (None, None), (8, "c"), (5, "a")]
    for moduli in (exact.MODULI, (2, 3), (1, 1)):
        found = exact.exact_groups(documents(spark, rows), moduli)
        assert collect(found, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(rows)
        kept = [r for r in found.collect() if r["kept"]]
        assert len(kept) == len({r["text_sha256"] for r in kept}) == 4
    assert collect(exact.without_copies(documents(spark, rows)), "doc_id", "text") == sorted([(6, "a"), (7, "b"), (8, "c"), (None, None)], key=str)


def test_without_copies(spark):
    left = exact.without_copies(documents(spark, ODD))
    assert left.columns == documents(spark, ODD).columns
    assert collect(left, "doc_id") == sorted([(2,), (3,), (5,), (6,), (8,), (9,), (10,)], key=str)


def test_composable():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    tables = tuple(exact.powers(m, b) for m, b in zip(exact.MODULI, exact.BASES, strict=True))
    whole = exact.fingerprint(data, tables, exact.MODULI)
    x, y = (exact.fingerprint(p, tables, exact.MODULI) for p in (data[:77_777], data[77_777:]))
    assert whole == [exact.combine(p, q, len(data) - 77_777, m, b) for p, q, m, b in zip(x, y, exact.MODULI, exact.BASES, strict=True)]
    value = 0
    for c in data[:1000]:
        value = (value * exact.BASES[0] + c + 1) % exact.MODULI[0]
    assert exact.fingerprint(data[:1000], tables, exact.MODULI)[0] == value


# -- SimHash ---------------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_within_two_bits():
    decoder = simhash.golay_decoder()
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 4000)
    keys = simhash.golay_keys(w, decoder)
    assert ((keys >= 0).sum(1) <= 6).all() and (keys[:, 0] >= 0).all()
    for flips in ((), (1,), (2, 9), (0, 22)):
        v = w.copy()
        for f in flips:
            v ^= 1 << f
        other = simhash.golay_keys(v, decoder)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, other, strict=True))


def near_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = list(ODD[:9])
    for i in range(100, 160):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        rows.append((i, " ".join(base)))
        for k in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((1000 + 10 * i + k, "  ".join(base)))
    return rows


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_simhash(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = near_rows()
    got = collect(simhash.near_groups(documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    prints = np.array([brute_simhash(t) for _, t in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2)
    label = forest(len(rows), a, b)
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, i), i)
    assert got == sorted(((i, f"{p:016x}", least[k]) for (i, _), p, k in zip(rows, prints.tolist(), label, strict=True)), key=str)


def brute_similar(rows, similarity=0.8):
    """Smallest doc_id of each row's group by Jaccard similarities of all pairs; of rows without a doc_id null."""
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    label = forest(len(rows), *(np.array(alike).T if alike else np.zeros((2, 0), int)))
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, i), i) if i is not None else None
    return [least[k] for k in label]


@pytest.mark.parametrize("full", [simhash.FULL, 4])
def test_similar(spark, monkeypatch, full):
    """Families of texts of all lengths and rates of edits: nearly every group is that of all pairs, and none holds more."""
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = [r for r in ODD if r[0] is not None and r[0] != 5]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 200, 800]))]
        for k in range(5):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40)) if k else 0):
                other[rng.randrange(len(base))] = rng.choice(words)
            rows.append((1000 + 100 * i + k, " ".join(other)))
    wanted = dict(zip([i for i, _ in rows], brute_similar(rows), strict=True))
    got = dict(collect(simhash.similar_groups(documents(spark, rows)), "doc_id", "component_id"))
    assert set(got) == set(wanted)
    assert sum(got[i] == wanted[i] for i in got) >= 0.97 * len(got)
    assert all(wanted[i] == wanted[got[i]] for i in got)  # never linked where brute force doesn't
    left = simhash.without_near_copies(documents(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {i for i in got if got[i] == i}


def test_similar_recall_near_the_threshold(spark):
    """300 pairs of a similarity of 0.8 to 0.86, and 300 of 0.72 to 0.79: at least 0.95 of the ones are linked, none of the others."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows, alike, other = [], [], []
    while len(alike) < 300 or len(other) < 300:
        n = rng.choice([100, 300, 900])
        a = [rng.choice(words) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(n // 60, n // 28)):
            b[rng.randrange(n)] = rng.choice(words)
        x, y = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (a, b))
        like = len(x & y) / len(x | y)
        kind = alike if 0.8 <= like <= 0.86 else other if 0.72 <= like < 0.79 else None
        if kind is not None and len(kind) < 300:
            kind.append(len(rows))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = dict(collect(simhash.similar_groups(documents(spark, rows)), "doc_id", "component_id"))
    assert sum(got[i + 1] == i for i in alike) >= 0.95 * 300
    assert all(got[i + 1] == i + 1 for i in other)


@pytest.mark.parametrize("full", [simhash.FULL, 64])
def test_similar_in_crowded_buckets(spark, monkeypatch, full):
    """A repeated phrase rules the fingerprints: every text is as near to 400 that aren't alike as to its own copy, and every copy is found."""
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(17)
    phrase, rows = "one two three four five six seven eight nine ten".split(), []
    for i in range(440):
        base = phrase * 60 + [f"t{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((i, " ".join(base)))
        if i % 11 == 0:  # copies in a chain, each like the one before
            for k in range(3):
                base[610 + 25 * k] = f"edit{i}x{k}"
                rows.append((1000 + 10 * i + k, " ".join(base)))
    wanted = dict(zip([i for i, _ in rows], brute_similar(rows), strict=True))
    assert sum(i != k for i, k in wanted.items()) == 120
    docs = documents(spark, rows).repartition(5)
    assert dict(collect(simhash.similar_groups(docs), "doc_id", "component_id")) == wanted


def test_pairs_belong_to_one_bucket():
    """The first key that two fingerprints share is that of the keys made for both, and none if they share none."""
    rng = np.random.default_rng(9)
    fp = rng.integers(-(2**63), 2**63 - 1, 40)
    fp = np.concatenate([fp, fp ^ (1 << rng.integers(0, 62, 40)) ^ (1 << rng.integers(0, 62, 40))])
    weak = np.zeros(len(fp), np.int64)
    for _ in range(9):
        weak = weak << 5 | rng.integers(0, 21, len(fp))
    table = simhash.pa.record_batch([fp, weak, np.ones(len(fp), np.int32), np.arange(len(fp))], names=["fp", "weak", "n", "node"])
    keys = [set() for _ in fp]
    for b in simhash._pair_keys(iter([table])):
        for key, node in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True):
            keys[node].add(key)
    a, b = np.triu_indices(len(fp), 1)
    first = simhash.first_keys(simhash.pair_indices(fp, weak, simhash.golay_decoder()), a, b)
    assert first.tolist() == [min(keys[i] & keys[j], default=-1) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert (first >= 0).sum() >= 40


def test_similar_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "c d e f g h"), (5, "A  b"), (6, "c d e f g h"), (None, "a b"), (None, None), (7, "x " * 30_000), (8, "x x x x x x x")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 4), (7, 7), (8, 7), (None, None), (None, None)], key=str)
    left = collect(simhash.without_near_copies(documents(spark, rows)), "doc_id", "text")
    assert {i for i, _ in left} == {1, 4, 7, None}


def test_spanning_forest():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(2, 12)
        edges = sorted((rng.randint(0, 5), rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30)))
        w, a, b = np.array(edges, int).reshape(-1, 3).T
        chosen = simhash.spanning(n, a, b)
        assert np.array_equal(forest(n, a, b), forest(n, a[chosen], b[chosen])) and len(chosen) == n - len(set(forest(n, a, b).tolist()))
        total, label = 0, list(range(n))
        for weight, x, y in edges:  # Kruskal
            if label[x] != label[y]:
                total += weight
                label = [label[x] if c == label[y] else c for c in label]
        assert w[chosen].sum() == total


# -- embeddings ------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    for i in range(300, 420):
        v = x[i % 300 if i % 2 else len(x) - 1]
        x = np.vstack([x, v / np.linalg.norm(v) + rng.standard_normal(16) * 0.06])
    rows = [(i, [float(c) for c in v.astype(np.float32)], 0) for i, v in enumerate(x)]
    rows += [(500, rows[3][1], 1), (501, rows[3][1], 1), (502, [3 * c for c in rows[7][1]], 2)]
    odd = [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [1.0, None] * 8, 0), (604, [float("inf")] + [1.0] * 15, 0), (605, [], 0), (606, [1.0, 0.0], 0), (607, [2.0, 0.0], 0), (608, [5.0], 0), (609, [-1.0], 0), (610, [2.0], 0)]
    got = collect(embed.near_groups(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")), "vec_id", "n_links", "component_id", "kept")
    y = np.array([np.array(r[1], np.float32) for r in rows], np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = y @ y.T >= 0.95
    np.fill_diagonal(hit, False)
    label = forest(len(rows), *np.nonzero(hit))
    ids = [r[0] for r in rows]
    wanted = [(i, int(n), ids[k], i == ids[k]) for i, n, k in zip(ids, hit.sum(1), label, strict=True)]
    wanted += [(i, 0, i, True) for i in (600, 601, 602, 603, 604, 605, 609)] + [(606, 1, 606, True), (607, 1, 606, False), (608, 1, 608, True), (610, 1, 608, False)]
    assert got == sorted(wanted, key=str)


def test_embeddings_full_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, [float(c) for c in base + rng.standard_normal(8) * 0.01], 0) for i in range(100)]
    got = collect(embed.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "n_links", "component_id")
    assert got == [(99, 0)] * 100


def test_embeddings_recall_where_cells_prune(spark):
    """20,000 vectors, 71 codes a half: of the true links of the ids divisible by 100, at least 0.99 are found, and none else."""
    rng = np.random.default_rng(5)
    n, dim = 20_000, 32
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    group = rng.integers(0, 300, n)  # a third lies in dense groups, many links close to the threshold
    noise = rng.standard_normal((n, dim)) / dim**0.5
    dense = np.arange(n) % 3 == 0
    x[dense] = x[group[dense]] + noise[dense] * rng.uniform(0.1, 0.35, n)[dense, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    assert embed.codes(n) >= 16
    got = {r["vec_id"]: r["n_links"] for r in embed.near_groups(df.repartition(4)).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    queries = np.arange(0, n, 100)
    true = (y[queries] @ y.T >= 0.95).sum(1) - 1
    found = np.array([got[i] for i in queries])
    assert true.sum() > 500 and (found <= true).all()
    assert found.sum() >= 0.99 * true.sum()


def test_embeddings_in_double_precision(spark):
    """Cosines a hair on either side of the threshold, components near the ends of their types, and long vectors."""
    near, far = 0.95 + 1e-12, 0.95 - 1e-12
    rows = [(1, [1.0, 0.0, 0.0]), (2, [near, (1 - near**2) ** 0.5, 0.0]), (3, [far, 0.0, (1 - far**2) ** 0.5]), (4, [0.0, 1e300, 1e300]), (5, [0.0, 1e-300, 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}
    big = 3.3e38
    rows = [(1, [big] * 3), (2, [1.0] * 3), (3, [1.0] * 5000), (4, [2.0] * 5000), (5, [1.0] * 2500 + [-1.0] * 2500)]
    got = {r["vec_id"]: r["n_links"] for r in embed.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_traversal_is_best_first_and_complete():
    rng = np.random.default_rng(1)
    a, b = rng.random((50, 6)), rng.random((50, 9))
    a[:, 2] = b[:, 4] = 0.0  # the own codes
    query, one, two = embed.traverse(a, b, 0.7)
    cost = a[query, one] + b[query, two]
    for q in range(50):
        mine = cost[query == q]
        assert (np.diff(mine) >= 0).all() and mine[0] == 0
        assert {*zip(one[query == q].tolist(), two[query == q].tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(a[q][:, None] + b[q][None] <= 0.7)), strict=True)}


# -- passages --------------------------------------------------------------------------------


def test_passages(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(5000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    shared, fuzzy = make(60), make(120)
    edited = list(fuzzy)
    for k in range(10, 110, 12):
        edited[k] = "edit"
    del edited[57]
    rows = {
        1: make(100) + shared + make(50), 2: make(30) + shared + make(10), 3: make(200), 4: shared + make(90), 5: make(20) + fuzzy + make(20), 6: make(40) + edited + make(5),
        7: make(30) + shared[:30] + make(30), 8: make(3), 9: shared,
    }
    data = [(i, " ".join(w)) for i, w in rows.items()] + [(10, None), (11, ""), (None, " ".join(shared)), (12, "x " * 30_000)]
    docs = documents(spark, data)
    found = {r["doc_id"]: r for r in substring.passages(docs).collect()}
    assert set(found) == {2, 4, 6, 9}
    for i, at, n in ((2, 30, 60), (4, 0, 60), (9, 0, 60)):
        assert (found[i]["start_word"], found[i]["end_word"]) == (at, at + n) and found[i]["similarity"] == 1.0
    assert {found[i]["other_id"] for i in (2, 4, 9)} == {1, 2, 4}
    assert found[6]["other_id"] == 5 and found[6]["start_word"] <= 42 and found[6]["end_word"] >= 40 + 117 and found[6]["similarity"] >= 0.8
    cut = {r["doc_id"]: r["text"] for r in substring.without_passages(docs, substring.passages(docs)).collect() if r["doc_id"] is not None}
    texts = dict(data)
    assert cut[1] == texts[1] and cut[3] == texts[3] and cut[5] == texts[5] and cut[7] == texts[7] and cut[10] is None
    assert cut[2].split() == rows[2][:30] + rows[2][90:] and cut[9] == ""


def test_passages_of_repeated_ids(spark):
    """Texts of one doc_id are told apart: each loses its own passages only, and the later of two that share one loses it."""
    rng = random.Random(16)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, twice = make(60), make(70)
    first, clean = make(40) + shared, make(80)
    a, b = sorted((" ".join(make(20) + twice), " ".join(twice + make(30))), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    texts = [(1, first), (2, make(10) + shared), (2, clean), (2, clean), (2, None), (2, [""]), (None, shared)]
    data = [(i, t and " ".join(t)) for i, t in texts] + [(3, a), (3, b)]
    docs = documents(spark, data)
    found = substring.passages(docs)
    assert {(r["doc_id"], r["other_id"], r["start_word"], r["end_word"], r["text_id"]) for r in found.collect()} == {
        (2, 1, 10, 70, hashlib.md5(data[1][1].encode()).hexdigest()), (3, 3, *((0, 70) if b.split()[0] == twice[0] else (20, 90)), hashlib.md5(b.encode()).hexdigest()),
    }
    left = collections.Counter((r["doc_id"], r["text"] and " ".join(r["text"].split())) for r in substring.without_passages(docs, found).collect())
    lost = lambda t, part: " ".join(t.replace(" ".join(part), "").split())
    assert left == collections.Counter([(i, lost(t, shared) if (i, t) == data[1] else lost(t, twice) if t == b else t) for i, t in data])


def test_exact_passages_of_frequent_lines(spark):
    """Whatever documents share pieces of it, a passage that an older document has word for word is found."""
    rng = random.Random(11)
    lines = [[f"l{i}x{k}" for k in range(rng.randint(6, 30))] for i in range(25)]
    passage = [w for line in lines[:6] for w in line]
    rows = {1: ["a"] * 5 + passage + ["b"] * 5, 400: ["c"] * 5 + passage + ["d"] * 5}
    for i in range(2, 400):  # each has some of the lines
        rows[i] = [w for k in range(rng.randint(1, 8)) for w in [*rng.choice(lines), *(f"u{i}x{k}x{j}" for j in range(rng.randint(0, 2)))]]
    seen, wanted = set(), {}
    for i in sorted(rows):
        grams = [tuple(rows[i][k : k + substring.LEAST]) for k in range(len(rows[i]) - substring.LEAST + 1)]
        wanted[i] = {k + j for k, g in enumerate(grams) if g in seen for j in range(substring.LEAST)}
        seen |= set(grams)
    assert len(wanted[400]) == len(passage) and sum(map(len, wanted.values())) > 10 * substring.LEAST
    found = {i: set() for i in rows}
    for r in substring.passages(documents(spark, [(i, " ".join(w)) for i, w in rows.items()]).repartition(7)).collect():
        found[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert all(wanted[i] <= found[i] for i in rows)


def test_passages_hidden_by_documents_in_between(spark, monkeypatch):
    """Every seed of an edited passage has a younger partner with a piece only; the passage is found with the oldest document."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    around = lambda part: " ".join([*(word() for _ in range(40)), *part, *(word() for _ in range(40))])
    base = [word() for _ in range(60)]
    edited = [word() if i % 10 == 9 and i < 59 else w for i, w in enumerate(base)]
    rows = [(1, around(base)), (100, around(edited))]
    rows += [(2 + i // 10 + 10 * k, around(edited[i : i + 9])) for i in range(0, 60, 10) for k in range(5)]
    for common in (0, substring.COMMON):
        monkeypatch.setattr(substring, "COMMON", common)
        got = collect(substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "other_id", "start_word", "end_word")
        assert got == [(100, 1, 40, 100)]


@pytest.mark.parametrize("common", [0, 16])
def test_passages_with_every_older_document(spark, monkeypatch, common):
    """Every seed of a piece that any older document gives lies in a passage."""
    monkeypatch.setattr(substring, "COMMON", common)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    bases = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(8)]
    bases.append([word()] * 70)
    rows = []
    for i in range(90):
        text = [word() for _ in range(rng.randrange(30))]
        for base in rng.sample(bases, 3):
            low = rng.randrange(len(base) - 8)
            text += [word() if rng.random() < 0.06 else w for w in base[low : low + rng.choice((9, 20, 40, 120))]]
            text += [word() for _ in range(rng.randrange(40))]
        rows.append((i, " ".join(text)))
    rows += [(200 + i, t) for i, t in rows[::9]]
    known = {}
    for i, t in rows:
        code = substring.words(t.encode())[2]
        known[i] = code.astype("<u4"), substring.seeds(code, np.array([len(code)]))
    expected = {}
    for i in known:
        found = set()
        for j in (j for j in known if j < i):
            (a, (ha, _, pa)), (b, (hb, _, pb)) = known[i], known[j]
            x, y = substring._places(ha, hb)
            none = np.zeros(len(x), np.int64)
            for _, _, part in substring.chained(none, pa[x], none, pb[y]) if len(x) else []:
                low, low_b = max(0, part[0, 0] - substring.MARGIN), max(0, part[0, 1] - substring.MARGIN)
                high, high_b = part[-1, :2] + part[-1, 2] + substring.MARGIN
                here = {p for s, t, n in part.tolist() for p in pa[x][(pa[x] - pb[y] == s - t) & (pa[x] >= s) & (pa[x] + substring.K <= s + n)].tolist()}
                for s, e, _, _ in substring.align(a[low:high], b[low_b:high_b], part - np.array([low, low_b, 0])):
                    if e - s >= substring.LEAST:
                        found.update(w for p in here if s + low <= p and p + substring.K <= e + low for w in range(p, p + substring.K))
        expected[i] = found
    got = {i: set() for i in known}
    for i, s, e in collect(substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "start_word", "end_word"):
        got[i].update(range(s, e))
    assert sum(map(len, expected.values())) > 1000
    assert not [i for i in known if expected[i] - got[i]]


def test_words_said_over_and_over_meet_one_older_class(spark):
    """Of a run of a word one older class is asked for; the runs are found all the same, the oldest document's by shorter ones."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = [(i, " ".join([*(word() for _ in range(40)), *["the"] * rng.randrange(20, 45), *(word() for _ in range(40))])) for i in range(60)]
    classes = []
    for i, t in rows:
        code = substring.words(t.encode())[2]
        seed, _, pos = substring.seeds(code, np.array([len(code)]))
        at = np.flatnonzero(seed == substring.seeds(substring.words(b"the the the the the")[2], np.array([5]))[0][0])
        context = seed[at].astype("<i8").tobytes() + (pos[at] - pos[at[0]]).astype("<i4").tobytes()
        classes.append({"class": i, "doc": i, "last": i, "segments": context, "open": list(range(len(at)))})
    kind = pa.schema([("class", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("segments", pa.binary()), ("open", pa.list_(pa.int32()))])
    seeds = pa.Table.from_batches(substring._occurrences([pa.RecordBatch.from_pylist(classes, kind)])).sort_by([("class", "ascending"), ("pos", "ascending")])
    keys = pa.Table.from_batches(substring._pair_keys(seeds.combine_chunks().to_batches())).sort_by("key")
    met = {(r["a"], r["b"]) for b in substring._candidate_rows(keys.combine_chunks().to_batches()) for r in b.to_pylist()}
    assert {a for a, _ in met} == set(range(1, 60)) and len(met) == 59

    around = lambda *part: " ".join([*(word() for _ in range(40)), *part, *(word() for _ in range(40))])
    rows += [(100, around(*["of"] * 20)), (101, around(*["of"] * 90)), (102, around(*["of"] * 30)), (103, around(*["of"] * 70))]
    rows += [(200, around(*["on"] * 10, *["x1"] * 2, *["on"] * 10, *["x2"] * 2, *["on"] * 35)), (201, around(*["on"] * 60))]
    found = collect(substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "start_word", "end_word")
    assert found == [(101, 40, 130), (103, 40, 110), (201, 40, 100)]


def _class_keys(places):
    """Keys of classes whose documents bear their numbers, from (seed, place) that all lie in no passage."""
    rows = [(s, i, p, i, i, True, k, True) for i, x in enumerate(places) for k, (s, p) in enumerate(x)]
    keys = pa.Table.from_batches(substring._pair_keys([substring.batch(substring._OCCURRENCES, *zip(*rows, strict=True))]))
    return keys.sort_by("key").combine_chunks().to_batches()


def test_lines_said_twice_meet_no_line_said_once():
    """Seeds less than K words apart make no key: no chain can have them farther apart in the class that asks."""
    once = [[(1, 0), (2, 2), (10 + i, 40)] for i in range(30)]
    met = {(r["a"], r["b"]) for b in substring._candidate_rows(_class_keys([*once, [(1, 0), (2, 2), (1, 20), (2, 22)]])) for r in b.to_pylist()}
    assert not met


def test_exact_matches_with_two_documents_make_two_pieces():
    """Words matched with two documents each, which come in turn: a piece for each document; before, one for each word."""
    names = ["doc", "pos", "other", "other_pos"]
    kinds = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("other", pa.int64()), ("other_pos", pa.int32())])
    rows = [dict(zip(names, (9, p, o, p + 3 * o), strict=True)) for p in range(40) for o in (4, 7)]
    random.Random(1).shuffle(rows)
    got = [r for b in substring._exact_pieces(50)([pa.RecordBatch.from_pylist(rows, kinds)]) for r in b.to_pylist()]
    assert sorted((r["other"], r["a0"], r["a1"], r["matched"]) for r in got) == [(4, 0, 89, 89), (7, 0, 89, 89)]


@pytest.mark.parametrize("seed", range(3))
def test_classes_of_few_and_of_common_seeds(seed):
    """Seeds counted in parts by tasks give the pairs and the common seeds of a count of all."""
    rng = random.Random(seed)
    kind = pa.schema([("class", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("segments", pa.binary()), ("open", pa.list_(pa.int32()))])
    classes, seen = [], collections.defaultdict(list)
    for c in range(60):
        n = rng.randrange(1, 30)
        seeds, pos = [rng.randrange(12 if rng.random() < 0.3 else 200) for _ in range(n)], sorted(rng.sample(range(400), n))
        open_ = rng.choice([None, [], rng.sample(range(n), rng.randrange(1, n + 1))])
        rep = rng.randrange(1000)
        last = rep + rng.randrange(500) if open_ else None
        classes.append(dict(zip(kind.names, (c, rep, last, np.array(seeds, "<i8").tobytes() + np.array(pos, "<i4").tobytes(), open_), strict=True)))
        for s, p in zip(seeds, pos, strict=True):
            seen[s].append((c, rep, rep if last is None else last, any(abs(pos[i] - p) <= substring.NEAR for i in open_ or [])))
    common = {s for s, rows in seen.items() if len(rows) > substring.COMMON and any(r[3] for r in rows)}
    pairs = {(a[0], b[0]) for rows in seen.values() if len(rows) <= substring.COMMON for a in rows for b in rows if a[3] and a[0] != b[0] and b[1] < a[2]}
    parts = [pa.RecordBatch.from_pylist(classes[k : k + 25], kind) for k in range(0, 60, 25)]
    rows = pa.Table.from_batches(substring._shared_seeds(iter(parts))).sort_by("key").combine_chunks().to_batches()
    got = [r for b in substring._few_rows(iter(rows)) for r in b.to_pylist()]
    assert {r["key"] for r in got if r["a"] is None} == common and len(common) > 3
    assert {(r["a"], r["b"]) for r in got if r["a"] is not None} == pairs and pairs
    assert max(collections.Counter(r for b in rows for r in b.column("key").to_pylist()).values()) <= 3 * substring.COMMON


def test_classes_put_off_are_met_later():
    """What is met at first and later is all older classes."""
    keys = _class_keys([[(1, 0), (2, 20)]] * 50)
    first = [r for b in substring._candidate_rows(keys, put_off=True) for r in b.to_pylist()]
    met = {(r["a"], r["b"]) for r in first if r["b"] is not None}
    assert met == {(i, 0) for i in range(1, 50)}
    assert {r["a"] for r in first if r["a"] is not None and r["b"] is None} == set(range(50))
    packed = [r for r in first if r["a"] is None]
    rows = substring._unpacked_keys([pa.RecordBatch.from_pydict({"key": pa.array([r["key"] for r in packed]), "rows": pa.array([r["rows"] for r in packed])})])
    later = {(r["a"], r["b"]) for b in substring._candidate_rows(rows, met=substring.OLDEST) for r in b.to_pylist()}
    assert not met & later and met | later == {(i, j) for i in range(50) for j in range(i)}


def test_fuzzy_passages(spark):
    """Of passages of 100 words with 12 % changed at random, nearly all are found; the seeds leave 94 % in simulations."""
    rng = random.Random(13)
    make = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    rows, n = [], 120
    for i in range(n):
        passage = make(100)
        edited = [f"e{rng.randrange(10**6)}" if rng.random() < 0.12 else w for w in passage]
        rows += [(i, " ".join(make(40) + passage + make(40))), (1000 + i, " ".join(make(60) + edited + make(20)))]
    found = substring.passages(documents(spark, rows)).collect()
    assert all(r["other_id"] == r["doc_id"] - 1000 and r["start_word"] >= 55 and r["end_word"] <= 165 for r in found)
    assert len({r["doc_id"] for r in found if r["end_word"] - r["start_word"] >= 70}) >= 0.88 * n


def brute_chain(a, b, n):
    best = 0
    order = sorted(range(len(a)), key=lambda i: a[i])
    score = {}
    for i in order:
        score[i] = n[i]
        for j in order:
            if j in score and j != i and a[j] + n[j] <= a[i] and b[j] + n[j] <= b[i] and a[i] - a[j] - n[j] <= substring.GAP and b[i] - b[j] - n[j] <= substring.GAP:
                score[i] = max(score[i], score[j] + n[i] - substring.GAP_COST * (a[i] - a[j] - n[j] + b[i] - b[j] - n[j]))
        best = max(best, score[i])
    return best


def test_chains():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 8)
        a = sorted(rng.sample(range(60), n))
        b, size = [rng.randrange(60) for _ in a], [rng.randint(1, 6) for _ in a]
        paths = substring.chain(a, b, size)
        assert sorted(i for p in paths for i in p) == list(range(n))
        def value(p):
            return sum(size[i] for i in p) - substring.GAP_COST * sum(a[j] - a[i] - size[i] + b[j] - b[i] - size[i] for i, j in zip(p, p[1:], strict=False))
        assert value(paths[0]) == pytest.approx(brute_chain(a, b, size))


def test_chains_near_a_longer_one():
    assert sorted(map(sorted, substring.chain([0, 300, 325], [0, 300, 326], [100, 16, 16]))) == [[0], [1, 2]]
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(2, 12)
        a = sorted(rng.sample(range(400), n))
        b, size = [max(0, x + rng.randint(-6, 6)) for x in a], [rng.randint(1, 60) for _ in a]
        path = substring.chain(a, b, size)[0]
        gaps = [(a[j] - a[i] - size[i], b[j] - b[i] - size[i]) for i, j in zip(path, path[1:], strict=False)]
        assert all(0 <= g <= substring.GAP for pair in gaps for g in pair)
        assert sum(size[i] for i in path) - substring.GAP_COST * sum(map(sum, gaps)) == pytest.approx(brute_chain(a, b, size))


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert exact.exact_groups(docs).count() == simhash.near_groups(docs).count() == simhash.similar_groups(docs).count() == substring.passages(docs).count() == 0
    assert exact.without_copies(docs).count() == simhash.without_near_copies(docs).count() == substring.without_passages(docs, substring.passages(docs)).count() == 0
    assert embed.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_folder_and_broadcasts(spark, monkeypatch):
    """What is stored lies in the shared folder and can be removed; tables of many rows or bytes aren't broadcast."""
    from strandlake.llm import common

    assert common.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    table = common.stored(spark.range(1000).select("id", simhash.F.repeat(simhash.F.lit("x"), 100).alias("x")))
    hinted = lambda df: df is not table
    assert hinted(common.small(table)) and table.count() == 1000
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    assert not hinted(common.small(table))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 30)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 999)
    assert not hinted(common.small(table))
    common.release(spark)
    with pytest.raises(Exception, match="(?i)not.exist|not_exist"):
        table.collect()


def test_pieces_that_add_nothing_are_left_out():
    """Of pieces of one document with a hundred others no word lies in more than three, and the passages are those of all pieces; before, all went on."""
    rng = random.Random(3)

    def passages(pieces):
        return [r for b in substring._passage_rows(10)(iter([substring.batch(substring._PIECES, *zip(*((d, o, s, e, e - s, 1.0) for d, s, e, o in sorted(pieces)), strict=True))])) for r in b.to_pylist()]

    for _ in range(50):
        pieces = [(doc, s, s + rng.randrange(50, 90), other) for doc in (-4, 10**12) for other in range(100) for s in [rng.randrange(300)]]
        kept = [pieces[i] for i in substring._covering(*(np.array([p[k] for p in pieces]) for k in (0, 3, 1, 2)))]
        assert passages(kept) == passages(pieces) and len(kept) < 40
        assert max(collections.Counter((d, w) for d, s, e, _ in kept for w in range(s, e)).values()) <= 3


def test_seeds_go_between_tasks_as_blocks():
    """Seeds of two tasks are matched as those of one; before, each was a row of its own."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(-40, 40) << 55, rng.randrange(-30, 30), rng.randrange(90)) for _ in range(900)})
    parts = [[r for r in rows if r[1] % 2 == k] for k in (0, 1)]
    blocks = [b for part in parts for b in substring._within_task([tuple(np.array(c, np.int64) for c in zip(*part, strict=True))], 7)]
    assert sum(b.num_rows for b in blocks) <= 2 * 2 * 7
    table = pa.Table.from_batches(blocks).sort_by("bucket").combine_chunks().to_batches()
    got = pa.Table.from_batches(substring._match_rows(iter(table), 5))
    doc, pos, other, there, seed = substring._columns(got.column("rows").to_pylist(), substring._MATCH)
    older = there >= 0
    first = {k: min(d for key, d, _ in rows if key == k) for k, _, _ in rows}
    several = {k for k in first if len({d for key, d, _ in rows if key == k}) > 1}
    place = {(k, d): min(p for key, e, p in rows if (key, e) == (k, d)) for k, d, _ in rows}
    # whatever isn't of the smallest document is matched with the first place of an older one, and what is comes without one
    assert {(k, d, p) for k, d, p, o in zip(seed, doc, pos, older, strict=True) if o} == {(k, d, p) for k, d, p in rows if d != first[k]}
    assert {(k, d, p) for k, d, p, o in zip(seed, doc, pos, older, strict=True) if not o} == {(k, d, p) for k, d, p in rows if k in several and d == first[k]}
    assert all(o < d and place[k, o] == t for k, d, o, t in zip(seed[older], doc[older], other[older], there[older], strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_classes_without_a_second_seed_in_common_do_not_meet(seed):
    """Classes with two seeds in common, one within REACH words of the other in both, all meet; of those with one seed in common few do."""
    rng = random.Random(seed)
    kind = pa.schema([("class", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("segments", pa.binary()), ("open", pa.list_(pa.int32()))])
    classes, places = [], {}
    for c in range(120):
        pos = sorted(rng.sample(range(120), 6))
        places[c] = [(rng.randrange(120), p) for p in pos]
        packed = np.array([s for s, _ in places[c]], "<i8").tobytes() + np.array(pos, "<i4").tobytes()
        classes.append(dict(zip(kind.names, (c, c, c, packed, list(range(6))), strict=True)))

    def met(around):
        rows = pa.Table.from_batches(substring._shared_seeds(iter([pa.RecordBatch.from_pylist(classes, kind)]), around)).sort_by("key").combine_chunks().to_batches()
        got = [r for b in substring._few_rows(iter(rows)) for r in b.to_pylist()]
        return {(r["a"], r["b"]) for r in got if r["a"] is not None}, {r["key"] for r in got if r["a"] is None}

    every, common = met(False)
    some, the_same = met(True)
    second = lambda a, b, x, p, q: any(y == z and 0 < abs(r - p) <= substring.REACH and 0 < abs(s - q) <= substring.REACH and (r > p) == (s > q) for y, r in a for z, s in b)
    needed = {(i, j) for i, j in every if any(x == z and x not in common and second(places[i], places[j], x, p, q) for x, p in places[i] for z, q in places[j])}
    assert needed and needed <= some <= every and len(some) < 0.7 * len(every) and common == the_same
