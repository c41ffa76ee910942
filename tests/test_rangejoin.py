"""Positional lookups against brute force over all small intervals and random ones of very different lengths."""

import random

from itertools import product

import pytest
from pyspark.sql import functions as F

from strandlake.operators import rangejoin as rj

ENDS = [(s, e) for s in range(-2, 6) for e in range(s, 6)]


def plus(strand, a, b):
    return a if strand == "+" else b


PREDICATES = {
    "find_overlapping": lambda t, s, e, qs, qe: s < qe and qs < e,
    "find_within": lambda t, s, e, qs, qe: s >= qs and e <= qe and plus(t, e > qs, s < qe),
    "find_5p_within": lambda t, s, e, qs, qe: qs <= plus(t, s, e - 1) < qe,
    "find_3p_within": lambda t, s, e, qs, qe: qs <= plus(t, e - 1, s) < qe,
    "find_5p_aligned": lambda t, s, e, qs, qe: plus(t, s == qs, e == qe),
    "find_3p_aligned": lambda t, s, e, qs, qe: plus(t, e == qe, s == qs),
    "find_exact": lambda t, s, e, qs, qe: (s, e) == (qs, qe),
}


def frames(spark):
    rows = [(c, t, s, e) for t in "+-" for c in ("a",) for s, e in ENDS]
    return (
        spark.createDataFrame(rows, "chrom string, strand string, start_pos long, end_pos long"),
        spark.createDataFrame(rows, "q_chrom string, q_strand string, q_start long, q_end long"),
    )


@pytest.mark.parametrize("name", sorted(PREDICATES))
@pytest.mark.parametrize("width", [1, 3, 8])
def test_lookup(spark, name, width):
    elements, queries = frames(spark)
    f = getattr(rj, name)
    got = f(elements, queries) if name.endswith(("aligned", "exact")) else f(elements, queries, width=width)
    found = sorted(tuple(r) for r in got.select("strand", "start_pos", "end_pos", "q_start", "q_end").collect())
    wanted = sorted((t, s, e, qs, qe) for t in "+-" for (s, e), (qs, qe) in product(ENDS, ENDS) if PREDICATES[name](t, s, e, qs, qe))
    assert found == wanted


def test_unstranded(spark):
    elements, queries = frames(spark)
    flipped = rj.find_exact(elements.where("strand = '+'"), queries.where("q_strand = '-'"), stranded=False)
    assert flipped.count() == len(ENDS)
    with pytest.raises(Exception, match="unstranded"):
        rj.find_5p_aligned(elements.where("strand = '+'"), queries, stranded=False).collect()


def test_allow_exclude(spark):
    elements, queries = frames(spark)
    allow, exclude = queries.where("q_start = 0 AND q_end = 4"), queries.where("q_start = 2 AND q_end = 3 AND q_strand = '+'")
    got = {tuple(r) for r in rj.allow_exclude(elements, allow, exclude, width=2).select("strand", "start_pos", "end_pos").collect()}
    hit = PREDICATES["find_overlapping"]
    wanted = {(t, s, e) for t in "+-" for s, e in ENDS if hit(t, s, e, 0, 4) and not (t == "+" and hit(t, s, e, 2, 3))}
    assert got == wanted


def test_classes(spark):
    elements, _ = frames(spark)
    assert rj.length_classes(elements) == [10]
    assert rj.length_classes(elements, 1) == [0, 1, 2, 3]
    assert rj.length_classes(elements.withColumn("end_pos", F.col("start_pos") + 5000)) == [13]
    stat = {tuple(r) for r in rj.lengths(elements, "strand").collect()}
    assert ("+", 0, 15, 1) in stat and ("-", 3, 6, 7) in stat


WHOLE = 250_000_000


def mixed(seed, n):
    """Intervals from empty to a whole chromosome, many of them at its ends."""
    rng = random.Random(seed)
    out = [("+", 0, WHOLE), ("-", 0, WHOLE), ("+", WHOLE, WHOLE), ("+", 0, 0)]
    while len(out) < n:
        size = rng.choice([0, 1, rng.randrange(2000), rng.randrange(1 << rng.randrange(28)), WHOLE // 2])
        start = rng.choice([0, rng.randrange(WHOLE - size), (rng.randrange(WHOLE) >> 20) << 20, 1 << rng.randrange(27)])
        out.append((rng.choice("+-"), start, start + size))
    return out


@pytest.mark.parametrize("name", ["find_overlapping", "find_within", "find_5p_within", "find_3p_within"])
def test_lookup_of_any_length(spark, name):
    a, b = mixed(1, 300), mixed(2, 300)
    elements = spark.createDataFrame([("a", *r) for r in a], "chrom string, strand string, start_pos long, end_pos long")
    queries = spark.createDataFrame([("a", *r) for r in b], "q_chrom string, q_strand string, q_start long, q_end long")
    found = sorted(tuple(r) for r in getattr(rj, name)(elements, queries).select("strand", "start_pos", "end_pos", "q_start", "q_end").collect())
    wanted = sorted((t, s, e, qs, qe) for t, s, e in a for u, qs, qe in b if t == u and PREDICATES[name](t, s, e, qs, qe))
    assert found == wanted


@pytest.mark.parametrize("keep", [True, False])
def test_any_of_any_length(spark, keep):
    a, b = mixed(3, 300) + mixed(3, 20), [r for r in mixed(4, 60) if r[2] - r[1] < WHOLE // 4]
    elements = spark.createDataFrame([("a", *r) for r in a], "chrom string, strand string, start_pos long, end_pos long")
    queries = spark.createDataFrame([("a", *r) for r in b], "q_chrom string, q_strand string, q_start long, q_end long")
    hit = lambda t, s, e: any(t == u and PREDICATES["find_overlapping"](t, s, e, qs, qe) for u, qs, qe in b)
    found = sorted(tuple(r) for r in rj.overlapping_any(elements, queries, keep=keep).select("strand", "start_pos", "end_pos").collect())
    assert found == sorted(r for r in a if hit(*r) == keep)
    assert 0 < len(found) < len(a)


def test_rows_of_the_longest(spark):
    """A chromosome as an element and as a window, among rows of every length: each becomes under 100 rows."""
    every = list(range(10, 29))
    row = spark.createDataFrame([(0, WHOLE), (0, 1)], "start_pos long, end_pos long")
    low, high = F.col("start_pos"), F.col("end_pos")
    for home in (True, False):
        spread = rj._spread(row, "_place", home, rj.length_class(low, high), low, high, every, every)
        assert max(r["count"] for r in spread.groupBy("end_pos").count().collect()) < 100
    assert rj._spread(row.limit(1), "_place", True, rj.length_class(low, high), low, high, [28], [10]).count() == 1


def test_plan_is_an_equi_join(spark):
    elements, queries = frames(spark)
    plan = rj.find_overlapping(elements, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_elements_longer_than_every_query_are_met_by_none(spark, monkeypatch):
    sides, spread = [], rj._spread
    monkeypatch.setattr(rj, "_spread", lambda rows, name, home, *rest: sides.append((home, rows)) or spread(rows, name, home, *rest))
    a = spark.createDataFrame([("a", t, s, s + n) for t in "+-" for s in (0, 7, 90) for n in (0, 3, 5, 1000)], "chrom string, strand string, start_pos long, end_pos long")
    b = spark.createDataFrame([("a", t, s, s + 8) for t in "+-" for s in (0, 5, 88)], "q_chrom string, q_strand string, q_start long, q_end long")
    got = sorted(tuple(r) for r in rj.find_within(a, b, width=4).collect())
    assert got == sorted((*x, *y) for x, y in product(map(tuple, a.collect()), map(tuple, b.collect())) if x[1] == y[1] and PREDICATES["find_within"](x[1], *x[2:], *y[2:]))
    (elements,) = [rows for home, rows in sides if home]
    assert elements.where("end_pos - start_pos > 8").count() == 0
