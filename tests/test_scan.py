"""Scans in pieces against brute force, with pieces of a few positions."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import annotation as an
from strandlake.operators import scan
from strandlake.operators import tracks as tr

STRIDES = [1, 7, 1 << 20]


def intervals(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("ab"), s := rng.randrange(400), s + rng.choice([0, 1, 3, 8, 60])) for _ in range(n)]


@pytest.mark.parametrize("stride", STRIDES)
def test_scanned(spark, stride):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "chrom string, pos long, v long").repartition(5)
    at = [scan.piece(F.col("pos"), stride)]
    kinds = {k: (k, F.col("v")) for k in ("max", "min", "sum")}
    for inclusive in (True, False):
        got = sorted((tuple(r) for r in scan.scanned(df, ["chrom"], ["pos"], at, kinds, inclusive).select("chrom", "pos", "max", "min", "sum").collect()), key=str)
        wanted = []
        for c, p, _ in rows:
            seen = [v for d, q, v in rows if d == c and (q < p or inclusive and q == p) and v is not None]
            wanted.append((c, p, *((f(seen) if seen else None) for f in (max, min, sum))))
        assert got == sorted(wanted, key=str)


@pytest.mark.parametrize("stride", STRIDES)
def test_ranked(spark, stride):
    rows = intervals(2)
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long").repartition(5)
    at = [scan.piece(F.col("start_pos"), stride)]
    got = sorted(tuple(r) for r in scan.ranked(df, ["chrom"], ["start_pos", "end_pos"], at, "place").collect())
    order = {c: sorted({r for r in rows if r[0] == c}) for c in "ab"}
    assert got == sorted((*r, order[r[0]].index(r) + 1) for r in rows)
    numbers = [(r["chrom"], r["place"]) for r in scan.ranked(df, ["chrom"], ["start_pos", "end_pos"], at, "place", dense=False).orderBy("chrom", "start_pos", "end_pos", "place").collect()]
    assert numbers == [(c, i + 1) for c in "ab" for i in range(sum(r[0] == c for r in rows))]


@pytest.mark.parametrize("stride", [*STRIDES, None])
@pytest.mark.parametrize("gap", [0, 5])
def test_merge_touching(spark, stride, gap):
    rows = intervals(3, 40)
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long").repartition(5)
    wanted = []
    for c in "ab":
        run = None
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if run and s <= run[2] + gap:
                run[2], run[3] = max(run[2], e), run[3] + 1
            else:
                run = [c, s, e, 1]
                wanted.append(run)
    assert sorted(tuple(r) for r in an.merge_touching(df, "chrom", gap=gap, stride=stride).select("chrom", "start_pos", "end_pos", "n").collect()) == sorted(map(tuple, wanted))


@pytest.mark.parametrize("stride", STRIDES)
def test_runs_of_defaults(spark, stride):
    rng = random.Random(4)
    values = {p: rng.choice([0.0, 0.0, 0.0, 0.01, 1.0]) if p < 90 else 0.0 for p in range(200) if rng.random() < 0.95}
    df = spark.createDataFrame([("c", "+", p, v) for p, v in values.items()], "chrom string, strand string, pos long, value double").repartition(5)
    got = {r["pos"]: r["value"] for r in tr.sparsified(df, tr.Track(), min_run=3, min_delta=0.05, stride=stride).collect()}
    near = {p: 0.0 if v < 0.05 else v for p, v in values.items()}
    dropped = set()
    for p in near:
        run = [p]
        while near.get(run[-1] + 1) == 0.0:
            run.append(run[-1] + 1)
        if near[p] == 0.0 and near.get(p - 1) != 0.0 and len(run) >= 3:
            dropped |= set(run)
    assert got == {p: v for p, v in near.items() if p not in dropped}
    blocks = tr.blocks_of(df, stride=stride).collect()
    assert {r["start_pos"] + i: v for r in blocks for i, v in enumerate(r["values"])} == values
    assert len(blocks) == sum(p - 1 not in values for p in values)


@pytest.mark.parametrize("stride", STRIDES)
def test_overlapping_blocks(spark, stride):
    rows = intervals(5, 25)
    df = spark.createDataFrame([(c, "+", s, e) for c, s, e in rows], "chrom string, strand string, start_pos long, end_pos long").repartition(5)
    ordered = sorted(rows)
    wanted = [r for i, r in enumerate(ordered) if any(o[0] == r[0] and o[2] > r[1] for o in ordered[:i])]
    assert sorted((r["chrom"], r["start_pos"], r["end_pos"]) for r in tr.overlapping_blocks(df, stride).collect()) == wanted
