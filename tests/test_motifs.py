"""Motif search against a plain scan."""

import random

import pytest

from strandlake.operators import dna

FLIP = str.maketrans("ACGT", "TGCA")


def scan(rows, motif, at, overlapping):
    out = []
    for chrom, strand, start, seq in rows:
        sought, shift = (motif, at) if strand == "+" else (motif.translate(FLIP)[::-1], len(motif) - at)
        i = (seq or "").find(sought)
        while i >= 0:
            out.append((chrom, start + i + shift))
            i = seq.find(sought, i + (1 if overlapping else len(motif)))
    return sorted(out)


@pytest.mark.parametrize("overlapping", [True, False])
@pytest.mark.parametrize(("motif", "position"), [("AA", "5p"), ("ACA", "3p"), ("A", 1), ("ACAACA", 2), ("T", "5p")])
def test_hits(spark, motif, position, overlapping):
    rng = random.Random(4)
    rows = [(i, rng.choice("+-"), 7, "".join(rng.choice("AC" if i % 2 else "A") for _ in range(rng.choice([0, 1, 2, 5, 100, 1023, 1024, 1025, 3000])))) for i in range(40)]
    rows.append((100, "+", 0, None))
    df = spark.createDataFrame(rows, "chrom long, strand string, start_pos long, seq string").repartition(3, "chrom")
    got = sorted((r["chrom"], r["hit"]) for r in dna.find_motif(df, motif, position, overlapping).collect())
    assert got == scan(rows, motif, {"5p": 0, "3p": len(motif)}.get(position, position), overlapping)


def test_positions_lie_within_the_motif(spark):
    df = spark.createDataFrame([("c", "+", 0, "A")], "chrom string, strand string, start_pos long, seq string")
    with pytest.raises(ValueError):
        dna.find_motif(df, "CAT", 4)
