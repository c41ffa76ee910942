"""Reads of SAM text as linked tables, VCF alleles and breakends, and the errors of strict readers."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import dna, rangejoin
from strandlake.operators import reads as rd
from strandlake.sources import sam, vcf


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


READS = "read_id long, name string, flag long, chrom string, pos long, mapq int, cigar string, seq string"


@pytest.fixture(scope="module")
def genome(spark):
    chroms = table(spark, [("c", "ACGTACGTACGTACGTACGT")], "chrom string, seq string")
    return dna.chunked(chroms, 8), chroms.select("chrom", F.length("seq").cast("long").alias("size"))


def test_linked_tables(spark, genome):
    reads = [(1, "a", 0, "c", 0, 9, "2S3M4N2M1I2D2M", "GGACTTACGT"), (2, "b", 16, "c", 4, 9, "4M", "*"), (3, "d", 0, "c", 4, 9, "4M", "A=GT"), (4, "e", 0, "c", 4, 9, "4M", "acgn")]
    t = sam.tables(table(spark, reads, READS), *genome, size=8)
    shown = {k: sorted(map(tuple, v.drop("name").collect())) for k, v in t.items()}
    assert shown["alignments"] == [(1, "c", "+", 0, 13), (2, "c", "-", 4, 8), (3, "c", "+", 4, 8), (4, "c", "+", 4, 8)]
    assert [r for r in shown["matches"] if r[0] == 1] == [(1, 0, "c", 0, 3), (1, 1, "c", 7, 13)]
    assert shown["junctions"] == [(1, 0, "c", 3, 7, 3, 4)]
    # SEQ: GG soft-clipped, ACT for ACG, TA for TA, C put in, two bases left out, GT for TA... at 11 and 12
    assert shown["variants"] == [(1, 0, "c", 2, "G", "T"), (1, 1, "c", 9, "", "C"), (1, 1, "c", 9, "CG", ""), (1, 1, "c", 11, "T", "G"), (1, 1, "c", 12, "A", "T"), (4, 0, "c", 7, "T", "N")]


def test_sequences_of_another_length(spark, genome):
    bad = table(spark, [(1, "a", 0, "c", 0, 9, "4M", "ACG")], READS)
    with pytest.raises(Exception, match="another length"):
        rd.read_variants(bad, *genome, 8).collect()


def test_strands_from_introns(spark):
    gaps = table(spark, [(1, "c", 10, 20), (2, "c", 30, 40), (3, "c", 50, 60), (4, "c", 10, 20)], "j long, chrom string, start_pos long, end_pos long")
    introns = table(spark, [("c", "+", 12, 18), ("c", "-", 35, 45), ("c", "+", 39, 41), ("c", "-", 60, 70)], "chrom string, strand string, start_pos long, end_pos long")
    assert {r["j"]: r["inferred"] for r in rd.inferred_strand(gaps, introns).collect()} == {1: "+", 2: None, 3: None, 4: "+"}
    with pytest.raises(Exception, match="no strand or of both"):
        rd.inferred_strand(gaps, introns, strict=True).collect()


def test_allow_exclude_and_library(spark):
    reads = [(i, "r", flag, "c", 10 * i, 9, "5M", "*") for i, flag in enumerate((0x41, 0x51, 0x81, 0x91))]
    allow = table(spark, [("c", "+", 0, 12), ("c", "-", 0, 30)], "q_chrom string, q_strand string, q_start long, q_end long")
    got = sam.tables(table(spark, reads, READS), library="ISF", allow=allow)["alignments"].collect()
    assert {(r["read_id"], r["strand"]) for r in got} == {(0, "+"), (1, "-"), (2, "-")}


@pytest.mark.parametrize("width", [1, 4, 1 << 10])
def test_overlapping_any_against_brute_force(spark, width):
    rng = random.Random(width)
    e = [(i % 40, rng.choice("ab"), rng.choice("+-"), s, s + rng.choice([0, 1, 3, 17, 64, 65, 3000])) for i in range(150) for s in [rng.randrange(-50, 6000)]]
    q = [(rng.choice("ab"), rng.choice("+-"), s, s + rng.choice([0, 1, 5, 400])) for _ in range(25) for s in [rng.randrange(-50, 6000)]]
    elements = table(spark, e, "k long, chrom string, strand string, start_pos long, end_pos long")
    queries = table(spark, q, "q_chrom string, q_strand string, q_start long, q_end long")
    hit = [r for r in e if any(r[1] == c and r[2] == t and r[3] < y and x < r[4] for c, t, x, y in q)]
    for keep in (True, False):
        got = sorted(map(tuple, rangejoin.overlapping_any(elements, queries, width, keep).collect()))
        assert got == sorted(hit if keep else [r for r in e if r not in hit])


HEAD = ["##INFO=<ID=AF,Number=A,Type=Float>", "##INFO=<ID=AD,Number=R,Type=Integer>", "##INFO=<ID=DP,Number=1,Type=Integer>", "##FORMAT=<ID=GT,Number=1,Type=String>", "##FORMAT=<ID=XD,Number=R,Type=Integer>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"]


def test_alleles(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text("\n".join([*HEAD, "1\t5\tx\tAC\tA,G,ACT\t.\t.\tAF=0.5,.,2;DP=7;AD=1,2,3,4\tGT:XD\t2|3:0,10,20,30", "1\t9\ty\tC\tT\t.\t.\tAF=.;AD=.\tGT:XD\t0/1:1,2"]) + "\n")
    got = [tuple(r) for r in vcf.read(spark, str(path), {"AF": -1.0, "AD": -1, "DP": -1}, {"XD": -1, "GT": None}, split=True).orderBy("start_pos", "alt").collect()]
    rows = [(r[1], r[2], r[3], r[4], *r[6:9], r[9][0][0], r[9][0][1]) for r in got]
    assert rows == [
        (4, 6, "AC", "G", -1.0, [1, 3], 7, [0, 20], 5),
        (5, 6, "C", "", 0.5, [1, 2], 7, [0, 10], 0),
        (6, 6, "", "T", 2.0, [1, 4], 7, [0, 30], 4),
        (8, 9, "C", "T", -1.0, [-1, -1], -1, [1, 2], 1),
    ]
    with pytest.raises(Exception, match="multi-allelic"):
        vcf.read(spark, str(path)).collect()


def test_breakends(spark, tmp_path):
    path = tmp_path / "b.vcf"
    path.write_text("\n".join([*HEAD, *(f"1\t{10 * i}\t{i}\t{ref}\t{alt}\t.\t.\t." for i, (ref, alt) in enumerate((("A", "]Un_x:9]A"), ("A", "A[Un_x:9["), ("A", "]Un_x:9]CA"), ("A", "AC]Un_x:9]"), ("A", "[Un_x:9[T")), 1))]) + "\n")
    got = [(r["start_pos"], r["end_pos"], r["ref"], r["alt"]) for r in vcf.read(spark, str(path)).orderBy("start_pos").collect()]
    assert got == [(9, 9, "", "]Un_x:9]"), (20, 20, "", "[Un_x:9["), (29, 29, "", "]Un_x:9]C"), (40, 40, "", "C]Un_x:9]"), (49, 50, "A", "[Un_x:9[T")]
