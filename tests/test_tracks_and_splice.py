"""Tracks, spliced coordinates and streams against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import reads as rd
from strandlake.operators import splice, tracks as tr
from strandlake.streaming import counts


def test_decode_with_resolution_and_strand(spark):
    blocks = spark.createDataFrame([("c", "+", 10, 16, [1.0, 2.0, 3.0]), ("c", "-", 4, 6, [9.0])], "chrom string, strand string, start_pos long, end_pos long, values array<double>")
    windows = spark.createDataFrame([(1, "c", "+", 8, 18), (2, "c", "-", 3, 12), (3, "c", "+", 5, 5)], "q_id long, q_chrom string, q_strand string, q_start long, q_end long")
    got: dict = {}
    for r in tr.decode(blocks, windows, tr.Track(default=-1.0, resolution=2, stranded=True)).orderBy("q_id", "i").collect():
        got.setdefault(r["q_id"], []).append(r["value"])
    assert got == {1: [-1, -1, 1, 1, 2, 2, 3, 3, -1, -1], 2: [-1] * 6 + [9, 9, -1]}


def test_quantise(spark):
    values = [0.0, 0.12, 0.125, 0.5, 0.99, 1.0, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(tr.quantised(F.col("v"), (0.0, 0.25, 1.0, float("nan")))).collect()]
    assert got[:6] == [0.0, 0.0, 0.25, 0.25, 1.0, 1.0] and np.isnan(got[6])
    for bad in (1.5, float("inf"), -0.1):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(bad,)], "v double").select(tr.quantised(F.col("v"), (0.0, 1.0))).collect()
    with pytest.raises(Exception, match="fit u2"):
        spark.createDataFrame([(4.0,)], "v double").select(tr.integral(F.col("v"), "u2")).collect()
    for wrong in ((0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, float("inf"), 2.0, 3.0)):
        with pytest.raises(ValueError):
            tr.check_dictionary(wrong, "f2")


def test_half_and_histogram(spark):
    v = [0.1, 1 / 3, 65504.0, -0.0, 0.0, float("nan"), 2049.0]
    rows = spark.createDataFrame([(x,) for x in v], "value double")
    got = {r["value"]: r["count"] for r in tr.histogram(rows).collect()}
    wanted: dict = {}
    for x in v:
        h = float(np.float16(x))
        if not np.isnan(h):
            wanted[h + 0.0] = wanted.get(h + 0.0, 0) + 1
    assert got == wanted


def test_blocks_round_trip(spark):
    values = {p: float(p % 5) for p in range(8180, 8220) if p % 11}
    rows = spark.createDataFrame([("c", "+", p, v) for p, v in values.items()], "chrom string, strand string, pos long, value double")
    blocks = tr.blocks_of(tr.sparsified(rows, tr.Track(), min_run=1))
    back = {r["start_pos"] + i: v for r in blocks.collect() for i, v in enumerate(r["values"])}
    assert back == {p: v for p, v in values.items() if v}


def lifted(parts, strand, pos):
    """Bases of the parts before a position."""
    return sum(max(0, min(e - s, pos - s if strand == "+" else e - pos)) for s, e in parts)


@pytest.mark.parametrize("strand", ["+", "-"])
def test_lower_and_lift(spark, strand):
    parts = [(10, 15), (20, 22), (30, 40)]
    total = sum(e - s for s, e in parts)
    ordered = parts if strand == "+" else parts[::-1]
    spots = [p for s, e in ordered for p in (range(s, e) if strand == "+" else range(e - 1, s - 1, -1))]
    d = splice.build(spark.createDataFrame([(1, "c", strand, s, e) for s, e in [*parts[1:], (10, 12), (12, 15)]], "dis_id long, chrom string, strand string, start_pos long, end_pos long"))
    segs = [(i * 100 + j, i, j) for i in range(total + 1) for j in range(i + 1, total + 1)]
    low = splice.lower(d, spark.createDataFrame([(k, 1, i, j) for k, i, j in segs], "seg_id long, dis_id long, seg_start long, seg_end long"))
    got: dict = {}
    for r in low.collect():
        got.setdefault(r["seg_id"], []).extend(range(r["start_pos"], r["end_pos"]))
    assert all(sorted(got[k]) == sorted(spots[i:j]) for k, i, j in segs)
    outside = splice.lower(d, spark.createDataFrame([(1, 1, -3, 2), (2, 1, total - 1, total + 4), (3, 1, 5, 5)], "seg_id long, dis_id long, seg_start long, seg_end long"))
    where = {r["seg_id"]: (r["start_pos"], r["end_pos"]) for r in outside.collect()}
    assert where[1] == ((7, 12) if strand == "+" else (38, 43)) and where[2] == ((39, 44) if strand == "+" else (6, 11))
    assert where[3][0] == where[3][1] == (20 if strand == "+" else 35)
    ivs = [(a * 100 + b, a, b) for a in range(5, 45, 3) for b in range(a + 1, 45, 4)]
    up = splice.lift(d, spark.createDataFrame([(k, 1, "c", a, b) for k, a, b in ivs], "iv_id long, dis_id long, chrom string, q_start long, q_end long"))
    seen = {r["iv_id"]: (r["seg_start"], r["seg_end"]) for r in up.collect()}
    wanted = {k: tuple(sorted((lifted(parts, strand, a), lifted(parts, strand, b)))) for k, a, b in ivs}
    assert seen == {k: v for k, v in wanted.items() if v[0] < v[1]}


def test_overlapping_parts_are_refused(spark):
    with pytest.raises(Exception, match="overlap"):
        splice.build(spark.createDataFrame([(1, "c", "+", 0, 5), (1, "c", "+", 4, 9)], "dis_id long, chrom string, strand string, start_pos long, end_pos long")).collect()


def test_stream(spark, tmp_path):
    rows = [("c", "+", 5, 9, i % 3, 2) for i in range(30)]
    schema = "chrom string, strand string, start_pos long, end_pos long, left long, right long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = counts.stream_distribution(stream).writeStream.outputMode("complete").format("memory").queryName("dist").start()
    query.processAllAvailable()
    query.stop()
    got = {r["shift"]: r["count"] for r in spark.table("dist").collect()}
    assert got == {0: 10, -1: 10, -2: 10, 2: 30}


SEGMENT = "seg_id long, dis_id long, seg_start long, seg_end long, same boolean"


def test_segments(spark):
    parts = splice.build(spark.createDataFrame([(1, "c", "-", 10, 15), (1, "c", "-", 20, 24), (2, "c", "+", 0, 6)], "dis_id long, chrom string, strand string, start_pos long, end_pos long"))
    segs = spark.createDataFrame([(1, 1, 0, 9, True), (2, 1, 2, 5, False), (3, 2, -2, 8, True), (4, 2, 9, 12, False), (5, 2, 3, 3, True)], SEGMENT)
    rows = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    ends = lambda df: rows(df.select("seg_id", "seg_start", "seg_end"))
    assert ends(splice.shifted(segs, 2)) == {1: (2, 11), 2: (0, 3), 3: (0, 10), 4: (7, 10), 5: (5, 5)}
    assert ends(splice.expanded(segs, 1, 2)) == {1: (-1, 11), 2: (0, 6), 3: (-3, 10), 4: (7, 13), 5: (2, 5)}
    with pytest.raises(Exception, match="less than nothing"):
        splice.expanded(segs, -1).collect()
    grown = splice.expand_coord(parts, 3, 1)
    assert sorted((r["dis_id"], r["ord"], r["start_pos"], r["end_pos"], r["cum"], r["total"]) for r in grown.collect()) == [(1, 0, 20, 27, 0, 13), (1, 1, 9, 15, 7, 13), (2, 0, -3, 7, 0, 10)]
    assert ends(splice.after_expand_coord(parts, segs, 3, 1)) == {1: (0, 13), 2: (5, 8), 3: (1, 11), 4: (12, 15), 5: (6, 6)}
    with pytest.raises(ValueError):
        splice.expand_coord(parts, -1)
    text = "ACGGTTANCACCTTGGAACCTGATCAAGTC"
    chunks = spark.createDataFrame([("c", i // 4, text[i : i + 4]) for i in range(0, len(text), 4)], "chrom string, chunk long, seq string")
    sizes = spark.createDataFrame([("c", len(text))], "chrom string, size long")
    rc = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    whole = rc(text[20:24]) + rc(text[10:15])
    assert rows(splice.spliced_dna(parts, segs, chunks, sizes, 4)) == {1: (whole,), 2: (rc(whole[2:5]),), 3: ("NN" + text[:6] + "NN",), 4: ("NNN",), 5: ("",)}
    with pytest.raises(Exception, match="outside"):
        splice.spliced_dna(parts, segs, chunks, sizes, 4, outside=False).collect()
    pair = segs.alias("a").join(segs.alias("b"), F.expr("a.seg_id = 1 and b.seg_id = 2"))
    with pytest.raises(Exception, match="different"):
        pair.select(splice.within("a", "b")).collect()
    assert rows(splice.properties(parts, segs))[2] == (9, 3, 5, 2, "+")
    with pytest.raises(ValueError):
        splice.from_transcripts({}, "introns")


def test_types_dimensions_and_strands(spark):
    with pytest.raises(ValueError, match="int8"):
        tr.as_dtype(F.lit(1.0), "u8", "int8")
    blocks = spark.createDataFrame([("c", "-", 4, 6, [1.0, 2.0, 3.0, 4.0]), ("c", "+", 5, 6, [7.0, 8.0])], "chrom string, strand string, start_pos long, end_pos long, values array<double>")
    windows = spark.createDataFrame([(1, "c", "-", 3, 6), (2, "c", "+", 5, 7)], "q_id long, q_chrom string, q_strand string, q_start long, q_end long")
    track = tr.Track(default=-1.0, stranded=True, dim=2)
    read = lambda how: [r["value"] for r in tr.decode(tr.placed(blocks, how, 2), windows, track).orderBy("q_id", "i", "dim").collect()]
    assert read("strand_aware") == [1, 2, 3, 4, -1, -1, 7, 8, -1, -1]
    assert read("strand_unaware") == [3, 4, 1, 2, -1, -1, 7, 8, -1, -1]
    with pytest.raises(Exception, match="single-stranded"):
        read("single_stranded")
    with pytest.raises(ValueError):
        tr.placed(blocks, "both")


def test_equal_reads_stay_apart(spark):
    reads = spark.createDataFrame([("r", 10, c) for c in ("5M3N4M", "5M3N4M", "2S1I4N3M2D1M", "3N2M", "4M", None)], "name string, pos long, cigar string").repartition(3)
    got = sorted((r["cigar"], r["segment"], r["start_pos"], r["end_pos"]) for r in rd.segments(reads).collect())
    assert got == sorted([("5M3N4M", 0, 10, 15), ("5M3N4M", 1, 18, 22)] * 2 + [("2S1I4N3M2D1M", 0, 10, 10), ("2S1I4N3M2D1M", 1, 14, 20), ("3N2M", 1, 13, 15), ("4M", 0, 10, 14)])
