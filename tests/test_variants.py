"""Sequences with variants, against the documented anchor examples and brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake.operators import dna
from strandlake.operators import genomic as gn
from strandlake.operators import pieces as pc
from strandlake.operators import variants as va

LEFT, WINDOW, RIGHT = "GGTTA", "TATCTTAAAGCTGTGTCTGT", "AACCC"
BASE = 100
TEXT = LEFT + WINDOW + RIGHT
START, END, ANCHOR = BASE + 5, BASE + 25, BASE + 15


def fetch(a, b):
    return "".join(TEXT[i - BASE] if 0 <= i - BASE < len(TEXT) else "N" for i in range(a, b))


def applied(variants, anchor=None, offset=0, start=START, end=END):
    return va.apply_variants(start, end, variants, anchor, offset).letters(fetch)


@pytest.mark.parametrize(
    ("variant", "anchor", "offset", "wanted"),
    [
        ((START + 15, "TCT", "T"), None, 0, "TATCTTAAAGCTGTGTGT"),
        ((START + 15, "TCT", "T"), ANCHOR, 0, "TATCTTAAAGCTGTGTGTAA"),
        ((START + 4, "T", "TGGG"), ANCHOR, 0, "CTGGGTAAAGCTGTGTCTGT"),
        ((START + 6, "AAAGCT", "A"), ANCHOR, 0, "TTATATCTTAGTGTCTGTAA"),
        ((START + 9, "G", "GTTT"), ANCHOR, 0, "TATCTTAAAGTTTCTGTGTC"),
        ((START + 9, "G", "GTTT"), ANCHOR, 3, "CTTAAAGTTTCTGTGTCTGT"),
        ((START + 9, "G", "GTTT"), ANCHOR, 1, "ATCTTAAAGTTTCTGTGTCT"),
    ],
)
def test_documented(variant, anchor, offset, wanted):
    if variant[1] == "AAAGCT":
        assert fetch(START + 6, START + 12) == "AAAGCT"
    assert applied([variant], anchor, offset) == wanted


def test_no_variants_and_sides():
    for anchor in (None, START, END, ANCHOR, START - 2, END + 2):
        assert applied([], anchor) == WINDOW
    # an anchor outside: the window is cut from what is anchored there
    assert applied([(START, "TA", "")], START - 2) == (fetch(START + 2, END + 2))
    assert len(applied([(END - 3, "TGT", "")], END + 2)) == len(WINDOW)


def test_fixed_length_always():
    rng = random.Random(4)
    for _ in range(300):
        variants, at = [], START - 3
        while at < END + 3:
            at += rng.randint(1, 6)
            kind = rng.randint(0, 2)
            n = rng.randint(1, 2)
            ref = fetch(at, at + n)
            if "N" in ref:
                break
            variants.append((at, ref, "G" * n) if kind == 0 else (at, "", "A" * n) if kind == 1 else (at, ref, ""))
            at += n
        for anchor in (START, END, ANCHOR, START - 2, END + 2):
            assert len(applied(variants, anchor, 1)) == len(WINDOW)
        free = applied(variants)
        inside = [c for v in variants for e in pc.split_variant(*v) if (c := pc.clipped(e, START, END))]
        text, shift = WINDOW, 0
        for e in sorted(inside, key=lambda e: e.start):
            i = e.start - START + shift
            text = text[:i] + e.alt + text[i + len(e.ref) :]
            shift += len(e.alt) - len(e.ref)
        assert free == text


def test_alignment():
    pieces = va.apply_variants(START, END, [(START + 2, "", "GG"), (START + 5, "T", "")])
    assert [(p - START, i) for p, i in map(pieces.lift, range(len(pieces)))][:8] == [(0, -1), (1, -1), (2, 0), (2, 1), (2, -1), (3, -1), (4, -1), (6, -1)]


def test_slices_are_those_of_the_bases():
    rng = random.Random(8)
    for _ in range(100):
        pieces = pc.apply_variants(START, END, [(START + 2, "TC", "GGG"), (START + 5, "T", ""), (START + 9, "", "AC"), (START + 12, "G", "T")], rng.choice([None, START, ANCHOR, END]), 1)
        whole, places = pieces.letters(fetch), [pieces.lift(k) for k in range(len(pieces))]
        a, b = sorted(rng.choices(range(len(pieces) + 1), k=2))
        cut = pieces.sliced(a, b)
        assert cut.letters(fetch) == whole[a:b] and [cut.lift(k) for k in range(len(cut))] == places[a:b]


def test_a_megabase_with_a_thousand_variants():
    rng = random.Random(9)
    text = "".join(rng.choices("ACGT", k=1_000_000))
    take = lambda a, b: text[a:b]
    changes = [(i, *rng.choice([(text[i], "G"), ("", "GATTACA"), (text[i : i + 3], "")])) for i in range(500, 1_000_000, 1000)]
    began = time.perf_counter()
    for anchor in (None, 500_250):
        pieces = pc.apply_variants(100_000, 900_000, changes, anchor)
        assert len(pieces.letters(take)) == len(pieces) and (anchor is None or len(pieces) == 800_000)
        assert text[pieces.lift(123_456)[0]] in "ACGT"
    assert time.perf_counter() - began < 1
    assert len(pieces.start) < 4_000


def brute_reach(start, end, anchor, gone):
    """Positions that a window needs, one at a time: every deleted one draws in the next."""
    if anchor is None:
        return start, end
    low, high = min(start, anchor), max(end, anchor)
    for side in (1, -1):
        left = high - anchor if side > 0 else anchor - low
        at = anchor if side > 0 else anchor - 1
        while left > 0:
            left += at in gone
            left -= 1
            at += side
        low, high = (low, max(high, at)) if side > 0 else (min(low, at + 1), high)
    return low, high


def test_windows_grow_to_a_fixpoint(spark):
    rng = random.Random(10)
    text = "".join(rng.choices("ACGT", k=4000))
    variants, at = [], 50
    while at < 3900:
        n = rng.choice([1, 2, 5, 40])
        variants.append(("c", at, *rng.choice([(text[at : at + n], ""), ("", "GG"), (text[at : at + n], "T" * n), (text[at : at + n], text[at])])))
        at += n + rng.choice([1, 2, 9, 60])
    windows = []
    for i in range(120):
        s = rng.randrange(300, 3300)
        e = s + rng.choice([0, 1, 30, 200])
        windows.append((i, "c", rng.choice("+-"), s, e, rng.choice([None, s, e, (s + e) // 2, s - 7, e + 7]), 1))
    w = spark.createDataFrame(windows, "q_id long, chrom string, strand string, start_pos long, end_pos long, anchor long, anchor_offset long")
    v = spark.createDataFrame(variants, "chrom string, start_pos long, ref string, alt string")
    seq = spark.createDataFrame([("c", text)], "chrom string, seq string")
    gone = {p for _, s, r, a in variants for e in pc.split_variant(s, r, a) if not e.alt for p in range(e.start, e.end)}
    reach = {r["q_id"]: (r["low"], r["high"]) for r in va.grown(w, v).collect()}
    for i, _, _, s, e, anchor, _ in windows:
        low, high = brute_reach(s, e, anchor, gone)
        assert reach[i][0] <= low and high <= reach[i][1]
        # no farther than what is deleted there
        assert (low - reach[i][0]) + (reach[i][1] - high) <= sum(p in gone for p in range(*reach[i]))
    seen = {(r["q_id"], r["start_pos"], r["ref"], r["alt"]) for r in va.sequence_variations(w, v).collect()}
    assert seen == {(i, s, r, a) for i, (low, high) in reach.items() for _, s, r, a in variants if (s < high and low < s + len(r)) or (s == low and not r)}
    sizes = seq.select("chrom", F.length("seq").cast("long").alias("size"))
    got = {r["q_id"]: r["dna"] for r in va.variant_dna(w, v, dna.chunked(seq, 64), sizes, 64).collect()}
    far = [x[1:] for x in variants]
    for i, _, strand, s, e, anchor, offset in windows:
        wanted = pc.apply_variants(s, e, far, anchor, offset).letters(lambda a, b: text[a:b])
        assert got[i] == (wanted if strand == "+" else va.reverse_complement(wanted))


def brute_left(text, start, ref, alt):
    """By the sequences that they make: of all equal ways to write an indel, the leftmost."""
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        start, ref, alt = start + 1, ref[1:], alt[1:]
    if bool(ref) == bool(alt):
        return start, ref, alt
    made = text[:start] + alt + text[start + len(ref) :]
    for s in range(start + 1):
        if ref and text[:s] + text[s + len(ref) :] == made:
            return s, text[s : s + len(ref)], ""
        if alt and made[:s] + made[s + len(alt) :] == text and text[:s] == made[:s]:
            return s, "", made[s : s + len(alt)]


@pytest.mark.parametrize("context", [1, 64])
def test_left_alignment(spark, context):
    rng = random.Random(11)
    texts = {"c": "AC" * 90 + "GGG" + "".join(rng.choices("AC", k=60)) + "T" * 40 + "".join(rng.choices("ACGT", k=60)), "d": "A" * 30}
    variants = [("c", 178, "AC", ""), ("c", 180, "", "ACAC"), ("c", 10, "acaC", "AC"), ("c", 5, "C", "G"), ("c", 0, "", "AC"), ("d", 29, "A", ""), ("d", 30, "", "AA"), ("d", 30, "", "G"), ("x", 4, "A", ""), ("c", 4, None, "A")]
    for _ in range(80):
        s, n = rng.randrange(1, 330), rng.randrange(1, 5)
        variants.append(("c", s, texts["c"][s : s + n], rng.choice(["", texts["c"][s : s + n] * 2, "G", texts["c"][s]])))
    variants += variants[:3]
    v = spark.createDataFrame(variants, "chrom string, start_pos long, ref string, alt string").repartition(3)
    seq = spark.createDataFrame(list(texts.items()), "chrom string, seq string")
    sizes = seq.select("chrom", F.length("seq").cast("long").alias("size"))
    got = sorted((tuple(r) for r in gn.left_aligned(v, dna.chunked(seq, 16), sizes, 16, context).collect()), key=str)
    wanted = [(c, s, r, a) if c == "x" or r is None else (c, *brute_left(texts[c], s, r.upper(), a)) for c, s, r, a in variants]
    assert got == sorted(wanted, key=str)


def test_variants_that_dont_fit(spark):
    seq = spark.createDataFrame([("chr1", "ACGTacgtAC"), ("2", "GGGG")], "chrom string, seq string")
    sizes = seq.select("chrom", F.length("seq").cast("long").alias("size"))
    rows = [("chr1", 1, "CG", "T"), ("chr1", 1, "CG", "T"), ("1", 4, "A", ""), ("2", 0, "g", "t"), ("chr1", 0, "T", "G"), ("chr1", 9, "CC", "G"), ("chr1", -1, "A", ""), ("3", 0, "A", "C"), ("2", 1, "G", "<DEL>"), ("2", 4, "", "A"), (None, 1, "A", "C"), ("2", None, "A", "C")]
    v = spark.createDataFrame(rows, "chrom string, start_pos long, ref string, alt string")
    named = gn.on_known_contigs(v, sizes)
    assert named.count() == len(rows) and named.where("chrom = 'chr1'").count() == 6
    got = sorted((tuple(r) for r in gn.with_faults(named, dna.chunked(seq, 3), sizes, 3).select("chrom", "start_pos", "fault").collect()), key=str)
    assert got == sorted([("chr1", 1, None)] * 2 + [("chr1", 4, None), ("2", 0, None), ("chr1", 0, "reference"), ("chr1", 9, "outside"), ("chr1", -1, "outside"), ("3", 0, "contig"), ("2", 1, "alphabet"), ("2", 4, None), (None, 1, "contig"), ("2", None, "outside")], key=str)
    assert gn.checked(named, dna.chunked(seq, 3), sizes, 3, "exclude").count() == 5
    with pytest.raises(Exception, match="doesn't fit the genome:reference:chr1:1:T:G"):
        gn.checked(named.where("chrom = 'chr1' and start_pos = 0"), dna.chunked(seq, 3), sizes, 3).collect()


def test_overlapping_variants_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        applied([(START, "TATC", ""), (START + 2, "TC", "")])


def test_normalise_keeps_a_shared_end():
    assert pc.split_variant(10, "GTACGT", "TTT") == [pc.Edit(10, "GTA", "TTT"), pc.Edit(13, "CGT", "")]
    assert pc.split_variant(10, "AC", "AC") == []


def test_reverse_complement(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(dna.LETTERS) for _ in range(n)) for n in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dna.reverse_complement(dna.reverse_complement(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)


def test_outside_is_an_error_if_not_allowed(spark):
    s = spark.createDataFrame([("c", "ACGTACGT")], "chrom string, seq string")
    w = spark.createDataFrame([(1, "c", "+", 6, 10), (2, "c", "-", -2, 3), (3, "c", "+", 7, 8), (4, "c", "+", 0, 0)], "q_id long, chrom string, strand string, start_pos long, end_pos long")
    sizes = s.select("chrom", F.length("seq").cast("long").alias("size"))
    got = {r["q_id"]: r["dna"] for r in dna.extract(w, dna.chunked(s, 3), sizes, 3).collect()}
    assert got == {1: "GTNN", 2: va.reverse_complement("NNACG"), 3: "T", 4: ""}
    with pytest.raises(Exception, match="outside"):
        dna.extract(w, dna.chunked(s, 3), sizes, 3, outside=False).collect()


def test_equal_windows_stay_apart(spark):
    s = spark.createDataFrame([("c", "AAAACCCCGGGGTTTT"), ("d", "ACG")], "chrom string, seq string")
    rows = [(1, "c", "+", 2, 10)] * 2 + [(1, "c", "-", 2, 10), (1, "c", "+", -2, 20), (1, "c", "+", -2, 20)] + [(2, "d", "+", 1, 1)] * 3 + [(3, "d", "+", 5, 7)] * 2
    w = spark.createDataFrame(rows, "q_id long, chrom string, strand string, start_pos long, end_pos long").repartition(3)
    got = sorted((r["q_id"], r["dna"]) for r in dna.extract(w, dna.chunked(s, 4), s.select("chrom", F.length("seq").cast("long").alias("size")), 4).collect())
    assert got == sorted([(1, "AACCCCGG")] * 2 + [(1, "CCGGGGTT"), *[(1, "NNAAAACCCCGGGGTTTTNNNN")] * 2] + [(2, "")] * 3 + [(3, "NN")] * 2)


def test_parse(spark):
    texts = ["chr1:1,001:a:-", "chr2:5:.:gt", "chr1:x:A:C", "chr1:5:A", "chr1:7:AZ:C"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(va.parse(F.col("t")).alias("v")).collect()
    assert [r["v"] and tuple(r["v"]) for r in rows] == [("chr1", 1000, 1001, "A", ""), ("chr2", 4, 4, "", "GT"), None, None, None]


def test_spanning(spark):
    """Against lengths counted base by base for variants that lie within a stretch."""
    from strandlake.operators import variants as va

    schema = "p_id long, chrom string, x_start long, x_end long, x_anchor long, x_offset long, y_start long, y_end long, y_anchor long, y_offset long"
    pairs = [
        (1, "c", 100, 150, 100, 0, 200, 250, None, 0), (2, "c", 100, 150, None, 0, 200, 250, None, 0), (3, "c", 200, 250, None, 0, 100, 150, 100, 0), (4, "c", 300, 350, 340, 0, 200, 250, None, 0),
        (5, "c", 300, 350, 320, 0, 400, 450, 430, 0), (6, "c", 400, 450, 430, 0, 300, 350, 320, 0), (7, "c", 100, 150, 100, 4, 200, 250, None, 0), (8, "d", 1, 5, 3, 0, 8, 9, None, 0), (9, "c", 100, 150, 100, 99, 200, 250, None, 0),
    ]
    v = [("c", 100, "", "N" * 10), ("c", 310, "ACGT", ""), ("c", 410, "", "GG"), ("c", 500, "A", ""), ("c", 330, "CA", "CATT")]
    got = va.spanning(spark.createDataFrame(pairs, schema), spark.createDataFrame(v, "chrom string, start_pos long, ref string, alt string"))
    rows = {r[0]: tuple(r)[1:] for r in got.collect()}
    # 310 loses four bases and 332 gains two before 340; between 320 and 430 there are four more
    assert rows == {
        1: (100, 260, 100, 0), 2: (100, 250, None, None), 3: (100, 260, 100, 0), 4: (340 - (340 - 200 - 4 + 2), 350, 340, 0), 5: (300, 454, 320, 0), 6: (300, 454, 320, 0), 7: (100, 256, 100, 4), 8: (1, 9, 3, 0), 9: (100, 250, 100, 99),
    }
    bad = spark.createDataFrame([(1, "c", 100, 150, 160, 0, 200, 250, None, 0)], schema)
    with pytest.raises(Exception, match="outside"):
        va.spanning(bad, spark.createDataFrame(v, "chrom string, start_pos long, ref string, alt string")).collect()


def test_motifs_are_sought_up_to_the_window_s_end(spark):
    texts = {"gone": "CCCGATTTTT", "next": "CCCGTTTTTT", "none": "CCCGATTTTT"}
    # a deletion right after the window, and an insertion one base after it
    variants = [("gone", 5, "TT", ""), ("next", 5, "", "AA")]
    windows = [(c, c, "+", 0, 4 if c == "next" else 5, None, 0) for c in texts]
    schema = "q_id string, chrom string, strand string, start_pos long, end_pos long, anchor long, anchor_offset long"
    s = spark.createDataFrame(list(texts.items()), "chrom string, seq string")
    tables = spark.createDataFrame(windows, schema), spark.createDataFrame(variants, "chrom string, start_pos long, ref string, alt string"), dna.chunked(s), s.select("chrom", F.length("seq").cast("long").alias("size"))
    hits = lambda motif, position: sorted(tuple(r) for r in va.variant_motif(*tables, motif, position).collect())
    assert hits("GA", "5p") == [("gone", 3, 0), ("none", 3, 0)]
    assert hits("GA", "3p") == [("gone", 7, 0), ("none", 5, 0)]
    assert hits("GT", "5p") == []
