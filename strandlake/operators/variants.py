"""Variants: parsing, normalising, VCF codes, and sequences with variants applied."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .dna import CHUNK, COMPLEMENTS, LETTERS, extract
from .pieces import Fetch, Pieces, apply_variants, split_variant
from .rangejoin import WIDTH, find_5p_aligned, find_overlapping, length_classes

#: Genotype and structural-variant codes.
GENOTYPES = {"hom_ref": 0, "het": 1, "hom_alt": 2, "unknown": 3, "het_0|1": 4, "het_1|0": 5}
SV_TYPES = ("NA", "DEL", "INS", "DUP", "INV", "CNV", "BND")


def ancestral_policy(variants: DataFrame, alt: str = "alt", policy: str = "error") -> DataFrame:
    """What becomes of rows whose ALT is ".": error, warn (they stay) or exclude."""
    if policy == "exclude":
        return variants.where(F.col(alt) != ".")
    if policy == "error":
        return variants.withColumn(alt, F.when(F.col(alt) == ".", F.raise_error(F.lit("an ancestral allele")).cast("string")).otherwise(F.col(alt)))
    return variants


def parse(text: Column) -> Column:
    """A struct (chrom, start_pos, end_pos, ref, alt) from "chrom:pos1:ref:alt"; null if it isn't one.

    Positions may have commas; "-" and "." stand for an empty allele; alleles are upper-cased.
    """
    part = F.split(text, ":")
    allele = lambda i: F.when(F.get(part, F.lit(i)).isin("-", "."), "").otherwise(F.upper(F.get(part, F.lit(i))))
    start = F.regexp_replace(F.get(part, F.lit(1)), ",", "").try_cast("long") - 1
    fine = (F.size(part) == 4) & start.isNotNull() & allele(2).rlike("^[ACGTN]*$") & allele(3).rlike("^[ACGTN]*$")
    return F.when(fine, F.struct(F.get(part, F.lit(0)).alias("chrom"), start.alias("start_pos"), (start + F.length(allele(2))).alias("end_pos"), allele(2).alias("ref"), allele(3).alias("alt")))


def variant_text(chrom: Column, start: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, (start + 1).cast("string"), ref, alt)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once for each row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Letters that two strings have in common from their beginnings."""
    n = F.least(F.length(a), F.length(b))
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))), True)
    return F.when(n == 0, 0).otherwise(_once(first, lambda at: F.when(at == 0, n).otherwise(at - 1))).cast("int")


def normalised(start: Column, ref: Column, alt: Column) -> Column:
    """An array of structs (start_pos, ref, alt): the common prefix goes, and what is left is a
    substitution, an insertion or a deletion, or a substitution and one of these. A shared end stays."""
    piece = lambda s, r, a: F.struct(s.cast("long").alias("start_pos"), r.alias("ref"), a.alias("alt"))

    def cut(pad: Column) -> Column:
        n = F.least(F.length(ref), F.length(alt)) - pad
        rest = lambda x: x.substr(pad + n + 1, F.length(x))
        both = F.array(piece(start + pad, ref.substr(pad + 1, n), alt.substr(pad + 1, n)), piece(start + pad + n, rest(ref), rest(alt)))
        return F.filter(both, lambda v: (v["ref"] != "") | (v["alt"] != ""))

    return _once(common_prefix(ref, alt), cut)


def genotype(gt: Column, het_default: bool = True) -> Column:
    """The code of a haploid or diploid GT text."""
    a, sep, b = gt.substr(1, 1), gt.substr(2, 1), gt.substr(3, 1)
    ref, alt, none = (lambda x: x == "0"), (lambda x: x.between("1", "9")), (lambda x: x == ".")
    half = F.lit(GENOTYPES["het"] if het_default else GENOTYPES["unknown"])
    return (
        F.when((F.length(gt) == 1) & ref(a), GENOTYPES["hom_ref"]).when((F.length(gt) == 1) & alt(a), GENOTYPES["hom_alt"])
        .when(F.length(gt) != 3, GENOTYPES["unknown"])
        .when(ref(a) & ref(b), GENOTYPES["hom_ref"]).when(alt(a) & alt(b), GENOTYPES["hom_alt"])
        .when((sep == "|") & ref(a) & alt(b), GENOTYPES["het_0|1"]).when((sep == "|") & alt(a) & ref(b), GENOTYPES["het_1|0"])
        .when((sep == "/") & (ref(a) & alt(b) | alt(a) & ref(b)), GENOTYPES["het"])
        .when((sep == "/") & (none(a) & alt(b) | alt(a) & none(b)), half).otherwise(GENOTYPES["unknown"]).cast("tinyint")
    )


def sv_type(name: Column) -> Column:
    """The code of an SVTYPE; null for an unknown one, so that no value moves to another row."""
    at = F.array_position(F.array(*(F.lit(t) for t in SV_TYPES)), F.coalesce(name, F.lit("NA")))
    return F.when(at > 0, at - 1).cast("tinyint")


def symbolic(pos: Column, ref: Column, end: Column, sv_len: Column) -> Column:
    """Struct (start_pos, end_pos) of a symbolic ALT: the padding base goes, the end is END or from SVLEN."""
    start = pos - 1 + F.length(ref)
    return F.struct(start.alias("start_pos"), F.coalesce(end, start + F.abs(sv_len), start).alias("end_pos"))


# -- applying variants to a window -------------------------------------------------------------


def reverse_complement(seq: str) -> str:
    return seq.translate(str.maketrans(LETTERS, COMPLEMENTS))[::-1]


def grown(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """q_id, chrom, low, high: how far windows(q_id, chrom, start_pos, end_pos, anchor) have to reach for variants(chrom, start_pos, ref, alt).

    A window reaches to its anchor. On either side of an anchor it grows by what is deleted there, then by what is deleted in the
    stretch that was added, until nothing is. Every round is a range join of the last stretches with the
    deletions, of those windows only that still grow. A window without an anchor keeps its ends. q_id is a key.
    """
    from strandlake.sources.store import stored

    each = variants.select("chrom", F.explode(normalised(F.col("start_pos"), F.col("ref"), F.col("alt"))).alias("v")).where("v.alt = ''")
    gone = stored(each.select("chrom", F.lit("+").alias("strand"), F.col("v.start_pos").alias("start_pos"), (F.col("v.start_pos") + F.length("v.ref")).alias("end_pos")))
    classes = length_classes(gone)
    low, high = F.least("start_pos", F.coalesce("anchor", "start_pos")), F.greatest("end_pos", F.coalesce("anchor", "end_pos"))
    whole = stored(windows.select("q_id", "chrom", low.cast("long").alias("low"), high.cast("long").alias("high"), F.col("anchor").cast("long").alias("anchor")))
    side = lambda left, a, b: F.struct(F.lit(left).alias("left"), a.alias("q_start"), b.alias("q_end"))
    sides = F.inline(F.array(side(True, F.col("low"), F.col("anchor")), side(False, F.col("anchor"), F.col("high"))))
    frontier = whole.where("anchor is not null").select("q_id", F.col("chrom").alias("q_chrom"), F.lit("+").alias("q_strand"), sides).where("q_start < q_end")
    found = []
    while asked := length_classes(frontier, start="q_start", end="q_end"):
        hits = find_overlapping(gone, frontier, classes=(classes, asked))
        n = F.least("end_pos", "q_end") - F.greatest("start_pos", "q_start")
        more = stored(hits.groupBy("q_id", "left", "q_chrom", "q_strand", "q_start", "q_end").agg(F.sum(n).alias("n")).where("n > 0"))
        found.append(more.select("q_id", "left", "n"))
        a = F.when(F.col("left"), F.col("q_start") - F.col("n")).otherwise(F.col("q_end"))
        b = F.when(F.col("left"), F.col("q_start")).otherwise(F.col("q_end") + F.col("n"))
        frontier = more.select("q_id", "q_chrom", "q_strand", "left", a.alias("q_start"), b.alias("q_end"))
    if not found:
        return whole.drop("anchor")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    sums = every.groupBy("q_id").agg(F.sum(F.when(F.col("left"), F.col("n"))).alias("_l"), F.sum(F.when(~F.col("left"), F.col("n"))).alias("_h"))
    zero = F.lit(0)
    return whole.join(sums, "q_id", "left").select("q_id", "chrom", (F.col("low") - F.coalesce("_l", zero)).alias("low"), (F.col("high") + F.coalesce("_h", zero)).alias("high"))


def sequence_variations(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """Every variant that the sequence of a window depends on: q_id and the columns of variants(chrom, start_pos, ref, alt, ...), each pair once.

    Those that overlap the window, grown if it is anchored, and insertions at its lower end. windows(q_id, chrom, start_pos, end_pos, anchor).
    """
    reach = grown(windows, variants).select("q_id", F.col("chrom").alias("q_chrom"), F.lit("+").alias("q_strand"), F.col("low").alias("q_start"), F.col("high").alias("q_end"))
    v = variants.withColumns({"strand": F.lit("+"), "end_pos": F.col("start_pos") + F.length("ref")})
    shown = ("q_id", *variants.columns)
    # an insertion at the lower end isn't within the window, so no pair is in both
    return find_overlapping(v, reach).select(*shown).unionByName(find_5p_aligned(v.where("ref = ''"), reach).select(*shown))


def _with_variants(windows: DataFrame, variants: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int, more: int = 0) -> DataFrame:
    """Windows with the reference as far as they reach, and the variants there, in order."""
    from strandlake.sources.store import stored

    # what is read again and again is made once
    windows = stored(windows)
    known = windows if not more else windows.withColumn("end_pos", F.col("end_pos") + more)
    variants = stored(variants.select("chrom", F.col("start_pos").cast("long").alias("start_pos"), "ref", "alt"))
    reach = stored(grown(known, variants))
    v = variants.withColumns({"strand": F.lit("+"), "end_pos": F.col("start_pos") + F.greatest(F.length("ref"), F.lit(1))})
    q = reach.select("q_id", F.col("chrom").alias("q_chrom"), F.lit("+").alias("q_strand"), (F.col("low") - 1).alias("q_start"), (F.col("high") + 1).alias("q_end"))
    hits = find_overlapping(v, q).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "ref", "alt"))).alias("_variants"))
    context = extract(reach.select("q_id", "chrom", F.lit("+").alias("strand"), F.col("low").alias("start_pos"), F.col("high").alias("end_pos")), chunks, sizes, size)
    numbers = {c: F.col(c).cast("long") for c in ("anchor", "anchor_offset")}
    return windows.withColumns(numbers).join(context.select("q_id", F.col("start_pos").alias("_low"), F.col("dna").alias("_dna")), "q_id").join(hits, "q_id", "left")


def _changed(batch: pa.RecordBatch, more: int = 0) -> Iterator[tuple[Pieces, Fetch]]:
    """The runs of each row of _with_variants(), of windows that hold `more` bases after their ends, and what fetches their reference."""
    of = batch.column
    held = of("_variants")
    value = [held.values.field(i).to_pylist() for i in range(3)]
    ends = held.offsets.to_pylist()
    rows = zip(of("start_pos").to_pylist(), of("end_pos").to_pylist(), of("anchor").to_pylist(), of("anchor_offset").to_pylist(), of("_low").to_pylist(), of("_dna").to_pylist(), strict=True)
    for i, (start, end, anchor, offset, low, text) in enumerate(rows):
        there = [(s, r, a) for s, r, a in zip(*(v[ends[i] : ends[i + 1]] for v in value), strict=True)] if held[i].is_valid else []
        if more and anchor is None:  # bases that are deleted at the end give none
            for e in sorted((e for v in there for e in split_variant(*v)), key=lambda e: e.start):
                end = e.end if e.start <= end < e.end and not e.alt else end
        yield apply_variants(start, end + more, there, anchor, offset or 0), lambda a, b, low=low, text=text: text[a - low : b - low]


def spanning(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """The span of two anchored intervals after variants: p_id, start_pos, end_pos, anchor, anchor_offset.

    pairs(p_id, chrom, x_start, x_end, x_anchor, x_offset, y_start, y_end, y_anchor, y_offset): without
    an anchor the plain span; else the side of the lower anchor stays in place and the other one is
    moved by what the variants between the anchors add or take. An anchor outside its interval is
    an error. variants(chrom, start_pos, ref, alt); those that touch a stretch change its length in full.
    """
    c, side = F.col, lambda s: F.struct(*(F.col(f"{s}_{n}").alias(n) for n in ("start", "end", "anchor")), F.coalesce(f"{s}_offset", F.lit(0)).alias("offset"))
    later = c("x_anchor").isNull() | (c("x_anchor") > c("y_anchor")) | (c("x_anchor") == c("y_anchor")) & (F.coalesce("x_offset", F.lit(0)) > F.coalesce("y_offset", F.lit(0)))
    p = pairs.select("p_id", "chrom", F.when(later, side("y")).otherwise(side("x")).alias("x"), F.when(later, side("x")).otherwise(side("y")).alias("y"))
    low, high = F.least("x.start", "y.start"), F.greatest("x.end", "y.end")
    windows = p.select("p_id", c("chrom").alias("q_chrom"), F.lit("+").alias("q_strand"), (low - 1).alias("q_start"), (high + 1).alias("q_end")).where(p["x.anchor"].isNotNull())
    v = variants.select("chrom", F.explode(normalised(c("start_pos"), c("ref"), c("alt"))).alias("_v")).select("chrom", F.lit("+").alias("strand"), "_v.*")
    v = v.withColumns({"end_pos": c("start_pos") + F.greatest(F.length("ref"), F.lit(1)), "_stop": c("start_pos") + F.length("ref"), "_more": F.length("alt") - F.length("ref"), "_ins": F.when(c("ref") == "", F.length("alt"))})
    # pieces are no longer than their variants: where these are all of the least class, the pieces needn't be measured
    classes = length_classes(variants.select("start_pos", (c("start_pos") + F.length("ref")).alias("end_pos")))
    classes = classes if classes == [(WIDTH - 1).bit_length()] else length_classes(v)
    near = find_overlapping(v, windows, classes=(classes, length_classes(windows, start="q_start", end="q_end"))).groupBy("p_id").agg(F.collect_list(F.struct("start_pos", "_stop", "_more", "_ins")).alias("_vs"))
    rows = p.join(near, "p_id", "left")
    vs = F.coalesce("_vs", F.array().cast(dict(near.dtypes)["_vs"]))

    def grown(a: Column, b: Column) -> Column:
        within = F.filter(vs, lambda e: (e["start_pos"] < b) & (e["_stop"] >= a))
        return b - a + F.aggregate(within, F.lit(0).cast("long"), lambda n, e: n + e["_more"])

    def place(anchor: Column, offset: Column) -> Column:
        """How far into an insertion at the anchor an offset goes."""
        return F.least(offset, F.coalesce(F.array_max(F.transform(F.filter(vs, lambda e: e["start_pos"] == anchor), lambda e: e["_ins"])), F.lit(0)))

    x, y = (lambda n: c(f"x.{n}")), (lambda n: c(f"y.{n}"))
    bad = F.raise_error(F.lit("an anchor lies outside its interval")).cast("long")
    fine = lambda s: F.when((s("anchor") < s("start")) | (s("anchor") > s("end")), bad).otherwise(s("anchor"))
    a, off = fine(x), place(x("anchor"), x("offset"))
    move = a + grown(a, fine(y)) - off + place(y("anchor"), y("offset")) - y("anchor")
    one_start = F.when(y("start") < a, F.least(x("start"), a - grown(y("start"), a) - off)).otherwise(x("start"))
    one_end = F.when(y("end") > a, F.greatest(x("end"), a + grown(a, y("end")) - off)).otherwise(x("end"))
    start = F.when(x("anchor").isNull(), F.least("x.start", "y.start")).when(y("anchor").isNull(), one_start).otherwise(F.least(x("start"), move + y("start")))
    end = F.when(x("anchor").isNull(), F.greatest("x.end", "y.end")).when(y("anchor").isNull(), one_end).otherwise(F.greatest(x("end"), move + y("end")))
    return rows.select("p_id", start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"), x("anchor").alias("anchor"), F.when(x("anchor").isNotNull(), x("offset")).alias("anchor_offset"))


def variant_dna(windows: DataFrame, variants: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK) -> DataFrame:
    """windows(q_id, chrom, strand, start_pos, end_pos, anchor, anchor_offset) with `dna` after variants(chrom, start_pos, ref, alt).

    q_id is a key. chunks, sizes and size are those of dna.extract(); a window fetches what its deletions draw in and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strands = b.column("strand").to_pylist()
            dna = [t if s == "+" else reverse_complement(t) for s, t in zip(strands, (p.letters(fetch) for p, fetch in _changed(b)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(dna, pa.string())], [*names, "dna"])

    rows = _with_variants(windows, variants, chunks, sizes, size)
    names = windows.columns
    return rows.mapInArrow(run, StructType([*(f for f in rows.schema.fields if f.name in names), StructField("dna", StringType())])).select(*names, "dna")


def variant_motif(windows: DataFrame, variants: DataFrame, chunks: DataFrame, sizes: DataFrame, motif: str, match_position: str | int = "5p", overlapping: bool = False, size: int = CHUNK) -> DataFrame:
    """Hits of a motif in plus- or minus-strand windows after variants, in reference coordinates: q_id, hit, anchor_offset.

    A hit within an insertion has the position of the base after it, and anchor_offset tells its place
    among the inserted bases; elsewhere that is 0. Arguments as for variant_dna().
    """
    k = len(motif)
    at = {"5p": 0, "3p": k}.get(match_position, match_position)
    if not isinstance(at, int) or not 0 <= at <= k:
        raise ValueError(f"a match position lies within the motif: {match_position}")
    ahead = motif.upper()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hits, places = [], [], []
            # the window is searched as it is; one base more gives a coordinate to a match position after the last one
            for i, (strand, (own, fetch), (pieces, _)) in enumerate(zip(b.column("strand").to_pylist(), _changed(b), _changed(b, 1), strict=True)):
                seq = own.letters(fetch).upper()
                sought, shift = (ahead, at) if strand == "+" else (reverse_complement(ahead), k - at)
                j = seq.find(sought)
                while j >= 0:
                    position, inserted = pieces.lift(j + shift)
                    rows.append(i)
                    hits.append(position)
                    places.append(max(inserted, 0))
                    j = seq.find(sought, j + (1 if overlapping else k))
            yield pa.RecordBatch.from_arrays([b.column("q_id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.int64()), pa.array(places, pa.int64())], ["q_id", "hit", "anchor_offset"])

    return _with_variants(windows, variants, chunks, sizes, size, 1).mapInArrow(run, f"q_id {dict(windows.dtypes)['q_id']}, hit long, anchor_offset long")


def variant_alignment(windows: DataFrame, variants: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every base of plus-strand windows after variants: q_id, i, base, ref_pos (from the window's start) and ins (place within an insertion, else -1)."""
    schema = f"q_id {dict(windows.dtypes)['q_id']}, i long, base string, ref_pos long, ins long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (start, (pieces, fetch)) in enumerate(zip(b.column("start_pos").to_pylist(), _changed(b), strict=True)):
                places = [pieces.lift(j) for j in range(len(pieces))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("q_id").take(pa.array([i] * len(places), pa.int64())), pa.array(range(len(places)), pa.int64()), pa.array(list(pieces.letters(fetch)), pa.string()), pa.array([p - start for p, _ in places], pa.int64()), pa.array([k for _, k in places], pa.int64())],
                    ["q_id", "i", "base", "ref_pos", "ins"],
                )

    return _with_variants(windows, variants, chunks, sizes, size).mapInArrow(run, schema)
