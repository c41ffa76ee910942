"""Spliced reads: flags, CIGAR strings, junctions, distributions and pileups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.store import stored

from .dna import CHUNK, extract
from .rangejoin import find_overlapping
from .scan import piece, scanned

SECONDARY, UNMAPPED, DUPLICATE, REVERSE = 0x900, 0x4, 0x400, 0x10
OPERATIONS = "MIDNS"


def usable(flag: Column, duplicates: bool = False) -> Column:
    """Primary alignments of mapped reads; duplicates only if asked for."""
    drop = SECONDARY | UNMAPPED | (0 if duplicates else DUPLICATE)
    return flag.bitwiseAND(F.lit(drop)) == 0


def read_strand(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(F.lit(REVERSE)) != 0, "-").otherwise("+")


def library_strand(flag: Column, library: str) -> Column:
    """The transcript's strand from a paired library's format: ...SF or ...SR; ...U has none. Single reads are an error."""
    if library.endswith("U"):
        return F.lit(None).cast("string")
    paired, first = flag.bitwiseAND(F.lit(0x1)) != 0, flag.bitwiseAND(F.lit(0x40)) != 0
    forward = F.when(first, read_strand(flag)).otherwise(F.when(read_strand(flag) == "+", "-").otherwise("+"))
    sense = forward if library.endswith("SF") else F.when(forward == "+", "-").otherwise("+")
    return F.when(paired, sense).otherwise(F.raise_error(F.lit("a stranded library has paired reads")).cast("string"))


def operations(cigar: Column) -> Column:
    """An array of (op, n); an unknown operation, an empty one or any rest is an error. Null has none."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z=])"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), p.substr(F.lit(1), F.length(p) - 1).cast("long").alias("n")))
    fine = cigar.rlike(rf"^(0*[1-9]\d*[{OPERATIONS}])+\z")
    return F.when(fine, ops).when(cigar.isNotNull(), F.raise_error(F.concat(F.lit("bad CIGAR: "), cigar)).cast("array<struct<op:string,n:bigint>>"))


def consumed(ops: Column, kinds: str) -> Column:
    """Bases that operations of these kinds take: MIS of the read, MDN of the reference."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, o: a + o["n"])


def junctions(reads: DataFrame, cigar: str = "cigar", pos: str = "pos", before: str | None = None) -> DataFrame:
    """A row for every gap: the read's columns, start_pos, end_pos and the matched bases to the left and right of it in the whole read.

    `before` names a column for the number of gaps before it, which is that of the match that ends there.
    """
    name = before
    ops = reads.withColumn("_ops", operations(F.col(cigar)))
    gap = ops.select("*", F.posexplode("_ops").alias("_i", "_op")).where("_op.op = 'N'")
    before, after = F.slice("_ops", F.lit(1), F.col("_i")), F.slice("_ops", F.col("_i") + 2, F.size("_ops"))
    start = F.col(pos) + consumed(before, "MDN")
    return gap.withColumns({"start_pos": start, "end_pos": start + F.col("_op.n"), "left": consumed(before, "M"), "right": consumed(after, "M"), **({name: F.size(F.filter(before, lambda o: o["op"] == "N")).cast("long")} if name else {})}).drop("_ops", "_i", "_op")


def segments(reads: DataFrame, cigar: str = "cigar", pos: str = "pos") -> DataFrame:
    """The runs between a read's gaps: segment number, start_pos, end_pos. Cut within each row, so equal reads stay apart and nothing is shuffled."""
    ops = reads.withColumn("_ops", operations(F.col(cigar)))
    gaps = F.filter(F.transform("_ops", lambda o, i: F.when(o["op"] == "N", i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    cut = ops.withColumn("_n", F.coalesce(gaps, none)).withColumns({"_from": F.concat(F.array(F.lit(0)), F.transform("_n", lambda i: i + 1)), "_to": F.concat("_n", F.array(F.size("_ops")))})
    runs = F.transform("_from", lambda s, k: F.struct(k.cast("long").alias("segment"), s.alias("s"), (F.get(F.col("_to"), k) - s).alias("n")))
    each = cut.withColumn("_run", F.explode(F.filter(runs, lambda r: r["n"] > 0)))
    start = F.col(pos) + consumed(F.slice("_ops", F.lit(1), F.col("_run.s")), "MDN")
    found = each.withColumns({"segment": F.col("_run.segment"), "start_pos": start, "_length": consumed(F.slice("_ops", F.col("_run.s") + 1, F.col("_run.n")), "MD")})
    return found.select(*reads.columns, "segment", "start_pos", (F.col("start_pos") + F.col("_length")).alias("end_pos"))


def overhang(value: Column, clamp: bool = True, most: int = 255) -> Column:
    """An overhang as it is stored: clamped, or an error beyond the limit."""
    return F.least(value, F.lit(most)) if clamp else F.when(value <= most, value).otherwise(F.raise_error(F.lit("overhang too large")).cast("long"))


JUNCTION = ("chrom", "start_pos", "end_pos")


def collect_junctions(gaps: DataFrame, min_reads: int = 1, min_overhang: int = 0) -> DataFrame:
    """Reads by junction, for junctions with enough: chrom, strand, start_pos, end_pos, num_reads, least and greatest overhangs.

    Counts rather than lists: a junction's reads stay rows of `gaps`, so a deep junction is no single value.
    """
    kept = gaps.where((F.col("left") >= min_overhang) & (F.col("right") >= min_overhang))
    return kept.groupBy("chrom", "strand", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("num_reads"), F.max("left").alias("max_left"), F.max("right").alias("max_right")).where(F.col("num_reads") >= min_reads)


def distribution(gaps: DataFrame, min_overhang: int = 0) -> DataFrame:
    """Counts by junction, strand and shift: each read counts once at -left and once at +right. An additive aggregate: it runs on streams alike."""
    kept = gaps.where((F.col("left") >= min_overhang) & (F.col("right") >= min_overhang))
    shifts = kept.withColumn("shift", F.explode(F.array(-F.col("left"), F.col("right"))))
    return shifts.groupBy(*JUNCTION, "strand", "shift").agg(F.count(F.lit(1)).alias("count"))


def reads_per_junction(counts: DataFrame) -> DataFrame:
    """num_reads of a distribution: half the sum of its counts."""
    return counts.groupBy(*JUNCTION).agg((F.sum("count") / 2).cast("long").alias("num_reads"), F.count(F.lit(1)).alias("num_counts"))


def depth(matched: DataFrame) -> DataFrame:
    """How many of matched(chrom, start_pos, end_pos) lie over each position, as runs of equal depth: chrom, start_pos, end_pos, depth.

    A sweep: each row adds one at its start and takes one at its end, which are summed by
    position before they are shuffled on and summed along the chromosome. Positions under none
    have no run; empty rows and rows with a null count for nothing.
    """
    rows = matched.where("start_pos < end_pos").select("chrom", F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("n")), F.struct(F.col("end_pos").alias("pos"), F.lit(-1).alias("n")))).alias("e"))
    events = stored(rows.groupBy("chrom", "e.pos").agg(F.sum("e.n").alias("n")).where("n <> 0"))
    over = scanned(events, ["chrom"], ["pos"], [piece(F.col("pos"))], {"depth": ("sum", F.col("n"))}, inclusive=True)
    # the next event is the least after it: the same scan from the other end
    ends = scanned(over.withColumn("back", -F.col("pos")), ["chrom"], ["back"], [piece(F.col("back"))], {"next": ("max", F.col("back"))})
    return ends.where("depth > 0").select("chrom", F.col("pos").alias("start_pos"), (-F.col("next")).alias("end_pos"), "depth")


def pileup_of_reads(reads: DataFrame, chunks: DataFrame, variants: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """A, C, G, T and DEL at every position that a matched base of reads(chrom, pos, cigar) lies over.

    The reference's chunks(chrom, chunk, seq) give the bases of the runs of equal depth, so rows grow
    with the positions, not with the reads over them. variants(chrom, start_pos, ref, alt): what linked
    reads have in place of the reference, as read_variants gives it; of substitutions and deletions
    each base takes one from the reference's count and gives one to the other, what is put in counts for nothing.
    N isn't counted (its row has zeros), and positions outside the chunks have no row.
    """
    runs = depth(segments(reads.select("chrom", "pos", "cigar")).select("chrom", "start_pos", "end_pos"))
    met = runs.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_pos") / size), F.floor((F.col("end_pos") - 1) / size)))).join(chunks.select("chrom", "chunk", "seq"), ["chrom", "chunk"])
    low = F.greatest(F.col("start_pos") - F.col("chunk") * size, F.lit(0))
    high = F.least(F.col("end_pos") - F.col("chunk") * size, F.length("seq"))
    part = met.where(high > low).select("chrom", "depth", (F.col("chunk") * size + low).alias("at"), F.split(F.substring("seq", (low + 1).cast("int"), (high - low).cast("int")), "").alias("bases"))
    counts = part.select("chrom", "at", "depth", F.posexplode("bases").alias("k", "base")).select("chrom", (F.col("at") + F.col("k")).alias("pos"), F.upper("base").alias("base"), F.col("depth").alias("n"))
    if variants is not None:
        whole = F.length("ref") == F.length("alt")
        other = lambda k: F.when(whole, F.upper(F.substring(F.col("alt"), k + 1, 1))).otherwise("DEL")
        changes = lambda k: F.array(F.struct(k.alias("k"), F.upper(F.substring(F.col("ref"), k + 1, 1)).alias("base"), F.lit(-1).alias("n")), F.struct(k.alias("k"), other(k).alias("base"), F.lit(1).alias("n")))
        each = variants.where(whole | (F.col("alt") == "")).where("ref <> ''").select("chrom", "start_pos", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.length("ref") - 1), changes))).alias("e"))
        each = each.select("chrom", (F.col("start_pos") + F.col("e.k")).alias("pos"), F.col("e.base").alias("base"), F.col("e.n").alias("n"))
        counts = counts.unionByName(each.groupBy("chrom", "pos", "base").agg(F.sum("n").alias("n")))
    return _counted(counts)


def _counted(rows: DataFrame) -> DataFrame:
    """rows(chrom, pos, base, n) as A, C, G, T and DEL by position."""
    count = lambda b: F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).cast("long").alias(b)
    return rows.groupBy("chrom", "pos").agg(*(count(b) for b in ("A", "C", "G", "T", "DEL")))


def pileup(bases: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """A, C, G, T and DEL by position.

    bases(chrom, pos, base): the reference base under every matched base of a read.
    variants(chrom, pos, ref, alt): single-base substitutions and deletions of reads, one base
    each, alt "" for a deletion; each takes one from the reference's count. N isn't counted.
    """
    plus = bases.select("chrom", "pos", F.upper("base").alias("base"), F.lit(1).alias("n"))
    if variants is not None:
        ref = variants.select("chrom", "pos", F.upper("ref").alias("base"), F.lit(-1).alias("n"))
        alt = variants.select("chrom", "pos", F.when(F.col("alt") == "", "DEL").otherwise(F.upper("alt")).alias("base"), F.lit(1).alias("n"))
        plus = plus.unionByName(ref).unionByName(alt)
    return _counted(plus)


def with_whole_sequence(reads: DataFrame) -> DataFrame:
    """reads(cigar, seq): a sequence is as long as the operations that take bases of the read, or "*"; else an error."""
    fine = F.col("cigar").isNull() | (F.col("seq") == "*") | (F.length("seq") == consumed(operations(F.col("cigar")), "MIS"))
    wrong = F.raise_error(F.concat(F.lit("a sequence of another length than its CIGAR: "), F.col("cigar"))).cast("string")
    return reads.withColumn("seq", F.when(fine, F.col("seq")).otherwise(wrong))


#: Bases of a reference, and rows of its table of sizes, up to which they may be broadcast.
BROADCAST_BASES, BROADCAST_SIZES = 16 << 20, 500_000
_OPERATION = "array<struct<op:string,n:bigint,pos:bigint,at:bigint,match:bigint>>"


def read_variants(reads: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK) -> DataFrame:
    """What reads(read_id, chrom, pos, cigar, seq) have in place of the reference: read_id, match, chrom, start_pos, ref, alt.

    A substitution is a base under M that differs; an insertion has an empty ref, a deletion an
    empty alt; match is the number of gaps before it. Equal ones of a read are one. Reads without a sequence ("*"), or with
    "=" in it, have none, nor do those on a chromosome that has no size. An operation meets one row
    of the reference, a chunk and the one after it, for which matches are cut to pieces of a chunk's length; only longer deletions
    are put together from several. So no read is shuffled where the reference is small enough to be
    broadcast, and no row is a single base until bases differ. chunks and sizes are those of dna.extract().
    """
    taken = lambda o, kinds: F.when(o["op"].isin(*kinds), o["n"]).otherwise(F.lit(0).cast("long"))
    placed = lambda a, o: F.array_append(a["ops"], F.struct(o["op"].alias("op"), o["n"].alias("n"), a["pos"].alias("pos"), a["at"].alias("at"), a["match"].alias("match")))
    step = lambda a, o: F.struct(
        (a["pos"] + taken(o, "MDN")).alias("pos"), (a["at"] + taken(o, "MIS")).alias("at"), (a["match"] + F.when(o["op"] == "N", 1).otherwise(0).cast("long")).alias("match"),
        F.when(o["op"].isin("M", "I", "D"), placed(a, o)).otherwise(a["ops"]).alias("ops"),
    )
    zero, none = F.lit(0).cast("long"), F.array().cast(_OPERATION)
    wrong = F.raise_error(F.concat(F.lit("a sequence of another length than its CIGAR: "), F.col("cigar"))).cast(_OPERATION)
    end = lambda a: F.when(a["at"] == F.length("seq"), F.when(F.contains("seq", F.lit("=")), none).otherwise(a["ops"])).otherwise(wrong)
    ops = F.aggregate(operations(F.col("cigar")), F.struct(F.col("pos").cast("long").alias("pos"), zero.alias("at"), zero.alias("match"), none.alias("ops")), step, end)
    alt = lambda o: F.when(o["op"] == "D", "").otherwise(F.upper(F.col("seq").substr((o["at"] + 1).cast("int"), o["n"].cast("int"))))
    window = lambda o: F.struct(o["op"].alias("op"), o["match"].alias("match"), o["pos"].alias("start_pos"), F.when(o["op"] == "I", zero).otherwise(o["n"]).alias("n"), alt(o).alias("alt"))
    known = lambda rows: rows.where("seq IS NULL OR seq <> '*'").select("read_id", "chrom", F.explode(F.array_distinct(F.transform(ops, window))).alias("o")).select("read_id", "chrom", "o.*")

    few = F.broadcast if sizes.count() <= BROADCAST_SIZES else (lambda rows: rows)
    each = known(reads).join(few(sizes.select("chrom", F.col("size").alias("_size"))), "chrom").where(f"op <> 'D' OR n <= {size}")
    # matches longer than a chunk as pieces of one
    k = F.explode(F.when(F.col("op") == "M", F.sequence(zero, F.floor((F.col("n") - 1) / size))).otherwise(F.array(zero)))
    cut = each.withColumn("_k", k).withColumn("_from", F.col("_k") * size)
    part = F.when(F.col("op") == "M", F.substring("alt", (F.col("_from") + 1).cast("int"), F.lit(size))).otherwise(F.col("alt"))
    cut = cut.select("read_id", "match", "chrom", "op", (F.col("start_pos") + F.col("_from")).alias("start_pos"), F.least(F.col("n") - F.col("_from"), F.lit(size)).alias("n"), part.alias("alt"), "_size")
    after = chunks.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.col("seq").alias("_after"))
    two = chunks.join(after, ["chrom", "chunk"], "left").select("chrom", "chunk", F.concat("seq", F.coalesce("_after", F.lit(""))).alias("_two"))
    two = F.broadcast(two) if chunks.count() * size <= BROADCAST_BASES else two
    first = F.greatest(F.col("start_pos"), zero)
    met = cut.withColumn("chunk", F.floor(first / size)).join(two, ["chrom", "chunk"], "left")
    inner = F.coalesce(F.substring("_two", (first - F.col("chunk") * size + 1).cast("int"), F.greatest(F.least(F.col("start_pos") + F.col("n"), F.col("_size")) - first, zero).cast("int")), F.lit(""))
    # N beyond the chromosome
    before = F.repeat(F.lit("N"), F.least(F.greatest(-F.col("start_pos"), zero), F.col("n")).cast("int"))
    got = met.withColumn("ref", F.when(F.col("n") == 0, "").otherwise(F.upper(F.rpad(F.concat(before, inner), F.col("n").cast("int"), "N"))))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.length("alt"), F.lit(1))), lambda i: F.col("ref").substr(i, F.lit(1)) != F.col("alt").substr(i, F.lit(1)))
    out = got.where("op <> 'M' OR ref <> alt").withColumn("_k", F.explode(F.when(F.col("op") == "M", differs).otherwise(F.array(F.lit(1)))))
    base = lambda c: F.when(F.col("op") == "M", F.col(c).substr(F.col("_k"), F.lit(1))).otherwise(F.col(c)).alias(c)
    short = out.select("read_id", "match", "chrom", (F.col("start_pos") + F.col("_k") - 1).alias("start_pos"), base("ref"), base("alt"))

    # deletions longer than a chunk; most reads go by the digits of their CIGAR
    long = known(reads.where(F.col("cigar").rlike(rf"\d{{{len(str(size))},}}D"))).where(f"op = 'D' AND n > {size}")
    windows = long.select("read_id", "match", "chrom", F.lit("+").alias("strand"), "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"))
    return short.unionByName(extract(windows, chunks, sizes, size).select("read_id", "match", "chrom", "start_pos", F.upper("dna").alias("ref"), F.lit("").alias("alt")))


def inferred_strand(gaps: DataFrame, introns: DataFrame, strict: bool = False) -> DataFrame:
    """gaps(chrom, start_pos, end_pos, ...) with `inferred`: the one strand on which introns(chrom, strand, start_pos, end_pos) overlap it.

    Null where introns of no strand or of both do, or an error if `strict`.
    """
    both = gaps.select(F.col("chrom").alias("q_chrom"), F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end")).distinct()
    both = both.withColumn("q_strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    hits = find_overlapping(introns.select("chrom", "strand", "start_pos", "end_pos"), both)
    seen = hits.groupBy(F.col("q_chrom").alias("chrom"), F.col("q_start").alias("start_pos"), F.col("q_end").alias("end_pos")).agg(F.bool_or(F.col("strand") == "+").alias("_p"), F.bool_or(F.col("strand") == "-").alias("_m"))
    none = F.raise_error(F.lit("a gap with introns of no strand or of both")).cast("string") if strict else F.lit(None).cast("string")
    strand = F.when(F.col("_p") & ~F.col("_m"), "+").when(F.col("_m") & ~F.col("_p"), "-").otherwise(none)
    return gaps.join(seen, ["chrom", "start_pos", "end_pos"], "left").withColumn("inferred", strand).drop("_p", "_m")
