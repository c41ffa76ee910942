"""Spliced coordinates: disjoint interval sequences and lifting to and from them.

A sequence is parts(dis_id, chrom, strand, start_pos, end_pos), exons for instance. Part
offsets are a running sum from 5' to 3'; lifting is a join on dis_id and arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dna as sequences
from .annotation import downstream, merge_touching
from .scan import dealt

REGIONS = ("exons", "cds", "utr5", "utr3")


def from_transcripts(regions: dict[str, DataFrame], region: str = "exons") -> DataFrame:
    """Sequences of a region of transcripts, dis_id being tran_idx; regions holds tables(tran_idx, chrom, strand, start_pos, end_pos)."""
    if region not in REGIONS:
        raise ValueError(f"unknown region: {region}")
    return build(regions[region].select(F.col("tran_idx").alias("dis_id"), "chrom", "strand", "start_pos", "end_pos"))


def build(intervals: DataFrame, together: bool = False) -> DataFrame:
    """Touching parts merged and numbered from 5', with cum (offset of the part) and total. Overlaps are an error.

    The parts of a sequence are dealt to one task, in as many tasks as the intervals need; not if they already lie `together` by dis_id.
    """
    intervals = intervals if together else dealt(intervals, "dis_id")
    w = Window.partitionBy("dis_id", "chrom", "strand").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bad = F.raise_error(F.lit("parts of a sequence overlap")).cast("long")
    fine = intervals.withColumn("start_pos", F.when(reach.isNull() | (F.col("start_pos") >= reach), F.col("start_pos")).otherwise(bad))
    return offsets(merge_touching(fine, "dis_id", "chrom", "strand", stride=None).drop("n"))


def offsets(parts: DataFrame) -> DataFrame:
    w = Window.partitionBy("dis_id").orderBy(downstream())
    length = F.col("end_pos") - F.col("start_pos")
    cum = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return parts.withColumns({"ord": F.row_number().over(w).cast("long") - 1, "cum": cum, "total": F.sum(length).over(Window.partitionBy("dis_id"))})


def lower(parts: DataFrame, segments: DataFrame) -> DataFrame:
    """segments(seg_id, dis_id, seg_start, seg_end) as genomic pieces: seg_id, chrom, strand, ord, start_pos, end_pos.

    Beyond the sequence the first or the last part is extended. An empty segment gives one
    empty piece, at the greater genomic position if it lies between two parts.
    """
    rows = _met(parts.join(segments, "dis_id"))
    point = rows.where("seg_start = seg_end AND seg_start >= _low AND seg_start <= _high")
    shown = ["seg_id", "chrom", "strand"]
    empty = point.groupBy(*shown).agg(F.min("ord").alias("ord"), F.max(_spot("seg_start")).alias("start_pos")).withColumn("end_pos", F.col("start_pos"))
    return _whole(rows).unionByName(empty)


def _spot(x: str) -> Column:
    return F.when(F.col("strand") == "+", F.col("start_pos") + F.col(x) - F.col("cum")).otherwise(F.col("end_pos") - (F.col(x) - F.col("cum")))


def _met(rows: DataFrame) -> DataFrame:
    """Parts joined with segments: from where to where they may meet (_low, _high), and do (_a, _b)."""
    length = F.col("end_pos") - F.col("start_pos")
    first, last = F.col("cum") == 0, F.col("cum") + length == F.col("total")
    low = F.when(first, F.lit(-(1 << 60))).otherwise(F.col("cum"))
    high = F.when(last, F.lit(1 << 60)).otherwise(F.col("cum") + length)
    return rows.withColumns({"_a": F.greatest(F.col("seg_start"), low), "_b": F.least(F.col("seg_end"), high), "_low": low, "_high": high})


def _whole(met: DataFrame) -> DataFrame:
    """The pieces of segments that aren't empty."""
    plus = F.col("strand") == "+"
    s, e = F.when(plus, _spot("_a")).otherwise(_spot("_b")), F.when(plus, _spot("_b")).otherwise(_spot("_a"))
    return met.where("seg_start < seg_end AND _a < _b").select("seg_id", "chrom", "strand", "ord", s.alias("start_pos"), e.alias("end_pos"))


def lift(parts: DataFrame, intervals: DataFrame) -> DataFrame:
    """intervals(iv_id, dis_id, chrom, q_start, q_end) in spliced coordinates: iv_id, seg_start, seg_end; none if nothing is left within the sequence.

    A position in a gap takes the boundary before it; the sequence's ends clip.
    """
    plus = F.col("strand") == "+"
    length = F.col("end_pos") - F.col("start_pos")
    inside = lambda x: F.greatest(F.lit(0), F.least(length, F.when(plus, F.col(x) - F.col("start_pos")).otherwise(F.col("end_pos") - F.col(x))))
    # bases of the parts before a position add up to its offset
    rows = parts.join(intervals, ["dis_id", "chrom"])
    sums = rows.groupBy("iv_id", "strand").agg(F.sum(inside("q_start")).alias("x"), F.sum(inside("q_end")).alias("y"))
    out = sums.select("iv_id", F.when(plus, F.col("x")).otherwise(F.col("y")).alias("seg_start"), F.when(plus, F.col("y")).otherwise(F.col("x")).alias("seg_end"))
    return out.where("seg_start < seg_end")


def genomic_span(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dis_id", "chrom", "strand").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))


# -- segments: seg_id, dis_id, seg_start, seg_end and same (on the strand of the parts) ----------


def properties(parts: DataFrame, segments: DataFrame) -> DataFrame:
    """seg_id, coordinate_length, length, end5_index, end3_index and strand."""
    rows = segments.join(parts.where("ord = 0").select("dis_id", F.col("total").alias("coordinate_length"), F.col("strand").alias("_strand")), "dis_id")
    five, three = F.when(F.col("same"), F.col("seg_start")).otherwise(F.col("seg_end")), F.when(F.col("same"), F.col("seg_end")).otherwise(F.col("seg_start"))
    return rows.select("seg_id", "coordinate_length", (F.col("seg_end") - F.col("seg_start")).alias("length"), five.alias("end5_index"), three.alias("end3_index"), strand_of(F.col("_strand"), F.col("same")).alias("strand"))


def shifted(segments: DataFrame, amount: int) -> DataFrame:
    """Moved downstream on the segment's own strand; a segment may leave the sequence."""
    by = F.when(F.col("same"), F.lit(amount)).otherwise(F.lit(-amount))
    return segments.withColumns({"seg_start": F.col("seg_start") + by, "seg_end": F.col("seg_end") + by})


def expanded(segments: DataFrame, upstream: int, dnstream: int | None = None) -> DataFrame:
    """Grown towards both ends on the segment's own strand, or shrunk; an error if its ends would pass each other."""
    dnstream = upstream if dnstream is None else dnstream
    s = F.col("seg_start") - F.when(F.col("same"), F.lit(upstream)).otherwise(F.lit(dnstream))
    e = F.col("seg_end") + F.when(F.col("same"), F.lit(dnstream)).otherwise(F.lit(upstream))
    bad = F.raise_error(F.lit("a segment shrinks to less than nothing")).cast("long")
    return segments.withColumns({"seg_start": F.when(s <= e, s).otherwise(bad), "seg_end": e})


def expand_coord(parts: DataFrame, upstream: int, dnstream: int | None = None) -> DataFrame:
    """The outer edges of the first and the last part grow."""
    dnstream = upstream if dnstream is None else dnstream
    if upstream < 0 or dnstream < 0:
        raise ValueError("coordinates grow only")
    plus, first = F.col("strand") == "+", F.col("ord") == 0
    last = F.col("cum") + F.col("end_pos") - F.col("start_pos") == F.col("total")
    s = F.col("start_pos") - F.when(plus & first, upstream).when(~plus & last, dnstream).otherwise(0)
    e = F.col("end_pos") + F.when(plus & last, dnstream).when(~plus & first, upstream).otherwise(0)
    return parts.withColumns({
        "start_pos": s, "end_pos": e, "cum": F.when(first, F.col("cum")).otherwise(F.col("cum") + upstream), "total": F.col("total") + upstream + dnstream,
    })


def after_expand_coord(parts: DataFrame, segments: DataFrame, upstream: int, dnstream: int | None = None) -> DataFrame:
    """Segments in grown coordinates: one that spanned everything still does, others keep their bases. parts as before growing."""
    dnstream = upstream if dnstream is None else dnstream
    rows = segments.join(parts.where("ord = 0").select("dis_id", "total"), "dis_id")
    whole = (F.col("seg_start") == 0) & (F.col("seg_end") == F.col("total"))
    s = F.col("seg_start") + F.when(whole, 0).otherwise(upstream)
    e = F.col("seg_end") + F.when(whole, upstream + dnstream).otherwise(upstream)
    return rows.withColumns({"seg_start": s, "seg_end": e}).select(*segments.columns)


def _comparable(a: str, b: str, answer: Column) -> Column:
    """The answer, or an error if two segments aren't of one sequence and strand."""
    fits = (F.col(f"{a}.dis_id") == F.col(f"{b}.dis_id")) & (F.col(f"{a}.same") == F.col(f"{b}.same"))
    return F.when(fits, answer).otherwise(F.raise_error(F.lit("segments of different sequences or strands")).cast("boolean"))


def _before(a: str, b: str) -> Column:
    """a ends where b starts or sooner; an empty segment isn't before itself."""
    s, e, t, u = F.col(f"{a}.seg_start"), F.col(f"{a}.seg_end"), F.col(f"{b}.seg_start"), F.col(f"{b}.seg_end")
    return ~((s == e) & (t == u) & (s == t)) & (e <= t)


def upstream_of(a: str, b: str) -> Column:
    """a and b name structs or aliased sides that hold segments; so below."""
    return _comparable(a, b, F.when(F.col(f"{a}.same"), _before(a, b)).otherwise(_before(b, a)))


def dnstream_of(a: str, b: str) -> Column:
    return upstream_of(b, a)


def within(a: str, b: str) -> Column:
    return _comparable(a, b, (F.col(f"{a}.seg_start") >= F.col(f"{b}.seg_start")) & (F.col(f"{a}.seg_end") <= F.col(f"{b}.seg_end")))


def intersect(a: str, b: str) -> Column:
    """A struct (seg_start, seg_end), null if nothing is shared."""
    s, e = F.greatest(f"{a}.seg_start", f"{b}.seg_start"), F.least(f"{a}.seg_end", f"{b}.seg_end")
    return F.when(_comparable(a, b, s < e), F.struct(s.alias("seg_start"), e.alias("seg_end")))


def strand_of(strand: Column, same: Column) -> Column:
    """The segment's strand from that of its parts."""
    return F.when(same, strand).when(strand == "+", "-").otherwise("+")


def turned(strand: Column, same: Column, to: str) -> Column:
    """`same` after a segment is put on the positive, negative, same or opposite strand, or is flipped."""
    to_same = {"positive": strand == "+", "negative": strand == "-", "same": F.lit(True), "opposite": F.lit(False), "flip": ~same}
    return to_same[to]


def spliced_dna(parts: DataFrame, segments: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = sequences.CHUNK, outside: bool = True) -> DataFrame:
    """Segments' bases from 5' to 3' on their own strand: seg_id, dna. Beyond the sequence N, or an error if `outside` isn't allowed.

    chunks and sizes as for dna.extract().
    """
    low, high = F.greatest(F.col("seg_start"), F.lit(0)), F.least(F.col("seg_end"), F.col("total"))
    if not outside:
        bad = F.raise_error(F.lit("a segment lies outside its sequence")).cast("long")
        low = F.when((F.col("seg_start") == F.col("seg_end")) | (F.col("seg_start") >= 0) & (F.col("seg_end") <= F.col("total")), low).otherwise(bad)
    # a part knows its sequence's total, and what is left of a segment within it isn't empty: one join of parts and segments will do
    kept = parts.join(segments, "dis_id").withColumns({"seg_start": low, "seg_end": high}).where("seg_start < seg_end")
    windows = _whole(_met(kept)).select(F.struct("seg_id", "ord").alias("q_id"), "chrom", "strand", "start_pos", "end_pos")
    pieces = sequences.extract(windows, chunks, sizes, size).groupBy(F.col("q_id.seg_id").alias("seg_id")).agg(F.array_sort(F.collect_list(F.struct("q_id.ord", "dna"))).alias("_parts"))
    inner = F.coalesce(F.array_join(F.transform("_parts", lambda p: p["dna"]), ""), F.lit(""))
    n = lambda x: F.repeat(F.lit("N"), F.greatest(F.lit(0), x).cast("int"))
    # a segment wholly beyond one end is N for its whole length
    length = F.col("seg_end") - F.col("seg_start")
    before, behind = F.least(-F.col("seg_start"), length), F.least(F.col("seg_end") - F.col("total"), length)
    whole = F.concat(n(before), inner, n(behind))
    s = segments.join(parts.where("ord = 0").select("dis_id", "total"), "dis_id")
    return s.join(pieces, "seg_id", "left").select("seg_id", F.when(F.col("same"), whole).otherwise(sequences.reverse_complement(whole)).alias("dna"))
