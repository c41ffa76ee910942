"""Genes, transcripts, exons and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import STRIDE, piece, scanned

#: Biotypes by priority, the highest last.
PRIORITY = ("non_coding", "protein_coding")
#: Bases between transcripts from which a gene's cluster is cut.
CLUSTER_GAP = 200_000


def id_prefixes(column: Column) -> Column:
    """An id and its prefixes up to each dot."""
    parts = F.split(column, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def lookup(elements: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(key) with the first row of elements(id, row_idx) whose id is the key or has it before a dot: an equi-join on all prefixes."""
    named = elements.select("row_idx", F.explode(id_prefixes(F.col("id"))).alias("key"))
    return named.groupBy("key").agg(F.min("row_idx").alias("row_idx")).join(keys, "key")


def find_by_id(elements: DataFrame, key: str) -> DataFrame:
    """All rows whose id is the key or begins with it and a dot."""
    return elements.where((F.col("id") == key) | F.col("id").startswith(key + "."))


def downstream(strand: str = "strand", start: str = "start_pos", end: str = "end_pos") -> Column:
    """Sort key from 5' to 3'."""
    return F.when(F.col(strand) == "+", F.col(start)).otherwise(-F.col(end))


def in_transcript(*more) -> Window:
    """Elements of a transcript from 5' to 3'; `more` breaks ties."""
    return Window.partitionBy("tran_idx").orderBy(downstream(), *more)


def numbered(elements: DataFrame, *more) -> DataFrame:
    """Add index (from 0), is_first and is_last of every element in its transcript."""
    w = in_transcript(*more)
    count = F.count(F.lit(1)).over(Window.partitionBy("tran_idx"))
    index = F.row_number().over(w).cast("long") - 1
    return elements.withColumns({"index": index, "is_first": index == 0, "is_last": index == count - 1})


def neighbours(elements: DataFrame, value: str, *more) -> DataFrame:
    """Add prev_<value> and next_<value>; null at a transcript's ends."""
    w = in_transcript(*more)
    return elements.withColumns({f"prev_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def introns(exons: DataFrame, *more) -> DataFrame:
    """The gaps between a transcript's neighbouring exons: tran_idx, chrom, strand, index, start_pos, end_pos."""
    w = in_transcript(*more)
    plus = F.col("strand") == "+"
    rows = exons.withColumns({
        "_s": F.when(plus, F.lag("end_pos").over(w)).otherwise(F.col("end_pos")),
        "_e": F.when(plus, F.col("start_pos")).otherwise(F.lag("start_pos").over(w)),
        "_i": F.row_number().over(w).cast("long") - 2,
    })
    rows = rows.where("_i >= 0")
    return rows.select("tran_idx", "chrom", "strand", F.col("_i").alias("index"), F.col("_s").alias("start_pos"), F.col("_e").alias("end_pos"))


def phases(cds: DataFrame, *more) -> DataFrame:
    """Add the phase: bases before the first whole codon, from the lengths of the coding pieces upstream."""
    before = F.coalesce(F.sum(F.col("end_pos") - F.col("start_pos")).over(in_transcript(*more).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cds.withColumn("phase", F.pmod(3 - before % 3, F.lit(3)).cast("long"))


def utrs(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """What is left of exons(tran_idx, chrom, strand, start_pos, end_pos) before and after the coding span: with side 5 or 3."""
    span = cds.groupBy("tran_idx").agg(F.min("start_pos").alias("_cs"), F.max("end_pos").alias("_ce"))
    both = exons.join(span, "tran_idx")
    plus = F.col("strand") == "+"
    piece = lambda side, s, e: F.struct(side.cast("long").alias("side"), s.alias("s"), e.alias("e"))
    low = piece(F.when(plus, 5).otherwise(3), F.col("start_pos"), F.least("end_pos", "_cs"))
    high = piece(F.when(plus, 3).otherwise(5), F.greatest("start_pos", "_ce"), F.col("end_pos"))
    cut = both.withColumn("_u", F.explode(F.filter(F.array(low, high), lambda p: p["s"] < p["e"])))
    return cut.select("tran_idx", "chrom", "strand", F.col("_u.side").alias("side"), F.col("_u.s").alias("start_pos"), F.col("_u.e").alias("end_pos"))


def clusters(transcripts: DataFrame, key: str, gap: int = CLUSTER_GAP) -> DataFrame:
    """Add the cluster (from 0) of each transcript of a gene id on a chromosome and strand: a new one where it starts `gap` or more after all before have ended."""
    w = Window.partitionBy(key, "chrom", "strand").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_pos") >= reach + gap, 1).otherwise(0)
    return transcripts.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gene_type(column: Column) -> Column:
    """Aggregate: the biotype of the highest priority, null if none has one."""
    rank = F.max(F.array_position(F.array(*(F.lit(p) for p in PRIORITY)), F.coalesce(column, F.lit(""))))
    return F.when(rank > 0, F.element_at(F.array(*(F.lit(p) for p in PRIORITY)), rank.cast("int")))


def merge_touching(intervals: DataFrame, *keys: str, gap: int = 0, stride: int | None = STRIDE) -> DataFrame:
    """Runs of intervals of a key that touch (or lie within `gap`) as one: keys, start_pos, end_pos, n.

    How far the intervals before reach, and where the island that an interval belongs to begins, are scans in pieces. Where
    keys are many and small, as transcripts are, stride None scans each as a whole.
    """
    order = ["start_pos", "end_pos"]
    rows = intervals.select(*keys, *order)
    w = Window.partitionBy(*keys).orderBy(*order)
    at = [piece(F.col("start_pos"), stride)] if stride else []
    reached = scanned(rows, keys, order, at, {"_reach": ("max", F.col("end_pos"))}) if stride else rows.withColumn("_reach", F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNull() | (F.col("start_pos") > F.col("_reach") + gap), F.col("start_pos"))
    marked = reached.withColumn("_new", new)
    island = scanned(marked, keys, order, at, {"_island": ("max", F.col("_new"))}, inclusive=True) if stride else marked.withColumn("_island", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n")).drop("_island")


def level_of(level: Column, source: Column) -> Column:
    """The evidence level: as given, else from the source's name, else null."""
    s = F.lower(source)
    known = F.when(s.isin("havana", "ensembl_havana", "refseq", "bestrefseq", "curated genomic", "curated"), 2).when(s.isin("ensembl", "gnomon"), 3)
    return F.coalesce(F.expr("null").cast("tinyint") if level is None else level.cast("tinyint"), known.cast("tinyint"))


def support_level(text: Column) -> Column:
    """The transcript support level: what stands before the first space, "NA" as 6."""
    head = F.substring_index(text, " ", 1)
    return F.when(F.upper(head) == "NA", 6).otherwise(head.try_cast("int")).cast("tinyint")
