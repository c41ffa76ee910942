"""SAM text as alignments, and as linked tables of alignments, matches, junctions and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import reads as rd
from strandlake.operators.dna import CHUNK
from strandlake.operators.rangejoin import allow_exclude
from strandlake.operators.reads import usable


def alignments(text: DataFrame, duplicates: bool = False) -> DataFrame:
    """Usable alignments of text(value): name, flag, chrom, pos (0-based), mapq, cigar, seq. Header lines go."""
    p = F.split("value", "\t")
    rows = text.where("value NOT LIKE '@%' AND value <> ''").select(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).cast("long").alias("flag"), F.get(p, F.lit(2)).alias("chrom"), (F.get(p, F.lit(3)).cast("long") - 1).alias("pos"), F.get(p, F.lit(4)).cast("int").alias("mapq"), F.get(p, F.lit(5)).alias("cigar"), F.get(p, F.lit(9)).alias("seq"))
    return rows.where(usable(F.col("flag"), duplicates))


def read(spark: SparkSession, path: str | list[str], duplicates: bool = False) -> DataFrame:
    """One or several files pooled."""
    return alignments(spark.read.text(path), duplicates)


def tables(alignments: DataFrame, chunks: DataFrame | None = None, sizes: DataFrame | None = None, library: str | None = None, introns: DataFrame | None = None, allow: DataFrame | None = None, exclude: DataFrame | None = None, size: int = CHUNK) -> dict[str, DataFrame]:
    """alignments(read_id, ...) as four tables that are linked by read_id and match.

    alignments: read_id, name, chrom, strand, start_pos, end_pos; matches, the runs between gaps: read_id,
    match, start_pos, end_pos; junctions: read_id, match (the one before the gap), start_pos, end_pos, left,
    right; and, if a reference is given, variants: read_id, match, start_pos, ref, alt. read_id must be
    the same in every evaluation, as a stored number or a key of the file is. A sequence of another length
    than its CIGAR is an error where variants are read.

    The strand is that of the library's format if given, else of the introns that a read's gaps
    overlap, else the read's own. Of allow and exclude (q_chrom, q_strand, q_start, q_end),
    an alignment has to overlap one of the former and none of the latter, on its strand.
    """
    a = alignments
    end = F.col("pos") + rd.consumed(rd.operations(F.col("cigar")), "MDN")
    strand = rd.library_strand(F.col("flag"), library) if library else rd.read_strand(F.col("flag"))
    a = a.withColumns({"strand": strand, "start_pos": F.col("pos"), "end_pos": end})
    if introns is not None and not library:
        gaps = rd.junctions(a.select("read_id", "chrom", "pos", "cigar"))
        said = rd.inferred_strand(gaps, introns).groupBy("read_id").agg(F.min("inferred").alias("_one"), F.max("inferred").alias("_two"))
        a = a.join(said, "read_id", "left").withColumn("strand", F.when(F.col("_one") == F.col("_two"), F.col("_one"))).drop("_one", "_two")
    if allow is not None or exclude is not None:
        a = allow_exclude(a, allow, exclude)
    reads = a.select("read_id", "chrom", "pos", "cigar", "seq")
    matches = rd.segments(reads.select("read_id", "chrom", "pos", "cigar")).select("read_id", F.col("segment").alias("match"), "chrom", "start_pos", "end_pos")
    gaps = rd.junctions(reads.select("read_id", "chrom", "pos", "cigar"), before="match").select("read_id", "match", "chrom", "start_pos", "end_pos", "left", "right")
    out = {"alignments": a.select("read_id", "name", "chrom", "strand", "start_pos", "end_pos"), "matches": matches, "junctions": gaps}
    if chunks is not None:
        out["variants"] = rd.read_variants(reads, chunks, sizes, size)
    return out
