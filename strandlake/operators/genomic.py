"""Variants against the genome: names of contigs, reference alleles, and indels moved to the left.

All three meet the chunked reference of dna.chunked() by joins; no task holds a chromosome.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dna import CHUNK, extract
from .variants import common_prefix

#: Bases before an indel that are fetched at first; those who match them all ask for twice as many.
CONTEXT = 64
_ALLELES = ["chrom", "start_pos", "ref", "alt"]


def on_known_contigs(variants: DataFrame, sizes: DataFrame) -> DataFrame:
    """variants(chrom, ...) with "chr" before names that the genome, sizes(chrom, size), has only so. Unknown names stay."""
    have = sizes.select(F.col("chrom").alias("_have")).distinct()
    prefixed = sizes.select(F.col("chrom").alias("_prefixed")).distinct()
    met = variants.join(have, F.col("chrom") == F.col("_have"), "left").join(prefixed, F.concat(F.lit("chr"), "chrom") == F.col("_prefixed"), "left")
    return met.withColumn("chrom", F.coalesce("_have", "_prefixed", "chrom")).select(*variants.columns)


def with_faults(variants: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK) -> DataFrame:
    """variants(chrom, start_pos, ref, alt, ...) with `fault`: alphabet, contig, outside or reference, the first that holds; null if none does.

    An allele has letters ACGTN, of either case; ref is what the genome has there, of either case. Nulls are faults of the
    alphabet, or of the contig or place. Repeated rows stay; each distinct place is fetched once.
    """
    letters = lambda c: F.coalesce(F.col(c).rlike("^[ACGTNacgtn]*$"), F.lit(False))
    known = sizes.select(F.col("chrom").alias("_chrom"), F.col("size").alias("_size"))
    met = variants.join(known, F.col("chrom") == F.col("_chrom"), "left")
    end = F.col("start_pos") + F.length("ref")
    inside = F.coalesce((F.col("start_pos") >= 0) & (end <= F.col("_size")), F.lit(False))
    early = F.when(~(letters("ref") & letters("alt")), "alphabet").when(F.col("_size").isNull(), "contig").when(~inside, "outside")
    first = met.withColumn("_early", early)
    places = first.where("_early is null and ref <> ''").select("chrom", "start_pos", F.length("ref").alias("_n")).distinct()
    windows = places.select("chrom", F.lit("+").alias("strand"), "start_pos", (F.col("start_pos") + F.col("_n")).alias("end_pos"))
    there = extract(windows, chunks, sizes, size).select(F.col("chrom").alias("_c"), F.col("start_pos").alias("_s"), (F.col("end_pos") - F.col("start_pos")).alias("_n"), "dna")
    seen = first.join(there, (F.col("chrom") == F.col("_c")) & (F.col("start_pos") == F.col("_s")) & (F.length("ref") == F.col("_n")), "left")
    return seen.select(*variants.columns, F.coalesce("_early", F.when((F.col("ref") != "") & (F.upper("dna") != F.upper("ref")), "reference")).alias("fault"))


def checked(variants: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK, policy: str = "error") -> DataFrame:
    """variants whose rows fit the genome: with a fault they are an error, or left out ("exclude")."""
    if policy not in ("error", "exclude"):
        raise ValueError(f"faults are an error or excluded: {policy}")
    found = with_faults(variants, chunks, sizes, size)
    if policy == "exclude":
        return found.where("fault is null").select(*variants.columns)
    text = F.concat_ws(":", F.lit("a variant doesn't fit the genome"), "fault", "chrom", (F.col("start_pos") + 1).cast("string"), "ref", "alt")
    return found.withColumn("ref", F.when(F.col("fault").isNull(), F.col("ref")).otherwise(F.raise_error(text).cast("string"))).select(*variants.columns)


def trimmed(start: Column, ref: Column, alt: Column) -> Column:
    """A struct (start_pos, ref, alt) without the alleles' common end, then without their common beginning."""
    tail = common_prefix(F.reverse(ref), F.reverse(alt))
    r, a = ref.substr(F.lit(1), F.length(ref) - tail), alt.substr(F.lit(1), F.length(alt) - tail)
    head = common_prefix(r, a)
    return F.struct((start + head).cast("long").alias("start_pos"), r.substr(head + 1, F.length(r)).alias("ref"), a.substr(head + 1, F.length(a)).alias("alt"))


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far each indel's text moves left through the bases before it: the common end of the bases and of the bases with the text."""
    for b in batches:
        moved = []
        for before, text in zip(b.column("dna").to_pylist(), b.column("_text").to_pylist(), strict=True):
            m = len(before)
            x, y = (np.frombuffer(t.encode(), np.uint8)[::-1] for t in (before, before + text))
            differs = np.flatnonzero(x != y[:m])
            moved.append(int(differs[0]) if len(differs) else m)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(moved, pa.int64())], [*b.schema.names, "_moved"])


def left_aligned(variants: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK, context: int = CONTEXT) -> DataFrame:
    """variants(chrom, start_pos, ref, alt, ...) with alleles trimmed and insertions and deletions as far left as the sequence allows.

    An indel within a repeat has many equal places; it moves left by a base as long as the base before it is its last one.
    Each distinct indel asks for the bases before it, `context` at first; those that match them all go on from there and ask for twice
    as many, so rounds grow with the logarithm of the longest repeat and only the ones that still move take part. Other columns
    and repeated rows stay. Case doesn't count, alleles come back in upper case; null alleles or places stay as they are.
    """
    from strandlake.sources.store import stored

    up = variants.select(*_ALLELES).where("chrom is not null and start_pos is not null and ref is not null and alt is not null").distinct()
    named = up.withColumn("_t", trimmed(F.col("start_pos"), F.upper("ref"), F.upper("alt")))
    texts = named.select(*(F.col(c).alias(f"_{c}") for c in _ALLELES), F.col("_t.start_pos").alias("_at"), F.col("_t.ref").alias("_r"), F.col("_t.alt").alias("_a"))
    every = stored(texts.withColumn("_text", F.concat("_r", "_a")))
    indel = (F.col("_r") == "") != (F.col("_a") == "")
    keys = [f"_{c}" for c in _ALLELES]
    done = [every.where(~indel).select(*keys, "_at", "_text", "_r", "_a")]
    frontier = every.where(indel & (F.col("_at") > 0)).join(sizes.select(F.col("chrom").alias("_chrom")).distinct(), "_chrom", "left_semi")
    done.append(every.where(indel).join(frontier.select(*keys), keys, "left_anti").select(*keys, "_at", "_text", "_r", "_a"))
    while True:
        windows = frontier.select(*keys, "_at", "_text", "_r", "_a", F.col("_chrom").alias("chrom"), F.lit("+").alias("strand"), F.greatest(F.col("_at") - context, F.lit(0)).alias("start_pos"), F.col("_at").alias("end_pos"))
        fetched = extract(windows, chunks, sizes, size).withColumn("dna", F.upper("dna"))
        rolled = fetched.mapInArrow(_roll, fetched.schema.simpleString()[7:-1].replace(":", " ") + ", _moved long")
        # the text turns as it moves: its last letters come to its front
        n = F.length("_text")
        turn = (F.col("_moved") % n).cast("int")
        turned = F.concat(F.col("_text").substr(n - turn + 1, n), F.col("_text").substr(F.lit(1), n - turn))
        out = stored(rolled.select(*keys, (F.col("_at") - F.col("_moved")).alias("_at"), turned.alias("_text"), "_r", "_a", ((F.col("_moved") == F.col("_at") - F.col("start_pos")) & (F.col("start_pos") > 0)).alias("_on")))
        done.append(out.where("not _on").drop("_on"))
        frontier = out.where("_on").drop("_on")
        if frontier.isEmpty():
            break
        context *= 2
    found = done[0]
    for f in done[1:]:
        found = found.unionByName(f)
    moved = found.withColumns({"_r": F.when((F.col("_r") != "") & (F.col("_a") == ""), F.col("_text")).otherwise(F.col("_r")), "_a": F.when((F.col("_a") != "") & (F.col("_r") == ""), F.col("_text")).otherwise(F.col("_a"))})
    same = F.lit(True)
    for c in _ALLELES:
        same = same & (F.col(c) == F.col(f"_{c}"))
    named = {"start_pos": "_at", "ref": "_r", "alt": "_a"}
    return variants.join(moved, same, "left").select(*(F.coalesce(named[c], c).alias(c) if c in named else c for c in variants.columns))
