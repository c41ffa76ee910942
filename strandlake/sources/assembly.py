"""Chromosome sizes, aliases, and ranked and selected transcripts of an assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.catalog import PRINCIPALITY, principality, unpivot_aliases


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom STRING, size LONG").csv(path, sep="\t")


def alias_rows(text: DataFrame, schemes: list[str]) -> DataFrame:
    """(canonical, scheme, alias) from tab-separated text(value), the first column canonical."""
    part = F.split("value", "\t")
    rows = text.where("value NOT LIKE '#%' AND value <> ''").select(*(F.get(part, F.lit(i)).alias(s) for i, s in enumerate(schemes)))
    return unpivot_aliases(rows)


def chrom_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The header line names the schemes."""
    text = spark.read.text(path)
    header = text.where("value LIKE '#%'").first()["value"]  # one line
    return alias_rows(text, header.lstrip("# ").split("\t"))


def appris(spark: SparkSession, path: str) -> DataFrame:
    """gene, gene_id, transcript_id, ccds, label and principality; unknown labels go."""
    rows = spark.read.schema("gene STRING, gene_id STRING, transcript_id STRING, ccds STRING, label STRING").csv(path, sep="\t")
    return rows.where(F.col("label").isin(*PRINCIPALITY)).withColumn("principality", principality(F.col("label")))


def mane(spark: SparkSession, path: str) -> DataFrame:
    """The summary table; more than one Select transcript of a gene is an error."""
    rows = spark.read.csv(path, sep="\t", header=True)
    one = rows.where("MANE_status = 'MANE Select'").groupBy("`#NCBI_GeneID`").agg(F.count(F.lit(1)).alias("_n"))
    both = rows.join(one, "#NCBI_GeneID", "left")
    return both.withColumn("MANE_status", F.when(F.coalesce(F.col("_n"), F.lit(0)) <= 1, F.col("MANE_status")).otherwise(F.raise_error(F.lit("two MANE Select transcripts")).cast("string"))).drop("_n")
