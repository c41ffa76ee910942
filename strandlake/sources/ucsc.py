"""UCSC tables: a transcript a line, exons as lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.annotation import clusters, phases

GENE = "bin INT, name STRING, chrom STRING, strand STRING, txStart LONG, txEnd LONG, cdsStart LONG, cdsEnd LONG, exonCount INT, exonStarts STRING, exonEnds STRING, score INT, name2 STRING, cdsStartStat STRING, cdsEndStat STRING, exonFrames STRING"
LINK = "name STRING, product STRING, mrnaAcc STRING, protAcc STRING, geneName LONG, prodName LONG, locusLinkId STRING, omimId LONG"


def _numbers(column: str) -> Column:
    return F.transform(F.filter(F.split(column, ","), lambda x: x != ""), lambda x: x.cast("long"))


def exon_rows(genes: DataFrame) -> DataFrame:
    """A row for every exon of rows with exonStarts and exonEnds."""
    pair = F.explode(F.arrays_zip(_numbers("exonStarts").alias("s"), _numbers("exonEnds").alias("e")))
    return genes.withColumn("_x", pair).withColumns({"start_pos": F.col("_x.s"), "end_pos": F.col("_x.e")}).drop("_x", "exonStarts", "exonEnds")


def tables(spark: SparkSession, genes_path: str, links_path: str) -> dict[str, DataFrame]:
    """genes, transcripts, exons and cdss; a transcript whose accession isn't linked exactly once is an error."""
    g = spark.read.schema(GENE).csv(genes_path, sep="\t")
    link = spark.read.schema(LINK).csv(links_path, sep="\t").groupBy(F.col("mrnaAcc").alias("name")).agg(F.first("product").alias("product"), F.first("protAcc").alias("protein_id"), F.first("locusLinkId").alias("entrez"), F.count(F.lit(1)).alias("_n"))
    both = g.join(link, "name", "left")
    wrong = F.raise_error(F.concat(F.lit("not linked once: "), F.col("name")))
    both = both.withColumn("entrez", F.when(F.col("_n") == 1, F.col("entrez")).otherwise(wrong.cast("string"))).drop("_n")
    kind = F.when(F.col("name").startswith("NM_"), "protein_coding").when(F.col("name").startswith("NR_"), "non_coding")
    trans = both.withColumn("tran_idx", F.xxhash64("name", "chrom", "strand", "txStart", "exonStarts")).withColumn("type", kind)
    placed = clusters(trans.withColumnsRenamed({"txStart": "start_pos", "txEnd": "end_pos"}), "entrez")
    ex = exon_rows(placed.drop("start_pos", "end_pos"))
    cds = ex.withColumns({"start_pos": F.greatest("start_pos", "cdsStart"), "end_pos": F.least("end_pos", "cdsEnd")}).where("start_pos < end_pos")
    genes = placed.groupBy("entrez", "chrom", "strand", "cluster").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.first("name2").alias("name"), F.max("type").alias("type"))
    cols = ["tran_idx", "chrom", "strand", "start_pos", "end_pos"]
    return {"genes": genes, "transcripts": placed, "exons": ex.select(*cols), "cdss": phases(cds.select(*cols))}
