"""A catalog of assemblies, their chromosomes, aliases and ranked transcripts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: APPRIS labels by rank.
PRINCIPALITY = ("PRINCIPAL:1", "PRINCIPAL:2", "PRINCIPAL:3", "PRINCIPAL:4", "PRINCIPAL:5", "ALTERNATIVE:1", "ALTERNATIVE:2")
#: Table formats: raised when a written schema changes.
VERSIONS = {"annotation": 1, "variants": 1, "track": 1, "alignments": 1, "junctions": 1, "distribution": 1}


def canonical(named: DataFrame, aliases: DataFrame, column: str = "chrom") -> DataFrame:
    """Add the canonical name of a chromosome from aliases(alias, canonical); an unknown one is null."""
    return named.join(aliases.select(F.col("alias").alias(column), "canonical"), column, "left")


def unpivot_aliases(table: DataFrame) -> DataFrame:
    """A wide alias table (first column canonical) as (canonical, scheme, alias); blanks go."""
    first, *rest = table.columns
    long = table.unpivot([first], rest, "scheme", "alias")
    own = table.select(first, F.lit(first).alias("scheme"), F.col(first).alias("alias"))
    return own.unionByName(long).withColumnRenamed(first, "canonical").where(F.coalesce(F.col("alias"), F.lit("")) != "")


def principality(label: Column) -> Column:
    """0 to 6 from an APPRIS label; null for an unknown one."""
    at = F.array_position(F.array(*(F.lit(p) for p in PRINCIPALITY)), label)
    return F.when(at > 0, at - 1)


def ranked(transcripts: DataFrame, gene: str, label: str, tie: str) -> DataFrame:
    """Add the place (from 1) within the gene by principality, then by `tie`; unlabelled ones last."""
    w = Window.partitionBy(gene).orderBy(principality(F.col(label)).asc_nulls_last(), tie)
    return transcripts.withColumn("place", F.row_number().over(w).cast("long"))


def register(annotations: DataFrame, root: str) -> None:
    """Add annotations(annotation, assembly) to the catalog under root, a configuration each."""
    lines = annotations.select("annotation", F.concat(F.lit("refg="), "assembly").alias("value"))
    lines.write.partitionBy("annotation").mode("append").text(f"{root}/configs")


def listing(spark, root: str) -> DataFrame:
    """The annotations of the catalog by assembly: assembly, annotation. Configurations without an assembly aren't listed."""
    lines = spark.read.schema("value string, annotation string").text(f"{root}/configs")
    return lines.where(F.col("value").startswith("refg=")).select(F.substring("value", len("refg=") + 1, 1 << 30).alias("assembly"), "annotation").where("assembly <> ''").distinct()


@dataclass
class Genome:
    """DataFrames of one assembly, opened when they are first asked for."""

    spark: object
    root: str
    config: str
    _open: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.root}/{self.config}/{name}")
        return self._open[name]

    @property
    def chromosomes(self) -> DataFrame:
        return self.table("chrom_sizes")

    def chromosome_size(self, chrom: str) -> int:
        row = self.chromosomes.where(F.col("chrom") == chrom).first()
        if row is None:
            raise ValueError(f"unknown chromosome: {chrom}")
        return row["size"]

    def chrom_aliases(self, scheme: str | None = None) -> DataFrame:
        aliases = self.table("chrom_aliases")
        return aliases if scheme is None else aliases.where(F.col("scheme") == scheme)

    def appris_transcripts(self) -> DataFrame:
        return ranked(self.table("appris"), "gene_id", "label", "transcript_id")

    def mane_transcripts(self, status: str = "MANE Select") -> DataFrame:
        mane = self.table("mane").where(F.col("MANE_status") == status)
        ids = F.substring_index("id", ".", 1)
        keys = mane.select(F.explode(F.array(F.substring_index("RefSeq_nuc", ".", 1), F.substring_index("Ensembl_nuc", ".", 1))).alias("_bare"))
        return self.table("transcripts").withColumn("_bare", ids).join(keys, "_bare", "left_semi").drop("_bare")


def same_assembly(a: DataFrame, b: DataFrame, column: str = "refg") -> Column:
    """A join condition that raises if assemblies are mixed."""
    return F.when(a[column] == b[column], True).otherwise(F.raise_error(F.lit("assemblies are mixed")).cast("boolean"))
