"""GFF3 in its GENCODE/Ensembl and NCBI flavours, as tables.

Parents are found by joins on Parent = ID, so lines may come in any order and a file may be
read by any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.annotation import downstream, level_of, support_level, utrs
from strandlake.operators.scan import piece, ranked

from .store import stored

COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
TRANSCRIPTS = ("transcript", "mRNA", "lnc_RNA", "ncRNA", "miRNA", "snRNA", "snoRNA", "rRNA", "tRNA", "primary_transcript", "pseudogenic_transcript")


def attribute(attributes: Column, name: str, default: str | None = None, sep: str = ";") -> Column:
    """The value of name=value, else the default."""
    found = F.regexp_extract(attributes, rf"(?:^|{sep}) *{name}=([^{sep}]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def lines(text: DataFrame) -> DataFrame:
    """Nine columns from text(value); comments go; positions become 0-based and half-open."""
    part = F.split("value", "\t", 9)
    rows = text.where("value <> '' AND value NOT LIKE '#%'").select(*(F.get(part, F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)))
    return rows.select("seqid", "source", "type", (F.col("start").cast("long") - 1).alias("start_pos"), F.col("end").cast("long").alias("end_pos"), "strand", "phase", "attributes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of GFF3 files, compressed or not."""
    return lines(spark.read.text(path))


def _bare(column: Column) -> Column:
    return F.regexp_replace(column, "^(gene|transcript|rna|exon|cds)[:-]", "")


def _index(rows: DataFrame, name: str) -> DataFrame:
    """Dense row numbers in order of place and id, from counts a chromosome and a piece of it: no single task sorts either.

    Rows and numbers are written once: each is read several times, and would otherwise be made anew from the lines every time.
    """
    rows = stored(rows)
    sizes = rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("chrom", before.alias("_base"))
    placed = ranked(rows, ["chrom"], ["start_pos", "end_pos", "strand", "id"], [piece(F.col("start_pos"))], name, dense=False)
    return stored(placed.join(base, "chrom").withColumn(name, F.col("_base") + F.col(name) - 1).drop("_base"))


def tables(text: DataFrame, orphaned: str = "error") -> dict[str, DataFrame]:
    """genes, transcripts, exons, cdss and utrs from text(value) of GFF3 lines.

    A row is a gene or a transcript by its type or its ID's prefix; ids lose their prefix.
    Children of rows of other types are left out. A transcript, exon or CDS whose parent isn't
    there is an error, as is a CDS outside the exons of its transcript, unless orphaned is
    "exclude"; orphans() lists the former.
    """
    if orphaned not in ("error", "exclude"):
        raise ValueError(f"orphans are an error or excluded: {orphaned}")
    strict = orphaned == "error"
    rows = lines(text)
    a = lambda n, default=None: attribute(F.col("attributes"), n, default)
    rows = rows.withColumns({"ID": a("ID"), "Parent": a("Parent"), "chrom": F.col("seqid")})
    place = ("chrom", "strand", "start_pos", "end_pos")
    is_gene = F.col("type").isin("gene", "pseudogene") | F.col("ID").startswith("gene:")
    is_tran = F.col("type").isin(*TRANSCRIPTS) | F.col("ID").startswith("transcript:")
    level = level_of(a("level"), F.col("source"))
    gene_id = F.coalesce(a("gene_id"), F.nullif(F.regexp_extract(F.coalesce(a("Dbxref"), F.lit("")), r"GeneID:(\d+)", 1), F.lit("")), _bare(F.col("ID")))
    genes = rows.where(is_gene).select(*place, F.col("ID").alias("_gene"), _bare(gene_id).alias("id"), F.coalesce(a("gene_name"), a("Name"), a("gene"), gene_id).alias("name"), F.coalesce(a("gene_type"), a("biotype"), a("gene_biotype")).alias("type"), level.alias("level"))
    genes = _index(genes, "gene_idx")
    trans = rows.where(is_tran & ~is_gene).select(
        *place, F.col("ID").alias("_tran"), F.col("Parent").alias("_gene"), F.coalesce(a("transcript_id"), _bare(F.col("ID"))).alias("id"), F.coalesce(a("transcript_type"), a("biotype")).alias("type"),
        level.alias("level"), support_level(a("transcript_support_level")).alias("tsl"), a("ccdsid").alias("ccds_id"), a("protein_id").alias("protein_id"), a("product").alias("product"),
    )
    of = genes.select("_gene", "gene_idx", F.col("type").alias("_type"))
    # every ID that can be a parent, so that a parent of another type is told from none; an error only where a child names none of them
    named = rows.where(F.col("ID").isNotNull() & ~F.col("type").isin("exon", "CDS")).select(F.col("ID").alias("_parent")).distinct()
    named = stored(named) if strict else named

    def of_parents(children: DataFrame, key: DataFrame, index: str) -> DataFrame:
        """children with the columns of key, both by _parent."""
        if not strict:
            return children.join(key, "_parent").drop("_parent")
        there = named.join(key, "_parent", "left").withColumn("_there", F.lit(True))
        met = children.join(there, "_parent", "left")
        missing = F.raise_error(F.concat(F.lit("a parent that isn't there: "), F.coalesce("_parent", F.lit("")))).cast("long")
        return met.withColumn(index, F.when(F.col("_there") | F.col("_parent").isNull(), F.col(index)).otherwise(missing)).where(F.col(index).isNotNull()).drop("_parent", "_there")

    trans = of_parents(trans.withColumnRenamed("_gene", "_parent"), of.withColumnRenamed("_gene", "_parent"), "gene_idx")
    trans = _index(trans.withColumn("type", F.coalesce("type", "_type")).drop("_type"), "tran_idx")
    key = trans.select(F.col("_tran").alias("_parent"), "tran_idx")

    def children(kind: str, *more: Column) -> DataFrame:
        c = rows.where(F.col("type") == kind).select(*place, F.explode(F.split("Parent", ",")).alias("_parent"), F.col("ID").alias("id"), *more)
        return of_parents(c, key, "tran_idx")

    w = Window.partitionBy("tran_idx").orderBy(downstream())
    exons = children("exon").withColumn("index", F.row_number().over(w).cast("long") - 1)
    cdss = children("CDS", F.col("phase").try_cast("tinyint").alias("phase"), a("protein_id").alias("protein_id"))
    inside = exons.select("tran_idx", F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), F.col("index").alias("exon_index"))
    held = (F.col("start_pos") >= F.col("_s")) & (F.col("end_pos") <= F.col("_e"))
    if strict:
        met = cdss.alias("c").join(inside.alias("i"), (F.col("c.tran_idx") == F.col("i.tran_idx")) & held, "left").select("c.*", "i.exon_index")
        cdss = met.withColumn("exon_index", F.coalesce("exon_index", F.raise_error(F.lit("a CDS outside the exons of its transcript")).cast("long")))
    else:
        cdss = cdss.join(inside, "tran_idx").where(held).drop("_s", "_e")
    return {"genes": genes.drop("_gene"), "transcripts": trans.drop("_tran"), "exons": exons, "cdss": cdss, "utrs": utrs(exons, cdss)}


def orphans(text: DataFrame) -> DataFrame:
    """Rows whose Parent is the ID of no row."""
    rows = lines(text).withColumns({"ID": attribute(F.col("attributes"), "ID"), "Parent": attribute(F.col("attributes"), "Parent")})
    child = rows.where("Parent IS NOT NULL").withColumn("_p", F.explode(F.split("Parent", ",")))
    return child.join(rows.select(F.col("ID").alias("_p")), "_p", "left_anti").drop("_p")
