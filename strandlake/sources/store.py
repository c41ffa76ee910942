"""Parquet tables with a format version, a cache of built tables, and FASTA text."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.catalog import VERSIONS
from strandlake.operators.dna import chunked

PROPERTY = "strandlake_format"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share, spark.checkpoint.dir. Where that is unset, one machine gets a folder of its own; a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/strandlake-tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove what this application put under scratch(); results that aren't computed by then can't be any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark)).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """A table partitioned by chromosome and sorted by position within files, so that range predicates prune row groups.

    Tasks get ranges of about as many rows each, however few chromosomes and positions the rows are spread over.
    The format's version travels as column metadata within the Parquet schema.
    """
    first = df.columns[0]
    marked = df.withMetadata(first, {PROPERTY: f"{kind}:{VERSIONS[kind]}"})
    if {"chrom", "start_pos"} <= set(df.columns):
        marked = marked.repartitionByRange("chrom", "start_pos").sortWithinPartitions("chrom", "start_pos")
        marked.write.mode(mode).partitionBy("chrom").parquet(path) if first != "chrom" else marked.write.mode(mode).parquet(path)
    else:
        marked.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of this kind and version, or an error."""
    df = spark.read.parquet(path)
    found = next((f.metadata[PROPERTY] for f in df.schema.fields if PROPERTY in f.metadata), None)
    if found != f"{kind}:{VERSIONS[kind]}":
        raise ValueError(f"not a table of {kind} {VERSIONS[kind]}: {found}")
    return df


def cached(spark: SparkSession, sources: list[str], options: dict, folder: str, kind: str, build) -> DataFrame:
    """build(), or what it gave before for the same files (by path, length and modification time) and options.

    Times come from the file system that Spark reads, so any store will do.
    """
    jvm = spark.sparkContext._jvm
    seen = []
    for s in sources:
        path = jvm.org.apache.hadoop.fs.Path(s)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append([s, status.getLen(), status.getModificationTime()])
    key = hashlib.sha256(json.dumps([seen, options, kind, VERSIONS[kind]], sort_keys=True, default=str).encode()).hexdigest()[:32]
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}-{key}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}-{key}/_SUCCESS")):
        write_table(build(), f"{folder}/{kind}-{key}", kind, mode="overwrite")
    return read_table(spark, f"{folder}/{kind}-{key}", kind)


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """sequences(chrom, seq) as (chrom, line, value): a header at line -1, then pieces of the width."""
    head = sequences.select("chrom", F.lit(-1).cast("long").alias("line"), F.concat(F.lit(">"), "chrom").alias("value"))
    return head.unionByName(chunked(sequences, width).select("chrom", F.col("chunk").alias("line"), F.col("seq").alias("value")))
