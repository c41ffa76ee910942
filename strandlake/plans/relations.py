"""Genomic relations derived from the driver's tables, for Spark and, as CTEs, for DuckDB.

Elements are line items, query windows are orders, and customer - order - line item
plays gene - transcript - exon. All arithmetic is on whole numbers, so both engines
agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.operators.scan import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> (source table, projection in SQL that both engines read alike)
_RELATIONS = {
    "iv": ("lineitem", """
        l_orderkey AS tran_idx, l_partkey AS part, l_linenumber AS line, concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS chrom,
        CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
        CAST(l_partkey * 100 + l_linenumber * 7 AS BIGINT) AS start_pos,
        CAST(l_partkey * 100 + l_linenumber * 7 + CAST(l_quantity AS INT) - 1 AS BIGINT) AS end_pos,
        CAST(l_quantity AS BIGINT) AS quantity"""),
    "pairs": ("lineitem", """
        l_orderkey AS id, l_linenumber AS line, concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS chrom,
        CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
        CAST(l_partkey * 100 + l_linenumber * 7 AS BIGINT) AS s, CAST(l_partkey * 100 + l_linenumber * 7 + CAST(l_quantity AS INT) - 1 AS BIGINT) AS e,
        CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS bstrand,
        CAST(l_partkey * 100 + l_suppkey % 60 AS BIGINT) AS bs, CAST(l_partkey * 100 + l_suppkey % 60 + l_orderkey % 40 AS BIGINT) AS be"""),
    "q": ("orders", """
        o_orderkey AS q_id, concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS q_chrom,
        CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS q_strand,
        CAST(o_custkey * 130 AS BIGINT) AS q_start, CAST(o_custkey * 130 + o_orderkey % 400 AS BIGINT) AS q_end"""),
    "gene": ("customer", "c_custkey AS gene_idx, c_name AS name, c_mktsegment AS type, c_nationkey AS chrom_idx"),
    "tran": ("orders", "o_orderkey AS tran_idx, o_custkey AS gene_idx, o_orderstatus AS type, o_orderpriority AS level, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand"),
    "blocks": ("events", "event_type AS chrom, CAST(event_id * 10 AS BIGINT) AS start_pos, CAST(event_id * 10 + 6 AS BIGINT) AS end_pos, CAST(floor(value) AS BIGINT) AS value, event_id AS block"),
    "qb": ("orders", """
        o_orderkey AS q_id, CAST(o_custkey * 60 AS BIGINT) AS q_start, CAST(o_custkey * 60 + o_orderkey % 50 AS BIGINT) AS q_end,
        CASE o_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS q_chrom, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS q_strand"""),
    "reads": ("lineitem", """
        concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
        CAST((l_partkey % 20) * 100 AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS left_len, CAST(l_partkey % 97 + 20 AS BIGINT) AS skip,
        CAST(l_linenumber * 5 AS BIGINT) AS right_len, CAST((l_orderkey % 4) * 256 + (l_partkey % 3) * 16 AS BIGINT) AS flag"""),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, projection = _RELATIONS[name]
    exprs, depth, start = [], 0, 0
    for i, c in enumerate(projection):  # split at the commas outside brackets
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            exprs.append(projection[start:i])
            start = i + 1
    exprs.append(projection[start:])
    return table(spark, sf_dir, source).selectExpr(*(" ".join(e.split()) for e in exprs))


def cte(*names: str) -> str:
    """The WITH clause of the relations, for DuckDB."""
    parts = []
    for n in names:
        source, projection = _RELATIONS[n]
        parts.append(f"{n} AS (SELECT {' '.join(projection.split()).replace('AS STRING', 'AS VARCHAR').replace('AS INT)', 'AS INTEGER)')} FROM {source})")
    return "WITH " + ", ".join(parts)


#: Exons that don't overlap within their transcript, one a part.
EXON = """exon AS (SELECT l_orderkey AS tran_idx, 'chr' || (l_orderkey % 5 + 1) AS chrom, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
CAST(l_partkey * 100 AS BIGINT) AS start_pos, CAST(l_partkey * 100 + 20 + CAST(max(l_quantity) AS INTEGER) AS BIGINT) AS end_pos, min(l_linenumber) AS line
FROM lineitem GROUP BY l_orderkey, l_partkey)"""


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Spark, a transcript's exons in one task."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.selectExpr(
        "l_orderkey AS tran_idx", "concat('chr', CAST(l_orderkey % 5 + 1 AS STRING)) AS chrom", "CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
        "CAST(l_partkey * 100 AS BIGINT) AS start_pos", "CAST(l_quantity AS INT) AS quantity", "l_linenumber",
    )
    return dealt(rows, "tran_idx", count=lines.count()).groupBy("tran_idx", "chrom", "strand", "start_pos").agg({"quantity": "max", "l_linenumber": "min"}).selectExpr("tran_idx", "chrom", "strand", "start_pos", "CAST(start_pos + 20 + `max(quantity)` AS BIGINT) AS end_pos", "`min(l_linenumber)` AS line")
