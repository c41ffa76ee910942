"""All queries of the library, gathered from its modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans import q_annotation, q_files, q_intervals, q_joins, q_reads, q_sequence, q_tracks

MODULES = (q_intervals, q_joins, q_annotation, q_reads, q_tracks, q_sequence, q_files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["j01_find_overlapping"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
