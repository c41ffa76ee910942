"""Queries against their SQL on keys that only larger tables have."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_first_value_of_far_positions(spark, tmp_path):
    # positions of a transcript that lie 100,000,000 and more apart
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet")
    far = F.when(F.col("l_linenumber") == 2, F.col("l_partkey") + 3_000_007).otherwise(F.col("l_partkey"))
    rows.withColumn("l_partkey", far.cast(dict(rows.dtypes)["l_partkey"])).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in entry.queries()["a09_first_value"](spark, str(tmp_path)).select("tran_idx", "protein_id").collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(duck.sql(entry.oracle_sql()["a09_first_value"]).select("tran_idx, protein_id").fetchall())
