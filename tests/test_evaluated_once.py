"""What is costly is evaluated once for a row: prefixes of alleles."""

from pyspark.sql import functions as F

from strandlake.operators import variants as va


def test_prefix_of_alleles_is_computed_once(spark):
    rows = [("AC", "AG"), ("", "T"), ("ACG", "A"), ("A", "A"), ("AAC", "AATTT"), ("", ""), (None, "A"), ("ACGT", "TC")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, ref string, alt string").withColumn("v", va.normalised(F.lit(10), F.col("ref"), F.col("alt")))
    shown = [[tuple(v) for v in r["v"]] for r in got.orderBy("i").collect()]
    assert shown == [[(11, "C", "G")], [(10, "", "T")], [(11, "CG", "")], [], [(12, "C", "T"), (13, "", "TT")], [], [], [(10, "AC", "TC"), (12, "GT", "")]]
    # before, some dozens of times
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_position(") == 1
