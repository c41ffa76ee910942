"""Junction distributions and pileups on streams.

Both are sums of small whole numbers, so the batch aggregates run on a stream as they are: in
update mode each trigger gives the counts that have changed. With a watermark on an event
time, the counts of a window are final and may be appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.reads import JUNCTION, distribution, pileup


def stream_distribution(gaps: DataFrame, min_overhang: int = 0) -> DataFrame:
    """gaps: a stream of junction rows as reads.junctions() makes them. For outputMode("update")."""
    return distribution(gaps, min_overhang)


def stream_pileup(bases: DataFrame) -> DataFrame:
    """bases(chrom, pos, base): a stream of reference bases under reads. For outputMode("update")."""
    return pileup(bases)


def windowed_distribution(gaps: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """The distribution of every window of event time, final once the watermark has passed. For outputMode("append")."""
    shifts = gaps.withWatermark(time, late).withColumn("shift", F.explode(F.array(-F.col("left"), F.col("right"))))
    return shifts.groupBy(F.window(time, window), *JUNCTION, "strand", "shift").agg(F.count(F.lit(1)).alias("count"))
