"""Registered queries of dense tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import tracks as tr

from .relations import cte, relation, table

QUERIES: dict = {}
ORACLE: dict = {}
BQ = cte("blocks", "qb")
EV = "SELECT event_id, value FROM events"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def _grid(value: str = "b.value", default: str = "-1", block: str = "p >= b.start_pos AND p < b.end_pos", more: str = "") -> str:
    return f"""{BQ}, g AS (SELECT q_id, q_chrom, q_strand, q_start, q_end, unnest(range(q_start, q_end)) AS p FROM qb{more})
    SELECT q_id, CASE WHEN q_strand = '-' THEN q_end - 1 - p ELSE p - q_start END AS i, coalesce({value}, {default}) AS value FROM g LEFT JOIN blocks b ON b.chrom = q_chrom AND {block}"""


@query("t01_decode", _grid())
def decode(spark, d):
    return tr.decode(relation(spark, d, "blocks"), relation(spark, d, "qb"), tr.Track(default=-1))


@query("t02_unstranded", _grid(more=" WHERE q_strand = '-'"))
def unstranded(spark, d):
    """Both strands of an unstranded track read the plus strand's data; minus comes reversed."""
    return tr.decode(relation(spark, d, "blocks"), relation(spark, d, "qb").where("q_strand = '-'"), tr.Track(default=-1))


@query("t03_resolution", f"""{BQ}, g AS (SELECT q_id, q_chrom, q_strand, q_start, q_end, unnest(range(q_start, q_end)) AS p FROM qb), v AS (SELECT chrom, start_pos, end_pos, unnest([value, value + 1, value + 2]) AS v, unnest([0, 1, 2]) AS k FROM blocks)
SELECT q_id, CASE WHEN q_strand = '-' THEN q_end - 1 - p ELSE p - q_start END AS i, coalesce(v, -1) AS value FROM g LEFT JOIN v ON chrom = q_chrom AND p >= start_pos + 2 * k AND p < start_pos + 2 * k + 2""")
def resolution(spark, d):
    """A value a grid of two positions."""
    b = relation(spark, d, "blocks").withColumn("values", F.array("value", F.col("value") + 1, F.col("value") + 2)).drop("value")
    return tr.decode(b, relation(spark, d, "qb"), tr.Track(default=-1, resolution=2))


_PAIRS = [(e, t) for e, types in tr.DTYPES.items() for t in types]


@query("t04_dtype", f"SELECT etype, dtype, count(*) AS n, CAST(sum(CASE WHEN etype = 'm0' THEN 1 ELSE event_id % 2 END) AS DOUBLE) AS total FROM events, (VALUES {', '.join(f'{p}' for p in _PAIRS)}) t(etype, dtype) GROUP BY 1, 2")
def dtype(spark, d):
    """Every encoding decoded as every type that it allows, in one scan."""
    v = (F.col("event_id") % 2).cast("double")
    shown = [F.struct(F.lit(e).alias("etype"), F.lit(t).alias("dtype"), tr.as_dtype(tr.encoded(v, tr.Track(etype=e)), e, t).cast("double").alias("v")) for e, t in _PAIRS]
    return table(spark, d, "events").select(F.explode(F.array(*shown)).alias("x")).select("x.*").groupBy("etype", "dtype").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query("t05_mask", _grid("CASE WHEN b.value IS NOT NULL THEN 1 END", "0"))
def mask(spark, d):
    return tr.decode(relation(spark, d, "blocks"), relation(spark, d, "qb"), tr.Track(default=0, etype="m0"))


@query("t06_integers", "SELECT event_id, CAST(CAST(floor(value) AS INTEGER) % 4 AS DOUBLE) AS u2 FROM events")
def integers(spark, d):
    return table(spark, d, "events").select("event_id", tr.integral((F.floor("value") % 4).cast("double"), "u2").alias("u2"))


_V = "(event_id % 1001) / CAST(1000 AS DOUBLE)"


@query("t07_quantise", f"SELECT event_id, CAST(floor({_V} * 4 + 0.5) AS DOUBLE) / 4 AS value FROM events")
def quantise(spark, d):
    """The nearest of five entries; a tie goes up."""
    v = (F.col("event_id") % 1001) / F.lit(1000.0)
    return table(spark, d, "events").select("event_id", tr.quantised(v, (0.0, 0.25, 0.5, 0.75, 1.0)).alias("value"))


@query("t08_dictionary", "SELECT CAST(i AS BIGINT) AS i, i / CAST(15 AS DOUBLE) AS value FROM range(16) t(i)")
def dictionary(spark, d):
    return spark.createDataFrame(list(enumerate(tr.default_dictionary(4))), "i long, value double")


@query("t09_half", "SELECT event_id, CAST(event_id % 2048 AS DOUBLE) + CASE WHEN event_id % 2048 < 1024 THEN 0.5 ELSE 0 END AS value FROM events")
def half(spark, d):
    """Values that half precision holds come back as they were."""
    v = (F.col("event_id") % 2048).cast("double") + F.when(F.col("event_id") % 2048 < 1024, 0.5).otherwise(0.0)
    return table(spark, d, "events").select("event_id", tr.half(v).alias("value"))


@query("t11_default_value", _grid(default="7"))
def default_value(spark, d):
    return tr.decode(relation(spark, d, "blocks"), relation(spark, d, "qb"), tr.Track(default=7))


@query("t12_sparsity", """WITH p AS (SELECT event_type AS chrom, event_id AS pos, CAST(CASE WHEN value < 60 THEN 0 ELSE 1 END AS DOUBLE) AS v FROM events),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, v ORDER BY pos) AS k FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY chrom, v, k) AS n FROM r) SELECT chrom, pos, v AS value FROM n WHERE v <> 0 OR n < 2""")
def sparsity(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("chrom"), F.lit("+").alias("strand"), F.col("event_id").alias("pos"), F.when(F.col("value") < 60, 0.0).otherwise(1.0).alias("value"))
    return tr.sparsified(p, tr.Track(), min_run=2).select("chrom", "pos", "value")


@query("t13_clamp", "SELECT event_id, greatest(10, least(50, floor(value))) AS value FROM events")
def clamp(spark, d):
    return table(spark, d, "events").select("event_id", tr.clamped(F.floor("value").cast("double"), 10.0, 50.0).alias("value"))


@query("t14_transform", "SELECT event_id, floor(value) * 2 + 1 AS value FROM events")
def transform(spark, d):
    return table(spark, d, "events").select("event_id", tr.transformed(F.floor("value").cast("double"), 0.0, 1.0, 1.0, 3.0).alias("value"))


@query("t15_restriction", f"{BQ} SELECT chrom, greatest(start_pos, 2000) AS start_pos, least(end_pos, 9002) AS end_pos, value FROM blocks WHERE start_pos < 9002 AND end_pos > 2000")
def restriction(spark, d):
    b = relation(spark, d, "blocks").where("start_pos < 9002 AND end_pos > 2000")
    at = lambda c, f, n: f(c, F.lit(n).cast("long")).alias(c)
    return b.select("chrom", at("start_pos", F.greatest, 2000), at("end_pos", F.least, 9002), "value")


@query("t16_block_overlaps", f"""{BQ}, w AS (SELECT chrom, start_pos, end_pos + value % 60 AS end_pos FROM blocks), m AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w) SELECT chrom, start_pos, end_pos FROM m WHERE start_pos < r""")
def block_overlaps(spark, d):
    """Blocks that a builder would refuse."""
    b = relation(spark, d, "blocks").select("chrom", F.lit("+").alias("strand"), "start_pos", (F.col("end_pos") + F.col("value") % 60).alias("end_pos"))
    return tr.overlapping_blocks(b).select("chrom", "start_pos", "end_pos")


@query("t17_sense_order", _grid("b.value + CASE WHEN q_strand = '-' THEN b.end_pos - 1 - p ELSE p - b.start_pos END", block="(b.block % 2 = 1) = (q_strand = '-') AND p >= b.start_pos AND p < b.end_pos"))
def sense_order(spark, d):
    """Data of a strand-aware track run from 5' to 3'; each strand has its own."""
    b = relation(spark, d, "blocks").withColumns({"strand": F.when(F.col("block") % 2 == 1, "-").otherwise("+"), "values": F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("value") + i)}).drop("value")
    return tr.decode(tr.placed(b, "strand_aware"), relation(spark, d, "qb"), tr.Track(default=-1, stranded=True))


@query("t19_dimensions", f"""{BQ}, g AS (SELECT q_id, q_chrom, q_strand, q_start, q_end, unnest(range(q_start, q_end)) AS p FROM qb)
SELECT q_id, CASE WHEN q_strand = '-' THEN q_end - 1 - p ELSE p - q_start END AS i, dim, coalesce(b.value + 10 * (p - b.start_pos) + dim, -1) AS value FROM g LEFT JOIN blocks b ON b.chrom = q_chrom AND p >= b.start_pos AND p < b.end_pos, (VALUES (0), (1), (2)) t(dim)""")
def dimensions(spark, d):
    """Three values a position; the minus strand turns positions round, not dimensions."""
    b = relation(spark, d, "blocks").withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.col("value") + 10 * F.floor(i / 3) + i % 3)).drop("value")
    return tr.decode(b, relation(spark, d, "qb"), tr.Track(default=-1, dim=3))


@query("t20_intervals", f"{BQ} SELECT DISTINCT chrom, start_pos, end_pos FROM blocks")
def intervals(spark, d):
    return relation(spark, d, "blocks").select("chrom", "start_pos", "end_pos").distinct()


@query("t21_histogram", f"WITH d AS ({_grid()}) SELECT CAST(value AS DOUBLE) AS value, count(*) AS count FROM d GROUP BY 1")
def histogram(spark, d):
    return tr.histogram(decode(spark, d))


@query("t22_properties", f"{BQ} SELECT chrom, count(*) AS blocks, CAST(min(end_pos - start_pos) AS BIGINT) AS least FROM blocks GROUP BY 1")
def properties(spark, d):
    b = relation(spark, d, "blocks")
    return b.groupBy("chrom").agg(F.count(F.lit(1)).alias("blocks"), F.min(F.col("end_pos") - F.col("start_pos")).alias("least"))


@query("a06_histogram", "SELECT event_type AS dim, CAST(floor(value) AS DOUBLE) AS value, count(*) AS count FROM events GROUP BY 1, 2")
def dim_histogram(spark, d):
    return tr.histogram(table(spark, d, "events").select(F.col("event_type").alias("dim"), F.floor("value").cast("double").alias("value")), "dim")


@query("a13_min_max", "SELECT event_type AS chrom, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def min_max(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("chrom")).agg(F.min("value").alias("least"), F.max("value").alias("most"))


@query("a14_sizes", f"{BQ} SELECT CAST(sum(end_pos - start_pos) AS BIGINT) AS data_size, count(*) AS index_size FROM blocks")
def sizes(spark, d):
    return relation(spark, d, "blocks").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("data_size"), F.count(F.lit(1)).alias("index_size"))


@query("s15_bedgraph", "SELECT event_type AS chrom, event_id * 10 AS start_pos, event_id * 10 + 6 AS end_pos, CAST(floor(value) AS DOUBLE) AS value FROM events")
def bedgraph(spark, d):
    """The reader's columns from lines of text."""
    from strandlake.sources.signal import bedgraph_rows

    e = table(spark, d, "events")
    n = lambda c: c.cast("long").cast("string")
    text = F.concat_ws("\t", "event_type", n(F.col("event_id") * 10), n(F.col("event_id") * 10 + 6), n(F.floor("value")))
    return bedgraph_rows(e.select(text.alias("value"))).drop("strand")


@query("s16_bed", "SELECT event_type AS chrom, event_id AS start_pos, event_id + 5 AS end_pos, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(user_id AS DOUBLE) AS value FROM events")
def bed(spark, d):
    from strandlake.sources.signal import bed_rows

    n = lambda c: c.cast("string")
    text = F.concat_ws("\t", "event_type", n(F.col("event_id")), n(F.col("event_id") + 5), F.lit("x"), n(F.col("user_id")), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"))
    return bed_rows(table(spark, d, "events").select(text.alias("value")))


@query("s17_blocks", "SELECT event_type AS chrom, event_id // 3 AS start_pos, unnest([floor(value), user_id]) AS value FROM events")
def from_arrays(spark, d):
    """Blocks given as arrays."""
    e = table(spark, d, "events").select(F.col("event_type").alias("chrom"), F.floor(F.col("event_id") / 3).alias("start_pos"), F.array(F.floor("value").cast("double"), F.col("user_id").cast("double")).alias("values"))
    return e.select("chrom", "start_pos", F.explode("values").alias("value"))
