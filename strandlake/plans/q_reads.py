"""Registered queries of spliced reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import reads as rd
from strandlake.operators.dna import chunked

from .q_sequence import SEQ, sequences
from .relations import cte, relation

QUERIES: dict = {}
ORACLE: dict = {}
R = cte("reads")
J = "pos + left_len AS start_pos, pos + left_len + skip AS end_pos"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def cigars(spark, d):
    """Reads with a CIGAR string of an overhang, a gap and an overhang, a deletion in some."""
    r = relation(spark, d, "reads")
    n = lambda c: F.col(c).cast("string")
    tail = F.when(F.col("right_len") % 2 == 0, F.concat(F.lit("2D"), n("right_len"), F.lit("M3S"))).otherwise(F.concat(n("right_len"), F.lit("M")))
    return r.withColumn("cigar", F.concat(n("left_len"), F.lit("M"), n("skip"), F.lit("N"), tail))


def gaps(spark, d):
    """Junctions with overhangs, straight from the lengths."""
    r = relation(spark, d, "reads")
    return r.select("chrom", "strand", (F.col("pos") + F.col("left_len")).alias("start_pos"), (F.col("pos") + F.col("left_len") + F.col("skip")).alias("end_pos"), F.col("left_len").alias("left"), F.col("right_len").alias("right"))


_CIGAR = "left_len || 'M' || skip || 'N' || CASE WHEN right_len % 2 = 0 THEN '2D' || right_len || 'M3S' ELSE right_len || 'M' END"


@query("r01_operations", f"{R}, c AS (SELECT chrom, pos, {_CIGAR} AS cigar FROM reads) SELECT chrom, pos, cigar, CAST(len(regexp_extract_all(cigar, '[A-Z]')) AS BIGINT) AS n_ops FROM c")
def operations(spark, d):
    return cigars(spark, d).select("chrom", "pos", "cigar", F.size(rd.operations(F.col("cigar"))).cast("long").alias("n_ops"))


@query("r02_consumption", f"{R} SELECT chrom, pos, left_len + right_len + CASE WHEN right_len % 2 = 0 THEN 3 ELSE 0 END AS query_len, left_len + skip + right_len + CASE WHEN right_len % 2 = 0 THEN 2 ELSE 0 END AS ref_len FROM reads")
def consumption(spark, d):
    ops = rd.operations(F.col("cigar"))
    return cigars(spark, d).select("chrom", "pos", rd.consumed(ops, "MIS").alias("query_len"), rd.consumed(ops, "MDN").alias("ref_len"))


@query("r03_junctions", f"{R} SELECT chrom, strand, {J} FROM reads")
def junctions(spark, d):
    return rd.junctions(cigars(spark, d)).select("chrom", "strand", "start_pos", "end_pos")


@query("r04_overhangs", f"{R} SELECT chrom, {J}, left_len AS \"left\", right_len AS \"right\" FROM reads")
def overhangs(spark, d):
    return rd.junctions(cigars(spark, d)).select("chrom", "start_pos", "end_pos", "left", "right")


@query("r05_clamp", f"{R} SELECT chrom, pos, least(left_len * 9, 255) AS overhang FROM reads")
def clamp(spark, d):
    return relation(spark, d, "reads").select("chrom", "pos", rd.overhang(F.col("left_len") * 9).cast("long").alias("overhang"))


@query("r06_segments", f"""{R}, u AS (SELECT chrom, strand, pos, left_len, skip, right_len FROM reads) SELECT chrom, pos, CAST(0 AS BIGINT) AS segment, pos AS start_pos, pos + left_len AS end_pos FROM u
UNION ALL SELECT chrom, pos, 1, pos + left_len + skip, pos + left_len + skip + right_len + CASE WHEN right_len % 2 = 0 THEN 2 ELSE 0 END FROM u""")
def segments(spark, d):
    r = cigars(spark, d).select("chrom", "strand", "pos", "left_len", "skip", "right_len", "cigar")
    return rd.segments(r).select("chrom", "pos", "segment", "start_pos", "end_pos")


@query("r09_read_strand", f"{R} SELECT chrom, pos, flag, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS read_strand FROM reads")
def read_strand(spark, d):
    return relation(spark, d, "reads").select("chrom", "pos", "flag", rd.read_strand(F.col("flag")).alias("read_strand"))


_FWD = "CASE WHEN ((flag & 64) <> 0) = ((flag & 16) = 0) THEN '+' ELSE '-' END"


@query("r10_library_strand", f"{R}, f AS (SELECT chrom, pos, (flag | 1) | (pos % 3) * 64 AS flag FROM reads) SELECT chrom, pos, flag, {_FWD} AS sf, CASE WHEN {_FWD} = '+' THEN '-' ELSE '+' END AS sr FROM f")
def library_strand(spark, d):
    r = relation(spark, d, "reads").select("chrom", "pos", F.col("flag").bitwiseOR(F.lit(1)).bitwiseOR((F.col("pos") % 3) * 64).alias("flag"))
    return r.select("chrom", "pos", "flag", rd.library_strand(F.col("flag"), "ISF").alias("sf"), rd.library_strand(F.col("flag"), "ISR").alias("sr"))


@query("r14_shift_sides", f"{R} SELECT chrom, strand, left_len, (strand = '+') AS is_start FROM reads")
def shift_sides(spark, d):
    """A negative shift is the start's side on the plus strand and the end's on the minus strand."""
    return relation(spark, d, "reads").select("chrom", "strand", "left_len", (F.col("strand") == "+").alias("is_start"))


@query("a01_junction_reads", f"{R} SELECT chrom, strand, {J}, count(*) AS num_reads, max(left_len) AS max_left, max(right_len) AS max_right FROM reads WHERE left_len >= 3 AND right_len >= 3 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2")
def junction_reads(spark, d):
    return rd.collect_junctions(gaps(spark, d), min_reads=2, min_overhang=3)


@query("a02_distribution", f"{R}, g AS (SELECT chrom, {J}, strand, unnest([-left_len, right_len]) AS shift FROM reads) SELECT chrom, start_pos, end_pos, strand, shift, count(*) AS count FROM g GROUP BY 1, 2, 3, 4, 5")
def distribution(spark, d):
    return rd.distribution(gaps(spark, d))


@query("a03_num_reads", f"{R} SELECT chrom, {J}, count(*) AS num_reads, CAST(count(DISTINCT strand || -left_len) + count(DISTINCT strand || right_len) AS BIGINT) AS num_counts FROM reads GROUP BY 1, 2, 3")
def num_reads(spark, d):
    return rd.reads_per_junction(rd.distribution(gaps(spark, d)))


@query("a04_total_reads", f"{R} SELECT count(*) AS total FROM reads WHERE left_len >= 5 AND right_len >= 5")
def total_reads(spark, d):
    kept = rd.reads_per_junction(rd.distribution(gaps(spark, d), min_overhang=5))
    return kept.agg(F.sum("num_reads").alias("total"))


_BASE = "['A','C','G','T','N'][p % 5 + 1]"


@query("a05_pileup", f"""{R}, m AS (SELECT chrom, pos + unnest(range(0, 10)) AS p FROM reads WHERE left_len > 10), b AS (SELECT chrom, p, {_BASE} AS base, 1 AS n FROM m),
v AS (SELECT chrom, pos + 3 AS p, left_len FROM reads WHERE left_len > 10 AND left_len % 3 < 2), x AS (SELECT chrom, p, {_BASE} AS base, -1 AS n FROM v UNION ALL SELECT chrom, p, CASE WHEN left_len % 3 = 0 THEN 'DEL' ELSE 'G' END, 1 FROM v), u AS (SELECT * FROM b UNION ALL SELECT * FROM x)
SELECT chrom, p AS pos, CAST(coalesce(sum(n) FILTER (base = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(n) FILTER (base = 'C'), 0) AS BIGINT) AS C, CAST(coalesce(sum(n) FILTER (base = 'G'), 0) AS BIGINT) AS G, CAST(coalesce(sum(n) FILTER (base = 'T'), 0) AS BIGINT) AS T, CAST(coalesce(sum(n) FILTER (base = 'DEL'), 0) AS BIGINT) AS DEL FROM u GROUP BY 1, 2""")
def pileup(spark, d):
    """Counts of bases under reads; variants (J19) take from the reference's count."""
    letters = F.array(*(F.lit(b) for b in "ACGTN"))
    base = F.element_at(letters, (F.col("pos") % 5 + 1).cast("int"))
    r = relation(spark, d, "reads").where("left_len > 10")
    bases = r.select("chrom", F.explode(F.sequence("pos", F.col("pos") + 9)).alias("pos"))
    v = r.where("left_len % 3 < 2").select("chrom", (F.col("pos") + 3).alias("pos"), "left_len").withColumn("alt", F.when(F.col("left_len") % 3 == 0, "").otherwise("G"))
    return rd.pileup(bases.withColumn("base", base), v.withColumn("ref", base))


_PILED = """r AS (SELECT doc_id, chrom, seq, k, (doc_id * 7 + k * 11) % greatest(length(seq) - 20, 1) AS pos FROM seq, (SELECT unnest(range(0, 6)) AS k) WHERE length(seq) >= 40),
m AS (SELECT chrom, pos, pos + unnest(list_concat(range(0, 6), range(9, 15))) AS p, seq, k FROM r),
x AS (SELECT chrom, p, CASE WHEN k % 3 = 1 AND p = pos + 2 AND substr(seq, CAST(p + 1 AS INTEGER), 1) <> 'T' THEN 'T' WHEN k % 3 = 2 AND p IN (pos + 10, pos + 11) THEN 'DEL' ELSE substr(seq, CAST(p + 1 AS INTEGER), 1) END AS base FROM m WHERE p < length(seq))"""


@query("j19_pileup_variants", f"""WITH {SEQ}, {_PILED} SELECT chrom, p AS pos, count(*) FILTER (base = 'A') AS A, count(*) FILTER (base = 'C') AS C, count(*) FILTER (base = 'G') AS G,
count(*) FILTER (base = 'T') AS T, count(*) FILTER (base = 'DEL') AS DEL FROM x GROUP BY 1, 2""")
def pileup_variants(spark, d):
    """Spliced reads over the texts' letters as a reference, with substitutions and deletions of two bases linked to them: positions, not reads, make the rows."""
    s = sequences(spark, d).where("length(seq) >= 40")
    r = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("pos", (F.col("doc_id") * 7 + F.col("k") * 11) % F.greatest(F.length("seq") - 20, F.lit(1)))
    at = lambda k, n: F.substring(F.col("seq"), (F.col("pos") + k + 1).cast("int"), F.lit(n))
    one = r.where("k % 3 = 1").select("chrom", (F.col("pos") + 2).alias("start_pos"), at(2, 1).alias("ref"), F.lit("T").alias("alt")).where("ref <> 'T'")
    two = r.where("k % 3 = 2").select("chrom", (F.col("pos") + 10).alias("start_pos"), at(10, 2).alias("ref"), F.lit("").alias("alt"))
    reads = r.select("chrom", "pos", F.when(F.col("k") % 3 == 2, "6M3N1M2D3M").otherwise("6M3N6M").alias("cigar"))
    return rd.pileup_of_reads(reads, chunked(s.select("chrom", "seq"), 1024), one.unionByName(two), 1024)


QUERIES["s12_distribution"], ORACLE["s12_distribution"] = distribution, ORACLE["a02_distribution"]
