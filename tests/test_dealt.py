"""Rows are dealt to as many tasks as their tables need, whatever number of shuffle partitions is set."""

import random
import re

from pyspark.sql import functions as F

from strandlake.operators import dna, scan, splice
from strandlake.operators import reads as rd
from strandlake.plans.relations import exons

SF = "/root/testdata/sf0.001"


def test_spliced_parts_lie_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Parts of a table twice as large lie in twice as many tasks; before, in as many as spark.sql.shuffle.partitions says."""
    rows = spark.range(8000).select((F.col("id") % 800).alias("dis_id"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), (F.col("id") * 10).alias("start_pos"), (F.col("id") * 10 + 4).alias("end_pos"))
    whole = splice.build(rows)
    rows.write.parquet(f"{tmp_path}/one")
    rows.unionByName(rows.withColumn("dis_id", F.col("dis_id") + 800)).write.parquet(f"{tmp_path}/two")
    one, two = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "two"))
    bytes_of = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(scan, "DEALT_BYTES", bytes_of(one) // 20)
    tasks = [splice.build(t).rdd.getNumPartitions() for t in (one, two)]
    assert tasks == [-(-bytes_of(t) // (bytes_of(one) // 20)) for t in (one, two)] and tasks[0] >= 20 and tasks[1] >= 1.8 * tasks[0]
    got = splice.build(one)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    # a sequence lies in one task
    assert got.withColumn("task", F.spark_partition_id()).groupBy("dis_id").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()


def test_exons_lie_in_tasks_of_bounded_size(spark, monkeypatch):
    before = sorted(map(tuple, exons(spark, SF).collect()))
    monkeypatch.setattr(scan, "DEALT_BYTES", 1 << 13)
    got = exons(spark, SF)
    assert got.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, got.collect())) == before


def test_exons_of_files_that_compress_well_lie_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Copies of line items, a row's side by side, take few bytes: tasks follow the rows. Before, eight copies went to hardly more tasks than one."""
    one = spark.read.parquet(f"{SF}/lineitem.parquet")
    copies = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("l_orderkey", F.col("l_orderkey") + F.col("i") * 10_000_000).drop("i")
    copies.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(scan, "DEALT_ROWS", 300)
    tasks = [exons(spark, d).rdd.getNumPartitions() for d in (SF, tmp_path)]
    assert tasks == [-(-one.count() // 300), -(-8 * one.count() // 300)]
    assert exons(spark, tmp_path).where("tran_idx < 10000000").exceptAll(exons(spark, SF)).isEmpty() and exons(spark, tmp_path).count() == 8 * exons(spark, SF).count()


def test_read_variants_against_brute_force_and_without_a_shuffle(spark):
    """Matches and deletions longer than a chunk, reads that begin or end beyond the chromosome, equal insertions; no read is shuffled."""
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGT") for _ in range(61))
    chroms = spark.createDataFrame([("c", ref)], "chrom string, seq string")
    chunks, sizes = dna.chunked(chroms, 8), chroms.select("chrom", F.length("seq").cast("long").alias("size"))
    reads = [(-1, "c", 3, "2M1I1I2M", ref[3:5] + "GG" + ref[5:7]), (-2, "none", 3, "2M", "AC"), (-3, "c", 0, "9N2M", ref[9:10] + "N")]
    for i in range(150):
        ops = [(rng.choice("MMMMIDNS"), rng.choice((1, 2, 7, 8, 9, 17, 25))) for _ in range(rng.randrange(1, 6))]
        seq = "".join(rng.choice("ACGT") for op, n in ops if op in "MIS" for _ in range(n))
        reads.append((i, "c", rng.randrange(-6, 64), "".join(f"{n}{op}" for op, n in ops), seq or "*"))
    want = set()
    for read_id, chrom, pos, cigar, seq in reads:
        at = match = 0
        for n, op in re.findall(r"(\d+)(\D)", cigar):
            n = int(n)
            under = "".join(ref[p] if 0 <= p < len(ref) else "N" for p in range(pos, pos + n))
            if seq != "*" and chrom == "c":
                if op == "M":
                    want |= {(read_id, match, pos + k, under[k], seq[at + k]) for k in range(n) if under[k] != seq[at + k]}
                if op in "ID":
                    want.add((read_id, match, pos, under if op == "D" else "", seq[at : at + n] if op == "I" else ""))
            at, pos, match = at + n * (op in "MIS"), pos + n * (op in "MDN"), match + (op == "N")
    rows = spark.createDataFrame(reads, "read_id long, chrom string, pos long, cigar string, seq string").repartition(3)
    got = rd.read_variants(rows, chunks, sizes, 8)
    assert sorted(map(tuple, got.select("read_id", "match", "start_pos", "ref", "alt").collect())) == sorted(want)
    # before, the pieces of all windows were put together by a shuffle: now those of long deletions only
    plan = rd.read_variants(rows.where("cigar NOT LIKE '%D'"), chunks, sizes, 8)._jdf.queryExecution().optimizedPlan()
    short = plan.children().apply(0).toString()
    assert "Aggregate" not in short and short.count("Join Inner") + short.count("Join LeftOuter") == short.count("rightHint=(strategy=broadcast)") + 1


def test_chunks_made_from_few_rows_are_not_broadcast(spark):
    """A reference made from its sizes looks as small as these once they are counted; before, adaptive execution sent it whole to the driver."""
    sizes = spark.range(2000).groupBy((F.col("id") % 3).alias("c")).agg(F.max("id").alias("size")).select(F.concat(F.lit("chr"), "c").alias("chrom"), (F.col("size") + 1).alias("size"))
    chunks = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / 8)))).select("chrom", "chunk", F.repeat(F.lit("ACGT"), 2).alias("seq"))
    windows = spark.range(4000).repartition(3).select(F.col("id").alias("q_id"), F.concat(F.lit("chr"), F.col("id") % 3).alias("chrom"), F.lit("+").alias("strand"), (F.col("id") % 1900).alias("start_pos"), (F.col("id") % 1900 + 5).alias("end_pos"))
    got = dna.extract(windows, chunks, sizes, 8)
    rows = got.collect()
    assert len(rows) == 4000 and all(r["dna"] == "ACGTACGTA"[r["start_pos"] % 4 :][:5] for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [chrom" in line and "chunk#" in line]
