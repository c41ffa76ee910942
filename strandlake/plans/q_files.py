"""Registered queries of readers, writers, headers, caches and catalogs, on files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import tracks
from strandlake.operators import reads as rd
from strandlake.operators import variants as va
from strandlake.operators.catalog import Genome
from strandlake.operators.scan import piece, scanned
from strandlake.sources import assembly, gff, sam, signal, store, twobit, vcf

from . import q_annotation, q_reads, q_sequence
from .q_sequence import _LONG, SEQ, UPW
from .relations import EXON, cte, exons, relation, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def text_file(spark, lines, compression: str | None = None, one: bool = False) -> str:
    """lines(value) written as text to the shared folder; its path."""
    path = store.scratch(spark)
    writer = (lines.coalesce(1) if one else lines).write
    (writer.option("compression", compression) if compression else writer).text(path)
    return path


def _event_lines(spark, d):
    n = lambda c: F.col(c).cast("string")
    return table(spark, d, "events").select(F.concat_ws("\t", n("event_id"), "event_type", n("user_id")).alias("value"))


_EVENTS = "SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events"


def _parsed(lines):
    p = F.split("value", "\t", 3)
    return lines.select(F.get(p, F.lit(0)).cast("long").alias("event_id"), F.get(p, F.lit(1)).alias("event_type"), F.get(p, F.lit(2)).alias("user_id"))


@query("s01_lines", _EVENTS)
def lines(spark, d):
    return _parsed(spark.read.text(text_file(spark, _event_lines(spark, d))))


@query("s02_gzip_lines", _EVENTS)
def gzip_lines(spark, d):
    return _parsed(spark.read.text(text_file(spark, _event_lines(spark, d), "gzip")))


@query("s06_ncbi_gff3", f"WITH {EXON} SELECT 'T' || tran_idx AS tran_id, CAST(tran_idx AS VARCHAR) AS gene_id, start_pos, row_number() OVER ({UPW}) - 1 AS index FROM exon")
def ncbi_gff3(spark, d):
    """mRNA rows with a GeneID in Dbxref; parents may come after their children."""
    e = exons(spark, d)
    t = e.groupBy("tran_idx", "chrom", "strand").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    tid = F.col("tran_idx").cast("string")
    line = lambda kind, attrs: F.concat_ws("\t", "chrom", F.lit("BestRefSeq"), F.lit(kind), (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value")
    rows = e.select(line("exon", F.concat(F.lit("ID=exon-"), tid, F.lit(";Parent=rna-"), tid)))
    rows = rows.unionByName(t.select(line("mRNA", F.concat(F.lit("ID=rna-"), tid, F.lit(";Parent=gene-"), tid, F.lit(";transcript_id=T"), tid))))
    rows = rows.unionByName(t.select(line("gene", F.concat(F.lit("ID=gene-"), tid, F.lit(";Dbxref=HGNC:1,GeneID:"), tid, F.lit(";gene_biotype=protein_coding"))))).unionByName(spark.createDataFrame([("###",), ("# x",)], "value string"))
    t = gff.tables(spark.read.text(text_file(spark, rows)))
    tran = t["transcripts"].select("tran_idx", F.col("id").alias("tran_id"), "gene_idx")
    return t["exons"].join(tran, "tran_idx").join(t["genes"].select("gene_idx", F.col("id").alias("gene_id")), "gene_idx").select("tran_id", "gene_id", "start_pos", "index")


_HEAD = ("##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="x">', '##INFO=<ID=AF,Number=A,Type=Float,Description="x">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">',
         '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2")


def vcf_path(spark, d):
    n = lambda c: F.col(c).cast("string")
    sample = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "0/1").otherwise("1|1"), F.lit(":"), n(c), F.lit(","), n("l_linenumber"))
    info = F.concat(F.when(F.col("l_linenumber") > 2, F.concat(F.lit("DP="), n("l_partkey"))).otherwise("DP=."), F.when(F.col("l_linenumber") % 2 == 0, ";DB").otherwise(""))
    row = F.concat_ws("\t", F.lit("chr1"), n("l_partkey"), F.concat(F.lit("rs"), n("l_orderkey")), F.lit("A"), F.lit("C"), F.lit("."), F.lit("."), info, F.lit("GT:AD"), sample("l_partkey"), sample("l_suppkey"))
    head = spark.createDataFrame([(x,) for x in _HEAD], "value string")
    return text_file(spark, head.unionByName(table(spark, d, "lineitem").select(row.alias("value"))))


_DP = "CASE WHEN l_linenumber > 2 THEN l_partkey ELSE -1 END"


@query("s08_vcf", f"SELECT 'rs' || l_orderkey AS id, l_partkey - 1 AS start_pos, CAST({_DP} AS INTEGER) AS dp, l_linenumber % 2 = 0 AS db FROM lineitem")
def read_vcf(spark, d):
    return vcf.read(spark, vcf_path(spark, d), {"DP": -1, "DB": None}).select("id", "start_pos", F.col("DP").alias("dp"), F.col("DB").alias("db"))


@query("s09_vcf_cache", f"SELECT 'rs' || l_orderkey AS id, CAST({_DP} AS INTEGER) AS dp FROM lineitem")
def vcf_cache(spark, d):
    """The second call reads what the first one built."""
    path, folder = vcf_path(spark, d), store.scratch(spark)
    build = lambda: vcf.read(spark, path, {"DP": -1})
    for _ in range(2):
        out = store.cached(spark, [path], {"info": ["DP"]}, folder, "variants", build)
    return out.select("id", F.col("DP").alias("dp"))


@query("c01_header", "SELECT * FROM (VALUES ('AD', 'FORMAT', 'R', 'int'), ('AF', 'INFO', 'A', 'float'), ('DB', 'INFO', '0', 'boolean'), ('DP', 'INFO', '1', 'int'), ('GT', 'FORMAT', '1', 'string')) t(id, kind, number, type)")
def header(spark, d):
    info, fmt, _ = vcf.header(spark, vcf_path(spark, d))
    rows = [(k, kind, n, t) for kind, of in (("INFO", info), ("FORMAT", fmt)) for k, (n, t) in of.items()]
    return spark.createDataFrame(rows, "id string, kind string, number string, type string")


@query("c02_defaults", "SELECT 'rs' || l_orderkey AS id, CAST(CASE WHEN l_linenumber > 2 THEN l_partkey ELSE 7 END AS INTEGER) AS dp FROM lineitem")
def defaults(spark, d):
    return vcf.read(spark, vcf_path(spark, d), {"DP": 7}).select("id", F.col("DP").alias("dp"))


@query("c10_info", f"SELECT CAST({_DP} AS INTEGER) AS dp, count(*) AS n FROM lineitem GROUP BY 1")
def info(spark, d):
    return vcf.read(spark, vcf_path(spark, d), {"DP": -1}).groupBy(F.col("DP").alias("dp")).agg(F.count(F.lit(1)).alias("n"))


@query("c13_samples", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 's1'), (1, 's2')) t(i, name)")
def samples(spark, d):
    return spark.createDataFrame(list(enumerate(vcf.sample_names(spark, vcf_path(spark, d)))), "i long, name string")


@query("c14_id", "SELECT 'rs' || l_orderkey AS rs FROM lineitem")
def ids(spark, d):
    return vcf.read(spark, vcf_path(spark, d), ["ID"]).select(F.col("ID").alias("rs"))


_GTS = "CAST(CASE WHEN {} % 2 = 0 THEN 1 ELSE 2 END AS TINYINT)"


@query("c15_genotypes", f"SELECT 'rs' || l_orderkey AS id, unnest([{_GTS.format('l_partkey')}, {_GTS.format('l_suppkey')}]) AS gt, unnest([CAST(l_partkey AS INTEGER), CAST(l_suppkey AS INTEGER)]) AS ref_depth FROM lineitem")
def genotypes(spark, d):
    t = vcf.read(spark, vcf_path(spark, d), (), ["GT", "AD"])
    return t.select("id", F.explode("samples").alias("s")).select("id", F.col("s.GT").alias("gt"), F.col("s.AD")[0].alias("ref_depth"))


def sam_path(spark, d):
    n = lambda c: F.col(c).cast("string")
    cigar = F.concat(n("left_len"), F.lit("M"), n("skip"), F.lit("N"), n("right_len"), F.lit("M"))
    row = F.concat_ws("\t", F.lit("r"), F.lit("0"), "chrom", (F.col("pos") + 1).cast("string"), F.lit("255"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    head = spark.createDataFrame([("@HD\tVN:1.6",)], "value string")
    return text_file(spark, head.unionByName(relation(spark, d, "reads").select(row.alias("value"))))


# Reads with sequences: the left part, a gap, the right part and, in some, an insertion, a deletion and a base more.
# The reference is ACGT again and again; every 17th and 13th base differs, as far as it isn't the reference's.
_REF = "['A', 'C', 'G', 'T'][CAST(p % 4 + 1 AS BIGINT)]"
_SEEN = f"""{cte('reads')}, n AS (SELECT row_number() OVER () AS id, * FROM reads WHERE (flag & 3332) = 0),
l AS (SELECT id, chrom, 0 AS match, pos + unnest(range(0, left_len)) AS p, left_len AS k FROM n), lv AS (SELECT id, chrom, match, p, {_REF} AS ref, 'N' AS alt FROM l WHERE (p + k) % 17 = 0),
r AS (SELECT id, chrom, 1 AS match, pos + left_len + skip + unnest(range(0, right_len)) AS p, right_len AS k FROM n), rv AS (SELECT id, chrom, match, p, {_REF} AS ref, 'T' AS alt FROM r WHERE (p + k) % 13 = 0 AND p % 4 <> 3),
e AS (SELECT id, chrom, 1 AS match, pos + left_len + skip + right_len AS p FROM n WHERE right_len % 2 = 0), dv AS (SELECT id, chrom, match, p, {_REF} || {_REF.replace('p % 4', '(p + 1) % 4')} AS ref, '' AS alt FROM e), iv AS (SELECT id, chrom, match, p, '' AS ref, 'GGT' AS alt FROM e),
v AS (SELECT * FROM lv UNION ALL SELECT * FROM rv UNION ALL SELECT * FROM dv UNION ALL SELECT * FROM iv)"""


def sequenced(spark, d) -> dict:
    """The four tables of a SAM file with sequences, and what they are made from."""
    from strandlake.operators import dna

    n = lambda c: F.col(c).cast("string")
    r = relation(spark, d, "reads").withColumn("e", F.col("pos") + F.col("left_len") + F.col("skip") + F.col("right_len"))
    letter = lambda p: F.element_at(F.array(*(F.lit(b) for b in "ACGT")), (p % 4 + 1).cast("int"))

    def part(at, k, every, alt):
        """The bases from `at` on, with alt where place and length add up to a multiple of `every`: they repeat after 4 * every."""
        lines = ["".join(alt if (p + i) % every == 0 else "ACGT"[p % 4] for p in range(4 * every)) for i in range(every)]
        line = F.element_at(F.array(*(F.lit(x) for x in lines)), (F.col(k) % every + 1).cast("int"))
        return F.substring(F.repeat(line, (F.col(k) / (4 * every) + 2).cast("int")), (at % (4 * every) + 1).cast("int"), F.col(k).cast("int"))

    more = F.col("right_len") % 2 == 0
    cigar = F.concat(n("left_len"), F.lit("M"), n("skip"), F.lit("N"), n("right_len"), F.lit("M"), F.when(more, "3I2D1M").otherwise(""))
    seq = F.concat(part(F.col("pos"), "left_len", 17, "N"), part(F.col("e") - F.col("right_len"), "right_len", 13, "T"), F.when(more, F.concat(F.lit("GGT"), letter(F.col("e") + 2))).otherwise(""))
    row = F.concat_ws("\t", F.lit("r"), n("flag"), "chrom", (F.col("pos") + 1).cast("string"), F.lit("255"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*"))
    reads = sam.read(spark, text_file(spark, r.select(row.alias("value")))).withColumn("read_id", F.monotonically_increasing_id())
    path = store.scratch(spark)
    reads.write.parquet(path)  # numbers stay what they are
    chroms = spark.createDataFrame([(f"chr{i}", "ACGT" * 600) for i in range(1, 6)], "chrom string, seq string")
    sizes = chroms.select("chrom", F.length("seq").cast("long").alias("size"))
    return sam.tables(spark.read.parquet(path), dna.chunked(chroms, 256), sizes, size=256)


@query("s10_sam", f"""{_SEEN}, t AS (SELECT 'alignments' AS kind, chrom FROM n UNION ALL SELECT 'matches', chrom FROM n UNION ALL SELECT 'matches', chrom FROM n UNION ALL SELECT 'junctions', chrom FROM n UNION ALL SELECT 'variants', chrom FROM v)
SELECT kind, chrom, count(*) AS n FROM t GROUP BY 1, 2""")
def sam_tables(spark, d):
    """Alignments, matches, junctions and variants of reads."""
    t = [t.select(F.lit(k).alias("kind"), "chrom") for k, t in sequenced(spark, d).items()]
    return t[0].unionByName(t[1]).unionByName(t[2]).unionByName(t[3]).groupBy("kind", "chrom").agg(F.count(F.lit(1)).alias("n"))


@query("r07_substitutions", f"{_SEEN} SELECT chrom, p AS pos, ref, alt, count(*) AS n FROM v GROUP BY 1, 2, 3, 4")
def substitutions(spark, d):
    """Substitutions, insertions and deletions of reads, against the reference."""
    return sequenced(spark, d)["variants"].groupBy("chrom", F.col("start_pos").alias("pos"), "ref", "alt").agg(F.count(F.lit(1)).alias("n"))


@query("j23_links", f"{_SEEN}, a AS (SELECT id, match, count(*) AS n_variants FROM v GROUP BY 1, 2) SELECT n.chrom, CAST(match AS BIGINT) AS match, n_variants, count(*) AS n FROM a JOIN n USING (id) GROUP BY 1, 2, 3")
def links(spark, d):
    """From alignments over their matches to variants: how many variants a match has."""
    t = sequenced(spark, d)
    # counted by match before they are linked: a row a match, not a variant, is shuffled
    count = t["variants"].groupBy("read_id", "match").agg(F.count(F.lit(1)).alias("n_variants"))
    linked = t["alignments"].select("read_id", "chrom").join(t["matches"].select("read_id", "match"), "read_id").join(count, ["read_id", "match"])
    return linked.groupBy("chrom", "match", "n_variants").agg(F.count(F.lit(1)).alias("n"))


@query("r08_read_length", f"{cte('reads')} SELECT count(*) AS n FROM reads WHERE left_len % 3 <> 0")
def read_length(spark, d):
    """Sequences of another length than their CIGAR asks for are an error; here such are left out before."""
    r = relation(spark, d, "reads").select(F.concat(F.col("left_len").cast("string"), F.lit("M")).alias("cigar"), F.when(F.col("left_len") % 3 == 0, "A").otherwise(F.repeat(F.lit("A"), F.col("left_len").cast("int"))).alias("seq"), "left_len")
    fine = rd.with_whole_sequence(r.where("left_len % 3 <> 0"))
    return fine.where("length(seq) = left_len").agg(F.count(F.lit(1)).alias("n"))


def alleles_path(spark, d):
    """A VCF with two alleles in every second row."""
    n = lambda c: F.col(c).cast("string")
    two = F.col("l_linenumber") % 2 == 0
    info = F.concat(F.lit("DP=3;AF="), n("l_partkey"), F.when(two, F.concat(F.lit(","), n("l_suppkey"))).otherwise(""), F.lit(";DB"))
    gt = F.when(two, F.when(F.col("l_partkey") % 3 == 0, "1|2").otherwise("1/2")).otherwise("0/1")
    ad = F.concat_ws(",", n("l_linenumber"), n("l_partkey"), F.when(two, n("l_suppkey")))
    sample = F.concat_ws(":", gt, ad)
    row = F.concat_ws("\t", F.lit("chr1"), n("l_partkey"), F.concat(F.lit("rs"), n("l_orderkey")), F.lit("G"), F.when(two, "A,C").otherwise("T"), F.lit("."), F.lit("."), info, F.lit("GT:AD"), sample, F.lit("./.:."))
    return text_file(spark, spark.createDataFrame([(x,) for x in _HEAD], "value string").unionByName(table(spark, d, "lineitem").select(row.alias("value"))))


@query("c16_split_alleles", """WITH a AS (SELECT 'rs' || l_orderkey AS id, l_linenumber % 2 = 0 AS two, * FROM lineitem), b AS (
SELECT id, CASE WHEN two THEN 'A' ELSE 'T' END AS alt, l_partkey AS af, CASE WHEN two AND l_partkey % 3 = 0 THEN 5 ELSE 1 END AS gt, l_linenumber AS rd, l_partkey AS ad FROM a
UNION ALL SELECT id, 'C', l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 4 ELSE 1 END, l_linenumber, l_suppkey FROM a WHERE two)
SELECT id, alt, CAST(af AS FLOAT) AS af, CAST(gt AS TINYINT) AS gt, CAST(rd AS INTEGER) AS ref_depth, CAST(ad AS INTEGER) AS alt_depth FROM b""")
def split_alleles(spark, d):
    """A row an ALT; values that go with the alleles follow theirs."""
    t = vcf.read(spark, alleles_path(spark, d), ["AF"], ["GT", "AD"], split=True)
    s = F.col("samples")[0]
    return t.select("id", "alt", F.col("AF").alias("af"), s["GT"].alias("gt"), s["AD"][0].alias("ref_depth"), s["AD"][1].alias("alt_depth"))


@query("c09_breakends", """SELECT 'rs' || l_orderkey AS id, l_partkey - CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS start_pos, l_partkey - CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS end_pos, '' AS ref,
CASE WHEN l_linenumber % 2 = 0 THEN '[chrUn_k:' || l_suppkey || '[' ELSE ']chrUn_k:' || l_suppkey || ']' END AS alt FROM lineitem""")
def breakends(spark, d):
    """Joined after, a breakend loses the base that it begins with; joined before, the one that it ends with. The mate's name stays as it is."""
    n = lambda c: F.col(c).cast("string")
    alt = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("A[chrUn_k:"), n("l_suppkey"), F.lit("["))).otherwise(F.concat(F.lit("]chrUn_k:"), n("l_suppkey"), F.lit("]a")))
    row = F.concat_ws("\t", F.lit("chr1"), n("l_partkey"), F.concat(F.lit("rs"), n("l_orderkey")), F.lit("A"), alt, F.lit("."), F.lit("."), F.lit("DB"))
    path = text_file(spark, spark.createDataFrame([(x,) for x in _HEAD], "value string").unionByName(table(spark, d, "lineitem").select(row.alias("value"))))
    return vcf.read(spark, path).select("id", "start_pos", "end_pos", "ref", "alt")


_GAPS = f"{cte('reads')} SELECT chrom, pos + left_len AS start_pos, pos + left_len + skip AS end_pos"


_SHIFTS = f"{cte('reads')}, g AS (SELECT chrom, pos + left_len AS start_pos, pos + left_len + skip AS end_pos, unnest([-left_len, right_len]) AS shift FROM reads)"


@query("s11_junctions", f"{_GAPS}, count(*) AS num_reads FROM reads WHERE left_len >= 4 AND right_len >= 4 GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def junctions(spark, d):
    gaps = rd.junctions(sam.read(spark, sam_path(spark, d))).withColumn("strand", rd.read_strand(F.col("flag")))
    return rd.collect_junctions(gaps, min_reads=2, min_overhang=4).select("chrom", "start_pos", "end_pos", "num_reads")


@query("s13_distribution_cache", f"{_SHIFTS} SELECT chrom, start_pos, end_pos, shift, count(*) AS count FROM g GROUP BY ALL")
def distribution_cache(spark, d):
    path, folder = sam_path(spark, d), store.scratch(spark)
    build = lambda: rd.distribution(rd.junctions(sam.read(spark, path)).withColumn("strand", F.lit("+")))
    for _ in range(2):
        out = store.cached(spark, [path], {}, folder, "distribution", build)
    return out.select("chrom", "start_pos", "end_pos", "shift", "count")


@query("s14_wig", "SELECT event_type AS chrom, event_id AS start_pos, event_id + 1 AS end_pos, CAST(user_id AS DOUBLE) AS value FROM events")
def wig(spark, d):
    """A section a chromosome; a file is read in order."""
    e = table(spark, d, "events").select("event_type", F.col("event_id"), F.concat_ws(" ", (F.col("event_id") + 1).cast("string"), F.col("user_id").cast("string")).alias("value"))
    head = e.groupBy("event_type").agg(F.lit(-1).cast("long").alias("event_id")).withColumn("value", F.concat(F.lit("variableStep chrom="), F.col("event_type")))
    rows = e.unionByName(head).repartition("event_type").sortWithinPartitions("event_type", "event_id").select("value")
    return signal.wig(spark, text_file(spark, rows)).drop("strand")


@query("s18_twobit", f"WITH {SEQ} SELECT chrom, length(seq) AS n, substr(seq, 1, 20) AS head FROM seq WHERE length(seq) > 0")
def read_twobit(spark, d):
    s = q_sequence.sequences(spark, d).where("length(seq) > 0").select("chrom", "seq")
    path = store.scratch(spark)
    twobit.write(s, path)
    chunks = twobit.read(spark, path, 1024)
    whole = chunks.groupBy("chrom").agg(F.sum(F.length("seq")).cast("long").alias("n"), F.min_by(F.substring("seq", 1, 20), "chunk").alias("head"))
    return whole


@query("s19_chrom_sizes", f"{cte('iv')} SELECT chrom, max(end_pos) AS size FROM iv GROUP BY 1")
def chrom_sizes(spark, d):
    rows = relation(spark, d, "iv").groupBy("chrom").agg(F.max("end_pos").alias("size"))
    return assembly.chrom_sizes(spark, text_file(spark, rows.select(F.concat_ws("\t", "chrom", F.col("size").cast("string")).alias("value"))))


@query("s21_appris", "SELECT CAST(o_orderkey AS VARCHAR) AS transcript_id, CAST(o_orderkey % 9 AS BIGINT) AS principality FROM orders WHERE o_orderkey % 9 < 7")
def appris(spark, d):
    label = F.element_at(F.array(*(F.lit(x) for x in (*assembly.PRINCIPALITY, "MINOR", "?"))), (F.col("o_orderkey") % 9 + 1).cast("int"))
    row = F.concat_ws("\t", F.lit("G"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("-"), label)
    return assembly.appris(spark, text_file(spark, table(spark, d, "orders").select(row.alias("value")))).select("transcript_id", F.col("principality").cast("long").alias("principality"))


@query("s22_mane", "SELECT CAST(c_custkey AS VARCHAR) AS gene, CASE WHEN c_custkey % 3 = 0 THEN 'MANE Plus Clinical' ELSE 'MANE Select' END AS status FROM customer")
def mane(spark, d):
    path = store.scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("#NCBI_GeneID"), F.when(F.col("c_custkey") % 3 == 0, "MANE Plus Clinical").otherwise("MANE Select").alias("MANE_status")).write.csv(path, sep="\t", header=True, compression="gzip")
    return assembly.mane(spark, path).select(F.col("#NCBI_GeneID").alias("gene"), F.col("MANE_status").alias("status"))


@query("s23_parquet_objects", f"{cte('iv')} SELECT chrom AS chromosome, strand, CAST(start_pos AS INTEGER) AS first, CAST(end_pos AS INTEGER) AS last FROM iv")
def parquet_objects(spark, d):
    """Intervals as struct columns, alone and in lists, through Parquet and back."""
    from strandlake.functions.intervals import Iv

    iv = relation(spark, d, "iv").select(Iv.of().struct().alias("interval"), F.array(Iv.of().struct()).alias("list"))
    path = store.scratch(spark)
    iv.write.parquet(path)
    return spark.read.parquet(path).select(F.col("list")[0].alias("x")).select("x.chromosome", "x.strand", F.col("x.start").alias("first"), F.col("x.end").alias("last"))


QUERIES["k07_parquet_objects"], ORACLE["k07_parquet_objects"] = parquet_objects, ORACLE["s23_parquet_objects"]


def _kept(name: str, kind: str, frame, sql: str) -> None:
    """A table written with its format version and read again."""

    def through(spark, d):
        path = store.scratch(spark)
        store.write_table(frame(spark, d), path, kind)
        return store.read_table(spark, path, kind)

    QUERIES[name], ORACLE[name] = through, sql


_kept("k01_table", "annotation", lambda s, d: relation(s, d, "iv").select("part", "chrom", "strand", "start_pos", "end_pos"), f"{cte('iv')} SELECT part, chrom, strand, start_pos, end_pos FROM iv")
_kept("k02_annotation", "annotation", lambda s, d: q_annotation.introns(s, d), q_annotation.ORACLE["w05_introns"])
_kept("k03_variants", "variants", lambda s, d: q_sequence.variants(s, d), q_sequence.ORACLE["v01_construct"].replace("start_pos, start_pos + length(ref) AS end_pos,", "start_pos,"))
_kept("k04_track", "track", lambda s, d: relation(s, d, "blocks"), f"{cte('blocks')} SELECT chrom, start_pos, end_pos, value, block FROM blocks")
QUERIES["k05_twobit"], ORACLE["k05_twobit"] = read_twobit, ORACLE["s18_twobit"]


# -- catalog, strandedness, extension points -------------------------------------------------


def genome(spark, d) -> Genome:
    root = store.scratch(spark)
    chrom_sizes(spark, d).write.parquet(f"{root}/hg19/chrom_sizes")
    q_annotation.aliases(spark, d).write.parquet(f"{root}/hg19/chrom_aliases")
    return Genome(spark, root, "hg19")


@query("g01_genome", f"{cte('iv')} SELECT chrom, max(end_pos) AS size FROM iv GROUP BY 1")
def open_genome(spark, d):
    """Tables are opened when they are asked for."""
    return genome(spark, d).chromosomes


@query("g07_mane_transcripts", "SELECT 'NM_' || o_orderkey || '.1' AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def mane_transcripts(spark, d):
    """Transcripts of MANE Select, whatever their versions, through the genome's tables."""
    root = store.scratch(spark)
    name = lambda a, c, v: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(v))
    table(spark, d, "orders").select(name("NM_", "o_orderkey", ".1").alias("id")).write.parquet(f"{root}/hg19/transcripts")
    status = F.when(F.col("l_returnflag") == "A", "MANE Select").otherwise("MANE Plus Clinical")
    table(spark, d, "lineitem").select(name("NM_", "l_orderkey", ".2").alias("RefSeq_nuc"), name("ENST", "l_orderkey", ".3").alias("Ensembl_nuc"), status.alias("MANE_status")).write.parquet(f"{root}/hg19/mane")
    return Genome(spark, root, "hg19").mane_transcripts()


@query("t24_wig_rules", """WITH e AS (SELECT event_type AS chrom, event_id AS id, user_id AS v FROM events), l AS (SELECT chrom, max(id) AS last FROM e GROUP BY 1)
SELECT chrom, id * 5 AS start_pos, id * 5 + CASE WHEN id = last THEN 3 ELSE 5 END AS end_pos, CAST(v AS DOUBLE) AS value FROM e JOIN l USING (chrom)""")
def wig_rules(spark, d):
    """Spans of the track's resolution, but for a shorter one at each chromosome's end."""
    from pyspark.sql import Window

    last = F.max("event_id").over(Window.partitionBy("event_type"))
    e = table(spark, d, "events").select("event_type", "event_id", "user_id", last.alias("last"))
    row = F.concat_ws(" ", (F.col("event_id") * 5 + 1).cast("string"), F.col("user_id").cast("string"))
    head = lambda span: F.concat(F.lit("variableStep chrom="), F.col("event_type"), F.lit(f" span={span}"))
    place = lambda x: F.lit(x).cast("long").alias("place")
    rows = e.select("event_type", F.col("event_id"), place(1), row.alias("value"))
    heads = e.where("event_id = last").select("event_type", F.col("event_id"), place(0), head(3).alias("value"))
    first = e.where("event_id < last").groupBy("event_type").agg(F.lit(-1).cast("long").alias("event_id")).select("event_type", "event_id", place(0), head(5).alias("value"))
    lines = rows.unionByName(heads).unionByName(first).repartition("event_type").sortWithinPartitions("event_type", "event_id", "place").select("value")
    return signal.wig(spark, text_file(spark, lines), resolution=5).drop("strand")


QUERIES["g02_lazy_tables"], ORACLE["g02_lazy_tables"] = open_genome, ORACLE["g01_genome"]


@query("g03_shorthands", "SELECT n_nationkey AS id, 'Interval(\"' || n_name || '\", \"+\", ' || n_nationkey || ', ' || (n_nationkey + 5) || ', \"hg19\")' AS shown FROM nation")
def shorthands(spark, d):
    from strandlake.functions.intervals import Iv

    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), Iv.from_dna0("n_name", F.lit("+"), "n_nationkey", F.col("n_nationkey") + 5).text().alias("shown"))


@query("r11_strandedness", "SELECT * FROM (VALUES ('U', FALSE), ('ISF', TRUE), ('ISR', TRUE), ('annotated', TRUE)) t(library, stranded)")
def strandedness(spark, d):
    return spark.createDataFrame([(x,) for x in ("U", "ISF", "ISR", "annotated")], "library string").select("library", (F.col("library").endswith("SF") | F.col("library").endswith("SR") | (F.col("library") == "annotated")).alias("stranded"))


@query("r12_variants_per_read", f"{cte('reads')} SELECT chrom, pos, left_len * 20 AS variants FROM reads WHERE left_len * 20 > 255")
def variants_per_read(spark, d):
    """Reads with more variants than a byte counts stay: there is no such limit here."""
    return relation(spark, d, "reads").select("chrom", "pos", (F.col("left_len") * 20).alias("variants")).where("variants > 255")


@query("r13_pooled", f"{_SHIFTS} SELECT chrom, start_pos, end_pos, shift, 2 * count(*) AS count FROM g GROUP BY ALL")
def pooled(spark, d):
    """Two files pooled; those of another assembly or strandedness would raise."""
    g = q_reads.gaps(spark, d).withColumn("refg", F.lit("hg19"))
    one = F.when(F.col("refg") == "hg19", F.col("chrom")).otherwise(F.raise_error(F.lit("assemblies are mixed")).cast("string"))
    both = g.unionByName(g).withColumn("chrom", one).withColumn("strand", F.lit("+"))
    return rd.distribution(both).select("chrom", "start_pos", "end_pos", "shift", "count")


@query("u01_pass_filter", f"{cte('reads')} SELECT chrom, pos, left_len FROM reads WHERE left_len > right_len")
def pass_filter(spark, d):
    """A caller's Python predicate, in Arrow batches."""
    from pyspark.sql.types import BooleanType

    keep = F.pandas_udf(lambda left, right: left > right, BooleanType())
    return relation(spark, d, "reads").where(keep("left_len", "right_len")).select("chrom", "pos", "left_len")


@query("u04_struct_columns", "SELECT c_custkey AS id, c_name AS name FROM customer")
def struct_columns(spark, d):
    """Objects are structs: no function has to pack or unpack them."""
    t = table(spark, d, "customer").select(F.struct("c_custkey", "c_name").alias("gene"))
    return t.select(F.col("gene.c_custkey").alias("id"), F.col("gene.c_name").alias("name"))


@query("w12_first_block", f"{cte('blocks')}, j AS (SELECT DISTINCT chrom, start_pos // 8192 AS jump FROM blocks) SELECT j.chrom, j.jump, min(b.start_pos) AS start_pos FROM j JOIN blocks b ON b.chrom = j.chrom AND b.end_pos >= j.jump * 8192 GROUP BY 1, 2")
def first_block(spark, d):
    """The first block that reaches each jump: the block itself or its forerunner, from one window."""
    b = relation(spark, d, "blocks").select("chrom", "start_pos", "end_pos", F.floor(F.col("start_pos") / 8192).alias("jump"))
    b = scanned(b, ["chrom"], ["start_pos"], [piece(F.col("start_pos"))], {"before": ("max", F.struct("start_pos", "end_pos"))})
    low = F.when(F.col("before.end_pos") >= F.col("jump") * 8192, F.col("before.start_pos")).otherwise(F.col("start_pos"))
    return b.withColumn("low", low).groupBy("chrom", "jump").agg(F.min("low").alias("start_pos"))


@query("t25_bed_categories", "SELECT event_id AS start_pos, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS DOUBLE) AS value FROM events")
def bed_categories(spark, d):
    n = lambda c: c.cast("string")
    rows = table(spark, d, "events").select(F.concat_ws("\t", F.lit("c"), n(F.col("event_id")), n(F.col("event_id") + 1), "event_type", F.lit("0"), F.lit(".")).alias("value"))
    return signal.bed_rows(spark.read.text(text_file(spark, rows)), ["click", "error", "purchase", "signup", "view"], stranded=False).select("start_pos", "value")


@query("t10_dictionary_check", "SELECT * FROM (VALUES ('finite', TRUE), ('falls', FALSE), ('short', FALSE)) t(name, fine)")
def dictionary_check(spark, d):
    def fine(values):
        try:
            return bool(tracks.check_dictionary(values, "f2"))
        except ValueError:
            return False

    return spark.createDataFrame([("finite", fine((0.0, 1.0, 2.0, float("nan")))), ("falls", fine((0.0, 2.0, 1.0, 3.0))), ("short", fine((0.0, 1.0)))], "name string, fine boolean")


# -- variant genomes -------------------------------------------------------------------------


@query("v13_alignment", f"""{_LONG.replace('SELECT doc_id AS q_id, ', '')} , b AS (SELECT doc_id AS q_id, unnest(range(40, doc_id % 30 + 50)) AS p FROM s),
k AS (SELECT q_id, p - 40 AS ref_pos, -1 AS ins FROM b WHERE p < 48 OR p >= 51 UNION ALL SELECT doc_id, 6, 0 FROM s UNION ALL SELECT doc_id, 6, 1 FROM s)
SELECT q_id, CAST(ref_pos AS BIGINT) AS ref_pos, CAST(ins AS BIGINT) AS ins FROM k""")
def alignment(spark, d):
    """In reference order, whatever the window's strand."""
    return va.variant_alignment(*q_sequence._variant_windows(spark, d, F.lit(None))).select("q_id", "ref_pos", "ins")


QUERIES["v15_variant_genome"], ORACLE["v15_variant_genome"] = q_sequence.QUERIES["v10_left_anchor"], q_sequence.ORACLE["v10_left_anchor"]
_MUT = "substr(seq, 41, 3) || 'N' || substr(seq, 45, 2) || 'GG' || substr(seq, 47, 2) || CASE WHEN doc_id % 30 + 50 > 51 THEN substr(seq, 52, CAST(doc_id % 30 + 50 - 51 AS BIGINT)) ELSE '' END"


@query("m02_variant_motif", f"""{_LONG.replace('SELECT doc_id AS q_id, ', '')} , m AS (SELECT doc_id AS q_id, doc_id % 2 AS minus, {_MUT} AS t FROM s), h AS (SELECT q_id, minus, unnest(range(1, length(t))) AS i, t FROM m), f AS (SELECT q_id, i - 1 + 2 * minus AS p FROM h WHERE substr(t, i, 2) = CASE WHEN minus = 1 THEN 'TC' ELSE 'GA' END)
SELECT q_id, CAST(40 + CASE WHEN p < 6 THEN p WHEN p < 8 THEN 6 WHEN p < 10 THEN p - 2 ELSE p + 1 END AS BIGINT) AS hit, CAST(CASE WHEN p = 7 THEN 1 ELSE 0 END AS BIGINT) AS anchor_offset FROM f""")
def variant_motif(spark, d):
    """Hits in changed sequences of both strands, in reference coordinates."""
    return va.variant_motif(*q_sequence._variant_windows(spark, d, F.lit(None)), "GA", overlapping=True)
