"""Registered queries of positional lookups, other joins, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.operators import rangejoin as rj
from strandlake.operators import variants as va
from strandlake.operators.scan import piece, ranked

from .relations import cte, relation, table

QUERIES: dict = {}
ORACLE: dict = {}
_SHOWN = ("q_id", "chrom", "strand", "start_pos", "end_pos")
_SQL_SHOWN = ", ".join(_SHOWN)
_SAME = "chrom = q_chrom AND strand = q_strand"
P = "strand = '+'"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


_LOOKUPS = {
    "j01_find_overlapping": (rj.find_overlapping, "start_pos < q_end AND q_start < end_pos"),
    "j02_find_within": (rj.find_within, f"start_pos >= q_start AND end_pos <= q_end AND CASE WHEN {P} THEN end_pos > q_start ELSE start_pos < q_end END"),
    "j03_find_5p_within": (rj.find_5p_within, f"CASE WHEN {P} THEN start_pos ELSE end_pos - 1 END >= q_start AND CASE WHEN {P} THEN start_pos ELSE end_pos - 1 END < q_end"),
    "j04_find_3p_within": (rj.find_3p_within, f"CASE WHEN {P} THEN end_pos - 1 ELSE start_pos END >= q_start AND CASE WHEN {P} THEN end_pos - 1 ELSE start_pos END < q_end"),
    "j05_find_5p_aligned": (rj.find_5p_aligned, f"CASE WHEN {P} THEN start_pos ELSE end_pos END = CASE WHEN {P} THEN q_start ELSE q_end END"),
    "j06_find_3p_aligned": (rj.find_3p_aligned, f"CASE WHEN {P} THEN end_pos ELSE start_pos END = CASE WHEN {P} THEN q_end ELSE q_start END"),
    "j07_find_exact": (rj.find_exact, "start_pos = q_start AND end_pos = q_end"),
}
for _name, (_f, _sql) in _LOOKUPS.items():
    QUERIES[_name] = lambda spark, d, f=_f: f(relation(spark, d, "iv"), relation(spark, d, "q")).select(*_SHOWN)
    ORACLE[_name] = f"{cte('iv', 'q')} SELECT {_SQL_SHOWN} FROM iv JOIN q ON {_SAME} AND {_sql}"


@query("j01_unstranded", f"{cte('iv', 'q')} SELECT {_SQL_SHOWN} FROM iv JOIN q ON chrom = q_chrom AND strand = '+' AND start_pos < q_end AND q_start < end_pos")
def unstranded(spark, d):
    """An unstranded table lies on the plus strand and takes every query there."""
    return rj.find_overlapping(relation(spark, d, "iv").where("strand = '+'"), relation(spark, d, "q"), stranded=False).select(*_SHOWN)


@query("j08_tree", "SELECT c_custkey AS gene_idx, count(DISTINCT o_orderkey) AS n_transcripts, count(l_orderkey) AS n_exons FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def tree(spark, d):
    """Gene, transcripts, exons; exons are summed a transcript before they meet the genes."""
    exons = relation(spark, d, "iv").groupBy("tran_idx").agg(F.count(F.lit(1)).alias("n"))
    trans = relation(spark, d, "tran").join(exons, "tran_idx", "left").groupBy("gene_idx").agg(F.count(F.lit(1)).alias("t"), F.sum(F.coalesce("n", F.lit(0))).alias("x"))
    zero = F.lit(0).cast("long")
    return relation(spark, d, "gene").join(trans, "gene_idx", "left").select("gene_idx", F.coalesce("t", zero).alias("n_transcripts"), F.coalesce("x", zero).alias("n_exons"))


@query("j09_exon_cds", f"{cte('iv')}, exon AS (SELECT DISTINCT tran_idx, line, part FROM iv), cds AS (SELECT DISTINCT tran_idx, line, part FROM iv WHERE quantity > 25) SELECT exon.tran_idx, exon.line, exon.part, cds.part IS NOT NULL AS has_cds FROM exon LEFT JOIN cds USING (tran_idx, line, part)")
def exon_cds(spark, d):
    key = ["tran_idx", "line", "part"]
    iv = relation(spark, d, "iv")
    exon = iv.groupBy(*key).agg(F.bool_or(F.col("quantity") > 25).alias("has_cds"))  # one side holds the other: no join is needed
    return exon.select(*key, "has_cds")


_IDS = "SELECT c_name || '.' || (c_custkey % 3) AS id, c_custkey AS row_idx FROM customer"


@query("j10_lookup_by_id", f"WITH t AS ({_IDS}), k AS (SELECT DISTINCT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS key FROM orders) SELECT key, min(row_idx) AS row_idx FROM k JOIN t ON id = key OR starts_with(id, key || '.') GROUP BY key")
def lookup_by_id(spark, d):
    """A versioned id is found by itself or by any prefix up to a dot; the first row wins."""
    from strandlake.operators.annotation import lookup

    t = table(spark, d, "customer").select(F.concat("c_name", F.lit("."), (F.col("c_custkey") % 3).cast("string")).alias("id"), F.col("c_custkey").alias("row_idx"))
    keys = table(spark, d, "orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("key")).distinct()
    return lookup(t, keys).select("key", "row_idx")


@query("j11_find_by_id", f"WITH t AS ({_IDS}) SELECT id, row_idx FROM t WHERE id = 'Customer#000000007' OR starts_with(id, 'Customer#000000007' || '.')")
def find_by_id(spark, d):
    key = "Customer#000000007"
    t = table(spark, d, "customer").select(F.concat("c_name", F.lit("."), (F.col("c_custkey") % 3).cast("string")).alias("id"), F.col("c_custkey").alias("row_idx"))
    return t.where((F.col("id") == key) | F.col("id").startswith(key + "."))


@query("j12_accession_join", "SELECT o_orderkey AS tran_idx, c_name AS gene_name FROM orders JOIN customer ON o_custkey = c_custkey")
def accession_join(spark, d):
    """Missing or repeated accessions are an error: the outer side's count is checked per key."""
    links = relation(spark, d, "gene").groupBy("gene_idx").agg(F.first("name").alias("gene_name"), F.count(F.lit(1)).alias("n"))
    both = relation(spark, d, "tran").join(links, "gene_idx", "left")
    wrong = F.raise_error(F.lit("a transcript's accession is missing or repeated")).cast("string")
    return both.select("tran_idx", F.when(F.col("n") == 1, F.col("gene_name")).otherwise(wrong).alias("gene_name"))


@query("j13_cds_to_exon", f"{cte('iv')}, cds AS (SELECT tran_idx, line, part, chrom, strand, start_pos + 2 AS cs, end_pos - 2 AS ce FROM iv WHERE end_pos - start_pos > 8) SELECT c.tran_idx, c.cs AS start_pos, c.ce AS end_pos, count(*) AS n_exons FROM cds c JOIN iv i ON c.tran_idx = i.tran_idx AND c.chrom = i.chrom AND c.strand = i.strand AND c.cs >= i.start_pos AND c.ce <= i.end_pos GROUP BY 1, 2, 3")
def cds_to_exon(spark, d):
    """Exons of the same transcript that contain the coding piece."""
    iv = relation(spark, d, "iv")
    cds = iv.where("end_pos - start_pos > 8").select("tran_idx", "chrom", "strand", (F.col("start_pos") + 2).alias("cs"), (F.col("end_pos") - 2).alias("ce"))
    both = cds.join(iv, ["tran_idx", "chrom", "strand"]).where("cs >= start_pos AND ce <= end_pos")
    return both.groupBy("tran_idx", F.col("cs").alias("start_"), F.col("ce").alias("end_")).agg(F.count(F.lit(1)).alias("n_exons")).select("tran_idx", F.col("start_").alias("start_pos"), F.col("end_").alias("end_pos"), "n_exons")


@query("j14_parent_join", "SELECT o_orderkey AS tran_idx, c_mktsegment AS type, l_linenumber AS line FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def parent_join(spark, d):
    """Gene, transcript and element by Parent = ID; a transcript takes its gene's biotype."""
    iv = relation(spark, d, "iv").select("tran_idx", "line")
    tran = relation(spark, d, "tran").select("tran_idx", "gene_idx")
    return iv.join(tran.join(relation(spark, d, "gene").select("gene_idx", "type"), "gene_idx"), "tran_idx").select("tran_idx", "type", "line")


@query("j15_within_cluster", f"""{cte("iv")}, t AS (SELECT tran_idx, chrom, strand, min(start_pos) AS s, max(end_pos) AS e FROM iv GROUP BY 1, 2, 3),
g AS (SELECT chrom, strand, s // 10000 AS c, min(s) AS gs, max(s) + 3000 AS ge FROM t GROUP BY 1, 2, 3)
SELECT tran_idx, t.chrom, t.strand, c AS cluster FROM t JOIN g ON t.chrom = g.chrom AND t.strand = g.strand AND s >= gs AND e <= ge AND CASE WHEN t.strand = '+' THEN e > gs ELSE s < ge END""")
def within_cluster(spark, d):
    t = relation(spark, d, "iv").groupBy("tran_idx", "chrom", "strand").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    g = t.groupBy(F.col("chrom").alias("q_chrom"), F.col("strand").alias("q_strand"), F.floor(F.col("start_pos") / 10000).alias("cluster")).agg(F.min("start_pos").alias("q_start"), (F.max("start_pos") + 3000).alias("q_end"))
    return rj.find_within(t, g, width=1 << 14).select("tran_idx", "chrom", "strand", "cluster")


_ALLOW = "SELECT q_chrom, q_strand, q_start, q_end FROM q WHERE q_id % 3 = 0"
_EXCLUDE = "SELECT q_chrom, q_strand, q_start, q_end FROM q WHERE q_id % 50 = 1"


@query("j16_allow_exclude", f"""{cte("iv", "q")}, a AS ({_ALLOW}), x AS ({_EXCLUDE}) SELECT tran_idx, part, line, chrom, strand, start_pos, end_pos, quantity FROM iv
WHERE NOT EXISTS (SELECT 1 FROM x WHERE {_SAME} AND start_pos < q_end AND q_start < end_pos) AND EXISTS (SELECT 1 FROM a WHERE {_SAME} AND start_pos < q_end AND q_start < end_pos)""")
def allow_exclude(spark, d):
    q = relation(spark, d, "q")
    return rj.allow_exclude(relation(spark, d, "iv"), q.where("q_id % 3 = 0"), q.where("q_id % 50 = 1"))


@query("j17_strand_inference", f"""{cte("reads", "iv")}, r AS (SELECT chrom, pos + left_len AS js, pos + left_len + skip AS je FROM reads), u AS (SELECT DISTINCT chrom, js, je FROM r),
s AS (SELECT u.chrom, js, je, bool_or(strand = '+') AS p, bool_or(strand = '-') AS m FROM u JOIN iv ON iv.chrom = u.chrom AND start_pos < je AND js < end_pos GROUP BY 1, 2, 3)
SELECT r.chrom, r.js, r.je, CASE WHEN p AND NOT m THEN '+' WHEN m AND NOT p THEN '-' END AS inferred FROM r LEFT JOIN s ON s.chrom = r.chrom AND s.js = r.js AND s.je = r.je""")
def strand_inference(spark, d):
    """The strand whose introns a gap meets; null where none or both do."""
    from strandlake.operators import reads as rd

    gaps = relation(spark, d, "reads").select("chrom", (F.col("pos") + F.col("left_len")).alias("start_pos"), (F.col("pos") + F.col("left_len") + F.col("skip")).alias("end_pos"))
    return rd.inferred_strand(gaps, relation(spark, d, "iv")).select("chrom", F.col("start_pos").alias("js"), F.col("end_pos").alias("je"), "inferred")


@query("j18_sequence_variations", f"""{cte("iv", "q")}, v AS (SELECT chrom, start_pos, start_pos + quantity % 4 AS end_pos, part FROM iv), w AS (SELECT q_id, q_chrom, q_start, q_end FROM q)
SELECT DISTINCT q_id, chrom, start_pos, end_pos, part FROM v JOIN w ON chrom = q_chrom AND (start_pos < q_end AND q_start < end_pos OR start_pos = q_start AND end_pos = start_pos)""")
def sequence_variations(spark, d):
    """Variants that overlap a window, and insertions at its 5' end."""
    v = relation(spark, d, "iv").select("chrom", "start_pos", F.repeat(F.lit("A"), (F.col("quantity") % 4).cast("int")).alias("ref"), F.lit("").alias("alt"), "part")
    w = relation(spark, d, "q").select("q_id", F.col("q_chrom").alias("chrom"), F.col("q_start").alias("start_pos"), F.col("q_end").alias("end_pos"), F.lit(None).cast("long").alias("anchor"))
    return va.sequence_variations(w, v).select("q_id", "chrom", "start_pos", (F.col("start_pos") + F.length("ref")).alias("end_pos"), "part").distinct()


_DEL = "v AS (SELECT chrom, start_pos, start_pos + quantity % 4 AS end_pos, part FROM iv)"
_GROWS = "chrom = q_chrom AND start_pos < hi AND end_pos > lo"


@query("j18_anchored", f"""WITH RECURSIVE {cte("iv", "q").removeprefix("WITH ")}, {_DEL}, w AS (SELECT q_id, q_chrom, q_start, q_end, q_start + (q_end - q_start) // 2 AS anchor FROM q WHERE q_id % 3 = 0),
grown(q_id, q_chrom, lo, hi, down) AS (
SELECT q_id, q_chrom, anchor, q_end, FALSE FROM w WHERE anchor < q_end UNION ALL SELECT q_id, q_chrom, q_start, anchor, TRUE FROM w WHERE q_start < anchor UNION ALL
SELECT q_id, q_chrom, CASE WHEN down THEN lo - n ELSE hi END, CASE WHEN down THEN lo ELSE hi + n END, down
FROM (SELECT q_id, q_chrom, lo, hi, down, CAST(sum(least(end_pos, hi) - greatest(start_pos, lo)) AS BIGINT) AS n FROM grown JOIN v ON {_GROWS} GROUP BY ALL) WHERE n > 0),
reach AS (SELECT q_id, q_chrom, min(lo) AS lo, max(hi) AS hi FROM grown GROUP BY 1, 2 UNION ALL SELECT q_id, q_chrom, q_start, q_end FROM w WHERE q_start = q_end)
SELECT DISTINCT q_id, lo, hi, chrom, start_pos, end_pos, part FROM v JOIN reach ON chrom = q_chrom AND (start_pos < hi AND lo < end_pos OR start_pos = lo AND end_pos = start_pos)""")
def sequence_variations_anchored(spark, d):
    """The same of windows anchored in their middle, which grow by what is deleted."""
    v = relation(spark, d, "iv").select("chrom", "start_pos", F.repeat(F.lit("A"), (F.col("quantity") % 4).cast("int")).alias("ref"), F.lit("").alias("alt"), "part")
    middle = (F.col("q_start") + F.floor((F.col("q_end") - F.col("q_start")) / 2)).alias("anchor")
    w = relation(spark, d, "q").where("q_id % 3 = 0").select("q_id", F.col("q_chrom").alias("chrom"), F.col("q_start").alias("start_pos"), F.col("q_end").alias("end_pos"), middle)
    found = va.sequence_variations(w, v).select("q_id", "chrom", "start_pos", (F.col("start_pos") + F.length("ref")).alias("end_pos"), "part").distinct()
    return found.join(va.grown(w, v).select("q_id", F.col("low").alias("lo"), F.col("high").alias("hi")), "q_id")


@query("j20_appris_join", "SELECT c_custkey AS gene_idx, o_orderkey AS tran_idx, o_orderpriority AS label FROM customer JOIN orders ON split_part(c_name || '.4', '.', 1) = split_part('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '.2', '.', 1)")
def appris_join(spark, d):
    """Tables of different id versions meet on the unversioned ids."""
    bare = lambda c: F.substring_index(c, ".", 1)
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("gene_idx"), bare(F.concat("c_name", F.lit(".4"))).alias("id"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("tran_idx"), F.col("o_orderpriority").alias("label"), bare(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(".2"))).alias("id"))
    return g.join(t, "id").select("gene_idx", "tran_idx", "label")


@query("j21_mane_join", "SELECT o_orderkey AS tran_idx FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def mane_join(spark, d):
    listed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("tran_idx"))
    return relation(spark, d, "tran").select("tran_idx").join(listed, "tran_idx", "left_semi")


@query("j22_chrom_alias", "SELECT s_suppkey, n_name AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def chrom_alias(spark, d):
    from strandlake.operators.catalog import canonical

    alias = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("alias"), F.col("n_name").alias("canonical"))
    named = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("chrom"))
    return canonical(named, alias).select("s_suppkey", "canonical")


@query("j24_read_variants", "SELECT l_orderkey AS read_idx, unnest([l_partkey, l_suppkey]) AS variant_idx FROM lineitem")
def read_variants(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_idx"), F.explode(F.array("l_partkey", "l_suppkey")).alias("variant_idx"))


@query("j25_categories", "SELECT event_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS BIGINT) AS category FROM events")
def categories(spark, d):
    """A name's place in the list of categories; an unknown name is an error."""
    names = F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))
    at = F.array_position(names, F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit("unknown category")).cast("long")).alias("category"))


# -- filters ---------------------------------------------------------------------------------


@query("f01_where", f"{cte('iv')} SELECT chrom, strand, start_pos, end_pos FROM iv WHERE quantity > 40 AND strand = '-'")
def where(spark, d):
    return relation(spark, d, "iv").where("quantity > 40 AND strand = '-'").select("chrom", "strand", "start_pos", "end_pos")


@query("f02_masked", f"{cte('iv')} SELECT chrom, start_pos, end_pos FROM iv WHERE quantity > 10 AND quantity % 2 = 0 AND line < 4")
def masked(spark, d):
    """Masks stack: each is a filter on the one before, and Catalyst joins them."""
    view = relation(spark, d, "iv")
    for mask in (F.col("quantity") > 10, F.col("quantity") % 2 == 0, F.col("line") < 4):
        view = view.where(mask)
    return view.select("chrom", "start_pos", "end_pos")


@query("f03_masked_lookup", f"{cte('iv', 'q')} SELECT {_SQL_SHOWN} FROM iv JOIN q ON {_SAME} AND start_pos < q_end AND q_start < end_pos WHERE quantity > 45")
def masked_lookup(spark, d):
    return rj.find_overlapping(relation(spark, d, "iv").where("quantity > 45"), relation(spark, d, "q")).select(*_SHOWN)


@query("f04_sam_flags", f"{cte('reads')} SELECT chrom, pos, flag FROM reads WHERE (flag & 2304) = 0 AND (flag & 4) = 0 AND (flag & 1024) = 0")
def sam_flags(spark, d):
    from strandlake.operators.reads import usable

    return relation(spark, d, "reads").where(usable(F.col("flag"))).select("chrom", "pos", "flag")


@query("f05_min_overhang", f"{cte('reads')} SELECT chrom, pos, left_len, right_len FROM reads WHERE left_len >= 12 AND right_len >= 12")
def min_overhang(spark, d):
    return relation(spark, d, "reads").where(F.least("left_len", "right_len") >= 12).select("chrom", "pos", "left_len", "right_len")


@query("f06_min_reads", f"{cte('reads')} SELECT chrom, strand, pos + left_len AS start_pos, pos + left_len + skip AS end_pos, count(*) AS n FROM reads GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2")
def min_reads(spark, d):
    r = relation(spark, d, "reads").withColumn("start_pos", F.col("pos") + F.col("left_len")).withColumn("end_pos", F.col("pos") + F.col("left_len") + F.col("skip"))
    return r.groupBy("chrom", "strand", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("f07_pass_filter", f"{cte('reads')} SELECT chrom, strand, pos, left_len FROM reads WHERE (left_len + right_len) % 3 = 0")
def pass_filter(spark, d):
    """A caller's predicate is a column expression; a pandas UDF works too."""
    keep = lambda r: (r["left_len"] + r["right_len"]) % 3 == 0
    r = relation(spark, d, "reads")
    return r.where(keep(r)).select("chrom", "strand", "pos", "left_len")


@query("f08_ancestral", "SELECT l_orderkey AS id, l_partkey % 7 AS alt FROM lineitem WHERE l_partkey % 7 <> 0")
def ancestral(spark, d):
    """ALT "." may be excluded, reported or refused; here it is excluded."""
    from strandlake.operators.variants import ancestral_policy

    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 7).alias("alt"), F.when(F.col("l_partkey") % 7 == 0, ".").otherwise("A").alias("ALT_"))
    return ancestral_policy(v, "ALT_", "exclude").select("id", "alt")


@query("f09_restriction", f"{cte('blocks')} SELECT chrom, greatest(start_pos, 1000) AS start_pos, least(end_pos, 5003) AS end_pos FROM blocks WHERE start_pos < 5003 AND end_pos > 1000")
def restriction(spark, d):
    b = relation(spark, d, "blocks").where("start_pos < 5003 AND end_pos > 1000")
    return b.select("chrom", F.greatest("start_pos", F.lit(1000).cast("long")).alias("start_pos"), F.least("end_pos", F.lit(5003).cast("long")).alias("end_pos"))


@query("f10_row_validation", "SELECT l_orderkey AS id, [NULL, 'multi-allelic', 'not normalised', 'bad REF', 'bad ALT', NULL, NULL][CAST(l_linenumber % 7 + 1 AS BIGINT)] AS fault FROM lineitem")
def row_validation(spark, d):
    """Faulty rows carry their fault; a strict reader raises on any."""
    from strandlake.sources import vcf

    row = lambda names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), row(("A", "A", "AC", "AX", "A", "AC", "g")).alias("REF"), row(("c", "C,G", "AT", "T", "#", "A", "G[chr2:7[")).alias("ALT"))
    return vcf.faults(t).select("id", "fault")


@query("f11_known_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def known_types(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("f12_group_filter", f"{cte('iv')} SELECT tran_idx, line, part FROM iv WHERE quantity > 20 AND tran_idx NOT IN (SELECT tran_idx FROM iv WHERE quantity < 3)")
def group_filter(spark, d):
    """Coding pieces go for every transcript that has one without an exon."""
    iv = relation(spark, d, "iv")
    return iv.where("quantity > 20").join(iv.where("quantity < 3").select("tran_idx"), "tran_idx", "left_anti").select("tran_idx", "line", "part")


# -- order, limits, sets ---------------------------------------------------------------------


@query("o01_by_pos5", f"{cte('iv')} SELECT chrom, strand, start_pos, end_pos, dense_rank() OVER (PARTITION BY chrom, strand ORDER BY CASE WHEN {P} THEN start_pos ELSE end_pos - 1 END, CASE WHEN {P} THEN end_pos - 1 ELSE start_pos END) AS by_pos5, dense_rank() OVER (PARTITION BY chrom, strand ORDER BY CASE WHEN {P} THEN end_pos - 1 ELSE start_pos END) AS by_pos3 FROM iv")
def by_pos5(spark, d):
    from strandlake.functions.intervals import Iv

    iv = Iv.of()
    keys = ["chrom", "strand"]
    rows = relation(spark, d, "iv").select("chrom", "strand", "start_pos", "end_pos")
    return ranked(ranked(rows, keys, [iv.pos5, iv.pos3], [piece(iv.pos5)], "by_pos5"), keys, [iv.pos3], [piece(iv.pos3)], "by_pos3")


@query("o02_upstream_order", f"{cte('iv')} SELECT tran_idx, strand, start_pos, end_pos, dense_rank() OVER (PARTITION BY tran_idx, chrom, strand ORDER BY CASE WHEN {P} THEN start_pos ELSE -end_pos END) AS place FROM iv")
def upstream_order(spark, d):
    w = Window.partitionBy("tran_idx", "chrom", "strand").orderBy(F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(-F.col("end_pos")))
    return relation(spark, d, "iv").select("tran_idx", "strand", "start_pos", "end_pos", F.dense_rank().over(w).cast("long").alias("place"))


@query("o03_source_order", f"{cte('iv')} SELECT chrom, strand, start_pos, tran_idx, dense_rank() OVER (PARTITION BY chrom ORDER BY strand, start_pos, tran_idx) AS place FROM iv")
def source_order(spark, d):
    rows = relation(spark, d, "iv").select("chrom", "strand", "start_pos", "tran_idx")
    return ranked(rows, ["chrom"], ["strand", "start_pos", "tran_idx"], [F.col("strand"), piece(F.col("start_pos"))], "place")


@query("o04_index", "SELECT c_custkey AS row_idx, c_name AS name FROM customer WHERE c_custkey IN (5, (SELECT max(c_custkey) - 2 FROM customer))")
def index(spark, d):
    """table[5] and table[-3] by the row index."""
    t = relation(spark, d, "gene")
    size = t.agg((F.max("gene_idx") + 1).alias("n"))
    at = F.broadcast(size).select(F.explode(F.array(F.lit(5).cast("long"), F.col("n") - 3)).alias("gene_idx"))
    return t.join(at, "gene_idx").select(F.col("gene_idx").alias("row_idx"), "name")


@query("o05_first_by_name", "SELECT c_mktsegment AS type, min(c_custkey) AS row_idx FROM customer GROUP BY 1")
def first_by_name(spark, d):
    return relation(spark, d, "gene").groupBy("type").agg(F.min("gene_idx").alias("row_idx"))


@query("o06_canonical_transcript", "SELECT gene_idx, tran_idx FROM (SELECT o_custkey AS gene_idx, o_orderkey AS tran_idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def canonical_transcript(spark, d):
    """The best label's smallest id: a partial aggregate instead of a sort per gene."""
    return relation(spark, d, "tran").groupBy("gene_idx").agg(F.min(F.struct("level", "tran_idx")).alias("b")).select("gene_idx", F.col("b.tran_idx").alias("tran_idx"))


@query("o07_union", f"{cte('iv')} SELECT chrom, start_pos FROM iv WHERE line = 1 UNION SELECT chrom, end_pos FROM iv WHERE line = 2")
def union(spark, d):
    iv = relation(spark, d, "iv")
    return iv.where("line = 1").select("chrom", "start_pos").union(iv.where("line = 2").select("chrom", "end_pos")).distinct()


@query("o08_mask_intersect", f"{cte('iv')} SELECT DISTINCT chrom, start_pos FROM iv WHERE line = 1 INTERSECT SELECT chrom, start_pos FROM iv WHERE quantity > 10")
def mask_intersect(spark, d):
    iv = relation(spark, d, "iv")
    return iv.where("line = 1").select("chrom", "start_pos").intersect(iv.where("quantity > 10").select("chrom", "start_pos"))


@query("o09_pool", f"{cte('reads')} SELECT chrom, pos FROM reads UNION ALL SELECT chrom, pos FROM reads WHERE flag = 0")
def pool(spark, d):
    r = relation(spark, d, "reads")
    return r.select("chrom", "pos").unionByName(r.where("flag = 0").select("chrom", "pos"))
