"""Registered queries of sequences, variants, VCF rules, spliced coordinates, readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import dna, splice
from strandlake.operators import genomic as gn
from strandlake.operators import variants as va
from strandlake.sources.store import stored

from .relations import EXON, cte, exons, relation, table

QUERIES: dict = {}
ORACLE: dict = {}
SEQ = "seq AS (SELECT doc_id, 'd' || doc_id AS chrom, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents)"
WIN = "win AS (SELECT doc_id AS q_id, chrom, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(doc_id % 37 - 5 AS BIGINT) AS start_pos, CAST(doc_id % 37 - 5 + doc_id % 90 AS BIGINT) AS end_pos, seq FROM seq WHERE length(seq) > 0)"
RC = lambda x: f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def sequences(spark, d):
    text = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), text.alias("seq"))


def windows(spark, d):
    s = sequences(spark, d).where("length(seq) > 0")
    start = F.col("doc_id") % 37 - 5
    return s.select(F.col("doc_id").alias("q_id"), "chrom", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start_pos"), (start + F.col("doc_id") % 90).alias("end_pos"))


def _sizes(s):
    return s.where("length(seq) > 0").select("chrom", F.length("seq").cast("long").alias("size"))


_PAD = "rpad(repeat('N', CAST(least(greatest(-start_pos, 0), end_pos - start_pos) AS BIGINT)) || CASE WHEN least(end_pos, length(seq)) > greatest(start_pos, 0) THEN substr(seq, CAST(greatest(start_pos, 0) + 1 AS BIGINT), CAST(least(end_pos, length(seq)) - greatest(start_pos, 0) AS BIGINT)) ELSE '' END, CAST(end_pos - start_pos AS INTEGER), 'N')"


@query("d01_extract", f"WITH {SEQ}, {WIN} SELECT q_id, CASE WHEN end_pos <= start_pos THEN '' WHEN strand = '+' THEN {_PAD} ELSE {RC(_PAD)} END AS dna FROM win")
def extract(spark, d):
    s = sequences(spark, d)
    return dna.extract(windows(spark, d), dna.chunked(s, 256), _sizes(s), 256).select("q_id", "dna")


@query("d02_soft_mask", "SELECT doc_id, regexp_replace(regexp_replace(text, '[^ACGTNacgtn]', '', 'g'), 'n', 'N', 'g') AS seq FROM documents")
def soft_mask(spark, d):
    """Lower case marks repeats; N is written over whatever was there."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "[^ACGTNacgtn]", ""), "n", "N").alias("seq"))


@query("d03_reverse_complement", f"WITH {SEQ} SELECT doc_id, {RC('seq')} AS rc FROM seq")
def reverse_complement(spark, d):
    return sequences(spark, d).select("doc_id", dna.reverse_complement(F.col("seq")).alias("rc"))


_HIT = "CASE WHEN doc_id % 2 = 0 THEN 'CAT' ELSE 'ATG' END"


@query("m01_find_motif", f"WITH {SEQ}, p AS (SELECT doc_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM seq WHERE length(seq) >= 3) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN i - 1 ELSE i + 2 END AS hit FROM p WHERE substr(seq, i, 3) = {_HIT}")
def find_motif(spark, d):
    s = sequences(spark, d).withColumns({"strand": F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"), "start_pos": F.lit(0).cast("long")})
    return dna.find_motif(s, "CAT", "5p").select("doc_id", F.col("hit").cast("long").alias("hit"))


def _apart(spark, d):
    s = sequences(spark, d).withColumns({"strand": F.lit("+"), "start_pos": F.lit(0).cast("long")})
    return dna.find_motif(s, "AA", "5p", overlapping=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES["m01_not_overlapping"] = _apart
ORACLE["m01_not_overlapping"] = f"WITH {SEQ} SELECT doc_id, CAST((length(seq) - length(replace(seq, 'AA', ''))) / 2 AS BIGINT) AS n FROM seq WHERE contains(seq, 'AA')"

# -- variants --------------------------------------------------------------------------------

_VAR = "v AS (SELECT l_orderkey AS id, 'chr' || (l_suppkey % 5 + 1) AS chrom, l_partkey AS start_pos, substr('ACGTACGTTGCA', CAST(l_partkey % 5 + 1 AS BIGINT), CAST(l_linenumber % 5 AS BIGINT)) AS ref, substr('ACGAACTTTGCA', CAST(l_partkey % 5 + 1 AS BIGINT), CAST(l_suppkey % 6 AS BIGINT)) AS alt FROM lineitem)"


def variants(spark, d):
    cut = lambda s, n: F.lit(s).substr((F.col("l_partkey") % 5 + 1).cast("int"), n.cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"), F.col("l_partkey").alias("start_pos"), cut("ACGTACGTTGCA", F.col("l_linenumber") % 5).alias("ref"), cut("ACGAACTTTGCA", F.col("l_suppkey") % 6).alias("alt"))


@query("v01_construct", f"WITH {_VAR} SELECT id, chrom, start_pos, start_pos + length(ref) AS end_pos, ref, alt FROM v")
def construct(spark, d):
    return variants(spark, d).select("id", "chrom", "start_pos", (F.col("start_pos") + F.length("ref")).alias("end_pos"), "ref", "alt")


@query("v02_from_string", f"WITH {_VAR} SELECT id, chrom, start_pos, start_pos + length(ref) AS end_pos, ref, alt FROM v")
def from_string(spark, d):
    """Text with thousands separators, lower case and "-" for empty alleles."""
    dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.lower(c))
    text = F.concat_ws(":", "chrom", F.format_number(F.col("start_pos") + 1, 0), dash("ref"), dash("alt"))
    return variants(spark, d).select("id", va.parse(text).alias("v")).select("id", "v.*")


@query("v03_variant_string", f"WITH {_VAR} SELECT id, chrom || ':' || (start_pos + 1) || ':' || ref || ':' || alt AS shown FROM v")
def variant_string(spark, d):
    return variants(spark, d).select("id", va.variant_text(F.col("chrom"), F.col("start_pos"), F.col("ref"), F.col("alt")).alias("shown"))


_PRE = "CAST(len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda k: substr(ref, 1, k) = substr(alt, 1, k))) AS BIGINT)"


@query("v04_normalise", f"""WITH {_VAR}, p AS (SELECT *, {_PRE} AS k FROM v), s AS (SELECT id, start_pos + k AS s, substr(ref, k + 1) AS r, substr(alt, k + 1) AS a FROM p), n AS (SELECT *, least(length(r), length(a)) AS m FROM s)
SELECT id, s AS start_pos, substr(r, 1, m) AS ref, substr(a, 1, m) AS alt FROM n WHERE m > 0 UNION ALL SELECT id, s + m, substr(r, m + 1), substr(a, m + 1) FROM n WHERE length(r) > m OR length(a) > m""")
def normalise(spark, d):
    return variants(spark, d).select("id", F.explode(va.normalised(F.col("start_pos"), F.col("ref"), F.col("alt"))).alias("v")).select("id", "v.*")


@query("v05_spanning", f"""{cte('pairs')}, g AS (SELECT DISTINCT id, line, s, e, id % 7 AS ins, CASE WHEN line % 2 = 0 THEN 3 ELSE 0 END AS del FROM pairs)
SELECT id, line, CASE WHEN id % 3 = 0 THEN s - 100 - ins ELSE s END AS start_pos, CASE WHEN id % 3 = 0 THEN e ELSE greatest(e, s + 200 + ins - del) END AS end_pos, CASE WHEN id % 3 < 2 THEN s END AS anchor, CASE WHEN id % 3 < 2 THEN 0 END AS anchor_offset FROM g WHERE id % 3 < 2
UNION ALL SELECT id, line, s, greatest(e, s + 200), NULL, NULL FROM g WHERE id % 3 = 2""")
def spanning(spark, d):
    """Anchored intervals and others up- or downstream, with an insertion and at times a deletion between them."""
    p = relation(spark, d, "pairs").select("id", "line", "s", "e").distinct().withColumns({"chrom": F.concat_ws(".", *(F.col(c).cast("string") for c in ("id", "line", "s", "e"))), "kind": F.col("id") % 3})
    up = F.col("kind") == 0
    rows = p.select(
        F.struct("id", "line", "s", "e").alias("p_id"), "chrom", F.col("s").alias("x_start"), F.col("e").alias("x_end"), F.when(F.col("kind") < 2, F.col("s")).alias("x_anchor"), F.lit(0).alias("x_offset"),
        F.when(up, F.col("s") - 100).otherwise(F.col("s") + 100).alias("y_start"), F.when(up, F.col("s") - 40).otherwise(F.col("s") + 200).alias("y_end"), F.lit(None).cast("long").alias("y_anchor"), F.lit(0).alias("y_offset"),
    )
    at = lambda n, ref, alt: F.struct((F.col("s") + n).alias("start_pos"), F.lit(ref).alias("ref"), alt.alias("alt"))
    new = F.repeat(F.lit("N"), (F.col("id") % 7).cast("int"))
    down = F.array(at(50, "", new), at(60, "ACG", F.when(F.col("line") % 2 == 0, "").otherwise("TTT")))
    v = p.select("chrom", F.explode(F.when(up, F.array(at(-70, "", new))).otherwise(down)).alias("v")).select("chrom", "v.*")
    return va.spanning(rows, v).select("p_id.id", "p_id.line", "start_pos", "end_pos", "anchor", F.col("anchor_offset").cast("int").alias("anchor_offset"))


@query("v06_distinct", f"WITH {_VAR} SELECT DISTINCT chrom, start_pos, ref, alt FROM v")
def distinct(spark, d):
    return variants(spark, d).select("chrom", "start_pos", "ref", "alt").dropDuplicates()


@query("v07_check", f"WITH {_VAR} SELECT id, regexp_full_match(ref, '[ACGTN]*') AND regexp_full_match(alt, '[ACGTN]*') AS fine FROM v")
def check(spark, d):
    return variants(spark, d).select("id", (F.col("ref").rlike("^[ACGTN]*$") & F.col("alt").rlike("^[ACGTN]*$")).alias("fine"))


def _variant_windows(spark, d, anchor):
    """Windows of ten to forty bases of the sequences, with a substitution, an insertion and a deletion in each."""
    # a reference is a table; here it is made from the documents once
    s = stored(sequences(spark, d).where("length(seq) >= 120"))
    w = s.select(F.col("doc_id").alias("q_id"), "chrom", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(40).cast("long").alias("start_pos"), (F.col("doc_id") % 30 + 50).alias("end_pos"), anchor.cast("long").alias("anchor"), F.lit(1).cast("long").alias("anchor_offset"))
    cut = lambda p, n: F.substring("seq", p + 1, n)
    v = s.select("chrom", F.explode(F.array(
        F.struct(F.lit(43).cast("long").alias("start_pos"), cut(43, 1).alias("ref"), F.lit("N").alias("alt")),
        F.struct(F.lit(46).cast("long").alias("start_pos"), F.lit("").alias("ref"), F.lit("GG").alias("alt")),
        F.struct(F.lit(48).cast("long").alias("start_pos"), cut(48, 3).alias("ref"), F.lit("").alias("alt")),
    )).alias("v")).select("chrom", "v.*")
    return w, v, dna.chunked(s), _sizes(s)


def _applied(spark, d, anchor):
    return va.variant_dna(*_variant_windows(spark, d, anchor)).select("q_id", "dna")


_S = lambda a, b: f"substr(seq, {a} + 1, CAST({b} - {a} AS BIGINT))"
_END = "(doc_id % 30 + 50)"
_STRAND = lambda x: f"CASE WHEN doc_id % 2 = 0 THEN {x} ELSE {RC(x)} END"
_LEFT = f"{_S(40, 43)} || 'N' || {_S(44, 46)} || 'GG' || {_S(46, 48)}"
_LONG = f"WITH {SEQ}, s AS (SELECT * FROM seq WHERE length(seq) >= 120) SELECT doc_id AS q_id, "
_FREE = f"{_LEFT} || {_S(51, _END)} || CASE WHEN {_END} = 50 THEN '' ELSE '' END"
QUERIES["v08_apply_no_anchor"] = lambda spark, d: _applied(spark, d, F.lit(None))
ORACLE["v08_apply_no_anchor"] = _LONG + _STRAND(f"({_LEFT} || CASE WHEN {_END} > 51 THEN {_S(51, _END)} ELSE '' END)") + " AS dna FROM s"
# anchor at the end: length held, the left side grows or shrinks
QUERIES["v09_right_anchor"] = lambda spark, d: _applied(spark, d, F.col("doc_id") % 30 + 50)
ORACLE["v09_right_anchor"] = _LONG + _STRAND(f"right({_S(30, 43)} || 'N' || {_S(44, 46)} || 'GG' || {_S(46, 48)} || CASE WHEN {_END} > 51 THEN {_S(51, _END)} ELSE '' END, {_END} - 40)") + " AS dna FROM s"
QUERIES["v10_left_anchor"] = lambda spark, d: _applied(spark, d, F.lit(40))
ORACLE["v10_left_anchor"] = _LONG + _STRAND(f"left({_LEFT} || {_S(51, 100)}, {_END} - 40)") + " AS dna FROM s"
QUERIES["v11_interior_anchor"] = lambda spark, d: _applied(spark, d, F.lit(46))
# the insertion at the anchor gives one base to the left
ORACLE["v11_interior_anchor"] = _LONG + _STRAND(f"(right({_S(30, 43)} || 'N' || {_S(44, 46)} || 'G', 6) || left('G' || {_S(46, 48)} || {_S(51, 110)}, {_END} - 46))") + " AS dna FROM s"
QUERIES["v12_outside_anchor"] = lambda spark, d: _applied(spark, d, F.lit(30))
ORACLE["v12_outside_anchor"] = _LONG + _STRAND(f"right(left({_S(30, 43)} || 'N' || {_S(44, 46)} || 'GG' || {_S(46, 48)} || {_S(51, 110)}, {_END} - 30), {_END} - 40)") + " AS dna FROM s"
QUERIES["v14_variant_dna"], ORACLE["v14_variant_dna"] = QUERIES["v08_apply_no_anchor"], ORACLE["v08_apply_no_anchor"]

# -- variants against the genome ----------------------------------------------------------------

# a sequence with a repeat of up to 300 bases at its end, and variants within and before it
_REP = "rep AS (SELECT doc_id, chrom, seq || repeat('CA', CAST(doc_id % 150 AS INTEGER)) || 'T' AS seq, length(seq || repeat('CA', CAST(doc_id % 150 AS INTEGER))) AS n FROM seq WHERE length(seq) >= 60)"
_GV = """gv AS (SELECT doc_id, chrom, seq, n - 2 AS start_pos, substr(seq, n - 1, 2) AS ref, '' AS alt FROM rep
UNION ALL SELECT doc_id, chrom, seq, n, '', substr(seq, n - 1, 2) FROM rep
UNION ALL SELECT doc_id, chrom, seq, 20 + doc_id % 30, '', substr(seq, CAST(20 + doc_id % 30 AS BIGINT), 1) FROM rep
UNION ALL SELECT doc_id, chrom, seq, 5, substr(seq, 6, 4), substr(seq, 6, 1) FROM rep
UNION ALL SELECT doc_id, chrom, seq, 30, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE substr(seq, 31, 1) END, 'N' FROM rep
UNION ALL SELECT doc_id, chrom, seq, n - 1, 'AT' || repeat('A', CAST(doc_id % 2 AS INTEGER)), 'G' FROM rep
UNION ALL SELECT doc_id, chrom, seq, 3, substr(seq, 4, 2), CASE WHEN doc_id % 2 = 0 THEN 'Z' ELSE 'G' END FROM rep)"""


def _genome(spark, d):
    """Variants of every sequence, its chunks and its sizes."""
    s = sequences(spark, d).where("length(seq) >= 60")
    whole = F.concat("seq", F.repeat(F.lit("CA"), (F.col("doc_id") % 150).cast("int")))
    rep = stored(s.select("doc_id", "chrom", F.concat(whole, F.lit("T")).alias("seq"), F.length(whole).alias("n")))
    cut = lambda at, k: F.col("seq").substr((at + 1).cast("int"), F.lit(k))
    v = lambda at, ref, alt: F.struct(at.cast("long").alias("start_pos"), ref.alias("ref"), alt.alias("alt"))
    n, i, none = F.col("n"), F.col("doc_id"), F.lit("")
    every = F.array(
        v(n - 2, cut(n - 2, 2), none), v(n, none, cut(n - 2, 2)), v(20 + i % 30, none, cut(19 + i % 30, 1)), v(F.lit(5), cut(F.lit(5), 4), cut(F.lit(5), 1)),
        v(F.lit(30), F.when(i % 3 == 0, "A").otherwise(cut(F.lit(30), 1)), F.lit("N")), v(n - 1, F.concat(F.lit("AT"), F.repeat(F.lit("A"), (i % 2).cast("int"))), F.lit("G")),
        v(F.lit(3), cut(F.lit(3), 2), F.when(i % 2 == 0, "Z").otherwise("G")),
    )
    return rep.select("doc_id", "chrom", F.explode(every).alias("v")).select("doc_id", "chrom", "v.*"), dna.chunked(rep), _sizes(rep)


_FAULT = """CASE WHEN NOT regexp_full_match(ref || alt, '[ACGTN]*') THEN 'alphabet' WHEN start_pos + length(ref) > length(seq) THEN 'outside'
WHEN substr(seq, CAST(start_pos + 1 AS BIGINT), length(ref)) <> ref THEN 'reference' END"""


@query("f10_reference", f"WITH {SEQ}, {_REP}, {_GV} SELECT doc_id, CAST(start_pos AS BIGINT) AS start_pos, ref, alt, {_FAULT} AS fault FROM gv")
def faults(spark, d):
    """What is wrong with a variant: its letters, its place, or a reference allele that the genome doesn't have there."""
    return gn.with_faults(*_genome(spark, d)).select("doc_id", "start_pos", "ref", "alt", "fault")


@query("s09_normalised", f"""WITH RECURSIVE {SEQ}, {_REP}, {_GV}, fine AS (SELECT * FROM gv WHERE {_FAULT} IS NULL),
p AS (SELECT doc_id, seq, start_pos AS s0, ref AS r0, alt AS a0, CAST(len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda k: right(ref, k) = right(alt, k))) AS BIGINT) AS k FROM fine),
t AS (SELECT doc_id, seq, s0, r0, a0, left(r0, length(r0) - k) AS r, left(a0, length(a0) - k) AS a FROM p),
h AS (SELECT *, CAST(len(list_filter(range(1, least(length(r), length(a)) + 1), lambda k: left(r, k) = left(a, k))) AS BIGINT) AS k FROM t),
roll(doc_id, seq, s0, r0, a0, s, r, a) AS (
SELECT doc_id, seq, s0, r0, a0, s0 + k, substr(r, k + 1), substr(a, k + 1) FROM h UNION ALL
SELECT doc_id, seq, s0, r0, a0, s - 1, CASE WHEN r <> '' THEN right(r, 1) || left(r, length(r) - 1) ELSE '' END, CASE WHEN a <> '' THEN right(a, 1) || left(a, length(a) - 1) ELSE '' END
FROM roll WHERE (r = '') <> (a = '') AND s > 0 AND substr(seq, CAST(s AS BIGINT), 1) = right(r || a, 1))
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_pos, arg_min(r, s) AS ref, arg_min(a, s) AS alt FROM roll GROUP BY doc_id, s0, r0, a0""")
def left_aligned(spark, d):
    """Rows that fit the genome, with indels moved left through repeats."""
    v, chunks, sizes = _genome(spark, d)
    fine = gn.checked(v, chunks, sizes, policy="exclude")
    return gn.left_aligned(fine.distinct(), chunks, sizes).select("doc_id", "start_pos", "ref", "alt")


# -- VCF rules -------------------------------------------------------------------------------

_GT = "['0/0','0/1','1/1','./.','0|1','1|0','0|0','1|1','./1','.|1','0','1'][CAST(l_orderkey % 12 + 1 AS BIGINT)]"


@query("c03_missing", "SELECT l_orderkey AS id, coalesce(CASE WHEN l_linenumber > 3 THEN l_partkey END, -1) AS depth, coalesce(CASE WHEN l_linenumber > 5 THEN l_returnflag END, '') AS label FROM lineitem")
def missing(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.coalesce(F.when(F.col("l_linenumber") > 3, F.col("l_partkey")), F.lit(-1)).alias("depth"), F.coalesce(F.when(F.col("l_linenumber") > 5, F.col("l_returnflag")), F.lit("")).alias("label"))


@query("c04_counts", "SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber % 3 <> 2")
def counts(spark, d):
    """Rows whose value has another count than the header says."""
    v = F.split(F.repeat(F.lit("1,"), F.col("l_linenumber") % 3), ",")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.size(v) - 1).alias("n")).where("n <> 2").select("id")


@query("c05_genotype", f"SELECT l_orderkey AS id, CAST([0, 1, 2, 3, 4, 5, 0, 2, 1, 3, 0, 2][CAST(l_orderkey % 12 + 1 AS BIGINT)] AS TINYINT) AS gt FROM lineitem")
def genotype(spark, d):
    gts = F.array(*(F.lit(x) for x in ("0/0", "0/1", "1/1", "./.", "0|1", "1|0", "0|0", "1|1", "./1", ".|1", "0", "1")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), va.genotype(F.element_at(gts, (F.col("l_orderkey") % 12 + 1).cast("int"))).alias("gt"))


@query("c06_sv_type", "SELECT l_orderkey AS id, CAST(CASE WHEN l_orderkey % 8 = 7 THEN NULL ELSE l_orderkey % 8 END AS TINYINT) AS sv FROM lineitem")
def sv_type(spark, d):
    names = F.array(*(F.lit(x) for x in (*va.SV_TYPES, "ODD")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), va.sv_type(F.element_at(names, (F.col("l_orderkey") % 8 + 1).cast("int"))).alias("sv"))


@query("c07_symbolic", "SELECT l_orderkey AS id, l_partkey AS start_pos, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 50 ELSE l_partkey + l_suppkey END AS end_pos FROM lineitem")
def symbolic(spark, d):
    end = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") + 50)
    s = va.symbolic(F.col("l_partkey"), F.lit("A"), end, -F.col("l_suppkey"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), s.alias("s")).select("id", "s.*")


@query("c08_trim_prefix", f"WITH {_VAR}, p AS (SELECT *, {_PRE} AS k FROM v) SELECT id, start_pos + k AS start_pos, substr(ref, k + 1) AS ref, substr(alt, k + 1) AS alt FROM p")
def trim_prefix(spark, d):
    v = variants(spark, d).withColumn("k", va.common_prefix(F.col("ref"), F.col("alt")))
    rest = lambda c: F.expr(f"substring({c}, k + 1)").alias(c)
    return v.select("id", (F.col("start_pos") + F.col("k")).cast("long").alias("start_pos"), rest("ref"), rest("alt"))


@query("c11_format_long", "SELECT l_orderkey AS id, unnest([0, 1]) AS sample, unnest([l_partkey, l_suppkey]) AS dp FROM lineitem")
def format_long(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.posexplode(F.array("l_partkey", "l_suppkey")).alias("sample", "dp"))


@query("c12_signed", "SELECT l_orderkey AS id, CAST(l_linenumber - 4 AS TINYINT) AS v FROM lineitem")
def signed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 4).cast("tinyint").alias("v"))


@query("c17_sample_reduction", "SELECT l_orderkey AS id FROM lineitem WHERE l_partkey + l_linenumber >= 150 OR l_suppkey + l_linenumber >= 150")
def sample_reduction(spark, d):
    """Rows of which some sample has enough depth over its alleles."""
    samples = F.array(F.array("l_partkey", F.col("l_linenumber").cast("long")), F.array("l_suppkey", F.col("l_linenumber").cast("long")))
    keep = F.exists(samples, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x) >= 150)
    return table(spark, d, "lineitem").where(keep).select(F.col("l_orderkey").alias("id"))


@query("c18_chrom_names", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 'MT' ELSE CAST(n_nationkey AS VARCHAR) END AS chrom FROM nation")
def chrom_names(spark, d):
    name = F.when(F.col("n_nationkey") == 0, "chrM").otherwise(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.regexp_replace(F.regexp_replace(name, "^chrM$", "MT"), "^chr", "").alias("chrom"))


# -- spliced coordinates ---------------------------------------------------------------------

UPW = "PARTITION BY tran_idx ORDER BY CASE WHEN strand = '+' THEN start_pos ELSE -end_pos END"
PART = f"{EXON}, part AS (SELECT tran_idx AS dis_id, chrom, strand, start_pos, end_pos, end_pos - start_pos AS len, row_number() OVER ({UPW}) - 1 AS ord, CAST(coalesce(sum(end_pos - start_pos) OVER ({UPW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum, CAST(sum(end_pos - start_pos) OVER (PARTITION BY tran_idx) AS BIGINT) AS total FROM exon)"


def parts(spark, d):
    return splice.build(exons(spark, d).withColumnRenamed("tran_idx", "dis_id").drop("line"), together=True)


@query("x01_build", f"WITH {PART} SELECT dis_id, chrom, strand, start_pos, end_pos, ord, cum, total FROM part")
def build(spark, d):
    return parts(spark, d)


@query("x02_from_transcript", f"""WITH {EXON}, c AS (SELECT tran_idx AS dis_id, chrom, strand, start_pos + 7 AS start_pos, end_pos - 9 AS end_pos FROM exon WHERE line <= 4), span AS (SELECT dis_id, min(start_pos) AS cs, max(end_pos) AS ce FROM c GROUP BY 1),
u AS (SELECT tran_idx AS dis_id, chrom, strand, CASE WHEN strand = '+' THEN start_pos ELSE greatest(start_pos, ce) END AS start_pos, CASE WHEN strand = '+' THEN least(end_pos, cs) ELSE end_pos END AS end_pos, 'utr5' AS region FROM exon JOIN span ON dis_id = tran_idx
UNION ALL SELECT tran_idx, chrom, strand, CASE WHEN strand = '-' THEN start_pos ELSE greatest(start_pos, ce) END, CASE WHEN strand = '-' THEN least(end_pos, cs) ELSE end_pos END, 'utr3' FROM exon JOIN span ON dis_id = tran_idx
UNION ALL SELECT *, 'cds' FROM c UNION ALL SELECT tran_idx, chrom, strand, start_pos, end_pos, 'exons' FROM exon)
SELECT region, dis_id, chrom, strand, start_pos, end_pos, row_number() OVER (PARTITION BY region, dis_id ORDER BY CASE WHEN strand = '+' THEN start_pos ELSE -end_pos END) - 1 AS ord FROM u WHERE start_pos < end_pos""")
def from_transcript(spark, d):
    """The sequences of each region of the transcripts."""
    from functools import reduce

    from strandlake.operators.annotation import utrs

    e = exons(spark, d)
    cds = e.where("line <= 4").withColumns({"start_pos": F.col("start_pos") + 7, "end_pos": F.col("end_pos") - 9})
    u = utrs(e, cds)
    regions = {"exons": e, "cds": cds, "utr5": u.where("side = 5"), "utr3": u.where("side = 3")}
    each = [splice.from_transcripts(regions, r).select(F.lit(r).alias("region"), "dis_id", "chrom", "strand", "start_pos", "end_pos", "ord") for r in splice.REGIONS]
    return reduce(lambda a, b: a.unionByName(b), each)


def segments(spark, d):
    """A segment a transcript, on either strand, at times beyond its ends."""
    p = parts(spark, d).where("ord = 0")
    start = F.col("dis_id") % 41 - 10
    return p.select(F.col("dis_id").alias("seg_id"), "dis_id", start.alias("seg_start"), (start + F.col("dis_id") % 67).alias("seg_end"), (F.col("dis_id") % 3 != 0).alias("same"))


_SEG = "seg AS (SELECT dis_id AS seg_id, dis_id, dis_id % 41 - 10 AS seg_start, dis_id % 41 - 10 + dis_id % 67 AS seg_end, dis_id % 3 <> 0 AS same, strand, total FROM part WHERE ord = 0)"


@query("x03_properties", f"WITH {PART}, {_SEG} SELECT seg_id, total AS coordinate_length, seg_end - seg_start AS length, CASE WHEN same THEN seg_start ELSE seg_end END AS end5_index, CASE WHEN same THEN seg_end ELSE seg_start END AS end3_index, CASE WHEN same = (strand = '+') THEN '+' ELSE '-' END AS strand FROM seg")
def properties(spark, d):
    return splice.properties(parts(spark, d), segments(spark, d))


@query("x04_shift_expand", f"WITH {PART}, {_SEG} SELECT seg_id, CASE WHEN same THEN seg_start + 6 - 8 ELSE seg_start - 6 - 5 END AS seg_start, CASE WHEN same THEN seg_end + 6 + 5 ELSE seg_end - 6 + 8 END AS seg_end FROM seg")
def shift_expand(spark, d):
    """Six bases downstream, then eight more upstream and five downstream, each on the segment's strand."""
    return splice.expanded(splice.shifted(segments(spark, d), 6), 8, 5).select("seg_id", "seg_start", "seg_end")


@query("x05_expand_coord", f"WITH {PART} SELECT dis_id, ord, CASE WHEN strand = '+' AND ord = 0 THEN start_pos - 4 WHEN strand = '-' AND cum + len = total THEN start_pos - 6 ELSE start_pos END AS start_pos, CASE WHEN strand = '+' AND cum + len = total THEN end_pos + 6 WHEN strand = '-' AND ord = 0 THEN end_pos + 4 ELSE end_pos END AS end_pos, CASE WHEN ord = 0 THEN 0 ELSE cum + 4 END AS cum, total + 10 AS total, CAST(CASE WHEN dis_id % 2 = 0 THEN 0 ELSE 5 END AS BIGINT) AS seg_start, CASE WHEN dis_id % 2 = 0 THEN total + 10 ELSE 9 END AS seg_end FROM part")
def expand_coord(spark, d):
    """The outer edges grow, four bases upstream and six downstream; a segment only if it spans everything."""
    p = parts(spark, d)
    even = F.col("dis_id") % 2 == 0
    s = p.where("ord = 0").select(F.col("dis_id").alias("seg_id"), "dis_id", F.when(even, 0).otherwise(1).cast("long").alias("seg_start"), F.when(even, F.col("total")).otherwise(5).alias("seg_end"))
    moved = splice.after_expand_coord(p, s, 4, 6).select("dis_id", "seg_start", "seg_end")
    return splice.expand_coord(p, 4, 6).join(moved, "dis_id").select("dis_id", "ord", "start_pos", "end_pos", "cum", "total", "seg_start", "seg_end")


@query("x06_segments", f"""WITH {PART}, {_SEG}, b AS (SELECT *, seg_start + dis_id % 29 - 14 AS s, seg_start + dis_id % 29 - 14 + dis_id % 23 AS e FROM seg),
c AS (SELECT *, seg_end <= s AND NOT (seg_start = seg_end AND s = e AND s = seg_start) AS ab, e <= seg_start AND NOT (seg_start = seg_end AND s = e AND s = seg_start) AS ba, greatest(seg_start, s) AS i, least(seg_end, e) AS j FROM b)
SELECT seg_id, CASE WHEN same THEN ab ELSE ba END AS upstream, CASE WHEN same THEN ba ELSE ab END AS dnstream, seg_start >= s AND seg_end <= e AS inside, CASE WHEN i < j THEN i END AS both_start, CASE WHEN i < j THEN j END AS both_end FROM c""")
def segment_predicates(spark, d):
    a = segments(spark, d)
    start = F.col("seg_start") + F.col("dis_id") % 29 - 14
    b = a.withColumns({"seg_start": start, "seg_end": start + F.col("dis_id") % 23})
    both = a.alias("a").join(b.alias("b"), F.col("a.seg_id") == F.col("b.seg_id"))
    shared = splice.intersect("a", "b")
    return both.select("a.seg_id", splice.upstream_of("a", "b").alias("upstream"), splice.dnstream_of("a", "b").alias("dnstream"), splice.within("a", "b").alias("inside"), shared["seg_start"].alias("both_start"), shared["seg_end"].alias("both_end"))


_SIDE = "CASE WHEN {} = (strand = '+') THEN '+' ELSE '-' END"


@query("x07_strand_toggle", f"WITH {PART}, {_SEG} SELECT seg_id, '+' AS positive, '-' AS negative, strand AS same, {_SIDE.format('FALSE')} AS opposite, {_SIDE.format('(NOT same)')} AS flip FROM seg")
def strand_toggle(spark, d):
    """The strand that a segment is on after each of the toggles."""
    rows = segments(spark, d).join(parts(spark, d).where("ord = 0").select("dis_id", "strand"), "dis_id")
    return rows.select("seg_id", *(splice.strand_of(F.col("strand"), splice.turned(F.col("strand"), F.col("same"), to)).alias(to) for to in ("positive", "negative", "same", "opposite", "flip")))


_SEGS = "seg AS (SELECT DISTINCT dis_id AS seg_id, dis_id, CAST(dis_id % 41 - 10 AS BIGINT) AS seg_start, CAST(dis_id % 41 - 10 + dis_id % 67 AS BIGINT) AS seg_end FROM part)"
_LOWX = "low AS (SELECT seg_id, chrom, strand, ord, start_pos, end_pos, cum, seg_start, seg_end, CASE WHEN cum = 0 THEN -1000000000 ELSE cum END AS l, CASE WHEN cum + len = total THEN 1000000000 ELSE cum + len END AS h FROM part JOIN seg USING (dis_id))"


@query("x08_lower", f"""WITH {PART}, {_SEGS}, {_LOWX}, c AS (SELECT *, greatest(seg_start, l) AS a, least(seg_end, h) AS b FROM low)
SELECT seg_id, chrom, strand, ord, CASE WHEN strand = '+' THEN start_pos + a - cum ELSE end_pos - (b - cum) END AS start_pos, CASE WHEN strand = '+' THEN start_pos + b - cum ELSE end_pos - (a - cum) END AS end_pos FROM c WHERE seg_start < seg_end AND a < b
UNION ALL SELECT seg_id, chrom, strand, min(ord), max(CASE WHEN strand = '+' THEN start_pos + seg_start - cum ELSE end_pos - (seg_start - cum) END), max(CASE WHEN strand = '+' THEN start_pos + seg_start - cum ELSE end_pos - (seg_start - cum) END) FROM c WHERE seg_start = seg_end AND seg_start BETWEEN l AND h GROUP BY 1, 2, 3""")
def lower(spark, d):
    p = parts(spark, d)
    s = p.select("dis_id").distinct()
    seg = s.select(F.col("dis_id").alias("seg_id"), "dis_id", (F.col("dis_id") % 41 - 10).alias("seg_start"), (F.col("dis_id") % 41 - 10 + F.col("dis_id") % 67).alias("seg_end"))
    return splice.lower(p, seg)


@query("x09_genomic_span", f"WITH {PART} SELECT dis_id, chrom, strand, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM part GROUP BY 1, 2, 3")
def genomic_span(spark, d):
    return splice.genomic_span(parts(spark, d))


@query("x10_lift", f"""WITH {PART}, q AS (SELECT dis_id, min(start_pos) + 15 AS qs, max(end_pos) - dis_id % 200 AS qe FROM part GROUP BY 1), i AS (SELECT dis_id, strand, CAST(sum(greatest(0, least(len, CASE WHEN strand = '+' THEN qs - start_pos ELSE end_pos - qs END))) AS BIGINT) AS x, CAST(sum(greatest(0, least(len, CASE WHEN strand = '+' THEN qe - start_pos ELSE end_pos - qe END))) AS BIGINT) AS y FROM part JOIN q USING (dis_id) GROUP BY 1, 2)
SELECT dis_id AS iv_id, CASE WHEN strand = '+' THEN x ELSE y END AS seg_start, CASE WHEN strand = '+' THEN y ELSE x END AS seg_end FROM i WHERE CASE WHEN strand = '+' THEN x < y ELSE y < x END""")
def lift(spark, d):
    p = parts(spark, d)
    q = p.groupBy("dis_id", "chrom").agg((F.min("start_pos") + 15).alias("q_start"), (F.max("end_pos") - F.first("dis_id") % 200).alias("q_end")).withColumn("iv_id", F.col("dis_id"))
    return splice.lift(p, q)


@query("x11_dna", f"""WITH {PART}, {_SEG}, w AS (SELECT dis_id, string_agg(CASE WHEN strand = '+' THEN t ELSE {RC('t')} END, '' ORDER BY ord) AS whole FROM (SELECT *, substr(repeat('ACGGTTANCA', 20), CAST(start_pos % 10 + 1 AS BIGINT), len) AS t FROM part) GROUP BY 1),
c AS (SELECT seg_id, same, repeat('N', CAST(least(greatest(-seg_start, 0), seg_end - seg_start) AS BIGINT)) || CASE WHEN least(seg_end, total) > greatest(seg_start, 0) THEN substr(whole, CAST(greatest(seg_start, 0) + 1 AS BIGINT), CAST(least(seg_end, total) - greatest(seg_start, 0) AS BIGINT)) ELSE '' END || repeat('N', CAST(least(greatest(seg_end - total, 0), seg_end - seg_start) AS BIGINT)) AS t FROM seg JOIN w USING (dis_id))
SELECT seg_id, CASE WHEN same THEN t ELSE {RC('t')} END AS dna FROM c""")
def spliced_dna(spark, d):
    """Bases of segments through the chunked reference, N beyond the sequence."""
    size = parts(spark, d).groupBy("chrom").agg((F.max("end_pos") + 10).alias("size"))
    # a reference of ten bases over and over, made chunk by chunk
    n = 1 << 12
    chunks = size.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / n))))
    text = F.substring(F.repeat(F.lit("ACGGTTANCA"), n // 10 + 2), (F.col("chunk") * n % 10 + 1).cast("int"), F.lit(n))
    return splice.spliced_dna(parts(spark, d), segments(spark, d), chunks.select("chrom", "chunk", text.alias("seq")), size, n)


@query("x12_equality", f"WITH {PART}, h AS (SELECT dis_id, chrom, strand, string_agg(start_pos || '-' || end_pos, ',' ORDER BY ord) AS k FROM part GROUP BY 1, 2, 3) SELECT count(*) AS n FROM (SELECT DISTINCT chrom, strand, k FROM h)")
def equality(spark, d):
    p = parts(spark, d).groupBy("dis_id", "chrom", "strand").agg(F.sort_array(F.collect_list(F.struct("ord", "start_pos", "end_pos"))).alias("k"))
    return p.select("chrom", "strand", "k").distinct().agg(F.count(F.lit(1)).alias("n"))


# -- readers and sinks on text derived from the tables ---------------------------------------


@query("s03_split", "SELECT event_id, split_part(x, ';', 1) AS a, substr(x, strpos(x, ';') + 1) AS rest FROM (SELECT event_id, event_type || ';' || user_id || ';' || event_id AS x FROM events)")
def split(spark, d):
    """The last column keeps what is left."""
    x = F.split(F.concat_ws(";", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")), ";", 2)
    return table(spark, d, "events").select("event_id", x[0].alias("a"), x[1].alias("rest"))


@query("s04_attributes", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS user_id, 'none' AS missing FROM events")
def attributes(spark, d):
    from strandlake.sources.gff import attribute

    text = F.concat(F.lit("kind="), F.col("event_type"), F.lit(";user="), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", attribute(text, "kind").alias("kind"), attribute(text, "user").alias("user_id"), attribute(text, "x", "none").alias("missing"))


def _gff(spark, d):
    e = exons(spark, d)
    t = e.groupBy("tran_idx", "chrom", "strand").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    line = lambda kind, attrs: F.concat_ws("\t", "chrom", F.lit("havana"), F.lit(kind), (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    tid = F.col("tran_idx").cast("string")
    rows = t.select(line("gene", F.concat(F.lit("ID=gene:G"), tid, F.lit(";gene_id=G"), tid, F.lit(";gene_type=protein_coding;level=2"))).alias("value"))
    rows = rows.unionByName(t.select(line("transcript", F.concat(F.lit("ID=transcript:T"), tid, F.lit(";Parent=gene:G"), tid, F.lit(";transcript_type=lncRNA"))).alias("value")))
    return rows.unionByName(e.select(line("exon", F.concat(F.lit("ID=e"), tid, F.lit(";Parent=transcript:T"), tid)).alias("value")))


@query("s05_gff3", f"WITH {EXON} SELECT 'T' || tran_idx AS tran_id, 'G' || tran_idx AS gene_id, chrom, strand, start_pos, end_pos, row_number() OVER ({UPW}) - 1 AS index FROM exon")
def gff3(spark, d):
    """Exons with their transcripts and genes, from GFF3 lines in any order."""
    from strandlake.sources.gff import tables

    t = tables(_gff(spark, d))
    tran = t["transcripts"].select("tran_idx", F.col("id").alias("tran_id"), "gene_idx")
    gene = t["genes"].select("gene_idx", F.col("id").alias("gene_id"))
    return t["exons"].join(tran, "tran_idx").join(gene, "gene_idx").select("tran_id", "gene_id", "chrom", "strand", "start_pos", "end_pos", "index")


@query("s07_ucsc", f"WITH {EXON} SELECT 'NM_' || tran_idx AS name, chrom, strand, start_pos, end_pos FROM exon")
def ucsc(spark, d):
    """Exons from lines with lists of starts and ends."""
    from strandlake.sources.ucsc import exon_rows

    e = exons(spark, d).groupBy("tran_idx", "chrom", "strand").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("x"))
    many = lambda c: F.concat(F.array_join(F.transform("x", lambda y: y[c].cast("string")), ","), F.lit(","))
    return exon_rows(e.select(F.concat(F.lit("NM_"), F.col("tran_idx").cast("string")).alias("name"), "chrom", "strand", many("start_pos").alias("exonStarts"), many("end_pos").alias("exonEnds"))).select("name", "chrom", "strand", "start_pos", "end_pos")


@query("f04_sam_lines", f"{cte('reads')} SELECT chrom, pos, flag, left_len + right_len AS matched FROM reads WHERE (flag & 2304) = 0 AND (flag & 4) = 0 AND (flag & 1024) = 0")
def sam(spark, d):
    from strandlake.operators import reads as rd
    from strandlake.sources.sam import alignments

    n = lambda c: F.col(c).cast("string")
    cigar = F.concat(n("left_len"), F.lit("M"), n("skip"), F.lit("N"), n("right_len"), F.lit("M"))
    text = F.concat_ws("\t", F.lit("r"), n("flag"), "chrom", (F.col("pos") + 1).cast("string"), F.lit("255"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    a = alignments(relation(spark, d, "reads").select(text.alias("value")))
    return a.select("chrom", "pos", "flag", rd.consumed(rd.operations(F.col("cigar")), "M").alias("matched"))


@query("s20_aliases", "SELECT 'chr' || n_nationkey AS canonical, n_name AS alias FROM nation UNION ALL SELECT 'chr' || n_nationkey, 'chr' || n_nationkey FROM nation")
def alias_lines(spark, d):
    from strandlake.sources.assembly import alias_rows

    t = table(spark, d, "nation").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"), F.lit("\t"), F.col("n_name")).alias("value"))
    return alias_rows(t, ["ucsc", "name"]).select("canonical", "alias")


@query("k06_fasta", f"WITH {SEQ}, p AS (SELECT doc_id, seq, unnest(range(0, CAST(ceil(length(seq) / 60.0) AS BIGINT))) AS i FROM seq WHERE length(seq) > 0) SELECT doc_id, i AS line, substr(seq, i * 60 + 1, 60) AS text FROM p")
def fasta(spark, d):
    s = sequences(spark, d)
    return dna.chunked(s.select(F.col("doc_id").alias("chrom"), "seq"), 60).select(F.col("chrom").alias("doc_id"), F.col("chunk").alias("line"), F.col("seq").alias("text"))
