"""Registered queries of the interval algebra and of its sort and set forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.intervals import Iv
from strandlake.operators.scan import piece, ranked

from .relations import cte, relation

QUERIES: dict = {}
ORACLE: dict = {}
PLUS = "strand = '+'"


def _pair() -> tuple[Iv, Iv]:
    return Iv.of("chrom", "strand", "s", "e"), Iv.of("chrom", "bstrand", "bs", "be")


def _projection(name: str, columns, sql: str) -> None:
    """A query that computes columns(a, b) of every pair of intervals, with its SQL."""

    def query(spark, sf_dir):
        return relation(spark, sf_dir, "pairs").select("id", "line", *(c.alias(k) for k, c in columns(*_pair()).items()))

    QUERIES[name] = query
    ORACLE[name] = f"{cte('pairs')} SELECT id, line, {sql} FROM pairs"


def _ends(iv: Iv, prefix: str = "") -> dict:
    return {f"{prefix}start_pos": iv.start, f"{prefix}end_pos": iv.end}


_projection("i01_construct", lambda a, b: {"chrom": a.chrom, "strand": a.strand, **_ends(a.checked())}, "chrom, strand, s AS start_pos, e AS end_pos")
_projection(
    "i02_string_anchors",
    lambda a, b: {f"at_{k}": a.anchored(v).anchor for k, v in {"start": "start", "end": "end", "p5": "5p", "p3": "3p", "center": "center"}.items()},
    f"""s AS at_start, e AS at_end, CASE WHEN {PLUS} THEN s ELSE e END AS at_p5, CASE WHEN {PLUS} THEN e ELSE s END AS at_p3,
    CASE WHEN {PLUS} THEN s + (e - s) // 2 ELSE e - (e - s) // 2 END AS at_center""",
)
_projection("i03_from_dna0_coord", lambda a, b: _ends(Iv.from_dna0_coord("chrom", "strand", "s")), "s AS start_pos, s + 1 AS end_pos")
_projection("i04_from_dna0", lambda a, b: _ends(Iv.from_dna0("chrom", "strand", "s", "e")), "s AS start_pos, e AS end_pos")
_projection("i05_from_dna1", lambda a, b: _ends(Iv.from_dna1("chrom", "strand", "s", "e")), "s - 1 AS start_pos, e AS end_pos")
def _rna(a):
    return Iv.from_rna1("chrom", F.when(a.plus, F.col("s") + 1).otherwise(-(F.col("e") + 1)), F.when(a.plus, F.col("e") + 1).otherwise(-(F.col("s") + 1)))
_projection("i06_from_rna1", lambda a, b: {"strand": _rna(a).strand, **_ends(_rna(a))}, "strand, s AS start_pos, e + 1 AS end_pos")
_projection("i07_accessors", lambda a, b: {"chromosome": a.chrom, "strand": a.strand, "refg": a.refg, "length": a.length}, "chrom AS chromosome, strand, 'hg19' AS refg, e - s AS length")
_projection(
    "i08_end5_end3", lambda a, b: {**_ends(a.end5, "p5_"), **_ends(a.end3, "p3_")},
    f"CASE WHEN {PLUS} THEN s ELSE e END AS p5_start_pos, CASE WHEN {PLUS} THEN s ELSE e END AS p5_end_pos, CASE WHEN {PLUS} THEN e ELSE s END AS p3_start_pos, CASE WHEN {PLUS} THEN e ELSE s END AS p3_end_pos",
)
_projection("i09_shift", lambda a, b: _ends(a.shift(17)), f"CASE WHEN {PLUS} THEN s + 17 ELSE s - 17 END AS start_pos, CASE WHEN {PLUS} THEN e + 17 ELSE e - 17 END AS end_pos")
_projection("i10_expand", lambda a, b: _ends(a.expand(10, 3)), f"CASE WHEN {PLUS} THEN s - 10 ELSE s - 3 END AS start_pos, CASE WHEN {PLUS} THEN e + 3 ELSE e + 10 END AS end_pos")
_HIT = "strand = bstrand AND s < be AND bs < e"
_projection("i11_intersect", lambda a, b: _ends(a.intersect(b)), f"CASE WHEN {_HIT} THEN greatest(s, bs) END AS start_pos, CASE WHEN {_HIT} THEN least(e, be) END AS end_pos")


def _subtract(spark, sf_dir):
    piece = relation(spark, sf_dir, "pairs").select("id", "line", F.explode(_pair()[0].subtract(_pair()[1])).alias("p"))
    return piece.select("id", "line", "p.start_pos", "p.end_pos")


QUERIES["i12_subtract"] = QUERIES["o10_difference"] = _subtract
ORACLE["i12_subtract"] = ORACLE["o10_difference"] = f"""{cte("pairs")}, hit AS (SELECT *, {_HIT} AND greatest(s, bs) < least(e, be) AS h FROM pairs)
SELECT id, line, s AS start_pos, e AS end_pos FROM hit WHERE NOT h
UNION ALL SELECT id, line, s, greatest(s, bs) FROM hit WHERE h AND s < greatest(s, bs)
UNION ALL SELECT id, line, least(e, be), e FROM hit WHERE h AND least(e, be) < e"""
_projection("i13_strands", lambda a, b: {"positive": a.plus, "opposite": a.opposite().strand, "as_plus": a.with_strand("+").strand}, f"{PLUS} AS positive, CASE WHEN {PLUS} THEN '-' ELSE '+' END AS opposite, '+' AS as_plus")
_projection("i14_upstream_of", lambda a, b: {"upstream": a.upstream_of(b)}, f"strand = bstrand AND CASE WHEN {PLUS} THEN e <= bs ELSE s >= be END AS upstream")
_projection("i15_dnstream_of", lambda a, b: {"dnstream": a.dnstream_of(b)}, f"strand = bstrand AND CASE WHEN {PLUS} THEN s >= be ELSE e <= bs END AS dnstream")
_projection("i16_contains", lambda a, b: {"holds": a.contains(b)}, "strand = bstrand AND bs >= s AND be <= e AS holds")
_projection("i17_within", lambda a, b: {"inside": a.within(b)}, "strand = bstrand AND s >= bs AND e <= be AS inside")
_projection("i18_overlaps", lambda a, b: {"hit": a.overlaps(b)}, f"{_HIT} AS hit")
_projection("i19_spanning", lambda a, b: _ends(a.spanning(b)), "least(s, bs) AS start_pos, greatest(e, be) AS end_pos")
_projection(
    "i20_midpoint", lambda a, b: _ends(a.midpoint), "s + (e - s) // 2 AS start_pos, e - (e - s) // 2 AS end_pos",
)
_projection(
    "i21_distance", lambda a, b: {"mid": a.distance(b), "p5": a.distance(b, "end5"), "p3": a.distance(b, "end3")},
    f"""abs((s + e) / 2.0 - (bs + be) / 2.0) AS mid,
    CAST(abs(CASE WHEN {PLUS} THEN s ELSE e END - CASE WHEN bstrand = '+' THEN bs ELSE be END) AS DOUBLE) AS p5,
    CAST(abs(CASE WHEN {PLUS} THEN e ELSE s END - CASE WHEN bstrand = '+' THEN be ELSE bs END) AS DOUBLE) AS p3""",
)
ORACLE["i21_distance"] = ORACLE["i21_distance"].replace("abs((s + e) / 2.0 - (bs + be) / 2.0)", "CAST(abs((s + e) - (bs + be)) AS DOUBLE) / 2")
_projection(
    "i22_conventions", lambda a, b: {"dna1_start": a.as_dna1()[0], "dna1_end": a.as_dna1()[1], "rna1_start": a.as_rna1()[0], "rna1_end": a.as_rna1()[1], "ucsc": a.as_ucsc()},
    f"""CASE WHEN e > s THEN s + 1 END AS dna1_start, CASE WHEN e > s THEN e END AS dna1_end,
    CASE WHEN e > s THEN CASE WHEN {PLUS} THEN s + 1 ELSE -e END END AS rna1_start, CASE WHEN e > s THEN CASE WHEN {PLUS} THEN e ELSE -(s + 1) END END AS rna1_end,
    chrom || ':' || (s + 1) || '-' || e AS ucsc""",
)
_projection("i23_with_anchor", lambda a, b: {"anchor": a.anchored(F.col("bs"), 2).anchor, "anchor_offset": a.anchored(F.col("bs"), 2).anchor_offset}, "bs AS anchor, CAST(2 AS BIGINT) AS anchor_offset")


def _ordered(spark, sf_dir):
    iv = Iv.of()
    rows = relation(spark, sf_dir, "iv").select("chrom", "strand", "start_pos", "end_pos")
    return ranked(rows, ["chrom"], [iv.pos5, F.when(iv.plus, 1).otherwise(0), iv.pos3], [piece(iv.pos5)], "place")


QUERIES["i24_order"] = _ordered
ORACLE["i24_order"] = f"""{cte("iv")} SELECT chrom, strand, start_pos, end_pos, dense_rank() OVER (PARTITION BY chrom ORDER BY
CASE WHEN {PLUS} THEN start_pos ELSE end_pos - 1 END, CASE WHEN {PLUS} THEN 1 ELSE 0 END, CASE WHEN {PLUS} THEN end_pos - 1 ELSE start_pos END) AS place FROM iv"""
_projection("i25_same_chromosome", lambda a, b: {"same": a.chrom == b.chrom}, "TRUE AS same")
_projection("i26_text", lambda a, b: {"shown": a.anchored("5p", 1).text()}, f"""'Interval("' || chrom || '", "' || strand || '", ' || s || ', ' || e || ', "hg19", ' || CASE WHEN {PLUS} THEN s ELSE e END || ', 1)' AS shown""")


def _unique(spark, sf_dir):
    return relation(spark, sf_dir, "iv").select("chrom", "strand", "start_pos", "end_pos").distinct()


QUERIES["o11_unique_intervals"] = _unique
ORACLE["o11_unique_intervals"] = f"{cte('iv')} SELECT DISTINCT chrom, strand, start_pos, end_pos FROM iv"
