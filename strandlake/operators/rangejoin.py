"""Positional lookups of many windows at once: range joins by classes of length.

Catalyst has no range join: an overlap predicate becomes an equi-join on chromosome and
strand with a residual filter, quadratic within a chromosome. Here every row has a class, the
power of two that its length doesn't exceed, and lies at home in one bin of its class, that of
its start. Of a pair the longer one (elements, if the classes are the same) is met at
home by the shorter one, which probes the two or three bins of the longer one's class from which
it can be reached. So a pair meets once, no distinct is needed, and a row of any length
becomes a few rows: one at home and three for every longer class that the other side
has. Which classes there are is measured, or given by a caller who knows. The exact predicate is
the residual. Lookups that align an end are plain equi-joins. Joins of hot bins are left
to adaptive execution, which splits them as both inputs are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.intervals import Iv

#: Rows up to this length are of one class, unless the caller says otherwise.
WIDTH = 1 << 10
#: Classes by which a window may exceed the shortest elements and still go to every bin of theirs.
SLACK = 5


def length_class(start: Column, end: Column, width: int = WIDTH) -> Column:
    """The class of an interval: the least n, not under that of `width`, with 2^n not under its length."""
    return F.greatest(F.lit(max(0, (width - 1).bit_length())), F.ceil(F.log2(F.greatest(end - start, F.lit(1)))).cast("int"))


def lengths(rows: DataFrame, *keys: str, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """keys, class, n, max_length: how many rows of each class of length there are, and the longest."""
    n = F.col(end) - F.col(start)
    return rows.groupBy(*keys, length_class(F.col(start), F.col(end), 1).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("max_length"))


def length_classes(rows: DataFrame, width: int = WIDTH, start: str = "start_pos", end: str = "end_pos") -> list[int]:
    """The classes of a side, ascending: two columns are read, and one number comes back, a bit for each class."""
    bits = rows.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), length_class(F.col(start), F.col(end), width))).alias("bits")).first()["bits"] or 0
    return [n for n in range(63) if bits >> n & 1]


def _unstranded(queries: DataFrame, stranded: bool, flip: bool) -> DataFrame:
    """Queries as an unstranded table takes them: on its plus strand, or not at all on the minus strand."""
    if stranded:
        return queries
    if flip:
        return queries.withColumn("q_strand", F.lit("+"))
    wrong = F.raise_error(F.lit("an unstranded table has no ends on the minus strand")).cast("string")
    return queries.withColumn("q_strand", F.when(F.col("q_strand") == "-", wrong).otherwise(F.col("q_strand")))


def _spread(rows: DataFrame, name: str, home: bool, own: Column, low: Column, high: Column, mine: list[int], theirs: list[int]) -> DataFrame:
    """A row at home and in every bin of the other side's longer classes from which it is reached: the column `name`, one number a place.

    Elements probe classes longer than their own, queries their own too. Places that nothing can meet, by the classes of both
    sides, aren't made: where all rows are of one class, elements are one row each and queries three. A place holds the
    bin, the class and whose home it is.
    """
    at = lambda x, c: F.call_function("shiftright", x.cast("long"), c)
    place = lambda b, c, whose: b * 128 + (c * 2 + int(whose)).cast("long")
    least = min(mine, default=0)
    own = F.lit(least) if len(mine) < 2 else own

    def probes(n: int) -> Column:
        c = F.lit(n)
        found = F.sequence(place(at(low, c) - 1, c, not home), place(F.greatest(at(high, c), at(low, c)), c, not home), F.lit(128).cast("long"))
        sure = n > max(mine) if home else n >= max(mine)
        return found if sure else F.when(own < c if home else own <= c, found).otherwise(F.array().cast("array<bigint>"))

    longer = [n for n in theirs if (n > least if home else n >= least)]
    # the other side probes a home only from a class below it, or, of elements, from the same one
    met = any(t <= n if home else t < n for t in theirs for n in mine)
    here = place(at(low, own), own, home)
    if not longer:
        return rows.withColumn(name, here if met else F.lit(None).cast("long"))
    every = [*([F.array(here)] if met else []), *(probes(n) for n in longer)]
    return rows.withColumn(name, F.explode(F.concat(*every) if len(every) > 1 else every[0]))


Classes = tuple[list[int], list[int]]


def _joined(elements: DataFrame, queries: DataFrame, low: Column, high: Column, q_low: Column, q_high: Column, residual: Column, width: int, classes: Classes | None) -> DataFrame:
    """Pairs for which `residual` holds; it has to imply that the stretches low to high and q_low to q_high, ends included, touch."""
    s, e, qs, qe = "_low", "_high", "_q_low", "_q_high"
    named, asked = elements.withColumns({s: low, e: high}), queries.withColumns({qs: q_low, qe: q_high})
    if classes is None:
        classes = length_classes(named, width, s, e), length_classes(asked, width, qs, qe)
    own, q_own = length_class(F.col(s), F.col(e), width), length_class(F.col(qs), F.col(qe), width)
    a = _spread(named, "_place", True, own, F.col(s), F.col(e), *classes)
    b = _spread(asked, "_q_place", False, q_own, F.col(qs), F.col(qe), *classes[::-1])
    on = (F.col("chrom") == F.col("q_chrom")) & (F.col("strand") == F.col("q_strand")) & (F.col("_place") == F.col("_q_place"))
    if "refg" in elements.columns and "q_refg" in queries.columns:
        on = on & (F.col("refg") == F.col("q_refg"))
    return a.join(b, on & residual).drop(s, e, "_place", qs, qe, "_q_place")


# elements: chrom, strand, start_pos, end_pos, ...; queries: q_chrom, q_strand, q_start, q_end, ...


def find_overlapping(elements: DataFrame, queries: DataFrame, width: int = WIDTH, stranded: bool = True, classes: Classes | None = None) -> DataFrame:
    """Pairs that share a base, or of which an empty one lies strictly inside the other."""
    s, e, qs, qe = (F.col(c) for c in ("start_pos", "end_pos", "q_start", "q_end"))
    return _joined(elements, _unstranded(queries, stranded, True), s, e, qs, qe, (s < qe) & (qs < e), width, classes)


def find_within(elements: DataFrame, queries: DataFrame, width: int = WIDTH, stranded: bool = True, classes: Classes | None = None) -> DataFrame:
    """Elements that lie within the query; an empty element on the query's 5' edge isn't found."""
    s, e, qs, qe = (F.col(c) for c in ("start_pos", "end_pos", "q_start", "q_end"))
    inside = (s >= qs) & (e <= qe) & F.when(F.col("strand") == "+", e > qs).otherwise(s < qe)
    own, asked = classes or (length_classes(elements, width), length_classes(queries, width, "q_start", "q_end"))
    # what is longer than every query lies within none, and would be met by all of them in the bins of its class
    if asked and own and own[-1] > asked[-1]:
        elements, own = elements.where(length_class(s, e, width) <= asked[-1]), [c for c in own if c <= asked[-1]]
    classes = own, asked
    return _joined(elements, _unstranded(queries, stranded, True), s, e, qs, qe, inside, width, classes)


def _point(elements: DataFrame, queries: DataFrame, at: Column, width: int, stranded: bool, classes: Classes | None) -> DataFrame:
    qs, qe = F.col("q_start"), F.col("q_end")
    e = elements.withColumn("_point", at)
    p = F.col("_point")
    # a base is of the least class, whatever the elements' lengths are
    known = classes or ([max(0, (width - 1).bit_length())], length_classes(queries, width, "q_start", "q_end"))
    return _joined(e, _unstranded(queries, stranded, False), p, p, qs, qe, (p >= qs) & (p < qe), width, known).drop("_point")


def find_5p_within(elements: DataFrame, queries: DataFrame, width: int = WIDTH, stranded: bool = True, classes: Classes | None = None) -> DataFrame:
    """Elements whose 5'-most base lies in the query."""
    return _point(elements, queries, Iv.of().pos5, width, stranded, classes)


def find_3p_within(elements: DataFrame, queries: DataFrame, width: int = WIDTH, stranded: bool = True, classes: Classes | None = None) -> DataFrame:
    """Elements whose 3'-most base lies in the query."""
    return _point(elements, queries, Iv.of().pos3, width, stranded, classes)


def _same(elements: DataFrame, queries: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    on = (F.col("chrom") == F.col("q_chrom")) & (F.col("strand") == F.col("q_strand"))
    if "refg" in elements.columns and "q_refg" in queries.columns:
        on = on & (F.col("refg") == F.col("q_refg"))
    for a, b in pairs:
        on = on & (a == b)
    return elements.join(queries, on)


_Q = ("q_chrom", "q_strand", "q_start", "q_end")


def find_5p_aligned(elements: DataFrame, queries: DataFrame, stranded: bool = True) -> DataFrame:
    """Elements with the query's 5' end: an equi-join."""
    return _same(elements, _unstranded(queries, stranded, False), (Iv.of().end5.start, Iv.of(*_Q).end5.start))


def find_3p_aligned(elements: DataFrame, queries: DataFrame, stranded: bool = True) -> DataFrame:
    """Elements with the query's 3' end: an equi-join."""
    return _same(elements, _unstranded(queries, stranded, False), (Iv.of().end3.start, Iv.of(*_Q).end3.start))


def find_exact(elements: DataFrame, queries: DataFrame, stranded: bool = True) -> DataFrame:
    return _same(elements, _unstranded(queries, stranded, True), (F.col("start_pos"), F.col("q_start")), (F.col("end_pos"), F.col("q_end")))


def overlapping_any(elements: DataFrame, queries: DataFrame, width: int = WIDTH, keep: bool = True, classes: Classes | None = None) -> DataFrame:
    """Elements that overlap any query (semi-join), or none of them (anti-join); all columns, repeated rows stay.

    Each element stays one row, at home in its class, and queries go to every bin of every class from which an
    element reaches them: one join tells. Where queries are far longer than the shortest elements they would go
    to very many bins; then the elements' distinct places are joined as pairs are, and the places found tell.
    """
    s, e, qs, qe = (F.col(c) for c in ("start_pos", "end_pos", "q_start", "q_end"))
    classes = classes or (length_classes(elements, width), length_classes(queries, width, "q_start", "q_end"))
    where = [c for c in ("refg", "chrom", "strand", "start_pos", "end_pos") if c != "refg" or ("refg" in elements.columns and "q_refg" in queries.columns)]
    how = "left_semi" if keep else "left_anti"
    if classes[0] and classes[1] and classes[1][-1] > classes[0][0] + SLACK:
        hits = find_overlapping(elements.select(*where).distinct(), queries, width, classes=classes).select(*where).distinct()
        return elements.join(hits, where, how).select(*elements.columns)
    at = lambda x, c: F.call_function("shiftright", x.cast("long"), c)
    one = elements.withColumn("_class", length_class(s, e, width)).withColumn("_bin", at(s, F.col("_class")))
    q = queries.withColumn("_q_class", F.explode(F.array(*(F.lit(c) for c in classes[0])).cast("array<int>")))
    q = q.withColumn("_q_bin", F.explode(F.sequence(at(qs, F.col("_q_class")) - 1, at(F.greatest(qe - 1, qs), F.col("_q_class")))))
    on = (F.col("chrom") == F.col("q_chrom")) & (F.col("strand") == F.col("q_strand")) & (F.col("_class") == F.col("_q_class")) & (F.col("_bin") == F.col("_q_bin")) & (s < qe) & (qs < e)
    if "refg" in where:
        on = on & (F.col("refg") == F.col("q_refg"))
    return one.join(q, on, how).drop("_class", "_bin")


def allow_exclude(elements: DataFrame, allow: DataFrame | None, exclude: DataFrame | None, width: int = WIDTH) -> DataFrame:
    """Elements that overlap nothing excluded and, if anything is allowed, something allowed."""
    if exclude is not None:
        elements = overlapping_any(elements, exclude, width, keep=False)
    return elements if allow is None else overlapping_any(elements, allow, width)
