"""Interval algebra as column expressions.

An `Iv` bundles the columns of a stranded, half-open interval (0-based, on the reference
strand). Every operation is an expression that Catalyst can fold, push down and compile;
nothing here runs Python per row. Empty intervals (start = end) are valid.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)



@dataclass(frozen=True)
class Iv:
    """The columns of an interval. anchor is null where there is none."""

    chrom: Column
    strand: Column
    start: Column
    end: Column
    refg: Column
    anchor: Column
    anchor_offset: Column

    @staticmethod
    def of(chrom="chrom", strand="strand", start="start_pos", end="end_pos", refg=None, anchor=None, anchor_offset=None) -> Iv:
        return Iv(_col(chrom), _col(strand), _col(start), _col(end), F.lit("hg19") if refg is None else _col(refg), F.lit(None).cast("long") if anchor is None else _col(anchor), F.lit(0).cast("long") if anchor_offset is None else _col(anchor_offset))

    # -- construction ---------------------------------------------------------

    def checked(self) -> Iv:
        """start, failing where start is beyond the end."""
        bad = F.raise_error(F.lit("an interval's start is beyond its end"))
        return replace(self, start=F.when(self.start <= self.end, self.start).otherwise(bad.cast("long")))

    def anchored(self, anchor, offset=0) -> Iv:
        """Anchor at a position, or at "start", "end", "5p", "3p" or "center" (which rounds towards the 5' end)."""
        half = F.floor(self.length / 2).cast("long")
        at = {
            "start": self.start, "end": self.end, "5p": F.when(self.plus, self.start).otherwise(self.end), "3p": F.when(self.plus, self.end).otherwise(self.start),
            "center": F.when(self.plus, self.start + half).otherwise(self.end - half),
        }
        if isinstance(anchor, str) and anchor not in at:
            raise ValueError(f"unknown anchor: {anchor}")
        return replace(self, anchor=at[anchor] if isinstance(anchor, str) else _col(anchor).cast("long"), anchor_offset=_col(offset).cast("long"))

    @staticmethod
    def from_dna0_coord(chrom, strand, pos, refg=None) -> Iv:
        return Iv.of(chrom, strand, _col(pos), _col(pos) + 1, refg)

    @staticmethod
    def from_dna0(chrom, strand, start, end, refg=None) -> Iv:
        return Iv.of(chrom, strand, start, end, refg)

    @staticmethod
    def from_dna1(chrom, strand, start, end, refg=None) -> Iv:
        """1-based, both ends included."""
        return Iv.of(chrom, strand, _col(start) - 1, end, refg)

    @staticmethod
    def from_rna1(chrom, start, end, refg=None) -> Iv:
        """1-based, both ends included; negative positions are on the reverse strand."""
        s, e = _col(start), _col(end)
        return Iv.of(chrom, F.when(s > 0, "+").otherwise("-"), F.least(F.abs(s), F.abs(e)) - 1, F.greatest(F.abs(s), F.abs(e)), refg)

    # -- properties -----------------------------------------------------------

    @property
    def plus(self) -> Column:
        return self.strand == "+"

    @property
    def length(self) -> Column:
        return self.end - self.start

    @property
    def pos5(self) -> Column:
        """Position of the 5'-most base."""
        return F.when(self.plus, self.start).otherwise(self.end - 1)

    @property
    def pos3(self) -> Column:
        """Position of the 3'-most base."""
        return F.when(self.plus, self.end - 1).otherwise(self.start)

    @property
    def end5(self) -> Iv:
        at = F.when(self.plus, self.start).otherwise(self.end)
        return replace(self, start=at, end=at)

    @property
    def end3(self) -> Iv:
        at = F.when(self.plus, self.end).otherwise(self.start)
        return replace(self, start=at, end=at)

    @property
    def midpoint(self) -> Iv:
        half = F.floor(self.length / 2).cast("long")
        return self.expand(-half, -half)

    @property
    def order(self) -> list[Column]:
        """Sort keys: assembly, chromosome name, 5' position, strand (minus first), 3' position, anchor."""
        return [self.refg, self.chrom, self.pos5, F.when(self.plus, 1).otherwise(0), self.pos3, self.anchor, self.anchor_offset]

    # -- geometry -------------------------------------------------------------

    def shift(self, n) -> Iv:
        """n positions downstream."""
        d = F.when(self.plus, _col(n)).otherwise(-_col(n))
        return replace(self, start=self.start + d, end=self.end + d)

    def expand(self, up, down=None) -> Iv:
        """Grow upstream and downstream; negative amounts shrink."""
        up, down = _col(up), _col(up if down is None else down)
        return replace(self, start=self.start - F.when(self.plus, up).otherwise(down), end=self.end + F.when(self.plus, down).otherwise(up))

    def with_strand(self, strand) -> Iv:
        return replace(self, strand=_col(strand) if not isinstance(strand, str) else F.lit(strand))

    def opposite(self) -> Iv:
        return replace(self, strand=F.when(self.plus, "-").otherwise("+"))

    def same_strand(self, o: Iv) -> Column:
        return (self.refg == o.refg) & (self.chrom == o.chrom) & (self.strand == o.strand)

    def upstream_of(self, o: Iv) -> Column:
        return self.same_strand(o) & F.when(self.plus, self.end <= o.start).otherwise(self.start >= o.end)

    def dnstream_of(self, o: Iv) -> Column:
        return self.same_strand(o) & F.when(self.plus, self.start >= o.end).otherwise(self.end <= o.start)

    def contains(self, o: Iv) -> Column:
        return self.same_strand(o) & (o.start >= self.start) & (o.end <= self.end)

    def within(self, o: Iv) -> Column:
        return o.contains(self)

    def overlaps(self, o: Iv) -> Column:
        return self.same_strand(o) & (self.start < o.end) & (o.start < self.end)

    def intersect(self, o: Iv) -> Iv:
        """Null positions where they don't overlap."""
        hit = self.overlaps(o)
        return replace(self, start=F.when(hit, F.greatest(self.start, o.start)), end=F.when(hit, F.least(self.end, o.end)), anchor=F.lit(None).cast("long"), anchor_offset=F.lit(0).cast("long"))

    def subtract(self, o: Iv) -> Column:
        """An array of structs (start_pos, end_pos); the interval itself if they share no base."""
        both = self.intersect(o)
        piece = lambda s, e: F.struct(s.alias("start_pos"), e.alias("end_pos"))
        cut = F.filter(F.array(piece(self.start, both.start), piece(both.end, self.end)), lambda p: p["start_pos"] < p["end_pos"])
        return F.when(both.start.isNotNull() & (both.start < both.end), cut).otherwise(F.array(piece(self.start, self.end)))

    def spanning(self, o: Iv) -> Iv:
        """From the lesser start to the greater end; null across chromosomes."""
        fits = (self.refg == o.refg) & (self.chrom == o.chrom)
        return replace(self, start=F.when(fits, F.least(self.start, o.start)), end=F.when(fits, F.greatest(self.end, o.end)))

    def distance(self, o: Iv, method: str = "midpoint") -> Column:
        """Between midpoints, 5' ends or 3' ends; null across chromosomes."""
        at = {"midpoint": lambda x: (x.start + x.end) / 2, "end5": lambda x: x.end5.start, "end3": lambda x: x.end3.start}[method]
        return F.when((self.refg == o.refg) & (self.chrom == o.chrom), F.abs(at(self) - at(o)).cast("double"))

    # -- conventions ----------------------------------------------------------

    def as_dna1(self) -> tuple[Column, Column]:
        """Null for empty intervals, which have no such form."""
        some = self.length > 0
        return F.when(some, self.start + 1), F.when(some, self.end)

    def as_rna1(self) -> tuple[Column, Column]:
        some = self.length > 0
        return F.when(some, F.when(self.plus, self.start + 1).otherwise(-self.end)), F.when(some, F.when(self.plus, self.end).otherwise(-(self.start + 1)))

    def as_ucsc(self) -> Column:
        return F.concat(self.chrom, F.lit(":"), (self.start + 1).cast("string"), F.lit("-"), self.end.cast("string"))

    def text(self) -> Column:
        """A printable form."""
        offset = F.when(self.anchor_offset != 0, F.concat(F.lit(", "), self.anchor_offset.cast("string"))).otherwise("")
        anchor = F.when(self.anchor.isNull(), "").otherwise(F.concat(F.lit(", "), self.anchor.cast("string"), offset))
        return F.concat(F.lit('Interval("'), self.chrom, F.lit('", "'), self.strand, F.lit('", '), self.start.cast("string"), F.lit(", "), self.end.cast("string"), F.lit(', "'), self.refg, F.lit('"'), anchor, F.lit(")"))

    def struct(self) -> Column:
        names = ("chromosome", "strand", "start", "end", "refg", "anchor", "anchor_offset")
        cols = (self.chrom, self.strand, self.start.cast("int"), self.end.cast("int"), self.refg, self.anchor.cast("int"), self.anchor_offset.cast("int"))
        return F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True)))
