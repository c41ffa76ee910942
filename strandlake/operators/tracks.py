"""Dense per-position tracks stored as blocks.

A track is blocks(chrom, strand, start_pos, end_pos, values array) that don't overlap, and
a `Track` with its default, resolution and encoding. Positions are only ever spread
out inside query windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .rangejoin import find_overlapping
from .scan import STRIDE, piece, scanned

#: Bits of the dictionary and integer encodings.
INTEGERS = {"u1": (0, 1), "u2": (0, 3), "u3": (0, 7), "u4": (0, 15), "u5": (0, 31), "u6": (0, 63), "u8": (0, 255), "i8": (-128, 127)}
DICTIONARIES = {"f2": 2, "f3": 3, "f4": 4, "f5": 5, "f6": 6, "f8": 8}
#: What each encoding can be decoded as.
DTYPES = {
    "m0": ("bool", "uint8", "int8", "float16", "float32"), "u1": ("bool", "uint8", "float16", "float32"),
    "u2": ("uint8", "float16", "float32"), "u3": ("uint8", "float16", "float32"), "u4": ("uint8", "float16", "float32"), "u5": ("uint8", "float16", "float32"), "u6": ("uint8", "float16", "float32"),
    "u8": ("uint8", "float16", "float32"), "i8": ("int8", "float16", "float32"),
    "f2": ("float16", "float32"), "f3": ("float16", "float32"), "f4": ("float16", "float32"), "f5": ("float16", "float32"), "f6": ("float16", "float32"), "f8": ("float16", "float32"),
    "f16": ("float16", "float32"), "f32": ("float32",),
}
#: Spark has no unsigned byte and no half: a wider type holds them.
_SPARK_TYPES = {"bool": "boolean", "uint8": "smallint", "int8": "tinyint", "float16": "float", "float32": "float"}
#: Positions of a track over which a run of defaults is left out, and the tolerance.
MIN_RUN, MIN_DELTA = 48, 0.0


@dataclass(frozen=True)
class Track:
    """What a track's blocks mean."""

    default: float = 0.0
    resolution: int = 1
    stranded: bool = False
    etype: str = "f32"
    dim: int = 1
    dictionary: tuple[float, ...] | None = None


def default_dictionary(bits: int) -> tuple[float, ...]:
    return tuple(float(x) for x in np.linspace(0, 1, 1 << bits))


def check_dictionary(values: tuple[float, ...], etype: str) -> tuple[float, ...]:
    """Non-decreasing and finite but for one last NaN; of the encoding's size."""
    body = values[:-1] if values and np.isnan(values[-1]) else values
    if etype not in DICTIONARIES or len(values) != 1 << DICTIONARIES[etype]:
        raise ValueError(f"{etype} takes no dictionary of {len(values)} values")
    if not np.isfinite(body).all() or (np.diff(body) < 0).any():
        raise ValueError("a dictionary is finite and doesn't decrease")
    return values


def quantised(value: Column, dictionary: tuple[float, ...]) -> Column:
    """The nearest entry, the upper one of a tie; beyond the ends, and infinite, is an error; NaN needs a NaN slot."""
    has_nan = bool(np.isnan(dictionary[-1]))
    body = dictionary[:-1] if has_nan else dictionary
    entries = F.array(*(F.lit(float(x)) for x in body))
    best = F.aggregate(entries, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull() | (F.abs(x - value) <= F.abs(acc - value)), x).otherwise(acc))
    bad = F.raise_error(F.lit("a value lies outside the dictionary")).cast("double")
    inside = F.when((value >= body[0]) & (value <= body[-1]), best).otherwise(bad)
    return F.when(F.isnan(value), F.lit(float("nan")) if has_nan else bad).otherwise(inside)


def integral(value: Column, etype: str) -> Column:
    low, high = INTEGERS[etype]
    return F.when((value >= low) & (value <= high) & (value == F.floor(value)), value).otherwise(F.raise_error(F.lit(f"a value doesn't fit {etype}")).cast("double"))


def half(value: Column) -> Column:
    """Rounded to half precision, which Spark lacks."""

    def rounded(values):
        import numpy as np
        import pandas as pd

        return pd.Series(values.to_numpy(np.float64).astype(np.float16).astype(np.float64))

    # pandas gives NaN back as null
    return F.when(F.isnan(value), value.cast("double")).otherwise(F.pandas_udf(rounded, DoubleType())(value))


def encoded(value: Column, track: Track) -> Column:
    """A value as the encoding keeps it."""
    if track.etype == "m0":
        return F.lit(1.0)
    if track.etype in INTEGERS:
        return integral(value, track.etype)
    if track.etype in DICTIONARIES:
        return quantised(value, track.dictionary or default_dictionary(DICTIONARIES[track.etype]))
    return half(value) if track.etype == "f16" else value.cast("float").cast("double")


def as_dtype(value: Column, etype: str, dtype: str) -> Column:
    """An encoded value in the type asked for; ValueError if the encoding can't be decoded as it."""
    if dtype not in DTYPES.get(etype, ()):
        raise ValueError(f"{etype} can't be decoded as {dtype}")
    return (half(value) if dtype == "float16" else value).cast(_SPARK_TYPES[dtype])


def placed(blocks: DataFrame, strandedness: str, dim: int = 1) -> DataFrame:
    """blocks(chrom, strand, start_pos, end_pos, values) as they were given, in reference order.

    single_stranded: both strands share the plus strand's data, and minus data are an error.
    strand_unaware: data of either strand are in reference order already. strand_aware: they run
    from 5' to 3', so those of the minus strand are turned round, position by position.
    """
    minus = F.col("strand") == "-"
    if strandedness == "single_stranded":
        return blocks.withColumn("strand", F.when(minus, F.raise_error(F.lit("minus-strand data in a single-stranded track")).cast("string")).otherwise(F.col("strand")))
    if strandedness == "strand_unaware":
        return blocks
    if strandedness != "strand_aware":
        raise ValueError(f"unknown strandedness: {strandedness}")
    last = (F.size("values") / dim).cast("int") - 1
    turned = F.reverse("values") if dim == 1 else F.flatten(F.transform(F.sequence(last, F.lit(0), F.lit(-1)), lambda i: F.slice("values", i * dim + 1, dim)))
    return blocks.withColumn("values", F.when(minus & (F.size("values") > 0), turned).otherwise(F.col("values")))


def transformed(value: Column, a: float, b: float, c: float, d: float) -> Column:
    """The line that takes a to c and b to d."""
    return value * F.lit((d - c) / (b - a)) + F.lit((c * b - a * d) / (b - a))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def decode(blocks: DataFrame, windows: DataFrame, track: Track = Track()) -> DataFrame:
    """Values of every position of windows(q_id, q_chrom, q_strand, q_start, q_end): q_id, i (from 0, in sense order), value.

    blocks may hold one `value` for the whole block or an array `values`, one per grid
    position, or track.dim of them, which then come as rows of their own with their `dim`.
    Blocks meet windows in a range join, so only positions inside windows that
    have data are joined; the rest take the default.
    """
    res = track.resolution
    data = blocks if "strand" in blocks.columns else blocks.withColumn("strand", F.lit("+"))
    q = windows.withColumn("_sense", F.col("q_strand"))
    if not track.stranded:
        q = q.withColumn("q_strand", F.lit("+"))
    if res > 1:
        q = q.withColumns({"_s": F.col("q_start"), "_e": F.col("q_end")})
    hits = find_overlapping(data, q)
    pos = F.explode(F.sequence(F.greatest("start_pos", "q_start"), F.least("end_pos", "q_end") - 1))
    at = hits.where("least(end_pos, q_end) > greatest(start_pos, q_start)").withColumn("pos", pos)
    nth = F.floor((F.col("pos") - F.col("start_pos")) / res).cast("int")
    many = track.dim > 1
    if "values" not in blocks.columns:
        value = F.array_repeat("value", track.dim) if many else F.col("value")
    else:
        value = F.slice("values", nth * track.dim + 1, track.dim) if many else F.element_at("values", nth + 1)
    known = at.select("q_id", "pos", ((F.array_repeat(F.lit(1), track.dim) if many else F.lit(1)) if track.etype == "m0" else value).alias("_v"))
    grid = windows.where("q_start < q_end").select("q_id", "q_strand", "q_start", "q_end", F.explode(F.sequence("q_start", F.col("q_end") - 1)).alias("pos"))
    i = F.when(F.col("q_strand") == "-", F.col("q_end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("q_start"))
    default = F.array_repeat(F.lit(track.default), track.dim) if many else F.lit(track.default)
    found = grid.join(known, ["q_id", "pos"], "left").select("q_id", i.alias("i"), F.coalesce("_v", default.cast(dict(known.dtypes)["_v"])).alias("value"))
    return found.select("q_id", "i", F.posexplode("value").alias("dim", "value")) if many else found


def histogram(values: DataFrame, *more: str) -> DataFrame:
    """value -> count at half precision, NaN left out, zeros of either sign one; `more` are further keys such as the dimension."""
    v = half(F.col("value").cast("double"))
    rows = values.select(*more, v.alias("value")).where(~F.isnan("value"))
    return rows.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value"))).groupBy(*more, "value").agg(F.count(F.lit(1)).alias("count"))


def runs(positions: DataFrame, state: Column, adjacent: bool = True, stride: int = STRIDE) -> DataFrame:
    """positions(chrom, strand, pos, ...) with `run`: where the run of one state begins that they lie in.

    A run goes on at the next row of the strand, or, if `adjacent`, at the next position only. Runs of any length are found by scans in
    pieces, so a chromosome is many tasks' work.
    """
    keys, at = ["chrom", "strand"], [piece(F.col("pos"), stride)]
    p = scanned(positions.withColumn("_state", state), keys, ["pos"], at, {"_last": ("max", F.struct("pos", "_state"))})
    goes_on = F.col("_last._state").eqNullSafe(F.col("_state")) & F.col("_last").isNotNull()
    if adjacent:
        goes_on = goes_on & (F.col("_last.pos") == F.col("pos") - 1)
    return scanned(p.withColumn("_new", F.when(~goes_on, F.col("pos"))), keys, ["pos"], at, {"run": ("max", F.col("_new"))}, inclusive=True).drop("_state", "_last", "_new")


def sparsified(positions: DataFrame, track: Track, min_run: int = MIN_RUN, min_delta: float = MIN_DELTA, stride: int = STRIDE) -> DataFrame:
    """positions(chrom, strand, pos, value) without runs of at least min_run defaults; near-defaults become the default."""
    v = F.when(F.abs(F.col("value") - track.default) <= min_delta, F.lit(track.default)).otherwise(F.col("value"))
    p = positions.withColumn("value", v).withColumn("_d", F.coalesce(F.col("value") == track.default, F.lit(False)))
    marked = runs(p, F.col("_d"), stride=stride)
    # a run is counted before the shuffle; only long ones of defaults come back
    long = marked.where("_d").groupBy("chrom", "strand", "run").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_run).drop("_n")
    return marked.join(long.withColumn("_d", F.lit(True)), ["chrom", "strand", "run", "_d"], "left_anti").select(*positions.columns)


def blocks_of(positions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Runs of neighbouring positions as blocks: chrom, strand, start_pos, end_pos, values."""
    run = runs(positions, F.lit(0), stride=stride)
    # a block ends at every CHUNK positions, so that no value grows with the track
    return run.groupBy("chrom", "strand", "run", F.floor(F.col("pos") / 8192).alias("_chunk")).agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values")).drop("run", "_chunk")


def overlapping_blocks(blocks: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Blocks that begin before one of their chromosome and strand has ended: none in a valid track."""
    found = scanned(blocks, ["chrom", "strand"], ["start_pos", "end_pos"], [piece(F.col("start_pos"), stride)], {"_reach": ("max", F.col("end_pos"))})
    return found.where("start_pos < _reach").drop("_reach")
