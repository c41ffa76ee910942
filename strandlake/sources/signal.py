"""WIG, bedGraph and BED signals as track blocks: chrom, strand, start_pos, end_pos, value."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Fixed value: a variableStep section goes on from the one before it up to this gap.
GAP = 8192
_SKIP = "value <> '' AND value NOT LIKE '#%' AND value NOT LIKE 'track%' AND value NOT LIKE 'browser%'"


def bedgraph_rows(text: DataFrame, strand: str = "+") -> DataFrame:
    p = F.split("value", r"\s+")
    return text.where(_SKIP).select(F.get(p, F.lit(0)).alias("chrom"), F.lit(strand).alias("strand"), F.get(p, F.lit(1)).cast("long").alias("start_pos"), F.get(p, F.lit(2)).cast("long").alias("end_pos"), F.get(p, F.lit(3)).cast("double").alias("value"))


def bed_rows(text: DataFrame, categories: list[str] | None = None, stranded: bool = True) -> DataFrame:
    """The score (1 where there is none), or the place of the name in the categories, where an unknown one is an error.

    Strands are + or - exactly if the track is stranded.
    """
    p = F.split("value", r"\t")
    if categories is None:
        value = F.coalesce(F.get(p, F.lit(4)).try_cast("double"), F.lit(1.0))
    else:
        at = F.array_position(F.array(*(F.lit(c) for c in categories)), F.get(p, F.lit(3)))
        value = F.when(at > 0, (at - 1).cast("double")).otherwise(F.raise_error(F.lit("unknown category")).cast("double"))
    given = F.coalesce(F.get(p, F.lit(5)), F.lit("."))
    fits = given.isin("+", "-") if stranded else given == "."
    strand = F.when(fits, F.when(given == ".", "+").otherwise(given)).otherwise(F.raise_error(F.lit("a strand that doesn't fit the track")).cast("string"))
    return text.where(_SKIP).select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("long").alias("start_pos"), F.get(p, F.lit(2)).cast("long").alias("end_pos"), strand.alias("strand"), value.alias("value"))


#: Rows of a WIG file that are handed on at once, and splits of files up to which what comes before them is broadcast.
BATCH, SPLITS = 1 << 16, 100_000
_SECTION = "struct<header:string,rows:long,last:string>"


def wig(spark: SparkSession, path: str, strand: str = "+", resolution: int | None = None) -> DataFrame:
    """fixedStep and variableStep sections of the files of a path, each read in as many splits as Spark makes of it.

    A header holds for the lines after it, so files are read twice: first each split gives
    the sections that it leaves behind (one row), which are put together by file, in
    order; then it is parsed with the sections before it. Only one row a split is
    shuffled. A file that can't be split (gzip) is one split. Empty files have no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    left = store.stored(lines.mapInPandas(_left_behind, f"file string, at long, before {_SECTION}, headers int, previous {_SECTION}, current {_SECTION}"))
    schema = f"file string, at long, split long, previous {_SECTION}, current {_SECTION}"
    before = store.stored(left.withColumn("split", F.monotonically_increasing_id()).groupBy("file").applyInPandas(_sections_before, schema))
    few = before.count() <= SPLITS
    numbered = lines if few else lines.withColumn("line", F.monotonically_increasing_id())
    joined = numbered.join(F.broadcast(before) if few else before, ["file", "at"], "left")
    if not few:
        joined = joined.repartition("split").sortWithinPartitions("split", "line")
    known = F.when(F.col("split").isNull(), F.raise_error(F.lit("the files are split in another way than before")).cast("long")).otherwise(F.col("split"))

    def run(frames: Iterator) -> Iterator:
        from itertools import islice

        import pandas as pd

        for _, first, values in _by_split(frames, ["split"]):
            after = [(x["header"], x["rows"], x["last"]) for x in (first["previous"], first["current"]) if x is not None]
            rows = wig_rows(values, strand, resolution, after)
            while batch := list(islice(rows, BATCH)):
                yield pd.DataFrame(batch, columns=["chrom", "strand", "start_pos", "end_pos", "value"])

    return joined.select("value", known.alias("split"), "previous", "current").mapInPandas(run, "chrom string, strand string, start_pos long, end_pos long, value double")


def _by_split(frames: Iterator, keys: list[str]) -> Iterator[tuple[tuple, dict, Iterator[str]]]:
    """(keys, first row, lines) of each run of lines of equal keys; lines are read as they come."""
    from itertools import chain, groupby

    def parts() -> Iterator[tuple[tuple, dict, list]]:
        for f in frames:
            new = (f[keys] != f[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            for low, high in zip(new, [*new[1:], len(f)], strict=True):
                first = f.iloc[low]
                yield tuple(first[k] for k in keys), first, f["value"].iloc[low:high].tolist()

    for key, found in groupby(parts(), key=lambda part: part[0]):
        _, first, values = next(found)
        yield key, first, chain(values, chain.from_iterable(v for _, _, v in found))


def _left_behind(frames: Iterator) -> Iterator:
    """Of each split: the rows before its first header, its number of headers, and its last two sections."""
    import pandas as pd

    for (file, at), _, values in _by_split(frames, ["file", "at"]):
        headers, sections = 0, [None, [None, 0, None]]  # rows before the first header have none
        before = sections[1]
        for line in values:
            line = line.strip()
            if not line or line.startswith(_NO_ROW):
                continue
            if line.startswith(_HEADER):
                headers, sections = headers + 1, [sections[1], [line, 0, None]]
            else:
                sections[1][1:] = sections[1][1] + 1, line
        whole = [dict(zip(("header", "rows", "last"), x, strict=True)) if x and x[0] else None for x in sections]
        yield pd.DataFrame({"file": [file], "at": [at], "before": [{"header": None, "rows": before[1], "last": before[2]}], "headers": [headers], "previous": [whole[0]], "current": [whole[1]]})


def _sections_before(splits):
    """The last two sections before each split of a file."""
    import pandas as pd

    previous, current, out = None, None, []
    for r in splits.sort_values("at").to_dict("records"):
        out.append((r["file"], r["at"], r["split"], previous, current))
        if r["before"]["rows"] and current:
            current = {**current, "rows": current["rows"] + r["before"]["rows"], "last": r["before"]["last"]}
        if r["headers"]:
            previous, current = (current if r["headers"] == 1 else r["previous"]), r["current"]
    return pd.DataFrame(out, columns=["file", "at", "split", "previous", "current"])


_NO_ROW, _HEADER = ("#", "track", "browser"), ("fixedStep", "variableStep")


def wig_rows(lines, strand: str = "+", resolution: int | None = None, after=()) -> Iterator[tuple]:
    """Rows of WIG lines; a fixedStep's span equals its step.

    For a track of a given resolution starts are multiples of it and spans equal it. Only a
    section of one row may have another span, and none may go on from it on its chromosome,
    nor begin before the section before it has ended. `after`: the sections just before
    these lines, the last two at most, as (header, number of rows, last row).
    """
    mode, chrom, at, step, span, rows = "", "", 0, 1, 1, 0
    odd, reach, before = False, 0, None  # the section's span isn't the resolution; where it ends; the section before (end, odd, mode) if of the same chromosome

    def begin(line: str) -> None:
        nonlocal mode, chrom, at, step, span, rows, odd, before
        ended = (chrom, reach, odd, mode) if rows else None
        mode, *rest = line.split()
        given = dict(x.split("=", 1) for x in rest)
        chrom, step, span, at, rows = given["chrom"], int(given.get("step", 1)), int(given.get("span", 1)), int(given.get("start", 1)) - 1, 0
        if at < 0 or resolution and at % resolution:
            raise ValueError(f"a start that isn't a multiple of the resolution: {at}")
        if mode == "fixedStep" and span != step:
            raise ValueError("a fixedStep's span equals its step")
        odd = resolution is not None and span != resolution
        before = ended[1:] if resolution and ended and ended[0] == chrom else None

    for header, rows_then, last in after:
        begin(header)
        if rows_then:
            rows, before = rows_then, None
            at += step * rows if mode == "fixedStep" else 0
            reach = at if mode == "fixedStep" else int(last.split()[0]) - 1 + span
    for line in lines:
        line = line.strip()
        if not line or line.startswith(_NO_ROW):
            continue
        if line.startswith(_HEADER):
            begin(line)
            continue
        if mode == "fixedStep":
            start, value = at, float(line)
            at += step
        elif mode == "variableStep":
            position, value = line.split()
            start, value = int(position) - 1, float(value)
        else:
            raise ValueError("a value before any header")
        rows += 1
        if odd and rows > 1:
            raise ValueError(f"a span of {span} in a track of resolution {resolution}")
        if before is not None:
            gap = start - before[0]
            if gap < 0:
                raise ValueError(f"a section begins before the one before it ends: {start}")
            if gap <= (0 if mode == "fixedStep" else GAP) and (before[1] or before[2] != mode):
                raise ValueError("only the last block of a chromosome may have another span" if before[1] else "fixedStep goes on from variableStep, or the reverse")
        before, reach = None, start + span
        yield chrom, strand, start, start + span, value
