"""Scans in order along chromosomes, in two levels.

A window over a whole chromosome is one task's work. Here the rows of a key are cut into pieces by
position; each piece is scanned by itself, and what the pieces before it came to is
one row a piece, scanned in a small second pass and joined to the rows. Rows and scan are
partitioned alike, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a piece.
STRIDE = 1 << 20

#: Bytes of the files read for each task that rows are dealt to: some hundred thousand rows.
DEALT_BYTES = 4 << 20
#: Rows for each such task, where they are counted: files of repeated values hold several times as many rows a byte.
DEALT_ROWS = 1 << 17

_KINDS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}


def dealt(rows: DataFrame, *keys: str, count: int = 0) -> DataFrame:
    """rows with equal keys together, in as many tasks as the tables they come from need, and no fewer than there are cores.

    A task that sorts or groups them then holds about as much on a large table as on a small one, whatever
    number of shuffle partitions is set; adaptive execution doesn't put such tasks together. count: number of the rows, if it is known.
    """
    spark = rows.sparkSession
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    # a source without statistics (rows from Python) is given as very large, and is small
    size = sum(n for n in (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) if n < 1 << 50)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, -(-size // DEALT_BYTES), -(-count // DEALT_ROWS)), *keys)


def piece(position: Column, stride: int = STRIDE) -> Column:
    return F.floor(position / F.lit(stride))


def _with_carry(rows: DataFrame, keys: Sequence[str], pieces: Sequence[Column], sums: dict[str, Column], over: dict[str, object]) -> tuple[DataFrame, list[str]]:
    """rows with their pieces, and for each name what `sums` come to in the pieces before."""
    at = [f"_p{i}" for i in range(len(pieces))]
    cut = rows.withColumns(dict(zip(at, pieces, strict=True)))
    each = cut.groupBy(*keys, *at).agg(*(c.alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*(F.col(c).alias(f"_k_{c}") for c in (*keys, *at)), *(over[n](n).over(before).alias(f"_c_{n}") for n in sums))
    on = F.lit(True)
    for c in (*keys, *at):
        on = on & cut[c].eqNullSafe(carried[f"_k_{c}"])
    return cut.join(carried, on).drop(*(f"_k_{c}" for c in (*keys, *at))), at


def scanned(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pieces: Sequence[Column], values: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """rows with each name: the max, min or sum of a column over the rows of the key before them in `order`, or up to them.

    `pieces` cut the rows of a key and never decrease along `order`: a position divided by a stride, after the
    columns that `order` begins with. Null where nothing came before; nulls don't count.
    """
    sums = {n: _KINDS[kind][0](c) for n, (kind, c) in values.items()}
    joined, at = _with_carry(rows, keys, pieces, sums, {n: _KINDS[kind][0] for n, (kind, _) in values.items()})
    here = Window.partitionBy(*keys, *at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = {n: _KINDS[kind][1](_KINDS[kind][0](c).over(here), F.col(f"_c_{n}")) for n, (kind, c) in values.items()}
    return joined.withColumns(out).drop(*at, *(f"_c_{n}" for n in values))


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pieces: Sequence[Column], name: str, dense: bool = True) -> DataFrame:
    """rows with `name`: their place in `order` among the rows of their key, from 1; equal rows share it if `dense`."""
    count = F.count_distinct(F.struct(*order)) if dense else F.count(F.lit(1))
    joined, at = _with_carry(rows, keys, pieces, {name: count}, {name: F.sum})
    here = Window.partitionBy(*keys, *at).orderBy(*order)
    place = (F.dense_rank() if dense else F.row_number()).over(here).cast("long")
    return joined.withColumn(name, place + F.coalesce(f"_c_{name}", F.lit(0))).drop(*at, f"_c_{name}")
