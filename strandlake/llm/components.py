"""Connected components of a link table, without a node or link on the driver.

Each round contracts the links within every partition to a spanning forest,
hooks each node to its smallest neighbour, halves the paths until they are
stars, and renames the remaining links by their roots. A hub's links lie in
joins of stored tables that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, stored, tidy

LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush(parts):
        pairs = np.concatenate(parts)
        nodes, index = np.unique(pairs, return_inverse=True)
        index = index.reshape(pairs.shape)
        root = forest(len(nodes), index[:, 0], index[:, 1])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return np.stack([nodes[moved], nodes[root[moved]]], 1)

    for b in batches:
        if b.num_rows:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1))
            size += b.num_rows
            if size > 1_000_000:
                held = [flush(held)]
                if len(held[0]) > 700_000:  # a forest that stays large is passed on
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], schema=LINKS)
                    held = []
                size = sum(map(len, held))
    if held:
        out = flush(held)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=LINKS)


def components(links: DataFrame) -> DataFrame:
    """links(a, b): whole numbers. Returns (node, component) for every linked node
    that is not itself the smallest of its component; the rest are their own.

    No links: an empty table. Links of a node with itself, repeated links and
    nulls are ignored.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    label = None
    while True:
        tree = stored(links.mapInArrow(tidy(_contract), "node long, root long"))
        if tree.isEmpty():
            break
        hook = stored(tree.groupBy("node").agg(F.min("root").alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(hook.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        label = hook if label is None else stored(label.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(hook))
        left = tree.join(hook.withColumnRenamed("root", "a"), "node").select("a", "root")
        links = left.join(up, "root", "left").select("a", F.coalesce("next", "root").alias("b")).where("a <> b")
    spark = links.sparkSession
    if label is None:
        return spark.createDataFrame([], "node long, component long")
    return label.select("node", F.col("root").alias("component"))
