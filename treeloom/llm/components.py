"""Connected components of an edge table: forests of partitions, then alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import discard, file_count, stash

#: Edges that one task may hold (16 bytes each): up to so many are joined in a single pass.
ONE_TASK = 1_000_000


def _forest(batches):
    """Union-find over one partition: (node, root) for each node, root the smallest node met."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if not a or not sum(map(len, a)):
        return
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    left, right = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while True:  # hang the larger root on the smaller one, then shorten the paths
        x, y = root[left], root[right]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); component: the smallest node reachable.

    Each partition first turns its edges into a forest (never more edges than nodes).  What is left goes to one
    task if it is counted and found small, else through rounds of star contraction.  Same result either way.
    The result reads a written stage: ``discard`` it when it has been used.
    """
    e = stash(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "node long, component long").where("node <> component").distinct(), "forest", 12)
    n = e.count()
    if n <= ONE_TASK:
        out = e.coalesce(1).mapInArrow(_forest, "node long, component long")
        out._stash_path = e._stash_path
    else:
        out = star_contraction(e.select(F.col("node").alias("a"), F.col("component").alias("b")), file_count(n))
        discard(e)
    return out


def star_contraction(edges: DataFrame, files: int = 12) -> DataFrame:
    """(node, component) over ``edges`` (a, b) of any number.

    Large stars hang every larger neighbour on the smallest one, small stars do so with the smaller neighbours.
    The number of rounds is logarithmic; each is two aggregations with map-side combining, so that a hub costs
    one row a task.  Nothing is collected but a count and a checksum.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", files)
    last = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        new = stash(small, "stars", files)
        discard(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    out._stash_path = e._stash_path
    return out
