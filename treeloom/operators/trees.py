"""Node tables: one row a node with its parent, built from levels of a hierarchy, and what their ancestry answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_levels(levels: list[tuple[str, DataFrame, str, str | None, str]]) -> DataFrame:
    """Canonical nodes of a hierarchy of tables.

    levels: (kind, table, key column, parent key column or None, name column), from the root down.
    Node ids are "kind:key"; depth is the level.
    """
    out = None
    for depth, (kind, df, key, parent, name) in enumerate(levels):
        up = levels[depth - 1][0] if depth else None
        rows = df.select(
            F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("node_id"),
            (F.concat(F.lit(f"{up}:"), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent_id"),
            F.lit(kind).alias("kind"),
            F.col(name).cast("string").alias("name"),
            F.lit(depth).alias("depth"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def ancestors(nodes: DataFrame, depth: int) -> DataFrame:
    """(node_id, ancestor_id, distance) up to a known depth: one equi-join a level, no recursion, distance 0 included."""
    edge = nodes.select("node_id", "parent_id")
    step = edge.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    out = step
    for d in range(1, depth + 1):
        up = edge.select(F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("up")).where("up is not null")
        step = step.join(up, "ancestor_id").select("node_id", F.col("up").alias("ancestor_id"), F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def nearest_ancestor(nodes: DataFrame, kinds: list[str], depth: int) -> DataFrame:
    """For each node its nearest ancestor (itself not counted) of one of the kinds: node_id, ancestor_id, distance."""
    a = ancestors(nodes, depth).where("distance > 0")
    kind = nodes.where(F.col("kind").isin(kinds)).select(F.col("node_id").alias("ancestor_id"))
    return a.join(kind, "ancestor_id").groupBy("node_id").agg(F.min(F.struct("distance", "ancestor_id")).alias("m")).select("node_id", "m.ancestor_id", "m.distance")


def interval_encode(nodes: DataFrame, sort: list[str]) -> DataFrame:
    """nodes with pre and post order numbers within a document (doc_id, node_id, parent_id, pos given).

    last: the largest pre of a node's subtree.  A document's nodes are one group: a document is bounded, a corpus is
    not.  Nodes without doc_id belong to no document and get no numbers.
    """
    import pandas as pd

    nodes = nodes.drop("pre", "post", "last")
    schema = type(nodes.schema)([*nodes.schema.fields]).add("pre", "integer").add("post", "integer").add("last", "integer")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict = {}
        for i, p in zip(pdf["node_id"], pdf["parent_id"]):
            kids.setdefault(None if pd.isna(p) else p, []).append(i)
        pre, post, last, n, m, todo = {}, {}, {}, 0, 0, [(i, False) for i in reversed(kids.get(None, []))]
        while todo:
            i, done = todo.pop()
            if done:
                post[i], last[i] = m, n - 1
                m += 1
                continue
            pre[i] = n
            n += 1
            todo.append((i, True))
            todo.extend((c, False) for c in reversed(kids.get(i, [])))
        return pdf.assign(pre=pdf["node_id"].map(pre), post=pdf["node_id"].map(post), last=pdf["node_id"].map(last))

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.sort_values(sort))

    none = [F.lit(None).cast("int").alias(k) for k in ("pre", "post", "last")]
    coded = nodes.where("doc_id is not null").groupBy("doc_id").applyInPandas(ordered, schema)
    return coded.unionByName(nodes.where("doc_id is null").select("*", *none))


def descendants_of(nodes: DataFrame, ancestors_of: DataFrame) -> DataFrame:
    """Pairs (ancestor row, node row) of encoded nodes, by interval containment within a document."""
    a = ancestors_of.select(F.col("doc_id"), F.col("node_id").alias("ancestor_id"), F.col("pre").alias("a_pre"), F.col("post").alias("a_post"))
    return nodes.join(a, "doc_id").where("a_pre < pre and post < a_post")
