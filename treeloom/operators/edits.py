"""Edits of node tables and schema tables: a table in, the edited table out; what can't be done comes out as rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.schema_graph import isa_closure
from treeloom.operators.stages import cut


def subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node_id): the nodes of the subtrees of roots (node_id), themselves included; one join for each level."""
    edge = nodes.select("node_id", "parent_id")
    level = cut(roots.select("node_id").distinct().join(edge.select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("root"), "node_id"))
    out = level
    while not level.isEmpty():
        level = cut(level.withColumnRenamed("node_id", "parent_id").join(edge, "parent_id").select("root", "node_id"))
        out = out.unionByName(level)
    return out


def remove(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes without the subtrees of roots (node_id); siblings close up where nodes have a position ``pos``."""
    left = nodes.join(subtrees(nodes, roots).select("node_id").distinct(), "node_id", "left_anti").select(nodes.columns)
    return renumber(left) if "pos" in nodes.columns else left


def renumber(nodes: DataFrame) -> DataFrame:
    """Positions from 0 without gaps among the children of a field, in their old order; roots keep theirs."""
    scope = [c for c in ("doc_id", "parent_id", "field_name") if c in nodes.columns]
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(F.asc_nulls_last("pos"), "node_id")) - 1
    kept = nodes.where("parent_id is null")
    return nodes.where("parent_id is not null").withColumn("pos", place.cast(nodes.schema["pos"].dataType)).unionByName(kept)


def move(nodes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected): each node of moves (node_id, new_parent) under its new parent.

    Rejected (node_id, reason): a node or parent that is not there, and a parent that lies below the node itself; of
    two moves of one node the one of the smaller parent counts.  Moves are judged on the tree before all of them, so
    a move under a node that is moved itself is rejected too: the two could close a circle.
    """
    one = cut(moves.groupBy("node_id").agg(F.min("new_parent").alias("new_parent")))
    there = nodes.select(F.col("node_id").alias("new_parent"), F.lit(True).alias("has_parent"))
    mine = nodes.select("node_id", F.lit(True).alias("has_node"))
    below = subtrees(nodes, one).select(F.col("root").alias("moved"), F.col("node_id").alias("new_parent")).withColumn("inside", F.lit(True))
    own = below.select(F.col("moved").alias("node_id"), "new_parent", F.col("inside").alias("own"))
    other = below.select("new_parent", F.col("inside").alias("other")).distinct()
    judged = one.join(mine, "node_id", "left").join(there, "new_parent", "left").join(own, ["node_id", "new_parent"], "left").join(other, "new_parent", "left")
    reason = F.when(F.col("has_node").isNull(), "no_node").when(F.col("has_parent").isNull(), "no_parent").when(F.col("own"), "own_subtree").when(F.col("other"), "moved_parent")
    judged = cut(judged.select("node_id", "new_parent", reason.alias("reason")))
    good = judged.where("reason is null").select("node_id", "new_parent")
    out = nodes.join(good, "node_id", "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id")).select(nodes.columns)
    return (renumber(out) if "pos" in nodes.columns else out), judged.where("reason is not null").select("node_id", "reason")


def rename(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes with the names of names (node_id, name)."""
    new = names.groupBy("node_id").agg(F.min("name").alias("__name"))
    return nodes.join(new, "node_id", "left").withColumn("name", F.coalesce("__name", "name")).select(nodes.columns)


# ------------------------------------------------------------- schema tables


def drop_classes(schema: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``Schema.tables`` without the classes of gone (class): their fields, their places among allowed
    children and their tokens go too; subclasses take the nearest superclass that stays."""
    g = gone.select("class").distinct()
    off = lambda df, c: df.join(g.select(F.col("class").alias(c)), c, "left_anti").select(df.columns)
    classes = schema["classes"]
    up = isa_closure(classes.select(F.col("class").alias("child"), F.col("superclass").alias("parent")))
    stay = up.where("distance > 0").join(g.select(F.col("class").alias("sup")), "sup", "left_anti")
    new = stay.groupBy("sub").agg(F.min(F.struct("distance", "sup"))["sup"].alias("new_super")).select(F.col("sub").alias("class"), "new_super")
    kept = off(classes, "class").join(new, "class", "left").withColumn("superclass", F.col("new_super")).select(classes.columns)
    out = dict(schema) | {"classes": kept, "fields": off(schema["fields"], "owner"), "children": off(off(schema["children"], "owner"), "child")}
    if "tokens" in schema:
        out["tokens"] = off(schema["tokens"], "class")
    return out


def set_superclass(classes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, rejected): superclasses of changes (class, superclass).

    Rejected (class, reason): an unknown class or superclass, and one that inherits from the class, now or by the
    other changes."""
    known = classes.select("class").distinct()
    new = changes.groupBy("class").agg(F.min("superclass").alias("new_super"))
    has = lambda c: known.select(F.col("class").alias(c), F.lit(True).alias("has_" + c))
    tried = cut(new.join(has("class"), "class", "left").join(has("new_super"), "new_super", "left"))
    ok = tried.where("has_class and has_new_super").select("class", "new_super")
    would = classes.join(ok, "class", "left").select(F.col("class").alias("child"), F.coalesce("new_super", "superclass").alias("parent"))
    up = isa_closure(would)
    # a class that stands above its own new superclass closes a circle
    circle = ok.join(up.select(F.col("sub").alias("new_super"), F.col("sup").alias("class")), ["class", "new_super"], "left_semi").select("class", F.lit(True).alias("circle"))
    judged = cut(tried.join(circle, "class", "left").select("class", "new_super", F.when(F.col("has_class").isNull(), "no_class").when(F.col("has_new_super").isNull(), "no_superclass").when(F.col("circle"), "cyclic").alias("reason")))
    good = judged.where("reason is null").select("class", "new_super")
    out = classes.join(good, "class", "left").withColumn("superclass", F.coalesce("new_super", "superclass")).select(classes.columns)
    return out, judged.where("reason is not null").select("class", "reason")


def move_fields(fields: DataFrame, moves: DataFrame) -> DataFrame:
    """fields with those of moves (owner, field, new_owner) in another class, after the fields that it has."""
    last = fields.groupBy("owner").agg((F.max("seq") + 1).alias("__at")).withColumnRenamed("owner", "new_owner")
    marked = fields.join(moves.select("owner", "field", "new_owner").dropDuplicates(["owner", "field"]), ["owner", "field"], "left").join(last, "new_owner", "left")
    w = Window.partitionBy("new_owner").orderBy("owner", "seq")
    seq = F.when(F.col("new_owner").isNotNull(), F.coalesce("__at", F.lit(0)) + F.row_number().over(w) - 1).otherwise(F.col("seq"))
    return marked.withColumn("seq", seq.cast("int")).withColumn("owner", F.coalesce("new_owner", "owner")).select(fields.columns)
