"""Name resolution as joins: dotted paths, nearest scopes, references, constants, enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.stages import cut


def resolve_path(nodes: DataFrame, path: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Nodes reached by names in a row, starting anywhere: one equi-join on the parent for each name."""
    found = nodes.where(F.col("name") == path[0]).select("node_id", F.col("node_id").alias("start_id"), "kind")
    for name in path[1:]:
        next_ = nodes.where(F.col("name") == name).select(F.col("node_id").alias("next_id"), "parent_id", F.col("kind").alias("next_kind"))
        found = found.join(next_, found["node_id"] == next_["parent_id"]).select(F.col("next_id").alias("node_id"), "start_id", F.col("next_kind").alias("kind"))
    return found.where(F.col("kind").isin(kinds)) if kinds else found


def resolve_scoped(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, node_id, scope_id, ambiguous) of references (ref_id, node_id, path array<string>) over nodes (node_id, parent_id, name).

    A path is looked for below the node that refers, then below each node further up, to the root: the nearest scope
    that holds the whole path wins.  Within a scope a name may lie deeper than a child as long as only nodes without a
    name stand between.  Of several targets the smallest node_id is taken and said to be ambiguous.  Each step is an
    equi-join over the references that are still open; a reference that finds nothing comes out with nulls.
    """
    n = cut(nodes.select("node_id", "parent_id", F.coalesce("name", F.lit("")).alias("name")))
    # named nodes with the nearest node above that has a name or is the one asked: unnamed ones are passed through
    named = n.where("name <> ''").select("node_id", F.col("parent_id").alias("above"), "name")
    below = level = named
    unnamed = n.where("name = ''").select(F.col("node_id").alias("above"), F.col("parent_id").alias("further"))
    while True:
        level = cut(level.join(unnamed, "above").where("further is not null").select("node_id", F.col("further").alias("above"), "name"))
        if level.isEmpty():
            break
        below = below.unionByName(level)
    below = cut(below)
    open_ = cut(references.where("path is not null and size(path) > 0").select("ref_id", F.col("node_id").alias("scope_id"), "path"))
    out = None
    while not open_.isEmpty():
        at = open_.select("ref_id", "scope_id", "path", F.col("scope_id").alias("here"), F.lit(0).alias("k"))
        done = None
        while True:
            step = at.join(below.select(F.col("above").alias("here"), F.col("node_id").alias("next"), "name"), "here").where(F.col("name") == F.get("path", F.col("k")))
            at = cut(step.select("ref_id", "scope_id", "path", F.col("next").alias("here"), (F.col("k") + 1).alias("k")))
            if at.isEmpty():
                break
            whole = at.where(F.col("k") == F.size("path"))
            done = whole if done is None else done.unionByName(whole)
            at = at.where(F.col("k") < F.size("path"))
        if done is not None:
            found = cut(done.groupBy("ref_id", "scope_id").agg(F.min("here").alias("node_id"), (F.countDistinct("here") > 1).alias("ambiguous")))
            out = found if out is None else out.unionByName(found)
            open_ = open_.join(found, "ref_id", "left_anti")
        open_ = cut(open_.join(n.select(F.col("node_id").alias("scope_id"), "parent_id"), "scope_id").where("parent_id is not null").select("ref_id", F.col("parent_id").alias("scope_id"), "path"))
    every = references.select("ref_id")
    if out is None:
        return every.select("ref_id", *(F.lit(None).cast(n.schema["node_id"].dataType).alias(k) for k in ("node_id", "scope_id")), F.lit(None).cast("boolean").alias("ambiguous"))
    return every.join(out, "ref_id", "left").select("ref_id", "node_id", "scope_id", "ambiguous")


def nearest(candidates: DataFrame, reference: list[str], distance: str, choose: list[str]) -> DataFrame:
    """The candidate of least distance of each reference, the first by ``choose``; ambiguous if several are as near."""
    w = Window.partitionBy(*reference)
    ranked = candidates.withColumn("__least", F.min(distance).over(w)).where(F.col(distance) == F.col("__least"))
    ranked = ranked.withColumn("ambiguous", F.count("*").over(w) > 1).withColumn("__r", F.row_number().over(w.orderBy(*choose)))
    return ranked.where("__r = 1").drop("__r", "__least")


def check_references(refs: DataFrame, key: str, targets: DataFrame, target_key: str, is_wanted: Column) -> DataFrame:
    """refs with status: ok, wrong_class (the target is not of the declared class) or dangling."""
    t = targets.select(F.col(target_key).alias("__t"), is_wanted.alias("__ok"))
    status = F.when(F.col("__t").isNull(), "dangling").when(F.col("__ok"), "ok").otherwise("wrong_class")
    return refs.join(t, refs[key] == t["__t"], "left").withColumn("status", status).drop("__t", "__ok")


def substitute_constants(values: DataFrame, column: str, constants: DataFrame) -> DataFrame:
    """Replaces values that name a constant (name, value); resolved tells which did.  The planner broadcasts constants by their size."""
    c = constants.select(F.col("name").alias("__n"), F.col("value").alias("__v"))
    return values.join(c, F.col(column) == F.col("__n"), "left").withColumn("resolved", F.col("__n").isNotNull()).withColumn(column, F.coalesce("__v", column)).drop("__n", "__v")


def enum_ordinal(name: Column, entries: list[str]) -> Column:
    """0-based ordinal of an entry, null if there is none of that name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, entries)), name), F.lit(0)).cast("int") - 1


def enum_name(ordinal: Column, entries: list[str]) -> Column:
    """Entry of an ordinal, null out of range."""
    return F.get(F.array(*map(F.lit, entries)), ordinal)
