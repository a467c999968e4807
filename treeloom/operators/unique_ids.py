"""Ids for nodes that others refer to: class path and name, numbered where they collide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_ids(nodes: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """nodes with a column id: the base itself for the first, then base_1, base_2, ...

    taken (id): ids that exist already.  Candidates that collide with a taken id, or with another base's numbered id,
    take the next free number: a loop of anti-joins that ends as soon as no row is left.
    """
    w = Window.partitionBy(base).orderBy(order)
    ranked = nodes.withColumn("__k", F.row_number().over(w) - 1)
    held = taken.select(F.col("id").alias("__id")).distinct() if taken is not None else None
    bases = nodes.select(F.col(base).alias("__id")).distinct()
    name = lambda: F.when(F.col("__k") == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("__k").cast("string")))
    # numbers that a base must skip: those that spell another base or a taken id
    other = bases if held is None else bases.union(held).distinct()
    parts = other.select("__id", F.regexp_extract("__id", "^(.*)_([1-9][0-9]*)$", 1).alias("__b"), F.regexp_extract("__id", "^(.*)_([1-9][0-9]*)$", 2).alias("__n")).where("__b <> ''")
    skip = parts.select("__b", F.col("__n").cast("bigint").alias("__n"))
    if held is not None:
        skip = skip.union(held.select(F.col("__id"), F.lit(0).cast("bigint"))).distinct()
    skips = skip.groupBy("__b").agg(F.array_sort(F.collect_set("__n")).alias("__skip"))
    shifted = ranked.join(skips, F.col(base) == F.col("__b"), "left")
    number = F.aggregate(F.coalesce("__skip", F.array().cast("array<bigint>")), F.col("__k").cast("bigint"), lambda k, s: F.when(s <= k, k + 1).otherwise(k))
    return shifted.withColumn("__k", number).withColumn("id", name()).drop("__k", "__b", "__skip")
