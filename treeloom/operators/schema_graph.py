"""Graph operators over schema tables: closures, effective fields, shortest implicit paths, cycles.

Nothing is bounded in depth.  Closures and cycles double the length of what they have joined in each round, paths go
breadth first, one level a round, and meet no pair twice; a round is an equi-join and an aggregate, cut from the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.stages import cut


def isa_closure(edges: DataFrame) -> DataFrame:
    """(sub, sup, distance) of edges (child, parent), distance 0 included; shortest distance where there are several."""
    known = edges.where("child is not null")
    ids = known.select(F.col("child").alias("id")).union(known.where("parent is not null").select("parent")).distinct()
    pairs = ids.select(F.col("id").alias("sub"), F.col("id").alias("sup"), F.lit(0).alias("distance")).union(known.where("parent is not null").select("child", "parent", F.lit(1)))
    reach = cut(pairs.groupBy("sub", "sup").agg(F.min("distance").alias("distance")))
    size = lambda r: tuple(r.agg(F.count("*"), F.sum("distance")).first())
    now = size(reach)
    while True:
        up = reach.select(F.col("sub").alias("mid"), F.col("sup").alias("top"), F.col("distance").alias("more"))
        twice = reach.join(up, F.col("sup") == F.col("mid")).groupBy("sub", F.col("top").alias("sup")).agg(F.min(F.col("distance") + F.col("more")).alias("distance"))
        reach, before = cut(twice), now
        now = size(reach)
        if now == before:
            return reach


def can_contain(edges: DataFrame) -> DataFrame:
    """(owner, child, distance): which classes may stand anywhere below which; edges (src, dst): classes allowed in fields."""
    over = edges.select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    below = isa_closure(over).where("distance > 0").select(F.col("sub").alias("owner"), F.col("sup").alias("child"), "distance")
    # a class that contains itself through others: one step to each of them, then back
    first = edges.select("src", "dst").distinct()
    self_ = below.join(first, (F.col("child") == F.col("src")) & (F.col("owner") == F.col("dst"))).groupBy("owner").agg(F.min(F.col("distance") + 1).alias("distance"))
    alone = first.where("src = dst").select(F.col("src").alias("owner"), F.lit(1).alias("distance"))
    loops = self_.unionByName(alone).groupBy("owner").agg(F.min("distance").alias("distance")).select("owner", F.col("owner").alias("child"), "distance")
    return below.unionByName(loops)


def cycles(edges: DataFrame) -> DataFrame:
    """(start, cycle): every cycle of a functional reference (child, parent), once, from its smallest member.

    Steps are doubled until the set of nodes they end in no longer shrinks: those nodes lie on cycles.  Only they
    are then ordered.
    """
    e = edges.where("child is not null and parent is not null").select("child", "parent")
    jump = cut(e)
    left = jump.select("parent").distinct().count()
    while left:
        further = jump.select(F.col("child").alias("mid"), F.col("parent").alias("to"))
        jump = cut(jump.join(further, F.col("parent") == F.col("mid")).select("child", F.col("to").alias("parent")))
        before, left = left, jump.select("parent").distinct().count()
        if left == before:
            break
    if not left:
        return jump.select(F.col("child").alias("start"), F.array("child").alias("cycle")).limit(0)
    on = e.join(jump.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    # smallest member of each cycle
    low = cut(on.select("child", "parent", F.least("child", "parent").alias("low")))
    total = None
    while True:
        further = low.select(F.col("child").alias("mid"), F.col("parent").alias("to"), F.col("low").alias("other"))
        low = cut(low.join(further, F.col("parent") == F.col("mid")).select("child", F.col("to").alias("parent"), F.least("low", "other").alias("low")))
        now = tuple(low.agg(F.countDistinct("low"), F.count("*"), F.sum(F.xxhash64("child", "low").cast("decimal(38,0)"))).first())
        if now == total:
            break
        total = now
    # steps that each member is before the smallest, by doubling over pointers that stop there
    members = on.join(low.select("child", "low"), "child")
    go = cut(members.select("child", F.when(F.col("child") == F.col("low"), F.col("child")).otherwise(F.col("parent")).alias("to"), (F.col("child") != F.col("low")).cast("int").alias("steps"), "low"))
    while not go.where("to <> low").isEmpty():
        further = go.select(F.col("child").alias("mid"), F.col("to").alias("end"), F.col("steps").alias("more"))
        go = cut(go.join(further, F.col("to") == F.col("mid")).select("child", F.col("end").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), "low"))
    size = go.groupBy("low").agg(F.count("*").alias("n"))
    placed = go.join(size, "low").select("low", F.pmod(F.col("n") - F.col("steps"), F.col("n")).alias("place"), "child")
    return placed.groupBy(F.col("low").alias("start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "child"))), lambda x: x["child"]).alias("cycle"))


def effective_fields(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """(class, owner, field, field_type, seq): own and inherited fields.

    classes (class, superclass); fields (class, field, field_type TREE or SUBTREE, seq).  A field of a class hides
    inherited ones of its name; superclass SUBTREE fields come first; one TREE field, of the lowest level, comes last.
    """
    up = isa_closure(classes.select(F.col("class").alias("child"), F.col("superclass").alias("parent")))
    all_fields = up.join(fields.withColumnRenamed("class", "owner"), up["sup"] == F.col("owner")).select(F.col("sub").alias("class"), "owner", "field", "field_type", "seq", "distance")
    by_name = Window.partitionBy("class", "field").orderBy("distance", "seq")
    trees = Window.partitionBy("class", "field_type").orderBy("distance", "seq")
    kept = all_fields.withColumn("r", F.row_number().over(by_name)).where("r = 1").withColumn("t", F.row_number().over(trees)).where("field_type = 'SUBTREE' or t = 1")
    order = Window.partitionBy("class").orderBy(F.col("field_type") == "TREE", F.desc("distance"), "seq")
    return kept.withColumn("place", F.row_number().over(order) - 1).select("class", "owner", "field", "field_type", F.col("place").alias("seq"))


def allowed_children(field_children: DataFrame, classes: DataFrame) -> DataFrame:
    """(owner, field, child): allowed classes with all their subclasses."""
    up = isa_closure(classes.select(F.col("class").alias("child"), F.col("superclass").alias("parent")))
    return field_children.join(up, F.col("child") == up["sup"]).select("owner", "field", F.col("sub").alias("child")).distinct()


def _breadth_first(level: DataFrame, edges: DataFrame, seen: DataFrame, through: DataFrame | None, most_hops: int | None) -> DataFrame:
    """(source, here, hops, n_paths, path) from the first level on; pairs (source, here) of ``seen`` are not met again."""
    level = cut(level)
    out, hops = level, 1
    seen = seen.unionByName(level.select("source", "here"))
    e = edges.select("src", "dst").distinct()
    while (most_hops is None or hops < most_hops) and not level.isEmpty():
        on = level.join(through.select(F.col("class").alias("here")).distinct(), "here", "left_semi") if through is not None else level
        further = on.join(e, on["here"] == e["src"]).groupBy("source", F.col("dst").alias("here")).agg(F.sum("n_paths").alias("n_paths"), F.min(F.array_append("path", F.col("dst"))).alias("path"))
        hops += 1
        level = cut(further.join(seen, ["source", "here"], "left_anti").select("source", "here", F.lit(hops).alias("hops"), "n_paths", "path"))
        out, seen = out.unionByName(level), seen.unionByName(level.select("source", "here"))
    return out


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(source, target, hops, n_paths, path): fewest hops over edges (src, dst), the first path in order, and how many there are."""
    s = sources.select(F.col(sources.columns[0]).alias("source")).distinct()
    t = targets.select(F.col(targets.columns[0]).alias("target")).distinct()
    first = s.join(edges.select("src", "dst").distinct(), F.col("source") == F.col("src")).where("src <> dst")
    first = first.select("source", F.col("dst").alias("here"), F.lit(1).alias("hops"), F.lit(1).cast("bigint").alias("n_paths"), F.array("source", "dst").alias("path"))
    walked = _breadth_first(first, edges, s.select("source", F.col("source").alias("here")), None, most_hops)
    return walked.join(t, F.col("here") == F.col("target"), "left_semi").select("source", F.col("here").alias("target"), "hops", "n_paths", "path")


def implicit_paths(edges: DataFrame, transparent: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(source, target, hops, ambiguous, path): how a class is reached from another through transparent classes only.

    edges (src, dst): classes allowed in a class's TREE field; every class between source and target is transparent.
    """
    first = edges.select("src", "dst").distinct().select(F.col("src").alias("source"), F.col("dst").alias("here"), F.lit(1).alias("hops"), F.lit(1).cast("bigint").alias("n_paths"), F.array("dst").alias("path"))
    walked = _breadth_first(first, edges, first.select("source", "here").limit(0), transparent, most_hops)
    return walked.select("source", F.col("here").alias("target"), "hops", (F.col("n_paths") > 1).alias("ambiguous"), "path")


def default_fields(paths: DataFrame, primitives: DataFrame) -> DataFrame:
    """(source, target, hops): primitive default fields reachable from a class, nearest first by hops."""
    return paths.join(primitives.select(F.col("class").alias("target")), "target").select("source", "target", "hops").distinct()


def permitted_tokens(paths: DataFrame, tokens: DataFrame) -> DataFrame:
    """(source, token, class, depth, ambiguous): tokens that may stand in a class; two at one depth are ambiguous."""
    at = paths.join(tokens.withColumnRenamed("class", "target"), "target").select("source", "token", F.col("target").alias("class"), F.col("hops").alias("depth"))
    return at.withColumn("ambiguous", F.count("*").over(Window.partitionBy("source", "token", "depth")) > 1)
