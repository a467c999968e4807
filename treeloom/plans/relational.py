"""Queries of the document engine over the relational tables, each with the SQL that returns the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import ranges, text
from treeloom.operators import edits, intervals, resolve, schema_graph, trees, unique_ids, validate, values
from treeloom.operators.stages import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def forest(spark: SparkSession, d: str) -> DataFrame:
    item = t(spark, d, "lineitem").withColumn("l_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return trees.from_levels(
        [
            ("region", t(spark, d, "region"), "r_regionkey", None, "r_name"),
            ("nation", t(spark, d, "nation"), "n_nationkey", "n_regionkey", "n_name"),
            ("customer", t(spark, d, "customer"), "c_custkey", "c_nationkey", "c_name"),
            ("order", t(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderpriority"),
            ("item", item, "l_key", "l_orderkey", "l_linestatus"),
        ]
    )


_FOREST = """
 SELECT 'region:' || r_regionkey AS node_id, NULL AS parent_id, 'region' AS kind, r_name AS name, 0 AS depth FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'nation', n_name, 1 FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer', c_name, 2 FROM customer
 UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order', o_orderpriority, 3 FROM orders
 UNION ALL SELECT 'item:' || l_orderkey || '-' || l_linenumber, 'order:' || l_orderkey, 'item', l_linestatus, 4 FROM lineitem
"""


@query(f"SELECT * FROM ({_FOREST})")
def tree_nodes(spark, d):
    """Five levels as canonical nodes."""
    return forest(spark, d)


@query("SELECT c_custkey, r_name || '.' || n_name || '.' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def node_paths(spark, d):
    """Dotted path from the root to each customer."""
    c, n, r = t(spark, d, "customer"), t(spark, d, "nation"), t(spark, d, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.concat_ws(".", "r_name", "n_name", "c_name").alias("path"))


@query("SELECT 'nation:' || n_nationkey AS node_id, 'region:' || r_regionkey AS start_id, 'nation' AS kind FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) AND n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = (SELECT min_by(r_regionkey, r_name) FROM region))")
def resolve_path(spark, d):
    """Nations reached by a path of two names: the first region's first nation."""
    nodes = forest(spark, d).where("depth <= 1")
    region = t(spark, d, "region").agg(F.min("r_name"), F.min_by("r_regionkey", "r_name")).first()
    nation = t(spark, d, "nation").where(F.col("n_regionkey") == region[1]).agg(F.min("n_name")).first()[0]
    return resolve.resolve_path(nodes, [region[0], nation], ["nation"])


@query("""SELECT 'customer:' || c_custkey AS ref_id, CASE WHEN m.n_regionkey = o.n_regionkey THEN 'nation:' || o.n_nationkey END AS node_id,
      CASE WHEN m.n_regionkey = o.n_regionkey THEN 'region:' || o.n_regionkey END AS scope_id, CASE WHEN m.n_regionkey = o.n_regionkey THEN FALSE END AS ambiguous
    FROM customer JOIN nation m ON m.n_nationkey = c_nationkey JOIN nation o ON o.n_nationkey = (c_nationkey + 5) % (SELECT count(*) FROM nation)""")
def resolve_scoped_paths(spark, d):
    """Every customer refers to a nation by name: found from the nearest scope above that holds it, or not at all."""
    nation = t(spark, d, "nation")
    n = nation.count()
    other = nation.select(F.pmod(F.col("n_nationkey") - 5, F.lit(n)).alias("c_nationkey"), F.array("n_name").alias("path"))
    node = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    refs = t(spark, d, "customer").join(other, "c_nationkey").select(node.alias("ref_id"), node.alias("node_id"), "path")
    return resolve.resolve_scoped(refs, forest(spark, d).where("depth <= 2"))


@query("""WITH c AS (SELECT a.o_orderkey AS ref, b.o_orderkey AS target, date_diff('day', b.o_orderdate, a.o_orderdate) AS dist
      FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate),
    m AS (SELECT *, min(dist) OVER (PARTITION BY ref) AS least FROM c)
    SELECT ref, min(target) AS target, CAST(dist AS INTEGER) AS dist, count(*) > 1 AS ambiguous FROM m WHERE dist = least GROUP BY ref, dist""")
def resolve_nearest_scope(spark, d):
    """The nearest earlier order of the same customer; ambiguous if several lie as near.

    Orders of a customer and day collapse to one candidate, then the day before it is one window step away.
    """
    from pyspark.sql import Window

    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    days = o.groupBy("o_custkey", "day").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("day")
    days = days.select("o_custkey", "day", F.lag("first").over(w).alias("target"), F.lag("n").over(w).alias("n"), F.lag("day").over(w).alias("before")).where("target is not null")
    return o.join(days, ["o_custkey", "day"]).select(F.col("o_orderkey").alias("ref"), "target", F.datediff("day", "before").alias("dist"), (F.col("n") > 1).alias("ambiguous"))


@query("SELECT r_name, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def descendant_counts(spark, d):
    """Line items below each region; items are counted by order first, so that the joins carry counts."""
    per_order = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t(spark, d, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"))
    c = t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    n = t(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    return n.join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("n").alias("n_items"))


@query("SELECT 'item:' || l_orderkey || '-' || l_linenumber AS node_id, 'nation:' || n_nationkey AS ancestor_id, 3 AS distance FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def ancestor_select(spark, d):
    """Nearest ancestor of kind nation of every line item.

    Ancestors are found for the orders, which are few; line items then meet their order's row once, by its integer key.
    """
    order, customer = t(spark, d, "orders"), t(spark, d, "customer")
    upper = trees.from_levels([("nation", t(spark, d, "nation"), "n_nationkey", None, "n_name"), ("customer", customer, "c_custkey", "c_nationkey", "c_name"), ("order", order, "o_orderkey", "o_custkey", "o_orderpriority")])
    near = trees.nearest_ancestor(upper, ["nation"], 2).where(F.col("node_id").startswith("order:")).select(F.substring_index("node_id", ":", -1).cast("bigint").alias("l_orderkey"), "ancestor_id", (F.col("distance") + 1).alias("distance"))
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return items.join(near, "l_orderkey").select(F.concat(F.lit("item:"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("node_id"), "ancestor_id", "distance")


@query("""WITH gone AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 = 0)
    SELECT 'region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'order', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey NOT IN (SELECT k FROM gone)""")
def subtree_removal(spark, d):
    """What is left of the tree of orders when every fifth nation is removed with all below it."""
    nodes = forest(spark, d).where("depth <= 3")
    nations = t(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return edits.remove(nodes, nations).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'nation:' || CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey + 1) % (SELECT count(*) FROM nation) ELSE c_nationkey END AS parent_id, count(*) AS n FROM customer GROUP BY 1""")
def subtree_moves(spark, d):
    """Customers of each nation after every third one has moved to the next nation."""
    nodes = forest(spark, d).where("depth <= 2")
    n = t(spark, d, "nation").count()
    of = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    moves = t(spark, d, "customer").where("c_custkey % 3 = 0").select(of("customer", F.col("c_custkey")).alias("node_id"), of("nation", (F.col("c_nationkey") + 1) % n).alias("new_parent"))
    moved, _ = edits.move(nodes, moves)
    return moved.where("kind = 'customer'").groupBy("parent_id").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT 'part:' || p_partkey AS sub, x.sup, x.distance FROM part, LATERAL (VALUES ('part:' || p_partkey, 0), ('brand:' || p_brand || '/' || p_type, 1), ('type:' || p_type, 2)) x(sup, distance)
    UNION SELECT DISTINCT 'brand:' || p_brand || '/' || p_type, x.sup, x.distance FROM part, LATERAL (VALUES ('brand:' || p_brand || '/' || p_type, 0), ('type:' || p_type, 1)) x(sup, distance)
    UNION SELECT DISTINCT 'type:' || p_type, 'type:' || p_type, 0 FROM part""")
def class_closure(spark, d):
    """Transitive superclasses in a hierarchy of three levels."""
    p = t(spark, d, "part").select(F.concat(F.lit("type:"), "p_type").alias("ty"), F.concat(F.lit("brand:"), "p_brand", F.lit("/"), "p_type").alias("br"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("pa"))
    edges = p.select(F.col("pa").alias("child"), F.col("br").alias("parent")).union(p.select("br", "ty")).distinct()
    return schema_graph.isa_closure(edges)


#: Classes of four levels and what stands in what, over the whole tables: segment, priority, brand, nation.
_LAYERS = """e AS (SELECT DISTINCT 'segment:' || c_mktsegment AS src, 'priority:' || o_orderpriority AS dst FROM customer JOIN orders ON o_custkey = c_custkey
      UNION SELECT DISTINCT 'priority:' || o_orderpriority, 'brand:' || p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
      UNION SELECT DISTINCT 'brand:' || p_brand, 'nation:' || s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
    p AS (SELECT src AS source, dst AS target, 1 AS hops, count(*) AS n_paths FROM e GROUP BY ALL
      UNION ALL SELECT a.src, b.dst, 2, count(*) FROM e a JOIN e b ON a.dst = b.src GROUP BY ALL
      UNION ALL SELECT a.src, c.dst, 3, count(*) FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src GROUP BY ALL)"""


def layers(spark, d) -> DataFrame:
    """(src, dst) of ``_LAYERS``; line items are reduced to distinct keys before any join."""
    item, order = t(spark, d, "lineitem"), t(spark, d, "orders")
    part = t(spark, d, "part").select("p_partkey", F.concat(F.lit("brand:"), "p_brand").alias("brand"))
    pri = order.select("o_orderkey", "o_custkey", F.concat(F.lit("priority:"), "o_orderpriority").alias("pri"))
    one = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("segment:"), "c_mktsegment").alias("src")).join(pri.select(F.col("o_custkey").alias("c_custkey"), F.col("pri").alias("dst")).distinct(), "c_custkey").select("src", "dst")
    two = item.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(pri.select("o_orderkey", "pri"), "o_orderkey").select("pri", "p_partkey").distinct().join(part, "p_partkey").select(F.col("pri").alias("src"), F.col("brand").alias("dst"))
    home = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst"))
    three = item.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct().join(part, "p_partkey").select("brand", "l_suppkey").distinct().join(home, "l_suppkey").select(F.col("brand").alias("src"), "dst")
    return one.union(two).union(three).distinct()


@query(f"WITH {_LAYERS} SELECT source, target, hops, n_paths FROM p")
def shortest_implicit_path(spark, d):
    """Fewest hops between any two classes of the whole tables, and how many shortest ways there are."""
    e = cut(layers(spark, d))
    ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return schema_graph.shortest_paths(e, ends, ends).select("source", "target", "hops", "n_paths")


@query(f"WITH {_LAYERS} SELECT source AS owner, target AS child, hops AS distance FROM p")
def can_contain(spark, d):
    """Which classes may stand anywhere below which."""
    return schema_graph.can_contain(cut(layers(spark, d)))


def _inner(e: DataFrame) -> DataFrame:
    return e.where("src not like 'segment:%'").select(F.col("src").alias("class")).distinct()


@query(f"WITH {_LAYERS} SELECT source, target, hops, n_paths > 1 AS ambiguous FROM p")
def permitted_children(spark, d):
    """Children that a class may have through transparent classes (priorities and brands)."""
    e = cut(layers(spark, d))
    return schema_graph.implicit_paths(e, _inner(e)).select("source", "target", "hops", "ambiguous")


@query(f"WITH {_LAYERS} SELECT source, target, hops FROM p WHERE target LIKE 'nation:%'")
def default_fields(spark, d):
    """Primitive classes (nations) that are the default of a class, by hops."""
    e = cut(layers(spark, d))
    primitives = e.where("dst like 'nation:%'").select(F.col("dst").alias("class")).distinct()
    return schema_graph.default_fields(schema_graph.implicit_paths(e, _inner(e)), primitives)


@query(f"""WITH {_LAYERS}, k AS (SELECT 'nation:' || n_nationkey AS class, '*' || (n_nationkey % 7) AS token FROM nation)
    SELECT source, token, class, hops AS depth, count(*) OVER (PARTITION BY source, token, hops) > 1 AS ambiguous FROM p JOIN k ON k.class = target""")
def permitted_tokens(spark, d):
    """Tokens of nations that may stand in a class; two at one depth are ambiguous."""
    e = cut(layers(spark, d))
    tokens = t(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("class"), F.concat(F.lit("*"), (F.col("n_nationkey") % 7).cast("string")).alias("token"))
    return schema_graph.permitted_tokens(schema_graph.implicit_paths(e, _inner(e)), tokens)


@query("""WITH c AS (SELECT 'part:' || p_partkey AS class, 'brand:' || p_brand || '/' || p_type AS b, 'type:' || p_type AS ty, p_size FROM part),
    f AS (SELECT DISTINCT ty AS class, 'kind' AS field, 'SUBTREE' AS field_type, 0 AS seq FROM c UNION ALL SELECT DISTINCT b, 'kind', 'SUBTREE', 0 FROM c
      UNION ALL SELECT DISTINCT b, '', 'TREE', 1 FROM c UNION ALL SELECT class, 'size', 'SUBTREE', 0 FROM c UNION ALL SELECT class, '', 'TREE', 1 FROM c WHERE p_size > 25),
    up AS (SELECT class, class AS owner, 0 AS distance FROM c UNION ALL SELECT class, b, 1 FROM c UNION ALL SELECT class, ty, 2 FROM c
      UNION ALL SELECT DISTINCT b, b, 0 FROM c UNION ALL SELECT DISTINCT b, ty, 1 FROM c UNION ALL SELECT DISTINCT ty, ty, 0 FROM c),
    k AS (SELECT up.class, up.owner, field, field_type, seq, distance, row_number() OVER (PARTITION BY up.class, field ORDER BY distance, seq) AS r FROM up JOIN f ON f.class = up.owner)
    SELECT class, owner, field, field_type, CAST(row_number() OVER (PARTITION BY class ORDER BY field_type = 'TREE', distance DESC, seq) - 1 AS INTEGER) AS seq FROM k WHERE r = 1""")
def effective_fields(spark, d):
    """Own and inherited fields of every part's class: hidden ones gone, the tree field last."""
    p = t(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("class"), F.concat(F.lit("brand:"), "p_brand", F.lit("/"), "p_type").alias("b"), F.concat(F.lit("type:"), "p_type").alias("ty"), "p_size")
    classes = p.select("class", F.col("b").alias("superclass")).union(p.select("b", "ty").distinct()).union(p.select("ty", F.lit(None).cast("string")).distinct())
    field = lambda df, c, name, kind, seq: df.select(F.col(c).alias("class"), F.lit(name).alias("field"), F.lit(kind).alias("field_type"), F.lit(seq).alias("seq"))
    types, brands = p.select("ty").distinct(), p.select("b").distinct()
    fields = field(types, "ty", "kind", "SUBTREE", 0).union(field(brands, "b", "kind", "SUBTREE", 0)).union(field(brands, "b", "", "TREE", 1)).union(field(p, "class", "size", "SUBTREE", 0)).union(field(p.where("p_size > 25"), "class", "", "TREE", 1))
    return schema_graph.effective_fields(classes, fields)


@query("""WITH c AS (SELECT DISTINCT 'brand:' || p_brand || '/' || p_type AS b, 'type:' || p_type AS ty FROM part)
    SELECT DISTINCT 'priority:' || o_orderpriority AS owner, '' AS field, x AS child FROM (SELECT DISTINCT o_orderpriority, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
      JOIN (SELECT ty, ty AS x FROM c UNION SELECT ty, b FROM c) ON ty = 'type:' || p_type""")
def allowed_children(spark, d):
    """Children that a priority allows: the types of its parts with all their subclasses."""
    part = t(spark, d, "part")
    ty, br = F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("brand:"), "p_brand", F.lit("/"), "p_type")
    classes = part.select(br.alias("class"), ty.alias("superclass")).distinct().union(part.select(ty, F.lit(None).cast("string")).distinct())
    used = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select("o_orderpriority", "p_partkey").distinct().join(part.select("p_partkey", ty.alias("child")), "p_partkey")
    return schema_graph.allowed_children(used.select(F.concat(F.lit("priority:"), "o_orderpriority").alias("owner"), F.lit("").alias("field"), "child").distinct(), classes)


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, (s_suppkey * 3 + s_nationkey) % (SELECT count(*) FROM supplier) AS parent FROM supplier),
    w(start, here, path) AS (SELECT child, parent, [child] FROM e UNION ALL SELECT w.start, e.parent, list_append(w.path, w.here) FROM w JOIN e ON e.child = w.here WHERE w.here <> w.start AND NOT list_contains(w.path, w.here))
    SELECT DISTINCT start, array_to_string(path, ',') AS cycle FROM w WHERE here = start AND start = list_min(path)""")
def cycle_check(spark, d):
    """Cycles of a functional reference among suppliers, each once, from its smallest member."""
    s = t(spark, d, "supplier")
    n = s.count()
    e = s.select(F.col("s_suppkey").alias("child"), ((F.col("s_suppkey") * 3 + F.col("s_nationkey")) % n).alias("parent"))
    return schema_graph.cycles(e).select("start", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query("""SELECT o_orderkey, n, r_name || '.' || n_name || '.' || c_name AS path FROM (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n NOT BETWEEN 1 AND 7""")
def cardinality_violations(spark, d):
    """Orders whose number of line items is outside {1-7}, zeros included, with the path of their customer."""
    o = t(spark, d, "orders")
    counts = validate.count_children(o, "o_orderkey", t(spark, d, "lineitem"), "l_orderkey")
    bad = validate.cardinality_violations(counts, "n", ranges.parse_cardinality(F.lit("{1-7}")))
    return bad.join(o.select("o_orderkey", "o_custkey"), "o_orderkey").join(node_paths(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n", "path")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_required_children(spark, d):
    return validate.missing_children(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", t(spark, d, "lineitem"), "l_orderkey")


@query("SELECT p_partkey, p_name, occurrence FROM (SELECT p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS INTEGER) AS occurrence FROM part) WHERE occurrence > 1")
def duplicate_names(spark, d):
    return validate.duplicate_names(t(spark, d, "part").select("p_partkey", "p_name"), [], "p_name", "p_partkey")


_NAMES = "SELECT 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'supplier', s_name FROM supplier"


def _names(spark, d):
    parts = [("region", "r_name"), ("nation", "n_name"), ("part", "p_name"), ("supplier", "s_name")]
    out = None
    for k, c in parts:
        x = t(spark, d, k).select(F.lit(k).alias("kind"), F.col(c).alias("name"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"SELECT kind, regexp_full_match(name, '[A-Za-z]([A-Za-z0-9_-]*[A-Za-z0-9])?') AS valid, count(*) AS n FROM ({_NAMES}) GROUP BY ALL")
def invalid_identifiers(spark, d):
    return _names(spark, d).groupBy("kind", text.is_identifier(F.col("name")).alias("valid")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN p_partkey IS NULL THEN 'dangling' WHEN p_type = 'PROMO' THEN 'ok' ELSE 'wrong_class' END AS status, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def reference_integrity(spark, d):
    """References that must point at promotional parts; counted by part before the join."""
    refs = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return resolve.check_references(refs, "l_partkey", t(spark, d, "part"), "p_partkey", F.col("p_type") == "PROMO").groupBy("status").agg(F.sum("n").alias("n"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, CAST(list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], o_orderpriority) - 1 AS INTEGER) AS ordinal, o_orderpriority AS name FROM orders")
def enum_ordinals(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", resolve.enum_ordinal(F.col("o_orderpriority"), _PRIORITIES).alias("ordinal"))
    return o.withColumn("name", resolve.enum_name(F.col("ordinal"), _PRIORITIES))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'first' WHEN 'NATION_2' THEN 'second' ELSE n_name END AS n_name, n_name IN ('NATION_1', 'NATION_2') AS resolved FROM nation")
def constant_substitution(spark, d):
    c = spark.createDataFrame([("NATION_1", "first"), ("NATION_2", "second")], "name string, value string")
    return resolve.substitute_constants(t(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", c)


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'none' AS label, 1.5 AS weight, CAST(0 AS INTEGER) AS must, 'missing must' AS errors FROM events""")
def struct_defaults(spark, d):
    """A struct built from a map of texts: given, defaulted and missing attributes."""
    e = t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    b = values.build_struct(F.col("m"), [("k", "int", None), ("label", "string", "none"), ("weight", "double", "1.5"), ("must", "int", None)])
    return e.select("event_id", b.alias("b")).select("event_id", "b.value.k", "b.value.label", "b.value.weight", "b.value.must", F.array_join("b.errors", ";").alias("errors"))


_LITERALS = ["1", "-7", "0x1F", "2147483648", "3.9", "-0.5", "1e3", "true", "false", "null", "word", "12abc", "{1-3}"]
_IN = "(VALUES " + ", ".join(f"('{x}')" for x in _LITERALS) + ") v(lit)"


@query("""WITH v AS (SELECT json_extract_string(props, '$.k') AS lit, 'event' AS origin FROM events UNION ALL SELECT lit, 'inline' FROM (VALUES ('abc'), ('1.5'), ('99999999999')) x(lit))
    SELECT origin, lit, CASE WHEN regexp_full_match(lit, '-?[0-9]+') AND TRY_CAST(lit AS INTEGER) IS NOT NULL THEN CAST(lit AS INTEGER) ELSE -1 END AS value, NOT (regexp_full_match(lit, '-?[0-9]+') AND TRY_CAST(lit AS INTEGER) IS NOT NULL) AS failed, count(*) AS n FROM v GROUP BY ALL""")
def variant_build(spark, d):
    """Literals to typed ints with an error flag."""
    e = t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("lit"), F.lit("event").alias("origin"))
    x = e.union(spark.createDataFrame([("abc", "inline"), ("1.5", "inline"), ("99999999999", "inline")], "lit string, origin string"))
    v = values.to_int(values.kind_of(F.col("lit")), F.col("lit"))
    return x.groupBy("origin", "lit").agg(F.count("*").alias("n")).select("origin", "lit", F.coalesce(v, F.lit(-1)).alias("value"), v.isNull().alias("failed"), "n")


@query("""WITH v AS (SELECT DISTINCT CAST(value AS VARCHAR) AS lit FROM events WHERE regexp_full_match(CAST(value AS VARCHAR), '-?[0-9]+[.][0-9]+'))
    SELECT lit, CAST(-999 AS INTEGER) AS safe_int, CAST(trunc(CAST(lit AS DOUBLE)) AS INTEGER) AS all_int, CAST(lit AS DOUBLE) AS safe_double, 'none' AS safe_bool, CAST(lit AS DOUBLE) <> 0 AS all_bool FROM v
    UNION ALL SELECT * FROM (VALUES ('1', 1, 1, 1.0, 'none', true), ('-7', -7, -7, -7.0, 'none', true), ('0x1F', 31, 31, 31.0, 'none', true), ('true', -999, 1, -999.0, 'true', true), ('false', -999, 0, -999.0, 'false', false), ('null', -999, 0, -999.0, 'none', false), ('word', -999, 0, -999.0, 'none', true)) x""")
def convert_safe_vs_all(spark, d):
    """Both conversion modes side by side."""
    e = t(spark, d, "events").select(F.col("value").cast("string").alias("lit")).where("lit rlike '^-?[0-9]+[.][0-9]+$'").distinct()
    x = e.union(spark.createDataFrame([(v,) for v in ("1", "-7", "0x1F", "true", "false", "null", "word")], "lit string"))
    k, c = values.kind_of(F.col("lit")), F.col("lit")
    return x.select("lit", F.coalesce(values.to_int(k, c), F.lit(-999)).alias("safe_int"), values.to_int(k, c, "ALL").alias("all_int"), F.coalesce(values.to_double(k, c), F.lit(-999.0)).alias("safe_double"), F.coalesce(values.to_bool(k, c).cast("string"), F.lit("none")).alias("safe_bool"), values.to_bool(k, c, "ALL").alias("all_bool"))


@query("""WITH s AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, s + 30 AS e FROM orders),
    r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT o_custkey, min(s) AS start, max(e) AS stop, count(*) AS n_merged FROM i GROUP BY o_custkey, island""")
def range_coalesce(spark, d):
    """Thirty-day ranges from each order date, merged by customer where they overlap or touch."""
    o = t(spark, d, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("start"))
    return ranges.coalesce_spans(o.withColumn("stop", F.col("start") + 30), ["o_custkey"], "start", "stop")


@query("SELECT o_orderkey, CAST(n AS BIGINT) AS n, n BETWEEN 0 AND 2 OR n = 4 OR n > 6 AS inside FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def range_contains(spark, d):
    """Is a count in the set {<3,4,>6}."""
    counts = validate.count_children(t(spark, d, "orders"), "o_orderkey", t(spark, d, "lineitem"), "l_orderkey")
    return counts.select("o_orderkey", "n", ranges.contains_value(ranges.parse_cardinality(F.lit("{<3,4,>6}")), F.col("n")).alias("inside"))


_CARDS = ["{1}", "{0-1}", "{>0}", "{<5}", "{*}", "{1,3-5,>9}", "{5-2}", "{}", "x", "{<0}"]


@query("""SELECT * FROM (VALUES ('{1}', '{1}', 'yes'), ('{0-1}', '{<2}', 'yes'), ('{>0}', '{>0}', 'no'), ('{<5}', '{<5}', 'yes'), ('{*}', '{*}', 'no'), ('{1,3-5,>9}', '{1,3-5,>9}', 'no'), ('{5-2}', NULL, 'malformed'), ('{}', NULL, 'malformed'), ('x', NULL, 'malformed'), ('{<0}', NULL, 'malformed')) v(literal, printed, bounded)
    UNION SELECT '{' || a || '-' || b || '}', CASE WHEN b > a THEN '{' || a || '-' || b || '}' END, CASE WHEN b > a THEN 'yes' ELSE 'malformed' END FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b FROM lineitem)""")
def cardinality_literals(spark, d):
    """Cardinality literals read and written back, among them one for each pair of line number and quantity; malformed ones are null."""
    c = ranges.parse_cardinality(F.col("literal"))
    made = t(spark, d, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("a"), F.col("l_quantity").cast("bigint").alias("b")).distinct().select(F.concat(F.lit("{"), "a", F.lit("-"), "b", F.lit("}")))
    given = spark.createDataFrame([(x,) for x in _CARDS], "literal string").union(made).distinct()
    return given.select("literal", ranges.print_cardinality(c).alias("printed"), F.when(c.isNull(), "malformed").when(ranges.highest(c).isNotNull(), "yes").otherwise("no").alias("bounded"))


_SPANS = "SELECT event_id, user_id, CAST(epoch_us(ts) AS BIGINT) AS s, CAST(epoch_us(ts) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events"


def _spans(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), "value")
    return e.select("event_id", "user_id", "s", (F.col("s") + F.floor(F.col("value") * 60) * 1000000).alias("e"))


@query(f"WITH x AS ({_SPANS}) SELECT p.user_id, p.event_id AS a, q.event_id AS b FROM x p JOIN x q ON p.user_id = q.user_id AND p.event_id < q.event_id AND p.s <= q.e AND q.s <= p.e")
def interval_overlap(spark, d):
    """Pairs of a user's spans that overlap: an equi-join on user and cell of an hour."""
    return intervals.overlapping_pairs(_spans(spark, d), "user_id", "event_id", "s", "e", 3_600_000_000)


@query("""WITH x AS (SELECT event_id, user_id, ts, event_type = 'view' AS st FROM events WHERE event_type IN ('view', 'purchase')),
    y AS (SELECT *, last_value(CASE WHEN st THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_id FROM x),
    z AS (SELECT start_id, event_id AS end_id, row_number() OVER (PARTITION BY start_id ORDER BY ts, event_id) AS r FROM y WHERE NOT st AND start_id IS NOT NULL)
    SELECT start_id, end_id FROM z WHERE r = 1""")
def annotation_pairing(spark, d):
    """Ends (purchases) paired with the nearest unclosed start (view) of their user."""
    e = t(spark, d, "events").where("event_type in ('view', 'purchase')").select("event_id", "user_id", "ts", (F.col("event_type") == "view").alias("st"))
    return intervals.pair_unique(e, ["user_id"], ["ts", "event_id"], "event_id", "st")


@query(f"""WITH x AS ({_SPANS}), b AS (SELECT user_id, s AS p FROM x UNION SELECT user_id, e FROM x),
    g AS (SELECT user_id, p AS seg_start, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS seg_end FROM b)
    SELECT g.user_id, seg_start, seg_end, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY s, event_id) AS active FROM g JOIN x ON x.user_id = g.user_id AND s <= seg_start AND seg_end <= e AND s < e WHERE seg_end IS NOT NULL GROUP BY 1, 2, 3""")
def overlap_to_nesting(spark, d):
    """Stretches between boundaries with the spans open over them, in order of start."""
    g = intervals.segments(_spans(spark, d), "user_id", "event_id", "s", "e", 600_000_000)
    return g.select("user_id", "seg_start", "seg_end", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS collapsed FROM documents")
def collapse_whitespace(spark, d):
    return t(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS trimmed FROM documents")
def trim_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.trim_text(F.col("text")).alias("trimmed"))


@query("SELECT doc_id, CAST(len(string_split(text, '.')) AS INTEGER) AS n, '<' || array_to_string(string_split(text, '.'), '|') || '>' AS joined FROM documents")
def split_join(spark, d):
    parts = text.split_on(F.col("text"), ".")
    return t(spark, d, "documents").select("doc_id", F.size(parts).alias("n"), text.join_with(parts, "|", "<", ">").alias("joined"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS INTEGER) AS n_tokens FROM documents")
def token_count(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[^ \t\r\n]+")).alias("n_tokens"))


_INLINE = ["a\nb", "a\n\nb", "a\n \n\n\tb", "\n", "", "x"]
_INLINE_SQL = "SELECT * FROM (VALUES (-1, 'a' || chr(10) || 'b'), (-2, 'a' || chr(10) || chr(10) || 'b'), (-3, 'a' || chr(10) || ' ' || chr(10) || chr(10) || chr(9) || 'b'), (-4, chr(10)), (-5, ''), (-6, 'x')) v(doc_id, text)"


@query(f"""WITH x AS (SELECT doc_id, text FROM documents UNION ALL {_INLINE_SQL}),
    r AS (SELECT doc_id, text, regexp_extract_all(chr(10) || text, '\\n[ \\t\\n]*') AS runs FROM x),
    k AS (SELECT doc_id, [len(regexp_replace(q, '[ \\t]', '', 'g')) - CASE WHEN i = 1 THEN 1 ELSE 0 END FOR q, i IN runs] AS own, [len(regexp_replace(q, '[ \\t]', '', 'g')) FOR q IN runs] AS n FROM r)
    SELECT doc_id, CAST(coalesce(list_sum(own), 0) AS BIGINT) AS newlines, CAST(coalesce(list_sum([CASE WHEN v >= 2 THEN 1 ELSE 0 END FOR v IN n]), 0) AS BIGINT) AS paragraphs, CAST(coalesce(list_sum([greatest(v - 2, 0) FOR v IN n]), 0) AS BIGINT) AS sections FROM k""")
def paragraph_tokens(spark, d):
    """Newline, paragraph and section tokens of each text; a text begins as if a line had just ended."""
    x = t(spark, d, "documents").select("doc_id", "text").union(spark.createDataFrame([(-k - 1, v) for k, v in enumerate(_INLINE)], "doc_id bigint, text string"))
    runs = F.transform(F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit("\n[ \t\n]*"), F.lit(0)), lambda r: F.length(F.regexp_replace(r, "[ \t]", "")).cast("bigint"))
    total = lambda f: F.aggregate(F.transform("runs", f), F.lit(0).cast("bigint"), lambda a, b: a + b)
    y = x.select("doc_id", runs.alias("runs"))
    return y.select("doc_id", (total(lambda v: v) - 1).alias("newlines"), total(lambda v: F.when(v >= 2, 1).otherwise(0).cast("bigint")).alias("paragraphs"), total(lambda v: F.greatest(v - 2, F.lit(0)).cast("bigint")).alias("sections"))


@query("""WITH x AS (SELECT doc_id, text, CAST(length(text) // 2 AS INTEGER) AS off FROM documents), y AS (SELECT *, substr(text, 1, off) AS pre FROM x)
    SELECT doc_id, CAST(len(string_split(pre, chr(10))) AS INTEGER) AS line, CAST(length(list_extract(string_split(pre, chr(10)), -1)) + 1 AS INTEGER) AS col FROM y""")
def line_column(spark, d):
    """Line and column of the middle of each text."""
    x = t(spark, d, "documents").withColumn("off", F.floor(F.length("text") / 2).cast("int"))
    return x.select("doc_id", text.line_of(F.col("text"), F.col("off")).alias("line"), text.column_of(F.col("text"), F.col("off")).alias("col"))


@query("""WITH x AS (SELECT 'page' AS kind, page_id AS id, html AS s FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
    SELECT kind, id, replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM x""")
def xml_escape(spark, d):
    x = t(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("s")).union(t(spark, d, "documents").select(F.lit("document"), "doc_id", "text"))
    return x.select("kind", "id", text.xml_escape(F.col("s")).alias("escaped"))


@query("""SELECT conv_id, turn, '{"role":' || CAST(to_json(role) AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS json FROM conversations""")
def json_writer(spark, d):
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit('{"role":'), text.json_string(F.col("role")), F.lit(',"text":'), text.json_string(F.col("text")), F.lit("}")).alias("json"))


@query("""SELECT p_partkey, CASE WHEN k = 0 THEN b ELSE b || '_' || k END AS id FROM (SELECT p_partkey, 'part_' || replace(p_name, ' ', '-') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)""")
def assign_unique_ids(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("part_"), F.translate("p_name", " ", "-")).alias("base"))
    return unique_ids.assign_ids(p, "base", "p_partkey").select("p_partkey", "id")


@query("""SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS n_system, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) <= 1 AS valid FROM conversations GROUP BY conv_id""")
def conversation_tree(spark, d):
    """Turns as children of their conversation; the role system has cardinality {0-1}."""
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum((F.col("role") == "system").cast("bigint")).alias("n_system"))
    return c.withColumn("valid", ranges.contains_value(ranges.parse_cardinality(F.lit("{0-1}")), F.col("n_system")))


@query("""WITH x AS (SELECT 'error' AS severity, 'cardinality' AS code FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE n NOT BETWEEN 1 AND 7
    UNION ALL SELECT 'error', 'missing_child' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    UNION ALL SELECT 'warning', 'duplicate_name' FROM (SELECT row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k > 1
    UNION ALL SELECT 'note', 'invalid_name' FROM """ + f"({_NAMES}) WHERE NOT regexp_full_match(name, '[A-Za-z]([A-Za-z0-9_-]*[A-Za-z0-9])?') AND name <> '')" + " SELECT severity, code, count(*) AS n FROM x GROUP BY ALL")
def diagnostics_summary(spark, d):
    """Diagnostics of several constraints counted by severity and code."""
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem")
    counts = validate.count_children(o, "o_orderkey", l, "l_orderkey")
    parts = [
        validate.diagnostic(validate.cardinality_violations(counts, "n", ranges.parse_cardinality(F.lit("{1-7}"))), "cardinality", F.col("o_orderkey"), F.col("n")),
        validate.diagnostic(validate.missing_children(o, "o_orderkey", l, "l_orderkey"), "missing_child", F.col("o_orderkey"), F.lit("")),
        validate.diagnostic(validate.duplicate_names(t(spark, d, "part"), [], "p_name", "p_partkey"), "duplicate_name", F.col("p_partkey"), F.col("p_name"), "warning"),
        validate.diagnostic(validate.invalid_names(_names(spark, d), "name"), "invalid_name", F.col("kind"), F.col("name"), "note"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return validate.summary(out)


_PATHS = ["a/b.TXT", "x.tar.gz", "dir.d/file", "none", "c:\\d.e\\f.Abc", ".hidden"]


@query(r"""SELECT path, translate(regexp_extract(path, '\.([^./\\]*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS extension FROM (SELECT url AS path FROM pages UNION
    SELECT * FROM (VALUES ('a/b.TXT'), ('x.tar.gz'), ('dir.d/file'), ('none'), ('c:\d.e\f.Abc'), ('.hidden')))""")
def file_extensions(spark, d):
    """Extensions of all page addresses and of some odd paths."""
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string").union(t(spark, d, "pages").select("url")).distinct()
    return paths.select("path", text.file_extension(F.col("path")).alias("extension"))


_TOKENS = ["==", "--", "a-", "-a", "%", "%{", "{", "{}", "<<", "- -", "~x~", "\\>"]


@query(r"""SELECT token, regexp_matches(token, '^[^A-Za-z0-9]') AND regexp_matches(token, '[^A-Za-z0-9]$') AND NOT regexp_matches(token, '[ \t\r\n]') AND token NOT IN ('\', '%', '%{', '}%', '{!', '<\', '\>') AND NOT regexp_matches(token, '^[{}]+$') AS allowed
    FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL UNION SELECT * FROM (VALUES ('=='), ('--'), ('a-'), ('-a'), ('%'), ('%{'), ('{'), ('{}'), ('<<'), ('- -'), ('~x~'), ('\>')))""")
def user_tokens(spark, d):
    """Which of the pieces of all documents between spaces, and of some odd ones, a schema may define as tokens."""
    pieces = t(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", " ")).alias("token"))
    return spark.createDataFrame([(p,) for p in _TOKENS], "token string").union(pieces).distinct().select("token", text.is_user_defined_token(F.col("token")).alias("allowed"))
