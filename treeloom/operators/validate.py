"""Constraints over node and schema tables; every operator yields diagnostics rows (severity, code, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import ranges, text
from treeloom.operators.schema_graph import cycles, isa_closure

SEVERITIES = ["debug", "note", "warning", "error", "fatal"]


def diagnostic(df: DataFrame, code: str, subject: Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def diagnose(df: DataFrame, *checks: tuple[Column, str, Column, Column]) -> DataFrame:
    """Diagnostics of several checks (condition, code, subject, detail) in one pass over the rows."""
    text_ = lambda c: c.cast("string")
    made = [F.when(on, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), text_(subject).alias("subject"), text_(detail).alias("detail"))) for on, code, subject, detail in checks]
    return df.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("d")).select("d.*")


def count_children(parents: DataFrame, key: str, children: DataFrame, parent_key: str) -> DataFrame:
    """(key, n): children of each parent, zeros included; children are counted before the join."""
    counted = children.groupBy(F.col(parent_key).alias("__p")).agg(F.count("*").alias("n"))
    return parents.select(key).join(counted, F.col(key) == F.col("__p"), "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cardinality_violations(counts: DataFrame, n: str, allowed: Column) -> DataFrame:
    return counts.where(~ranges.contains_value(allowed, F.col(n)))


def missing_children(parents: DataFrame, key: str, children: DataFrame, parent_key: str) -> DataFrame:
    return parents.join(children.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def duplicate_names(nodes: DataFrame, scope: list[str], name: str, order: str) -> DataFrame:
    """Second and later rows of a name within a scope, with their occurrence number."""
    w = Window.partitionBy(*scope, name).orderBy(order)
    return nodes.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def invalid_names(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(~text.is_identifier_or_empty(F.col(name)))


def summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity", "code").agg(F.count("*").alias("n"))


def at_least(diagnostics: DataFrame, severity: str) -> DataFrame:
    return diagnostics.where(F.col("severity").isin(SEVERITIES[SEVERITIES.index(severity) :]))


# ------------------------------------------------------------- documents against schemas


def check_documents(nodes: DataFrame, annotations: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """Diagnostics of parsed documents.

    nodes (doc_id, node_id, parent_id, field_name, pos, kind, ontology, class_name, name, transparent, attributes,
    content, anno_id); annotations (doc_id, anno_id, class_name, name, start_node, end_node); schema: the tables of
    ``Schema.tables``.  Those are schema-sized; the planner broadcasts them by their size.  What concerns one node is
    decided in one pass over the nodes joined with their parents.
    """
    classes, fields, children = schema["classes"], schema["fields"], schema["children"]
    at = lambda *c: F.concat_ws("/", *(F.col(x).cast("string") for x in c))
    subject = at("doc_id", "node_id")
    cls = F.concat_ws(":", "ontology", "class_name")
    known = classes.select("class", F.col("transparent").alias("may_be_transparent"), "root")
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"), cls.alias("owner"))
    in_primitive = fields.select("owner", F.col("field").alias("field_name"), F.col("primitive").alias("in_primitive"))
    allowed = children.select("owner", F.col("field").alias("field_name"), F.col("child").alias("class"), F.lit(True).alias("allowed")).distinct()
    entity = F.col("kind") == "entity"
    every = nodes.withColumn("class", F.when(entity, cls)).join(known, "class", "left").join(above, ["doc_id", "parent_id"], "left").join(in_primitive, ["owner", "field_name"], "left").join(allowed, ["owner", "field_name", "class"], "left")
    child = F.col("parent_id").isNotNull() & (F.col("parent_kind") == "entity")
    out = [
        diagnose(
            every,
            (~text.is_identifier_or_empty(F.col("name")), "invalid_name", subject, F.col("name")),
            (entity & F.col("root").isNull(), "unknown_class", subject, F.col("class")),
            (entity & F.col("transparent") & ~F.col("may_be_transparent"), "not_transparent", subject, F.col("class")),
            (entity & F.col("parent_id").isNull() & ~F.col("root"), "no_root_permission", subject, F.col("class")),
            (F.col("parent_id").isNotNull() & F.col("parent_kind").isNull(), "parent_missing", subject, F.col("parent_id")),
            ((F.col("parent_kind") == "primitive") | ((F.col("parent_kind") == "anchor") & (F.col("parent_name") != "start")), "parent_kind", subject, F.col("parent_kind")),
            (child & (F.col("kind") == "primitive") & ~F.col("in_primitive"), "primitive_not_allowed", subject, F.col("field_name")),
            (child & (F.col("kind") != "primitive") & F.col("in_primitive"), "primitive_expected", subject, F.col("field_name")),
            (child & entity & F.col("root").isNotNull() & F.col("allowed").isNull(), "child_not_allowed", subject, F.concat_ws(" in ", "class", "field_name")),
        ),
        diagnostic(duplicate_names(nodes.where("kind = 'entity' and name <> ''"), ["doc_id", "parent_id"], "name", "node_id"), "duplicate_name", subject, F.col("name")),
    ]
    typed = nodes.where("kind = 'entity'").select("doc_id", "node_id", "parent_id", "field_name", cls.alias("class"))
    roots = nodes.groupBy("doc_id").agg(F.sum((F.col("parent_id").isNull() & entity).cast("int")).alias("n"))
    out.append(diagnostic(roots.where("n = 0"), "no_root", F.col("doc_id"), F.lit("")))
    # a child counts for its class and each allowed superclass
    closure = isa_closure(classes.select(F.col("class").alias("child"), F.col("superclass").alias("parent")))
    up = typed.where("parent_id is not null").join(closure.select(F.col("sub").alias("class"), "sup"), "class")
    counted = up.groupBy("doc_id", "parent_id", "field_name", F.col("sup").alias("child")).agg(F.count("*").alias("n"))
    own = typed.select("doc_id", F.col("node_id").alias("parent_id"), F.col("class").alias("owner"))
    rules = children.join(fields.where("not primitive").select("owner", "field", "optional"), ["owner", "field"]).join(classes.select(F.col("class").alias("child"), "cardinality"), "child").withColumnRenamed("field", "field_name")
    used = counted.groupBy("doc_id", "parent_id", "field_name").agg(F.sum("n").alias("any"))
    both = own.join(rules, "owner").join(counted, ["doc_id", "parent_id", "field_name", "child"], "left").join(used, ["doc_id", "parent_id", "field_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = both.where(~ranges.contains_value(F.col("cardinality"), F.col("n")) & ~(F.col("optional") & F.col("any").isNull()))
    place = at("doc_id", "parent_id")
    out.append(diagnostic(bad, "cardinality", place, F.concat_ws(" ", F.col("child"), F.col("n").cast("string"))))
    primitive = nodes.where("kind = 'primitive'").groupBy("doc_id", "parent_id", "field_name").agg(F.count("*").alias("n"))
    need = own.join(fields.where("primitive").select("owner", F.col("field").alias("field_name"), "optional"), "owner")
    filled = need.join(primitive, ["doc_id", "parent_id", "field_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out.append(diagnose(filled, ((F.col("n") == 0) & ~F.col("optional"), "primitive_missing", place, F.col("field_name")), (F.col("n") > 1, "primitive_repeated", place, F.col("field_name"))))
    out.append(check_annotations(nodes, annotations, schema))
    return reduce(DataFrame.unionByName, out)


def check_annotations(nodes: DataFrame, annotations: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """Both ends are anchors of the same document that point back; every anchor belongs to one; the class is known."""
    who = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("anno_id").cast("string"))
    anchors = nodes.where("kind = 'anchor'")
    side = lambda k: anchors.select("doc_id", F.col("node_id").alias(f"{k}_node"), F.col("anno_id").alias(f"{k}_back"), F.col("node_id").alias(f"{k}_found"))
    known = schema["classes"].where("annotation").select(F.col("class").alias("full"), F.lit(True).alias("is_known"))
    full = F.concat(F.col("ontology"), F.lit(":~"), F.col("class_name"))
    joined = annotations.join(side("start"), ["doc_id", "start_node"], "left").join(side("end"), ["doc_id", "end_node"], "left").withColumn("full", full).join(known, "full", "left")
    back = lambda k: F.col(f"{k}_found").isNotNull() & ~F.col(f"{k}_back").eqNullSafe(F.col("anno_id"))
    found = diagnose(
        joined,
        (F.col("start_found").isNull(), "annotation_start_node", who, F.col("class_name")),
        (F.col("end_found").isNull(), "annotation_end_node", who, F.col("class_name")),
        (back("start") | back("end"), "annotation_back_reference", who, F.col("class_name")),
        (F.col("start_found") > F.col("end_found"), "annotation_order", who, F.col("class_name")),
        (F.col("is_known").isNull(), "unknown_annotation", who, F.col("class_name")),
    )
    alone = anchors.join(annotations.select("doc_id", "anno_id"), ["doc_id", "anno_id"], "left_anti")
    return found.unionByName(diagnostic(alone, "anchor_unconnected", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("node_id").cast("string")), F.col("name")))


def check_schema(schema: dict[str, DataFrame]) -> DataFrame:
    """Diagnostics of the schema tables themselves."""
    classes, fields, children = schema["classes"], schema["fields"], schema["children"]
    none = F.lit("")
    above = classes.select(F.col("class").alias("superclass"), F.lit(True).alias("known")).distinct()
    filled = children.groupBy("owner", "field").agg(F.count("*").alias("n_children"))
    own = fields.where("declared")
    out = [
        diagnose(
            classes.join(above, "superclass", "left"),
            (F.col("root") & F.col("transparent"), "root_and_transparent", F.col("class"), none),
            (~text.is_identifier(F.regexp_replace(F.element_at(F.split("class", ":"), -1), "^~", "")), "invalid_name", F.col("class"), none),
            (F.col("superclass").isNotNull() & F.col("known").isNull(), "unknown_superclass", F.col("class"), F.col("superclass")),
            (F.size("cardinality") == 0, "empty_cardinality", F.col("class"), none),
        ),
        diagnose(
            fields.join(filled, ["owner", "field"], "left"),
            ((F.col("field") == "") & (F.col("field_type") == "SUBTREE"), "nameless_subtree", F.col("owner"), none),
            (F.col("field") == "name", "reserved_name", F.col("owner"), F.col("field")),
            (~text.is_identifier_or_empty(F.col("field")), "invalid_field_name", F.col("owner"), F.col("field")),
            (~F.col("primitive") & F.col("n_children").isNull(), "no_children", F.col("owner"), F.col("field")),
            (F.col("primitive") & F.col("n_children").isNotNull(), "primitive_with_children", F.col("owner"), F.col("field")),
        ),
        diagnostic(classes.groupBy("class").count().where("count > 1"), "duplicate_class", F.col("class"), none),
        diagnostic(cycles(classes.select(F.col("class").alias("child"), F.col("superclass").alias("parent"))), "cyclic_superclass", F.col("start"), F.array_join("cycle", " ")),
        diagnostic(own.groupBy("owner", "field").count().where("count > 1"), "duplicate_field", F.col("owner"), F.col("field")),
        diagnostic(own.groupBy("owner").agg(F.sum((F.col("field_type") == "TREE").cast("int")).alias("n")).where("n > 1"), "several_tree_fields", F.col("owner"), F.col("n")),
        diagnose(
            schema["tokens"],
            (~text.is_user_defined_token(F.col("token")) & ~F.col("token").isin("paragraph", "newline", "space", "indent", "dedent"), "invalid_token", F.col("class"), F.col("token")),
            ((F.col("kind") == "short") & (F.col("field") != ""), "short_token_of_field", F.col("class"), F.col("token")),
        ),
        diagnostic(schema["tokens"].where("kind = 'close'").join(schema["tokens"].where("kind = 'open'").select("class", "field"), ["class", "field"], "left_anti").where("token not in ('paragraph', 'newline', 'space', 'dedent')"), "close_without_open", F.col("class"), F.col("token")),
        check_types(schema),
    ]
    return reduce(DataFrame.unionByName, out)


def check_types(schema: dict[str, DataFrame]) -> DataFrame:
    """Diagnostics of value types: names, entries of enumerations, attributes and parents of structs."""
    types, attributes, entries = schema["types"], schema["type_fields"], schema["entries"]
    short = F.element_at(F.split("type", ":"), -1)
    has = entries.groupBy("type").agg(F.count("*").alias("n_entries"))
    kinds = types.select(F.col("type").alias("parent"), F.col("kind").alias("parent_kind"))
    none = F.lit("")
    each = types.where("kind <> 'builtin'").join(has, "type", "left").join(kinds, "parent", "left")
    twice = lambda df, c: df.groupBy("type", c).count().where("count > 1")
    return reduce(
        DataFrame.unionByName,
        [
            diagnose(
                each,
                (~text.is_identifier(short), "invalid_type_name", F.col("type"), none),
                ((F.col("kind") == "enum") & F.col("n_entries").isNull(), "empty_enum", F.col("type"), none),
                (F.col("parent").isNotNull() & F.col("parent_kind").isNull(), "unknown_parent_type", F.col("type"), F.col("parent")),
                (F.col("parent_kind") != "struct", "parent_no_struct", F.col("type"), F.col("parent")),
            ),
            diagnose(entries, (~text.is_identifier(F.col("entry")), "invalid_entry", F.col("type"), F.col("entry"))),
            diagnostic(twice(entries, "entry"), "duplicate_entry", F.col("type"), F.col("entry")),
            diagnose(attributes, (~text.is_identifier(F.col("field")), "invalid_attribute", F.col("type"), F.col("field"))),
            diagnostic(twice(attributes, "field"), "duplicate_attribute", F.col("type"), F.col("field")),
            diagnostic(cycles(types.where("parent is not null").select(F.col("type").alias("child"), "parent")), "cyclic_type", F.col("start"), F.array_join("cycle", " ")),
        ],
    )
