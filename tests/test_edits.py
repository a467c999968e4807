"""Edits of node and schema tables."""

import pytest

from treeloom.operators import edits

ROWS = [(0, None, "f", 0, "r"), (1, 0, "f", 0, "a"), (2, 0, "f", 1, "b"), (3, 0, "f", 2, "c"), (4, 1, "f", 0, "d"), (5, 4, "f", 0, "e")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, "node_id int, parent_id int, field_name string, pos int, name string")


def shape(df):
    return {r["node_id"]: (r["parent_id"], r["pos"]) for r in df.collect()}


def test_remove(spark, nodes):
    gone = spark.createDataFrame([(1,), (5,), (99,)], "node_id int")
    assert shape(edits.remove(nodes, gone)) == {0: (None, 0), 2: (0, 0), 3: (0, 1)}
    assert shape(edits.remove(nodes, gone.limit(0))) == {r[0]: (r[1], r[3]) for r in ROWS}


def test_move(spark, nodes):
    moves = spark.createDataFrame([(4, 3), (4, 9), (1, 5), (7, 0), (2, 50), (3, 1)], "node_id int, new_parent int")
    out, rejected = edits.move(nodes, moves)
    assert {tuple(r) for r in rejected.collect()} == {(1, "own_subtree"), (7, "no_node"), (2, "no_parent"), (4, "moved_parent"), (3, "moved_parent")}
    assert shape(out) == {r[0]: (r[1], r[3]) for r in ROWS}
    out, rejected = edits.move(nodes, moves.where("node_id = 4"))
    assert rejected.count() == 0 and shape(out)[4] == (3, 0) and shape(out)[5] == (4, 0)


def test_rename(spark, nodes):
    out = edits.rename(nodes, spark.createDataFrame([(2, "z"), (77, "q")], "node_id int, name string"))
    assert {r["node_id"]: r["name"] for r in out.collect()} == {r[0]: "z" if r[0] == 2 else r[4] for r in ROWS}


def test_schema_edits(spark):
    make = spark.createDataFrame
    classes = make([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "class string, superclass string")
    fields = make([("a", "x", 0), ("b", "y", 0), ("b", "z", 1), ("c", "w", 0)], "owner string, field string, seq int")
    children = make([("a", "x", "b"), ("a", "x", "c"), ("b", "y", "c")], "owner string, field string, child string")
    tokens = make([("b", "", "open", "*")], "class string, field string, kind string, token string")
    out = edits.drop_classes({"classes": classes, "fields": fields, "children": children, "tokens": tokens}, make([("b",)], "class string"))
    assert {tuple(r) for r in out["classes"].collect()} == {("a", None), ("c", "a"), ("d", "c")}
    assert {r["field"] for r in out["fields"].collect()} == {"x", "w"} and {tuple(r) for r in out["children"].collect()} == {("a", "x", "c")} and out["tokens"].count() == 0
    new, rejected = edits.set_superclass(classes, make([("a", "d"), ("d", "a"), ("q", "a"), ("b", "q")], "class string, superclass string"))
    assert {tuple(r) for r in rejected.collect()} == {("a", "cyclic"), ("d", "cyclic"), ("q", "no_class"), ("b", "no_superclass")}
    new, rejected = edits.set_superclass(classes, make([("d", "a")], "class string, superclass string"))
    assert rejected.count() == 0 and {tuple(r) for r in new.collect()} == {("a", None), ("b", "a"), ("c", "b"), ("d", "a")}
    moved = edits.move_fields(fields, make([("b", "y", "c"), ("b", "z", "c"), ("a", "x", "n")], "owner string, field string, new_owner string"))
    assert {tuple(r) for r in moved.collect()} == {("n", "x", 0), ("c", "w", 0), ("c", "y", 1), ("c", "z", 2)}
