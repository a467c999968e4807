import os

import pytest
from pyspark.sql import functions as F

from treeloom.functions import literals, ranges, text
from treeloom.operators import intervals, resolve, schema_graph, trees, unique_ids, validate
from treeloom.plans import markup
from treeloom.sinks import document_element, graph_text, html_document, schema_element
from treeloom.sources import lexer
from treeloom.sources.css import match_selector, parse_css, specificity
from treeloom.sources.locator import Locator, deduce
from treeloom.sources.reader import html_nodes, parse, parse_documents, read_folder
from treeloom.sources.xml_events import attribute_offsets
from treeloom.streaming.delivery import deliver, read_stream

DOCUMENTS = [
    (1, "\\document\n\\import[ontology]{story.markup}\n\\begin{story}\n\\scene[mood=wild]{The wind rose.\n\nIt <\\loud fell again\\loud> at dusk.}\n\\scene{Nothing stirred.}\n\\end{story}\n"),
    (2, "\\document\n\\import[ontology]{story.markup}\n\\story\nNo scene here at all.\n"),
    (3, "\\document\n\\import[ontology]{story.markup}\n\\begin{story}\n\\scene[mood=blue]{Wrong mood.}\n\\unknown{x}\n\\end{tale}\n"),
    (4, ""),
    (5, '<document><import rel="ontology" src="story.markup"/><story><title>A tale</title><scene><a:start:loud/>Over<a:end:loud/> there.</scene></story></document>'),
]


def kinds(source):
    return [e[0] for e in lexer.events(source)]


def tree(b, parent=None):
    out = []
    for n in b.nodes:
        if n["parent_id"] == parent:
            out.append((n["class_name"], n["content"] if n["kind"] == "primitive" else tree(b, n["node_id"])))
    return out


class TestLexer:
    def test_commands_fields_and_data(self):
        e = list(lexer.events("\\test#x[a=1,b=\"two\"]{data}{!more} end"))
        assert e[0][:5] == ("command", "test", "x", {"name": "x", "a": 1, "b": "two"}, False)
        assert [x[0] for x in e] == ["command", "field_start", "data", "field_end", "field_start", "data", "field_end", "data"]
        assert [x[1] for x in e if x[0] == "field_start"] == [False, True]

    def test_comments_nest(self):
        assert kinds("a%{ b %{ c }% d }%e % f\ng") == ["data"]
        assert next(lexer.events("a%{ b %{ c }% d }%e % f\ng"))[1] == "ae g"
        assert kinds("%{ open") == ["error"]

    def test_escapes_and_line_breaks(self):
        e = next(lexer.events("a\\{b\r\nc\\%"))
        assert e[1] == "a{b\nc%" and e[2] == (1, 5)

    def test_ranges(self):
        assert kinds("\\begin{a}x\\end{a}") == ["command", "data", "range_end"]
        assert "error" in kinds("\\begin{a}\\end{b}") and "error" in kinds("\\end{a}") and "error" in kinds("\\begin{a}")

    def test_annotations(self):
        e = list(lexer.events("<\\em#a{x}text\\em#a> and <\\em y\\>"))
        assert [x[0] for x in e] == ["anno_start", "field_start", "data", "field_end", "data", "anno_end", "data", "anno_start", "data", "anno_end"]
        assert e[5][1:3] == ("em", "a") and e[-1][1:3] == ("", "")


class TestLiterals:
    @pytest.mark.parametrize(
        ("source", "value"),
        [("1", 1), ("-7", -7), ("0x1F", 31), ("1.5", 1.5), ("50e2", 5000.0), ("true", True), ("null", None), ("name", "name"), ('"a\\n\\x41\\u00e4"', "a\nAä"), ("[1, 2]", [1, 2]), ("[k=1, v]", {"k": 1, "#1": "v"}), ("[]", []), ("{1-3}", [(1, 3)]), ("{>0,*}", [(1, None), (0, None)]), ("free text here", "free text here")],
    )
    def test_values(self, source, value):
        assert literals.read(source) == value

    @pytest.mark.parametrize("source", ['"open', "[1, 2", "{3-1}", "99999999999", "{<0}"])
    def test_errors(self, source):
        with pytest.raises(literals.LiteralError):
            literals.read(source)

    def test_writers(self):
        v = {"b": [1, 2.5], "a": literals.Cardinality([(0, 1), (3, None)]), "c": "x\"y"}
        assert literals.write_json(v) == '{"a":"{<2,>2}","b":[1,2.5],"c":"x\\"y"}'
        assert literals.write_native([1, {"k": "v"}]) == '[1,["k"="v"]]'
        assert literals.write_native([1], pretty=True) == "[\n\t1\n]"


LIBRARY = {
    "text.markup": r"""
\ontology#text
	\struct#book[root=true]
		\field
			\childRef[ref=part]
			\childRef[ref=par]
	\struct#part
		\field
			\childRef[ref=par]
	\struct#par[transparent=true]
		\syntax
			\close{\paragraph}
		\field
			\childRef[ref=str]
	\struct#str[transparent=true]
		\primitive[type=string]
	\annotation#emph
	\annotation#note
		\field#body
			\childRef[ref=par]
""",
    "lines.markup": r"""
\ontology#lines
	\struct#poem[root=true]
		\field
			\childRef[ref=line]
			\childRef[ref=block]
	\struct#line[transparent=true]
		\syntax
			\close{\newline}
		\primitive[type=string]
	\struct#block
		\syntax
			\open{\indent}
			\close{\dedent}
		\field
			\childRef[ref=line]
			\childRef[ref=block]
""",
    "loop.markup": "\\ontology#loop\n\t\\import[ontology]{loop.markup}\n",
}


class TestBuilder:
    def test_implicit_structure_and_paragraphs(self):
        b = parse("\\import[ontology]{text.markup}\n\\begin{book}\none\n\ntwo \\part{three} four\n\\end{book}", LIBRARY)
        assert not b.diagnostics
        par = lambda *s: ("par", [("str", [("string", f'"{x}"')]) for x in s])
        assert tree(b) == [("book", [par("one"), par("two"), ("part", [par("three")]), par("four")])]

    def test_indentation(self):
        b = parse("\\import[ontology]{lines.markup}\n\\begin{poem}\na\n\tb\n\t\tc\nd\n\\end{poem}", LIBRARY)
        line = lambda s: ("line", [("string", f'"{s}"')])
        assert tree(b) == [("poem", [line("a"), ("block", [line("b"), ("block", [line("c")])]), line("d")])]

    def test_annotations_overlap(self):
        b = parse("\\import[ontology]{text.markup}\n\\book{a <\\emph b <\\emph#x c\\emph> d\\emph#x> e}", LIBRARY)
        # an end without an id closes the nearest start, whatever its id; the named end then finds none
        assert [(a["name"], a["end_node"] is not None) for a in b.annotations] == [("", False), ("x", True)]
        assert "annotation_end" in [d[2] for d in b.diagnostics]

    def test_annotation_content_and_xml(self):
        b = parse('<document><import rel="ontology" src="text.markup"/><book>This <a:start:note>why?</a:start:note>word<a:end:note/>.</book></document>', LIBRARY)
        assert not b.diagnostics and len(b.annotations) == 1 and b.annotations[0]["end_node"] is not None
        assert tree(b)[0][1][0][1][1][1] == [("par", [("str", [("string", '"why?"')])])]

    def test_values_constants_and_defaults(self):
        source = "\\document\n\\typesystem#t\n\t\\struct#rgb\n\t\t\\field#r[type=int]\n\t\t\\field#g[type=int,default=7]\n\t\\constant#red[type=rgb,value=[r=255]]\n\\ontology#o\n\t\\struct#a[root=true]\n\t\t\\field\n\t\t\t\\childRef[ref=b]\n\t\\struct#b\n\t\t\\primitive[type=rgb]\n\\begin{a}\n\\b{red}\n\\b{[1, 2]}\n\\b{nonsense}\n\\end{a}"
        b = parse(source)
        assert [n["content"] for n in b.nodes if n["kind"] == "primitive"] == ['{"g":7,"r":255}', '{"g":2,"r":1}']
        assert [d[2] for d in b.diagnostics] == ["value"]

    @pytest.mark.parametrize("source", ["\\import[ontology]{missing}\n\\book{x}", "\\import[ontology]{text.markup}\n\\book{\\nothing}", "\\import[ontology]{loop.markup}", "text only", "<document><book></document>"])
    def test_errors_are_data(self, source):
        assert parse(source, LIBRARY).diagnostics

    def test_html_nests_overlapping_annotations(self):
        b = parse("\\import[ontology]{text.markup}\n\\book{a <\\emph#p b <\\emph#q c \\emph#p> d \\emph#q> e}", LIBRARY)
        assert "a<em>b<em>c</em></em><em>d</em>e" in html_document(b.nodes, b.annotations).replace(" ", "")

    def test_xml_writer(self):
        b = parse("\\import[ontology]{text.markup}\n\\book#n{a & b}", LIBRARY)
        out = document_element(b.nodes, b.annotations, {}).lines(True)
        assert '<text:book name="n">' in out and "<text:str>a &amp; b</text:str>" in out
        assert any(e.name == "ontology" for e in schema_element(b.schema))


class TestDataFrames:
    def test_documents_and_checks(self, spark):
        parts = parse_documents(spark.createDataFrame([*DOCUMENTS, (6, None)], "doc_id bigint, text string"), markup.RESOURCES)
        schema = parse(DOCUMENTS[0][1], markup.RESOURCES).schema.tables(spark)
        found = {(r["code"], r["subject"]) for r in validate.check_documents(parts["nodes"], parts["annotations"], schema).collect()}
        assert found == {("cardinality", "2/0")}
        assert validate.check_schema(schema).count() == 0
        assert graph_text(parts["nodes"]).where("line like '%->%'").count() == parts["nodes"].where("parent_id is not null").count()

    def test_faulty_nodes(self, spark):
        row = "doc_id bigint, node_id int, parent_id int, field_name string, pos int, kind string, ontology string, class_name string, name string, transparent boolean, attributes string, content string, anno_id int"
        e = lambda i, p, kind, cls, name="", f="", anno=None: (1, i, p, f, 0, kind, "story", cls, name, False, None, None, anno)
        nodes = spark.createDataFrame([e(0, None, "entity", "story"), e(1, 0, "entity", "scene", "a"), e(2, 0, "entity", "scene", "a"), e(3, 77, "entity", "scene"), e(4, 1, "primitive", "string"), e(5, 4, "entity", "words", "b\n"), e(6, 1, "anchor", "", "start", anno=8), e(7, 1, "anchor", "", "end", anno=9), e(8, 1, "anchor", "", "end", anno=30)], row)
        annotations = spark.createDataFrame([(1, 8, "story", "loud", "", None, 7, 6), (1, 9, "story", "quiet", "", None, 6, 99)], "doc_id bigint, anno_id int, ontology string, class_name string, name string, attributes string, start_node int, end_node int")
        schema = parse(DOCUMENTS[0][1], markup.RESOURCES).schema.tables(spark)
        found = {(r["code"], r["subject"]) for r in validate.check_documents(nodes, annotations, schema).collect()}
        want = {("duplicate_name", "1/2"), ("parent_missing", "1/3"), ("primitive_not_allowed", "1/4"), ("parent_kind", "1/5"), ("invalid_name", "1/5"), ("anchor_unconnected", "1/8")}
        want |= {("annotation_back_reference", "1/8"), ("annotation_order", "1/8"), ("annotation_end_node", "1/9"), ("unknown_annotation", "1/9"), ("annotation_back_reference", "1/9")}
        assert want <= found, want - found
        assert not {c for c, s in found if s in ("1/0", "1/1")} - {"cardinality", "primitive_missing"}

    def test_faulty_schema(self, spark):
        make = spark.createDataFrame
        any_ = [(0, None)]
        schema = {
            "classes": make([("o:a", "o:b", any_, True, True, False), ("o:b", "o:a", any_, False, False, False), ("o:1", "o:z", [], False, False, False), ("o:a", None, any_, False, False, False)], "class string, superclass string, cardinality array<struct<start:bigint,end:bigint>>, transparent boolean, root boolean, annotation boolean"),
            "fields": make([("o:a", "", "SUBTREE", False, None, False, 0, True), ("o:a", "name", "SUBTREE", True, "string", False, 1, True), ("o:b", "f", "TREE", False, None, False, 0, True), ("o:b", "f", "TREE", False, None, False, 1, True)], "owner string, field string, field_type string, primitive boolean, type string, optional boolean, seq int, declared boolean"),
            "children": make([("o:a", "name", "o:b")], "owner string, field string, child string"),
            "tokens": make([("o:a", "", "open", "word"), ("o:a", "", "close", ")"), ("o:b", "f", "close", "*"), ("o:b", "f", "short", "!")], "class string, field string, kind string, token string"),
            "types": make([("t:e", "enum", None), ("t:s", "struct", "t:e"), ("t:x", "struct", "t:gone"), ("t:p", "struct", "t:q"), ("t:q", "struct", "t:p"), ("t:9", "enum", None)], "type string, kind string, parent string"),
            "type_fields": make([("t:s", "a", 0), ("t:s", "a", 1), ("t:s", "-", 2)], "type string, field string, seq int"),
            "entries": make([("t:9", "x", 0), ("t:9", "x", 1), ("t:9", "0", 2)], "type string, entry string, ordinal int"),
        }
        found = {(r["code"], r["subject"]) for r in validate.check_schema(schema).collect()}
        want = {("root_and_transparent", "o:a"), ("invalid_name", "o:1"), ("unknown_superclass", "o:1"), ("empty_cardinality", "o:1"), ("nameless_subtree", "o:a"), ("reserved_name", "o:a"), ("no_children", "o:b"), ("primitive_with_children", "o:a"), ("duplicate_class", "o:a"), ("duplicate_field", "o:b"), ("several_tree_fields", "o:b"), ("invalid_token", "o:a"), ("short_token_of_field", "o:b"), ("close_without_open", "o:b")}
        want |= {("empty_enum", "t:e"), ("parent_no_struct", "t:s"), ("unknown_parent_type", "t:x"), ("cyclic_type", "t:p"), ("invalid_type_name", "t:9"), ("duplicate_entry", "t:9"), ("invalid_entry", "t:9"), ("duplicate_attribute", "t:s"), ("invalid_attribute", "t:s")}
        assert want <= found, want - found

    def test_deep_chains(self, spark):
        chain = spark.createDataFrame([(k, k + 1) for k in range(130)], "child bigint, parent bigint")
        up = schema_graph.isa_closure(chain)
        assert up.where("sub = 0 and sup = 130 and distance = 130").count() == 1 and up.count() == 131 * 132 // 2
        e = chain.select(F.col("child").alias("src"), F.col("parent").alias("dst")).where("src < 21")
        t = e.where("src > 0").select(F.col("src").alias("class"))
        got = schema_graph.implicit_paths(e, t).where("source = 0 and target = 21").first()
        assert got["hops"] == 21 and got["path"] == list(range(1, 22)) and not got["ambiguous"]
        ring = chain.unionByName(spark.createDataFrame([(130, 5), (200, 201), (201, 200), (300, 300)], chain.schema))
        assert sorted((r["start"], r["cycle"]) for r in schema_graph.cycles(ring).collect()) == [(5, list(range(5, 131))), (200, [200, 201]), (300, [300])]
        loops = schema_graph.can_contain(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "src string, dst string"))
        assert {tuple(r) for r in loops.collect()} == {("a", "b", 1), ("b", "a", 1), ("a", "a", 2), ("b", "b", 2), ("c", "c", 1)}

    def test_exact_ends_and_control_characters(self, spark):
        import json

        rows = spark.createDataFrame([("abc",), ("abc\n",), ("a\x01b\u2028\"\\",), (None,)], "x string")
        assert [r[0] for r in rows.select(text.is_identifier(F.col("x"))).collect()] == [True, False, False, None]
        got = [r[0] for r in rows.select(text.json_string(F.col("x"))).collect()]
        assert got[3] is None and [json.loads(g) for g in got[:3]] == ["abc", "abc\n", "a\x01b\u2028\"\\"]

    def test_scoped_paths(self, spark):
        nodes = spark.createDataFrame([(0, None, "doc"), (1, 0, "a"), (2, 1, ""), (3, 2, "x"), (4, 3, "y"), (5, 0, "b"), (6, 5, "x"), (7, 6, "z"), (8, 5, "x"), (9, 8, "z")], "node_id int, parent_id int, name string")
        refs = spark.createDataFrame([(1, 1, ["x", "y"]), (2, 4, ["x"]), (3, 7, ["x", "z"]), (4, 3, ["b", "x"]), (5, 4, ["nowhere"]), (6, 4, []), (7, 4, None)], "ref_id int, node_id int, path array<string>")
        got = {r["ref_id"]: (r["node_id"], r["scope_id"], r["ambiguous"]) for r in resolve.resolve_scoped(refs, nodes).collect()}
        assert got == {1: (4, 1, False), 2: (3, 2, False), 3: (7, 5, True), 4: (6, 0, True), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None)}
        assert resolve.resolve_scoped(refs.limit(0), nodes).count() == 0 and resolve.resolve_scoped(refs, nodes.limit(0)).where("node_id is not null").count() == 0

    def test_pairs_stay_in_their_scope(self, spark):
        e = spark.createDataFrame([(1, 0, "a", True, 1), (1, 1, "a", False, 2), (1, 2, "a", False, 1), (None, 3, "a", True, 1)], "doc bigint, at bigint, name string, st boolean, field int")
        got = {(r["start_at"], r["end_at"]) for r in intervals.pair_stack(e, "doc", "at", "name", "st", "field").collect()}
        assert got == {(0, 2), (None, 1)}
        assert {(r["start_at"], r["end_at"]) for r in intervals.pair_stack(e, "doc", "at", "name", "st").collect()} == {(0, 1), (None, 2)}

    def test_cycles_and_closure(self, spark):
        e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "child string, parent string")
        assert [r["cycle"] for r in schema_graph.cycles(e).collect()] == [["a", "b", "c"]]
        assert {(r["sub"], r["sup"]) for r in schema_graph.isa_closure(e).collect()} >= {("d", "c"), ("d", "d"), ("a", "a")}

    def test_effective_fields(self, spark):
        c = spark.createDataFrame([("p", None), ("s", "p")], "class string, superclass string")
        f = spark.createDataFrame([("p", "x", "SUBTREE", 0), ("p", "", "TREE", 1), ("s", "y", "SUBTREE", 0), ("s", "x", "SUBTREE", 1), ("s", "body", "TREE", 2)], "class string, field string, field_type string, seq int")
        rows = sorted((r["seq"], r["field"], r["owner"]) for r in schema_graph.effective_fields(c, f).where("class = 's'").collect())
        assert [r[1:] for r in rows] == [("y", "s"), ("x", "s"), ("body", "s")]

    def test_implicit_paths(self, spark):
        e = spark.createDataFrame([("book", "par"), ("par", "str"), ("book", "part"), ("part", "par")], "src string, dst string")
        t = spark.createDataFrame([("par",), ("str",)], "class string")
        got = {(r["source"], r["target"]): (r["hops"], r["ambiguous"]) for r in schema_graph.implicit_paths(e, t).collect()}
        assert got[("book", "str")] == (2, False) and ("book", "par") in got and got[("part", "str")] == (2, False)

    def test_pairing(self, spark):
        e = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", True), (1, 2, "a", False), (1, 3, "b", False), (1, 4, "a", False)], "doc bigint, pos bigint, name string, st boolean")
        got = {(r["start_at"], r["end_at"]) for r in intervals.pair_stack(e, "doc", "pos", "name", "st").collect()}
        assert got == {(0, 2), (1, 3), (None, 4)}

    def test_overlaps(self, spark):
        s = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 21, 30), (2, 4, 0, 100), (1, 5, 0, 40)], "k int, id int, s bigint, e bigint")
        got = {(r["a"], r["b"]) for r in intervals.overlapping_pairs(s, "k", "id", "s", "e", 7).collect()}
        assert got == {(1, 2), (1, 5), (2, 5), (3, 5)}

    def test_coalesce(self, spark):
        s = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 7, 8), (1, 2, 2), (2, 5, None), (2, 9, 9)], "k int, s bigint, e bigint")
        assert sorted(tuple(r) for r in ranges.coalesce_spans(s, ["k"], "s", "e").collect()) == [(1, 1, 5, 3), (1, 7, 8, 1), (2, 5, None, 2)]

    def test_cardinality_columns(self, spark):
        rows = [("{1}",), ("{0-1}",), ("{>0}",), ("{2,>5}",), ("{2-1}",), ("",)]
        c = ranges.parse_cardinality(F.col("x"))
        got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(ranges.print_cardinality(c), ranges.contains_value(c, F.lit(1)), ranges.lowest(c)).collect()]
        assert got == [("{1}", True, 1), ("{<2}", True, 0), ("{>0}", True, 1), ("{2,>5}", False, 2), (None, None, None), (None, None, None)]

    def test_unique_ids_skip_what_is_taken(self, spark):
        n = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x_1"), (5, "y")], "n int, base string")
        taken = spark.createDataFrame([("y",), ("x_2",)], "id string")
        got = {r["n"]: r["id"] for r in unique_ids.assign_ids(n, "base", "n", taken).collect()}
        assert got == {1: "x", 2: "x_3", 3: "x_4", 4: "x_1", 5: "y_1"}

    def test_selectors(self, spark):
        page = '<html><body><nav id="n"><ul><li class="a">1</li><li>2</li></ul></nav><p><b>x</b></p></body></html>'
        nodes = trees.interval_encode(html_nodes(spark.createDataFrame([(1, page)], "page_id bigint, html string")).withColumnRenamed("page_id", "doc_id"), ["node_id"])
        count = lambda s: match_selector(nodes, parse_css(s + " { a: b; }").selectors[0][0], "doc_id").count()
        assert [count(s) for s in ("li", "nav li", "nav > li", "ul > li", 'li[class="a"]', "nav#n b", "body b", "*")] == [2, 2, 0, 2, 1, 0, 1, 8]

    def test_resolution(self, spark):
        n = spark.createDataFrame([("1", None, "a", "k"), ("2", "1", "b", "k"), ("3", "1", "b", "m"), ("4", None, "b", "k")], "node_id string, parent_id string, name string, kind string")
        assert {r["node_id"] for r in resolve.resolve_path(n, ["a", "b"]).collect()} == {"2", "3"}
        assert {r["node_id"] for r in resolve.resolve_path(n, ["a", "b"], ["m"]).collect()} == {"3"}

    def test_text_functions(self, spark):
        d = spark.createDataFrame([("  a \n\t b ",)], "s string")
        r = d.select(text.collapse(F.col("s")), text.trim_text(F.col("s")), text.json_string(F.col("s")), text.normalise_linebreaks(F.lit("a\r\nb\rc\n\rd"))).first()
        assert tuple(r) == ("a b", "a \n\t b", '"  a \\n\\t b "', "a\nb\nc\nd")


def test_css_and_specificity():
    s = parse_css('a, b > c[d="e"]:f(1, 2) { x: y; } a { x: z; w: "v v"; } /* c */ #i::g { }')
    assert len(s.selectors) == 4 and s.merged()[((" ", "a", ()),)] == {"x": "z", "w": "v v"}
    assert specificity(s.selectors[1][0]) == (0, 2, 2) and specificity(s.selectors[3][0])[0] == 1
    with pytest.raises(ValueError):
        parse_css("a { x y; }")


def test_locator(tmp_path):
    (tmp_path / "new").mkdir()
    for name in ("book.xml", "book.xml~", "new/book.markup"):
        (tmp_path / name).write_text(name)
    where = Locator({"ontology": [str(tmp_path)]})
    assert where.read(where.locate("book", "ontology")) == "book.xml"
    where.add_path("ontology", str(tmp_path / "new"))
    assert where.read(where.locate("book", "ontology")) == "new/book.markup"
    assert where.autocomplete(str(tmp_path / "book")) == [str(tmp_path / "book.xml")]
    assert deduce("ontology", "a.xml") == ("xml", {"ontology"})
    with pytest.raises(ValueError):
        deduce("ontology", "a.png")


def test_attribute_offsets():
    tag = '<a b="cä" d = \'e\'/>'
    got = attribute_offsets(tag, 0)
    raw = tag.encode()
    assert {k: raw[a:b].decode() for k, (a, b) in got.items()} == {"b": "cä", "d": "e"}


def test_data_source_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.markup").write_text("\\document\n\\ontology#o\n\t\\struct#a[root=true]\n\t\t\\primitive[type=int]\n\\a{7}")
    nodes = read_folder(spark, str(src))
    assert nodes.where("kind = 'primitive'").first()["content"] == "7"
    q = deliver(read_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    streamed = spark.read.parquet(str(tmp_path / "out/nodes"))
    assert streamed.count() == nodes.count()
    assert os.path.isdir(tmp_path / "cp")


def test_command_line(tmp_path, capsys):
    from treeloom.__main__ import main

    (tmp_path / "ontology").mkdir()
    (tmp_path / "ontology/text.markup").write_text(LIBRARY["text.markup"])
    (tmp_path / "doc.markup").write_text("\\import[ontology]{text}\n\\book{Hello}")
    (tmp_path / "bad.markup").write_text("\\import[ontology]{text}\n\\book{\\none}")
    assert main([str(tmp_path / "doc.markup"), "-I", str(tmp_path), "-f"]) == 0
    out = capsys.readouterr().out
    assert "<text:str>Hello</text:str>" in out and "<ontology " in out
    assert main([str(tmp_path / "doc.markup"), "-I", str(tmp_path), "-F", "html", "-o", str(tmp_path / "o.html")]) == 0
    assert "Hello" in (tmp_path / "o.html").read_text()
    assert main([str(tmp_path / "bad.markup"), "-I", str(tmp_path)]) == 1 and "bad.markup:2:" in capsys.readouterr().err
    assert main([str(tmp_path / "none")]) == 2
