"""User-defined tokens and white space: the trie, ids, marks, and what they do to a document."""

import random

import pytest

from treeloom.sources.reader import parse
from treeloom.sources.tokens import Registry, Trie, first_word, marks, protect, take

LIBRARY = {
    "notes.markup": r"""
\ontology#notes
	\struct#page[root=true]
		\field
			\childRef[ref=words]
			\childRef[ref=sum]
			\childRef[ref=bullet]
			\childRef[ref=raw]
			\childRef[ref=cell]
	\struct#words[transparent=true]
		\primitive[type=string]
	\struct#sum
		\syntax
			\open{$}
			\close{$}
		\field#low[subtree=true, optional=true]
			\syntax
				\open{_(}
				\close{)}
			\childRef[ref=words]
		\field
			\childRef[ref=words]
			\childRef[ref=power]
	\struct#power
		\syntax
			\short[greedy=false]{^}
		\field
			\childRef[ref=words]
	\struct#bullet
		\syntax
			\short{--}
		\field
			\childRef[ref=words]
	\struct#raw
		\syntax
			\open{<<}
			\close{>>}
		\primitive[type=string, whitespaceMode=preserve]
	\struct#cell
		\syntax
			\open{<}
			\close{>}
		\primitive[type=string]
			\syntax
				\whitespace{trim}
	\annotation#strong
		\syntax
			\open{**}
			\close{**}
	\annotation#emph
		\syntax
			\open{*}
			\close{*}
""",
    "twice.markup": "\\ontology#o\n\\struct#a[root=true]\n\\field\n\\childRef[ref=b]\n\\childRef[ref=c]\n\\struct#b\n\\syntax\n\\open{+}\n\\close{-}\n\\struct#c\n\\syntax\n\\open{+}\n\\close{-}\n",
}


def read(body, kind=None):
    return parse("\\import[ontology]{notes.markup}\n" + body, LIBRARY) if kind is None else parse(body, LIBRARY, kind=kind)


def tree(b, parent=None):
    return [(n["field_name"] + "/" + n["class_name"] if n["field_name"] else n["class_name"], n["content"] if n["kind"] == "primitive" else tree(b, n["node_id"])) for n in b.nodes if n["parent_id"] == parent and n["kind"] != "anchor"]


def words(s):
    return ("words", [("string", f'"{s}"')])


def test_trie_finds_the_longest():
    t = Trie(["a", "ab", "abcd", "b"])
    assert t.longest("abcx") == "ab" and t.longest("abcd") == "abcd" and t.longest("xab", 1) == "ab" and t.longest("c") == ""
    assert "ab" in t and "abc" not in t and not t.add("ab") and not t.add("")
    assert t.remove("abcd") and not t.remove("abcd") and not t.remove("abc") and t.longest("abcd") == "ab"


def test_trie_against_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        tokens = {"".join(rng.choice("+-*") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        text = "".join(rng.choice("+-*x ") for _ in range(40))
        want = sorted(((k, max((t for t in tokens if text.startswith(t, k)), key=len)) for k in range(40) if any(text.startswith(t, k) for t in tokens)))
        assert [(m.start, m.token) for m in marks(text, Trie(tokens))] == want
        assert all(m.start != 3 for m in marks(text, Trie(tokens), [3]))


def test_ids_are_counted_and_used_again():
    r = Registry()
    assert (r.register("a"), r.register("b"), r.register("a"), r.register("")) == (0, 1, 0, None)
    assert r.unregister("a") and "a" in r.trie and r.unregister("a") and "a" not in r.trie and not r.unregister("a")
    assert (r.register("c"), r.register("d")) == (0, 2)


def test_white_space_modes():
    s = " \t a \n  b "
    assert take(s, "preserve") == s and take(s, "trim") == "a \n  b" and take(s) == "a b"
    assert take(protect("a  b ", [1, 2, 4])) == "a  b " and take("   ") == ""
    assert first_word("  ab c d") == ("  ab", " c d") and first_word("ab") == ("ab", "")


def test_elements_and_fields_by_token():
    b = read("\\page{one $_(k)two$ three}")
    assert not b.diagnostics
    assert tree(b) == [("page", [words("one"), ("sum", [("low/words", [("string", '"k"')]), words("two")]), words("three")])]


def test_short_tokens():
    b = read("\\page{$x^2 y$ and}")
    assert tree(b) == [("page", [("sum", [words("x"), ("power", [words("2")]), words("y")]), words("and")])]
    b = read("\\page{a --b c d}")
    assert tree(b) == [("page", [words("a"), ("bullet", [words("b c d")])])]


def test_longest_match_and_modes():
    b = read("\\page{<<  keep \t this >> <  a  b  >}")
    assert tree(b) == [("page", [("raw", [("string", '"  keep \\t this "')]), ("cell", [("string", '"a  b"')])])]


def test_annotations_by_token():
    b = read("\\page{a *b **c* d** e}")
    assert [(a["class_name"], a["end_node"] is not None) for a in b.annotations] == [("emph", True), ("strong", True)]
    assert [n["name"] for n in b.nodes if n["kind"] == "anchor"] == ["start", "start", "end", "end"]


def test_escaped_signs_are_text():
    assert tree(read("\\page{a \\*b \\$c\\$ d}")) == [("page", [words("a *b $c$ d")])]


def test_xml_has_no_user_tokens():
    b = read('<document><import rel="ontology" src="notes.markup"/><page>a *b $c$ --d</page></document>', "xml")
    assert tree(b) == [("page", [words("a *b $c$ --d")])] and not b.annotations


def test_ambiguous_token_is_said_once():
    b = parse("\\import[ontology]{twice.markup}\n\\a{" + "x " * 50 + "+ - + - }", LIBRARY)
    assert [d[2] for d in b.diagnostics].count("ambiguous_token") == 1


def test_included_offsets_are_its_own():
    b = parse("\\document\n\\import[ontology]{notes.markup}\n\\include{part}\n", LIBRARY | {"part": "\\page{some words}"})
    assert [n["src_start"] for n in b.nodes if n["class_name"] in ("page", "string")] == [0, 6]


@pytest.mark.parametrize("n", [2000, 20000])
def test_long_texts_are_linear(n):
    import time

    t = time.time()
    b = read("\\page{" + "word *x* " * n + "}")
    assert len(b.annotations) == n and time.time() - t < 2 + n / 500


def test_command_line(tmp_path, capsys):
    from treeloom.__main__ import context, main

    (tmp_path / "data" / "ontology").mkdir(parents=True)
    (tmp_path / "data" / "ontology" / "notes.markup").write_text(LIBRARY["notes.markup"])
    (tmp_path / "in.markup").write_text("\\import[ontology]{notes.markup}\n\\page{a \\nothing b}\n")
    assert main([str(tmp_path / "in.markup"), "-I", str(tmp_path / "data")]) == 1
    out, err = capsys.readouterr()
    assert '<import rel="ontology" src="notes.markup"/>' in out and "<notes:page>" in out
    lines = err.splitlines()
    assert ":2:9: error" in lines[0] and lines[1] == "\\page{a \\nothing b}" and lines[2] == " " * 8 + "^"
    assert main([str(tmp_path / "in.markup"), "-I", str(tmp_path / "data"), "-f"]) == 1 and "<import" not in capsys.readouterr()[0]
    assert main([str(tmp_path / "gone")]) == 2
    line, mark = context("x" * 50 + "!" + "y" * 200, 50)
    assert line[mark.index("^")] == "!" and line.startswith("...") and line.endswith("...")
