"""Writers: node tables to XML, HTML, JSON and graph text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.literals import write_native


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


class Element:
    """An output element; text among its children puts it on one line."""

    def __init__(self, name: str, attributes: dict | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []

    def add(self, child):
        self.children.append(child)
        return child

    def lines(self, pretty: bool, depth: int = 0) -> str:
        tabs, end = ("\t" * depth, "\n") if pretty else ("", "")
        head = self.name + "".join(f' {k}="{escape(v)}"' for k, v in sorted(self.attributes.items()))
        if not self.children:
            return f"{tabs}<{head}/>{end}"
        inner = pretty and not any(isinstance(c, str) for c in self.children)
        body = "".join(escape(c) if isinstance(c, str) else c.lines(inner, depth + 1) for c in self.children)
        return f"{tabs}<{head}>" + ("\n" if inner else "") + body + ("\t" * depth if inner else "") + f"</{self.name}>{end}"


def _value(content: str | None, pretty: bool) -> str:
    v = json.loads(content) if content is not None else None
    if isinstance(v, str):
        return v
    return "" if v is None else write_native(v, pretty)


def document_element(nodes: list[dict], annotations: list[dict], fields: dict[str, list[str]], ids: dict[int, str] | None = None, pretty: bool = True) -> Element:
    """One document's rows as an element tree.  fields: class -> its SUBTREE fields, which always appear."""
    kids: dict = {}
    for n in nodes:
        kids.setdefault(n["parent_id"], []).append(n)
    for v in kids.values():
        v.sort(key=lambda n: (n["field_name"], n["pos"], n["node_id"]))
    annos = {a["anno_id"]: a for a in annotations}
    ids = ids or {}

    def fill(e: Element, own: list[dict], cls: str):
        by_field: dict = {}
        for n in own:
            by_field.setdefault(n["field_name"], []).append(n)
        subtree = fields.get(cls, [])
        for f in subtree:
            inner = e.add(Element(f))
            for n in by_field.get(f, []):
                node(inner, n)
        for f, rows in by_field.items():
            if f not in subtree:
                for n in sorted(rows, key=lambda n: n["pos"]):
                    node(e, n)

    def node(e: Element, n: dict):
        if n["kind"] == "primitive":
            text = _value(n["content"], pretty)
            if text:
                e.add(text)
        elif n["kind"] == "anchor":
            a = annos.get(n["anno_id"], {})
            x = e.add(Element(f"a:{n['name']}:{a.get('class_name', '')}", {"name": a["name"]} if a.get("name") else {}))
            if n["name"] == "start":
                fill(x, kids.get(n["node_id"], []), f"{a.get('ontology')}:~{a.get('class_name')}")
        else:
            attributes = {k: v if isinstance(v, str) else write_native(v) for k, v in (json.loads(n["attributes"]) if n["attributes"] else {}).items()}
            if n["name"]:
                attributes["name"] = n["name"]
            if n["node_id"] in ids:
                attributes["id"] = ids[n["node_id"]]
            cls = f"{n['ontology']}:{n['class_name']}"
            fill(e.add(Element(cls, attributes)), kids.get(n["node_id"], []), cls)

    names = sorted({n["ontology"] for n in nodes if n["kind"] == "entity"})
    root = Element("document", {f"xmlns:{o}": o for o in names if o})
    for n in kids.get(None, []):
        node(root, n)
    return root


def import_elements(imports: list[tuple[str, str]]) -> list[Element]:
    """What a document imports, as elements before its content."""
    return [Element("import", {"rel": rel, "src": src} if rel else {"src": src}) for rel, src in imports]


def schema_element(schema) -> list[Element]:
    """Classes and value types as elements: an ontology or typesystem each."""
    out: dict[tuple, Element] = {}

    def of(kind, name):
        return out.setdefault((kind, name), Element(kind, {"name": name}))

    for full, c in schema.classes.items():
        onto, _, name = full.partition(":")
        attributes = {"name": name.lstrip("~")}
        if c.superclass:
            attributes["isa"] = c.superclass
        if list(c.cardinality) != [(0, None)]:
            attributes["cardinality"] = write_native(c.cardinality)
        attributes |= {k: "true" for k in ("root", "transparent") if getattr(c, k)}
        e = of("ontology", onto).add(Element("annotation" if c.annotation else "struct", attributes))
        if c.attributes:
            inner = e.add(Element("attributes"))
            for n, kind, default, optional in c.attributes:
                inner.add(Element("attribute", {"name": n, "type": kind} | ({"default": write_native(default)} if optional else {})))
        syntax = {k: getattr(c, k) for k in ("open", "close", "short") if getattr(c, k)}
        for f in c.fields:
            a = ({"name": f.name} if f.name else {}) | ({} if f.tree else {"subtree": "true"}) | ({"optional": "true"} if f.optional else {})
            x = e.add(Element("primitive" if f.primitive else "field", a | ({"type": f.primitive} if f.primitive else {})))
            for child in f.children:
                x.add(Element("childRef", {"ref": child.split(":")[-1] if child.startswith(onto + ":") else child.replace(":", ".")}))
        if syntax:
            s = e.add(Element("syntax"))
            for k, t in syntax.items():
                s.add(Element(k)).add(Element(t) if t.isalpha() else t)
    for full, t in schema.types.items():
        system, _, name = full.partition(":")
        e = of("typesystem", system).add(Element(t.kind, {"name": name} | ({"parent": t.parent} if t.parent else {})))
        for n, kind, default, optional in t.attrs:
            e.add(Element("field", {"name": n, "type": kind} | ({"default": write_native(default, True)} if optional else {})))
        for x in t.entries:
            e.add(Element("entry")).add(x)
    for full, (kind, v) in schema.constants.items():
        system, _, name = full.partition(":")
        of("typesystem", system).add(Element("constant", {"name": name, "type": kind, "value": write_native(v, True)}))
    return [out[k] for k in sorted(out)]


def write_xml(nodes: DataFrame, annotations: DataFrame, fields: dict[str, list[str]], pretty: bool = True) -> DataFrame:
    """(doc_id, xml): a document's rows are one group, folded to text.  Rows without doc_id belong to no document."""
    packed = nodes.select("doc_id", F.lit("n").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("row")).unionByName(annotations.select("doc_id", F.lit("a").alias("part"), F.to_json(F.struct(*annotations.columns)).alias("row")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blank = {"parent_id": None, "attributes": None, "content": None, "anno_id": None, "name": "", "field_name": ""}
        n = [blank | json.loads(r) for r in pdf.loc[pdf["part"] == "n", "row"]]
        a = [json.loads(r) for r in pdf.loc[pdf["part"] == "a", "row"]]
        n.sort(key=lambda x: x["node_id"])
        text = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + document_element(n, a, fields, pretty=pretty).lines(pretty)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "xml": [text]})

    return packed.where("doc_id is not null").groupBy("doc_id").applyInPandas(run, "doc_id bigint, xml string")


#: Element of each class in HTML; headings are numbered by depth.
_HTML = {"ul": "ul", "ol": "ol", "item": "li", "paragraph": "p"}
_INLINE = {"emph": "em", "strong": "strong"}


def html_document(nodes: list[dict], annotations: list[dict]) -> str:
    """A book as HTML: sections, headings h1 to h4, paragraphs, lists; emph and strong, overlapping ones nested."""
    kids: dict = {}
    for n in nodes:
        kids.setdefault(n["parent_id"], []).append(n)
    annos = {a["anno_id"]: a for a in annotations}
    root = next((n for n in kids.get(None, []) if n["class_name"] == "book"), None)
    if root is None:
        raise ValueError("only a book can be written as HTML")
    depth = {"book": 1, "chapter": 2, "section": 3, "subsection": 4}
    open_: list[int] = []
    out: list[str] = []

    def tag(a):
        return _INLINE.get(annos[a]["class_name"])

    def anchor(n):
        a = n["anno_id"]
        if n["name"] == "start":
            open_.append(a)
            if tag(a):
                out.append(f"<{tag(a)}>")
            return
        if a not in open_:
            return
        k = open_.index(a)
        above = open_[k + 1 :]
        for x in [*reversed(above), a]:
            if tag(x):
                out.append(f"</{tag(x)}>")
        open_.pop(k)
        for x in above:
            if tag(x):
                out.append(f"<{tag(x)}>")

    def walk(n, level):
        for c in kids.get(n["node_id"], []):
            name = c["class_name"]
            if c["kind"] == "anchor":
                anchor(c)
            elif c["kind"] == "primitive":
                out.append(escape(_value(c["content"], False)))
            elif name == "heading":
                out.append(f"<h{level}>")
                walk(c, level)
                out.append(f"</h{level}>")
            elif name in depth:
                out.append(f'<div class="{name}">')
                walk(c, depth[name])
                out.append("</div>")
            elif name in _HTML:
                out.append(f"<{_HTML[name]}>")
                if name == "paragraph":
                    out.extend(f"<{tag(a)}>" for a in open_ if tag(a))
                walk(c, level)
                if name == "paragraph":
                    out.extend(f"</{tag(a)}>" for a in reversed(open_) if tag(a))
                out.append(f"</{_HTML[name]}>")
            else:
                walk(c, level)

    walk(root, 1)
    return "<!DOCTYPE html><html><head><title>Document</title></head><body>" + "".join(out) + "</body></html>"


def graph_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, line): lines of a directed graph in dot form, a node or an edge each."""
    label = F.concat(F.lit('  n'), F.col("node_id").cast("string"), F.lit(' [label="'), F.col("class_name"), F.lit('"];'))
    edge = F.concat(F.lit("  n"), F.col("parent_id").cast("string"), F.lit(" -> n"), F.col("node_id").cast("string"), F.lit(";"))
    return nodes.select("doc_id", label.alias("line")).unionByName(nodes.where("parent_id is not null").select("doc_id", edge.alias("line")))


def serialize_html_nodes(nodes: DataFrame) -> DataFrame:
    """(page_id, text): element nodes of ``html_nodes`` written back, every element closed, its text before its children.

    Nodes without page_id belong to no page and are left out.
    """
    void = set("area base br col embed hr img input link meta source track wbr".split())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict = {}
        for r in pdf.sort_values("node_id").to_dict("records"):
            kids.setdefault(None if pd.isna(r["parent_id"]) else int(r["parent_id"]), []).append(r)
        out: list[str] = []
        todo: list = [("open", r) for r in reversed(kids.get(None, []))]
        while todo:
            what, r = todo.pop()
            if what == "close":
                out.append(f"</{r['tag']}>")
                continue
            attributes = "".join(f' {k}="{escape(v)}"' for k, v in sorted(dict(r["attributes"]).items()))
            out.append(f"<{r['tag']}{attributes}>")
            if r["tag"] not in void:
                out.append((r["text"] or "") if r["tag"] in ("script", "style") else escape(r["text"] or ""))
                todo.append(("close", r))
                todo.extend(("open", c) for c in reversed(kids.get(r["node_id"], [])))
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "text": ["".join(out)]})

    return nodes.where("page_id is not null").groupBy("page_id").applyInPandas(run, "page_id bigint, text string")
