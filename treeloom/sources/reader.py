"""Marked-up documents as DataFrames: one row a document in, node, annotation and diagnostics rows out.

Text becomes rows in one pass of per-document Python (mapInArrow); everything after is joins and aggregates.  A
document that can't be parsed gives diagnostics, never an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeloom.sources import lexer, xml_events
from treeloom.sources.builder import Builder
from treeloom.sources.locator import Locator
from treeloom.sources.schema import Schema

NODES = "doc_id bigint, node_id int, parent_id int, field_name string, pos int, kind string, ontology string, class_name string, name string, transparent boolean, attributes string, content string, anno_id int, src_start bigint"
ANNOTATIONS = "doc_id bigint, anno_id int, ontology string, class_name string, name string, attributes string, start_node int, end_node int"
DIAGNOSTICS = "doc_id bigint, severity string, code string, message string, src_start bigint"
EVENTS = "doc_id bigint, seq int, event string, name string, ident string, detail string, src_start bigint"
#: DDL type -> Arrow type.
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_ALL = "part string, " + NODES + ", start_node int, end_node int, severity string, code string, message string"
#: Rows and characters of text after which a batch of rows goes back to Spark.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22


def source_events(text: str, kind: str) -> Iterator[tuple]:
    return xml_events.events(text) if kind == "xml" else lexer.events(text)


def kind_of(text: str | None) -> str:
    return "xml" if (text or "").lstrip().startswith("<") and not (text or "").lstrip().startswith("<\\") else "markup"


def parse(text: str | None, resources: dict[str, str] | None = None, doc_id=0, kind: str | None = None, schema: Schema | None = None) -> Builder:
    """Parses one document; resources: path -> text of what it may import."""
    locator = Locator(static=resources or {})

    def load(rel, src):
        found = locator.locate(src, rel)
        if found is None:
            return None
        body = locator.read(found)
        return source_events(body, kind_of(body))

    kind = kind or kind_of(text)
    b = Builder(doc_id, schema, load, tokens=kind != "xml")
    return b.run(source_events(text or "", kind))


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


def in_batches(rows: Callable[[int, str], Iterator[tuple]], batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows(doc_id, text) of every document, in batches bounded by rows and text.

    What Python holds is one document and one batch, however many documents come at once.
    """

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, chars = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            for row in rows(ids[k].as_py(), texts[k].as_py()):
                held.append(row)
                chars += sum(len(v) for v in row if isinstance(v, str))
                if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield made(held)
                    held, chars = [], 0
    if held:
        yield made(held)


def parse_rows(docs: DataFrame, resources: dict[str, str] | None = None) -> DataFrame:
    """All rows of parsing docs (doc_id, text) in one table, for ``parts_of``.  resources are modules: schema-sized."""
    schema = _arrow(_ALL)

    def rows(doc_id, text):
        b = parse(text, resources, doc_id)
        said = (dict(zip(("doc_id", "severity", "code", "message", "src_start"), d)) for d in b.diagnostics)
        for part, found in (("node", b.nodes), ("annotation", b.annotations), ("diagnostic", said)):
            for r in found:
                yield part, *map(r.get, schema.names[1:])

    def run(batches):
        return in_batches(rows, batches, schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _ALL)


def parts_of(rows: DataFrame) -> dict[str, DataFrame]:
    """nodes, annotations, diagnostics of ``parse_rows``; write the rows before where several are used."""
    pick = lambda ddl: [c.strip().split()[0] for c in ddl.split(",")]
    return {"nodes": rows.where("part = 'node'").select(pick(NODES)), "annotations": rows.where("part = 'annotation'").select(pick(ANNOTATIONS)), "diagnostics": rows.where("part = 'diagnostic'").select(pick(DIAGNOSTICS))}


def parse_documents(docs: DataFrame, resources: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """nodes, annotations, diagnostics of docs (doc_id, text)."""
    return parts_of(parse_rows(docs, resources))


def lex_documents(docs: DataFrame) -> DataFrame:
    """Events of docs (doc_id, text), one row each."""
    schema = _arrow(EVENTS)

    def rows(doc_id, text):
        for k, e in enumerate(source_events(text or "", kind_of(text))):
            named = e[0] not in ("data", "error", "field_start", "field_end")
            detail = e[1] if e[0] in ("data", "error") else "range" if e[0] == "command" and e[4] else ""
            yield doc_id, k, e[0], e[1] if named else "", e[2] if named and len(e) > 3 else "", detail, e[-1]

    def run(batches):
        return in_batches(rows, batches, schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, EVENTS)


class _File(InputPartition):
    def __init__(self, path):
        self.path = path


class MarkupReader(DataSourceReader):
    def __init__(self, options):
        self.locator = Locator(paths={"": [options["path"]]})

    def partitions(self):
        return [_File(p) for p in self.locator.listing(("markup", "xml", "txt"))]

    def read(self, part):
        from pyspark.sql import Row

        if part is None:
            return
        b = parse(self.locator.read(part.path), doc_id=0)
        for n in b.nodes:
            yield Row(part.path, *(n[c.strip().split()[0]] for c in NODES.split(",")))


class MarkupSource(DataSource):
    """spark.read.format("treeloom_markup").load(folder): nodes of every document of a folder, one task a file."""

    @classmethod
    def name(cls):
        return "treeloom_markup"

    def schema(self):
        return "path string, " + NODES

    def reader(self, schema):
        return MarkupReader(self.options)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MarkupSource)
    return spark.read.format("treeloom_markup").load(folder)


def html_nodes(pages: DataFrame) -> DataFrame:
    """Element nodes of pages (page_id, html): page_id, node_id, parent_id, tag, depth, pos, attributes, closed, text, last.

    node_id counts elements in document order and last is the largest of its subtree, so descendants are an interval.
    Raw-text elements (script, style) hold text only, void elements have no content, an end tag closes the nearest
    open element of its name.
    """
    from html.parser import HTMLParser

    void = set("area base br col embed hr img input link meta source track wbr".split())

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.open, self.counts = [], [], {}

        def handle_starttag(self, tag, attrs):
            parent = self.open[-1][0] if self.open else None
            self.counts[parent] = self.counts.get(parent, -1) + 1
            row = [len(self.rows), parent, tag, len(self.open), self.counts[parent], {k: v or "" for k, v in attrs}, tag in void, ""]
            self.rows.append(row)
            if tag not in void:
                self.open.append((row[0], tag))

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][1] == tag:
                    self.rows[self.open[k][0]][6] = True
                    del self.open[k:]
                    return

        def handle_data(self, data):
            if self.open:
                self.rows[self.open[-1][0]][7] += data

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string(), pa.int32()]
    names = ["page_id", "node_id", "parent_id", "tag", "depth", "pos", "attributes", "closed", "text", "last"]

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch, out = whole.slice(k, 200), []
                for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    p = Tree()
                    p.feed(html or "")
                    p.close()
                    last = list(range(len(p.rows)))
                    for r in reversed(p.rows):
                        if r[1] is not None:
                            last[r[1]] = max(last[r[1]], last[r[0]])
                    out += [(page, *r[:5], list(r[5].items()), *r[6:], end) for r, end in zip(p.rows, last)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return pages.select(F.col("page_id").cast("bigint"), "html").mapInArrow(run, "page_id bigint, node_id int, parent_id int, tag string, depth int, pos int, attributes map<string,string>, closed boolean, text string, last int")


def balance(events: DataFrame) -> DataFrame:
    """(doc_id, lowest, final): running balance of begun and ended ranges; balanced where both are 0."""
    from pyspark.sql import Window

    step = F.when((F.col("event") == "command") & (F.col("detail") == "range"), 1).when(F.col("event") == "range_end", -1).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("seq")
    run = events.withColumn("b", F.sum(step).over(w))
    return run.groupBy("doc_id").agg(F.least(F.min("b"), F.lit(0)).alias("lowest"), F.max_by("b", "seq").alias("final"))
