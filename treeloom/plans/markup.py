"""Queries over marked-up documents and web pages: parse, check, select, serialise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators import validate
from treeloom.operators.stages import cut
from treeloom.sinks import serialize_html_nodes, write_xml
from treeloom.sources.css import match_selector, parse_css
from treeloom.sources.reader import balance, html_nodes, lex_documents, parse, parse_rows, parts_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Modules of the queries; written for them.
RESOURCES = {
    "story.markup": r"""
\ontology#story
	\struct#story[root=true, cardinality={1}]
		\field#title[subtree=true, optional=true]
			\childRef[ref=headline]
		\field
			\childRef[ref=scene]
			\childRef[ref=par]
	\struct#headline[transparent=true, cardinality={0-1}]
		\primitive[type=string]
	\struct#scene[cardinality={>0}]
		\attributes
			\attribute#mood[type=mood, default=calm]
		\field
			\childRef[ref=par]
	\struct#par[transparent=true]
		\syntax
			\close{\paragraph}
		\field
			\childRef[ref=words]
	\struct#words[transparent=true]
		\primitive[type=string]
	\annotation#loud
	\typesystem#feelings
		\enum#mood
			\entry calm
			\entry wild
""",
}
#: How a turn is written by role; roles of no entry become a command that the schema does not know.
ROLES = {"user": "\\scene[mood=wild]{", "assistant": "\\scene{", "system": "\\scene[mood=odd]{"}
#: The documents of the queries in SQL: turns with what is left of their text.
_TURNS = """t AS (SELECT conv_id AS doc_id, coalesce(role, '') AS role, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS said FROM conversations)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def conversation_markup(spark, d) -> DataFrame:
    """(doc_id, text): every conversation as a marked-up story, a scene for each turn."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    said = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    head = F.lit("\\ghost{")
    for role, command in ROLES.items():
        head = F.when(F.col("role") == role, command).otherwise(head)
    turns = c.select(F.col("conv_id").alias("doc_id"), F.struct("turn", F.concat(head, said, F.lit("}\n")).alias("line")).alias("turn"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x["line"]), "")  # a conversation is one document
    return turns.groupBy("doc_id").agg(F.concat(F.lit("\\document\n\\import[ontology]{story.markup}\n\\begin{story}\n"), body, F.lit("\\end{story}\n")).alias("text"))


def _parsed(spark, d) -> dict[str, DataFrame]:
    """Nodes, annotations, diagnostics: parsed once."""
    rows = parse_rows(conversation_markup(spark, d), RESOURCES)
    return parts_of(cut(rows))


@query(f"WITH {_TURNS} SELECT doc_id, count(*) + 3 AS n_commands, count(*) + 5 + count(*) FILTER (said <> '') AS n_data, count(*) + 1 AS n_fields FROM t GROUP BY doc_id")
def markup_events(spark, d):
    """Events of every document, counted by kind."""
    n = lambda kind: F.sum((F.col("event") == kind).cast("bigint"))
    return lex_documents(conversation_markup(spark, d)).groupBy("doc_id").agg(n("command").alias("n_commands"), n("data").alias("n_data"), n("field_start").alias("n_fields"))


@query("SELECT DISTINCT conv_id AS doc_id, CAST(0 AS BIGINT) AS lowest, CAST(0 AS BIGINT) AS final FROM conversations")
def markup_balance(spark, d):
    """Running balance of ranges in every document."""
    return balance(lex_documents(conversation_markup(spark, d)))


@query(f"""WITH {_TURNS}, s AS (SELECT * FROM t WHERE role IN ('user', 'assistant', 'system'))
    SELECT doc_id, 'story' AS class_name, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chars FROM (SELECT DISTINCT doc_id FROM t)
    UNION ALL SELECT doc_id, 'scene', count(*), 0 FROM s GROUP BY doc_id
    UNION ALL SELECT doc_id, k, count(*), CAST(CASE WHEN k = 'string' THEN sum(length(said)) ELSE 0 END AS BIGINT) FROM s, (VALUES ('par'), ('words'), ('string')) x(k) WHERE said <> '' GROUP BY doc_id, k""")
def markup_parse(spark, d):
    """Nodes of every document by class, with the characters of their content."""
    chars = F.sum(F.coalesce(F.length("content") - 2, F.lit(0)))
    return _parsed(spark, d)["nodes"].groupBy("doc_id", "class_name").agg(F.count("*").alias("n"), chars.cast("bigint").alias("chars"))


@query(f"""WITH {_TURNS} SELECT code, count(*) AS n FROM (
    SELECT 'attributes' AS code FROM t WHERE role = 'system' UNION ALL SELECT 'not_allowed' FROM t WHERE role NOT IN ('user', 'assistant', 'system')
    UNION ALL SELECT 'cardinality' FROM t GROUP BY doc_id HAVING count(*) FILTER (role IN ('user', 'assistant', 'system')) = 0) GROUP BY code""")
def markup_validate(spark, d):
    """Diagnostics of parsing and of the schema's constraints, counted by code."""
    parts = _parsed(spark, d)
    schema = parse("\\document\n\\import[ontology]{story.markup}\n\\story\n", RESOURCES).schema.tables(spark)
    found = validate.check_documents(parts["nodes"], parts["annotations"], schema).unionByName(validate.check_schema(schema))
    own = parts["diagnostics"].select("severity", "code", F.col("doc_id").cast("string").alias("subject"), F.col("message").alias("detail"))
    return validate.at_least(found.unionByName(own), "error").groupBy("code").agg(F.count("*").alias("n"))


@query(f"""WITH {_TURNS} SELECT doc_id, count(*) FILTER (role IN ('user', 'assistant', 'system')) AS n_scenes, count(*) FILTER (role = 'user') AS n_wild FROM t GROUP BY doc_id""")
def markup_to_xml(spark, d):
    """Canonical XML of every document that has a root: its scenes and the wild ones, counted in the text."""
    parts = _parsed(spark, d)
    schema = parse("\\document\n\\import[ontology]{story.markup}\n\\story\n", RESOURCES).schema
    fields = {c: [f.name for f in schema.fields_of(c) if not f.tree] for c in schema.classes}
    times = lambda what: F.size(F.regexp_extract_all("xml", F.lit(what), F.lit(0))).cast("bigint")
    return write_xml(parts["nodes"], parts["annotations"], fields).select("doc_id", times("<story:scene[ />]").alias("n_scenes"), times('mood="wild"').alias("n_wild"))


@query()
def html_elements(spark, d):
    """Element nodes of all pages, attributes as JSON."""
    return html_nodes(spark.read.parquet(f"{d}/pages.parquet")).withColumn("attributes", F.to_json("attributes"))


@query()
def selector_match(spark, d):
    """Elements that each of three selectors picks, counted by page."""
    nodes = cut(html_nodes(spark.read.parquet(f"{d}/pages.parquet")).where("page_id is not null").select(F.col("page_id").alias("doc_id"), "node_id", "parent_id", "tag", "attributes", F.col("node_id").alias("pre"), "last"))
    style = parse_css('nav > ul > li { color: red; } body p { margin: none; } div[class="ad"] { display: none; }')
    out = None
    for k, (steps, _) in enumerate(style.selectors):
        x = match_selector(nodes, steps, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("selector", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


@query()
def serialize_round_trip(spark, d):
    """Pages written from their nodes and read again: same elements, attributes and texts in the same places."""
    nodes = cut(html_nodes(spark.read.parquet(f"{d}/pages.parquet")).where("page_id is not null"))
    again = html_nodes(serialize_html_nodes(nodes).withColumnRenamed("text", "html"))
    place = F.xxhash64("node_id", "parent_id", "tag", "depth", "pos", F.array_sort(F.map_entries("attributes")), "text")
    shape = lambda n: n.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(place.cast("decimal(38,0)")).alias("h"))
    a, b = shape(nodes), shape(again).withColumnRenamed("n", "n2").withColumnRenamed("h", "h2")
    return a.join(b, "page_id", "left").select("page_id", "n", F.coalesce((F.col("n") == F.col("n2")) & (F.col("h") == F.col("h2")), F.lit(False)).alias("equal"))
