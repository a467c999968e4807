"""Rows that the test tables don't have: null dates, keys and texts, dates before 1582; many documents at once."""

import datetime

import duckdb
import pyarrow as pa

from treeloom.functions import ranges
from treeloom.plans import registry
from treeloom.plans.markup import RESOURCES
from treeloom.sources import reader


def test_spans_without_start(spark):
    s = spark.createDataFrame([(1, 1, 3), (1, None, None), (1, 9, 9), (1, None, 4), (2, None, None), (2, None, None), (3, 5, None), (3, None, None)], "k int, s bigint, e bigint")
    got = sorted((tuple(r) for r in ranges.coalesce_spans(s, ["k"], "s", "e").collect()), key=repr)
    assert got == [(1, 1, 3, 1), (1, 9, 9, 3), (2, None, None, 1), (2, None, None, 1), (3, 5, None, 2)]


def test_range_coalesce_of_orders_without_date_or_customer(spark, tmp_path):
    d = datetime.datetime
    dates = [(1, d(1995, 1, 1)), (1, d(1995, 1, 31, 23)), (1, None), (1, d(1995, 5, 1)), (2, None), (2, None), (None, d(1500, 2, 3, 13)), (None, None), (3, d(1969, 12, 31, 23)), (3, d(1970, 2, 1))]
    rows = [(k, c, x) for k, (c, x) in enumerate(dates)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f'SELECT o_custkey, "start", "stop", n_merged FROM ({registry.ORACLE["range_coalesce"]})').fetchall()
    got = registry.QUERIES["range_coalesce"](spark, str(tmp_path)).select("o_custkey", "start", "stop", "n_merged").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def handed_back(monkeypatch, spark, made_by, docs):
    """Rows and bytes of the batches that a step's Python hands back for one batch of docs."""
    frame, steps = type(spark.range(0)), []
    ran = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: steps.append(f) or ran(self, f, *a, **k))
    made_by(spark.createDataFrame([], "doc_id bigint, text string"))
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(len(docs))), "text": docs})
    out = list(steps[0](iter([whole])))
    return [b.num_rows for b in out], [b.nbytes for b in out]


def test_parsing_many_documents_goes_back_in_bounded_batches(spark, monkeypatch):
    text = "\\document\n\\import[ontology]{story.markup}\n\\begin{story}\n" + "\\scene{one}\n" * 3 + "\\end{story}\n"
    rows, _ = handed_back(monkeypatch, spark, lambda d: reader.parse_rows(d, RESOURCES), [text] * 1000)
    assert sum(rows) == 13 * 1000 and max(rows) <= reader.BATCH_ROWS


def test_parsing_large_documents_goes_back_in_bounded_batches(spark, monkeypatch):
    text = "\\document\n\\import[ontology]{story.markup}\n\\begin{story}\n\\scene{" + "word " * 100_000 + "}\n\\end{story}\n"
    rows, size = handed_back(monkeypatch, spark, lambda d: reader.parse_rows(d, RESOURCES), [text] * 20)
    assert sum(rows) == 5 * 20 and max(size) < 2 * reader.BATCH_CHARS


def test_events_of_many_documents_go_back_in_bounded_batches(spark, monkeypatch):
    rows, _ = handed_back(monkeypatch, spark, reader.lex_documents, ["\\scene{one}"] * 5000)
    assert sum(rows) == 4 * 5000 and max(rows) <= reader.BATCH_ROWS
