"""The registered queries: columns of the contracts, SQL where there is some, brute force for the others."""

import os

import duckdb
import pytest

from treeloom.llm import queries

from test_ngram_join import brute as groups
from test_suffix_dedup import brute as removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, duck, name):
    df, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())


def test_op5(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r[0]: tuple(r[1:]) for r in queries.op5_suffix_array_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == removed(rows)


def test_op10(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r[0]: (r[1], r[2]) for r in queries.op10_ngram_jaccard_join(spark, SF).collect()}
    assert got == groups(rows)


def test_op8(spark, duck):
    n = duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    rows = queries.op8_toxicity(spark, SF).collect()
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("name", ["op1_media_columns", "op3_language_id", "op4_sentencepiece", "op6_chat_formatting", "op7_license_scan", "op9_lm_scoring"])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
