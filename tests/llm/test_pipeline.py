"""The pipeline against plain Python versions of its stages, each on what its predecessor kept."""

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from treeloom.llm import pieces
from treeloom.llm.common import stash

from test_decontaminate import brute as windows
from test_ngram_join import brute as groups
from test_suffix_dedup import brute as removed


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    by = dict(texts)
    extra = [(500 + k, " ".join(["stupid idiot", by[k], "you moron"]), "en", "src", 0) for k in range(20)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(500 <= k < 520)) for k in [*by, *range(500, 520)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(by[5].split()[:15])), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, folder), name)
        rows = docs.collect()
        if name == "sentencepiece":
            model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), np.int32).tolist() for r in rows} == {i: model.encode(t or "") for i, t in before.items()}
            assert all(r["round_trip"] for r in rows)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(after)
        if name == "toxicity":
            assert set(before) - set(after) == set(range(500, 520))
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in groups(before.items(), 5, 80, 100).items() if i == c}
        elif name == "suffix_array_dedup":
            want = removed(before.items())
            assert set(after) == set(before)
            for r in rows:
                n, gone = want[r["doc_id"]][:2]
                assert (r["text"] is None) == (before[r["doc_id"]] is None)
                assert n - gone - 6 <= len((r["text"] or "").encode()) <= n - gone
                assert r["n_chars"] == len(r["text"] or "")
        else:
            assert set(after) == {r[0] for r in windows(before.items(), bench) if r[2] == 0}
            assert len(after) < len(before)
        before = after


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and set(corpus_pipeline.QUERIES) == {"pipeline"}


def write(spark, d, rows, ddl, labels, bench):
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")


def test_null_and_repeated_ids_and_clashing_columns(spark, texts, tmp_path):
    by = dict(texts)
    long = lambda k: by[k] + " " + by[k + 1]
    rows = [(1, by[408]), (1, by[408]), (1, long(3)), (None, long(5)), (None, long(5)), (2, long(7)), (3, long(7)), (4, None), (None, None), (5, ""), (6, by[406])]
    columns = ("token", "sig", "start", "key", "__row_hash", "n_words", "words")
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in columns)
    write(spark, tmp_path, [(i, t, "en", "s", len(t or ""), *(f"{c}{k}" for c in columns)) for k, (i, t) in enumerate(rows)], ddl, [(1, 1, 0), (None, 1, 1), (2, 1, None)], [(1, "never in any document at all"), (None, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        if name == "ngram_jaccard_join":
            # 3 is 2's copy; rows of one doc_id and rows without one stay
            assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows if i != 3)
        if name == "suffix_array_dedup":
            # of equal rows one keeps its text
            left = [r["text"] for r in got if r["doc_id"] is None and r["text"] is not None]
            assert sorted(map(len, left))[0] == 0 and max(left, key=len) == long(5)
            assert max((r["text"] for r in got if r["doc_id"] == 1), key=len) == by[408]
        if name != "sentencepiece":
            assert len({r["sig"] for r in got}) == len(got)
    assert len(got) == len(rows) - 1 and all(r["round_trip"] for r in got)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], "doc_id bigint, text string, lang string, source string, n_chars bigint", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
