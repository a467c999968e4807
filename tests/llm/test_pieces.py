import random

import numpy as np
import pytest

from treeloom.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def test_equals_the_library(vocabulary, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    odd = ["", None, " ", "  a  b ", "\t\n\0", "日本語 🙂 Ａ ▁x", "Ther" * 300, " " * 70 + "x" + " " * 33, "<s></s><unk> <0x41>"]
    odd += ["".join(rng.choice("ab the \n é▁日🙂") for _ in range(rng.randint(1, 90))) for _ in range(100)]
    odd += [t for _, t in texts]
    for t, ids in zip(odd, pieces.encode_rows(vocabulary, odd)):
        assert np.frombuffer(ids, np.int32).tolist() == model.encode(t or "")
        assert vocabulary.decode(ids) == (t or "").replace("▁", " ").encode()


def test_rows(spark, docs, nothing, texts):
    got = pieces.encode_documents(docs).collect()
    assert {r["doc_id"]: bytes(r["__decoded"]).decode() for r in got} == {i: t or "" for i, t in texts}
    assert pieces.encode_documents(nothing).count() == 0


def test_long_segments_and_memory(vocabulary, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    long = ["".join(rng.choice("therinawon日é🙂") for _ in range(n)) for n in (41, 50, 66, 67, 100, 500, 1500)]
    for t in [*long, *long[::-1], "word " * 30 + long[3]]:
        assert np.frombuffer(pieces.encode_rows(vocabulary, [t])[0], np.int32).tolist() == model.encode(t)


def test_repeated_rows_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "the same", "a"), (1, "the same", "b"), (None, "x" * 3000, "c"), (None, None, "d")], "doc_id bigint, text string, ids string")
    got = pieces.encode_documents(d).collect()
    assert sorted((r["ids"], bytes(r["__decoded"]).decode()) for r in got) == [("a", "the same"), ("b", "the same"), ("c", "x" * 3000), ("d", "")]
