import hashlib
import tempfile

import numpy as np
import pytest

from treeloom.llm import induced_sort, suffix_dedup
from treeloom.llm.suffix_dedup import cut_repeats


def brute(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in seen:
                m[p : p + size] = b"\1" * size
            seen.add(w)
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out[i] = (len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    return out


def run(docs):
    rows = cut_repeats(docs, 100).collect()
    return {r["doc_id"]: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], hashlib.sha256(bytes(r["__kept"])).hexdigest()) for r in rows}


def test_matches_brute_force(docs, texts):
    assert run(docs) == brute(texts)


def test_hot_anchors_are_split(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert run(docs) == brute(texts)


def test_empty(nothing, spark):
    assert run(nothing) == {}
    got = cut_repeats(spark.createDataFrame([(None, "a" * 300), (1, "a" * 150), (2, None)], "doc_id bigint, text string"), 100).collect()
    assert {r["doc_id"]: r["__n_removed"] for r in got} == {None: 299, 1: 150, 2: 0}


def test_rows_of_one_id_are_judged_apart(spark):
    a, b, c = ("".join(f"{w}{k * n} " for k in range(60)) for w, n in (("a", 1), ("b", 7), ("c", 13)))
    rows = [(1, a), (1, a), (1, b), (1, b[:150] + c), (2, b), (None, c), (None, c[20:200] + "end"), (None, c), (-(2**63), "other " + b[50:]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, f"x{k}") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, extra string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = sorted((repr(order[k][0]), *v) for k, v in brute([(k, t) for k, (_, t) in enumerate(order)]).items())
    out = cut_repeats(docs, 100).collect()
    assert sorted((repr(r["doc_id"]), r["__n_bytes"], r["__n_removed"], r["__n_spans"], hashlib.sha256(bytes(r["__kept"])).hexdigest()) for r in out) == want
    assert {r["extra"] for r in out} == {f"x{k}" for k in range(len(rows))}


@pytest.mark.parametrize("in_memory", [1, 1000])
def test_external_sort(in_memory, monkeypatch):
    rng = np.random.default_rng(2)
    for trial in range(60):
        n, s = int(rng.integers(1, 90)), int(rng.integers(1, 5))
        t = rng.integers(0, s, n).astype(np.int32)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, n // 6)], 6)[:n]
        monkeypatch.setattr(induced_sort, "BLOCK", int(rng.integers(1, 9)))
        monkeypatch.setattr(induced_sort, "QUEUED", int(rng.integers(1, 20)))
        with tempfile.TemporaryDirectory() as f:
            out = list(induced_sort.sort_suffixes(t, f, 8, 0, in_memory))
        text, n = t.tolist(), len(t)
        order = sorted(range(n), key=lambda i: text[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while k < 8 and a + k < n and b + k < n and text[a + k] == text[b + k]:
                k += 1
            common.append(k)
        assert np.concatenate([a for a, _ in out]).tolist() == order
        assert np.concatenate([b for _, b in out]).tolist() == common
