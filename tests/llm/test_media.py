import glob
import hashlib
import os
import zlib

import numpy as np

from treeloom.llm import media


def test_png_round_trip():
    for n in (0, 1, 192, 5000):
        raw, size = media.payload("x" * n)
        assert size == n and len(raw) % 192 == 0 and raw
        assert media.decode_png(media.encode_png(raw)).tobytes() == raw


def test_features(spark, docs, texts, nothing):
    got = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["error"] is None and r["media_bytes"] == len(media.encode_png(p))
    assert media.media_features(nothing).count() == 0


def test_ranges_and_damage(spark, tmp_path):
    d = spark.createDataFrame([(k, "text %d " % k * 50) for k in range(40)], "doc_id bigint, text string").coalesce(1)
    folder = f"file://{tmp_path}/a"
    listed = media.write_archives(d, folder).collect()
    assert sum(r["members"] for r in listed) == 40
    for size in (100, 1000, 1 << 20):
        rows = media.read_archives(spark, folder, rangebytes=str(size)).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(40))
    rows = {r["doc_id"]: r for r in media.read_archives(spark, folder).collect()}
    path = glob.glob(f"{tmp_path}/a/*.zip")[0]
    with open(path, "r+b") as f:
        f.seek(rows[7]["offset"] + 80)
        f.write(b"\xff\xff\xff\xff")
    again = {r["doc_id"]: r for r in media.read_archives(spark, folder, attempts="2").collect()}
    assert again[7]["media"] is None and again[7]["error"]
    assert all(again[k]["error"] is None for k in range(40) if k != 7)
    assert os.path.getsize(path)


def test_feature_is_a_function_of_the_payload():
    a = np.arange(192 * 5, dtype=np.uint8).reshape(5, 192)
    assert media.feature(a) == media.feature(a.copy())
