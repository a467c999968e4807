"""Queries over the operators of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import masked_lm
from treeloom.llm.chat import format_conversations
from treeloom.llm.common import table
from treeloom.llm.decontaminate import phrase_hits
from treeloom.llm.language import identify_languages
from treeloom.llm.licenses import scan_licenses
from treeloom.llm.media import media_features
from treeloom.llm.ngram_join import jaccard_components
from treeloom.llm.pieces import encode_documents
from treeloom.llm.suffix_dedup import cut_repeats
from treeloom.llm.toxicity import fit, score_documents


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = phrase_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS phrase
  FROM b, LATERAL (SELECT unnest(range(0, greatest(len(w) - 9, 1))) AS s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, pos.n, s FROM pos JOIN win ON pos.phrase = win.phrase AND pos.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"), (F.col("__decoded") == F.encode(F.translate(F.coalesce("text", F.lit("")), "\u2581", " "), "utf-8")).alias("round_trip"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(docs, 100)
    return cut.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score(docs, masked_lm.fit(docs))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT n.doc_id, coalesce(last, 0), n FROM n LEFT JOIN (SELECT doc_id, max(b) AS last FROM runs GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id) USING (doc_id)
"""

_OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, label FROM r JOIN both_ ON r.doc_id = x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(label) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (op1_media_columns, op2_benchmark_decontamination, op3_language_id, op4_sentencepiece, op5_suffix_array_dedup, op6_chat_formatting, op7_license_scan, op8_toxicity, op9_lm_scoring, op10_ngram_jaccard_join)
}
ORACLE: dict[str, str] = {"op2_benchmark_decontamination": _OP2_SQL, "op5_suffix_array_dedup": _OP5_SQL, "op10_ngram_jaccard_join": _OP10_SQL}
