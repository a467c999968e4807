"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the
columns of documents.  Rows with a null doc_id or text pass the filters unless their text itself decides; a stage that
finds nothing to do returns its rows as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import maybe_broadcast, stash, table
from treeloom.llm.decontaminate import phrase_hits
from treeloom.llm.ngram_join import jaccard_components
from treeloom.llm.pieces import encode_documents
from treeloom.llm.suffix_dedup import cut_repeats
from treeloom.llm.toxicity import fit, score_documents


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ``rejected`` (doc_id)."""
    ids = stash(rejected.select(F.col("doc_id").alias("__rejected")).distinct(), "rejected", 12)
    return docs.join(maybe_broadcast(ids), F.col("doc_id") == F.col("__rejected"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the grammar is fitted on labelled rows of these documents."""
    grammar = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_documents(docs, grammar, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word 5-grams at a similarity of 0.8 or more the smallest doc_id stays."""
    groups = jaccard_components(docs.select("doc_id", "text"), 5, 80, 100)
    return _without(docs, groups.where("doc_id <> component_id"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier are cut out of the texts, n_chars follows.

    A cut may fall inside a character; what is left of that character is dropped.
    """
    cut = cut_repeats(docs, 100)
    text = F.when(F.col("__had_text"), F.col("__text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word passage of the benchmark go."""
    hits = phrase_hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return _without(docs, hits.where("n_hit > 0"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (little-endian int32), their number, and whether they decode to the text."""
    coded = encode_documents(docs.select("doc_id", "text"))
    same = F.col("__decoded") == F.encode(F.translate(F.coalesce("text", F.lit("")), "▁", " "), "utf-8")
    return coded.select("doc_id", F.col("__ids").alias("ids"), (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs


#: No SQL: learned weights and token ids can't be expressed in it.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
