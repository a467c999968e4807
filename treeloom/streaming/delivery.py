"""File-source delivery: documents that arrive are parsed by the same stateless transform as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources.reader import parse_documents


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files of a folder as a stream (path, doc_id, text); doc_id is a hash of the path."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).withColumn("path", F.col("_metadata.file_path"))
    return files.select("path", F.xxhash64("path").alias("doc_id"), F.col("value").alias("text"))


def deliver(stream: DataFrame, out: str, checkpoint: str, resources: dict[str, str] | None = None):
    """Starts a query that appends nodes, annotations and diagnostics of each batch under ``out``; one commit a batch.

    A batch that is run again after a failure overwrites its own partition, so nothing comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        for name, df in parse_documents(batch, resources).items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
