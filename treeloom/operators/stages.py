"""Cutting the lineage of iterative plans in the folder that the session's executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the session's own, a temporary one only in a local session that names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="treeloom-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and read from the shared folder from here on; survives lost executors."""
    _folder(df.sparkSession)
    return df.checkpoint()
