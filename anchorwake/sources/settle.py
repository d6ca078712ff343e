"""Materialise a table that several steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so that it is computed once and survives lost executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session may go without: it gets a temporary folder.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint()


def _ensure_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="anchorwake-checkpoint-")
    context.setCheckpointDir(folder)
