"""Tables that several steps read, written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anchorwake.sources import settle


_written: list[str] = []


def stored(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it again.

    Of large rows, ``rows_per_file`` limits those that are gathered while a file is written or read. This cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    _written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def stored_alone(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """Store the table that ``make`` returns, and delete those that were stored on the way to it."""
    before = len(_written)
    table = stored(make())
    for path in _written[before:-1]:
        _delete(spark, path)
    del _written[before:-1]
    return table


def _folder(spark: SparkSession) -> str:
    settle._ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables"


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    _delete(table.sparkSession, table._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
