"""A filtered log stored by game, so that later jobs read it without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.operators.ordering import BLOCK, ROWS_PER_BLOCK, key_sizes, rows_per_block
from anchorwake.operators.sequences import GAME, ORDER, split_games


def store_log(windowed: DataFrame, table: str, path: str | None = None, buckets: int | None = None, mode: str = "error") -> DataFrame:
    """Store a log as the Parquet table ``table``, bucketed by game and sorted as the jobs read it; returns the table.

    Windows and totals per game then run where the files are: ``jobs.facts_from_windowed(spark.table(table))``
    moves no row of the log. Games too large for one task are cut first, and their blocks
    are dealt to buckets of their own; the table then has the column ``_block``, which the jobs
    know. ``buckets`` are by default as many as keep a bucket within twice the rows of a block, or twice
    ``ROWS_PER_BLOCK`` where the session's blocks are smaller: a task works on one block at a time, so a bucket
    may hold many of them, and every bucket is a file and a task. The files lie under ``path``, or in the warehouse.
    """
    spark = windowed.sparkSession
    named = windowed.where(F.col(GAME).isNotNull()).drop(BLOCK)
    sizes = key_sizes(named, (GAME,))
    split = split_games(named, sizes=sizes)
    if buckets is None:
        rows = sizes.agg(F.sum("_rows")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / max(ROWS_PER_BLOCK, rows_per_block(spark))))
    keys = [GAME] if split is None else [GAME, BLOCK]
    placed = named if split is None else split.assign(named)
    # Dealt as the buckets are, so that each is one sorted file.
    writer = placed.repartition(buckets, *keys).write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *ORDER)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return spark.table(table)
