"""Weights from tables: a lookup with a default, and the leverage of the player jobs from such tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.leverage import margin_weight
from anchorwake.functions.nulls import if_else

#: Rows of a table of weights up to which it is sent to every task.
BROADCAST_ROWS = 100_000


def with_lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    name: str,
    table_key: str | None = None,
    value: str = "weight",
    default: float | None = fixed.DEFAULT_WEIGHT,
) -> DataFrame:
    """Add ``name``: the ``value`` that ``table`` gives to ``key``, or ``default`` where it gives none.

    A missing key, a key that is not listed and a listed one without a value all get the
    default. The table must list a key once; otherwise an error names one that it does not. It is
    broadcast if it has at most ``BROADCAST_ROWS`` rows, which is counted; a larger one is joined by
    key, where Spark splits the partitions of frequent keys.
    """
    listed = table.select(F.col(table_key or key).alias("_listed"), F.col(value).alias("_value")).where("_listed IS NOT NULL")
    per_key = listed.groupBy("_listed").agg(F.count("*").alias("n"))
    rows, most, twice = per_key.agg(F.count("*"), F.max("n"), F.max_by("_listed", "n")).first()
    if rows and most > 1:
        raise ValueError(f"the table of weights lists {twice} more than once")
    small = rows <= BROADCAST_ROWS
    joined = df.join(F.broadcast(listed) if small else listed, F.col(key) == F.col("_listed"), "left")
    found = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return joined.withColumn(name, found).drop("_listed", "_value")


def with_leverage(
    facts: DataFrame,
    period_weights: DataFrame,
    strength_weights: DataFrame,
    name: str = "leverage",
    score_diff: str = "score_diff",
    period: str = "period",
    manpower: str = "manpower",
    x: str = "fo_x",
) -> DataFrame:
    """The leverage of ``leverage_lookup`` with the weights of periods and strengths from tables.

    The tables have the columns ``period`` or ``manpower``, and ``weight``. What they do not list
    has weight 1; the result is missing when margin or x is missing.
    """
    weighed = with_lookup(facts, period_weights, period, "_period_weight", "period")
    weighed = with_lookup(weighed, strength_weights, manpower, "_strength_weight", "manpower")
    zone: Column = if_else(F.abs(F.col(x)) > fixed.END_ZONE_X, fixed.END_ZONE_WEIGHT, fixed.DEFAULT_WEIGHT)
    leverage = margin_weight(F.col(score_diff)) * F.col("_period_weight") * F.col("_strength_weight") * zone
    return weighed.withColumn(name, leverage).drop("_period_weight", "_strength_weight")
