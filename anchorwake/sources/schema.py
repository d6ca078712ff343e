"""The event log: columns, missing values and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("gameid", T.IntegerType()),
        T.StructField("compiledgametime", T.DoubleType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("eventname", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("teamid", T.IntegerType()),
        T.StructField("playerid", T.IntegerType()),
        T.StructField("xadjcoord", T.DoubleType()),
        T.StructField("teaminpossession", T.IntegerType()),
        T.StructField("scoredifferential", T.IntegerType()),
        T.StructField("manpowersituation", T.StringType()),
        T.StructField("xg_allattempts", T.DoubleType()),
    ]
)
# Added by the window filter, and by the reader where the log has no order column.
SEQUENCE = T.StructType(
    [
        T.StructField("faceoff_sequence_id", T.LongType()),
        T.StructField("faceoff_time", T.DoubleType()),
    ]
)
REQUIRED = ("gameid", "compiledgametime", "eventname")
# Identifiers: any type that sorts; the readers take them as BIGINT unless told otherwise.
IDS = ("gameid", "teamid", "playerid", "teaminpossession")
# Columns that the jobs cannot do without.
NEEDED = (*EVENTS.fieldNames(),)


def check_columns(events: DataFrame) -> DataFrame:
    """``events`` as it is; an error names the columns that are not there."""
    absent = [c for c in NEEDED if c not in events.columns]
    if absent:
        raise ValueError(f"the log has no column {', '.join(absent)}")
    return events


def _incomplete() -> Column:
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.col(name).isNull()
    anchor = F.coalesce(F.col("eventname") == "faceoff", F.lit(False))
    return missing | (anchor & F.col("outcome").isNull())


def complete() -> Column:
    """Whether a row has a game, a time and an event name, and an outcome if it is an anchor."""
    return ~_incomplete()


def complete_rows(events: DataFrame) -> DataFrame:
    """Rows with a game, a time and an event name, and an outcome on every anchor."""
    return events.where(complete())


def incomplete_rows(events: DataFrame) -> DataFrame:
    """The other rows, to be kept aside and looked at."""
    return events.where(_incomplete())
