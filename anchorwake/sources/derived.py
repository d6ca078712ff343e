"""An anchor log derived from the ``events`` table of the test data.

The test tables hold no such log, so every event becomes a log row by integer
arithmetic on its id and payload; a signup becomes an anchor with its two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAPS = {
    "period": "CASE WHEN row_pos % 23 = 3 THEN NULL WHEN row_pos % 29 = 4 THEN 5 ELSE period END",
    "teamid": "CASE WHEN row_pos % 19 <> 5 THEN teamid END",
    "xadjcoord": "CASE WHEN row_pos % 43 <> 10 THEN xadjcoord END",
    "scoredifferential": "CASE WHEN row_pos % 31 <> 7 THEN scoredifferential END",
    "manpowersituation": "CASE WHEN row_pos % 37 = 8 THEN 'fourOnFour' WHEN row_pos % 41 <> 9 THEN manpowersituation END",
}

_SOURCE = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``events`` table as an anchor log, 1,000 source events to a game."""
    source = spark.read.schema(_SOURCE).parquet(f"{sf_dir}/events.parquet")
    rows = source.selectExpr(
        "event_id",
        "value",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        "CAST(user_id % 40 AS INT) AS p",
        "event_type = 'purchase' AS attempt",
        "event_type = 'signup' AS anchor",
        "CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'carry' ELSE 'block' END AS other",
        "explode(CASE WHEN event_type = 'signup' THEN array(0, 1) ELSE array(0) END) AS side",
    )
    named = rows.selectExpr(
        "*",
        "event_id % 1000 * 4 + k % 6 AS t",
        "side = 0 AS first",
        "CASE WHEN anchor THEN 'faceoff' WHEN attempt AND k < 20 THEN 'goal' "
        "WHEN attempt THEN 'shot' ELSE other END AS eventname",
    )
    return named.selectExpr(
        "CAST(floor(event_id / 1000) AS INT) AS gameid",
        "CAST(t AS DOUBLE) AS compiledgametime",
        "CAST(floor(t / 1200) + 1 AS INT) AS period",
        "eventname",
        "CASE WHEN if(anchor, first, k % 2 = 0) THEN 'successful' ELSE 'failed' END AS outcome",
        "(p + side) % 2 + 1 AS teamid",
        "if(first, p, (p + 1 + 2 * (k % 20)) % 40) AS playerid",
        "CAST(CASE WHEN anchor OR k % 17 <> 0 THEN if(first, k * 2 - 99, 99 - k * 2) END AS DOUBLE) "
        "AS xadjcoord",
        "CASE WHEN k % 11 <> 0 THEN (p + k) % 2 + 1 END AS teaminpossession",
        "if(first, k % 5 - 2, 2 - k % 5) AS scoredifferential",
        "CASE k % 7 WHEN 0 THEN 'powerPlay' WHEN 1 THEN 'shortHanded' ELSE 'evenStrength' END "
        "AS manpowersituation",
        "CASE WHEN attempt AND k % 13 <> 0 THEN value / 1000 END AS xg_allattempts",
        "event_id * 2 + side AS row_pos",
    )


def with_gaps(events: DataFrame) -> DataFrame:
    """The log with missing values, a fifth period, an unknown strength and anchors of one row."""
    kept = events.where("NOT (eventname = 'faceoff' AND row_pos % 47 = 11)")
    return kept.selectExpr(*[f"{GAPS[c]} AS {c}" if c in GAPS else c for c in events.columns])


def with_long_ids(events: DataFrame) -> DataFrame:
    """The log with games numbered beyond INT."""
    return events.withColumn("gameid", events.gameid.cast("bigint") + 3_000_000_000)
