"""The two anchor rows of a zone-report sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.functions.zones import role, zone5, zone_type
from anchorwake.operators.sequences import GAME, is_anchor

RANGE_BITS = 16  # 65,536 ids to a range


def pair_adjacent(anchors: DataFrame, from_joined: Sequence[str] = ()) -> DataFrame:
    """Keep anchors whose join id is shared by exactly two rows of the game.

    An anchor's join id is its own id plus one if that is the next anchor's id,
    else its own. So only the last two of a run of consecutive ids stay, and
    that depends on ids at most two away. The work is split into ranges of ids;
    rows near the edge of a range are copied to the neighbouring one, which
    keeps every window small even when one game holds most anchors.

    Columns in ``from_joined`` are taken from the row that has the join id.
    """
    sid = F.col("faceoff_sequence_id")
    own = F.shiftright(sid, RANGE_BITS)
    reaches = F.array(*[F.shiftright(sid + d, RANGE_BITS) for d in (-2, -1, 0, 1)])
    rows = anchors.withColumn("_range", F.explode(F.array_distinct(reaches)))
    ordered = Window.partitionBy(GAME, "_range").orderBy("faceoff_sequence_id")

    def holds(neighbour, distance):
        return F.coalesce(neighbour == sid + distance, F.lit(False))

    rows = rows.withColumns(
        {
            "_next": holds(F.lead(sid).over(ordered), 1),
            "_next2": holds(F.lead(sid, 2).over(ordered), 2),
            "_prev": holds(F.lag(sid).over(ordered), -1),
            **{f"_next_{c}": F.lead(c).over(ordered) for c in from_joined},
        }
    )
    follows = F.col("_next")
    two_rows = F.when(follows, ~F.col("_next2")).otherwise(F.col("_prev"))
    joined = {c: F.when(follows, F.col(f"_next_{c}")).otherwise(F.col(c)) for c in from_joined}
    return (
        rows.where((F.col("_range") == own) & two_rows)
        .withColumns({"join_id": F.when(follows, sid + 1).otherwise(sid), **joined})
        .select(*anchors.columns, "join_id")
    )


def with_zones(anchors: DataFrame) -> DataFrame:
    """Add the acting team's zone, role and zone type to anchor rows."""
    x = F.col("xadjcoord")
    zoned = anchors.withColumns({"my_zon": zone5(x), "zone_type": zone_type(x)})
    return zoned.withColumn("my_role", role(F.col("my_zon"), F.col("outcome")))


def paired_registry(windowed: DataFrame) -> DataFrame:
    """One row per team and paired anchor, with its zone, role and context."""
    anchors = windowed.where(is_anchor()).select(
        GAME, "faceoff_sequence_id", "teamid", "xadjcoord", "period",
        "scoredifferential", "manpowersituation", "outcome",
    )
    return with_zones(pair_adjacent(anchors)).select(
        GAME, "faceoff_sequence_id", "join_id", "teamid", "my_zon", "my_role", "zone_type",
        "period", "scoredifferential", "manpowersituation", "outcome",
    )
