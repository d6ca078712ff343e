"""Physical anchors: who met, what followed for each side, and per participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.leverage import leverage_lookup
from anchorwake.functions.nulls import sum_or_zero
from anchorwake.functions.zones import mirror_zone, start_zone, winner_zone, zone_level
from anchorwake.operators.sequences import GAME, ORDER, is_anchor

SESSION = (GAME, "physical_faceoff_id")
REGISTRY_COLUMNS = (
    GAME, "physical_faceoff_id", "winner_team", "loser_team", "winner_player", "loser_player",
    "fo_x", "period", "score_diff", "manpower", "leverage", "fo_zone_winner", "fo_zone",
)


def _first(condition: Column, *values: str) -> Column:
    """The values of the first row in game order that meets the condition."""
    return F.min(F.when(condition, F.struct(*ORDER, *values)))


def _by_team(sessioned: DataFrame) -> DataFrame:
    """Totals per physical anchor and team, combined before the shuffle.

    This is the only step that sees every event, and its result has about two
    rows per anchor however many events one anchor has.
    """
    other = F.col("eventname") != fixed.ANCHOR_EVENT
    return sessioned.groupBy(*SESSION, "teamid").agg(
        _first(is_anchor(), "period", "scoredifferential", "manpowersituation").alias("_context"),
        _first(
            is_anchor() & (F.col("outcome") == fixed.WON), "teamid", "playerid", "xadjcoord"
        ).alias("_winner"),
        _first(is_anchor() & (F.col("outcome") == fixed.LOST), "teamid", "playerid").alias("_loser"),
        sum_or_zero(
            F.when(F.col("eventname").isin(*fixed.ATTEMPT_EVENTS), F.col("xg_allattempts"))
        ).alias("_xg"),
        F.max(F.when(other, F.col("xadjcoord"))).alias("_reach"),
    )


def anchor_facts(sessioned: DataFrame) -> DataFrame:
    """Registry, expected goals and territory per physical anchor, in one pass.

    An anchor needs a team on both sides. Expected goals of a team that is both
    winner and loser (a mixed pair) count for the winner only.
    """
    whole = Window.partitionBy(*SESSION)
    teams = _by_team(sessioned).withColumns(
        {c: F.min(c).over(whole) for c in ("_context", "_winner", "_loser")}
    )
    teams = teams.where("_winner.teamid IS NOT NULL AND _loser.teamid IS NOT NULL")
    won = F.col("teamid") == F.col("_winner.teamid")
    lost = F.col("teamid") == F.col("_loser.teamid")

    def reach(side: Column) -> Column:
        return F.greatest(F.lit(fixed.REACH_FLOOR), F.max(F.when(side, F.col("_reach"))))

    facts = teams.groupBy(*SESSION).agg(
        F.first("_context").alias("_context"),
        F.first("_winner").alias("_winner"),
        F.first("_loser").alias("_loser"),
        sum_or_zero(F.when(won, F.col("_xg"))).alias("xg_winner"),
        sum_or_zero(F.when(lost & ~won, F.col("_xg"))).alias("xg_loser"),
        reach(won).alias("max_x_winner"),
        reach(lost).alias("max_x_loser"),
    )
    facts = facts.select(
        *SESSION,
        F.col("_winner.teamid").alias("winner_team"),
        F.col("_loser.teamid").alias("loser_team"),
        F.col("_winner.playerid").alias("winner_player"),
        F.col("_loser.playerid").alias("loser_player"),
        F.col("_winner.xadjcoord").alias("fo_x"),
        F.col("_context.period").alias("period"),
        F.col("_context.scoredifferential").alias("score_diff"),
        F.col("_context.manpowersituation").alias("manpower"),
        "xg_winner", "xg_loser", "max_x_winner", "max_x_loser",
    )
    x = F.col("fo_x")
    return facts.withColumns(
        {
            "leverage": leverage_lookup(
                F.col("score_diff"), F.col("period"), F.col("manpower"), x
            ),
            "fo_zone_winner": winner_zone(x),
            "fo_zone": start_zone(x),
            # The loser starts from the mirror image of the winner's spot.
            "terr_winner": zone_level(F.col("max_x_winner")) - zone_level(x),
            "terr_loser": zone_level(F.col("max_x_loser")) - zone_level(-x),
        }
    )


def anchor_registry(sessioned: DataFrame) -> DataFrame:
    """One row per physical anchor with both participants and its context."""
    return anchor_facts(sessioned.where(is_anchor())).select(*REGISTRY_COLUMNS)


def xg_by_side(sessioned: DataFrame) -> DataFrame:
    """The registry with expected goals of the winning and the losing team."""
    return anchor_facts(sessioned).select(*REGISTRY_COLUMNS, "xg_winner", "xg_loser")


def territorial_delta(sessioned: DataFrame) -> DataFrame:
    """The registry with the furthest x per side and the zone levels gained."""
    return anchor_facts(sessioned).select(
        *REGISTRY_COLUMNS, "max_x_winner", "max_x_loser", "terr_winner", "terr_loser"
    )


def participants_long(facts: DataFrame) -> DataFrame:
    """One row per participant of each anchor, seen from that participant's side."""

    def side(player, won, zone, xg_for, xg_against, territory):
        return F.struct(
            F.col(player).alias("playerid"),
            F.lit(won).alias("won"),
            zone.alias("player_zone"),
            F.col(xg_for).alias("xg_for"),
            F.col(xg_against).alias("xg_against"),
            F.col(territory).alias("terr_delta"),
        )

    zone = F.col("fo_zone_winner")
    sides = F.array(
        side("winner_player", True, zone, "xg_winner", "xg_loser", "terr_winner"),
        side("loser_player", False, mirror_zone(zone), "xg_loser", "xg_winner", "terr_loser"),
    )
    return facts.select("leverage", F.explode(sides).alias("_side")).select(
        "_side.playerid", "_side.won", "leverage", "_side.player_zone",
        "_side.xg_for", "_side.xg_against", "_side.terr_delta",
    )
