"""The zone report: what happened after each paired anchor, per team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.functions.leverage import leverage_case, leverage_weights
from anchorwake.functions.nulls import if_else, strict_mean, sum_or_zero
from anchorwake.functions.zones import movement
from anchorwake.operators.pairing import pair_adjacent, with_zones
from anchorwake.operators.sequences import GAME, ORDER, is_anchor

SEQUENCE = (GAME, "faceoff_sequence_id")
CONTEXT = (
    "teamid", "xadjcoord", "period", "scoredifferential", "manpowersituation", "outcome",
)
FLAGS = (
    "i_made_goal", "opp_made_goal", "i_made_shot", "opp_made_shot",
    "i_attempt_shot", "opp_attempt_shot",
)
FACT_COLUMNS = (
    *SEQUENCE, "teamid", "my_zon", "my_role", "zone_type", *FLAGS,
    "final_x", "last_possession_team", "period", "score_diff", "manpower", "outcome_val",
)


def anchored_sequences(windowed: DataFrame) -> DataFrame:
    """One row per sequence whose anchor is in the log: anchor, last event, what each team did.

    An anchor may be filtered out while its events stay, for example if its period is
    missing; such a sequence is in no registry.

    The first grouping sees every event and is combined before the shuffle; it
    leaves one row per team of a sequence, which the second one gathers.
    """
    name, good = F.col("eventname"), F.col("outcome") == fixed.WON
    shot, goal = name == fixed.SHOT_EVENT, name == fixed.GOAL_EVENT
    teams = windowed.groupBy(*SEQUENCE, F.col("teamid").alias("team")).agg(
        F.bool_or(goal & good).alias("goal"),
        F.bool_or(shot & good).alias("shot"),
        F.bool_or(shot).alias("try"),
        F.count_if(shot | goal).alias("attempts"),
        sum_or_zero(F.when(shot | goal, F.col("xg_allattempts"))).alias("xg"),
        F.min(F.when(is_anchor(), F.struct(*ORDER, *CONTEXT))).alias("_anchor"),
        F.max(F.struct(*ORDER, "xadjcoord", "teaminpossession")).alias("_last"),
    )
    return teams.groupBy(*SEQUENCE).agg(
        F.min("_anchor").alias("_anchor"),
        F.max("_last").alias("_last"),
        F.collect_list(F.struct("team", "goal", "shot", "try", "attempts", "xg")).alias("_teams"),
    ).where("_anchor IS NOT NULL")


def sequence_results(windowed: DataFrame, loser_xg: str = "zero") -> DataFrame:
    """Facts and expected goals per paired anchor row, from one pass over the events (see ``paired_results``)."""
    return paired_results(anchored_sequences(windowed), loser_xg)


def paired_results(sequences: DataFrame, loser_xg: str = "zero") -> DataFrame:
    """Facts and expected goals per paired anchor row, from ``anchored_sequences``.

    With ``loser_xg="zero"`` the rows of the losing team have no expected goals
    on either side, so only winners score. ``"mirrored"`` gives them the same
    two sums as their opponent.
    """
    if loser_xg not in ("zero", "mirrored"):
        raise ValueError("loser_xg is 'zero' or 'mirrored'")
    pairs = pair_adjacent(sequences, from_joined=("_last", "_teams"))
    rows = with_zones(pairs.select(*SEQUENCE, "_anchor.*", "_last", "_teams"))
    teams, me = F.col("_teams"), F.col("teamid")

    def total(which) -> Column:
        return F.aggregate(
            teams, F.lit(0.0), lambda so_far, t: so_far + F.when(which(t), t["xg"]).otherwise(0.0)
        )

    def any_team(which, did: str) -> Column:
        return F.exists(teams, lambda t: which(t) & t[did])

    def mine(t):
        return t["team"] == me

    def theirs(t):
        return t["team"] != me

    won, lost = F.col("outcome") == fixed.WON, F.col("outcome") == fixed.LOST
    winner = F.when(won, total(mine))
    loser = F.when(won, total(theirs))
    if loser_xg == "mirrored":
        winner, loser = winner.when(lost, total(theirs)), loser.when(lost, total(mine))
    kinds = {"made_goal": "goal", "made_shot": "shot", "attempt_shot": "try"}
    flags = [
        any_team(side, did).alias(f"{who}_{kind}")
        for kind, did in kinds.items()
        for who, side in (("i", mine), ("opp", theirs))
    ]
    return rows.select(
        *SEQUENCE, "teamid", "my_zon", "my_role", "zone_type",
        *flags,
        F.col("_last.xadjcoord").alias("final_x"),
        F.col("_last.teaminpossession").alias("last_possession_team"),
        "period",
        F.col("scoredifferential").alias("score_diff"),
        F.col("manpowersituation").alias("manpower"),
        F.col("outcome").alias("outcome_val"),
        F.exists(teams, lambda t: t["attempts"] > 0).alias("has_attempt"),
        winner.otherwise(0.0).alias("xg_winner"),
        loser.otherwise(0.0).alias("xg_loser"),
    )


def sequence_xg(windowed: DataFrame, loser_xg: str = "zero") -> DataFrame:
    """Expected goals per registry row that was followed by a shot or goal."""
    results = sequence_results(windowed, loser_xg).where("has_attempt")
    return results.select(*SEQUENCE, "xg_winner", "xg_loser")


def sequence_facts(windowed: DataFrame) -> DataFrame:
    """Six event flags, the final state and the context per registry row."""
    return sequence_results(windowed).select(*FACT_COLUMNS)


def classify_outcome(facts: DataFrame) -> DataFrame:
    """Label each sequence by the first that applies: goals, shots, attempts, possession."""
    holder = F.col("last_possession_team")
    kinds = (
        ("i_made_goal", fixed.GOAL_FOR),
        ("opp_made_goal", fixed.GOAL_AGAINST),
        ("i_made_shot", fixed.SHOT_FOR),
        ("opp_made_shot", fixed.SHOT_AGAINST),
        ("i_attempt_shot", fixed.ATTEMPT_FOR),
        ("opp_attempt_shot", fixed.ATTEMPT_AGAINST),
    )
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for flag, text in kinds:
        label = label.when(F.col(flag), text)
    for place, with_puck, without in fixed.POSSESSION_LABELS:
        there = F.col("movement") == place
        label = label.when(F.col("i_have_puck") & there, with_puck)
        label = label.when(~F.col("i_have_puck") & there, without)
    return facts.withColumns(
        {
            "i_have_puck": F.when(holder.isNull(), False).otherwise(holder == F.col("teamid")),
            "movement": movement(F.col("final_x")),
        }
    ).withColumn("total_utfall", label.otherwise(fixed.UNDEFINED_OUTCOME))


def fis_scores(results: DataFrame) -> DataFrame:
    """Reward (expected goals for minus against) times leverage per registry row."""
    winner, loser = F.col("xg_winner"), F.col("xg_loser")
    reward = if_else(F.col("outcome_val") == fixed.WON, winner - loser, loser - winner)
    context = F.col("score_diff"), F.col("period"), F.col("manpower"), F.col("zone_type")
    scored = classify_outcome(results).withColumns({"reward": reward, **leverage_weights(*context)})
    return scored.withColumn("leverage", leverage_case(*context)).withColumn(
        "fis_score", F.col("reward") * F.col("leverage")
    )


def zone_impact(scores: DataFrame) -> DataFrame:
    """Mean score and number of physical anchors per zone."""
    return scores.groupBy("my_zon").agg(
        F.round(strict_mean(F.col("fis_score")), 4).alias("Avg_FIS"),
        (F.count("*") / 2).alias("Antal_Fysiska_Tekningar"),
    )


def outcome_report(scores: DataFrame) -> DataFrame:
    """Count and share of each outcome within zone and role, sorted."""
    counts = scores.groupBy("my_zon", "my_role", "total_utfall").agg(
        F.count("*").alias("Antal_Tekningar")
    )
    n = F.col("Antal_Tekningar")
    share = n / F.sum(n).over(Window.partitionBy("my_zon", "my_role")) * 100
    return counts.withColumn("Procent", F.round(share, 2)).orderBy(
        "my_zon", F.col("my_role").asc_nulls_last(), "total_utfall"
    )


def control_total(registry: DataFrame, impact: DataFrame) -> DataFrame:
    """One row that checks the zone table against the registry."""
    expected = registry.agg(F.count("*") / 2).scalar()
    actual = impact.agg(sum_or_zero(F.col("Antal_Fysiska_Tekningar")).alias("actual"))
    return actual.withColumn("expected", expected).withColumn(
        "ok", F.col("actual") == F.col("expected")
    )
