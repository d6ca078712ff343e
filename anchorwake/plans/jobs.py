"""The three jobs: window filter, zone report, and player reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.operators import outcomes, panels, pairing, ratings, registry, sequences
from anchorwake.sources import events as io
from anchorwake.sources.schema import complete_rows, incomplete_rows
from anchorwake.sources.settle import settle


class CheckedLog(NamedTuple):
    complete: DataFrame
    incomplete: DataFrame


def checked_log(events: DataFrame) -> CheckedLog:
    """Raw log to the rows the jobs can use, and the others to be looked at."""
    return CheckedLog(complete_rows(events), incomplete_rows(events))


def post_anchor_events(
    events: DataFrame, horizon: float = fixed.HORIZON_SECONDS, split="find"
) -> DataFrame:
    """Raw log to the events within the horizon of their anchor."""
    return sequences.window_after_anchor(sequences.attach_anchor(events, split), horizon)


def write_post_anchor_events(
    events: DataFrame, path: str, fmt: str = "csv", mode: str = "error", horizon: float = fixed.HORIZON_SECONDS, split="find"
) -> io.SequenceCounts:
    """Raw log to files with the events within the horizon of their anchor, and how many they are."""
    windowed = sequences.window_after_anchor(sequences.attach_in_blocks(events, split), horizon)
    return io.write_counted(windowed, path, fmt, mode)


def sequence_counts(windowed: DataFrame) -> DataFrame:
    """Events and sequences that the filter has kept, as one row."""
    return sequences.sequence_summary(windowed)


def session_facts(
    events: DataFrame, horizon: float = fixed.HORIZON_SECONDS, split="find"
) -> DataFrame:
    """Raw log to one row per physical anchor.

    Events are shuffled once, by game: the filter and the session numbers are
    windows over the same partitioning, and the totals are combined before they
    leave it. The log-wide sequence id is not needed here and not computed.
    """
    if split == "find":
        split = sequences.split_games(events)
    attached = sequences.attach_in_blocks(events, split, number=False)
    windowed = sequences.window_after_anchor(attached, horizon)
    return registry.anchor_facts(sequences.sessions_in_blocks(windowed, split))


def facts_from_windowed(windowed: DataFrame, split="find") -> DataFrame:
    """Stored filtered log to one row per physical anchor; the horizon is not applied again."""
    return registry.anchor_facts(sequences.sessions_in_blocks(windowed, split))


class ZoneReport(NamedTuple):
    scores: DataFrame
    zone_impact: DataFrame
    outcome_report: DataFrame
    control_total: DataFrame


def zone_report(windowed: DataFrame, loser_xg: str = "zero") -> ZoneReport:
    """Filtered log to the zone table, the outcome distribution and their check."""
    # Scores and check both start from here, so the events are gathered once.
    found = settle(outcomes.anchored_sequences(windowed))
    scores = outcomes.fis_scores(outcomes.paired_results(found, loser_xg))
    impact = outcomes.zone_impact(scores)
    pairs = pairing.pair_adjacent(found.select(*outcomes.SEQUENCE))
    check = outcomes.control_total(pairs, impact)
    return ZoneReport(scores, impact, outcomes.outcome_report(scores), check)


class Leaderboards(NamedTuple):
    leaderboard: DataFrame
    summary: DataFrame
    panel: DataFrame
    annotations: DataFrame


def leaderboards(
    facts: DataFrame, min_fo=fixed.MIN_PER_ZONE, k: int = fixed.PANEL_SIZE
) -> Leaderboards:
    """Anchor facts to the leaderboard of each zone and its chart tables."""
    # One row per player and zone; the participants themselves are never written.
    totals = settle(ratings.zone_totals(registry.participants_long(facts)))
    board = ratings.qualified(totals, min_fo)
    panel = panels.leaderboard_panel(board, k=k)
    return Leaderboards(
        board.orderBy("player_zone", F.desc("impact_score"), "playerid"),
        ratings.summary_of(totals, min_fo),
        panels.win_labels(panel),
        panels.panel_annotations(panel),
    )


class Ratings(NamedTuple):
    counts: DataFrame
    rated: DataFrame
    best: DataFrame
    worst: DataFrame
    correlation: DataFrame
    panel: DataFrame
    annotations: DataFrame
    outliers: DataFrame
    export: DataFrame


def rated_table(facts: DataFrame, min_fo: int = fixed.MIN_RATED) -> DataFrame:
    """One materialised row per player with enough anchors."""
    players = ratings.player_ratings(registry.participants_long(facts))
    return settle(ratings.rated_players(players, min_fo))


def rating_report(
    facts: DataFrame, min_fo: int = fixed.MIN_RATED, k: int = fixed.PANEL_SIZE
) -> Ratings:
    """Anchor facts to ratings, extremes, correlations and chart tables."""
    rated = rated_table(facts, min_fo)
    classified = ratings.classify_players(rated)
    best, worst = ratings.rating_extremes(rated, k)
    panel = panels.leaderboard_panel(classified, "FIS_per_fo", (), k, tail=True)
    return Ratings(
        ratings.rating_counts(facts, rated),
        classified,
        best,
        worst,
        ratings.rank_correlation(rated),
        panels.win_labels(panel, F.col("raw_win_rate") * 100),
        panels.panel_annotations(panel, "FIS_per_fo", ()),
        panels.outlier_labels(classified),
        ratings.ratings_export(classified),
    )
