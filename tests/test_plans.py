"""The shape of the physical plans: what is shuffled, read and joined."""

import re

import pytest
from logs import random_log, frame

from anchorwake.operators import outcomes, ratings, registry, sequences
from anchorwake.plans import jobs
from anchorwake.sources.derived import derived_events


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events")
    frame(spark, random_log(11)).selectExpr("*", "'pad' AS unused").write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+\([^)]*\)|SinglePartition|RoundRobin\S*)", text)


def test_anchor_facts_shuffle_the_log_once(events):
    text = plan(jobs.session_facts(events, split=None))
    found = exchanges(text)
    assert len(found) == 1 and found[0].startswith("hashpartitioning(gameid")
    assert "Join" not in text and "Python" not in text
    assert "unused" not in text and "teaminpossession" not in text


def test_ratings_shuffle_players_after_the_log(events):
    text = plan(ratings.player_ratings(registry.participants_long(jobs.session_facts(events, split=None))))
    found = exchanges(text)
    assert len(found) == 2 and found[0].startswith("hashpartitioning(playerid")
    assert text.index("partial_count") > text.index("hashpartitioning(playerid")


def test_zone_scores_join_only_the_game_starts(events):
    windowed = jobs.post_anchor_events(events, split=None)
    text = plan(outcomes.fis_scores(outcomes.sequence_results(windowed)))
    by_game = [e for e in exchanges(text) if e.startswith("hashpartitioning(gameid")]
    assert len(by_game) <= 3  # the log, and the counts per game for the two levels of starts
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # The window filter sits below the join that numbers the sequences.
    join = min(text.index(j) for j in ("BroadcastHashJoin", "SortMergeJoin") if j in text)
    assert join < text.index("faceoff_time") or join < text.index("+ 10.0")


def test_size_check_reads_one_column(events, spark):
    sizes = events.where("gameid IS NOT NULL").groupBy("gameid").count()
    assert "ReadSchema: struct<gameid:int>" in plan(sizes)


def test_large_games_are_spread(spark, events, small_blocks):
    small_blocks(20)
    split = sequences.split_games(events)
    sessioned = sequences.sessions_in_blocks(
        sequences.window_after_anchor(sequences.attach_in_blocks(events, split, number=False)), split
    )
    assert "_block" in sessioned.columns
    text = plan(sessioned)
    by_block = re.findall(r"Exchange hashpartitioning\(gameid#\d+, _block#\d+", text)
    assert by_block
    # No window over a whole game, but for the table with one row per block.
    for window in re.findall(r"Window \[.*?\], \[(gameid#\d+[^\]]*)\], \[(\w+)", text):
        assert "_block" in window[0] or window[1] == "_block"


def test_large_games_cost_two_scans(spark, events, small_blocks):
    """Cut points and what crosses blocks are made before, so the result reads the log once and its tails once."""
    small_blocks(20)
    facts = jobs.session_facts(events)
    facts.collect()
    text = plan(facts)
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert len(re.findall(r"FileScan parquet", final)) <= 2
    # The other exchanges are of tables with one row per block.
    assert len(re.findall(r"Exchange hashpartitioning\(gameid#\d+, _block", final)) <= 2


def test_zone_report_gathers_events_once(spark, events):
    report = jobs.zone_report(jobs.post_anchor_events(events, split=None))
    for table in (report.scores, report.control_total, report.outcome_report):
        assert "FileScan" not in plan(table)


def test_top_k_is_limited_before_the_shuffle(spark, events):
    from anchorwake.operators import panels

    board = spark.range(1000).selectExpr(
        "'z' AS player_zone", "CAST(id AS INT) AS playerid", "id / 7 AS impact_score", "1.0D AS win_pct"
    )
    assert "WindowGroupLimit" in plan(panels.leaderboard_panel(board))
    rated = board.selectExpr("playerid", "1 AS total_faceoffs", "impact_score AS raw_win_rate",
                             "impact_score AS bayes_win_rate", "impact_score AS FIS_per_fo")
    for extreme in ratings.rating_extremes(rated):
        assert "TakeOrderedAndProject" in plan(extreme)


def test_derived_log_has_no_nested_loop(spark):
    text = plan(derived_events(spark, "/root/testdata/sf0.001"))
    assert "Join" not in text and not exchanges(text)
