import pytest
from pyspark.sql import functions as F
from logs import attach, event, frame, pairs, random_log, sessions, tiny, window

from anchorwake.operators import pairing, sequences
from anchorwake.operators.ordering import BLOCK, find_split, key_sizes, starts_by_key
from anchorwake.plans import jobs
from anchorwake.sources.settle import settle


def by_row(df, *names):
    return {r["row_pos"]: tuple(r[n] for n in names) for r in df.collect()}


def test_tiny_window(spark):
    kept = by_row(jobs.post_anchor_events(frame(spark, tiny())), "faceoff_sequence_id")
    assert {k: v[0] for k, v in kept.items()} == {
        0: 0, 1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6, 9: 9, 10: 10, 11: 11, 12: 12,
    }


def test_summary(spark):
    row = sequences.sequence_summary(jobs.post_anchor_events(frame(spark, tiny()))).first()
    assert (row.n_events, row.n_sequences) == (11, 8)


def test_tiny_sessions(spark):
    sessioned = sequences.anchor_sessions(jobs.post_anchor_events(frame(spark, tiny())))
    got = {k: v[0] for k, v in by_row(sessioned, "physical_faceoff_id").items()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 5: 2, 6: 2, 7: 2, 9: 3, 10: 3, 11: 4, 12: 4}


def test_event_at_the_same_time_before_an_anchor_merges_it(spark):
    rows = [
        event(0, 0, "faceoff"), event(1, 5, "pass"), event(2, 5, "faceoff"), event(3, 6, "faceoff"),
    ]
    sessioned = sequences.anchor_sessions(jobs.post_anchor_events(frame(spark, rows)))
    assert [v[0] for _, v in sorted(by_row(sessioned, "physical_faceoff_id").items())] == [1, 1, 1, 2]


def test_anchor_without_period_keeps_the_period_before(spark):
    rows = [event(0, 0, "faceoff", period=1), event(1, 5, "faceoff", period=None), event(2, 6, "pass")]
    got = by_row(sequences.attach_anchor(frame(spark, rows)), "faceoff_sequence_id", "faceoff_period")
    assert got == {0: (0, 1), 1: (1, 1), 2: (1, 1)}
    assert set(by_row(jobs.post_anchor_events(frame(spark, rows)), "period")) == {0, 2}


def test_missing_times_sort_last_and_count_in_the_numbering(spark):
    rows = [
        event(0, None, "faceoff"), event(1, 3, "faceoff"), event(2, None, "pass"),
        event(3, 1, "faceoff", game=2), event(4, 1, "faceoff", game=None),
    ]
    got = by_row(sequences.attach_anchor(frame(spark, rows)), "faceoff_sequence_id", "faceoff_time")
    assert got == {1: (0, 3.0), 0: (1, 3.0), 2: (1, 3.0), 3: (3, 1.0)}


@pytest.mark.parametrize("rows_per_block", [None, 9])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_walking_the_log(spark, small_blocks, seed, rows_per_block):
    log = random_log(seed)
    expected = attach(log)
    kept = window(expected)
    if rows_per_block:
        small_blocks(rows_per_block)
    events = frame(spark, log).repartition(5)
    names = ("faceoff_sequence_id", "faceoff_time", "faceoff_period")
    attached = settle(sequences.attach_anchor(events))
    assert attached.columns == [*events.columns, *names]
    assert by_row(attached, *names) == {r["row_pos"]: tuple(r[n] for n in names) for r in expected}
    windowed = settle(sequences.window_after_anchor(attached))
    assert set(by_row(windowed, "period")) == {r["row_pos"] for r in kept}
    found = by_row(sequences.anchor_sessions(windowed), "physical_faceoff_id")
    assert {k: v[0] for k, v in found.items()} == sessions(kept)
    blocked = sequences.window_after_anchor(sequences.attach_in_blocks(events))
    assert (BLOCK in blocked.columns) == (rows_per_block is not None)
    found = by_row(sequences.anchor_sessions(blocked), "physical_faceoff_id")
    assert {k: v[0] for k, v in found.items()} == sessions(kept)
    joined = pairing.paired_registry(windowed).collect()
    assert {r.faceoff_sequence_id: r.join_id for r in joined} == pairs(kept)


def test_one_instant_may_hold_everything(spark, small_blocks):
    small_blocks(20)
    rows = [event(i, 7, "faceoff" if i % 50 == 0 else "pass") for i in range(300)]
    split = sequences.split_games(frame(spark, rows))
    sizes = [r["count"] for r in split.assign(frame(spark, rows)).groupBy(BLOCK).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 100
    got = by_row(sequences.anchor_sessions(jobs.post_anchor_events(frame(spark, rows))), "faceoff_sequence_id", "physical_faceoff_id")
    assert got == {i: (i // 50 * 50, 1) for i in range(300)}


def test_blocks_follow_the_order(spark, small_blocks):
    small_blocks(25)
    events = frame(spark, random_log(9, size=400))
    placed = sequences.split_games(events).assign(events).where("gameid = 70000").collect()
    placed.sort(key=lambda r: (r.compiledgametime, r.row_pos))
    blocks = [r[BLOCK] for r in placed]
    assert blocks == sorted(blocks) and blocks[0] == 1 and blocks[-1] > 5


def test_no_split_when_games_are_small(spark):
    events = frame(spark, random_log(3))
    assert sequences.split_games(events) is None
    assert find_split(events.limit(0), ("gameid",), ("row_pos",)) is None


def test_starts_by_key_in_blocks_and_with_negative_keys(spark, small_blocks):
    keys = [-70_000, -1, 0, 0, 65_535, 65_536, 65_536, 200_000]
    df = spark.createDataFrame([(k,) for k in keys], "gameid int")
    expected = {-70_000: 0, -1: 1, 0: 2, 65_535: 4, 65_536: 5, 200_000: 7}
    for rows_per_block in (None, 2):
        if rows_per_block:
            small_blocks(rows_per_block)
        got = {r.gameid: r._start for r in starts_by_key(key_sizes(df, ("gameid",)), "gameid").collect()}
        assert got == expected


@pytest.mark.parametrize("rows_per_block", [None, 9])
@pytest.mark.parametrize("change", ["CAST(gameid AS BIGINT) + 3000000000", "concat('g', lpad(gameid, 9, '0'))"])
def test_ids_of_any_type(spark, small_blocks, change, rows_per_block):
    """BIGINT and text games give the rows and numbers of INT games in the same order."""
    events = frame(spark, random_log(4))
    expected = by_row(jobs.post_anchor_events(events), "faceoff_sequence_id", "faceoff_time")
    facts = sorted(tuple(r)[1:] for r in jobs.session_facts(events).drop("gameid").collect())
    if rows_per_block:
        small_blocks(rows_per_block)
    other = events.withColumns({"gameid": F.expr(change), "teamid": F.expr("concat('T', teamid)")})
    assert by_row(jobs.post_anchor_events(other), "faceoff_sequence_id", "faceoff_time") == expected
    assert jobs.session_facts(other).count() == len(facts)


@pytest.mark.parametrize("rows_per_block", [4, 20])
def test_missing_times_in_blocks(spark, small_blocks, rows_per_block):
    """Sessions do not depend on where a game is cut, also between rows without a time."""
    rows = [event(i, i if i < 6 else None, "faceoff") for i in range(24)]
    rows += [event(100 + i, i // 3 if i % 4 else None, "faceoff" if i % 3 else "pass", game=2) for i in range(40)]
    events = frame(spark, rows)
    whole, attached = (by_row(f(events), *n) for f, n in ((sequences.anchor_sessions, ["physical_faceoff_id"]), (sequences.attach_anchor, ["faceoff_sequence_id", "faceoff_time"])))
    columns = sequences.attach_anchor(events).schema, sequences.anchor_sessions(events).schema
    assert sorted({v[0] for k, v in whole.items() if k < 100}) == [1, 2, 3, 4, 5, 6]
    small_blocks(rows_per_block)
    assert sequences.split_games(events) is not None
    assert by_row(sequences.anchor_sessions(events), "physical_faceoff_id") == whole
    assert by_row(sequences.attach_anchor(events), "faceoff_sequence_id", "faceoff_time") == attached
    assert (sequences.attach_anchor(events).schema, sequences.anchor_sessions(events).schema) == columns


def test_pairs_across_an_id_range(spark):
    ids = [65_533, 65_534, 65_535, 65_536, 65_540, 131_071, 131_072, 131_073, 131_075, 131_076]
    anchors = spark.createDataFrame([(1, i) for i in ids], "gameid int, faceoff_sequence_id bigint")
    got = {r.faceoff_sequence_id: r.join_id for r in pairing.pair_adjacent(anchors).collect()}
    assert got == {
        65_535: 65_536, 65_536: 65_536, 131_072: 131_073, 131_073: 131_073,
        131_075: 131_076, 131_076: 131_076,
    }


def test_mixed_pair_is_not_checked_for_one_winner(spark):
    rows = [event(i, 0, "faceoff", "successful", team=i) for i in range(3)]
    got = pairing.paired_registry(jobs.post_anchor_events(frame(spark, rows))).collect()
    assert {(r.faceoff_sequence_id, r.join_id, r.teamid) for r in got} == {(1, 2, 1), (2, 2, 2)}
