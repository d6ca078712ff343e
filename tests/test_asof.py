"""As-of joins, weights from tables, cut points and quantiles of large keys, and logs stored by game."""

import random
import re

import pytest
from logs import event, frame, random_log
from pyspark.sql import functions as F
from test_plans import exchanges, plan

from anchorwake.operators import asof, ordering, registry, sequences, weights
from anchorwake.operators.ordering import BLOCK, find_split
from anchorwake.plans import jobs
from anchorwake.sources.stored import store_log

LEFT = "k string, g int, t int, id int"
RIGHT = "k string, g int, t int, v int, w string"


def _tables(seed):
    rng = random.Random(seed)

    def place():
        k = rng.choice(["a", "a", "a", "b", None] if rng.random() < 0.2 else ["a", "a", "b"])
        return k, rng.choice([1, 1, 1, 2]), rng.choice([None, *range(40)])

    left = [(*place(), i) for i in range(150)]
    right = [(*place(), rng.choice([None, 1, 2, 3]), rng.choice("xyz")) for _ in range(60)]
    return left, right


def _plain_join(left, right):
    out = {}
    for k, g, t, i in left:
        found = [
            (rt, (v is None, v), w, v) for rk, rg, rt, v, w in right if None not in (k, t, rk, rt) and (rk, rg) == (k, g) and rt <= t
        ]
        # Of equal places the largest values, missing ones last.
        best = max(found, key=lambda r: (r[0], r[1][0], r[1][1] or 0, r[2])) if found else None
        out[i] = (best[3], best[2]) if best else (None, None)
    return out


@pytest.mark.parametrize("rows_per_block", [None, 7])
def test_asof_join_by_comparing_all_rows(spark, small_blocks, rows_per_block):
    left, right = _tables(rows_per_block or 1)
    if rows_per_block:
        small_blocks(rows_per_block)
    ours, theirs = spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2)
    joined = asof.asof_join(ours, theirs, ["k", "g"], ["t"])
    assert joined.columns == ["k", "g", "t", "id", "v", "w"]
    rows = joined.collect()
    assert sorted((r.k or "", r.g, r.t or -1, r.id) for r in rows) == sorted((k or "", g, t or -1, i) for k, g, t, i in left)
    expected = _plain_join(left, right)
    # A missing value sorts first within a struct, so it counts only where there is no other.
    found = {r.id: (r.v, r.w) for r in rows}
    several = {(k, g, t) for k, g, t, *_ in right if sum((k, g, t) == r[:3] for r in right) > 1}
    for k, g, t, i in left:
        hit = [r for r in right if None not in (k, t, r[0], r[2]) and r[:2] == (k, g) and r[2] <= t]
        if not hit or (k, g, max(r[2] for r in hit)) not in several:
            assert found[i] == expected[i]
        else:
            assert found[i] in {r[3:] for r in hit if r[2] == max(h[2] for h in hit)}
    # Ties are broken by value, so the result does not depend on the layout or on the cuts.
    again = asof.asof_join(ours.repartition(5), theirs.coalesce(1), ["k", "g"], ["t"], split=None)
    assert {r.id: (r.v, r.w) for r in again.collect()} == found


def test_asof_join_of_few_columns_and_none(spark):
    ours, theirs = spark.createDataFrame([("a", 1, 5, 1), ("b", 1, 5, 2)], LEFT), spark.createDataFrame([("a", 1, 5, 7, "x")], RIGHT)
    inner = asof.asof_join(ours, theirs, ["k", "g"], ["t"], ["v"], "inner", "their_")
    assert [tuple(r) for r in inner.collect()] == [("a", 1, 5, 1, 7)]
    assert inner.columns[-1] == "their_v"
    nothing = asof.asof_join(ours, theirs.limit(0), ["k", "g"], ["t"])
    assert sorted((r.id, r.v) for r in nothing.collect()) == [(1, None), (2, None)]
    assert asof.asof_join(ours.limit(0), theirs, ["k", "g"], ["t"]).collect() == []
    with pytest.raises(ValueError, match="prefix"):
        asof.asof_join(ours, theirs.withColumnRenamed("v", "id"), ["k", "g"], ["t"])
    with pytest.raises(ValueError, match="how"):
        asof.asof_join(ours, theirs, ["k"], ["t"], how="outer")
    text = plan(asof.asof_join(ours, theirs, ["k", "g"], ["t"], split=None))
    assert "Join" not in text and len([e for e in exchanges(text) if "k#" in e]) == 1


def test_one_instant_of_a_join_may_hold_everything(spark, small_blocks):
    small_blocks(20)
    ours = spark.range(300).selectExpr("'a' AS k", "1 AS g", "5 AS t", "CAST(id AS INT) AS id")
    theirs = spark.createDataFrame([("a", 1, 5, 7, "x"), ("a", 1, 4, 9, "z")], RIGHT)
    assert {(r.v, r.w) for r in asof.asof_join(ours, theirs, ["k", "g"], ["t"]).collect()} == {(7, "x")}
    rows = ours.withColumns({"_h": F.xxhash64("id")})
    sizes = find_split(rows, ("k", "g"), ("t", "_h")).assign(rows).groupBy(BLOCK).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 100


# ------------------------------------------------------------------ context and weights


def test_context_that_must_stay_the_same(spark):
    rows = [
        event(0, 0, "faceoff", period=None, strength="powerPlay"), event(1, 1, "pass", period=None, strength="powerPlay"),
        event(2, 2, "pass", period=1, strength="powerPlay"), event(3, 3, "faceoff", period=1, strength=None),
        event(4, 4, "pass", period=1, strength=None), event(5, 5, "pass", period=1, strength="powerPlay"),
    ]
    log, same = frame(spark, rows), ("period", "manpowersituation")

    def kept(fill, differs):
        attached = sequences.attach_anchor(log, same=same, fill=fill)
        return sorted(r.row_pos for r in sequences.window_after_anchor(attached, 10, same, missing_differs=differs).collect())

    assert kept(True, True) == [5]  # the second anchor has the strength of the first
    assert kept(False, True) == []
    assert kept(False, False) == [0, 1, 3, 4]
    assert sequences.window_after_anchor(sequences.attach_anchor(log, same=()), 1, ()).count() == 4


def test_weights_from_tables_are_those_of_the_literals(spark):
    from anchorwake.functions import fixed

    facts = jobs.session_facts(frame(spark, random_log(6)))
    periods = spark.createDataFrame([*fixed.PERIOD_WEIGHTS.items(), (None, 9.0)], "period int, weight double")
    strengths = spark.createDataFrame([*fixed.STRENGTH_WEIGHTS.items(), ("none", None)], "manpower string, weight double")
    expected = sorted(map(str, facts.collect()))
    weighed = weights.with_leverage(facts.drop("leverage"), periods, strengths).select(*facts.columns)
    assert sorted(map(str, weighed.collect())) == expected
    assert "BroadcastHashJoin" in plan(weighed)
    with pytest.raises(ValueError, match="lists 2 more than once"):
        weights.with_leverage(facts, periods.union(periods.where("period = 2")), strengths)
    none = weights.with_lookup(facts, periods.limit(0), "period", "w", default=None)
    assert none.where("w IS NOT NULL").count() == 0


def test_large_tables_of_weights_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(weights, "BROADCAST_ROWS", 2)
    table = spark.range(5).selectExpr("id AS k", "id * 1.5D AS weight")
    found = weights.with_lookup(spark.range(7).withColumnRenamed("id", "k"), table, "k", "w")
    assert {r.k: r.w for r in found.collect()} == {0: 0.0, 1: 1.5, 2: 3.0, 3: 4.5, 4: 6.0, 5: 1.0, 6: 1.0}


# ------------------------------------------------------------------ large keys


def test_cut_points_in_ranges_are_the_same(spark, monkeypatch, small_blocks):
    small_blocks(64)
    events = spark.range(60_000).selectExpr("id % 50 = 0 AS few", "CAST(id * id % 4001 AS DOUBLE) AS t", "id AS row_pos")
    events = events.selectExpr("CASE WHEN few THEN 'small' ELSE 'large' END AS k", "t", "row_pos")
    gathered = find_split(events, ("k",), ("t", "row_pos"))
    whole = {r.k: r._cuts for r in gathered.bounds.collect()}
    monkeypatch.setattr(ordering, "GATHERED_SAMPLES", 1024)
    ranged = find_split(events, ("k",), ("t", "row_pos"))
    assert {r.k: r._cuts for r in ranged.bounds.collect()} == whole and len(whole["large"]) > 500
    sizes = [r["count"] for r in ranged.assign(events).where("k = 'large'").groupBy(BLOCK).count().collect()]
    assert sorted(sizes)[len(sizes) // 2] < 2 * 64 and max(sizes) < 6 * 64


def test_blocks_of_the_usual_size_are_even(spark):
    """With the limit's own number of samples a block is within twice the limit."""
    events = spark.range(300_000).selectExpr("'k' AS k", "CAST(id * 7919 % 300007 AS DOUBLE) AS t", "id AS row_pos")
    split = find_split(events, ("k",), ("t", "row_pos"), limit=20_000)
    sizes = [r["count"] for r in split.assign(events).groupBy(BLOCK).count().collect()]
    assert max(sizes) < 2 * 20_000


def test_sessions_of_cut_games_are_computed_once(spark, small_blocks, tmp_path):
    frame(spark, random_log(11)).write.parquet(str(tmp_path / "log"))
    events = spark.read.parquet(str(tmp_path / "log"))
    small_blocks(20)
    split = sequences.split_games(events)
    windowed = sequences.window_after_anchor(sequences.attach_in_blocks(events, split, number=False))
    text = plan(sequences.sessions_in_blocks(windowed, split))
    # Windows over events: those of the games that are not cut. The cut ones come from a checkpoint.
    assert len(re.findall(r"FileScan parquet", text)) == 1 and "Scan ExistingRDD" in text


def test_quantiles_sort_only_the_bins_they_need(spark, small_blocks):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 0.5, 0.5, rng.random()]), rng.gauss(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    wanted = {"a": (F.col("x"), 0.5), "b": (F.abs(F.col("y")), 0.92), "c": (F.col("y"), 0.0), "d": (F.col("y"), 1.0), "e": (F.col("x"), 0.251)}
    whole = ordering.quantiles(df, wanted, "id").first().asDict()
    small_blocks(30)
    cut = ordering.quantiles(df, wanted, "id")
    assert cut.first().asDict() == pytest.approx(whole)
    assert ordering.quantiles(df.selectExpr("id", "CAST(NULL AS DOUBLE) AS x", "y"), {"a": wanted["a"], "c": wanted["c"]}, "id").first().asDict() == {
        "a": None, "c": pytest.approx(whole["c"]),
    }


# ------------------------------------------------------------------ stored by game


@pytest.mark.parametrize("rows_per_block", [None, 20])
def test_a_log_stored_by_game_is_not_shuffled_again(spark, small_blocks, tmp_path, rows_per_block):
    log = frame(spark, random_log(12))
    expected = sorted(map(str, jobs.session_facts(log).collect()))
    if rows_per_block:
        small_blocks(rows_per_block)
    name = f"log_{rows_per_block or 'whole'}"
    stored = store_log(jobs.post_anchor_events(log), name, str(tmp_path / "log"), 4)
    try:
        assert (BLOCK in stored.columns) == bool(rows_per_block)
        facts = jobs.facts_from_windowed(stored, split=None)
        text = plan(facts)
        # Only totals per anchor and team move; those of whole games not even that.
        if rows_per_block:
            moved = [e for e in exchanges(text) if not e.startswith("HashedRelation")]
            assert moved and all("physical_faceoff_id" in e for e in moved)
        else:
            assert exchanges(text) == []
        assert sorted(map(str, facts.select(*jobs.session_facts(log).columns).collect())) == expected
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_small_blocks_share_buckets(spark, small_blocks, tmp_path):
    """A bucket is a file and a task, so their number follows the rows and not the blocks."""
    log = frame(spark, random_log(12))
    expected = sorted(map(str, jobs.session_facts(log).collect()))
    small_blocks(5)
    stored = store_log(jobs.post_anchor_events(log), "log_shared", str(tmp_path / "log"))
    try:
        n = int(spark.sql("DESCRIBE FORMATTED log_shared").where("col_name = 'Num Buckets'").first().data_type)
        assert n == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert stored.select("gameid", BLOCK).distinct().count() > n
        facts = jobs.facts_from_windowed(stored, split=None)
        assert sorted(map(str, facts.select(*jobs.session_facts(log).columns).collect())) == expected
    finally:
        spark.sql("DROP TABLE log_shared")
