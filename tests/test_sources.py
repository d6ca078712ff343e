import random

import pytest
from logs import NAMES, event, frame, random_log, tiny

from anchorwake.operators import ratings, sequences
from anchorwake.plans import jobs
from anchorwake.sources import csv_rows
from anchorwake.sources import events as io
from anchorwake.sources.schema import complete_rows, incomplete_rows
from anchorwake.sources.settle import settle


def write_csv(path, rows, blank=""):
    names = [n for n in NAMES if n != "row_pos"]
    lines = [",".join([*names, "extra"])]
    for row in rows:
        lines.append(",".join([*(blank if row[n] is None else str(row[n]) for n in names), "e"]))
    path.write_text("\n".join(lines) + "\n")


def content(df):
    rows = df.orderBy("row_pos").drop("row_pos", "extra").collect()
    return [tuple(r) for r in rows]


def expected(rows):
    return [tuple(r[n] for n in NAMES if n != "row_pos") for r in rows]


@pytest.mark.parametrize("blank", ["", "NA", "NaN"])
def test_csv_keeps_order_types_and_unknown_columns(spark, tmp_path, blank):
    rows = tiny()
    write_csv(tmp_path / "log.csv", rows, blank)
    df = io.read_events_csv(spark, str(tmp_path / "log.csv"))
    assert df.columns[-2:] == ["extra", "row_pos"]
    assert dict(df.dtypes)["gameid"] == "bigint" and dict(df.dtypes)["compiledgametime"] == "double"
    assert content(df) == expected(rows)


def test_csv_with_kept_blanks(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [event(0, 0, "faceoff", strength=None, team=None)])
    write_csv(tmp_path / "b.csv", [event(0, 0, "faceoff", strength=None)], blank="NA")
    a, b = (io.read_events_csv(spark, str(tmp_path / f), "keep").first() for f in ("a.csv", "b.csv"))
    assert (a.manpowersituation, a.teamid, b.manpowersituation) == ("", None, None)
    with pytest.raises(ValueError):
        io.read_events_csv(spark, str(tmp_path / "a.csv"), "other")


def test_csv_order_over_splits_and_files(spark, tmp_path):
    rows = [event(i, 0, "pass", player=i) for i in range(400)]
    write_csv(tmp_path / "one.csv", rows)
    (tmp_path / "many").mkdir()
    for n in range(3):
        write_csv(tmp_path / "many" / f"part-{n}.csv", rows[n * 130 : (n + 1) * 130])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        one = io.read_events_csv(spark, str(tmp_path / "one.csv"))
        assert one.rdd.getNumPartitions() > 4
        assert [r.playerid for r in one.orderBy("row_pos").collect()] == list(range(400))
        many = io.read_events_csv(spark, str(tmp_path / "many"))
        assert [r.playerid for r in many.orderBy("row_pos").collect()] == list(range(390))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_filtered_log_round_trip(spark, tmp_path):
    log = frame(spark, random_log(5))
    windowed = settle(jobs.post_anchor_events(log))
    direct = {(r.gameid, r.faceoff_sequence_id, r.playerid, r.physical_faceoff_id)
              for r in sequences.anchor_sessions(windowed).collect()}
    for fmt, read in (("csv", io.read_events_csv), ("parquet", io.read_events_parquet)):
        io.write_events(windowed, str(tmp_path / fmt), fmt)
        again = read(spark, str(tmp_path / fmt))
        assert dict(again.dtypes)["faceoff_sequence_id"] == "bigint"
        assert {(r.gameid, r.faceoff_sequence_id, r.playerid, r.physical_faceoff_id)
                for r in sequences.anchor_sessions(again).collect()} == direct
    with pytest.raises(ValueError):
        io.write_events(windowed, str(tmp_path / "x"), "orc")


def test_ids_written_as_decimals(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("gameid,faceoff_sequence_id,faceoff_time\n7.0,12.0,3.5\n7,,nan\n")
    got = io.read_events_csv(spark, str(path), required=()).orderBy("row_pos").collect()
    assert [tuple(r)[:3] for r in got] == [(7, 12, 3.5), (7, None, None)]


def test_parquet_without_order_column_or_with_nan(spark, tmp_path):
    rows = [event(i, i, "pass", x=float("nan") if i % 2 else 1.0) for i in range(50)]
    frame(spark, rows).drop("row_pos").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = io.read_events_parquet(spark, str(tmp_path / "one"))
    got = [(r.compiledgametime, r.xadjcoord) for r in one.orderBy("row_pos").collect()]
    assert got == [(float(i), None if i % 2 else 1.0) for i in range(50)]
    frame(spark, rows).drop("row_pos").repartition(3).write.parquet(str(tmp_path / "three"))
    three = io.read_events_parquet(spark, str(tmp_path / "three"))
    assert three.select("row_pos").distinct().count() == 50


def _csv(tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    return str(tmp_path / "x.csv")


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = _csv(tmp_path, 'gameid,eventname,note,period\n1,pass,"said ""hi, there"" ok",1\n2,pass,"two\nlines",2\n3,pass,,\n')
    rows = io.read_events_csv(spark, path, multi_line=True, required=()).orderBy("row_pos").collect()
    assert [tuple(r)[:4] for r in rows] == [
        (1, "pass", 'said "hi, there" ok', 1), (2, "pass", "two\nlines", 2), (3, "pass", None, None),
    ]


def test_csv_with_surplus_fields_or_unreadable_values(spark, tmp_path):
    good = "gameid,teamid,period,compiledgametime\n3000000001,1,1,1.5\n7,2.0,,\n8,1\n"
    df = io.read_events_csv(spark, _csv(tmp_path, good), required=())
    assert [tuple(r)[:4] for r in df.orderBy("row_pos").collect()] == [(3000000001, 1, 1, 1.5), (7, 2, None, None), (8, 1, None, None)]
    for bad in ("9,1,1,1,5", "9,T2,1,1", "9,1,12.7,1", "9,1,1,1d", "9,1,1,oops", "x,1,1,1"):
        path = _csv(tmp_path, good + bad + "\n")
        with pytest.raises(Exception, match="cannot read|more fields"):
            io.read_events_csv(spark, path, required=()).collect()
        with pytest.raises(Exception, match="cannot read|more fields"):
            io.read_events_csv(spark, path, required=()).select("gameid", "teamid", "period", "compiledgametime").count() and io.read_events_csv(spark, path, required=()).select(
                "gameid", "teamid", "period", "compiledgametime"
            ).collect()
        assert io.read_events_csv(spark, path, unreadable="skip", required=()).count() == 3
        rejected = io.rejected_events_csv(spark, path, required=()).collect()
        assert len(rejected) == 1 and rejected[0].gameid in ("9", "x") and rejected[0].reason
    text = io.read_events_csv(spark, _csv(tmp_path, good + "g9,T2,1,1\n"), id_type="string", required=())
    assert {r.gameid for r in text.collect()} == {"3000000001", "7", "8", "g9"}
    with pytest.raises(ValueError):
        io.read_events_csv(spark, path, id_type="float")


def test_files_are_read_back_by_others(spark, tmp_path):
    import pandas as pd

    rows = [event(0, 0, "faceoff"), event(1, 1, 'said "hi, x"'), event(2, 2, "pass")]
    io.write_events(jobs.post_anchor_events(frame(spark, rows)), str(tmp_path / "out"))
    got = pd.concat(pd.read_csv(f) for f in sorted((tmp_path / "out").glob("*.csv")))
    assert sorted(got.eventname) == sorted(r["eventname"] for r in rows)


def test_order_has_one_type(spark, tmp_path):
    rows = [event(i, 0, "pass") for i in range(6)]
    write_csv(tmp_path / "a.csv", rows)
    one = dict(io.read_events_csv(spark, str(tmp_path / "a.csv")).dtypes)["row_pos"]
    write_csv(tmp_path / "b.csv", rows)
    assert dict(io.read_events_csv(spark, str(tmp_path / "*.csv")).dtypes)["row_pos"] == one


def test_parquet_columns_are_checked(spark, tmp_path):
    log = frame(spark, [event(0, 0, "pass", x=float("nan")), event(1, 1, "pass", period=2)])
    log.withColumns({"xadjcoord": log.xadjcoord.cast("float"), "period": log.period.cast("bigint")}).write.parquet(str(tmp_path / "p"))
    read = io.read_events_parquet(spark, str(tmp_path / "p"))
    assert dict(read.dtypes)["xadjcoord"] == "double" and dict(read.dtypes)["period"] == "int"
    assert [r.xadjcoord for r in read.orderBy("row_pos").collect()] == [None, 0.0]
    log.withColumn("period", log.period + 0.5).write.parquet(str(tmp_path / "q"))
    with pytest.raises(Exception, match="period"):
        io.read_events_parquet(spark, str(tmp_path / "q")).collect()
    log.drop("teamid").write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="teamid"):
        io.read_events_parquet(spark, str(tmp_path / "r"))


def test_ratings_file_is_sorted(spark, tmp_path):
    facts = jobs.session_facts(frame(spark, tiny()))
    export = ratings.ratings_export(ratings.classify_players(jobs.rated_table(facts, 1)))
    io.write_ratings(export, str(tmp_path / "ratings"))
    again = spark.read.option("header", True).csv(str(tmp_path / "ratings"))
    assert again.columns == list(ratings.EXPORT_COLUMNS)
    assert [r.playerid for r in again.collect()] == ["21", "11"]


def test_incomplete_rows_are_set_apart(spark):
    rows = [event(0, 0, "faceoff"), event(1, None, "pass"), event(2, 0, None), event(3, 0, "faceoff", None), event(4, 0, "pass", None)]
    df = frame(spark, rows)
    assert [r.row_pos for r in complete_rows(df).orderBy("row_pos").collect()] == [0, 4]
    assert [r.row_pos for r in incomplete_rows(df).orderBy("row_pos").collect()] == [1, 2, 3]


def _fields(row, *names):
    return tuple(row[n] for n in names)


def test_files_with_columns_in_other_orders(spark, tmp_path):
    rows = tiny()
    names = [n for n in NAMES if n != "row_pos"]
    (tmp_path / "logs [1]").mkdir()

    def write(file, order, some, more=()):
        lines = [",".join([*order, *more])] + [",".join([*("" if r[n] is None else str(r[n]) for n in order), *more]) for r in some]
        (tmp_path / "logs [1]" / file).write_text("\n".join(lines) + "\n")

    write("a%20.csv", names, rows[:5])
    write("b c.csv", names[::-1], rows[5:9], ["note"])
    write("c.csv", names, rows[9:])
    (tmp_path / "logs [1]" / "d.csv").write_text("")
    folder = str(tmp_path / "logs ?1?")
    df = io.read_events_csv(spark, folder)
    assert df.columns == [*names, "note", "row_pos"]
    got = df.orderBy("row_pos").collect()
    assert [_fields(r, *names) for r in got] == expected(rows)
    assert [r.note for r in got] == [None] * 5 + ["note"] * 4 + [None] * 4
    assert jobs.post_anchor_events(df).count() == jobs.post_anchor_events(frame(spark, rows)).count()
    write("e.csv", [n for n in names if n != "teamid"], rows[:1])
    with pytest.raises(ValueError, match="e.csv.*teamid"):
        io.read_events_csv(spark, folder)
    assert io.read_events_csv(spark, folder, required=()).where("teamid IS NULL").count() == 1
    with pytest.raises(ValueError, match="no file"):
        io.read_events_csv(spark, str(tmp_path / "logs ?1?" / "d.csv"))


def test_headers_with_blank_and_repeated_names(spark, tmp_path):
    path = _csv(tmp_path, '\ufeff,gameid,note,"Note","a,b",note\n1,2,x,y,z,w\n')
    df = io.read_events_csv(spark, path, required=())
    assert df.columns == ["_c0", "gameid", "note", "Note.1", "a,b", "note.2", "row_pos"]
    assert tuple(df.first())[:6] == ("1", 2, "x", "y", "z", "w")
    with pytest.raises(ValueError, match="line break"):
        io.read_events_csv(spark, _csv(tmp_path, 'gameid,"no\nte"\n'), required=())


def _long_fields(tmp_path, seed):
    """Files with fields of many lines, in two orders of columns and with both line ends."""
    rng = random.Random(seed)
    fields = ["plain", '"two\nlines"', '"a ""q"", b"', '"' + "long\n" * 40 + '"', "", '"with, comma\r\n and more"', '"\n"', "é"]
    rows = []
    for f, (order, end) in enumerate([("gameid,note,period", "\n"), ("note,period,gameid", "\r\n"), ("gameid,note,period", "\n")]):
        lines = [order]
        for i in range(250):
            note = rng.choice(fields)
            cells = {"gameid": str(1000 * f + i), "note": note, "period": str(i % 3)}
            lines.append(",".join(cells[c] for c in order.split(",")))
            text = note[1:-1].replace('""', '"') if note.startswith('"') else note
            rows.append((1000 * f + i, text, i % 3))
        (tmp_path / f"{f}.csv").write_bytes((end.join(lines) + end).encode())
    return rows


@pytest.mark.parametrize("split", [None, 1000, 120])
def test_line_breaks_in_fields_are_read_in_parallel(spark, tmp_path, split):
    rows = _long_fields(tmp_path, 3)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = io.read_events_csv(spark, str(tmp_path), "keep", multi_line=True, required=())
        found = df.orderBy("row_pos").collect()
        lines = csv_rows._lines(spark, str(tmp_path))
        assert not split or lines.rdd.getNumPartitions() >= 20
        if split == 120:  # smaller than a field: some splits begin inside one, some lie within
            assert csv_rows.split_openings(lines).count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [_fields(r, "gameid", "note", "period") for r in found] == rows


def test_a_field_that_does_not_end_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="does not end"):
        io.read_events_csv(spark, _csv(tmp_path, 'gameid,note\n1,"open\n2,x\n'), multi_line=True, required=())


@pytest.mark.parametrize("multi_line", [False, True])
def test_one_pass_stores_accepted_and_rejected_rows(spark, tmp_path, multi_line):
    rows = [event(i, i, "faceoff" if i % 3 == 0 else "pass") for i in range(40)]
    write_csv(tmp_path / "x.csv", rows)
    with open(tmp_path / "x.csv", "a") as f:
        f.write("oops,1\n5,x\n" + ",".join(["1"] * 14) + "\n")
    path = str(tmp_path / "x.csv")
    split = io.store_events_csv(spark, path, str(tmp_path / "out"), multi_line=multi_line)
    accepted = io.read_events_csv(spark, path, unreadable="skip", multi_line=multi_line)
    rejected = io.rejected_events_csv(spark, path, multi_line=multi_line)
    assert split.accepted.dtypes == accepted.dtypes and split.rejected.columns == [c for c in rejected.columns if c not in ("row_pos", "reason")] + ["reason", "row_pos"]
    assert sorted(map(str, split.accepted.collect())) == sorted(map(str, accepted.collect()))
    names = split.rejected.columns
    assert sorted(map(str, split.rejected.collect())) == sorted(map(str, rejected.select(*names).collect()))
    assert (split.accepted.count(), split.rejected.count()) == (40, 3)
    assert {r.reason for r in split.rejected.collect()} == {"cannot read gameid", "cannot read compiledgametime", "surplus fields"}
    # Each half reads its own files.
    plan = split.rejected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(accepted" in plan or "NOT accepted" in plan.split("PartitionFilters")[1]


def test_incomplete_rows_are_stored_apart_in_one_pass(spark, tmp_path):
    rows = [event(0, 0, "faceoff"), event(1, None, "pass"), event(2, 0, None), event(3, 0, "faceoff", None), event(4, 0, "pass", None)]
    split = io.store_checked(frame(spark, rows), str(tmp_path / "out"))
    assert sorted(r.row_pos for r in split.accepted.collect()) == [0, 4]
    assert sorted(r.row_pos for r in split.rejected.collect()) == [1, 2, 3]
    assert split.accepted.columns == frame(spark, rows).columns


@pytest.mark.parametrize("rows_per_block", [None, 5])
@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_counts_come_with_the_write(spark, small_blocks, tmp_path, fmt, rows_per_block):
    log = frame(spark, random_log(13))
    expected = tuple(sequences.sequence_summary(jobs.post_anchor_events(log)).first())
    rows = sorted(map(str, jobs.post_anchor_events(log).collect()))
    if rows_per_block:
        small_blocks(rows_per_block)
    assert tuple(jobs.write_post_anchor_events(log, str(tmp_path / "out"), fmt)) == expected
    if fmt == "parquet":
        assert sorted(map(str, io.read_events_parquet(spark, str(tmp_path / "out")).select(*jobs.post_anchor_events(log).columns).collect())) == rows
    else:
        assert io.read_events_csv(spark, str(tmp_path / "out")).count() == len(rows)
    assert tuple(jobs.write_post_anchor_events(log.limit(0), str(tmp_path / "none"), fmt)) == (0, 0)
