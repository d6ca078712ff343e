import pytest
from pyspark.sql import functions as F

from anchorwake.functions import leverage, nulls, zones

X = [26.0, 25.0, 6.0, 5.0, -4.0, -5.0, -24.0, -25.0, -26.0, None]


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, fn, values=X):
    rows = column(spark, values).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


@pytest.mark.parametrize(
    ("fn", "expected"),
    [
        (lambda x: F.substring(zones.zone5(x), 1, 1), list("1223344555")),
        (zones.zone_level, [2, 1, 1, 0, 0, -1, -1, -2, -2, -2]),
        (zones.zone_type, ["Endzone", "Neutral_Side", "Neutral_Side", "Center", "Center", "Center",
                           "Neutral_Side", "Neutral_Side", "Endzone", "Center"]),
        (zones.winner_zone, ["Offensive Zone"] + ["Neutral Zone"] * 6 + ["Defensive Zone"] * 3),
        (zones.start_zone, ["Offensive Zone", "Neutral Zone", "Neutral Zone"] + ["Center Ice"] * 7),
        (zones.movement, ["Offensiv Zon"] + ["Mittzon"] * 7 + ["Defensiv Zon", "Mittzon"]),
    ],
)
def test_zone_bounds_are_strict(spark, fn, expected):
    assert apply(spark, fn) == expected


def test_role(spark):
    df = spark.createDataFrame(
        [("1. Offensiv Zon", "failed"), ("5. Defensiv Zon", "successful"),
         ("3. Mitt-tekning", "successful"), ("3. Mitt-tekning", "failed"), ("3. Mitt-tekning", None)],
        "z string, o string",
    )
    got = [r[0] for r in df.select(zones.role(F.col("z"), F.col("o"))).collect()]
    assert got == ["Anfallande Lag", "Försvarande Lag", "Anfallande Lag", "Försvarande Lag", None]


def test_mirror_is_an_involution(spark):
    df = column(spark, ["Offensive Zone", "Neutral Zone", "Defensive Zone"], "string")
    twice = zones.mirror_zone(zones.mirror_zone(F.col("x")))
    assert df.where(twice != F.col("x")).count() == 0


def weights(spark, fn, rows, last):
    df = spark.createDataFrame(rows, f"d int, p int, m string, z {last}")
    out = df.select(fn(F.col("d"), F.col("p"), F.col("m"), F.col("z"))).collect()
    return [None if r[0] is None else round(r[0], 9) for r in out]


def test_leverage_case(spark):
    rows = [
        (0, 1, "evenStrength", "Center"), (-1, 5, "fourOnFour", "Endzone"),
        (1, 3, "powerPlay", "Neutral_Side"), (0, None, "evenStrength", "Center"),
        (0, 1, None, "Center"), (None, 1, "evenStrength", "Center"),
    ]
    assert weights(spark, leverage.leverage_case, rows, "string") == [
        0.6, round(0.5 * 1.5 * 1.3 * 1.3, 9), round(0.5 * 1.3 * 1.1, 9), 1.0, None, None,
    ]


def test_leverage_lookup(spark):
    rows = [
        (0, 1, "evenStrength", 0.0), (1, 4, "shortHanded", -26.0), (0, 5, "fourOnFour", 25.0),
        (0, None, None, 25.5), (None, 1, "evenStrength", 0.0), (0, 1, "evenStrength", None),
    ]
    assert weights(spark, leverage.leverage_lookup, rows, "double") == [
        0.6, round(0.5 * 1.5 * 1.3 * 1.3, 9), 1.0, 1.3, None, None,
    ]


def test_strict_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0, True), ("a", 2.0, False), ("b", None, False), ("b", 1.0, True), ("c", None, True)],
        "g string, x double, m boolean",
    )
    got = df.groupBy("g").agg(
        nulls.strict_sum(F.col("x"), F.col("m")), nulls.strict_sum(F.col("x")),
        nulls.strict_mean(F.col("x")), nulls.sum_or_zero(F.col("x")),
    ).orderBy("g").collect()
    assert [tuple(r)[1:] for r in got] == [
        (1.0, 3.0, 1.5, 3.0), (1.0, None, None, 1.0), (None, None, None, 0.0),
    ]


def test_if_else_keeps_missing(spark):
    df = column(spark, [1.0, -1.0, None])
    assert [r[0] for r in df.select(nulls.if_else(F.col("x") > 0, "y", "n")).collect()] == ["y", "n", None]


def test_whole_number_rounds_half_to_even(spark):
    assert apply(spark, nulls.whole_number, [0.5, 1.5, 2.5, 2.6, None]) == ["0", "2", "2", "3", None]
