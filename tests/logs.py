"""Small logs, and a plain-Python statement of the ordered operators to check against."""

from __future__ import annotations

import random

from pyspark.sql import types as T

from anchorwake.sources.schema import EVENTS

SCHEMA = T.StructType([*EVENTS.fields, T.StructField("row_pos", T.LongType())])
NAMES = SCHEMA.fieldNames()

_EVEN = "evenStrength"
# row_pos, time, period, event, outcome, team, player, x, possession, margin, strength, xg
_TINY = [
    (0, 0, 1, "faceoff", "successful", 1, 11, 0, 1, 0, _EVEN, None),
    (1, 0, 1, "faceoff", "failed", 2, 21, 0, 1, 0, _EVEN, None),
    (2, 4, 1, "shot", "successful", 1, 11, 40, 1, 0, _EVEN, 0.10),
    (3, 10, 1, "pass", "successful", 2, 21, 30, 2, 0, _EVEN, None),
    (4, 11, 1, "pass", "failed", 2, 22, 35, 2, 0, _EVEN, None),
    (5, 50, 1, "faceoff", "successful", 2, 21, 60, 2, 1, _EVEN, None),
    (6, 50, 1, "faceoff", "failed", 1, 11, -60, 2, -1, _EVEN, None),
    (7, 55, 1, "goal", "successful", 2, 22, 70, 2, 1, _EVEN, 0.30),
    (8, 58, 2, "shot", "successful", 2, 22, 65, 2, 2, _EVEN, 0.20),
    (9, 100, 2, "faceoff", "failed", 1, 11, -20, None, 0, _EVEN, None),
    (10, 100, 2, "faceoff", "successful", 2, 21, 20, None, 0, _EVEN, None),
    (11, 103, 2, "faceoff", "successful", 1, 11, 30, 1, 0, "powerPlay", None),
    (12, 103, 2, "faceoff", "failed", 2, 21, -30, 1, 0, "shortHanded", None),
]


def event(row_pos, time, name, outcome="successful", team=1, player=1, x=0.0, period=1,
          game=1, possession=1, margin=0, strength=_EVEN, xg=None):
    return {
        "gameid": game, "compiledgametime": None if time is None else float(time),
        "period": period, "eventname": name, "outcome": outcome, "teamid": team,
        "playerid": player, "xadjcoord": None if x is None else float(x),
        "teaminpossession": possession, "scoredifferential": margin,
        "manpowersituation": strength, "xg_allattempts": xg, "row_pos": row_pos,
    }


def tiny() -> list[dict]:
    return [
        event(r, t, e, o, team, p, x, period, 1, poss, m, s, xg)
        for r, t, period, e, o, team, p, x, poss, m, s, xg in _TINY
    ]


def frame(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(row[n] for n in NAMES) for row in rows], SCHEMA)


def random_log(seed: int, games: int = 3, size: int = 120) -> list[dict]:
    """Games of unequal size with many equal times, missing periods and odd anchors."""
    rng = random.Random(seed)
    rows, pos = [], 0
    for game in range(games):
        for _ in range(size if game == 1 else rng.randint(1, 12)):
            name = rng.choice(["faceoff", "faceoff", "shot", "goal", "pass", "carry"])
            rows.append(
                event(
                    pos, rng.randint(0, size), name, rng.choice(["successful", "failed"]),
                    rng.choice([1, 2, 2, None]) if rng.random() < 0.2 else rng.choice([1, 2]),
                    rng.randint(1, 6), rng.choice([None, *range(-40, 41, 5)]),
                    rng.choice([1, 1, 1, 2, None]) if rng.random() < 0.3 else 1,
                    game * 70_000, rng.choice([1, 2, None]), rng.randint(-2, 2),
                    rng.choice([_EVEN, "powerPlay", "fourOnFour"]),
                    round(rng.random(), 3) if name in ("shot", "goal") else None,
                )
            )
            pos += 1
    rng.shuffle(rows)
    return rows


def attach(rows: list[dict]) -> list[dict]:
    """Latest anchor of each event, by walking the sorted log."""
    out, state = [], {}
    for index, row in enumerate(
        sorted(rows, key=lambda r: (r["gameid"], r["compiledgametime"], r["row_pos"]))
    ):
        last = state.setdefault(row["gameid"], {"id": None, "time": None, "period": None})
        if row["eventname"] == "faceoff":
            last["id"], last["time"] = index, row["compiledgametime"]
            if row["period"] is not None:
                last["period"] = row["period"]
        out.append(
            {**row, "faceoff_sequence_id": last["id"], "faceoff_time": last["time"],
             "faceoff_period": last["period"]}
        )
    return out


def window(attached: list[dict]) -> list[dict]:
    return [
        r for r in attached
        if r["faceoff_sequence_id"] is not None
        and r["compiledgametime"] <= r["faceoff_time"] + 10
        and r["period"] is not None and r["period"] == r["faceoff_period"]
    ]


def sessions(windowed: list[dict]) -> dict[int, int]:
    """row_pos -> physical id."""
    out, count, before = {}, {}, {}
    for r in windowed:
        game = r["gameid"]
        if r["eventname"] == "faceoff" and before.get(game) != r["compiledgametime"]:
            count[game] = count.get(game, 0) + 1
        before[game] = r["compiledgametime"]
        out[r["row_pos"]] = count.get(game, 0)
    return out


def pairs(windowed: list[dict]) -> dict[int, int]:
    """sequence id -> join id of the anchors that are kept."""
    joins: dict[tuple, list[int]] = {}
    anchors = [r for r in windowed if r["eventname"] == "faceoff"]
    for r, after in zip(anchors, anchors[1:] + [None]):
        sid = r["faceoff_sequence_id"]
        linked = after and after["gameid"] == r["gameid"] and after["faceoff_sequence_id"] == sid + 1
        joins.setdefault((r["gameid"], sid + 1 if linked else sid), []).append(sid)
    return {sid: join for (_, join), sids in joins.items() if len(sids) == 2 for sid in sids}
