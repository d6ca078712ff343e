"""DuckDB statements that state each registered query directly on the test tables."""

from __future__ import annotations

RAW_EVENTS = """raw_events AS (
SELECT gameid,
       CAST(t AS DOUBLE) AS compiledgametime,
       CAST(FLOOR(t / 1200) + 1 AS INT) AS period,
       ev AS eventname,
       CASE WHEN ev = 'faceoff' THEN CASE WHEN side = 0 THEN 'successful' ELSE 'failed' END
            WHEN k % 2 = 0 THEN 'successful' ELSE 'failed' END AS outcome,
       CAST((p + side) % 2 + 1 AS INT) AS teamid,
       CAST(CASE WHEN side = 0 THEN p ELSE (p + 1 + 2 * (k % 20)) % 40 END AS INT) AS playerid,
       CAST(CASE WHEN k % 17 = 0 AND ev <> 'faceoff' THEN NULL
                 WHEN side = 0 THEN k * 2 - 99 ELSE 99 - k * 2 END AS DOUBLE) AS xadjcoord,
       CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE (p + k) % 2 + 1 END AS INT) AS teaminpossession,
       CAST(CASE WHEN side = 0 THEN k % 5 - 2 ELSE 2 - k % 5 END AS INT) AS scoredifferential,
       CASE k % 7 WHEN 0 THEN 'powerPlay' WHEN 1 THEN 'shortHanded' ELSE 'evenStrength' END AS manpowersituation,
       CASE WHEN ev IN ('shot', 'goal') AND k % 13 <> 0 THEN value / 1000 END AS xg_allattempts,
       CAST(event_id * 2 + side AS BIGINT) AS row_pos
FROM (SELECT event_id, value, event_type, k, p,
             CAST(FLOOR(event_id / 1000) AS INT) AS gameid,
             (event_id % 1000) * 4 + k % 6 AS t,
             CASE WHEN event_type = 'signup' THEN 'faceoff'
                  WHEN event_type = 'purchase' AND k < 20 THEN 'goal'
                  WHEN event_type = 'purchase' THEN 'shot'
                  WHEN event_type = 'click' THEN 'pass'
                  WHEN event_type = 'view' THEN 'carry' ELSE 'block' END AS ev
      FROM (SELECT event_id, value, event_type, CAST(user_id % 40 AS INT) AS p,
                   CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) a) b
CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side) s
WHERE side = 0 OR event_type = 'signup')"""

ATTACHED = """numbered AS (
SELECT *, row_number() OVER (ORDER BY gameid, compiledgametime, row_pos) - 1 AS idx
FROM raw_events),
attached AS (
SELECT * EXCLUDE (idx),
       CAST(last_value(CASE WHEN eventname = 'faceoff' THEN idx END IGNORE NULLS) OVER w AS BIGINT) AS faceoff_sequence_id,
       last_value(CASE WHEN eventname = 'faceoff' THEN compiledgametime END IGNORE NULLS) OVER w AS faceoff_time,
       last_value(CASE WHEN eventname = 'faceoff' THEN period END IGNORE NULLS) OVER w AS faceoff_period
FROM numbered
WINDOW w AS (PARTITION BY gameid ORDER BY compiledgametime, row_pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

WINDOWED = """windowed AS (
SELECT * EXCLUDE (faceoff_period) FROM attached
WHERE faceoff_sequence_id IS NOT NULL AND compiledgametime <= faceoff_time + 10
  AND period = faceoff_period)"""

SESSIONED = """flagged AS (
SELECT *, CASE WHEN eventname = 'faceoff'
                AND compiledgametime IS DISTINCT FROM lag(compiledgametime) OVER
                    (PARTITION BY gameid ORDER BY compiledgametime, row_pos)
               THEN 1 ELSE 0 END AS is_new
FROM windowed),
sessioned AS (
SELECT * EXCLUDE (is_new),
       CAST(sum(is_new) OVER (PARTITION BY gameid ORDER BY compiledgametime, row_pos
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS physical_faceoff_id
FROM flagged)"""

REGISTRY = """ranked_anchors AS (
SELECT *, row_number() OVER (PARTITION BY gameid, physical_faceoff_id
                             ORDER BY compiledgametime, row_pos) AS nth,
       row_number() OVER (PARTITION BY gameid, physical_faceoff_id, outcome
                          ORDER BY compiledgametime, row_pos) AS nth_outcome
FROM sessioned WHERE eventname = 'faceoff'),
sides AS (
SELECT gameid, physical_faceoff_id,
       max(CASE WHEN nth_outcome = 1 AND outcome = 'successful' THEN teamid END) AS winner_team,
       max(CASE WHEN nth_outcome = 1 AND outcome = 'failed' THEN teamid END) AS loser_team,
       max(CASE WHEN nth_outcome = 1 AND outcome = 'successful' THEN playerid END) AS winner_player,
       max(CASE WHEN nth_outcome = 1 AND outcome = 'failed' THEN playerid END) AS loser_player,
       max(CASE WHEN nth_outcome = 1 AND outcome = 'successful' THEN xadjcoord END) AS fo_x,
       max(CASE WHEN nth = 1 THEN period END) AS period,
       max(CASE WHEN nth = 1 THEN scoredifferential END) AS score_diff,
       max(CASE WHEN nth = 1 THEN manpowersituation END) AS manpower
FROM ranked_anchors GROUP BY gameid, physical_faceoff_id),
registry AS (
SELECT *,
       1.0::DOUBLE / (1 + abs(score_diff))
       * CASE period WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 4 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
       * CASE WHEN manpower IN ('powerPlay', 'shortHanded') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END
       * CASE WHEN fo_x IS NULL THEN NULL WHEN abs(fo_x) > 25 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS leverage,
       CASE WHEN fo_x > 25 THEN 'Offensive Zone' WHEN fo_x > -25 THEN 'Neutral Zone'
            ELSE 'Defensive Zone' END AS fo_zone_winner,
       CASE WHEN fo_x > 25 THEN 'Offensive Zone' WHEN fo_x > 5 THEN 'Neutral Zone'
            ELSE 'Center Ice' END AS fo_zone
FROM sides WHERE winner_team IS NOT NULL AND loser_team IS NOT NULL)"""


def _level(x: str) -> str:
    return (
        f"CASE WHEN {x} > 25 THEN 2 WHEN {x} > 5 THEN 1 WHEN {x} > -5 THEN 0 "
        f"WHEN {x} > -25 THEN -1 ELSE -2 END"
    )


FACTS = f"""xg AS (
SELECT r.gameid, r.physical_faceoff_id,
       sum(CASE WHEN e.teamid = r.winner_team THEN xg_allattempts END) AS w,
       sum(CASE WHEN e.teamid = r.loser_team AND r.loser_team <> r.winner_team THEN xg_allattempts END) AS l
FROM registry r JOIN sessioned e USING (gameid, physical_faceoff_id)
WHERE e.eventname IN ('shot', 'goal') GROUP BY ALL),
reach AS (
SELECT r.gameid, r.physical_faceoff_id,
       max(CASE WHEN e.teamid = r.winner_team THEN xadjcoord END) AS w,
       max(CASE WHEN e.teamid = r.loser_team THEN xadjcoord END) AS l
FROM registry r JOIN sessioned e USING (gameid, physical_faceoff_id)
WHERE e.eventname <> 'faceoff' GROUP BY ALL),
facts0 AS (
SELECT r.*, coalesce(xg.w, 0.0::DOUBLE) AS xg_winner, coalesce(xg.l, 0.0::DOUBLE) AS xg_loser,
       greatest(-100.0::DOUBLE, reach.w) AS max_x_winner,
       greatest(-100.0::DOUBLE, reach.l) AS max_x_loser
FROM registry r
LEFT JOIN xg USING (gameid, physical_faceoff_id)
LEFT JOIN reach USING (gameid, physical_faceoff_id)),
facts AS (
SELECT *, {_level('max_x_winner')} - {_level('fo_x')} AS terr_winner,
       {_level('max_x_loser')} - {_level('-fo_x')} AS terr_loser
FROM facts0)"""

PARTICIPANTS = """participants AS (
SELECT winner_player AS playerid, TRUE AS won, leverage, fo_zone_winner AS player_zone,
       xg_winner AS xg_for, xg_loser AS xg_against, terr_winner AS terr_delta FROM facts
UNION ALL
SELECT loser_player, FALSE, leverage,
       CASE fo_zone_winner WHEN 'Offensive Zone' THEN 'Defensive Zone'
            WHEN 'Defensive Zone' THEN 'Offensive Zone' ELSE 'Neutral Zone' END,
       xg_loser, xg_winner, terr_loser FROM facts)"""

def _strict(x: str, where: str = "TRUE") -> str:
    """A sum that is missing if one of its values is."""
    return f"CASE WHEN count(*) FILTER (WHERE {where} AND ({x}) IS NULL) = 0 THEN coalesce(sum({x}) FILTER (WHERE {where}), 0.0::DOUBLE) END"


_CREATED, _CONCEDED = _strict("xg_for * leverage", "won"), _strict("xg_against * leverage", "NOT won")

BOARD = f"""board AS (
SELECT player_zone, playerid, count(*) AS n_fo, count(*) FILTER (WHERE won) AS n_won,
       avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS win_pct,
       {_CREATED} AS xg_created,
       {_CONCEDED} AS xg_conceded,
       ({_CREATED} - {_CONCEDED}) / count(*) AS impact_score
FROM participants GROUP BY player_zone, playerid HAVING count(*) >= {{min_fo}})"""

PLAYERS = f"""players AS (
SELECT *, wins / total_faceoffs AS raw_win_rate, (10 + wins) / (20.0::DOUBLE + total_faceoffs) AS bayes_win_rate,
       (lev_xg_gen - lev_xg_con) / total_faceoffs AS FIS_xg,
       lev_terr * 0.002::DOUBLE / total_faceoffs AS FIS_terr,
       (lev_xg_gen - lev_xg_con) / total_faceoffs + lev_terr * 0.002::DOUBLE / total_faceoffs AS FIS_per_fo
FROM (SELECT playerid, count(*) AS total_faceoffs, count(*) FILTER (WHERE won) AS wins,
             count(*) FILTER (WHERE NOT won) AS losses,
             {_CREATED} AS lev_xg_gen,
             {_CONCEDED} AS lev_xg_con,
             {_strict('terr_delta * leverage')} AS lev_terr,
             CASE WHEN count(*) = count(leverage) THEN avg(leverage) END AS avg_leverage
      FROM participants GROUP BY playerid) p),
rated AS (SELECT * FROM players WHERE total_faceoffs >= {{min_rated}}),
cuts AS (
SELECT median(FIS_per_fo) AS fis_med, median(raw_win_rate) AS wr_med,
       quantile_cont(abs(FIS_per_fo), 0.92) AS size_cut,
       quantile_cont(abs(raw_win_rate - 0.5), 0.92) AS lean_cut FROM rated),
classified AS (
SELECT rated.*,
       CASE WHEN raw_win_rate >= wr_med AND FIS_per_fo >= fis_med THEN 'High win% + High FIS'
            WHEN raw_win_rate >= wr_med AND FIS_per_fo < fis_med THEN 'High win% + Low FIS'
            WHEN raw_win_rate < wr_med AND FIS_per_fo >= fis_med THEN 'Low win% + High FIS'
            ELSE 'Low win% + Low FIS' END AS quadrant,
       abs(FIS_per_fo) > size_cut OR abs(raw_win_rate - 0.5) > lean_cut AS outlier
FROM rated, cuts)"""

PAIRED = """chained AS (
SELECT *, CASE WHEN lead(faceoff_sequence_id) OVER (PARTITION BY gameid ORDER BY compiledgametime, row_pos)
                    = faceoff_sequence_id + 1
               THEN faceoff_sequence_id + 1 ELSE faceoff_sequence_id END AS join_id
FROM windowed WHERE eventname = 'faceoff'),
zoned AS (
SELECT *, CASE WHEN xadjcoord > 25 THEN '1. Offensiv Zon' WHEN xadjcoord > 5 THEN '2. Neutral Zon (Off)'
               WHEN xadjcoord > -5 THEN '3. Mitt-tekning' WHEN xadjcoord > -25 THEN '4. Neutral Zon (Def)'
               ELSE '5. Defensiv Zon' END AS my_zon
FROM chained QUALIFY count(*) OVER (PARTITION BY gameid, join_id) = 2),
paired AS (
SELECT gameid, faceoff_sequence_id, join_id, teamid, my_zon,
       CASE WHEN left(my_zon, 1) IN ('1', '2') THEN 'Anfallande Lag'
            WHEN left(my_zon, 1) IN ('4', '5') THEN 'Försvarande Lag'
            WHEN outcome = 'successful' THEN 'Anfallande Lag'
            WHEN outcome = 'failed' THEN 'Försvarande Lag' END AS my_role,
       CASE WHEN abs(xadjcoord) > 25 THEN 'Endzone' WHEN abs(xadjcoord) > 5 THEN 'Neutral_Side'
            ELSE 'Center' END AS zone_type,
       period, scoredifferential, manpowersituation, outcome
FROM zoned)"""

SEQUENCE_XG = """sequence_xg AS (
SELECT r.gameid, r.faceoff_sequence_id,
       coalesce(sum(CASE WHEN r.outcome = 'successful' AND e.teamid = r.teamid THEN e.xg_allattempts END), 0.0::DOUBLE) AS xg_winner,
       coalesce(sum(CASE WHEN r.outcome = 'successful' AND e.teamid <> r.teamid THEN e.xg_allattempts END), 0.0::DOUBLE) AS xg_loser
FROM paired r JOIN windowed e ON e.gameid = r.gameid AND e.faceoff_sequence_id = r.join_id
WHERE e.eventname IN ('shot', 'goal') GROUP BY r.gameid, r.faceoff_sequence_id)"""

def _any(x: str, name: str) -> str:
    """Whether a condition holds somewhere; missing if that is unknown."""
    return f"CASE WHEN bool_or({x}) THEN TRUE WHEN count(*) = count({x}) THEN FALSE END AS {name}"


_FLAGS = ",\n       ".join(
    _any(f"{did} AND ev_team {how} teamid", f"{who}_{kind}")
    for kind, did in (
        ("made_goal", "ev_name = 'goal' AND ev_outcome = 'successful'"),
        ("made_shot", "ev_name = 'shot' AND ev_outcome = 'successful'"),
        ("attempt_shot", "ev_name = 'shot'"),
    )
    for who, how in (("i", "="), ("opp", "<>"))
)

OUTCOMES = """joined AS (
SELECT r.*, e.eventname AS ev_name, e.outcome AS ev_outcome, e.teamid AS ev_team, e.xadjcoord AS ev_x,
       e.teaminpossession AS ev_possession,
       row_number() OVER (PARTITION BY r.gameid, r.faceoff_sequence_id
                          ORDER BY e.compiledgametime DESC, e.row_pos DESC) AS from_end
FROM paired r JOIN windowed e ON e.gameid = r.gameid AND e.faceoff_sequence_id = r.join_id),
seq_facts AS (
SELECT gameid, faceoff_sequence_id, teamid, my_zon, my_role, zone_type,
       {flags},
       max(CASE WHEN from_end = 1 THEN ev_x END) AS final_x,
       max(CASE WHEN from_end = 1 THEN ev_possession END) AS last_possession_team,
       min(period) AS period, min(scoredifferential) AS score_diff,
       min(manpowersituation) AS manpower, min(outcome) AS outcome_val
FROM joined GROUP BY gameid, faceoff_sequence_id, teamid, my_zon, my_role, zone_type),
moved AS (
SELECT *, last_possession_team IS NOT NULL AND last_possession_team = teamid AS i_have_puck,
       CASE WHEN final_x > 25 THEN 'Offensiv Zon' WHEN final_x < -25 THEN 'Defensiv Zon'
            ELSE 'Mittzon' END AS movement
FROM seq_facts),
classified_seq AS (
SELECT *, CASE WHEN i_made_goal THEN '01. Mål (Egna)'
     WHEN opp_made_goal THEN '11. Mål (Insläppt)'
     WHEN i_made_shot THEN '02. Avslut på mål (Egna)'
     WHEN opp_made_shot THEN '10. Avslut på mål (Emot)'
     WHEN i_attempt_shot THEN '03. Skottförsök (Egna - Miss/Block)'
     WHEN opp_attempt_shot THEN '09. Skottförsök (Emot - Miss/Block)'
     WHEN movement = 'Offensiv Zon' AND i_have_puck THEN '04. Innehav i Offensiv Zon'
     WHEN movement = 'Offensiv Zon' AND NOT i_have_puck THEN '05. Utan puck i Offensiv Zon'
     WHEN movement = 'Mittzon' AND i_have_puck THEN '06. Innehav i Mittzon'
     WHEN movement = 'Mittzon' AND NOT i_have_puck THEN '07. Utan puck i Mittzon'
     WHEN movement = 'Defensiv Zon' AND i_have_puck THEN '08. Innehav i Defensiv Zon'
     WHEN movement = 'Defensiv Zon' AND NOT i_have_puck THEN '09. Utan puck i Defensiv Zon'
     ELSE '12. Odefinierat' END AS total_utfall
FROM moved)""".replace("{flags}", _FLAGS)

SCORES = """weighted AS (
SELECT c.*, coalesce(x.xg_winner, 0.0::DOUBLE) AS xg_winner, coalesce(x.xg_loser, 0.0::DOUBLE) AS xg_loser,
       CASE WHEN outcome_val = 'successful'
            THEN coalesce(x.xg_winner, 0.0::DOUBLE) - coalesce(x.xg_loser, 0.0::DOUBLE)
            ELSE coalesce(x.xg_loser, 0.0::DOUBLE) - coalesce(x.xg_winner, 0.0::DOUBLE) END AS reward,
       1.0::DOUBLE / (1 + abs(score_diff)) AS score_weight,
       CASE WHEN period = 1 THEN 0.6::DOUBLE WHEN period = 2 THEN 0.8::DOUBLE WHEN period = 3 THEN 1.0::DOUBLE
            WHEN period >= 4 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS period_weight,
       CASE WHEN manpower = 'evenStrength' THEN 1.0::DOUBLE WHEN manpower IS NOT NULL THEN 1.3::DOUBLE END AS manpower_weight,
       CASE zone_type WHEN 'Endzone' THEN 1.3::DOUBLE WHEN 'Neutral_Side' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS zone_weight
FROM classified_seq c LEFT JOIN sequence_xg x USING (gameid, faceoff_sequence_id)),
scores AS (
SELECT *, score_weight * period_weight * manpower_weight * zone_weight AS leverage,
       reward * (score_weight * period_weight * manpower_weight * zone_weight) AS fis_score
FROM weighted)"""


def _panel(source: str, by: str, score: str, tail: bool, k: int = 10) -> str:
    group = f"PARTITION BY {by}" if by else ""
    per_player = f"PARTITION BY {by + ', ' if by else ''}playerid"
    side = f"PARTITION BY {by + ', ' if by else ''}src"
    last = "DESC" if tail else "ASC"
    return f"""halves AS (
SELECT *, 'bottom' AS src FROM (
  SELECT * FROM {source} QUALIFY row_number() OVER ({group} ORDER BY {score} ASC, playerid ASC) <= {k})
UNION ALL
SELECT *, 'top' AS src FROM (
  SELECT * FROM {source} QUALIFY row_number() OVER ({group} ORDER BY {score} DESC, playerid {last}) <= {k})),
deduped AS (SELECT * FROM halves QUALIFY row_number() OVER ({per_player} ORDER BY src) = 1),
panel AS (
SELECT *, CAST(row_number() OVER ({group} ORDER BY {score}, src, playerid) AS INT) AS display_pos,
       CASE WHEN {score} >= 0 THEN 'positive' WHEN {score} < 0 THEN 'negative' END AS sign_class,
       count(*) FILTER (WHERE src = 'bottom') OVER ({group}) + 0.5::DOUBLE AS divider_pos
FROM deduped),
placed AS (
SELECT *, row_number() OVER ({side} ORDER BY display_pos) AS place, count(*) OVER ({side}) AS size
FROM panel),
annotated AS (
SELECT *, CAST(CAST(round_even(1 / abs({score}), 0) AS BIGINT) AS VARCHAR) AS fo_label
FROM placed WHERE abs({score}) >= 0.001 AND (size <= 3 OR place IN (1, CAST(ceil(size / 2) AS BIGINT), size)))"""


def _f(x: str, name: str = "") -> str:
    """A double in the form in which both engines are compared."""
    return f"CAST(CAST(round({x}, 12) AS FLOAT) AS DOUBLE) + 0.0::DOUBLE AS {name or x}"


_EVENT = (
    "gameid, compiledgametime, period, eventname, outcome, teamid, playerid, xadjcoord, "
    "teaminpossession, scoredifferential, manpowersituation, "
    f"{_f('xg_allattempts')}, row_pos"
)
_REG = (
    "gameid, physical_faceoff_id, winner_team, loser_team, winner_player, loser_player, fo_x, "
    f"period, score_diff, manpower, {_f('leverage')}, fo_zone_winner, fo_zone"
)
_BOARD = (
    f"player_zone, playerid, n_fo, n_won, {_f('win_pct')}, "
    f"{_f('xg_created')}, {_f('xg_conceded')}, "
    f"{_f('impact_score')}"
)
_RATED = (
    f"playerid, total_faceoffs, wins, losses, {_f('raw_win_rate')}, "
    f"{_f('bayes_win_rate')}, {_f('lev_xg_gen')}, "
    f"{_f('lev_xg_con')}, {_f('lev_terr')}, "
    f"{_f('FIS_xg')}, {_f('FIS_terr')}, "
    f"{_f('FIS_per_fo')}, {_f('avg_leverage')}, quadrant"
)
_PANEL = "src, display_pos, sign_class, divider_pos"


def _with(parts, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def _log(columns: str, where: str = "TRUE") -> str:
    """The derived log with some columns replaced."""
    clean = RAW_EVENTS.replace("raw_events AS (", "clean_events AS (", 1)
    return f"{clean},\nraw_events AS (SELECT * REPLACE ({columns}) FROM clean_events WHERE {where})"


GAPS = _log(
    "CASE WHEN row_pos % 23 = 3 THEN NULL WHEN row_pos % 29 = 4 THEN 5 ELSE period END AS period, "
    "CASE WHEN row_pos % 19 <> 5 THEN teamid END AS teamid, "
    "CASE WHEN row_pos % 43 <> 10 THEN xadjcoord END AS xadjcoord, "
    "CASE WHEN row_pos % 31 <> 7 THEN scoredifferential END AS scoredifferential, "
    "CASE WHEN row_pos % 37 = 8 THEN 'fourOnFour' WHEN row_pos % 41 <> 9 THEN manpowersituation END AS manpowersituation",
    "NOT (eventname = 'faceoff' AND row_pos % 47 = 11)",
)
LONG_IDS = _log("CAST(gameid AS BIGINT) + 3000000000 AS gameid")


def statements() -> dict[str, str]:
    """The statement of every registered query of the library itself."""
    out = _statements(RAW_EVENTS)
    for name in CUT_GAMES:
        out[f"{name}_cut_games"] = out[name]
    for name in ("player_ratings", "rank_correlation"):
        out[f"{name}_cut_table"] = out[name]
    out["xg_by_side_stored_log"] = out["xg_by_side_bucketed_log"] = out["xg_by_side"]
    gaps = _statements(GAPS)
    out |= {f"{name}_gaps": gaps[name] for name in WITH_GAPS}
    out |= {f"{name}_gaps_cut_games": gaps[name] for name in GAPS_CUT_GAMES}
    out["post_anchor_events_long_ids"] = _statements(LONG_IDS)["post_anchor_events"]
    return out


#: Queries that are also run with every game cut, on the whole log and on the log with gaps.
CUT_GAMES = ("attached_events", "anchor_sessions", "xg_by_side", "attempt_anchors", "team_anchors", "same_strength_events")
GAPS_CUT_GAMES = ("xg_by_side", "fis_scores", "attempt_anchors", "same_or_both_missing", "team_anchors")
#: Queries that are also run on the log with gaps.
WITH_GAPS = (
    "attempt_anchors", "team_anchors", "same_strength_events", "same_or_both_missing",
    "post_anchor_events", "anchor_sessions", "anchor_registry", "xg_by_side", "territorial_delta",
    "impact_leaderboard", "leaderboard_summary", "leaderboard_panel", "player_ratings", "rank_correlation",
    "pair_adjacent", "sequence_xg", "sequence_outcomes", "fis_scores", "zone_impact", "outcome_report", "control_total",
)


def _latest(keys: str, anchor: str, prefix: str, same: tuple[str, ...], fill: bool = True) -> str:
    """``attached``: every row with a key and the latest anchor of its key."""
    if fill:
        context = [f"last_value(CASE WHEN {anchor} THEN {c} END IGNORE NULLS) OVER w AS {prefix}_{c}" for c in same]
    else:
        context = [f"(last_value(CASE WHEN {anchor} THEN {{'v': {c}}} END IGNORE NULLS) OVER w).v AS {prefix}_{c}" for c in same]
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""numbered AS (
SELECT *, row_number() OVER (ORDER BY {keys}, compiledgametime, row_pos) - 1 AS idx FROM raw_events WHERE {known}),
attached AS (
SELECT * EXCLUDE (idx), CAST(last_value(CASE WHEN {anchor} THEN idx END IGNORE NULLS) OVER w AS BIGINT) AS {prefix}_sequence_id,
       last_value(CASE WHEN {anchor} THEN compiledgametime END IGNORE NULLS) OVER w AS {prefix}_time, {", ".join(context)}
FROM numbered WINDOW w AS (PARTITION BY {keys} ORDER BY compiledgametime, row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _after(prefix: str, horizon: int, same: tuple[str, ...], equal: str = "=") -> str:
    context = " AND ".join(f"{c} {equal} {prefix}_{c}" for c in same)
    return (
        f"SELECT {_EVENT}, {prefix}_sequence_id, {prefix}_time FROM attached "
        f"WHERE {prefix}_sequence_id IS NOT NULL AND compiledgametime <= {prefix}_time + {horizon} AND {context}"
    )


def _new_statements(raw: str, to_registry: list[str]) -> dict[str, str]:
    """Anchors of other keys, contexts and kinds, from the same log or from a table of their own."""
    strength, either, attempt = ("period", "manpowersituation"), ("manpowersituation", "teaminpossession"), "eventname IN ('shot', 'goal')"
    faceoff = "eventname = 'faceoff'"
    place = "CAST(compiledgametime AS BIGINT) * 1000000000 + row_pos"
    return {
        "attempt_anchors": _with(
            [raw],
            f"SELECT e.gameid, e.teamid, e.compiledgametime, e.row_pos, e.eventname, e.playerid, {_f('e.xg_allattempts', 'xg_allattempts')}, "
            "a.period AS anchor_period, a.outcome AS anchor_outcome, a.playerid AS anchor_playerid, a.xadjcoord AS anchor_xadjcoord "
            f"FROM (SELECT *, {place} AS place FROM raw_events WHERE {attempt}) e "
            f"ASOF LEFT JOIN (SELECT *, {place} AS place FROM raw_events WHERE {faceoff}) a "
            "ON e.gameid = a.gameid AND e.teamid = a.teamid AND e.place >= a.place",
        ),
        "team_anchors": _with(
            [raw, _latest("gameid, teamid", faceoff, "faceoff", strength)],
            f"SELECT {_EVENT}, faceoff_sequence_id, faceoff_time, faceoff_period, faceoff_manpowersituation FROM attached",
        ),
        "same_strength_events": _with([raw, _latest("gameid", faceoff, "faceoff", strength)], _after("faceoff", 10, strength)),
        "same_or_both_missing": _with(
            [raw, _latest("gameid", faceoff, "faceoff", either, fill=False)], _after("faceoff", 20, either, "IS NOT DISTINCT FROM")
        ),
        "attempt_sequences": _with([raw, _latest("gameid", attempt, "attempt", ("teamid",))], _after("attempt", 5, ("teamid",))),
        "weighed_registry": _with(
            to_registry,
            "SELECT * REPLACE (CAST(CAST(1.0::DOUBLE / (1 + abs(score_diff)) * coalesce(0.5::DOUBLE + period / 8, 1.0::DOUBLE) "
            "* CASE manpower WHEN 'powerPlay' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END "
            "* CASE WHEN fo_x IS NULL THEN NULL WHEN abs(fo_x) > 25 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS FLOAT) AS DOUBLE) AS leverage) "
            "FROM registry",
        ),
    }


def _statements(raw: str, min_fo: int = 15, min_rated: int = 50) -> dict[str, str]:
    to_window = [raw, ATTACHED, WINDOWED]
    to_session = [*to_window, SESSIONED]
    to_registry = [*to_session, REGISTRY]
    to_facts = [*to_registry, FACTS]
    to_players = [*to_facts, PARTICIPANTS]
    to_board = [*to_players, BOARD.format(min_fo=min_fo)]
    to_rated = [*to_players, PLAYERS.format(min_rated=min_rated)]
    to_pairs = [*to_window, PAIRED]
    to_outcomes = [*to_pairs, OUTCOMES]
    to_scores = [*to_outcomes, SEQUENCE_XG, SCORES]
    zone_panel = _panel("board", "player_zone", "impact_score", tail=False)
    rating_panel = _panel("classified", "", "FIS_per_fo", tail=True)
    extremes = (
        "playerid, total_faceoffs, round(raw_win_rate, 4) + 0.0::DOUBLE AS raw_win_rate, "
        "round(bayes_win_rate, 4) + 0.0::DOUBLE AS bayes_win_rate, round(FIS_per_fo, 4) + 0.0::DOUBLE AS FIS_per_fo"
    )
    whole = "CASE WHEN count(*) = count(score) THEN corr({}, fis) END"
    ranked = """ranked AS (
SELECT rank() OVER (ORDER BY raw_win_rate) + (count(*) OVER (PARTITION BY raw_win_rate) - 1) / 2 AS raw,
       rank() OVER (ORDER BY bayes_win_rate) + (count(*) OVER (PARTITION BY bayes_win_rate) - 1) / 2 AS bay,
       rank() OVER (ORDER BY FIS_per_fo) + (count(*) OVER (PARTITION BY FIS_per_fo) - 1) / 2 AS fis, FIS_per_fo AS score
FROM rated)"""
    out = {
        "attached_events": _with(
            [RAW_EVENTS, ATTACHED],
            f"SELECT {_EVENT}, faceoff_sequence_id, faceoff_time, faceoff_period FROM attached",
        ),
        "post_anchor_events": _with(
            to_window, f"SELECT {_EVENT}, faceoff_sequence_id, faceoff_time FROM windowed"
        ),
        "sequence_summary": _with(
            to_window,
            "SELECT count(*) AS n_events, count(DISTINCT faceoff_sequence_id) AS n_sequences FROM windowed",
        ),
        "anchor_sessions": _with(
            to_session,
            f"SELECT {_EVENT}, faceoff_sequence_id, faceoff_time, physical_faceoff_id FROM sessioned",
        ),
        "anchor_registry": _with(to_registry, f"SELECT {_REG} FROM registry"),
        "xg_by_side": _with(
            to_facts,
            f"SELECT {_REG}, {_f('xg_winner')}, {_f('xg_loser')} FROM facts",
        ),
        "territorial_delta": _with(
            to_facts,
            f"SELECT {_REG}, max_x_winner, max_x_loser, terr_winner, terr_loser FROM facts",
        ),
        "participants_long": _with(
            to_players,
            f"SELECT playerid, won, {_f('leverage')}, player_zone, "
            f"{_f('xg_for')}, {_f('xg_against')}, terr_delta FROM participants",
        ),
        "impact_leaderboard": _with(to_board, f"SELECT {_BOARD} FROM board"),
        "leaderboard_summary": _with(
            to_board,
            "SELECT z.player_zone, n_participations, coalesce(n, 0) AS n_qualifying, avg_win_pct "
            "FROM (SELECT player_zone, count(*) AS n_participations FROM participants GROUP BY ALL) z "
            "LEFT JOIN (SELECT player_zone, count(*) AS n, round(avg(win_pct), 1) AS avg_win_pct "
            "FROM board GROUP BY ALL) b ON b.player_zone = z.player_zone",
        ),
        "leaderboard_panel": _with(
            [*to_board, zone_panel],
            f"SELECT {_BOARD}, {_PANEL}, CAST(CAST(round_even(win_pct, 0) AS BIGINT) AS VARCHAR) "
            "|| '% win' AS win_label FROM panel",
        ),
        "panel_annotations": _with(
            [*to_board, zone_panel], f"SELECT {_BOARD}, {_PANEL}, fo_label FROM annotated"
        ),
        "player_ratings": _with(to_rated, f"SELECT {_RATED}, outlier FROM classified"),
        "ratings_export": _with(to_rated, f"SELECT {_RATED} FROM classified"),
        "rating_counts": _with(
            to_rated,
            "SELECT (SELECT count(*) FROM registry) AS n_registry, (SELECT count(*) FROM rated) AS n_rated",
        ),
        "rating_extremes": _with(
            to_rated,
            f"SELECT 'top' AS extreme, {extremes} FROM (SELECT * FROM rated ORDER BY FIS_per_fo DESC, playerid LIMIT 10) "
            f"UNION ALL SELECT 'bottom', {extremes} FROM (SELECT * FROM rated ORDER BY FIS_per_fo, playerid LIMIT 10)",
        ),
        "rank_correlation": _with(
            [*to_rated, ranked],
            f"SELECT {_f(whole.format('raw'), 'cor_raw')}, {_f(whole.format('bay'), 'cor_bay')} FROM ranked",
        ),
        "ratings_panel": _with(
            [*to_rated, rating_panel],
            f"SELECT {_RATED}, outlier, {_PANEL}, CAST(CAST(round_even(raw_win_rate * 100, 0) AS BIGINT) "
            "AS VARCHAR) || '% win' AS win_label FROM panel",
        ),
        "ratings_annotations": _with(
            [*to_rated, rating_panel], f"SELECT {_RATED}, outlier, {_PANEL}, fo_label FROM annotated"
        ),
        "outlier_labels": _with(
            to_rated,
            f"SELECT CAST(playerid AS VARCHAR) AS label, {_f('raw_win_rate')}, "
            f"{_f('FIS_per_fo')}, quadrant FROM classified WHERE outlier",
        ),
        "pair_adjacent": _with(to_pairs, "SELECT * FROM paired"),
        "sequence_xg": _with(
            [*to_pairs, SEQUENCE_XG],
            f"SELECT gameid, faceoff_sequence_id, {_f('xg_winner')}, "
            f"{_f('xg_loser')} FROM sequence_xg",
        ),
        "sequence_outcomes": _with(to_outcomes, "SELECT * FROM classified_seq"),
        "fis_scores": _with(
            to_scores,
            "SELECT gameid, faceoff_sequence_id, teamid, my_zon, my_role, zone_type, total_utfall, "
            f"{_f('reward')}, {_f('score_weight')}, {_f('period_weight')}, "
            f"{_f('manpower_weight')}, {_f('zone_weight')}, {_f('leverage')}, "
            f"{_f('fis_score')} FROM scores",
        ),
        "zone_impact": _with(
            to_scores,
            "SELECT my_zon, CASE WHEN count(*) = count(fis_score) THEN round(avg(fis_score), 4) + 0.0::DOUBLE END AS Avg_FIS, count(*) / 2 AS Antal_Fysiska_Tekningar "
            "FROM scores GROUP BY my_zon",
        ),
        "outcome_report": _with(
            to_outcomes,
            "SELECT my_zon, my_role, total_utfall, count(*) AS Antal_Tekningar, "
            "round(count(*) / sum(count(*)) OVER (PARTITION BY my_zon, my_role) * 100, 2) AS Procent "
            "FROM classified_seq GROUP BY my_zon, my_role, total_utfall",
        ),
        "control_total": _with(
            to_scores,
            "SELECT actual, expected, actual = expected AS ok FROM "
            "(SELECT sum(n) AS actual FROM (SELECT count(*) / 2 AS n FROM scores GROUP BY my_zon)) a, "
            "(SELECT count(*) / 2 AS expected FROM paired) e",
        ),
    }
    return out | _new_statements(raw, to_registry)
