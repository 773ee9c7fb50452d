"""The feature matrix as one query: its feeds from the supplied tables, and columns of every stage in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plays as P
from ..plans import matrix as M
from ..session import cut_lineage
from .frames import PLAYS
from .registry import query, r, rounded, rs

# Orders of one day and one sixteenth are a game; every group has one game a day at most.
GAMES = {
    "game_id": "(year(o_orderdate) * 366 + dayofyear(o_orderdate)) * 16 + o_orderkey % 16",
    "season": "year(o_orderdate)",
    "week": "CAST(floor((dayofyear(o_orderdate) - 1) / 7) AS INT) + 1",
    "game_date": "CAST(o_orderdate AS DATE)",
    "game_start_utc": "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + (o_orderkey % 16) * INTERVAL '1' HOUR",
    "home_team": "concat('T', CAST(o_orderkey % 16 AS VARCHAR(9)))",
    "away_team": "concat('T', CAST(16 + (o_orderkey % 16 + dayofyear(o_orderdate)) % 16 AS VARCHAR(9)))",
}
SIDE = f"CASE WHEN l_linenumber % 2 = 0 THEN {GAMES['home_team']} ELSE {GAMES['away_team']} END"
# One row per line item, seen as a play of one of the game's sides.
GAME_PLAYS = {
    **{n: GAMES[n] for n in ("game_id", "season", "week", "game_date")},
    **{n: PLAYS[n] for n in (
        "play_id", "qtr", "down", "ydstogo", "yardline_100", "goal_to_go", "half_seconds_remaining", "score_differential", "no_huddle", "pass_oe", "pass",
        "rush", "complete_pass", "incomplete_pass", "yards_gained", "air_yards", "yards_after_catch", "epa", "success", "qb_dropback", "qb_spike", "qb_kneel",
        "rush_touchdown", "pass_touchdown", "td_player_id",
    )},
    "drive": "l_orderkey * 4 + l_linenumber % 3",
    "posteam": SIDE,
    "defteam": f"CASE WHEN l_linenumber % 2 = 0 THEN {GAMES['away_team']} ELSE {GAMES['home_team']} END",
    "passer_player_id": f"CASE WHEN l_returnflag <> 'A' THEN concat('P', {SIDE}) END",
    "rusher_player_id": f"CASE WHEN l_returnflag = 'A' THEN concat('R', {SIDE}, '-', CAST(l_partkey % 3 AS VARCHAR(9))) END",
    "receiver_player_id": f"CASE WHEN l_returnflag <> 'A' AND l_partkey % 5 <> 0 THEN concat('W', {SIDE}, '-', CAST(l_partkey % 4 AS VARCHAR(9))) END",
}
# Side feeds of a game, from its line items; their times lie before and after any cutoff.
FEED_TIMES = {
    "reported_at": f"{GAMES['game_start_utc']} - (l_suppkey % 100 - 10) * INTERVAL '1' HOUR",
    "odds_snapshot_ts": f"{GAMES['game_start_utc']} - (l_partkey % 50 - 5) * INTERVAL '1' HOUR",
    "forecast_generated_ts": f"{GAMES['game_start_utc']} - ((l_orderkey * 8 + l_linenumber) * 37 % 400009 - 20000) * INTERVAL '1' SECOND",
}
LINES = {"total_line": "30 + l_quantity", "spread_line": "l_discount * 100 - 5"}
FORECAST = {"temp_f": "l_quantity * 2.0", "wind_speed_mph": "l_tax * 300", "precip_probability_pct": "CAST(l_partkey % 100 AS DOUBLE)", "forecast_lead_hours": "CAST(l_linenumber * 6 AS DOUBLE)"}


def _columns(pairs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in pairs.items())


def feeds(t) -> M.Feeds:
    """Plays, schedule, snaps, positions and side feeds."""
    # Every stage and side feed reads the joined rows, most by game: they are joined and laid out by game once.
    used = sorted(set(re.findall(r"\b[lo]_\w+", " ".join([*GAMES.values(), *GAME_PLAYS.values(), *FEED_TIMES.values(), *LINES.values(), *FORECAST.values()]))))
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(f"{GAMES['game_id']} AS game_id", *used)
    held = M.laid_out(joined, "plays", M.GAME)
    plays = held.selectExpr("game_id", *[f"{e} AS {n}" for n, e in GAME_PLAYS.items() if n != "game_id"])
    for step in (P.with_role_indicators, P.with_masked_yards, P.with_credit, P.with_zone_usage):
        plays = plays.transform(step)
    people = plays.select(F.explode(F.array("rusher_player_id", "receiver_player_id", "passer_player_id")).alias("player_id"), "game_id").where(F.col("player_id").isNotNull())
    snaps = people.groupBy("game_id", "player_id").agg((F.count(F.lit(1)) / 4).alias("offense_pct"))
    kind = F.substring("player_id", 1, 1)
    positions = people.select("player_id").distinct().withColumn("position", F.when(kind == "R", "RB").when(kind == "P", "QB").otherwise("WR"))

    def feed(name: str, more: dict[str, str]) -> DataFrame:
        return held.selectExpr("game_id", f"{FEED_TIMES[name]} AS {name}", *[f"{e} AS {n}" for n, e in more.items()])

    # One forecast for each game and time.
    forecasts = feed("forecast_generated_ts", FORECAST).groupBy("game_id", "forecast_generated_ts").agg(*[F.max(n).alias(n) for n in FORECAST])
    return M.Feeds(
        plays, cut_lineage(t.orders.selectExpr(*[f"{e} AS {n}" for n, e in GAMES.items()]).distinct()), positions, snaps,
        injuries=feed("reported_at", {}), odds=feed("odds_snapshot_ts", LINES), forecasts=M.write_grain(forecasts, "forecasts", M.GAME),
    )


#: What the query shows of the stages: column and its SQL.
SHOWN = {
    "3g_target_per_game": "m.t3",
    "season_carry_per_game_with_team": "m.cs",
    "lifetime_target_per_game_vs_team": "CASE WHEN m.vn >= 4 THEN m.vt END",
    "drive_hist_touch_rate_l3": "m.dr",
    "hist_catch_rate_l5": "m.c5",
    "hist_air_yards_sum_l3": "m.a3",
    "snap_offense_pct_l3": "m.s3",
    "hist_target_share_l3": "CASE WHEN oc.targets_l3 > 0 THEN m.t3 / oc.targets_l3 ELSE 0 END",
    "team_ctx_pass_rate_l3": "oc.pass_rate_l3",
    "opp_ctx_yards_per_play_prev": "dc.ypp_prev",
    "team_pace_proe_prev": "pace.proe_prev",
    "opp_def_pass_epa_allowed_prev": "sp.epa_prev",
    "qb_profile_team_dropbacks_l3": "pf.drop_l3",
    "team_anytime_td_rate_lifetime": "tr.life",
    "team_pos_anytime_td_rate_2": "pr.two",
    "hours_since_last": "gs.hours",
    "team_implied_total": "CASE WHEN m.team = gs.home_team THEN (od.total_line - od.spread_line) / 2 ELSE od.total_line - (od.total_line - od.spread_line) / 2 END",
    "weather_temp_air_f": "wx.temp_f",
    "weather_temp_trend": "wx.temp_f - wx.prev_temp",
}
_WEEK = "season * 1000 + week"

MATRIX_SQL = f"""
WITH held AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pl AS (SELECT {_columns(GAME_PLAYS)} FROM held),
g AS (SELECT DISTINCT {_columns(GAMES)} FROM orders),
roles AS (
  SELECT season, week, game_id, game_date, drive, passer_player_id AS p, posteam AS team, defteam AS opponent, 0 AS tgt, 0 AS rec, 0 AS car, 1 AS att, 0 AS air, yards_gained AS py, 0 AS ry, pass_touchdown AS td
  FROM pl WHERE passer_player_id IS NOT NULL
  UNION ALL SELECT season, week, game_id, game_date, drive, rusher_player_id, posteam, defteam, 0, 0, 1, 0, 0, 0, yards_gained, rush_touchdown FROM pl WHERE rusher_player_id IS NOT NULL
  UNION ALL SELECT season, week, game_id, game_date, drive, receiver_player_id, posteam, defteam, 1, complete_pass, 0, 0, coalesce(air_yards, 0), 0, 0, pass_touchdown FROM pl WHERE receiver_player_id IS NOT NULL),
drives AS (
  SELECT season, week, game_id, game_date, drive, p, team, opponent, sum(tgt) AS tgt, sum(rec) AS rec, sum(car) AS car, sum(att) AS att, sum(air) AS air, sum(py) AS py, sum(ry) AS ry, sum(td) AS td, count(*) AS plays
  FROM roles GROUP BY ALL),
pg AS (
  SELECT season, week, game_id, game_date, p, team, opponent, sum(tgt) AS tgt, sum(rec) AS rec, sum(car) AS car, sum(att) AS att, sum(air) AS air, sum(py) AS py, sum(ry) AS ry,
         (sum(td) > 0)::INT AS hit, sum(plays) AS plays, count(*) AS nd, count(*) FILTER (tgt + rec + car + att > 0) AS touched
  FROM drives GROUP BY ALL),
m AS (
  SELECT *, sum(tgt) OVER w3 / count(*) OVER w3 AS t3, sum(car) OVER ws / count(*) OVER ws AS cs, sum(tgt) OVER wv / count(*) OVER wv AS vt, count(*) OVER wv AS vn,
         coalesce(sum(touched) OVER w3 / sum(nd) OVER w3, 0) AS dr, least(coalesce(sum(rec) OVER w5, 0) / (coalesce(sum(tgt) OVER w5, 0) + 1e-6), 1) AS c5,
         coalesce(sum(air) OVER w3, 0) AS a3, avg(plays / 4) OVER w3 AS s3
  FROM pg
  WINDOW w3 AS (PARTITION BY p ORDER BY game_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY p ORDER BY game_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
         ws AS (PARTITION BY p, season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wv AS (PARTITION BY p, opponent ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ow AS (SELECT season, week, team, sum(att) AS att, sum(car) AS car, sum(tgt) AS tgt FROM pg GROUP BY ALL),
oc AS (
  SELECT season, week, team, coalesce(avg(CASE WHEN att + car > 0 THEN att / (att + car) ELSE 0 END) OVER w, 0) AS pass_rate_l3, coalesce(avg(tgt) OVER w, 0) AS targets_l3
  FROM ow WINDOW w AS (PARTITION BY season, team ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
dw AS (SELECT season, week, opponent, sum(att) + sum(car) AS n, sum(py) + sum(ry) AS y FROM pg GROUP BY ALL),
dc AS (SELECT season, week, opponent, coalesce(lag(CASE WHEN n > 0 THEN y / n ELSE 0 END) OVER (PARTITION BY season, opponent ORDER BY week), 0) AS ypp_prev FROM dw),
pace AS (
  SELECT game_id, posteam, lag(proe) OVER (PARTITION BY season, posteam ORDER BY game_date) AS proe_prev
  FROM (SELECT season, game_id, posteam, game_date, coalesce(avg(pass_oe), 0) AS proe FROM pl WHERE qtr <= 4 AND coalesce(qb_spike, 0) = 0 AND coalesce(qb_kneel, 0) = 0 GROUP BY ALL)),
sp AS (
  SELECT season, week, defteam, lag(v) OVER (PARTITION BY defteam ORDER BY {_WEEK}) AS epa_prev
  FROM (SELECT season, week, defteam, coalesce(avg(epa), 0) AS v FROM pl WHERE pass = 1 GROUP BY ALL)),
pf AS (
  SELECT season, week, posteam, avg(v) OVER (PARTITION BY posteam ORDER BY {_WEEK} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS drop_l3
  FROM (SELECT season, week, posteam, sum(qb_dropback) AS v FROM pl WHERE passer_player_id IS NOT NULL GROUP BY ALL)),
tr AS (
  SELECT season, week, team, avg(h) OVER (PARTITION BY team ORDER BY {_WEEK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life
  FROM (SELECT season, week, team, max(hit) AS h FROM pg GROUP BY ALL)),
pr AS (
  SELECT season, week, team, kind, avg(h) OVER (PARTITION BY team, kind ORDER BY {_WEEK} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS two
  FROM (SELECT season, week, team, left(p, 1) AS kind, max(hit) AS h FROM pg GROUP BY ALL)),
gs AS (
  SELECT *, datediff('second', lag(game_start_utc) OVER (PARTITION BY team ORDER BY game_start_utc), game_start_utc) // 60 / 60 AS hours
  FROM (SELECT game_id, game_start_utc, home_team, home_team AS team FROM g UNION ALL SELECT game_id, game_start_utc, home_team, away_team FROM g)),
cut AS (SELECT game_id, game_start_utc - INTERVAL '6' HOUR AS cutoff FROM g),
inj AS (SELECT c.game_id, max(f.reported_at) AS ts FROM cut c JOIN (SELECT {GAMES['game_id']} AS game_id, {FEED_TIMES['reported_at']} AS reported_at FROM held) f ON f.game_id = c.game_id AND f.reported_at <= c.cutoff GROUP BY ALL),
od AS (
  SELECT c.game_id, max(f.ts) AS ts, max_by(f.lines, (f.ts, f.lines)).total_line AS total_line, max_by(f.lines, (f.ts, f.lines)).spread_line AS spread_line
  FROM cut c JOIN (SELECT {GAMES['game_id']} AS game_id, {FEED_TIMES['odds_snapshot_ts']} AS ts, {{'total_line': {LINES['total_line']}, 'spread_line': {LINES['spread_line']}}} AS lines FROM held) f
  ON f.game_id = c.game_id AND f.ts <= c.cutoff GROUP BY c.game_id),
fc AS (SELECT {GAMES['game_id']} AS game_id, {FEED_TIMES['forecast_generated_ts']} AS ts, max({FORECAST['temp_f']}) AS temp_f FROM held GROUP BY ALL),
fp AS (SELECT *, lag(temp_f) OVER (PARTITION BY game_id ORDER BY ts) AS prev_temp FROM fc),
wx AS (SELECT c.game_id, max(f.ts) AS ts, max_by(temp_f, f.ts) AS temp_f, nullif(max_by(coalesce(prev_temp, -999), f.ts), -999) AS prev_temp
  FROM cut c JOIN fp f ON f.game_id = c.game_id AND f.ts <= c.cutoff GROUP BY c.game_id)
SELECT m.p AS player_id, m.game_id, m.hit AS anytime_td, CAST(inj.ts AS VARCHAR) AS injury_snapshot_ts, {rs({n: e for n, e in SHOWN.items()})}
FROM m JOIN gs ON gs.game_id = m.game_id AND gs.team = m.team
JOIN inj ON inj.game_id = m.game_id JOIN od ON od.game_id = m.game_id JOIN wx ON wx.game_id = m.game_id
LEFT JOIN oc ON oc.season = m.season AND oc.week = m.week AND oc.team = m.team
LEFT JOIN dc ON dc.season = m.season AND dc.week = m.week AND dc.opponent = m.opponent
LEFT JOIN pace ON pace.game_id = m.game_id AND pace.posteam = m.team
LEFT JOIN sp ON sp.season = m.season AND sp.week = m.week AND sp.defteam = m.opponent
LEFT JOIN pf ON pf.season = m.season AND pf.week = m.week AND pf.posteam = m.team
LEFT JOIN tr ON tr.season = m.season AND tr.week = m.week AND tr.team = m.team
LEFT JOIN pr ON pr.season = m.season AND pr.week = m.week AND pr.team = m.team AND pr.kind = left(m.p, 1)"""


@query("feature_matrix_stages", MATRIX_SQL)
def _feature_matrix_stages(t) -> DataFrame:
    out = M.matrix(feeds(t))
    return rounded(out.select("player_id", "game_id", "anytime_td", F.date_format("injury_snapshot_ts", "yyyy-MM-dd HH:mm:ss").alias("injury_snapshot_ts"), *[F.col(f"`{n}`").cast("double").alias(n) for n in SHOWN]))
