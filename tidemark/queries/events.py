"""Queries: event flags, outcomes, credit, and the grains built from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plays as P
from ..functions.labels import with_labels
from ..operators import grains as G
from ..operators.keys import nz
from ..operators.prior import prior_rows
from .frames import player_games, player_games_sql, plays, plays_sql
from .registry import query, r, rounded, rs


def sums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("bigint").alias(c) for c in columns])


SITUATION_SQL = {
    "situ_two_minute": "coalesce(half_seconds_remaining, 0) <= 120",
    "situ_final_four_minutes": "game_seconds_remaining <= 240",
    "situ_hurry_up": "coalesce(no_huddle, 0) = 1 OR coalesce(half_seconds_remaining, 0) <= 120",
    "situ_red_zone": "coalesce(yardline_100, 100) <= 20",
    "situ_goal_line": "coalesce(yardline_100, 100) <= 5 OR goal_to_go = 1",
    "situ_third_down": "down = 3",
    "situ_fourth_down": "down = 4",
    "situ_short_yardage": "ydstogo <= 2",
    "situ_long_yardage": "ydstogo >= 10",
    "situ_leading": "coalesce(score_differential, 0) > 0",
    "situ_trailing": "coalesce(score_differential, 0) < 0",
    "situ_trailing_one_score": "coalesce(score_differential, 0) BETWEEN -8 AND -1",
    "situ_leading_one_score": "coalesce(score_differential, 0) BETWEEN 1 AND 8",
    "situ_tied": "coalesce(score_differential, 0) = 0",
    "situ_pass_expected": "coalesce(xpass >= 0.60, false)",
    "situ_run_expected": "coalesce(xpass <= 0.40, false)",
    "situ_light_box": "coalesce(defenders_in_box <= 6, false)",
    "situ_heavy_box": "coalesce(defenders_in_box >= 8, false)",
    "situ_man_coverage": "coalesce(lower(trim(defense_man_zone_type)) = 'man', false)",
    "situ_zone_coverage": "coalesce(lower(trim(defense_man_zone_type)) = 'zone', false)",
    "situ_blitz": "number_of_pass_rushers >= 5",
    "situ_pressure": "was_pressure = 1",
}
SITUATION_FLAGS = ",\n  ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {n}" for n, c in SITUATION_SQL.items())


@query(
    "situation_flags",
    f"""
WITH {plays_sql()},
f AS (SELECT season, posteam, {SITUATION_FLAGS}, abs(coalesce(score_differential, 0)) AS situ_score_diff_abs FROM plays)
SELECT season, posteam, count(*) AS n, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in [*SITUATION_SQL, 'situ_score_diff_abs'])}
FROM f GROUP BY ALL
""",
)
def _situation_flags(t) -> DataFrame:
    flagged = P.with_situation(P.coerce_numbers(plays(t.lineitem)))
    return sums(flagged, ["season", "posteam"], [*SITUATION_SQL, "situ_score_diff_abs"])


OUTCOME_SQL = """CASE WHEN rush_touchdown = 1 THEN 'rush_td' WHEN pass_touchdown = 1 THEN 'pass_td'
  WHEN interception = 1 THEN 'interception' WHEN fumble = 1 THEN 'fumble' WHEN sack = 1 THEN 'sack' WHEN qb_spike = 1 THEN 'qb_spike'
  WHEN qb_kneel = 1 THEN 'qb_kneel' WHEN penalty = 1 THEN 'penalty' WHEN pass = 1 AND complete_pass = 1 THEN 'pass_complete'
  WHEN pass = 1 AND incomplete_pass = 1 THEN 'pass_incomplete' WHEN pass = 1 THEN 'pass' WHEN rush = 1 THEN 'rush' ELSE 'other' END"""


@query("play_outcome", f"WITH {plays_sql()} SELECT season, {OUTCOME_SQL} AS play_outcome, count(*) AS n, {r('sum(amount)', 'amount', 2)} FROM plays GROUP BY ALL")
def _play_outcome(t) -> DataFrame:
    out = P.with_outcome(plays(t.lineitem)).groupBy("season", "play_outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return rounded(out, 2)


CREDIT_SQL = """coalesce(td_player_id, CASE WHEN rush_touchdown = 1 THEN rusher_player_id END,
  CASE WHEN pass_touchdown = 1 THEN receiver_player_id END, CASE WHEN return_touchdown = 1 THEN returner_player_id END)"""
ROLE_SQL = """CASE WHEN passer_player_id IS NOT NULL AND pass = 1 THEN 1 ELSE 0 END AS pass_attempt,
  complete_pass AS completion,
  CASE WHEN receiver_player_id IS NOT NULL AND complete_pass = 1 THEN 1 ELSE 0 END AS reception,
  CASE WHEN receiver_player_id IS NOT NULL AND passer_player_id IS NOT NULL AND pass = 1 THEN 1 ELSE 0 END AS target,
  CASE WHEN rusher_player_id IS NOT NULL AND rush = 1 THEN 1 ELSE 0 END AS carry"""
ENRICHED_SQL = f"""{plays_sql()},
roles AS (SELECT *, {ROLE_SQL}, {CREDIT_SQL} AS touchdown_player_id,
  CASE WHEN rush = 1 THEN yards_gained END AS rushing_yards, CASE WHEN pass = 1 THEN yards_gained END AS passing_yards,
  CASE WHEN pass = 1 THEN yards_gained END AS receiving_yards FROM plays),
e AS (SELECT *, CASE WHEN touchdown_player_id IS NOT NULL THEN 1 ELSE 0 END AS touchdown,
  CASE WHEN target = 1 AND yardline_100 <= 20 THEN 1 ELSE 0 END AS red_zone_target,
  CASE WHEN carry = 1 AND yardline_100 <= 20 THEN 1 ELSE 0 END AS red_zone_carry,
  CASE WHEN target = 1 AND goal_to_go = 1 THEN 1 ELSE 0 END AS goal_to_go_target,
  CASE WHEN carry = 1 AND goal_to_go = 1 THEN 1 ELSE 0 END AS goal_to_go_carry FROM roles)"""


def enriched(lineitem: DataFrame) -> DataFrame:
    out = plays(lineitem)
    for step in (P.with_role_indicators, P.with_masked_yards, P.with_credit, P.with_zone_usage):
        out = out.transform(step)
    return out


USAGE = ["pass_attempt", "completion", "reception", "target", "carry", "red_zone_target", "red_zone_carry", "goal_to_go_target", "goal_to_go_carry", "touchdown"]


@query(
    "role_indicators",
    f"""WITH {ENRICHED_SQL} SELECT season, week, posteam, count(*) AS n, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in USAGE)},
  CAST(sum(rushing_yards) AS DOUBLE) AS rushing_yards, CAST(sum(passing_yards) AS DOUBLE) AS passing_yards FROM e GROUP BY ALL""",
)
def _role_indicators(t) -> DataFrame:
    e = enriched(t.lineitem)
    return e.groupBy("season", "week", "posteam").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("bigint").alias(c) for c in USAGE],
        F.sum("rushing_yards").cast("double").alias("rushing_yards"), F.sum("passing_yards").cast("double").alias("passing_yards"),
    )


@query(
    "score_credit",
    f"""WITH {ENRICHED_SQL} SELECT touchdown_player_id, count(*) AS n, {r('sum(amount)', 'amount', 2)} FROM e
WHERE touchdown = 1 GROUP BY 1""",
)
def _score_credit(t) -> DataFrame:
    out = enriched(t.lineitem).where("touchdown = 1").groupBy("touchdown_player_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return rounded(out, 2)


@query(
    "players_involved",
    f"""WITH {plays_sql('passer_player_id', 'rusher_player_id', 'receiver_player_id')}
SELECT nullif(concat_ws(' | ', 'PASSER:' || passer_player_id, 'RUSHER:' || rusher_player_id, 'RECEIVER:' || receiver_player_id), '') AS players_involved,
  count(*) AS n FROM plays GROUP BY 1""",
)
def _players_involved(t) -> DataFrame:
    named = plays(t.lineitem, "passer_player_id", "rusher_player_id", "receiver_player_id").withColumnsRenamed(
        {f"{x}_player_id": f"{x}_player_name" for x in ("passer", "rusher", "receiver")}
    )
    return P.with_participants(named).groupBy("players_involved").agg(F.count(F.lit(1)).alias("n"))


def roles_sql(keys: str) -> str:
    """Three role branches, unioned and re-aggregated."""
    metrics = ["passing_yards", "pass_attempt", "completion", "passing_td", "rushing_yards", "carry", "rushing_td_count", "red_zone_carry", "goal_to_go_carry",
               "receiving_yards", "target", "reception", "receiving_td_count", "red_zone_target", "goal_to_go_target"]
    given = {
        "passer": {"passing_yards": "passing_yards", "pass_attempt": "pass_attempt", "completion": "completion", "passing_td": "pass_touchdown",
                   "rushing_yards": "rushing_yards", "carry": "carry", "rushing_td_count": "rush_touchdown", "red_zone_carry": "red_zone_carry", "goal_to_go_carry": "goal_to_go_carry"},
        "rusher": {"rushing_yards": "rushing_yards", "carry": "carry", "rushing_td_count": "rush_touchdown", "red_zone_carry": "red_zone_carry", "goal_to_go_carry": "goal_to_go_carry"},
        "receiver": {"receiving_yards": "receiving_yards", "target": "target", "reception": "reception", "receiving_td_count": "pass_touchdown",
                     "red_zone_target": "red_zone_target", "goal_to_go_target": "goal_to_go_target"},
    }
    parts = [
        f"SELECT {keys}, {role}_player_id AS player_id, "
        + ", ".join(f"sum(coalesce({given[role][m]}, 0)) AS {m}" if m in given[role] else f"0 AS {m}" for m in metrics)
        + f", sum(CASE WHEN touchdown_player_id = {role}_player_id THEN touchdown ELSE 0 END) AS touchdowns, min(posteam) AS team"
        + f" FROM e WHERE {role}_player_id IS NOT NULL GROUP BY ALL"
        for role in given
    ]
    total = ", ".join(f"CAST(sum({m}) AS {'DOUBLE' if m.endswith('yards') else 'BIGINT'}) AS {m}" for m in [*metrics, "touchdowns"])
    return "u AS (" + " UNION ALL ".join(parts) + f"), ent AS (SELECT {keys}, player_id, {total}, min(team) AS team FROM u GROUP BY ALL)"


ENTITY_COLUMNS = ["player_id", "team", "passing_yards", "pass_attempt", "completion", "passing_td", "rushing_yards", "carry", "rushing_td_count", "red_zone_carry",
                  "goal_to_go_carry", "receiving_yards", "target", "reception", "receiving_td_count", "red_zone_target", "goal_to_go_target", "touchdowns"]


@query("entity_game_totals", f"WITH {ENRICHED_SQL}, {roles_sql('season, week, game_id')} SELECT season, week, game_id, {', '.join(ENTITY_COLUMNS)} FROM ent")
def _entity_game_totals(t) -> DataFrame:
    out = G.entity_totals(enriched(t.lineitem), ["season", "week", "game_id"])
    return out.select("season", "week", "game_id", *ENTITY_COLUMNS)


@query("entity_drive_totals", f"WITH {ENRICHED_SQL}, {roles_sql('season, week, game_id, drive')} SELECT season, week, game_id, drive, {', '.join(ENTITY_COLUMNS)} FROM ent")
def _entity_drive_totals(t) -> DataFrame:
    out = G.entity_totals(enriched(t.lineitem), ["season", "week", "game_id", "drive"])
    return out.select("season", "week", "game_id", "drive", *ENTITY_COLUMNS)


@query(
    "labelled_entity_games",
    f"""WITH {ENRICHED_SQL}, {roles_sql('season, week, game_id')},
o AS (SELECT *, rushing_td_count + receiving_td_count + passing_td AS off, greatest(touchdowns - (rushing_td_count + receiving_td_count + passing_td), 0) AS oth FROM ent)
SELECT season, week, game_id, player_id, off AS td_count_offense, rushing_td_count + receiving_td_count AS td_count_skill, off + oth AS td_count_all,
  (off > 0)::INT AS anytime_td_offense, (rushing_td_count > 0)::INT AS anytime_td_rush, (receiving_td_count > 0)::INT AS anytime_td_rec,
  (passing_td > 0)::INT AS anytime_td_pass_thrown, (off + oth > 0)::INT AS anytime_td_all, (rushing_td_count + receiving_td_count > 0)::INT AS anytime_td_skill,
  (off > 0)::INT AS anytime_td, off AS td_count FROM o""",
)
def _labelled_entity_games(t) -> DataFrame:
    out = with_labels(G.entity_totals(enriched(t.lineitem), ["season", "week", "game_id"]))
    names = [c for c in out.columns if c.startswith(("td_count", "anytime_td"))]
    return out.select("season", "week", "game_id", "player_id", *names)


for _name, _keys in (("drive_totals", ["season", "week", "game_id", "posteam", "defteam", "drive"]), ("game_totals", ["season", "week", "game_id", "posteam", "defteam"])):

    def _group(t, keys=_keys) -> DataFrame:
        return G.group_totals(enriched(t.lineitem), keys).withColumns({c: F.col(c).cast("bigint") for c in ("yards", "tds")})

    query(
        _name,
        f"WITH {ENRICHED_SQL} SELECT {', '.join(_keys)}, count(*) AS n_plays, CAST(sum(coalesce(yards_gained, 0)) AS BIGINT) AS yards, CAST(sum(touchdown) AS BIGINT) AS tds FROM e GROUP BY ALL",
    )(_group)


DRIVES_SQL = f"""{player_games_sql()},
d AS (SELECT game_id, team, player_id, season, week, count(*) AS drive_count, max(game_date) AS game_date,
  count(*) FILTER (carry + target + pass_attempt + reception > 0) AS touch_drives, count(*) FILTER (touchdowns > 0) AS td_drives,
  sum(passing_yards + rushing_yards + receiving_yards) AS total_yards, count(*) FILTER (red_zone_carry + red_zone_target > 0) AS red_zone_drives,
  count(*) FILTER (goal_to_go_carry + goal_to_go_target > 0) AS goal_to_go_drives FROM pg GROUP BY ALL)"""
DRIVE_COLUMNS = ("count", "touch_drives", "td_drives", "total_yards", "red_zone_drives", "goal_to_go_drives")


def _drive_rows(lineitem: DataFrame) -> DataFrame:
    return player_games(lineitem).withColumnRenamed("touchdowns", "touchdown")


@query("drive_summary", f"WITH {DRIVES_SQL} SELECT game_id, team, player_id, season, week, CAST(game_date AS VARCHAR) AS game_date, drive_count, touch_drives AS drive_touch_drives, td_drives AS drive_td_drives, total_yards AS drive_total_yards, red_zone_drives AS drive_red_zone_drives, goal_to_go_drives AS drive_goal_to_go_drives FROM d")
def _drive_summary(t) -> DataFrame:
    return G.drive_summary(_drive_rows(t.lineitem)).withColumn("game_date", F.col("game_date").cast("string"))


_DRIVE_HIST = {"count": "drive_count"} | {c: c for c in DRIVE_COLUMNS if c != "count"}
_DRIVE_SELECT = ", ".join(
    [f"coalesce(sum({src}) OVER wp, 0) AS p_{n}, coalesce(sum({src}) OVER w3, 0) AS l_{n}" for n, src in _DRIVE_HIST.items()]
)


@query(
    "drive_history",
    f"""WITH {DRIVES_SQL},
daily AS (SELECT player_id, team, game_date, sum(drive_count) AS drive_count, sum(touch_drives) AS touch_drives, sum(td_drives) AS td_drives, sum(total_yards) AS total_yards,
  sum(red_zone_drives) AS red_zone_drives, sum(goal_to_go_drives) AS goal_to_go_drives FROM d GROUP BY ALL),
h AS (SELECT player_id, team, game_date, lag(game_date) OVER w AS data_as_of, {_DRIVE_SELECT} FROM daily
  WINDOW w AS (PARTITION BY player_id, team ORDER BY game_date),
  wp AS (PARTITION BY player_id, team ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  w3 AS (PARTITION BY player_id, team ORDER BY game_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT player_id, team, CAST(game_date AS VARCHAR) AS game_date, CAST(data_as_of AS VARCHAR) AS data_as_of,
  {', '.join(f'CAST({s}_{n} AS DOUBLE) AS drive_hist_{n}_{w}' for n in DRIVE_COLUMNS for s, w in (('p', 'prev'), ('l', 'l3')))},
  {rs({f'drive_hist_{lab}_{w}': f'CASE WHEN {s}_count > 0 THEN {s}_{num} / {s}_count ELSE 0 END' for num, lab in (('touch_drives', 'touch_rate'), ('td_drives', 'td_rate'), ('total_yards', 'yards_per_drive'), ('red_zone_drives', 'red_zone_rate'), ('goal_to_go_drives', 'goal_to_go_rate')) for s, w in (('p', 'prev'), ('l', 'l3'))})}
FROM h""",
)
def _drive_history(t) -> DataFrame:
    """Strictly prior drive sums; games of one day are one row, so ties cannot leak."""
    summary = G.drive_summary(_drive_rows(t.lineitem))
    measures = [c for c in summary.columns if c.startswith("drive_")]
    daily = summary.groupBy("player_id", "team", "game_date").agg(*[F.sum(c).alias(c) for c in measures])
    out = G.drive_history(daily, plan=None)
    casts = {c: F.col(c).cast("double") for c in out.columns if c.startswith("drive_hist_")}
    return rounded(out.withColumns(casts | {c: F.col(c).cast("string") for c in ("game_date", "data_as_of")}))


STATS = ["target", "carry", "touchdowns"]


@query(
    "context_daily_totals",
    f"""WITH {player_games_sql('player_id', 'game_date', 'season', 'team', 'opponent', *STATS)}
SELECT CASE WHEN grouping(opponent) = 0 THEN 'vs_team' WHEN grouping(team) = 0 THEN 'with_team' ELSE 'vs_any' END AS ctx, player_id,
  CAST(game_date AS VARCHAR) AS game_date, season, CAST(team AS DOUBLE) AS team, CAST(opponent AS DOUBLE) AS opponent,
  {', '.join(f'CAST(sum({s}) AS BIGINT) AS {s}_num' for s in STATS)}, count(*) AS denom
FROM pg GROUP BY GROUPING SETS ((player_id, game_date, season), (player_id, game_date, season, opponent), (player_id, game_date, season, team))""",
)
def _context_daily_totals(t) -> DataFrame:
    rows = player_games(t.lineitem, "player_id", "game_date", "season", "team", "opponent", *STATS)
    out = G.context_totals(rows, "player_id", "game_date", {"vs_any": [], "vs_team": ["opponent"], "with_team": ["team"]}, STATS, ["season"])
    casts = {f"{s}_num": F.col(f"{s}_num").cast("bigint") for s in STATS} | {"game_date": F.col("game_date").cast("string")}
    return out.withColumns(casts | {c: F.col(c).cast("double") for c in ("team", "opponent")})


def context_sql(group: str, prefix: str, as_of: str) -> str:
    rates = {n: f"coalesce({a} / nullif({b}, 0), 0)" for n, (a, b) in G.CONTEXT_RATES.items()}
    totals = ", ".join(f"CAST(sum({s}) AS DOUBLE) AS {o}" for s, o in G.CONTEXT_SUMS.items())
    feats = ", ".join(
        f"coalesce(avg({m}) OVER w{n}, 0) AS {prefix}{m}_{'prev' if n == 1 else f'l{n}'}"
        for m, sizes in [*((m, (1, 3, 5)) for m in G.CONTEXT_RATES), *((m, (1, 3)) for m in G.CONTEXT_VOLUMES)]
        for n in sizes
    )
    return f"""{prefix}a AS (SELECT season, week, {group} AS team, max(game_date) AS game_date, {totals}, CAST(count(DISTINCT player_id) AS DOUBLE) AS skill_players_active FROM pg WHERE {group} IS NOT NULL GROUP BY ALL),
{prefix}b AS (SELECT *, pass_attempts + carries AS offensive_plays, passing_yards + rushing_yards AS total_yards, red_zone_targets + red_zone_carries AS red_zone_plays,
  goal_to_go_targets + goal_to_go_carries AS goal_to_go_plays FROM {prefix}a),
{prefix}c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in rates.items())} FROM {prefix}b),
{prefix}h AS (SELECT season, week, team, game_date, lag(game_date) OVER (PARTITION BY season, team ORDER BY game_date) AS {as_of}, {feats} FROM {prefix}c
  WINDOW w1 AS (PARTITION BY season, team ORDER BY game_date ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING),
  w3 AS (PARTITION BY season, team ORDER BY game_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY season, team ORDER BY game_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


_CTX_FEATURES = [
    f"{p}{m}_{'prev' if n == 1 else f'l{n}'}"
    for p in ("team_ctx_", "opp_ctx_")
    for m, sizes in [*((m, (1, 3, 5)) for m in G.CONTEXT_RATES), *((m, (1, 3)) for m in G.CONTEXT_VOLUMES)]
    for n in sizes
]


@query(
    "team_context_history",
    f"""WITH {player_games_sql()}, {context_sql('team', 'team_ctx_', 'data_as_of')}, {context_sql('opponent', 'opp_ctx_', 'opp_as_of')}
SELECT season, week, team, CAST(game_date AS VARCHAR) AS game_date, CAST(least(data_as_of, opp_as_of) AS VARCHAR) AS data_as_of,
  {rs({c: f'coalesce({c}, 0)' for c in _CTX_FEATURES}, 5)}
FROM team_ctx_h FULL JOIN opp_ctx_h USING (season, week, team, game_date)""",
)
def _team_context_history(t) -> DataFrame:
    out = G.context_history(player_games(t.lineitem))
    return rounded(out.withColumns({c: F.col(c).cast("string") for c in ("game_date", "data_as_of")}), 5)


_PASS_SQL = {
    "opp_def_pass_success_allowed": "avg(success)", "opp_def_pass_epa_allowed": "avg(epa)",
    "opp_def_pass_explosive_rate": "avg(CASE WHEN yards_gained >= 20 THEN 1.0 ELSE 0 END)",
    "opp_def_pass_third_down_rate": "avg(CASE WHEN down = 3 THEN 1.0 ELSE 0 END)",
    "opp_def_pass_red_zone_rate": "avg(CASE WHEN coalesce(yardline_100, 100) <= 20 THEN 1.0 ELSE 0 END)",
    "opp_def_blitz_rate": "avg(CASE WHEN number_of_pass_rushers >= 5 THEN 1.0 ELSE 0 END)",
    "opp_def_pass_box_avg": "avg(defenders_in_box)",
    "opp_def_man_rate": "avg(CASE WHEN lower(trim(defense_man_zone_type)) = 'man' THEN 1.0 ELSE 0 END)",
    "opp_def_zone_rate": "avg(CASE WHEN lower(trim(defense_man_zone_type)) = 'zone' THEN 1.0 ELSE 0 END)",
    "opp_def_two_high_rate": "avg(CASE WHEN regexp_matches(lower(defense_coverage_type), 'two|2') THEN 1.0 ELSE 0 END)",
    "opp_def_pass_rushers_avg": "avg(coalesce(number_of_pass_rushers, 0))",
    **{f"opp_def_pass_{m}_allowed_vs_{p}": f"coalesce(avg(CASE WHEN position = '{p}' THEN {m} END), 0)" for p in ("WR", "TE", "RB") for m in ("epa", "success")},
    **{f"opp_def_pass_{m}_allowed_{d}": f"coalesce(avg(CASE WHEN pass_location = '{d}' THEN {m} END), 0)" for d in ("left", "middle", "right") for m in ("epa", "success")},
}


def _positions(lineitem: DataFrame) -> DataFrame:
    return (
        plays(lineitem, "season", "week", "receiver_player_id").where("receiver_player_id is not null").distinct()
        .withColumn("position", F.expr("CASE CAST(substring(receiver_player_id, 2) AS INT) % 3 WHEN 0 THEN 'WR' WHEN 1 THEN 'TE' ELSE 'RB' END"))
        .withColumnRenamed("receiver_player_id", "player_id")
    )


_POSITION_SQL = "CASE CAST(substring(receiver_player_id, 2) AS INT) % 3 WHEN 0 THEN 'WR' WHEN 1 THEN 'TE' WHEN 2 THEN 'RB' END AS position"


@query("pass_defence_splits", f"WITH {ENRICHED_SQL}, p AS (SELECT *, {_POSITION_SQL} FROM e WHERE pass_attempt = 1) SELECT season, week, defteam, count(*) AS opp_def_pass_plays, {rs(_PASS_SQL)} FROM p GROUP BY ALL")
def _pass_defence_splits(t) -> DataFrame:
    flagged = P.with_situation(enriched(t.lineitem))
    out = G.pass_splits(flagged, _positions(t.lineitem))
    return rounded(out.select("season", "week", "defteam", "opp_def_pass_plays", *_PASS_SQL))


_RUSH_SQL = {
    "opp_def_rush_success_allowed": "coalesce(avg(success), 0)", "opp_def_rush_epa_allowed": "coalesce(avg(epa), 0)",
    "opp_def_rush_stuff_rate": "avg(CASE WHEN yards_gained <= 0 THEN 1.0 ELSE 0 END)", "opp_def_rush_explosive_rate": "avg(CASE WHEN yards_gained >= 10 THEN 1.0 ELSE 0 END)",
    "opp_def_rush_red_zone_rate": "avg(CASE WHEN coalesce(yardline_100, 100) <= 20 THEN 1.0 ELSE 0 END)",
    "opp_def_rush_goal_line_rate": "avg(CASE WHEN coalesce(yardline_100, 100) <= 5 OR goal_to_go = 1 THEN 1.0 ELSE 0 END)",
    "opp_def_light_box_rate": "avg(CASE WHEN defenders_in_box <= 6 THEN 1.0 ELSE 0 END)", "opp_def_heavy_box_rate": "avg(CASE WHEN defenders_in_box >= 8 THEN 1.0 ELSE 0 END)",
    "opp_def_run_expected_rate": "avg(CASE WHEN xpass <= 0.40 THEN 1.0 ELSE 0 END)",
}


def _rush_splits(lineitem: DataFrame) -> DataFrame:
    flagged = P.with_situation(enriched(lineitem)).withColumn("rush_attempt", F.col("carry"))
    return G.rush_splits(flagged)


@query("rush_defence_splits", f"WITH {ENRICHED_SQL} SELECT season, week, defteam, count(*) AS opp_def_rush_plays, {rs(_RUSH_SQL)} FROM e WHERE carry = 1 GROUP BY ALL")
def _rush_defence_splits(t) -> DataFrame:
    return rounded(_rush_splits(t.lineitem))


@query(
    "defence_split_history",
    f"""WITH {ENRICHED_SQL}, s AS (SELECT season, week, defteam, CAST(count(*) AS DOUBLE) AS opp_def_rush_plays, {', '.join(f'{e} AS {n}' for n, e in _RUSH_SQL.items())} FROM e WHERE carry = 1 GROUP BY ALL)
SELECT season, week, defteam, {rs({f'{n}_{lab}': f'avg({n}) OVER w{k}' for n in ['opp_def_rush_plays', *_RUSH_SQL] for k, lab in ((1, 'prev'), (3, 'l3'))})} FROM s
WINDOW w1 AS (PARTITION BY defteam ORDER BY season, week ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY defteam ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def _defence_split_history(t) -> DataFrame:
    return rounded(G.split_history(_rush_splits(t.lineitem)))


_PROFILE_SQL = {
    "games": "count(DISTINCT game_id)", "dropbacks": "sum(qb_dropback)", "pass_attempts": "sum(pass_attempt)", "completions": "sum(completion)",
    "pass_yards": "sum(coalesce(passing_yards, 0))", "pass_epa": "sum(epa)", "pass_success_rate": "avg(success)", "avg_air_yards": "avg(air_yards)",
    "median_air_yards": "median(air_yards)", "deep_attempt_rate": "avg(CASE WHEN air_yards >= 15 THEN 1.0 ELSE 0 END)",
    "short_attempt_rate": "avg(CASE WHEN air_yards <= 0 THEN 1.0 ELSE 0 END)", "scrambles": "sum(qb_scramble)", "shotgun_rate": "avg(shotgun)",
    "no_huddle_rate": "avg(coalesce(no_huddle, 0))", "avg_xpass": "avg(xpass)",
    "completion_rate": "sum(completion) / nullif(sum(pass_attempt), 0)", "pass_yards_per_attempt": "sum(coalesce(passing_yards, 0)) / nullif(sum(pass_attempt), 0)",
    "pass_epa_per_dropback": "sum(epa) / nullif(sum(qb_dropback), 0)", "scramble_rate": "sum(qb_scramble) / nullif(sum(qb_dropback), 0)",
}


@query("passing_profile", f"WITH {ENRICHED_SQL} SELECT season, week, passer_player_id, {rs({'qb_' + n: e for n, e in _PROFILE_SQL.items()}, 5)} FROM e WHERE passer_player_id IS NOT NULL GROUP BY ALL")
def _passing_profile(t) -> DataFrame:
    out = G.passing_profile(enriched(t.lineitem), ["season", "week", "passer_player_id"], "qb_").drop("game_date")
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.startswith("qb_")}), 5)


@query(
    "rushing_profile",
    f"""WITH {ENRICHED_SQL} SELECT season, week, rusher_player_id, {rs({'rush_attempts': 'sum(carry)', 'rush_yards': 'sum(coalesce(rushing_yards, 0))', 'rush_tds': 'sum(rush_touchdown)', 'rush_success_rate': 'avg(success)', 'rush_yards_per_attempt': 'sum(coalesce(rushing_yards, 0)) / nullif(sum(carry), 0)', 'rush_touchdown_rate': 'sum(rush_touchdown) / nullif(sum(carry), 0)'})}
FROM e WHERE rusher_player_id IS NOT NULL GROUP BY ALL""",
)
def _rushing_profile(t) -> DataFrame:
    out = G.rushing_profile(enriched(t.lineitem), ["season", "week", "rusher_player_id"])
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.startswith("rush_")}))


@query(
    "profile_lags",
    f"""WITH {ENRICHED_SQL}, p AS (SELECT season, posteam AS team, week, avg(success) AS sr, sum(epa) / nullif(sum(qb_dropback), 0) AS epd, max(game_date) AS gd FROM e WHERE passer_player_id IS NOT NULL GROUP BY ALL)
SELECT season, team, week, CAST(lag(gd) OVER w AS VARCHAR) AS data_as_of, {rs({'sr_prev': 'avg(sr) OVER w1', 'sr_l3': 'avg(sr) OVER w3', 'epd_prev': 'avg(epd) OVER w1', 'epd_l3': 'avg(epd) OVER w3'})}
FROM p WINDOW w AS (PARTITION BY season, team ORDER BY week), w1 AS (PARTITION BY season, team ORDER BY week ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING),
  w3 AS (PARTITION BY season, team ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def _profile_lags(t) -> DataFrame:
    e = enriched(t.lineitem).withColumn("team", F.col("posteam"))
    p = G.passing_profile(e, ["season", "team", "week"]).select("season", "team", "week", "game_date", F.col("pass_success_rate").alias("sr"), F.col("pass_epa_per_dropback").alias("epd"))
    out = G.lagged_means(p, ["season", "team"], "week", {"sr": (1, 3), "epd": (1, 3)}, as_of="data_as_of")
    return rounded(out.drop("sr", "epd", "game_date").withColumn("data_as_of", F.col("data_as_of").cast("string")))


_PACE_SQL = f"""{plays_sql()}, pc AS (SELECT season, week, posteam, coalesce(avg(coalesce(no_huddle, 0)), 0) AS nh, coalesce(avg(pass_oe), 0) AS proe,
  coalesce(avg(CASE WHEN abs(score_differential) <= 10 AND half_seconds_remaining > 120 THEN pass END), 0.5) AS npr,
  count(*) FILTER (abs(score_differential) <= 10 AND half_seconds_remaining > 120) AS neutral_plays
FROM plays WHERE posteam IS NOT NULL AND qtr <= 4 AND coalesce(qb_spike, 0) = 0 AND coalesce(qb_kneel, 0) = 0 AND week <= 18 GROUP BY ALL)"""
_PACE = {"team_pace_no_huddle_rate": "nh", "team_pace_proe": "proe", "team_pace_neutral_pass_rate": "npr"}


@query("pace_metrics", f"WITH {_PACE_SQL} SELECT season, week, posteam, neutral_plays, {rs(_PACE)} FROM pc")
def _pace_metrics(t) -> DataFrame:
    return rounded(G.pace_metrics(plays(t.lineitem), ["season", "week", "posteam"]))


@query(
    "pace_history",
    f"""WITH {_PACE_SQL} SELECT season, week, posteam, {rs({f'{n}_{lab}': f'avg({c}) OVER w{k}' for n, c in _PACE.items() for k, lab in ((1, 'prev'), (3, 'l3'), (5, 'l5'))})} FROM pc
WINDOW w1 AS (PARTITION BY season, posteam ORDER BY week ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY season, posteam ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY season, posteam ORDER BY week ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def _pace_history(t) -> DataFrame:
    pace = G.pace_metrics(plays(t.lineitem), ["season", "week", "posteam"]).withColumn("game_date", F.col("week"))
    return rounded(G.pace_history(pace).drop("game_date"))


# Players on the field: two aligned lists built from the row's own keys.
_FIELD_IDS = "concat_ws(';', concat('W', CAST(l_partkey % 90 AS VARCHAR(9))), concat('R', CAST(l_suppkey % 60 AS VARCHAR(9))), concat('Q', CAST(l_linenumber AS VARCHAR(9))))"
_FIELD_POS = "CASE WHEN l_partkey % 13 = 0 THEN 'WR;RB' ELSE concat_ws(';', CASE l_partkey % 90 % 3 WHEN 0 THEN 'WR' WHEN 1 THEN ' te' ELSE 'RB' END, 'RB', 'QB') END"
_FIELD = {"season": "year(l_shipdate)", "team": "l_suppkey % 32", "game_id": "l_orderkey", "play_id": "l_linenumber * 100000 + l_partkey",
          "offense_players": _FIELD_IDS, "offense_positions": _FIELD_POS, "receiver": "concat('W', CAST(l_partkey % 90 AS VARCHAR(9)))",
          "pass_location": "CASE l_partkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'middle' WHEN 2 THEN 'right' END", "route": "CASE l_partkey % 3 WHEN 0 THEN 'slant' WHEN 1 THEN 'GO' END",
          "is_target": "CASE WHEN l_partkey % 5 <> 0 THEN 1 ELSE 0 END"}
_FIELD_SQL = "fp AS (SELECT DISTINCT " + ", ".join(f"{e} AS {n}" for n, e in _FIELD.items()) + """ FROM lineitem WHERE l_returnflag <> 'A'),
x AS (SELECT season, team, game_id, play_id, unnest(string_split(offense_players, ';')) AS player_id, upper(trim(unnest(string_split(offense_positions, ';')))) AS off_position
  FROM fp WHERE len(string_split(offense_players, ';')) = len(string_split(offense_positions, ';'))),
field AS (SELECT * FROM x WHERE off_position IN ('WR', 'TE', 'RB', 'HB', 'FB'))"""


def _field_frames(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = lineitem.where("l_returnflag <> 'A'").selectExpr(*[f"{e} AS {n}" for n, e in _FIELD.items()]).distinct()
    return rows, G.on_field(rows, ["season", "team", "game_id", "play_id"])


@query(
    "route_participation",
    f"""WITH {_FIELD_SQL}, tot AS (SELECT season, team, count(DISTINCT (game_id, play_id)) AS d FROM fp GROUP BY ALL)
SELECT f.season, f.team, f.player_id, count(DISTINCT (f.game_id, f.play_id)) AS ps_route_participation_plays, any_value(tot.d) AS ps_team_dropbacks,
  {r('count(DISTINCT (f.game_id, f.play_id)) / any_value(tot.d)', 'ps_route_participation_pct')} FROM field f JOIN tot USING (season, team) GROUP BY f.season, f.team, f.player_id""",
)
def _route_participation(t) -> DataFrame:
    rows, field = _field_frames(t.lineitem)
    return rounded(G.participation(rows, ["season", "team"], ["game_id", "play_id"], field))


_ALIGN_SQL = """CASE WHEN off_position = 'TE' THEN 'inline' WHEN off_position IN ('RB', 'HB', 'FB') THEN 'backfield'
  WHEN off_position = 'WR' AND (upper(coalesce(pass_location, '')) = 'MIDDLE' OR upper(trim(coalesce(route, ''))) IN ('SLANT','IN/DIG','SHALLOW CROSS/DRAG','SCREEN','QUICK OUT','HITCH/CURL','TEXAS/ANGLE')) THEN 'slot' ELSE 'wide' END"""


@query(
    "target_alignment_shares",
    f"""WITH {_FIELD_SQL}, j AS (SELECT f.season, f.team, f.player_id, {_ALIGN_SQL} AS a FROM fp JOIN field f ON fp.season = f.season AND fp.team = f.team AND fp.game_id = f.game_id
  AND fp.play_id = f.play_id AND fp.receiver = f.player_id WHERE fp.is_target = 1)
SELECT season, team, player_id, count(*) AS ps_targets_total, {', '.join(f"count(*) FILTER (a = '{a}') AS ps_targets_{a}_count" for a in G.ALIGNMENTS)},
  {rs({f'ps_targets_{a}_share': f"count(*) FILTER (a = '{a}') / count(*)" for a in G.ALIGNMENTS})} FROM j GROUP BY ALL""",
)
def _target_alignment_shares(t) -> DataFrame:
    rows, field = _field_frames(t.lineitem)
    targets = rows.where("is_target = 1").withColumnRenamed("receiver", "player_id")
    return rounded(G.alignment_shares(targets, field, ["season", "team"], ["game_id", "play_id"]))


@query(
    "scripted_plays",
    f"""WITH {plays_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY season, posteam ORDER BY game_date, game_id, play_id, amount) - 1 AS rk FROM plays)
SELECT season, posteam, count(*) FILTER (rk < 20 AND 3600 - game_seconds_remaining <= 1200 AND NOT (qtr IN (2, 4) AND quarter_seconds_remaining <= 120)
  AND NOT (coalesce(no_huddle, 0) = 1 AND quarter_seconds_remaining < 240) AND coalesce(down, 1) IN (1, 2)) AS scripted, CAST(max(rk) AS BIGINT) AS last_rank FROM k GROUP BY ALL""",
)
def _scripted_plays(t) -> DataFrame:
    flagged = G.scripted_flags(plays(t.lineitem), ["season", "posteam"], ["game_date", "game_id", "play_id", "amount"])
    return flagged.groupBy("season", "posteam").agg(F.sum("is_scripted_play").cast("bigint").alias("scripted"), F.max("offense_play_rank").cast("bigint").alias("last_rank"))


@query(
    "primary_entity",
    f"WITH {ENRICHED_SQL}, s AS (SELECT season, week, posteam, passer_player_id, sum(pass_attempt) AS a FROM e WHERE passer_player_id IS NOT NULL GROUP BY ALL) SELECT season, week, posteam, max_by(passer_player_id, (a, passer_player_id)) AS primary_qb_id FROM s GROUP BY ALL",
)
def _primary_entity(t) -> DataFrame:
    e = enriched(t.lineitem).where("passer_player_id is not null")
    return G.primary_by(e, ["season", "week", "posteam"], "passer_player_id", "pass_attempt", "primary_qb_id")


@query("most_frequent_label", "WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, min_by(p, (-n, p)) AS priority FROM c GROUP BY 1")
def _most_frequent_label(t) -> DataFrame:
    return G.most_frequent(t.orders, ["o_custkey"], "o_orderpriority", "priority")


_LABELS = {
    "rec_success_rate_label": ("reception", "target", True), "rush_success_rate_label": ("rush_success_plays", "carry", True), "yards_per_target_label": ("receiving_yards", "target", False),
    "yards_per_catch_label": ("receiving_yards", "reception", False), "air_yards_per_catch_label": ("air_yards_total", "reception", False),
    "yac_per_catch_label": ("yards_after_catch_total", "reception", False), "air_yards_per_target_label": ("air_yards_all_targets", "target", False),
    "yards_per_carry_label": ("rushing_yards", "carry", False), "td_per_target_label": ("receiving_td_count", "target", True), "td_per_carry_label": ("rushing_td_count", "carry", True),
    "td_per_rz_carry_label": ("rushing_td_count", "red_zone_carry", True), "td_per_gl_carry_label": ("rushing_td_count", "goal_to_go_carry", True),
}
_LABEL_SQL = {n: (f"least(greatest({a} / ({b} + 1e-6), 0), 1)" if c else f"{a} / ({b} + 1e-6)") for n, (a, b, c) in _LABELS.items()}


@query(
    "label_ratios",
    f"""WITH {player_games_sql()}, w AS (SELECT *, sum(target) OVER k AS tt, sum(carry) OVER k AS tc FROM pg WINDOW k AS (PARTITION BY season, week, team, game_id)),
f AS (SELECT season, week, team, player_id, {', '.join(f'{e} AS {n}' for n, e in _LABEL_SQL.items())}, least(greatest(target / (tt + 1e-6), 0), 1) AS target_share_label, least(greatest(carry / (tc + 1e-6), 0), 1) AS carry_share_label FROM w)
SELECT * FROM f""",
)
def _label_ratios(t) -> DataFrame:
    labelled = G.with_label_ratios(player_games(t.lineitem))
    return labelled.select("season", "week", "team", "player_id", *_LABELS, "target_share_label", "carry_share_label")


@query(
    "vacated_usage",
    f"""WITH {player_games_sql('season', 'week', 'team', 'position', 'player_id', 'target', 'carry')}, g AS (SELECT season, week, team, position, sum(target) AS vt, sum(carry) AS vc FROM pg WHERE player_id % 7 = 0 GROUP BY ALL)
SELECT p.season, p.team, p.position, count(*) AS n, CAST(sum(coalesce(vt, 0)) AS BIGINT) AS vacated_targets, CAST(sum(coalesce(vc, 0)) AS BIGINT) AS vacated_carries
FROM pg p LEFT JOIN g ON p.season = g.season AND p.week = g.week AND p.team = g.team AND p.position = g.position GROUP BY ALL""",
)
def _vacated_usage(t) -> DataFrame:
    rows = player_games(t.lineitem, "season", "week", "team", "position", "player_id", "target", "carry")
    out = G.vacated_usage(rows, F.col("player_id") % 7 == 0, {"vt": "target", "vc": "carry"})
    return out.groupBy("season", "team", "position").agg(F.count(F.lit(1)).alias("n"), F.sum("vt").cast("bigint").alias("vacated_targets"), F.sum("vc").cast("bigint").alias("vacated_carries"))


@query(
    "offense_lag_means",
    f"""WITH {player_games_sql('season', 'week', 'team', 'red_zone_target', 'touchdowns')}, u AS (SELECT season, week, team, team % 5 AS coord, CAST(sum(red_zone_target) AS DOUBLE) AS rz, CAST(sum(touchdowns) AS DOUBLE) AS td FROM pg GROUP BY ALL),
l AS (SELECT *, lag(rz) OVER w AS rz_prev, lag(td) OVER w AS td_prev FROM u WINDOW w AS (PARTITION BY season, team ORDER BY week))
SELECT season, week, team, coord, rz_prev, td_prev, {rs({'team_rz_l3': 'avg(rz_prev) OVER a', 'team_td_l3': 'avg(td_prev) OVER a', 'coord_rz_l3': 'avg(rz_prev) OVER b', 'coord_td_l3': 'avg(td_prev) OVER b'})} FROM l
WINDOW a AS (PARTITION BY season, team ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY season, coord ORDER BY week, team ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _offense_lag_means(t) -> DataFrame:
    u = player_games(t.lineitem, "season", "week", "team", "red_zone_target", "touchdowns").groupBy("season", "week", "team").agg(
        F.sum("red_zone_target").cast("double").alias("rz"), F.sum("touchdowns").cast("double").alias("td")
    ).withColumn("coord", F.col("team") % 5)
    out = G.offense_history(u, ["rz", "td"], {"team": ["season", "team"], "coord": ["season", "coord"]})
    return rounded(out.drop("rz", "td"))


@query(
    "inactivity_history",
    """WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_inactive, CAST(substring(o_orderpriority, 1, 1) AS INT) AS d FROM orders)
SELECT o_orderkey, CAST(coalesce(sum(is_inactive) OVER w5, 0) AS BIGINT) AS recent_inactivity_count, CAST(coalesce(lag(is_inactive) OVER w, 0) AS BIGINT) AS was_inactive_last_game,
  CAST(coalesce(lag(d) OVER w - d, 0) AS BIGINT) AS depth_chart_mobility FROM o
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w5 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def _inactivity_history(t) -> DataFrame:
    o = t.orders.selectExpr("o_custkey", "o_orderdate", "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_inactive", "CAST(substring(o_orderpriority, 1, 1) AS INT) AS depth_chart_order")
    out = G.inactivity_history(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("recent_inactivity_count", "was_inactive_last_game", "depth_chart_mobility")])


@query(
    "prior_event_rate",
    f"""WITH {player_games_sql('season', 'week', 'player_id', 'team', 'touchdowns')}, u AS (SELECT *, season * 100 + week AS unit, CASE WHEN touchdowns > 1 THEN 1.0 ELSE 0 END AS hit FROM pg),
k AS (SELECT player_id, unit, sum(hit) AS s, count(*) AS n FROM u GROUP BY ALL)
SELECT player_id, unit, {r('sum(s) OVER w / nullif(sum(n) OVER w, 0)', 'prior')}, n FROM k WINDOW w AS (PARTITION BY player_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _prior_event_rate(t) -> DataFrame:
    u = player_games(t.lineitem, "season", "week", "player_id", "touchdowns").selectExpr("player_id", "season * 100 + week AS unit", "CASE WHEN touchdowns > 1 THEN 1.0D ELSE 0.0D END AS hit")
    out = G.prior_event_rate(u, ["player_id"], "unit", "hit", "prior")
    return rounded(out.groupBy("player_id", "unit").agg(F.max("prior").alias("prior"), F.count(F.lit(1)).alias("n")))


@query(
    "pivot_flag_shares",
    "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1",
)
def _pivot_flag_shares(t) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count()
    return counts.select("l_suppkey", *[nz(c).alias(c) for c in ("A", "N", "R")])


@query(
    "shifted_target",
    "SELECT o_custkey, o_orderkey, lead(o_totalprice) OVER w AS next_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY next_price IS NOT NULL",
)
def _shifted_target(t) -> DataFrame:
    from ..functions.expectations import shifted_target

    out = shifted_target(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", -1, "next_price")
    return out.select("o_custkey", "o_orderkey", "next_price")


@query(
    "lag_and_halo_means",
    f"""SELECT o_orderkey, {rs({'m3': 'avg(o_totalprice) OVER w3', 'sd5': 'CASE WHEN count(*) OVER w5 >= 2 THEN stddev_samp(o_totalprice) OVER w5 END', 'mx5': 'max(o_totalprice) OVER w5', 'mn5': 'min(o_totalprice) OVER w5'}, 4)} FROM orders
WINDOW w3 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def _lag_and_halo_means(t) -> DataFrame:
    from ..operators.prior import last_rows

    out = prior_rows(
        t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], 5,
        lambda w: {"m3": F.avg("o_totalprice").over(last_rows(w, 3)), "sd5": F.stddev_samp("o_totalprice").over(last_rows(w, 5)), "mx5": F.max("o_totalprice").over(last_rows(w, 5)), "mn5": F.min("o_totalprice").over(last_rows(w, 5))},
    )
    return rounded(out.select("o_orderkey", "m3", "sd5", "mx5", "mn5"), 4)
