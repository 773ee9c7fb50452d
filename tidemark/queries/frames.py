"""Play-by-play shaped inputs derived from the supplied tables.

These column mappings are input preparation only, written once as expressions that Spark and
DuckDB both read; the operators under test never appear here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.slices import spread

# One row per line item, seen as an event of a game between two groups.
PLAYS = {
    "game_id": "l_orderkey",
    "play_id": "l_linenumber",
    "season": "year(l_shipdate)",
    "week": "month(l_shipdate)",
    "game_date": "CAST(l_shipdate AS DATE)",
    "posteam": "concat('T', CAST(l_suppkey % 32 AS VARCHAR(9)))",
    "defteam": "concat('T', CAST(l_partkey % 32 AS VARCHAR(9)))",
    "drive": "l_linenumber % 3",
    "qtr": "l_partkey % 5 + 1",
    "down": "l_linenumber % 4 + 1",
    "ydstogo": "CAST(l_quantity AS INT) % 15",
    "yardline_100": "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey % 100 END",
    "goal_to_go": "CASE WHEN l_partkey % 100 <= 8 THEN 1 ELSE 0 END",
    "half_seconds_remaining": "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE (l_orderkey * 7 + l_partkey) % 1800 END",
    "game_seconds_remaining": "(l_orderkey * 7 + l_partkey) % 3600",
    "quarter_seconds_remaining": "(l_orderkey * 7 + l_partkey) % 900",
    "score_differential": "CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE l_suppkey % 41 - 20 END",
    "no_huddle": "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 WHEN l_linenumber = 2 THEN NULL ELSE 0 END",
    "xpass": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 10 END",
    "pass_oe": "l_tax - l_discount",
    "defenders_in_box": "CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_quantity AS INT) % 10 END",
    "number_of_pass_rushers": "l_linenumber",
    "defense_man_zone_type": "CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linestatus = 'O' THEN ' Man' ELSE 'ZONE ' END",
    "defense_coverage_type": "CASE WHEN l_partkey % 3 = 0 THEN 'COVER_2' WHEN l_partkey % 3 = 1 THEN 'Two_Man' ELSE 'COVER_1' END",
    "was_pressure": "CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END",
    "pass": "CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END",
    "rush": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END",
    "complete_pass": "CASE WHEN l_returnflag <> 'A' AND l_quantity > 15 THEN 1 ELSE 0 END",
    "incomplete_pass": "CASE WHEN l_returnflag <> 'A' AND l_quantity < 12 THEN 1 ELSE 0 END",
    "passer_player_id": "CASE WHEN l_returnflag <> 'A' THEN concat('P', CAST(l_suppkey % 60 AS VARCHAR(9))) END",
    "rusher_player_id": "CASE WHEN l_returnflag = 'A' THEN concat(CASE WHEN l_partkey % 9 = 0 THEN 'P' ELSE 'R' END, CAST(l_suppkey % 60 AS VARCHAR(9))) END",
    "receiver_player_id": "CASE WHEN l_returnflag <> 'A' AND l_partkey % 5 <> 0 THEN concat('W', CAST(l_partkey % 90 AS VARCHAR(9))) END",
    "yards_gained": "CAST(l_quantity AS INT) - 10",
    "air_yards": "CASE WHEN l_returnflag <> 'A' AND l_linenumber <> 6 THEN CAST(l_quantity AS INT) - 12 END",
    "yards_after_catch": "CASE WHEN l_returnflag <> 'A' AND l_quantity > 15 THEN CAST(l_quantity AS INT) % 7 END",
    "epa": "l_tax - l_discount + CAST(l_quantity AS INT) % 5",
    "success": "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END",
    "qb_dropback": "CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END",
    "qb_scramble": "CASE WHEN l_returnflag = 'N' AND l_partkey % 11 = 0 THEN 1 ELSE 0 END",
    "shotgun": "l_partkey % 2",
    "qb_spike": "CASE WHEN l_partkey % 101 = 0 THEN 1 ELSE 0 END",
    "qb_kneel": "CASE WHEN l_partkey % 103 = 0 THEN 1 ELSE 0 END",
    "interception": "CASE WHEN l_returnflag <> 'A' AND l_extendedprice < 4000 THEN 1 ELSE 0 END",
    "fumble": "CASE WHEN l_extendedprice BETWEEN 4000 AND 6000 THEN 1 ELSE 0 END",
    "sack": "CASE WHEN l_returnflag = 'N' AND l_tax = 0 THEN 1 ELSE 0 END",
    "penalty": "CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END",
    "rush_touchdown": "CASE WHEN l_returnflag = 'A' AND l_extendedprice > 80000 THEN 1 ELSE 0 END",
    "pass_touchdown": "CASE WHEN l_returnflag <> 'A' AND l_extendedprice > 85000 THEN 1 ELSE 0 END",
    "return_touchdown": "CASE WHEN l_partkey % 211 = 0 THEN 1 ELSE 0 END",
    "returner_player_id": "concat('K', CAST(l_suppkey % 7 AS VARCHAR(9)))",
    "td_player_id": "CASE WHEN l_partkey % 307 = 0 THEN concat('D', CAST(l_suppkey % 7 AS VARCHAR(9))) END",
    "pass_location": "CASE l_partkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'middle' WHEN 2 THEN 'right' END",
    "route": "CASE l_partkey % 3 WHEN 0 THEN 'slant' WHEN 1 THEN 'GO' END",
    "amount": "l_extendedprice",
}


def plays(lineitem: DataFrame, *names: str) -> DataFrame:
    chosen = names or tuple(PLAYS)
    return spread(lineitem, ["l_orderkey", "l_partkey"]).selectExpr(*[f"{PLAYS[n]} AS {n}" for n in chosen])


def plays_sql(*names: str, table: str = "plays") -> str:
    chosen = names or tuple(PLAYS)
    return f"{table} AS (SELECT " + ", ".join(f"{PLAYS[n]} AS {n}" for n in chosen) + " FROM lineitem)"


# One row per line item of a customer order, seen as a finished player-game row.
PLAYER_GAMES = {
    "game_id": "l_orderkey",
    "season": "year(l_shipdate)",
    "week": "month(l_shipdate)",
    "player_id": "l_partkey % 150",
    "position": "CASE l_partkey % 150 % 6 WHEN 0 THEN 'RB' WHEN 1 THEN 'WR' WHEN 2 THEN 'TE' WHEN 3 THEN 'QB' WHEN 4 THEN 'FB' ELSE 'K' END",
    "team": "l_suppkey % 32",
    "opponent": "l_partkey % 32",
    "game_date": "CAST(l_shipdate AS DATE)",
    "target": "CAST(l_quantity AS INT) % 9",
    "reception": "CAST(l_quantity AS INT) % 5",
    "carry": "CAST(l_quantity AS INT) % 11",
    "pass_attempt": "CAST(l_quantity AS INT) % 13",
    "completion": "CAST(l_quantity AS INT) % 7",
    "red_zone_target": "CAST(l_quantity AS INT) % 3",
    "red_zone_carry": "CAST(l_quantity AS INT) % 4",
    "goal_to_go_target": "CAST(l_quantity AS INT) % 2",
    "goal_to_go_carry": "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END",
    "passing_yards": "l_quantity * 3",
    "rushing_yards": "l_quantity * 2",
    "receiving_yards": "l_quantity * 5",
    "passing_td": "CASE WHEN l_extendedprice > 90000 THEN 1 ELSE 0 END",
    "rushing_td_count": "CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END",
    "receiving_td_count": "CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END",
    "touchdowns": "CASE WHEN l_discount > 0.06 THEN 2 WHEN l_tax > 0.05 THEN 1 ELSE 0 END",
    "rush_success_plays": "CAST(l_quantity AS INT) % 3",
    "air_yards_total": "l_quantity + 1",
    "air_yards_all_targets": "l_quantity * 2 - 7",
    "yards_after_catch_total": "l_quantity / 4",
}


def player_games(lineitem: DataFrame, *names: str) -> DataFrame:
    chosen = names or tuple(PLAYER_GAMES)
    return spread(lineitem, ["l_orderkey", "l_partkey"]).selectExpr(*[f"{PLAYER_GAMES[n]} AS {n}" for n in chosen])


def player_games_sql(*names: str, table: str = "pg") -> str:
    chosen = names or tuple(PLAYER_GAMES)
    return f"{table} AS (SELECT " + ", ".join(f"{PLAYER_GAMES[n]} AS {n}" for n in chosen) + " FROM lineitem)"


def _pct(seed: int, modulus: int, null_every: int) -> str:
    """A share between 0 and 1 that depends on the part key, NULL now and then."""
    return f"CASE WHEN p_partkey % {null_every} = 0 THEN NULL ELSE CAST(p_partkey * {seed} % {modulus} AS DOUBLE) / {modulus} END"


# One row per part, seen as a player with finished history columns.
PLAYERS = {
    "player_id": "p_partkey",
    "position": "CASE p_partkey % 8 WHEN 0 THEN 'RB' WHEN 1 THEN 'WR' WHEN 2 THEN 'TE' WHEN 3 THEN 'QB' WHEN 4 THEN 'FB' WHEN 5 THEN 'HB' WHEN 6 THEN 'K' ELSE 'WR' END",
    "depth_chart_position": "CASE p_partkey % 5 WHEN 0 THEN 'FB' WHEN 1 THEN 'P' ELSE 'WR' END",
    "hist_carry_share_l3": _pct(7, 97, 13),
    "hist_carry_share_prev": _pct(11, 89, 17),
    "hist_target_share_l3": _pct(5, 211, 19),
    "hist_target_share_prev": _pct(3, 223, 23),
    "hist_red_zone_target_share_l3": _pct(13, 101, 11),
    "hist_goal_to_go_target_share_l3": _pct(17, 103, 29),
    "hist_red_zone_carry_share_l3": _pct(19, 107, 31),
    "hist_goal_to_go_carry_share_l3": _pct(23, 109, 7),
    "snap_offense_pct_l3": _pct(29, 113, 37),
    "snap_offense_pct_prev": _pct(31, 127, 41),
    "snap_st_pct_l3": _pct(59, 131, 43),
    "snap_volatility_cv_l5": _pct(37, 131, 43),
    "max_snap_pct_l5": _pct(41, 137, 47),
    "depth_chart_order": "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_partkey % 4 + 1 END",
    "team_ctx_pass_rate_l3": _pct(43, 139, 59),
    "team_ctx_carries_l3": "CASE WHEN p_partkey % 61 = 0 THEN NULL ELSE CAST(p_partkey % 80 AS DOUBLE) END",
    "team_ctx_offensive_plays_l3": "CAST(p_partkey % 70 + 10 AS DOUBLE)",
    "team_ctx_offensive_plays_prev": "CAST(p_partkey % 60 + 5 AS DOUBLE)",
    "opp_ctx_offensive_plays_l3": "CAST(p_partkey % 50 + 20 AS DOUBLE)",
    "opp_ctx_offensive_plays_prev": "CAST(p_partkey % 40 + 20 AS DOUBLE)",
    "team_ctx_red_zone_play_rate_l3": _pct(47, 149, 67),
    "team_ctx_goal_to_go_play_rate_l3": _pct(53, 151, 71),
    "opp_ctx_red_zone_play_rate_l3": _pct(61, 157, 73),
    "opp_ctx_td_per_play_l3": _pct(67, 163, 79),
    "opp_ctx_rush_rate_l3": _pct(71, 167, 83),
    "qb_profile_scramble_rate_l3": _pct(73, 173, 89),
    "qb_profile_team_rush_attempts_l3": "CAST(p_partkey % 12 AS DOUBLE)",
    "qb_profile_team_dropbacks_l3": "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(p_partkey % 45 AS DOUBLE) END",
    "qb_profile_avg_air_yards_l3": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 18 AS DOUBLE) END",
    "ps_hist_route_participation_plays_l3": "CAST(p_partkey % 40 AS DOUBLE)",
    "ps_hist_route_participation_pct_l3": _pct(79, 179, 31),
    "ps_hist_targets_slot_share_l3": _pct(83, 181, 29),
    "ps_hist_targets_wide_share_l3": _pct(89, 191, 23),
    "is_inactive": "CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END",
    "team": "CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END",
    "home_team": "CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'C' END",
    "away_team": "'B'",
    "total_line": "CASE WHEN p_partkey % 101 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + 20.5 END",
    "spread_line": "CAST(p_size AS DOUBLE) / 4 - 6",
    "market_anytime_td_spread": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END",
    "hist_air_yards_sum_l3": "CAST(p_partkey % 90 AS DOUBLE)",
    "hist_targets_l3": "CAST(p_partkey % 9 AS DOUBLE)",
    "hist_air_yards_sum_l5": "CAST(p_partkey % 170 AS DOUBLE)",
    "hist_targets_l5": "CAST(p_partkey % 19 AS DOUBLE)",
    "air_yards_prev_game": "CAST(p_partkey % 50 AS DOUBLE)",
    "targets_prev_game": "CAST(p_partkey % 6 AS DOUBLE)",
    "hist_catch_rate_l5": _pct(97, 193, 101),
    "hist_targets_count_l5": "CAST(p_partkey % 31 AS INT)",
    "injury_practice_status_day1": "CASE p_partkey % 4 WHEN 0 THEN 'DNP' WHEN 1 THEN 'Limited' WHEN 2 THEN 'FP' END",
    "injury_practice_status_day2": "CASE p_partkey % 5 WHEN 0 THEN 'dnp' WHEN 1 THEN 'LP' WHEN 2 THEN 'Full' ELSE 'Limited' END",
    "injury_practice_status_day3": "CASE p_partkey % 3 WHEN 0 THEN 'LP' ELSE 'Full' END",
    "status": "CASE p_partkey % 6 WHEN 0 THEN 'ACTIVATED' WHEN 1 THEN 'IR-R' WHEN 2 THEN 'Reserve/x' WHEN 3 THEN 'CUT' ELSE 'ACT' END",
    "injury_game_designation": "CASE p_partkey % 10 WHEN 0 THEN 'Out' WHEN 1 THEN 'doubtful' WHEN 2 THEN 'Questionable' WHEN 3 THEN '' END",
    "injury_report_status": "CASE p_partkey % 14 WHEN 0 THEN 'Out' WHEN 1 THEN 'Doubtful' END",
    "injury_practice_status": "CASE p_partkey % 5 WHEN 0 THEN 'DID NOT PARTICIPATE' WHEN 1 THEN 'LIMITED' WHEN 2 THEN 'FULL' END",
    "injury_practice_dnp_count": "p_partkey % 4",
    "injury_inactive_probability_model": _pct(101, 197, 5),
}


def players(part: DataFrame, *names: str) -> DataFrame:
    chosen = names or tuple(PLAYERS)
    return part.selectExpr(*[f"{PLAYERS[n]} AS {n}" for n in chosen])


def players_sql(*names: str, table: str = "pl") -> str:
    chosen = names or tuple(PLAYERS)
    return f"{table} AS (SELECT " + ", ".join(f"{PLAYERS[n]} AS {n}" for n in chosen) + " FROM part)"
