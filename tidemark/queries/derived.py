"""Queries: column families on the player frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import depth, injuries, labels, roles, usage
from ..functions.expectations import GUARDS, compose_expectations, floor_availability, gated_predictions, guard_availability
from .frames import players, players_sql
from .registry import query, r, rounded, rs

C, T_, S, SP, CV, MX, D = (
    "coalesce(hist_carry_share_l3, 0)", "coalesce(hist_target_share_l3, 0)", "coalesce(snap_offense_pct_l3, 0)", "coalesce(snap_offense_pct_prev, 0)",
    "coalesce(snap_volatility_cv_l5, 1)", "coalesce(max_snap_pct_l5, 0)", "coalesce(depth_chart_order, 99)",
)
CONC = f"{T_} / (coalesce(snap_offense_pct_l3, 0.01) + 0.01)"


def clip(e: str, lo: float | None = None, hi: float | None = None) -> str:
    out = e if lo is None else f"greatest({e}, {lo})"
    out = out if hi is None else f"least({out}, {hi})"
    return f"CASE WHEN ({e}) IS NOT NULL THEN {out} END"


def step(e: str, *cuts: float) -> str:
    return "CASE " + " ".join(f"WHEN {e} > {c} THEN {len(cuts) - i}" for i, c in enumerate(cuts)) + " ELSE 0 END"


def yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


RB = {
    "rb_is_lead_back": yes(f"{C} > 0.40"), "rb_is_committee_back": yes(f"{C} BETWEEN 0.15 AND 0.40"), "rb_is_workhorse": yes(f"{C} > 0.55"), "rb_is_bellcow": yes(f"{C} > 0.50"),
    "rb_is_receiving_back": yes(f"{T_} > {C}"), "rb_high_rz_target": yes("hist_red_zone_target_share_l3 > 0.08"), "rb_high_g2g_target": yes("hist_goal_to_go_target_share_l3 > 0.05"),
    "rb_is_goal_line_rb": yes("hist_goal_to_go_carry_share_l3 > 0.20"), "rb_high_g2g_carry": yes("hist_goal_to_go_carry_share_l3 > 0.30"), "rb_high_rz_carry": yes("hist_red_zone_carry_share_l3 > 0.25"),
    "rb_snap_tier": step(S, 0.60, 0.40, 0.20), "rb_volatility_tier": f"CASE WHEN {CV} < 0.30 THEN 2 WHEN {CV} < 0.70 THEN 1 ELSE 0 END", "rb_is_stable_role": yes(f"{CV} < 0.30"),
    "rb_snap_trend": f"{SP} - {S}", "rb_is_trending_up": yes(f"{SP} - {S} > 0.05"), "rb_depth_chart_tier": f"CASE {D} WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END", "rb_is_rb1": yes(f"{D} = 1"),
    "rb_ceiling_ratio": clip(f"{MX} / (coalesce(snap_offense_pct_l3, 0.01) + 0.01)", 0, 3), "rb_carry_dominance": clip(f"{C} * {C} * 4", 0, 2),
    "rb_pass_game_lift": clip(f"{T_} * coalesce(team_ctx_pass_rate_l3, 0.5) * 5", 0, 2), "rb_total_usage_score": clip(f"{C} + {T_} * 2", 0, 1.5),
    "rb_team_rushing_volume": clip("coalesce(team_ctx_carries_l3, 25) / 35", 0, 2),
}
DEPTH3, DEPTH4 = "3 - least(greatest(coalesce(depth_chart_order, 3), 1), 3)", "4 - least(greatest(coalesce(depth_chart_order, 4), 1), 4)"
TE = {
    "te_snap_pct_scaled": S, "te_target_share_scaled": clip(f"{T_} * 10", 0, 2), "te_stability_score": f"1 - least(greatest({CV}, 0), 1)", "te_ceiling_pct": MX, "te_depth_score": DEPTH3,
    "te_combined_role_score": f"{DEPTH3} + (1 - least({CV}, 1)) + least({MX}, 1)", "te_is_receiving_te": yes(f"{T_} > 0.10"), "te_is_primary_target": yes(f"{T_} > 0.15"),
    "te_is_blocking_te": yes(f"{S} > 0.40 AND {T_} < 0.08"), "te_target_concentration": CONC, "te_high_rz_target": yes("hist_red_zone_target_share_l3 > 0.12"),
    "te_high_g2g_target": yes("hist_goal_to_go_target_share_l3 > 0.08"), "te_is_te1": yes(f"{S} > 0.65"), "te_snap_tier": step(S, 0.70, 0.50, 0.30),
    "te_volatility_tier": f"CASE WHEN {CV} < 0.30 THEN 2 WHEN {CV} < 0.70 THEN 1 ELSE 0 END", "te_is_stable_role": yes(f"{CV} < 0.30"), "te_snap_trend": f"{SP} - {S}",
    "te_is_trending_up": yes(f"{SP} - {S} > 0.05"), "te_depth_chart_tier": f"CASE {D} WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END", "te_ceiling_tier": step(MX, 0.80, 0.40), "te_has_high_ceiling": yes(f"{MX} > 0.80"),
    "te_role_score": f"(CASE {D} WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) + {yes(f'{CV} < 0.30')} + {yes(f'{MX} > 0.80')}",
    "te_route_participation": clip("ps_hist_route_participation_plays_l3 / greatest(coalesce(qb_profile_team_dropbacks_l3, 1), 1)", 0, 1),
    "te_target_efficiency": clip(CONC, 0, 2), "te_receiving_role_score": clip(f"{T_} * 5 + {S} * 0.5", 0, 2), "te_is_pure_blocker": yes(f"{S} > 0.50 AND {T_} < 0.05"),
    "te_role_clarity": f"CASE WHEN ({S} > 0.50 AND {CONC} < 0.15) OR {CONC} > 0.25 THEN 1.0 ELSE 0.5 END", "te_team_pass_volume": clip("coalesce(team_ctx_pass_rate_l3, 0.5) * 2", 0, 2),
}
WR = {
    "wr_snap_pct_scaled": S, "wr_stability_score": f"1 - least(greatest({CV}, 0), 1)", "wr_ceiling_pct": MX, "wr_depth_score": DEPTH4,
    "wr_combined_role_score": f"{DEPTH4} + (1 - least({CV}, 1)) + least({MX}, 1)", "wr_snap_trend": f"{SP} - {S}", "wr_is_trending_up": yes(f"{SP} - {S} > 0.05"),
    "wr_volatility_tier": f"CASE WHEN {CV} < 0.20 THEN 2 WHEN {CV} < 0.50 THEN 1 ELSE 0 END", "wr_depth_tier": step(S, 0.85, 0.70, 0.40), "wr_snap_tier": step(S, 0.70, 0.50, 0.30),
    "wr_is_wr1": yes(f"{S} > 0.75"), "wr_is_low_usage": yes(f"{S} < 0.20"), "wr_target_concentration": CONC, "wr_high_rz_target": yes("hist_red_zone_target_share_l3 > 0.20"),
    "wr_high_g2g_target": yes("hist_goal_to_go_target_share_l3 > 0.10"),
}
QB = {"qb_is_likely_starter": yes(f"{S} > 0.80"), "qb_snap_tier": step(S, 0.80, 0.50, 0.20), "qb_is_mobile": yes("qb_profile_scramble_rate_l3 > 0.05")}
ROLE_SQL = {
    n: f"CASE WHEN position IN ({g}) THEN {e} END"
    for family, g in ((RB, "'RB', 'HB', 'FB'"), (TE, "'TE'"), (WR, "'WR'"), (QB, "'QB'"))
    for n, e in family.items()
}


@query(
    "role_features",
    f"""WITH {players_sql()} SELECT player_id, CASE WHEN position IN ('RB','HB','FB') THEN 'RB' WHEN position IN ('TE','QB') THEN position ELSE 'WR' END AS position_group, {rs(ROLE_SQL)} FROM pl""",
)
def _role_features(t) -> DataFrame:
    out = roles.with_role_features(roles.with_position_group(players(t.part)))
    return rounded(out.select("player_id", "position_group", *[F.col(n).cast("double").alias(n) for n in ROLE_SQL]))


CTX_SQL = {
    "is_fullback": yes("depth_chart_position = 'FB'"), "is_special_teams_only": yes("depth_chart_position IN ('P', 'K')"),
    "practice_trend_up": yes("d1 <= d2 AND d2 <= d3 AND d1 < d3"), "practice_trend_down": yes("d1 >= d2 AND d2 >= d3 AND d1 > d3"), "roster_late_activation": yes("status = 'ACTIVATED'"),
    "is_unavailable": yes("upper(injury_game_designation) IN ('OUT','DOUBTFUL','INACTIVE') OR upper(injury_report_status) IN ('OUT','DOUBTFUL')"),
    "is_eligible": yes("position IN ('QB','RB','WR','TE') AND NOT (upper(status) IN ('CUT','RES','RESERVE') OR upper(status) LIKE 'IR%' OR upper(status) LIKE 'RESERVE%') AND NOT regexp_matches(upper(coalesce(injury_game_designation, '')), 'OUT|DOUBTFUL|INACTIVE|SUSPENDED')"),
}
_PRACTICE = "CASE WHEN upper({c}) LIKE '%DNP%' THEN 0 WHEN regexp_matches(upper({c}), 'LP|LIMITED') THEN 1 WHEN regexp_matches(upper({c}), 'FP|FULL') THEN 2 END"


@query(
    "availability_flags",
    f"""WITH {players_sql()}, p AS (SELECT *, {', '.join(_PRACTICE.format(c=f'injury_practice_status_day{i}') + f' AS d{i}' for i in (1, 2, 3))} FROM pl)
SELECT player_id, {', '.join(f'{e} AS {n}' for n, e in CTX_SQL.items())} FROM p""",
)
def _availability_flags(t) -> DataFrame:
    base = roles.with_context_flags(roles.with_specialist_flags(players(t.part)))
    base = base.withColumns({"is_unavailable": F.when(injuries.unavailable(base), 1).otherwise(0), "is_eligible": F.when(injuries.eligible(base), 1).otherwise(0)})
    return base.select("player_id", *CTX_SQL)


NONREC = "position IN ('QB','OL','K','P','LS')"
USAGE_SQL = {
    "combined_usage_share_l3": f"{C} + {T_}", "is_low_usage_role": yes(f"{C} + {T_} < 0.05"), "expected_snaps_l3": "coalesce(team_ctx_offensive_plays_l3 * snap_offense_pct_l3, 0)",
    "expected_snaps_prev": "coalesce(team_ctx_offensive_plays_prev * snap_offense_pct_prev, 0)", "is_return_specialist": yes("snap_st_pct_l3 >= 0.25 AND snap_offense_pct_l3 <= 0.15"),
    "expected_rz_touches_l3": "coalesce(team_ctx_offensive_plays_l3 * team_ctx_red_zone_play_rate_l3 * (coalesce(hist_red_zone_carry_share_l3, 0) + coalesce(hist_red_zone_target_share_l3, 0)), 0)",
    "expected_gl_touches_l3": "coalesce(team_ctx_offensive_plays_l3 * team_ctx_goal_to_go_play_rate_l3 * (coalesce(hist_goal_to_go_carry_share_l3, 0) + coalesce(hist_goal_to_go_target_share_l3, 0)), 0)",
    "has_market_odds": yes("market_anytime_td_spread IS NOT NULL"), "is_non_receiving_position": yes(NONREC), "is_primary_receiving_position": yes("position IN ('WR','TE')"), "is_rb_position": yes("position = 'RB'"),
    "active_adjusted_target_share_l3": "hist_target_share_l3 * (1 - is_inactive)", "active_adjusted_carry_share_l3": "hist_carry_share_l3 * (1 - is_inactive)",
    "snap_weighted_target_share": "coalesce(team_ctx_offensive_plays_l3 * snap_offense_pct_l3, 0) * hist_target_share_l3", "snap_weighted_carry_share": "coalesce(team_ctx_offensive_plays_l3 * snap_offense_pct_l3, 0) * hist_carry_share_l3",
    "position_capped_target_share_l3": f"CASE WHEN position = 'QB' THEN {clip('hist_target_share_l3', 0, 0.05)} ELSE hist_target_share_l3 END",
    "position_target_baseline": "CASE position WHEN 'QB' THEN 0.001 WHEN 'WR' THEN 0.10 WHEN 'TE' THEN 0.07 WHEN 'RB' THEN 0.04 ELSE 0 END",
    "position_carry_baseline": "CASE position WHEN 'QB' THEN 0.001 WHEN 'RB' THEN 0.12 WHEN 'FB' THEN 0.02 ELSE 0 END",
    "position_max_target_share": "CASE position WHEN 'QB' THEN 0.02 WHEN 'RB' THEN 0.20 WHEN 'WR' THEN 0.40 WHEN 'TE' THEN 0.30 ELSE 0.05 END",
    "position_adjusted_snap_signal": "CASE position WHEN 'QB' THEN snap_offense_pct_l3 * 0.001 WHEN 'RB' THEN snap_offense_pct_l3 * 0.5 ELSE snap_offense_pct_l3 END",
    "target_opportunity_rate": clip("hist_target_share_l3 / CASE WHEN snap_offense_pct_l3 IS NOT NULL THEN greatest(snap_offense_pct_l3, 0.01) END", 0, 2),
    "receiver_expected_target_share": f"CASE WHEN {NONREC} THEN 0 WHEN position = 'RB' THEN 0.04 WHEN position = 'TE' THEN 0.07 WHEN position = 'WR' THEN 0.10 ELSE 0 END",
    "receiver_snap_adjusted_expected": f"CASE WHEN {NONREC} THEN 0 ELSE snap_offense_pct_l3 * CASE position WHEN 'WR' THEN 0.20 WHEN 'TE' THEN 0.15 WHEN 'RB' THEN 0.08 ELSE 0 END END",
    "has_minimal_snap_history": "CASE WHEN snap_offense_pct_l3 IS NOT NULL THEN (snap_offense_pct_l3 < 0.05)::INT END", "likely_zero_usage": yes(f"is_inactive = 1 OR {S} < 0.05"),
    "is_receiving_back": yes("position = 'RB' AND hist_target_share_l3 > 0.05"), "is_pass_catching_back": yes("position = 'RB' AND hist_target_share_l3 > 0.05"),
    "rb_target_workload_tier": f"CASE WHEN position <> 'RB' THEN -1 ELSE {step(T_, 0.08, 0.05, 0.02, 0.005)} END", "is_goal_line_back": yes(f"position = 'RB' AND {C} > 0.20 AND {T_} < 0.04"),
    "rb_receiving_ratio": f"CASE WHEN position = 'RB' THEN {T_} / ({C} + {T_} + 0.001) ELSE 0 END", "rb_expected_target_share": f"{S} * {T_}",
    "rb_target_ceiling": f"CASE WHEN position = 'RB' THEN least({T_} * 1.3, 0.25) ELSE 1 END", "is_backup_rb": yes(f"position = 'RB' AND {C} < 0.15"),
    "rb_workload_tier": f"CASE WHEN position <> 'RB' THEN -1 ELSE {step(C, 0.40, 0.25, 0.10, 0.03)} END",
    "rb_carry_per_snap_ratio": f"CASE WHEN position = 'RB' THEN CASE WHEN snap_offense_pct_l3 IS NOT NULL THEN least({C} / greatest(snap_offense_pct_l3, 0.01), 2) END ELSE 0 END",
    "rb_expected_carries": f"CASE WHEN position = 'RB' THEN coalesce(team_ctx_offensive_plays_l3 * snap_offense_pct_l3, 0) * {C} / greatest(coalesce(snap_offense_pct_l3, 0.5), 0.1) ELSE 0 END",
    "qb_carry_siphon_l3": "least(qb_profile_team_rush_attempts_l3 / (coalesce(qb_profile_team_dropbacks_l3, 0.01) + 0.01), 1)", "carry_share_trend": f"coalesce(hist_carry_share_prev, 0) - {C}",
    "carry_share_cv_like": f"least(abs(coalesce(hist_carry_share_prev, 0) - {C}) / (coalesce(hist_carry_share_l3, 0.001) + 0.001), 5)",
    "hist_carry_per_route_l3": f"least({C} / (coalesce(ps_hist_route_participation_pct_l3, 0.01) + 0.01), 3)", "wr_gadget_flag": yes(f"{C} > 0 AND {T_} < 0.12 AND position IN ('WR','TE')"),
    "qb_scramble_rate_l3": "coalesce(qb_profile_scramble_rate_l3, 0)", "opp_ctx_run_rate_allowed_l3": "coalesce(opp_ctx_rush_rate_l3, 0)",
    "team_implied_total": "CASE WHEN team = home_team THEN (total_line - spread_line) / 2 WHEN team = away_team THEN total_line - (total_line - spread_line) / 2 END",
    "opp_implied_total": "CASE WHEN team = home_team THEN total_line - (total_line - spread_line) / 2 WHEN team = away_team THEN (total_line - spread_line) / 2 END",
    "market_team_total_x_hist_target_l3": "(CASE WHEN team = home_team THEN (total_line - spread_line) / 2 WHEN team = away_team THEN total_line - (total_line - spread_line) / 2 END) * hist_target_share_l3",
    "market_team_total_x_hist_carry_prev": "(CASE WHEN team = home_team THEN (total_line - spread_line) / 2 WHEN team = away_team THEN total_line - (total_line - spread_line) / 2 END) * hist_carry_share_prev",
    "matchup_pace_l3": "team_ctx_offensive_plays_l3 + opp_ctx_offensive_plays_l3", "pace_diff_prev": "team_ctx_offensive_plays_prev - opp_ctx_offensive_plays_prev", "opp_def_td_per_play_l3": "opp_ctx_td_per_play_l3",
}


@query("usage_features", f"WITH {players_sql()} SELECT player_id, {rs(USAGE_SQL)} FROM pl")
def _usage_features(t) -> DataFrame:
    out = usage.with_usage_features(players(t.part))
    return rounded(out.select("player_id", *[F.col(n).cast("double").alias(n) for n in USAGE_SQL]))


P5, P3, PP = "hist_air_yards_sum_l5 / greatest(hist_targets_l5, 1)", "hist_air_yards_sum_l3 / greatest(hist_targets_l3, 1)", "air_yards_prev_game / greatest(targets_prev_game, 1)"
PRIOR = "(CASE position WHEN 'WR' THEN 10.7 WHEN 'TE' THEN 6.2 WHEN 'RB' THEN 0.3 ELSE 5.0 END)"
CATCH = "(CASE position WHEN 'RB' THEN 0.77 WHEN 'TE' THEN 0.70 WHEN 'WR' THEN 0.62 ELSE 0.70 END)"
SLOT, WIDE, AIR = "coalesce(ps_hist_targets_slot_share_l3, 0.33)", "coalesce(ps_hist_targets_wide_share_l3, 0.33)", "coalesce(qb_profile_avg_air_yards_l3, 8)"
DEPTH_SQL = {
    "position_target_depth_prior": "CASE position WHEN 'WR' THEN 10.7 WHEN 'TE' THEN 6.2 WHEN 'RB' THEN 0.3 WHEN 'FB' THEN 0 WHEN 'QB' THEN 0 ELSE 5 END",
    "position_depth_variance": "CASE position WHEN 'WR' THEN 7.4 WHEN 'TE' THEN 5.5 WHEN 'RB' THEN 4.1 ELSE 5 END", "position_depth_rank": "CASE position WHEN 'WR' THEN 3 WHEN 'TE' THEN 2 WHEN 'RB' THEN 1 WHEN 'FB' THEN 0 WHEN 'QB' THEN 0 ELSE 1 END",
    "is_short_target_position": yes("position IN ('RB','FB','QB')"), "is_deep_target_position": yes("position = 'WR'"), "position_depth_ceiling": "CASE position WHEN 'RB' THEN 3 WHEN 'FB' THEN 0 WHEN 'TE' THEN 12 WHEN 'WR' THEN 30 ELSE 5 END",
    "hist_air_yards_per_target_l3": P3, "hist_air_yards_per_target_l5": P5, "air_yards_per_target_prev": PP, "expected_target_depth": f"CASE WHEN hist_targets_l3 >= 3 THEN {P3} ELSE {PRIOR} END",
    "wr_depth_archetype": f"CASE WHEN position = 'WR' THEN CASE WHEN {P5} > 15 THEN 4 WHEN {P5} > 10 THEN 3 WHEN {P5} > 5 THEN 2 ELSE 1 END ELSE 0 END",
    "te_depth_archetype": f"CASE WHEN position = 'TE' THEN CASE WHEN {P5} > 8 THEN 3 WHEN {P5} > 4 THEN 2 ELSE 1 END ELSE 0 END", "has_depth_history": yes("hist_targets_l5 >= 5"),
    "player_depth_vs_position": f"CASE WHEN hist_targets_l5 >= 3 THEN {P5} - {PRIOR} ELSE 0 END", "depth_uncertainty": "CASE WHEN hist_targets_l5 >= 15 THEN 0.2 WHEN hist_targets_l5 >= 10 THEN 0.4 WHEN hist_targets_l5 >= 5 THEN 0.6 ELSE 0.8 END",
    "shrunk_depth_estimate": f"CASE WHEN hist_targets_l5 >= 10 THEN 0.9 * {P5} + 0.1 * {PRIOR} WHEN hist_targets_l5 >= 6 THEN 0.8 * {P5} + 0.2 * {PRIOR} WHEN hist_targets_l5 >= 3 THEN 0.7 * {P5} + 0.3 * {PRIOR} WHEN hist_targets_l5 >= 1 THEN 0.5 * {P5} + 0.5 * {PRIOR} ELSE {PRIOR} END",
    "best_depth_estimate": f"CASE WHEN hist_targets_l5 >= 5 THEN {P5} WHEN hist_targets_l3 >= 2 THEN 0.7 * {P3} + 0.3 * {PRIOR} ELSE {PRIOR} END",
    "weighted_expected_depth": f"CASE WHEN targets_prev_game >= 1 THEN 0.6 * {PP} + 0.4 * {P5} ELSE {P5} END",
    "position_catch_rate_prior": "CASE position WHEN 'RB' THEN 0.77 WHEN 'TE' THEN 0.70 WHEN 'WR' THEN 0.62 WHEN 'FB' THEN 0.75 ELSE 0.70 END",
    "shrunk_catch_rate_estimate": f"CASE WHEN hist_targets_count_l5 >= 20 THEN hist_catch_rate_l5 WHEN hist_targets_count_l5 >= 5 THEN hist_catch_rate_l5 * 0.7 + {CATCH} * 0.3 ELSE {CATCH} END",
    "depth_adjusted_catch_rate_prior": f"least(greatest(0.70 - ({P3}) * 0.015, 0.40), 0.90)", "wr_slot_tendency": SLOT, "wr_slot_vs_outside": f"{SLOT} - {WIDE}",
    "adjusted_target_depth_prior": f"CASE position WHEN 'WR' THEN 10.7 - 3.0 * ({SLOT} - 0.33) WHEN 'TE' THEN 6.2 WHEN 'RB' THEN 0.3 ELSE 0 END", "qb_air_yards_tendency": f"least(greatest({AIR}, 3), 15)",
    "qb_scaled_target_depth": f"CASE position WHEN 'WR' THEN {AIR} / 8 * 10.7 WHEN 'TE' THEN {AIR} / 8 * 6.2 WHEN 'RB' THEN 0.3 ELSE 0 END", "rb_receiving_depth_tendency": f"CASE WHEN position = 'RB' THEN 0.3 + {T_} * 5 END",
    "wr_route_depth_tendency": f"CASE WHEN position = 'WR' THEN {WIDE} * 3 + 9 END", "te_receiving_depth_tendency": f"CASE WHEN position = 'TE' THEN 4 + {T_} * 20 END",
}


@query("depth_and_catch_priors", f"WITH {players_sql()} SELECT player_id, {rs(DEPTH_SQL)} FROM pl")
def _depth_and_catch_priors(t) -> DataFrame:
    out = players(t.part)
    for fn in (depth.with_depth_priors, depth.with_depth_estimates, depth.with_catch_priors, depth.with_depth_tendencies):
        out = out.transform(fn)
    return rounded(out.select("player_id", *[F.col(n).cast("double").alias(n) for n in DEPTH_SQL]))


@query(
    "injury_probability",
    f"""WITH {players_sql()}, b AS (SELECT *, greatest(CASE upper(injury_report_status) WHEN 'OUT' THEN 0.98 WHEN 'DOUBTFUL' THEN 0.85 WHEN 'QUESTIONABLE' THEN 0.55 WHEN 'SUSPENDED' THEN 0.9 ELSE 0.1 END,
  CASE injury_practice_status WHEN 'DID NOT PARTICIPATE' THEN 0.8 WHEN 'LIMITED' THEN 0.5 WHEN 'FULL' THEN 0.1 ELSE 0.15 END) AS p FROM pl)
SELECT player_id, {rs({'probability': 'CASE WHEN injury_practice_dnp_count >= 2 THEN least(p + 0.1, 1) ELSE p END', 'availability_inactive_prob': 'coalesce(injury_inactive_probability_model, 0)', 'availability_uncertainty': 'coalesce(injury_inactive_probability_model, 0) * (1 - coalesce(injury_inactive_probability_model, 0))'})} FROM b""",
)
def _injury_probability(t) -> DataFrame:
    out = injuries.with_availability(players(t.part))
    p = injuries.inactive_probability(F.upper("injury_report_status"), F.col("injury_practice_status"), F.col("injury_practice_dnp_count"))
    return rounded(out.select("player_id", p.cast("double").alias("probability"), "availability_inactive_prob", "availability_uncertainty"))


@query(
    "model_fallback",
    f"""WITH {players_sql('player_id', 'injury_inactive_probability_model')}, w AS (SELECT *, CAST(player_id % 100 AS DOUBLE) / 100 AS width, CAST(player_id % 7 AS DOUBLE) / 7 AS h FROM pl)
SELECT player_id, CASE WHEN width > 0.65 THEN 'heuristic' ELSE 'model' END AS injury_inactive_probability_source, {r('CASE WHEN width > 0.65 THEN h ELSE injury_inactive_probability_model END', 'injury_inactive_probability')} FROM w""",
)
def _model_fallback(t) -> DataFrame:
    base = players(t.part, "player_id", "injury_inactive_probability_model").selectExpr(
        "*", "CAST(player_id % 100 AS DOUBLE) / 100 AS injury_inactive_probability_interval_width", "CAST(player_id % 7 AS DOUBLE) / 7 AS injury_inactive_probability"
    )
    return rounded(injuries.with_model_fallback(base).select("player_id", "injury_inactive_probability_source", "injury_inactive_probability"))


# --- labels and guards ---------------------------------------------------------------------

_COUNTS = "p_partkey % 3 AS rushing_td_count, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 2 END AS receiving_td_count, p_size % 3 AS passing_td, p_size % 6 AS touchdowns"
_OFF = "rushing_td_count + coalesce(receiving_td_count, 0) + passing_td"


@query(
    "label_versions",
    f"""WITH c AS (SELECT p_partkey AS player_id, {_COUNTS} FROM part), o AS (SELECT *, {_OFF} AS off, greatest(touchdowns - ({_OFF}), 0) AS oth FROM c)
SELECT player_id, off AS td_count_offense, off + oth AS td_count_all, (off + oth > 0)::INT AS anytime_td_all, (off > 0)::INT AS anytime_td_offense, (rushing_td_count > 0)::INT AS anytime_td_rush,
  (coalesce(receiving_td_count, 0) > 0)::INT AS anytime_td_rec, (passing_td > 0)::INT AS anytime_td_pass_thrown, (off + oth > 0)::INT AS anytime_td, off + oth AS td_count FROM o""",
)
def _label_versions(t) -> DataFrame:
    base = t.part.selectExpr("p_partkey AS player_id", *[e.strip() for e in _COUNTS.split(", ")])
    out = labels.with_labels(base, "v1_any_all")
    return out.select("player_id", *[c for c in out.columns if c.startswith(("td_count", "anytime_td")) and c not in ("td_count_skill",)])


@query("leak_guard", "SELECT o_orderkey, o_totalprice FROM orders")
def _leak_guard(t) -> DataFrame:
    leaky = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("postgame_status"), F.col("o_totalprice").alias("final_score"), F.col("o_custkey").alias("actual_td_count"))
    return labels.guard_leaks(leaky)[0]


@query("frozen_projection", "SELECT o_orderkey, CAST(epoch_us(o_orderdate) / 1000000 AS DOUBLE) AS o_orderdate, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus, CAST(NULL AS DOUBLE) AS missing_feature FROM orders")
def _frozen_projection(t) -> DataFrame:
    return labels.project_frozen(t.orders, ["o_orderkey", "o_orderdate", "o_orderstatus", "missing_feature"], {"o_orderstatus": ["F", "O"]})


# --- expectations, gates, guards -------------------------------------------------------------

_PRED = {
    "season": "year(o_orderdate)", "week": "month(o_orderdate)", "team": "o_custkey % 8", "game_id": "o_custkey % 40", "player_id": "o_orderkey",
    "position": "CASE o_orderkey % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'FB' END", "is_fullback": "CASE WHEN o_orderkey % 6 >= 4 THEN 1 ELSE 0 END",
    "pred_team_pace": "CAST(o_custkey % 30 + 40 AS DOUBLE)", "team_ctx_pass_rate_l3": "CAST(o_custkey % 100 AS DOUBLE) / 100", "pred_snaps": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 70 - 5 AS DOUBLE) END",
    "pred_availability_active": "CAST(o_orderkey * 7 % 101 AS DOUBLE) / 100", "pred_usage_targets": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey * 3 % 60 AS DOUBLE) / 100 END",
    "pred_usage_carries": "CAST(o_orderkey * 11 % 50 AS DOUBLE) / 100", "pred_td_conv_rec": "CAST(o_orderkey % 13 AS DOUBLE) / 100", "pred_td_conv_rush": "CAST(o_orderkey % 9 AS DOUBLE) / 100",
    "hist_red_zone_target_share_prev": "CAST(o_orderkey % 40 AS DOUBLE) / 100", "hist_red_zone_carry_share_prev": "CAST(o_orderkey % 30 AS DOUBLE) / 100", "hist_target_share_l3": "CAST(o_orderkey % 25 AS DOUBLE) / 100",
    "availability_uncertainty": "CAST(o_orderkey % 40 AS DOUBLE) / 100", "injury_game_designation": "CASE o_orderkey % 9 WHEN 0 THEN 'Out' WHEN 1 THEN 'Doubtful' WHEN 2 THEN 'questionable' END",
    "injury_practice_status": "CASE o_orderkey % 4 WHEN 0 THEN 'Did Not Participate In Practice' WHEN 1 THEN 'Limited' END", "injury_inactive_probability": "CAST(o_orderkey % 21 AS DOUBLE) / 20",
    "injury_is_inactive_designation": "CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END", "snap_ceiling_l5": "CAST(o_orderkey % 12 AS DOUBLE)", "max_snap_pct_l5": "CAST(o_orderkey % 50 AS DOUBLE) / 100",
    "snap_offense_pct_l3": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END", "pred_usage_target_yards": "CAST(o_orderkey % 15 AS DOUBLE) - 3",
}


def preds(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*[f"{e} AS {n}" for n, e in _PRED.items()])


PRED_SQL = "pr AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PRED.items()) + " FROM orders)"


@query(
    "composed_expectations",
    f"""WITH {PRED_SQL}, a AS (SELECT *, pred_team_pace * team_ctx_pass_rate_l3 AS tp, pred_team_pace * (1 - team_ctx_pass_rate_l3) AS tr FROM pr),
b AS (SELECT *, tp * coalesce(pred_usage_targets, 0) AS t0, tr * pred_usage_carries AS c0, least(pred_availability_active, 1) AS act FROM a),
c AS (SELECT *, t0 * act AS t1, c0 * act AS c1 FROM b), d AS (SELECT *, sum(t1) OVER g AS st, sum(c1) OVER g AS sc FROM c WINDOW g AS (PARTITION BY season, week, team, game_id)),
e AS (SELECT *, t1 * CASE WHEN tp > 0 AND st > 0 THEN least(greatest(tp / (st + 1e-6), 0.25), 4) ELSE 1 END AS t2, c1 * CASE WHEN tr > 0 AND sc > 0 THEN least(greatest(tr / (sc + 1e-6), 0.25), 4) ELSE 1 END AS c2 FROM d),
f AS (SELECT *, pred_td_conv_rec * t2 + pred_td_conv_rush * c2 AS lam FROM e)
SELECT player_id, {rs({'expected_targets': 't2', 'expected_carries': 'c2', 'expected_opportunities': 't2 + c2', 'expected_opportunities_raw': 't0 + c0', 'expected_snaps_stable': 'greatest(coalesce(pred_snaps, 0), 0) * (1 - least(availability_uncertainty, 0.25))', 'expected_td_count_structural': 'lam', 'anytime_td_structural': '1 - exp(-lam)', 'expected_td_rate_per_opportunity': 'CASE WHEN t2 + c2 <> 0 THEN lam / (t2 + c2) END', 'expected_rz_targets': 't2 * hist_red_zone_target_share_prev', 'expected_rz_opportunities': 't2 * hist_red_zone_target_share_prev + c2 * hist_red_zone_carry_share_prev'})} FROM f""",
)
def _composed_expectations(t) -> DataFrame:
    out = compose_expectations(preds(t.orders))
    return rounded(out.select("player_id", "expected_targets", "expected_carries", "expected_opportunities", "expected_opportunities_raw", "expected_snaps_stable", "expected_td_count_structural", "anytime_td_structural", "expected_td_rate_per_opportunity", "expected_rz_targets", "expected_rz_opportunities"))


@query(
    "gated_predictions",
    f"""WITH {PRED_SQL}, s AS (SELECT *, CASE WHEN pred_availability_active >= 0.5 THEN coalesce(pred_snaps, 0) ELSE 0 END AS sn FROM pr),
u AS (SELECT *, CASE WHEN sn > 0 THEN coalesce(pred_usage_targets, 0) ELSE 0 END AS ut, CASE WHEN sn > 0 THEN pred_usage_carries ELSE 0 END AS uc FROM s)
SELECT player_id, (pred_availability_active >= 0.5)::INT AS gate_snaps_global, (sn > 0)::INT AS gate_usage_targets_global, (ut > 0)::INT AS gate_td_conv_rec_global, {rs({'pred_snaps': 'sn', 'pred_usage_targets': 'ut', 'pred_usage_carries': 'uc', 'pred_td_conv_rec': 'CASE WHEN ut > 0 THEN pred_td_conv_rec ELSE 0 END', 'pred_td_conv_rush': 'CASE WHEN uc > 0 THEN pred_td_conv_rush ELSE 0 END'})} FROM u""",
)
def _gated_predictions(t) -> DataFrame:
    out = gated_predictions(preds(t.orders))
    return rounded(out.select("player_id", "gate_snaps_global", "gate_usage_targets_global", "gate_td_conv_rec_global", "pred_snaps", "pred_usage_targets", "pred_usage_carries", "pred_td_conv_rec", "pred_td_conv_rush"))


@query(
    "prediction_guards",
    f"""WITH {PRED_SQL}, q AS (SELECT *, least(injury_inactive_probability, 0.95) AS ip FROM pr)
SELECT player_id, {rs({
    'availability': "CASE WHEN injury_is_inactive_designation = 1 THEN 0 ELSE least(pred_availability_active * CASE upper(coalesce(injury_game_designation, '')) WHEN 'OUT' THEN 0 WHEN 'DOUBTFUL' THEN 0.25 WHEN 'QUESTIONABLE' THEN 0.85 ELSE 1 END * CASE WHEN upper(coalesce(injury_practice_status, '')) LIKE '%DID NOT PARTICIPATE%' THEN 0.55 ELSE 1 END * CASE WHEN upper(coalesce(injury_practice_status, '')) LIKE '%LIMITED%' THEN 0.85 ELSE 1 END * CASE WHEN ip >= 0.5 THEN greatest(1 - ip, 0.05) ELSE 1 END, 1) END",
    'floored': "CASE WHEN coalesce(snap_offense_pct_l3, 0) = 0 AND injury_is_inactive_designation = 0 THEN greatest(pred_availability_active, CASE WHEN position = 'QB' THEN 0.9 ELSE 0.35 END) ELSE pred_availability_active END",
    'snaps': 'CASE WHEN max_snap_pct_l5 < 0.25 AND pred_snaps > snap_ceiling_l5 * 1.5 THEN snap_ceiling_l5 * 1.5 ELSE pred_snaps END',
    'targets': "CASE WHEN position = 'QB' THEN 0 WHEN is_fullback = 1 AND pred_usage_targets > 0.10 THEN 0.10 WHEN position = 'RB' AND pred_usage_targets > greatest(hist_target_share_l3 * 1.5, 0.03) THEN greatest(hist_target_share_l3 * 1.5, 0.03) ELSE pred_usage_targets END",
    'carries': "CASE WHEN position = 'WR' THEN least(pred_usage_carries, 0.05) WHEN position = 'TE' THEN least(pred_usage_carries, 0.02) WHEN position = 'QB' THEN least(pred_usage_carries, 0.30) WHEN is_fullback = 1 THEN least(pred_usage_carries, 0.10) ELSE pred_usage_carries END",
    'target_yards': "CASE WHEN position = 'QB' THEN 0 WHEN position = 'RB' THEN least(greatest(pred_usage_target_yards, 0), 2) WHEN is_fullback = 1 THEN 0 ELSE pred_usage_target_yards END",
    'air': "CASE WHEN position = 'RB' THEN least(pred_usage_target_yards, 0) WHEN is_fullback = 1 THEN 0 ELSE pred_usage_target_yards END"})} FROM q""",
)
def _prediction_guards(t) -> DataFrame:
    base = preds(t.orders).withColumns(
        {"availability": F.col("pred_availability_active"), "floored": F.col("pred_availability_active"), "snaps": F.col("pred_snaps"), "targets": F.col("pred_usage_targets"),
         "carries": F.col("pred_usage_carries"), "target_yards": F.col("pred_usage_target_yards"), "air": F.col("pred_usage_target_yards")}
    )
    base = floor_availability(guard_availability(base, "availability"), "floored")
    for problem, name in (("snaps", "snaps"), ("usage_targets", "targets"), ("usage_carries", "carries"), ("usage_target_yards", "target_yards"), ("efficiency_rec_yards_air", "air")):
        base = GUARDS[problem](base, name)
    return rounded(base.select("player_id", "availability", "floored", "snaps", "targets", "carries", "target_yards", "air"))
