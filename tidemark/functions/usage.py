"""Usage columns: shares, expectations, eligibility, caps, market and pace interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .derive import bounded, derive, flag, lookup, or0, tier

# Fixed values: (player stat, team total) pairs of the historical shares.
SHARE_PAIRS = (
    ("target", "targets"),
    ("carry", "carries"),
    ("pass_attempt", "pass_attempts"),
    ("red_zone_target", "red_zone_targets"),
    ("red_zone_carry", "red_zone_carries"),
    ("goal_to_go_target", "goal_to_go_targets"),
    ("goal_to_go_carry", "goal_to_go_carries"),
)
# Positions and their baselines.
NON_RECEIVERS = ("QB", "OL", "K", "P", "LS")
TARGET_BASELINE = {"QB": 0.001, "WR": 0.10, "TE": 0.07, "RB": 0.04}
CARRY_BASELINE = {"QB": 0.001, "RB": 0.12, "FB": 0.02}
MAX_TARGET_SHARE = {"QB": 0.02, "RB": 0.20, "WR": 0.40, "TE": 0.30}
EXPECTED_TARGET = {"RB": 0.04, "TE": 0.07, "WR": 0.10}
SNAP_TARGET_RATE = {"WR": 0.20, "TE": 0.15, "RB": 0.08}

POS = F.col


def share_of(num: str, den: str) -> Column:
    """``num / den``; 0 where the total is not positive."""
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(0.0)


def with_historical_shares(df: DataFrame) -> DataFrame:
    specs = []
    for stat, total in SHARE_PAIRS:
        for games, suffix in (("1g", "prev"), ("3g", "l3")):
            mine, team = f"{games}_{stat}_per_game", f"team_ctx_{total}_{suffix}"
            specs.append((f"hist_{stat}_share_{suffix}", [mine, team], share_of(mine, team)))
    return derive(df, specs)


def with_combined_usage(df: DataFrame) -> DataFrame:
    needs = ["hist_carry_share_l3", "hist_target_share_l3"]
    both = or0(needs[0]) + or0(needs[1])
    return derive(df, [("combined_usage_share_l3", needs, both), ("is_low_usage_role", needs, flag(both < 0.05))])


def with_eligibility(df: DataFrame) -> DataFrame:
    p = F.col("position")
    return derive(
        df,
        [
            ("is_non_receiving_position", ["position"], flag(p.isin(*NON_RECEIVERS))),
            ("is_primary_receiving_position", ["position"], flag(p.isin("WR", "TE"))),
            ("is_rb_position", ["position"], flag(p == "RB")),
        ],
    )


def with_adjusted_shares(df: DataFrame) -> DataFrame:
    """Shares zeroed for inactive players, and weighted by expected snaps."""
    snaps = next((c for c in ("expected_snaps_l3", "snap_offense_pct_l3") if c in df.columns), None)
    specs = []
    for kind in ("target", "carry"):
        share = f"hist_{kind}_share_l3"
        specs.append((f"active_adjusted_{kind}_share_l3", ["is_inactive", share], F.col(share) * (1 - F.col("is_inactive"))))
        if snaps:
            specs.append((f"snap_weighted_{kind}_share", [share], F.col(snaps) * F.col(share)))
    return derive(df, specs)


def with_position_baselines(df: DataFrame) -> DataFrame:
    p, share, snap = F.col("position"), F.col("hist_target_share_l3"), F.col("snap_offense_pct_l3")
    non_receiver = p.isin(*NON_RECEIVERS)
    return derive(
        df,
        [
            ("position_capped_target_share_l3", ["position", "hist_target_share_l3"], F.when(p == "QB", bounded(share, 0.0, 0.05)).otherwise(share)),
            ("position_target_baseline", ["position"], lookup(p, TARGET_BASELINE, 0.0)),
            ("position_carry_baseline", ["position"], lookup(p, CARRY_BASELINE, 0.0)),
            ("position_max_target_share", ["position"], lookup(p, MAX_TARGET_SHARE, 0.05)),
            ("position_adjusted_snap_signal", ["position", "snap_offense_pct_l3"], snap * lookup(p, {"QB": 0.001, "RB": 0.5}, 1.0)),
            (
                "target_opportunity_rate",
                ["position", "hist_target_share_l3", "snap_offense_pct_l3"],
                bounded(share / bounded(snap, 0.01), 0.0, 2.0),
            ),
            ("receiver_expected_target_share", ["position"], F.when(non_receiver, 0.0).otherwise(lookup(p, EXPECTED_TARGET, 0.0))),
            (
                "receiver_snap_adjusted_expected",
                ["position", "snap_offense_pct_l3"],
                F.when(non_receiver, 0.0).otherwise(snap * lookup(p, SNAP_TARGET_RATE, 0.0)),
            ),
        ],
    )


def with_zero_usage_flags(df: DataFrame) -> DataFrame:
    inactive = or0("is_inactive", 0) if "is_inactive" in df.columns else F.lit(0)
    few = or0("snap_offense_pct_l3") < 0.05
    return derive(
        df,
        [
            ("has_minimal_snap_history", ["snap_offense_pct_l3"], (F.col("snap_offense_pct_l3") < 0.05).cast("int")),
            ("likely_zero_usage", ["snap_offense_pct_l3"], flag((inactive == 1) | few)),
        ],
    )


def with_back_usage(df: DataFrame) -> DataFrame:
    """Usage columns of running backs."""
    rb = F.col("position") == "RB"
    t, c = or0("hist_target_share_l3"), or0("hist_carry_share_l3")
    snap = F.col("snap_offense_pct_l3")
    pt, pc, ptc = (["position", "hist_target_share_l3"], ["position", "hist_carry_share_l3"], ["position", "hist_target_share_l3", "hist_carry_share_l3"])

    def ladder(x: Column, cuts: list[tuple[float, int]]) -> Column:
        return F.when(~rb, -1).otherwise(tier(x, cuts, 0))

    return derive(
        df,
        [
            ("is_receiving_back", pt, flag(rb & (t > 0.05))),
            ("is_pass_catching_back", pt, flag(rb & (t > 0.05))),
            ("rb_target_workload_tier", pt, ladder(t, [(0.08, 4), (0.05, 3), (0.02, 2), (0.005, 1)])),
            ("is_goal_line_back", ptc, flag(rb & (c > 0.20) & (t < 0.04))),
            ("rb_receiving_ratio", ptc, F.when(rb, t / (c + t + 0.001)).otherwise(0.0)),
            ("rb_expected_target_share", [*pt, "snap_offense_pct_l3"], or0("snap_offense_pct_l3") * t),
            ("rb_target_ceiling", [*pt, "snap_offense_pct_l3"], F.when(rb, bounded(t * 1.3, 0.0, 0.25)).otherwise(1.0)),
            ("is_backup_rb", pc, flag(rb & (c < 0.15))),
            ("rb_workload_tier", pc, ladder(c, [(0.40, 4), (0.25, 3), (0.10, 2), (0.03, 1)])),
            ("rb_carry_per_snap_ratio", [*pc, "snap_offense_pct_l3"], F.when(rb, bounded(c / bounded(snap, 0.01), 0.0, 2.0)).otherwise(0.0)),
            (
                "rb_expected_carries",
                [*pc, "expected_snaps_l3", "snap_offense_pct_l3"],
                F.when(rb, or0("expected_snaps_l3") * c / bounded(or0("snap_offense_pct_l3", 0.5), 0.1)).otherwise(0.0),
            ),
        ],
    )


def with_carry_context(df: DataFrame) -> DataFrame:
    """Quarterback siphon, carry trend, situational carry rates, gadget flag, run context."""
    rush, drop = "qb_profile_team_rush_attempts_l3", "qb_profile_team_dropbacks_l3"
    siphon = bounded(or0(rush) / (or0(drop, 0.01) + 0.01), 0.0, 1.0)
    trend = or0("hist_carry_share_prev") - or0("hist_carry_share_l3")
    shares = ["hist_carry_share_prev", "hist_carry_share_l3"]

    def rate(kind: str) -> tuple[str, list[str], Column]:
        mine, all_ = f"3g_{kind}_carry_per_game", "3g_carry_per_game"
        return f"hist_{kind}_carry_rate_l3", [mine, all_], bounded(or0(mine) / (or0(all_) + 0.001), 0.0, 1.0)

    gadget = (or0("hist_carry_share_l3") > 0) & (or0("hist_target_share_l3") < 0.12) & F.col("position").isin("WR", "TE")
    copies = (
        ("qb_profile_scramble_rate_l3", "qb_scramble_rate_l3"),
        ("team_ctx_rush_rate_l3", "team_ctx_run_rate_neutral_l3"),
        ("team_ctx_rush_rate_prev", "team_ctx_run_rate_prev"),
        ("opp_ctx_rush_rate_l3", "opp_ctx_run_rate_allowed_l3"),
    )
    specs = [
        ("qb_carry_siphon_l3", [rush, drop], siphon),
        ("qb_designed_run_share_l3", [rush, drop, "qb_profile_team_scramble_rate_l3"], bounded(siphon - or0("qb_profile_team_scramble_rate_l3"), 0.0, 1.0)),
        ("carry_share_trend", shares, trend),
        ("carry_share_cv_like", shares, bounded(F.abs(trend) / (F.abs(or0("hist_carry_share_l3", 0.001)) + 0.001), 0.0, 5.0)),
        rate("short_yard"),
        rate("third_down"),
        (
            "hist_carry_per_route_l3",
            ["hist_carry_share_l3", "ps_hist_route_participation_pct_l3"],
            bounded(or0("hist_carry_share_l3") / (or0("ps_hist_route_participation_pct_l3", 0.01) + 0.01), 0.0, 3.0),
        ),
        ("wr_gadget_flag", ["hist_carry_share_l3", "hist_target_share_l3", "position"], flag(gadget)),
    ]
    specs += [(out, [source], or0(source)) for source, out in copies]
    return derive(df, specs)


def with_expected_snaps(df: DataFrame) -> DataFrame:
    """Expected snaps, red-zone and goal-line touches; return specialists; market presence."""
    plays = "team_ctx_offensive_plays_l3"

    def touches(zone: str) -> tuple[list[str], Column]:
        rate = f"team_ctx_{zone}_play_rate_l3"
        parts = [f"hist_{zone}_carry_share_l3", f"hist_{zone}_target_share_l3"]
        value = F.col(plays) * F.col(rate) * (or0(parts[0]) + or0(parts[1]))
        return [plays, rate, *parts], F.coalesce(value, F.lit(0.0))

    rz, gl = touches("red_zone"), touches("goal_to_go")
    st, off = F.col("snap_st_pct_l3"), F.col("snap_offense_pct_l3")
    specs = [
        (f"expected_snaps_{w}", [f"team_ctx_offensive_plays_{w}", f"snap_offense_pct_{w}"], F.coalesce(F.col(f"team_ctx_offensive_plays_{w}") * F.col(f"snap_offense_pct_{w}"), F.lit(0.0)))
        for w in ("l3", "prev")
    ]
    specs += [
        ("is_return_specialist", ["snap_st_pct_l3", "snap_offense_pct_l3"], flag((st >= 0.25) & (off <= 0.15))),
        ("expected_rz_touches_l3", *rz),
        ("expected_gl_touches_l3", *gl),
        ("has_market_odds", ["market_anytime_td_spread"], flag(F.col("market_anytime_td_spread").isNotNull())),
    ]
    return derive(df, specs)


def with_implied_totals(df: DataFrame) -> DataFrame:
    """Implied team totals from the total and the home spread."""
    needs = ["total_line", "spread_line", "team", "home_team", "away_team"]
    total, spread = F.col("total_line").cast("double"), F.col("spread_line").cast("double")
    home = (total - spread) / 2
    away = total - home
    mine = F.when(F.col("team") == F.col("home_team"), home).when(F.col("team") == F.col("away_team"), away)
    other = F.when(F.col("team") == F.col("home_team"), away).when(F.col("team") == F.col("away_team"), home)
    return derive(df, [("team_implied_total", needs, mine), ("opp_implied_total", needs, other)])


def with_market_interactions(df: DataFrame) -> DataFrame:
    specs = []
    for kind in ("target", "carry"):
        for w in ("prev", "l3"):
            share = f"hist_{kind}_share_{w}"
            specs.append((f"market_team_total_x_hist_{kind}_{w}", ["team_implied_total", share], F.col("team_implied_total") * F.col(share)))
    return derive(df, specs)


def with_pace_matchup(df: DataFrame) -> DataFrame:
    specs = []
    for w in ("prev", "l3"):
        mine, theirs = f"team_ctx_offensive_plays_{w}", f"opp_ctx_offensive_plays_{w}"
        specs += [
            (f"team_pace_{w}", [mine], F.col(mine).cast("double")),
            (f"opp_pace_{w}", [theirs], F.col(theirs).cast("double")),
            (f"matchup_pace_{w}", [mine, theirs], F.col(mine) + F.col(theirs)),
            (f"pace_diff_{w}", [mine, theirs], F.col(mine) - F.col(theirs)),
        ]
        for metric in ("red_zone_play_rate", "td_per_play"):
            source = f"opp_ctx_{metric}_{w}"
            specs.append((f"opp_def_{metric}_{w}", [source], F.col(source).cast("double")))
    return derive(df, specs)


def with_gap_fillers(df: DataFrame) -> DataFrame:
    """Defaults of columns that a serving frame may lack: vacancies and practice trends."""
    names = ("vacated_targets_l3", "vacated_carries_l3", "vacated_red_zone_targets_l3", "vacated_goal_to_go_carries_l3", "practice_trend_up", "practice_trend_down")
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0)) if n in df.columns else F.lit(0) for n in names})


def with_usage_features(df: DataFrame) -> DataFrame:
    """All usage columns in dependency order; the same chain serves training and scoring."""
    steps = (
        with_historical_shares, with_combined_usage, with_expected_snaps, with_eligibility, with_adjusted_shares,
        with_position_baselines, with_zero_usage_flags, with_back_usage, with_carry_context, with_implied_totals,
        with_market_interactions, with_pace_matchup,
    )
    for step in steps:
        df = df.transform(step)
    return df
