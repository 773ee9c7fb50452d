"""Role features per position group, driven by threshold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .derive import Spec, bounded, derive, first_match, flag, or0, tier

CARRY, TARGET = "hist_carry_share_l3", "hist_target_share_l3"
RZ_TARGET, GL_TARGET = "hist_red_zone_target_share_l3", "hist_goal_to_go_target_share_l3"
RZ_CARRY, GL_CARRY = "hist_red_zone_carry_share_l3", "hist_goal_to_go_carry_share_l3"
SNAP, SNAP_PREV = "snap_offense_pct_l3", "snap_offense_pct_prev"
CV, CEILING, DEPTH = "snap_volatility_cv_l5", "max_snap_pct_l5", "depth_chart_order"
SNAPS = "expected_snaps_l3"

# Positions of each group.
GROUPS = {"RB": ("RB", "HB", "FB"), "WR": ("WR",), "TE": ("TE",), "QB": ("QB",)}

# Flags that are 1 above a threshold (feature, input, threshold).
ABOVE = {
    "RB": (
        ("rb_is_lead_back", CARRY, 0.40), ("rb_is_workhorse", CARRY, 0.55), ("rb_is_bellcow", CARRY, 0.50),
        ("rb_high_rz_target", RZ_TARGET, 0.08), ("rb_high_g2g_target", GL_TARGET, 0.05),
        ("rb_is_goal_line_rb", GL_CARRY, 0.20), ("rb_high_g2g_carry", GL_CARRY, 0.30), ("rb_high_rz_carry", RZ_CARRY, 0.25),
    ),
    "TE": (
        ("te_is_receiving_te", TARGET, 0.10), ("te_is_primary_target", TARGET, 0.15), ("te_high_rz_target", RZ_TARGET, 0.12),
        ("te_high_g2g_target", GL_TARGET, 0.08), ("te_is_te1", SNAP, 0.65), ("te_has_high_ceiling", CEILING, 0.80),
        ("te_is_high_snap_te", SNAPS, 40.0),
    ),
    "WR": (("wr_is_wr1", SNAP, 0.75), ("wr_high_rz_target", RZ_TARGET, 0.20), ("wr_high_g2g_target", GL_TARGET, 0.10)),
    "QB": (("qb_is_likely_starter", SNAP, 0.80), ("qb_is_mobile", "qb_profile_scramble_rate_l3", 0.05)),
}
# Tiers tested from the top (feature, input, thresholds); the count of thresholds is the top tier.
TIERS = {
    "RB": (("rb_snap_tier", SNAP, (0.60, 0.40, 0.20)),),
    "TE": (("te_snap_tier", SNAP, (0.70, 0.50, 0.30)), ("te_ceiling_tier", CEILING, (0.80, 0.40))),
    "WR": (("wr_depth_tier", SNAP, (0.85, 0.70, 0.40)), ("wr_snap_tier", SNAP, (0.70, 0.50, 0.30))),
    "QB": (("qb_snap_tier", SNAP, (0.80, 0.50, 0.20)),),
}
# Upper bounds of the volatility tiers, stable first.
VOLATILITY = {"RB": (0.30, 0.70), "TE": (0.30, 0.70), "WR": (0.20, 0.50)}
STABLE_BELOW = 0.30
TREND_UP = 0.05


def with_position_group(df: DataFrame, position: str = "position", out: str = "position_group") -> DataFrame:
    """RB, WR, TE or QB; unknown positions count as WR."""
    p = F.col(position)
    return df.withColumn(out, first_match([(p.isin(*names), group) for group, names in GROUPS.items()], "WR"))


def with_specialist_flags(df: DataFrame) -> DataFrame:
    p = F.col("depth_chart_position")
    return derive(
        df,
        [
            ("is_fullback", ["depth_chart_position"], flag(p == "FB")),
            ("is_special_teams_only", ["depth_chart_position"], flag(p.isin("P", "K"))),
        ],
    )


def practice_level(status: Column) -> Column:
    """0 did not practise, 1 limited, 2 full, from a free-text status."""
    text = F.upper(status.cast("string"))
    return F.when(text.contains("DNP"), 0).when(text.rlike("LP|LIMITED"), 1).when(text.rlike("FP|FULL"), 2)


def with_practice_trend(df: DataFrame) -> DataFrame:
    """Up (down) when three days never fall (rise) and the last differs from the first."""
    days = [f"injury_practice_status_day{i}" for i in (1, 2, 3)]
    a, b, c = (practice_level(F.col(d)) for d in days)
    return derive(
        df,
        [
            ("practice_trend_up", days, flag((a <= b) & (b <= c) & (a < c))),
            ("practice_trend_down", days, flag((a >= b) & (b >= c) & (a > c))),
        ],
    )


def with_context_flags(df: DataFrame) -> DataFrame:
    st = "snap_st_pct_prev"
    return derive(
        with_practice_trend(df),
        [
            ("st_snap_pct_prev", [st], F.col(st)),
            ("st_heavy_prev", [st], flag(or0(st) > 0.50)),
            ("roster_late_activation", ["status"], flag(F.col("status") == "ACTIVATED")),
        ],
    )


def _common(group: str) -> list[Spec]:
    """Flags and tiers that differ between groups only by name and threshold."""
    low = group.lower()
    specs: list[Spec] = [(name, [source], flag(or0(source) > cut)) for name, source, cut in ABOVE[group]]
    for name, source, cuts in TIERS[group]:
        specs.append((name, [source], tier(or0(source), [(c, len(cuts) - i) for i, c in enumerate(cuts)], 0)))
    if group in VOLATILITY:
        steady, moderate = VOLATILITY[group]
        specs.append((f"{low}_volatility_tier", [CV], tier(or0(CV, 1.0), [(steady, 2), (moderate, 1)], 0, below=True)))
        trend = or0(SNAP_PREV) - or0(SNAP)
        specs.append((f"{low}_snap_trend", [SNAP_PREV, SNAP], trend))
        specs.append((f"{low}_is_trending_up", [SNAP_PREV, SNAP], flag(trend > TREND_UP)))
    if group in ("RB", "TE"):
        order = F.coalesce(F.col(DEPTH), F.lit(3))
        specs.append((f"{low}_is_stable_role", [CV], flag(or0(CV, 1.0) < STABLE_BELOW)))
        specs.append((f"{low}_depth_chart_tier", [DEPTH], F.when(order == 1, 2).when(order == 2, 1).otherwise(0)))
    if group in ("TE", "WR"):
        top = {"TE": 3, "WR": 4}[group]
        depth = F.lit(float(top)) - bounded(F.coalesce(F.col(DEPTH), F.lit(top)).cast("double"), 1, top)
        stability = 1.0 - bounded(or0(CV, 1.0), 0.0, 1.0)
        specs += [
            (f"{low}_snap_pct_scaled", [SNAP], or0(SNAP)),
            (f"{low}_stability_score", [CV], stability),
            (f"{low}_ceiling_pct", [CEILING], or0(CEILING)),
            (f"{low}_depth_score", [DEPTH], depth),
            (f"{low}_combined_role_score", [DEPTH, CV, CEILING], depth + stability + bounded(or0(CEILING), 0.0, 1.0)),
            (f"{low}_target_concentration", [TARGET, SNAP], or0(TARGET) / (or0(SNAP, 0.01) + 0.01)),
        ]
    return specs


def _back() -> list[Spec]:
    carry, target = or0(CARRY), or0(TARGET)
    return [
        ("rb_is_committee_back", [CARRY], flag((carry >= 0.15) & (carry <= 0.40))),
        ("rb_is_receiving_back", [TARGET, CARRY], flag(target > carry)),
        ("rb_is_rb1", [DEPTH], flag(F.col(DEPTH) == 1)),
        ("rb_ceiling_ratio", [CEILING, SNAP], bounded(or0(CEILING) / (or0(SNAP, 0.01) + 0.01), 0.0, 3.0)),
        ("rb_carry_dominance", [CARRY], bounded(carry * carry * 4.0, 0.0, 2.0)),
        ("rb_pass_game_lift", [TARGET, "team_ctx_pass_rate_l3"], bounded(target * or0("team_ctx_pass_rate_l3", 0.5) * 5.0, 0.0, 2.0)),
        ("rb_total_usage_score", [CARRY, TARGET], bounded(carry + target * 2.0, 0.0, 1.5)),
        ("rb_team_rushing_volume", ["team_ctx_carries_l3"], bounded(or0("team_ctx_carries_l3", 25.0) / 35.0, 0.0, 2.0)),
    ]


def _tight_end(have: set[str]) -> list[Spec]:
    target, snap = or0(TARGET), or0(SNAP)
    efficiency = target / (or0(SNAP, 0.01) + 0.01)
    order = F.coalesce(F.col(DEPTH), F.lit(3))
    points = F.when(order == 1, 2.0).when(order == 2, 1.0).otherwise(0.0)
    points = points + flag(or0(CV, 1.0) < STABLE_BELOW) + flag(or0(CEILING) > 0.80)
    blocker = (snap > 0.50) & (efficiency < 0.15)
    routes, dropbacks = "ps_hist_route_participation_plays_l3", "qb_profile_team_dropbacks_l3"
    specs: list[Spec] = [
        ("te_target_share_scaled", [TARGET], bounded(target * 10.0, 0.0, 2.0)),
        ("te_is_blocking_te", [SNAP, TARGET], flag((snap > 0.40) & (target < 0.08))),
        ("te_expected_snaps_ratio", [SNAPS, SNAP], or0(SNAPS) / 60.0),
        ("te_role_score", [DEPTH, CV, CEILING], points.cast("double")),
        ("te_target_efficiency", [TARGET, SNAP], bounded(efficiency, 0.0, 2.0)),
        ("te_receiving_role_score", [TARGET, SNAP], bounded(target * 5.0 + snap * 0.5, 0.0, 2.0)),
        ("te_is_pure_blocker", [TARGET, SNAP], flag((snap > 0.50) & (target < 0.05))),
        ("te_role_clarity", [TARGET, SNAP], F.when(blocker | (efficiency > 0.25), 1.0).otherwise(0.5)),
        ("te_team_pass_volume", ["team_ctx_pass_rate_l3"], bounded(or0("team_ctx_pass_rate_l3", 0.5) * 2.0, 0.0, 2.0)),
    ]
    if {routes, dropbacks} <= have:
        specs.append(("te_route_participation", [], bounded(or0(routes) / bounded(or0(dropbacks, 1.0), 1.0), 0.0, 1.0)))
    else:
        specs.append(("te_route_participation", [SNAP], snap))
    return specs


def with_role_features(df: DataFrame, position: str = "position") -> DataFrame:
    """Role columns of every group; NULL for players of other groups. One projection."""
    have = set(df.columns)
    extra = {"RB": _back(), "TE": _tight_end(have), "WR": [("wr_is_low_usage", [SNAP], flag(or0(SNAP) < 0.20))], "QB": []}
    specs = []
    for group, names in GROUPS.items():
        member = F.col(position).isin(*names)
        specs += [(name, needs, F.when(member, value)) for name, needs, value in _common(group) + extra[group]]
    return derive(df, specs)
