"""Priors and shrinkage: catch rates and target depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators.prior import last_rows, prefix_sums, prior_rows
from .derive import bounded, derive, flag, lookup, or0, tier

# Priors by position.
CATCH_PRIOR = {"RB": 0.77, "TE": 0.70, "WR": 0.62, "FB": 0.75}
SHRINK_PRIOR = {"RB": 0.77, "TE": 0.70, "WR": 0.62}
DEPTH_PRIOR = {"WR": 10.7, "TE": 6.2, "RB": 0.3, "FB": 0.0, "QB": 0.0}
DEPTH_FALLBACK = {"WR": 10.7, "TE": 6.2, "RB": 0.3}
DEPTH_SPREAD = {"WR": 7.4, "TE": 5.5, "RB": 4.1}
DEPTH_RANK = {"WR": 3, "TE": 2, "RB": 1, "FB": 0, "QB": 0}
DEPTH_CEILING = {"RB": 3.0, "FB": 0.0, "TE": 12.0, "WR": 30.0}
EPSILON = 1e-6


def with_catch_history(df: DataFrame, entity: str = "player_id", order: str = "game_date", plan="auto") -> DataFrame:
    """Career, last-3, last-5 and previous catch rates; never NULL, at most 1."""
    made, tried = or0("reception", 0), or0("target", 0)

    def rate(a: Column, b: Column) -> Column:
        return bounded(or0_of(a) / (or0_of(b) + EPSILON), 0.0, 1.0)

    def recent(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for label, n in (("l3", 3), ("l5", 5), ("prev", 1)):
            frame = last_rows(w, n)
            out[f"hist_catch_rate_{label}"] = rate(F.sum(made).over(frame), F.sum(tried).over(frame))
            if n > 1:
                out[f"hist_targets_count_{label}"] = or0_of(F.sum(tried).over(frame)).cast("int")
        return out

    out = prior_rows(df, entity, order, 5, recent, plan=plan)
    out = prefix_sums(out, entity, order, {"_made": made, "_tried": tried}, plan=plan)
    return out.withColumn("hist_catch_rate_career", rate(F.col("_made"), F.col("_tried"))).drop("_made", "_tried")


def or0_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def with_catch_priors(df: DataFrame) -> DataFrame:
    p = F.col("position")
    n, rate, prior = F.col("hist_targets_count_l5"), F.col("hist_catch_rate_l5"), lookup(p, SHRINK_PRIOR, 0.70)
    shrunk = F.when(n >= 20, rate).when(n >= 5, rate * 0.7 + prior * 0.3).otherwise(prior)
    depth = bounded(0.70 - or0("hist_air_yards_per_target_l3", 5.0) * 0.015, 0.40, 0.90)
    return derive(
        df,
        [
            ("position_catch_rate_prior", ["position"], lookup(p, CATCH_PRIOR, 0.70)),
            ("shrunk_catch_rate_estimate", ["position", "hist_catch_rate_l5", "hist_targets_count_l5"], shrunk),
            ("depth_adjusted_catch_rate_prior", ["hist_air_yards_per_target_l3"], depth),
        ],
    )


def with_air_yards_history(df: DataFrame, entity: str = "player_id", order: str = "game_date", plan="auto") -> DataFrame:
    """Sums of air yards and targets over the last 1, 3 and 5 rows; 0 without history."""

    def recent(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for source, names in (
            ("air_yards_all_targets", ("air_yards_prev_game", "hist_air_yards_sum_l3", "hist_air_yards_sum_l5")),
            ("target", ("targets_prev_game", "hist_targets_l3", "hist_targets_l5")),
        ):
            for name, n in zip(names, (1, 3, 5), strict=True):
                out[name] = or0_of(F.sum(source).over(last_rows(w, n))).cast("double")
        return out

    return prior_rows(df, entity, order, 5, recent, plan=plan)


def with_depth_priors(df: DataFrame) -> DataFrame:
    p = F.col("position")
    return derive(
        df,
        [
            ("position_target_depth_prior", ["position"], lookup(p, DEPTH_PRIOR, 5.0)),
            ("position_depth_variance", ["position"], lookup(p, DEPTH_SPREAD, 5.0)),
            ("position_depth_rank", ["position"], lookup(p, DEPTH_RANK, 1)),
            ("is_short_target_position", ["position"], flag(p.isin("RB", "FB", "QB"))),
            ("is_deep_target_position", ["position"], flag(p == "WR")),
            ("position_depth_ceiling", ["position"], lookup(p, DEPTH_CEILING, 5.0)),
        ],
    )


def with_depth_tendencies(df: DataFrame) -> DataFrame:
    """Alignment, quarterback and role tendencies."""
    p = F.col("position")
    slot, wide, air, share = "ps_hist_targets_slot_share_l3", "ps_hist_targets_wide_share_l3", "qb_profile_avg_air_yards_l3", "hist_target_share_l3"
    s, w, a, t = or0(slot, 0.33), or0(wide, 0.33), or0(air, 8.0), or0(share)
    return derive(
        df,
        [
            ("wr_slot_tendency", [slot], bounded(s, 0.0, 1.0)),
            ("wr_outside_tendency", [slot, wide], bounded(w, 0.0, 1.0)),
            ("wr_slot_vs_outside", [slot, wide], s - w),
            ("adjusted_target_depth_prior", ["position", slot], F.when(p == "WR", 10.7 - 3.0 * (s - 0.33)).when(p == "TE", 6.2).when(p == "RB", 0.3).otherwise(0.0)),
            ("qb_air_yards_tendency", [air], bounded(a, 3.0, 15.0)),
            ("qb_scaled_target_depth", ["position", air], F.when(p == "WR", a / 8.0 * 10.7).when(p == "TE", a / 8.0 * 6.2).when(p == "RB", 0.3).otherwise(0.0)),
            ("rb_receiving_depth_tendency", ["position", share], F.when(p == "RB", 0.3 + t * 5.0)),
            ("wr_route_depth_tendency", ["position", wide], F.when(p == "WR", w * 3.0 + 9.0)),
            ("te_receiving_depth_tendency", ["position", share], F.when(p == "TE", 4.0 + t * 20.0)),
        ],
    )


def with_depth_estimates(df: DataFrame) -> DataFrame:
    """Per-target depth, archetypes and shrunk depth from the air-yards history."""
    p = F.col("position")
    prior = lookup(p, DEPTH_FALLBACK, 5.0)

    def per(yards: str, targets: str) -> Column:
        return F.col(yards) / bounded(F.col(targets), 1.0)

    l3, l5, prev = (
        per("hist_air_yards_sum_l3", "hist_targets_l3"),
        per("hist_air_yards_sum_l5", "hist_targets_l5"),
        per("air_yards_prev_game", "targets_prev_game"),
    )
    n3, n5 = F.col("hist_targets_l3"), F.col("hist_targets_l5")
    base = ["hist_air_yards_sum_l3", "hist_targets_l3", "hist_air_yards_sum_l5", "hist_targets_l5", "air_yards_prev_game", "targets_prev_game", "position"]

    def blend(weight: float) -> Column:
        return weight * l5 + (1 - weight) * prior

    shrunk = F.when(n5 >= 10, blend(0.9)).when(n5 >= 6, blend(0.8)).when(n5 >= 3, blend(0.7)).when(n5 >= 1, blend(0.5)).otherwise(prior)
    best = F.when(n5 >= 5, l5).when(n3 >= 2, 0.7 * l3 + 0.3 * prior).otherwise(prior)
    unsure = F.when(n5 >= 15, 0.2).when(n5 >= 10, 0.4).when(n5 >= 5, 0.6).otherwise(0.8)
    weighted = F.coalesce(F.when(F.col("targets_prev_game") >= 1, 0.6 * prev + 0.4 * l5).otherwise(l5), F.lit(0.0))
    return derive(
        df,
        [
            ("hist_air_yards_per_target_l3", base, or0_of(l3)),
            ("hist_air_yards_per_target_l5", base, or0_of(l5)),
            ("air_yards_per_target_prev", base, or0_of(prev)),
            ("expected_target_depth", base, F.when(n3 >= 3, l3).otherwise(prior)),
            ("wr_depth_archetype", base, F.when(p == "WR", tier(l5, [(15, 4), (10, 3), (5, 2)], 1)).otherwise(0)),
            ("te_depth_archetype", base, F.when(p == "TE", tier(l5, [(8, 3), (4, 2)], 1)).otherwise(0)),
            ("has_depth_history", base, flag(n5 >= 5)),
            ("player_depth_vs_position", base, F.when(n5 >= 3, l5 - prior).otherwise(0.0)),
            ("hist_target_volume_l3", base, or0_of(n3).cast("double")),
            ("hist_target_volume_l5", base, or0_of(n5).cast("double")),
            ("depth_uncertainty", base, unsure),
            ("shrunk_depth_estimate", base, shrunk),
            ("best_depth_estimate", base, best),
            ("weighted_expected_depth", base, weighted),
        ],
    )
