"""Composed expectations, gated predictions, deterministic guards and survival values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import attach_totals, clip, join_on, nz
from .derive import bounded, flag

TEAM_KEYS = ("season", "week", "team", "game_id")


def first_of(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def with_team_plays(df: DataFrame) -> DataFrame:
    """Expected team plays, split by a pass rate of the same window as the pace."""
    pace = first_of(df, ["pred_team_pace", "team_pace_l3", "team_pace_prev", "team_ctx_offensive_plays_l3", "team_ctx_offensive_plays_prev"])
    if pace is None:
        return df
    window = "prev" if pace.endswith("_prev") else "l3"
    rates = [f"team_ctx_pass_rate_{window}", f"team_pass_rate_{window}"]
    others = ["team_ctx_pass_rate_prev", "team_ctx_pass_rate_l3", "team_ctx_pass_rate_l5", "team_pass_rate_prev", "team_pass_rate_l3"]
    plays = bounded(F.col(pace).cast("double"), 0.0)
    columns = {"expected_team_plays": plays}
    rate_name = first_of(df, [*rates, *others])
    if rate_name:
        rate = bounded(F.col(rate_name).cast("double"), 0.0, 1.0)
        columns |= {"expected_team_pass_plays": plays * rate, "expected_team_rush_plays": plays * bounded(1.0 - rate, 0.0, 1.0)}
    return df.withColumns(columns)


def _shares(df: DataFrame, tag: str) -> DataFrame:
    """Expected targets and carries of one prediction family, raw and availability-weighted."""
    have = set(df.columns)
    active = f"pred_availability_active{tag}"
    weight = bounded(F.col(active).cast("double"), 0.0, 1.0) if active in have else F.lit(1.0)
    columns = {}
    for kind, plays, share in (("targets", "pass", "pred_usage_targets"), ("carries", "rush", "pred_usage_carries")):
        if {f"expected_team_{plays}_plays", share + tag} <= have:
            raw = F.col(f"expected_team_{plays}_plays") * clip(nz(share + tag, 0.0), 0.0, 1.0)
            columns |= {f"expected_{kind}_raw{tag}": raw, f"expected_{kind}{tag}": raw * weight}
    return df.withColumns(columns) if columns else df


def reconcile(df: DataFrame, value: str, target: str, keys: Sequence[str], low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Scale ``value`` so that its group sum approaches ``target``; the factor is clipped.

    Groups without a positive sum or target keep their values. Totals are pre-aggregated and
    joined back, so one big group does not end in one task.
    """
    out = attach_totals(df, list(keys), {"_sum": F.sum(value)})
    factor = F.when((F.col(target) > 0) & (F.col("_sum") > 0), clip(F.col(target) / (F.col("_sum") + 1e-6), low, high)).otherwise(1.0)
    return out.withColumn(value, F.col(value) * factor).drop("_sum")


def _family(df: DataFrame, tag: str) -> DataFrame:
    """Opportunities, structural scores and red-zone expectations of one prediction family."""
    df = _shares(df, tag)
    t, c = f"expected_targets{tag}", f"expected_carries{tag}"
    if not {t, c} <= set(df.columns):
        return df
    keys = [k for k in TEAM_KEYS if k in df.columns]
    if keys:
        df = reconcile(df, t, "expected_team_pass_plays", keys)
        df = reconcile(df, c, "expected_team_rush_plays", keys)
    columns = {f"expected_opportunities{tag}": F.col(t) + F.col(c), f"expected_opportunities_raw{tag}": F.col(f"expected_targets_raw{tag}") + F.col(f"expected_carries_raw{tag}")}
    parts = []
    have = set(df.columns)
    for kind, one, role in ((t, "target", "rec"), (c, "carry", "rush")):
        rate_name = f"pred_td_conv_{role}{tag}"
        if rate_name in have:
            rate = bounded(F.col(rate_name).cast("double"), 0.0, 1.0)
            plural = "targets" if one == "target" else "carries"
            expected = rate * clip(nz(kind, 0.0), 0.0)
            columns |= {f"expected_td_rate_per_{one}{tag}": rate, f"expected_td_from_{plural}{tag}": expected}
            parts.append(nz(expected, 0.0))
    df = df.withColumns(columns)
    if parts:
        total = F.greatest(sum(parts[1:], parts[0]), F.lit(0.0))
        probability = 1.0 - F.exp(-total)
        extra = {f"expected_td_count_structural{tag}": total, f"expected_td_prob_structural{tag}": probability}
        if not tag:
            opportunities = nz("expected_opportunities", 0.0)
            extra |= {"anytime_td_structural": probability, "expected_td_rate_per_opportunity": F.when(opportunities != 0, total / opportunities)}
        df = df.withColumns(extra)
    zones = {}
    for kind, share in (("targets", "target"), ("carries", "carry")):
        name = first_of(df, [f"{p}red_zone_{share}_share_{w}" for p in ("hist_", "") for w in ("prev", "l3")])
        if name:
            for raw in ("", "_raw"):
                zones[f"expected_rz_{kind}{raw}{tag}"] = F.col(f"expected_{kind}{raw}{tag}") * clip(nz(name, 0.0), 0.0, 1.0)
    if len(zones) == 4 and not tag:
        for raw in ("", "_raw"):
            zones[f"expected_rz_opportunities{raw}"] = zones[f"expected_rz_targets{raw}"] + zones[f"expected_rz_carries{raw}"]
    return df.withColumns(zones) if zones else df


def compose_expectations(df: DataFrame) -> DataFrame:
    """Expected counts from component predictions; the same function trains and scores."""
    df = with_team_plays(df)
    have = set(df.columns)
    early = {}
    if "pred_snaps" in have:
        snaps = F.greatest(nz("pred_snaps", 0.0), F.lit(0.0))
        early |= {"expected_snaps": snaps, "expected_snaps_raw": snaps}
        if "availability_uncertainty" in have:
            early["expected_snaps_stable"] = snaps * (1.0 - clip(nz("availability_uncertainty", 0.0), 0.0, 0.25))
    df = df.withColumns(early) if early else df
    df = _family(_family(df, ""), "_moe")
    have = set(df.columns)
    late: dict[str, Column] = {}
    for name, source in (("team_red_zone_rate", "red_zone"), ("team_goal_to_go_rate", "goal_to_go")):
        rate = first_of(df, [f"team_{source}_play_rate_prev", f"team_{source}_play_rate_l3"])
        if rate:
            late[name] = clip(nz(rate, 0.0), 0.0, 1.0)
    if "expected_opportunities" in have:
        if "availability_uncertainty" in have:
            late["expected_opportunities_stable"] = F.col("expected_opportunities") * (1.0 - clip(nz("availability_uncertainty", 0.0), 0.0, 0.25))
        for raw in ("", "_raw"):
            if "team_red_zone_rate" in late:
                late[f"team_based_rz_opportunities{raw}"] = F.col(f"expected_opportunities{raw}") * late["team_red_zone_rate"]
            if "pred_efficiency_tds" in have:
                signal = F.col("pred_efficiency_tds") * F.col(f"expected_opportunities{raw}")
                late |= {f"expected_td_signal{raw}": signal, f"expected_td_prob_poisson{raw}": 1.0 - F.exp(-bounded(signal, 0.0))}
            if {"pred_efficiency_tds", f"expected_rz_opportunities{raw}"} <= have:
                signal = F.col("pred_efficiency_tds") * F.col(f"expected_rz_opportunities{raw}")
                late |= {f"expected_rz_td_signal{raw}": signal, f"expected_rz_td_prob_poisson{raw}": 1.0 - F.exp(-bounded(signal, 0.0))}
        for source, name, kind, top in (
            ("pred_efficiency_rec_success", "expected_rec_success", "targets", 1.0),
            ("pred_efficiency_rush_success", "expected_rush_success", "carries", 1.0),
            ("pred_efficiency_rec_yards", "expected_receiving_yards", "targets", None),
            ("pred_efficiency_rush_yards", "expected_rushing_yards", "carries", None),
            ("pred_td_conv_rec", "expected_rz_td_from_targets", "rz_targets", 1.0),
            ("pred_td_conv_rush", "expected_rz_td_from_carries", "rz_carries", 1.0),
        ):
            if {source, f"expected_{kind}"} <= have:
                late[name] = bounded(F.col(source).cast("double"), 0.0, top) * F.greatest(nz(f"expected_{kind}", 0.0), F.lit(0.0))
        if {"expected_receiving_yards", "expected_rushing_yards"} <= set(late):
            total = late["expected_receiving_yards"] + late["expected_rushing_yards"]
            opportunities = nz("expected_opportunities", 0.0)
            late |= {"expected_total_yards": total, "expected_yards_per_opportunity": F.when(opportunities != 0, total / opportunities)}
    return df.withColumns(late) if late else df


# --- gates and guards ---------------------------------------------------------------------------

# Label gates of the problems (problem -> column, smallest or largest value kept).
LABEL_GATES = {
    "snaps": ("is_inactive", "<=", 0.0),
    **{p: ("snaps_label", ">", 0.0) for p in ("usage_targets", "usage_carries", "usage_target_yards")},
    **{p: ("target", ">", 0.0) for p in ("efficiency_rec_yards_air", "efficiency_rec_yards_yac", "efficiency_rec_yards", "td_conv_rec")},
    **{p: ("carry", ">", 0.0) for p in ("efficiency_rush_yards", "efficiency_rush_success", "td_conv_rush")},
}


def label_gate(df: DataFrame, problem: str) -> Column:
    """Rows that may influence a problem; problems without a gate keep every row."""
    name, op, bound = LABEL_GATES.get(problem, ("", "", 0.0))
    if name not in df.columns:
        return F.lit(True)
    value = nz(F.col(name).cast("double"), 0.0)
    return value <= bound if op == "<=" else value > bound


# Upstream prediction that a problem depends on.
UPSTREAM = {
    "snaps": "availability_active",
    **{p: "snaps" for p in ("usage_targets", "usage_carries", "usage_target_yards")},
    **{p: "usage_targets" for p in ("efficiency_rec_yards_air", "efficiency_rec_yards_yac", "efficiency_rec_yards", "td_conv_rec")},
    **{p: "usage_carries" for p in ("efficiency_rush_yards", "efficiency_rush_success", "td_conv_rush")},
}


def gated_predictions(df: DataFrame, active_threshold: float = 0.5, family: str = "global") -> DataFrame:
    """Chain of predictions: each counts only where its upstream passed, else 0.

    Adds ``gate_<problem>_<family>``. A missing upstream column lets every row pass.
    """
    tag = "" if family == "global" else f"_{family}"
    for problem, upstream in UPSTREAM.items():
        name, source = f"pred_{problem}{tag}", f"pred_{upstream}{tag}"
        if name not in df.columns:
            continue
        if source not in df.columns:
            gate = F.lit(True)
        elif upstream == "availability_active":
            gate = nz(source, 0.0) >= active_threshold
        else:
            gate = nz(source, 0.0) > 0
        df = df.withColumns({f"gate_{problem}_{family}": flag(gate), name: F.when(gate, nz(name, 0.0)).otherwise(0.0)})
    return df


def guard_availability(df: DataFrame, pred: str) -> DataFrame:
    """Zero ruled-out players and dampen doubtful, limited and likely inactive ones."""
    have = set(df.columns)
    p = F.col(pred).cast("double")
    if "injury_is_inactive_designation" in have:
        p = F.when(nz("injury_is_inactive_designation") != 0, 0.0).otherwise(p)
    if "injury_game_designation" in have:
        d = F.upper(nz("injury_game_designation", ""))
        p = p * F.when(d.isin("OUT", "INACTIVE"), 0.0).when(d == "DOUBTFUL", 0.25).when(d == "QUESTIONABLE", 0.85).otherwise(1.0)
    if "injury_practice_status" in have:
        s = F.upper(nz("injury_practice_status", ""))
        p = p * F.when(s.contains("DID NOT PARTICIPATE"), 0.55).otherwise(1.0) * F.when(s.contains("LIMITED"), 0.85).otherwise(1.0)
    source = first_of(df, ["injury_inactive_probability_model", "injury_inactive_probability"])
    if source:
        q = clip(nz(source, 0.0), 0.0, 0.95)
        p = p * F.when(q >= 0.5, clip(1.0 - q, 0.05, 1.0)).otherwise(1.0)
    return df.withColumn(pred, clip(p, 0.0, 1.0))


def floor_availability(df: DataFrame, pred: str) -> DataFrame:
    """Active players without snap history get at least .9 (quarterbacks) or .35."""
    if "snap_offense_pct_l3" not in df.columns:
        return df
    fresh = nz("snap_offense_pct_l3", 0.0) == 0
    if "injury_is_inactive_designation" in df.columns:
        fresh = fresh & (nz("injury_is_inactive_designation") == 0)
    least = F.when(F.col("position") == "QB", 0.9).otherwise(0.35) if "position" in df.columns else F.lit(0.35)
    return df.withColumn(pred, F.when(fresh, F.greatest(F.col(pred), least)).otherwise(F.col(pred)))


def cap_snaps(df: DataFrame, pred: str) -> DataFrame:
    """Low-usage players may not exceed one and a half times their ceiling."""
    cap = F.col("snap_ceiling_l5") * 1.5
    low = F.col("max_snap_pct_l5") < 0.25
    return df.withColumn(pred, F.when(low & (F.col(pred) > cap), cap).otherwise(F.col(pred)))


def _cap(value: Column, condition: Column, top: Column | float) -> Column:
    return F.when(condition & (value > top), top).otherwise(value)


def cap_targets(df: DataFrame, pred: str) -> DataFrame:
    """Quarterbacks 0; fullbacks at most .10; backs at most 1.5 times their history, .03 at least."""
    p, v = F.col("position"), F.col(pred)
    v = F.when(p == "QB", 0.0).otherwise(v)
    if "is_fullback" in df.columns:
        v = _cap(v, F.col("is_fullback") == 1, 0.10)
    if "hist_target_share_l3" in df.columns:
        v = _cap(v, p == "RB", F.greatest(nz("hist_target_share_l3", 0.0) * 1.5, F.lit(0.03)))
    return df.withColumn(pred, v)


def cap_carries(df: DataFrame, pred: str) -> DataFrame:
    v = F.col(pred)
    for position, top in (("WR", 0.05), ("TE", 0.02), ("QB", 0.30)):
        v = _cap(v, F.col("position") == position, top)
    if "is_fullback" in df.columns:
        v = _cap(v, F.col("is_fullback") == 1, 0.10)
    return df.withColumn(pred, v)


def cap_target_yards(df: DataFrame, pred: str) -> DataFrame:
    p = F.col("position")
    v = F.when(p == "QB", 0.0).when(p == "RB", clip(F.col(pred), 0.0, 2.0)).otherwise(F.col(pred))
    if "is_fullback" in df.columns:
        v = F.when(F.col("is_fullback") == 1, 0.0).otherwise(v)
    return df.withColumn(pred, v)


def cap_air_yards(df: DataFrame, pred: str) -> DataFrame:
    v = _cap(F.col(pred), F.col("position") == "RB", 0.0)
    if "is_fullback" in df.columns:
        v = F.when(F.col("is_fullback") == 1, 0.0).otherwise(v)
    return df.withColumn(pred, v)


GUARDS = {
    "availability_active": guard_availability,
    "snaps": cap_snaps,
    "usage_targets": cap_targets,
    "usage_carries": cap_carries,
    "usage_target_yards": cap_target_yards,
    "efficiency_rec_yards_air": cap_air_yards,
}


# --- team totals ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class TeamTotals:
    """Fitted scaling of player probabilities to implied team totals."""

    divisor: float = 6.8
    global_scale: float = 1.0
    mean_total: float = 21.0
    keys: tuple[str, ...] = ("season", "week", "team")
    min_scale: float = 0.25
    max_scale: float = 3.0
    weights: tuple[str, ...] = ()
    role_intensity: float = 0.5


def fit_team_totals(df: DataFrame, target: str, keys: Sequence[str] = ("season", "week", "team"), weights: Sequence[str] = ()) -> TeamTotals:
    """Points per score and overall scale of a training frame; three one-row aggregates."""
    mean = df.agg(F.avg("team_implied_total").alias("m")).first()["m"]
    mean = mean if mean and mean > 0 else 21.0
    groups = df.groupBy(*keys).agg(F.avg(nz("team_implied_total", mean)).alias("implied"), F.sum(nz(target, 0.0)).alias("actual"))
    row = groups.agg(F.sum("implied").alias("implied"), F.sum("actual").alias("actual")).first()
    divisor = 6.8 if row["actual"] <= 1e-6 else min(12.0, max(3.0, row["implied"] / row["actual"]))
    expected = row["implied"] / divisor
    scale = 1.0 if expected <= 1e-6 else min(3.0, max(0.25, row["actual"] / expected))
    present = tuple(w for w in weights if w in df.columns)
    return TeamTotals(divisor, scale, mean, tuple(keys), weights=present)


def scale_to_team_totals(df: DataFrame, prob: str, fit: TeamTotals, out: str | None = None) -> DataFrame:
    """Scale probabilities to the implied team total, lean by role weight, renormalise, clip."""
    keys = list(fit.keys)
    weight = sum((F.greatest(nz(w, 0.0), F.lit(0.0)) for w in fit.weights), F.lit(0.0))
    base = df.withColumns({"_implied": nz("team_implied_total", fit.mean_total), "_w": weight})
    base = attach_totals(base, keys, {"_expected": F.greatest(F.avg("_implied") / fit.divisor, F.lit(0.0)), "_pred": F.sum(prob), "_mean_w": F.avg("_w")})
    scale = F.when(F.col("_pred") >= 0.1, F.col("_expected") / F.col("_pred"))
    value = F.col(prob) * clip(nz(scale, fit.global_scale), fit.min_scale, fit.max_scale)
    if fit.weights and fit.role_intensity > 0:
        lean = F.when(F.col("_mean_w") > 0, F.col("_w") / F.col("_mean_w")).otherwise(F.col("_w"))
        value = value * clip(1.0 + fit.role_intensity * (lean - 1.0), 0.25, 4.0)
        base = attach_totals(base.withColumn("_value", value), keys, {"_sum": F.sum("_value")})
        value = F.col("_value") * F.when(F.col("_sum") > 0, F.col("_expected") / F.col("_sum")).otherwise(1.0)
    return base.withColumn(out or prob, clip(value, 0.0, 1.0)).drop("_implied", "_w", "_expected", "_pred", "_mean_w", "_value", "_sum")


# --- survival columns to expected values ---------------------------------------------------------

SURVIVAL_EPS = 1e-6


def survival_to_pmf(df: DataFrame, survival: Sequence[str], prefix: str = "pmf_") -> DataFrame:
    """``P(Y >= 1..K)`` columns made non-increasing, then ``pmf_0 .. pmf_K`` (last is the tail)."""
    kept: list[Column] = []
    columns = {}
    for i, name in enumerate(survival, 1):
        value = clip(F.col(name).cast("double"), SURVIVAL_EPS, 1 - SURVIVAL_EPS)
        kept.append(value if i == 1 else F.least(kept[-1], value))
        columns[f"survival_{i}"] = kept[-1]
    out = df.withColumns(columns)
    s = [F.col(f"survival_{i}") for i in range(1, len(survival) + 1)]
    mass = [1.0 - s[0], *[a - b for a, b in zip(s, s[1:], strict=False)], s[-1]]
    total = sum(mass[1:], mass[0])
    return out.withColumns({f"{prefix}{i}": m / total for i, m in enumerate(mass)})


def expected_value(df: DataFrame, heads: Sequence[str], tail_mean: float, tail_ratio: float = 0.35, top: int = 5, out: str = "expected_value") -> DataFrame:
    """Expected count from ordinal heads; a missing last head is the one before times the ratio."""
    names = list(heads)
    if len(names) < top:
        df = df.withColumn("_tail_head", clip(F.col(names[-1]) * tail_ratio, 0.0, 1.0))
        names.append("_tail_head")
    df = survival_to_pmf(df, names)
    values = [float(i) for i in range(len(names))] + [float(tail_mean)]
    total = sum((F.col(f"pmf_{i}") * v for i, v in enumerate(values)), F.lit(0.0))
    return df.withColumn(out, total).drop("_tail_head")


def tail_parameters(df: DataFrame, count: str, keys: Sequence[str] = (), k: int = 5) -> DataFrame:
    """``P(Y >= k) / P(Y >= k - 1)`` and ``E[Y | Y >= k]`` per group."""
    y = F.col(count)
    n4, n5 = F.sum(flag(y >= k - 1)), F.sum(flag(y >= k))
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(
        F.when(n4 > 0, n5 / n4).otherwise(0.0).alias("tail_ratio"), nz(F.avg(F.when(y >= k, y.cast("double"))), float(k)).alias("tail_mean")
    )


# --- sample weights ------------------------------------------------------------------------------


def sample_weights(df: DataFrame, config: Mapping, target: str | None = None, opportunity: str | None = None, out: str = "sample_weight") -> DataFrame:
    """Season decay, week and current-season boosts, clip, normalise to mean 1, then opportunities.

    The reference season, its last week and the mean weight are one-row scalar subqueries.
    """
    current = config.get("reference_season")
    season = F.col("season")
    base = df.withColumn("_now", F.lit(int(current)) if current is not None else df.agg(F.max("season")).scalar())
    mine = season == F.col("_now")
    weight = F.pow(F.lit(float(config.get("season_decay", 0.6))), F.greatest(F.col("_now") - nz(season, 9999), F.lit(0)))
    boost = float(config.get("current_season_week_boost", 0.0))
    if boost and "week" in df.columns:
        last = F.lit(int(current)) if current is not None else df.agg(F.max("season")).scalar()
        base = base.withColumn("_last_week", df.where(season == last).agg(F.max("week")).scalar())
        part = F.when(F.col("_last_week") > 0, clip(nz("week", 0) / F.col("_last_week"), 0.0, 1.0)).otherwise(0.0)
        weight = weight * F.when(mine, 1.0 + boost * part).otherwise(1.0)
    weight = weight * F.when(mine, float(config.get("current_season_multiplier", 1.0))).otherwise(1.0)
    if target:
        weight = weight * F.when(mine & (nz(target, 0) > 0), float(config.get("current_season_positive_multiplier", 1.0))).otherwise(1.0)
    start = int(config.get("recent_week_boost_start", 0))
    if start > 0 and "week" in df.columns:
        weight = weight * F.when(mine & (nz("week", 0) >= start), float(config.get("recent_week_boost_multiplier", 1.0))).otherwise(1.0)
    base = base.withColumn(out, clip(weight, float(config.get("min_weight", 0.1)), float(config.get("max_weight", 3.0))))
    if config.get("normalize", True):
        base = base.withColumn(out, F.col(out) / base.agg(F.avg(out)).scalar())
    if opportunity:
        base = base.withColumn(out, F.col(out) * nz(opportunity, 0.0))
    return base.drop("_now", "_last_week")


def with_labels_joined(df: DataFrame, stats: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Attach a target that lives in another frame."""
    return join_on(df.drop(column), stats.select(*keys, column), list(keys))


def shifted_target(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, shift: int, out: str) -> DataFrame:
    """Target from a later (negative ``shift``) or earlier row of the group; rows without one are dropped."""
    from ..operators.prior import later_rows, prior_rows

    step = later_rows if shift < 0 else prior_rows
    moved = step(df, list(keys), list(order), max(abs(shift), 1), lambda w: {out: F.lag(column, abs(shift)).over(w)})
    return moved.where(F.col(out).isNotNull())
