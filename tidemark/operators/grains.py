"""Coarser grains from events: role aggregates, totals by context, team contexts, profiles.

Everything here is a hash aggregate with map-side partial sums; nothing is collected per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .keys import attach_totals, join_on, nz, ratio
from .prior import last_rows, prefix_sums, prior_rows
from .quantiles import median
from .slices import dealt

# --- roles to entity rows -------------------------------------------------------------------

ROLES = ("passer", "rusher", "receiver")
# Sums credited to each role (output column -> input column).
ROLE_SUMS = {
    "passer": {
        "passing_yards": "passing_yards", "pass_attempt": "pass_attempt", "completion": "completion",
        "passing_td": "pass_touchdown", "rushing_yards": "rushing_yards", "carry": "carry",
        "rushing_td_count": "rush_touchdown", "red_zone_carry": "red_zone_carry", "goal_to_go_carry": "goal_to_go_carry",
    },
    "rusher": {
        "rushing_yards": "rushing_yards", "carry": "carry", "rushing_td_count": "rush_touchdown",
        "red_zone_carry": "red_zone_carry", "goal_to_go_carry": "goal_to_go_carry",
    },
    "receiver": {
        "receiving_yards": "receiving_yards", "target": "target", "reception": "reception",
        "receiving_td_count": "pass_touchdown", "red_zone_target": "red_zone_target",
        "goal_to_go_target": "goal_to_go_target", "air_yards_all_targets": "air_yards",
        "yards_after_catch_total": "yards_after_catch",
    },
}
FLOATS = ("passing_yards", "rushing_yards", "receiving_yards", "air_yards_all_targets", "air_yards_total", "yards_after_catch_total")


def _role_measures(have: set[str], role: str, names: Sequence[str]) -> list[Column]:
    """The measures one role contributes; 0 for those it has no part in."""
    carried = nz("carry") > 0 if "carry" in have else F.lit(False)
    runner = role in ("passer", "rusher")
    special = {}
    if runner and {"carry", "ydstogo"} <= have:
        special["short_yard_carry"] = F.when(carried & (nz("ydstogo", 100) <= 2), 1).otherwise(0)
    if runner and {"carry", "down"} <= have:
        special["third_down_carry"] = F.when(carried & (F.col("down") == 3), 1).otherwise(0)
    if role == "receiver" and {"complete_pass", "air_yards"} <= have:
        special["air_yards_total"] = F.when(F.col("complete_pass") == 1, nz("air_yards")).otherwise(0)
    if role == "passer" and "yards_gained" in have:
        special["rush_success_plays"] = F.when(F.col("yards_gained") > 0, 1).otherwise(0)
    if {"touchdown_player_id", "touchdown"} <= have:
        own = F.col("touchdown_player_id") == F.col(f"{role}_player_id")
        special["touchdowns"] = F.when(own, nz("touchdown")).otherwise(0)
    given = {out: nz(source) for out, source in ROLE_SUMS[role].items() if source in have}
    return [({**given, **special}.get(n, F.lit(0))).cast("double" if n in FLOATS else "bigint").alias(n) for n in names]


def explode_roles(plays: DataFrame, keep: Sequence[str], roles: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per (event, role, player) with that role's measures; at most three per event.

    The measures are computed while the row is expanded, so the aggregate that follows is plain
    sums over columns.
    """
    have = set(plays.columns)
    entries = []
    for role in roles:
        if f"{role}_player_id" in have:
            name = F.col(f"{role}_player_name") if f"{role}_player_name" in have else F.lit(None).cast("string")
            entry = F.struct(F.col(f"{role}_player_id").alias("player_id"), name.alias("player_name"), *_role_measures(have, role, measures))
            entries.append(F.when(F.col(f"{role}_player_id").isNotNull(), entry))
    kept = [c for c in keep if c in have]
    out = plays.select(*kept, F.explode(F.array(*entries)).alias("_r")).where(F.col("_r").isNotNull())
    return out.select(*kept, "_r.*")


def entity_totals(plays: DataFrame, keys: Sequence[str], roles: Sequence[str] = ROLES) -> DataFrame:
    """Totals per (keys, player) over all roles, in one aggregation.

    Each role contributes its own sums; a player with two roles in a game gets the sum of both.
    Own scores count once per role in which the event names the player.
    """
    have = set(plays.columns)
    measures = list(dict.fromkeys(out for role in roles for out, source in ROLE_SUMS[role].items() if source in have))
    extras = {
        "short_yard_carry": {"carry", "ydstogo"}, "third_down_carry": {"carry", "down"}, "air_yards_total": {"complete_pass", "air_yards"},
        "rush_success_plays": {"yards_gained"}, "touchdowns": {"touchdown_player_id", "touchdown"},
    }
    measures += [n for n, needs in extras.items() if needs <= have]
    rows = explode_roles(plays, [*keys, "posteam", "defteam"], roles, measures)
    sides = {s: n for s, n in (("posteam", "team"), ("defteam", "opponent")) if s in have and s not in keys}
    grain = [*keys, "player_id", "player_name"]
    totals = rows.groupBy(*grain, *sides).agg(*[F.sum(n).alias(n) for n in measures])
    if not sides:
        return totals
    # A minimum of text cannot live in a hash aggregate and would sort the raw rows; here it only
    # meets rows that are already summed. The team of a player in a game is constant, so the
    # second grouping has nothing left to merge but faulty feeds.
    return totals.groupBy(*grain).agg(*[F.sum(n).alias(n) for n in measures], *[F.min(s).alias(n) for s, n in sides.items()])


def group_totals(plays: DataFrame, keys: Sequence[str], yards: str = "yards_gained", score: str = "touchdown") -> DataFrame:
    """Events, yards and scores per drive or game (choose by ``keys``)."""
    return plays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_plays"), F.sum(nz(yards)).alias("yards"), F.sum(nz(score)).alias("tds")
    )


def drive_measures(drives: DataFrame) -> dict[str, Column]:
    """Aggregates over a game's drives: how many there were and how many had a touch, a score, a red-zone or goal-to-go touch."""
    have = set(drives.columns)

    def any_use(*names: str) -> Column:
        used = sum((nz(n) for n in names if n in have), F.lit(0))
        return F.sum(F.when(used > 0, 1).otherwise(0))

    aggs = {
        "drive_count": F.count(F.lit(1)),
        "drive_touch_drives": any_use("carry", "target", "pass_attempt", "reception"),
        "drive_td_drives": any_use("touchdown"),
        "drive_total_yards": F.sum(sum((nz(c) for c in ("passing_yards", "rushing_yards", "receiving_yards") if c in have), F.lit(0.0))),
    }
    for zone in ("red_zone", "goal_to_go"):
        if {f"{zone}_carry", f"{zone}_target"} <= have:
            aggs[f"drive_{zone}_drives"] = any_use(f"{zone}_carry", f"{zone}_target")
    return aggs


def drive_summary(drives: DataFrame, keys: Sequence[str] = ("game_id", "team", "player_id", "season", "week")) -> DataFrame:
    """Drives per game and how many had a touch, a score, a red-zone or goal-to-go touch."""
    keys = [k for k in keys if k in drives.columns]
    aggs = {"game_date": F.max("game_date")} | drive_measures(drives)
    return drives.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


# Fixed values: (numerator, denominator, label) of the drive rates.
DRIVE_RATES = (
    ("touch_drives", "count", "touch_rate"),
    ("td_drives", "count", "td_rate"),
    ("total_yards", "count", "yards_per_drive"),
    ("red_zone_drives", "count", "red_zone_rate"),
    ("goal_to_go_drives", "count", "goal_to_go_rate"),
)


def drive_history(summary: DataFrame, keys: Sequence[str] = ("player_id", "team"), order: str = "game_date", plan="auto") -> DataFrame:
    """Cumulative (``_prev``) and last-3 (``_l3``) drive sums before the game, with their rates."""
    measures = [c for c in summary.columns if c.startswith("drive_")]
    names = {m: m.removeprefix("drive_") for m in measures}

    def recent(w: WindowSpec) -> dict[str, Column]:
        out = {f"drive_hist_{n}_l3": nz(F.sum(m).over(last_rows(w, 3)), 0.0) for m, n in names.items()}
        return out | {"data_as_of": F.lag(order).over(w)}

    out = prior_rows(summary, list(keys), order, 3, recent, plan=plan)
    out = prefix_sums(out, list(keys), order, {f"drive_hist_{n}_prev": F.col(m) for m, n in names.items()}, plan=plan)
    rates = {}
    for num, den, label in DRIVE_RATES:
        if num in names.values():
            for w in ("prev", "l3"):
                rates[f"drive_hist_{label}_{w}"] = ratio(F.col(f"drive_hist_{num}_{w}"), F.col(f"drive_hist_{den}_{w}"), 0.0)
    return out.withColumns(rates).drop(*measures)


# --- totals by context ------------------------------------------------------------------------


def context_totals(
    df: DataFrame,
    entity: str,
    day: str,
    contexts: Mapping[str, Sequence[str]],
    stats: Sequence[str],
    extra: Sequence[str] = (),
    denom: str = "denom",
) -> DataFrame:
    """Totals per (context, entity, day) for several contexts in one shuffle of the rows by entity and day, in tasks of bounded size.

    ``contexts`` maps a label to the extra grouping columns, e.g. ``{"vs_any": [], "vs_team":
    ["opponent"], "with_team": ["team"]}``. Unused grouping columns are NULL in a row.
    """
    dims = sorted({c for cols in contexts.values() for c in cols})
    # Sum the events to the finest grain first: it and all contexts are groupings of rows that lie together by entity and day.
    finest = dealt(df, [entity, day], 1 + len(contexts)).groupBy(entity, day, *extra, *dims).agg(
        *[F.sum(nz(s)).alias(f"{s}_num") for s in stats], F.count(F.lit(1)).alias(denom)
    )
    branches = F.array(
        *[
            F.struct(F.lit(label).alias("ctx"), *[(F.col(d) if d in cols else F.lit(None).cast(df.schema[d].dataType)).alias(d) for d in dims])
            for label, cols in contexts.items()
        ]
    )
    wide = finest.withColumn("_c", F.explode(branches)).select(
        "_c.ctx", *[F.col(f"_c.{d}").alias(d) for d in dims], entity, day, *extra, *[f"{s}_num" for s in stats], denom
    )
    return wide.groupBy("ctx", entity, day, *extra, *dims).agg(
        *[F.sum(f"{s}_num").alias(f"{s}_num") for s in stats], F.sum(denom).alias(denom)
    )


# Rates of a team context (name -> numerator, denominator).
CONTEXT_RATES = {
    "pass_rate": ("pass_attempts", "offensive_plays"),
    "rush_rate": ("carries", "offensive_plays"),
    "target_per_play": ("targets", "offensive_plays"),
    "td_per_play": ("total_tds", "offensive_plays"),
    "yards_per_play": ("total_yards", "offensive_plays"),
    "red_zone_play_rate": ("red_zone_plays", "offensive_plays"),
    "goal_to_go_play_rate": ("goal_to_go_plays", "offensive_plays"),
    "pass_completion_rate": ("completions", "pass_attempts"),
    "pass_yards_per_attempt": ("passing_yards", "pass_attempts"),
    "rush_yards_per_carry": ("rushing_yards", "carries"),
}
# Sums of a team context (input -> output).
CONTEXT_SUMS = {
    "pass_attempt": "pass_attempts", "completion": "completions", "carry": "carries", "target": "targets",
    "red_zone_target": "red_zone_targets", "red_zone_carry": "red_zone_carries",
    "goal_to_go_target": "goal_to_go_targets", "goal_to_go_carry": "goal_to_go_carries",
    "passing_yards": "passing_yards", "rushing_yards": "rushing_yards", "receiving_yards": "receiving_yards",
    "passing_td": "passing_tds", "rushing_td_count": "rushing_tds", "receiving_td_count": "receiving_tds",
    "touchdowns": "total_tds",
}
CONTEXT_VOLUMES = (
    "pass_attempts", "carries", "targets", "red_zone_targets", "red_zone_carries", "goal_to_go_targets",
    "goal_to_go_carries", "offensive_plays", "total_yards", "total_tds", "skill_players_active",
)


def context_week_totals(players: DataFrame, group: str, entity: str = "player_id") -> DataFrame:
    """Sums, distinct players and safe rates per (season, week, group)."""
    base = players.where(F.col(group).isNotNull())
    have = set(players.columns)
    totals = base.groupBy("season", "week", F.col(group).alias("team")).agg(
        F.max("game_date").alias("game_date"),
        *[F.sum(F.col(source) if source in have else F.lit(0)).alias(out) for source, out in CONTEXT_SUMS.items()],
        F.countDistinct(entity).alias("skill_players_active"),
    )
    totals = totals.withColumns(
        {
            "offensive_plays": F.col("pass_attempts") + F.col("carries"),
            "total_yards": F.col("passing_yards") + F.col("rushing_yards"),
            "red_zone_plays": F.col("red_zone_targets") + F.col("red_zone_carries"),
            "goal_to_go_plays": F.col("goal_to_go_targets") + F.col("goal_to_go_carries"),
        }
    )
    return totals.withColumns({name: ratio(F.col(a), F.col(b), 0.0) for name, (a, b) in CONTEXT_RATES.items()})


def lagged_means(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    spans: Mapping[str, Sequence[int]],
    prefix: str = "",
    as_of: str | None = None,
    fill: float | None = None,
    plan=None,
) -> DataFrame:
    """``_prev`` (1), ``_l3``, ``_l5`` … means over the prior rows of each metric.

    The default ``plan=None`` is for week or game grains, whose groups the calendar bounds.
    """
    label = {1: "prev"}

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for metric, sizes in spans.items():
            for n in sizes:
                value = F.avg(metric).over(last_rows(w, n))
                out[f"{prefix}{metric}_{label.get(n, f'l{n}')}"] = value if fill is None else nz(value, fill)
        if as_of:
            out[as_of] = F.lag("game_date").over(w)
        return out

    reach = max(n for sizes in spans.values() for n in sizes)
    return prior_rows(df, list(keys), order, reach, build, plan=plan)


def context_history(players: DataFrame, entity: str = "player_id") -> DataFrame:
    """Offence and defence contexts per team-week with ``data_as_of``, full-joined.

    A team without one side keeps 0 there; ``data_as_of`` is the earlier of the two sides.
    """
    spans = {m: (1, 3, 5) for m in CONTEXT_RATES} | {m: (1, 3) for m in CONTEXT_VOLUMES}
    # One pass over the raw rows: both sides are summed from one row per player and pairing.
    present = [c for c in CONTEXT_SUMS if c in players.columns]
    players = players.groupBy("season", "week", "team", "opponent", entity).agg(F.max("game_date").alias("game_date"), *[F.sum(c).alias(c) for c in present])
    sides = []
    for group, prefix, as_of in (("team", "team_ctx_", "data_as_of"), ("opponent", "opp_ctx_", "opp_data_as_of")):
        totals = context_week_totals(players, group, entity)
        lagged = lagged_means(totals, ["season", "team"], "game_date", spans, prefix, as_of, fill=0.0)
        features = [c for c in lagged.columns if c.startswith(prefix)]
        sides.append((lagged.select("season", "week", "team", "game_date", as_of, *features), features))
    (offense, off_cols), (defense, def_cols) = sides
    both = offense.join(defense, ["season", "week", "team", "game_date"], "full")
    as_of = F.least(F.col("data_as_of"), F.col("opp_data_as_of"))
    return both.withColumns({"data_as_of": as_of} | {c: nz(c, 0.0) for c in (*off_cols, *def_cols)}).drop("opp_data_as_of")


# --- splits, profiles, pace ---------------------------------------------------------------------


def share_of_rows(condition: Column) -> Column:
    """Mean of a condition over all rows; NULL counts as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def pass_splits(plays: DataFrame, positions: DataFrame | None = None, keys: Sequence[str] = ("season", "week", "defteam")) -> DataFrame:
    """Pass defence per group: success, value, situational shares, per position and direction.

    Conditional means replace a pivot, so every split shares one aggregation.
    """
    base = plays.where(F.col("pass_attempt") == 1)
    if positions is not None:
        roster = positions.select("season", "week", F.col("player_id").alias("receiver_player_id"), "position")
        roster = roster.dropDuplicates(["season", "week", "receiver_player_id"])
        base = base.join(roster, ["season", "week", "receiver_player_id"], "left")
    coverage = F.lower(F.trim(F.col("defense_man_zone_type")))
    situations = {
        "two_minute": "pass_two_minute_rate", "third_down": "pass_third_down_rate", "fourth_down": "pass_fourth_down_rate",
        "red_zone": "pass_red_zone_rate", "goal_line": "pass_goal_line_rate", "pass_expected": "pass_expected_rate",
        "blitz": "blitz_rate", "pressure": "pressure_rate",
    }
    have = set(base.columns)
    aggs = {
        "pass_plays": F.count(F.lit(1)),
        "pass_success_allowed": nz(F.avg("success"), 0.0),
        "pass_epa_allowed": nz(F.avg("epa"), 0.0),
        "pass_explosive_rate": share_of_rows(F.col("yards_gained") >= 20),
    }
    aggs |= {out: share_of_rows(F.col(f"situ_{s}") == 1) for s, out in situations.items() if f"situ_{s}" in have}
    if "defenders_in_box" in have:
        aggs["pass_box_avg"] = F.avg("defenders_in_box")
    if "defense_man_zone_type" in have:
        aggs |= {"man_rate": share_of_rows(coverage == "man"), "zone_rate": share_of_rows(coverage == "zone")}
    if "defense_coverage_type" in have:
        aggs["two_high_rate"] = share_of_rows(F.lower("defense_coverage_type").rlike("two|2"))
    if "number_of_pass_rushers" in have:
        aggs["pass_rushers_avg"] = F.avg(nz("number_of_pass_rushers", 0.0))
    segments = [("position", p, f"vs_{p}") for p in ("WR", "TE", "RB")] + [("pass_location", d, d) for d in ("left", "middle", "right")]
    for column, value, suffix in segments:
        if column in have:
            for metric in ("epa", "success"):
                aggs[f"pass_{metric}_allowed_{suffix}"] = nz(F.avg(F.when(F.col(column) == value, F.col(metric))), 0.0)
    return base.groupBy(*keys).agg(*[c.alias(f"opp_def_{n}") for n, c in aggs.items()])


def rush_splits(plays: DataFrame, keys: Sequence[str] = ("season", "week", "defteam")) -> DataFrame:
    base = plays.where(F.col("rush_attempt") == 1)
    have = set(base.columns)
    situations = {
        "red_zone": "rush_red_zone_rate", "goal_line": "rush_goal_line_rate", "light_box": "light_box_rate",
        "heavy_box": "heavy_box_rate", "run_expected": "run_expected_rate",
    }
    aggs = {
        "rush_plays": F.count(F.lit(1)),
        "rush_success_allowed": nz(F.avg("success"), 0.0),
        "rush_epa_allowed": nz(F.avg("epa"), 0.0),
        "rush_stuff_rate": share_of_rows(F.col("yards_gained") <= 0),
        "rush_explosive_rate": share_of_rows(F.col("yards_gained") >= 10),
    }
    aggs |= {out: share_of_rows(F.col(f"situ_{s}") == 1) for s, out in situations.items() if f"situ_{s}" in have}
    return base.groupBy(*keys).agg(*[c.alias(f"opp_def_{n}") for n, c in aggs.items()])


def split_history(splits: DataFrame, group: str = "defteam", order: Sequence[str] = ("season", "week"), windows: Sequence[int] = (1, 3)) -> DataFrame:
    """Prior means of every split metric per group, across seasons. The columns come from the schema."""
    metrics = [c for c in splits.columns if c.startswith("opp_def_")]
    stamped = splits.withColumn("_o", F.col(order[0]) * 1000 + F.col(order[1]))
    out = lagged_means(stamped, [group], "_o", {m: windows for m in metrics})
    return out.drop("_o", *metrics)


def passing_profile(plays: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Passing profile per group with exact median depth."""
    base = plays.where(F.col("passer_player_id").isNotNull())
    air = F.col("air_yards")
    have = set(base.columns)
    aggs = {
        "games": F.countDistinct("game_id").cast("double"),
        "dropbacks": F.sum(nz("qb_dropback", 0.0)),
        "pass_attempts": F.sum(nz("pass_attempt", 0.0)),
        "completions": F.sum(nz("completion", 0.0)),
        "pass_yards": F.sum(nz("passing_yards", 0.0)),
        "pass_epa": F.sum(nz("epa", 0.0)),
        "pass_success_rate": F.avg(nz("success", 0.0)),
        "avg_air_yards": F.avg(air),
        "deep_attempt_rate": share_of_rows(air >= 15),
        "short_attempt_rate": share_of_rows(air <= 0),
    }
    optional = {
        "scrambles": ("qb_scramble", F.sum(nz("qb_scramble", 0.0))), "shotgun_rate": ("shotgun", F.avg(nz("shotgun", 0.0))),
        "no_huddle_rate": ("no_huddle", F.avg(nz("no_huddle", 0.0))), "pressure_rate": ("situ_pressure", F.avg(nz("situ_pressure", 0.0))),
        "avg_xpass": ("xpass", F.avg("xpass")),
    }
    aggs |= {name: column for name, (source, column) in optional.items() if source in have}
    if "game_date" in have:
        aggs["game_date"] = F.max("game_date")
    stats = base.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    stats = join_on(stats, median(base, list(keys), "air_yards", "median_air_yards"), list(keys))
    rates = {
        "completion_rate": ("completions", "pass_attempts"), "pass_yards_per_attempt": ("pass_yards", "pass_attempts"),
        "pass_epa_per_dropback": ("pass_epa", "dropbacks"), "scramble_rate": ("scrambles", "dropbacks"),
    }
    stats = stats.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in rates.items() if a in stats.columns})
    fixed = {*keys, "game_date"}
    return stats.select(*[F.col(c).alias(c if c in fixed else prefix + c) for c in stats.columns])


def rushing_profile(plays: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    base = plays.where(F.col("rusher_player_id").isNotNull())
    stats = base.groupBy(*keys).agg(
        F.sum(nz("carry", 0.0)).alias("rush_attempts"), F.sum(nz("rushing_yards", 0.0)).alias("rush_yards"),
        F.sum(nz("rush_touchdown", 0.0)).alias("rush_tds"), F.avg(nz("success", 0.0)).alias("rush_success_rate"),
    )
    stats = stats.withColumns(
        {
            "rush_yards_per_attempt": ratio(F.col("rush_yards"), F.col("rush_attempts")),
            "rush_touchdown_rate": ratio(F.col("rush_tds"), F.col("rush_attempts")),
        }
    )
    return stats.select(*[F.col(c).alias(c if c in keys else prefix + c) for c in stats.columns])


def pace_metrics(plays: DataFrame, keys: Sequence[str] = ("season", "week", "game_id", "posteam", "game_date"), last_week: int | None = 18) -> DataFrame:
    """Tempo per team-game outside overtime, spikes and kneels; neutral means a close score early in the half."""
    base = plays.where(
        F.col("posteam").isNotNull() & (F.col("qtr") <= 4) & (nz("qb_spike") == 0) & (nz("qb_kneel") == 0)
    )
    if last_week is not None:
        base = base.where(F.col("week") <= last_week)
    neutral = (F.abs("score_differential") <= 10) & (F.col("half_seconds_remaining") > 120)
    return base.groupBy(*keys).agg(
        nz(F.avg(nz("no_huddle")), 0.0).alias("team_pace_no_huddle_rate"),
        nz(F.avg("pass_oe"), 0.0).alias("team_pace_proe"),
        nz(F.avg(F.when(neutral, F.col("pass"))), 0.5).alias("team_pace_neutral_pass_rate"),
        F.sum(F.when(neutral, 1).otherwise(0)).alias("neutral_plays"),
    )


PACE_METRICS = ("team_pace_no_huddle_rate", "team_pace_proe", "team_pace_neutral_pass_rate")


def pace_history(pace: DataFrame, keys: Sequence[str] = ("season", "posteam")) -> DataFrame:
    out = lagged_means(pace, keys, "game_date", {m: (1, 3, 5) for m in PACE_METRICS})
    return out.drop(*PACE_METRICS, "neutral_plays")


# --- participation and alignment ----------------------------------------------------------------

# Positions that run routes, alignments, and routes that mark a slot alignment.
SKILL_POSITIONS = ("WR", "TE", "RB", "HB", "FB")
ALIGNMENTS = ("slot", "wide", "inline", "backfield")
SLOT_ROUTES = ("SLANT", "IN/DIG", "SHALLOW CROSS/DRAG", "SCREEN", "QUICK OUT", "HITCH/CURL", "TEXAS/ANGLE")


def on_field(plays: DataFrame, keys: Sequence[str], ids: str = "offense_players", positions: str = "offense_positions") -> DataFrame:
    """One row per (event, player on the field) from two aligned ``;`` lists.

    Events whose lists differ in length are left out; an element without a partner never appears.
    """
    split = plays.withColumns({"_i": F.split(ids, ";"), "_p": F.split(positions, ";")}).where(F.size("_i") == F.size("_p"))
    rows = split.withColumn("_z", F.explode(F.arrays_zip("_i", "_p")))
    position = F.upper(F.trim(F.col("_z._p")))
    return (
        rows.select(*keys, F.trim(F.col("_z._i")).alias("player_id"), position.alias("off_position"))
        .where(F.col("off_position").isin(*SKILL_POSITIONS) & (F.length("player_id") > 0))
    )


def participation(plays: DataFrame, group: Sequence[str], event: Sequence[str], field: DataFrame) -> DataFrame:
    """Events with a player on the field over all events of the group. Distinct events on both sides."""
    ids = F.struct(*event)
    mine = field.groupBy(*group, "player_id").agg(F.countDistinct(ids).alias("ps_route_participation_plays"))
    total = plays.groupBy(*group).agg(F.countDistinct(ids).alias("ps_team_dropbacks"))
    out = join_on(mine, total, list(group))
    return out.withColumn("ps_route_participation_pct", ratio(F.col("ps_route_participation_plays"), F.col("ps_team_dropbacks"), 0.0))


def alignment_shares(targets: DataFrame, field: DataFrame, group: Sequence[str], event: Sequence[str]) -> DataFrame:
    """Targets by alignment as counts and shares: an interaction join, then a four-value pivot."""
    p = F.col("off_position")
    slot = (F.upper(nz("pass_location", "")) == "MIDDLE") | F.upper(F.trim(nz("route", ""))).isin(*SLOT_ROUTES)
    aligned = (
        F.when(p == "TE", "inline").when(p.isin("RB", "HB", "FB"), "backfield").when((p == "WR") & slot, "slot").otherwise("wide")
    )
    keys = [*group, *[e for e in event if e not in group], "player_id"]
    joined = targets.join(field.select(*keys, "off_position"), keys, "inner").withColumn("alignment", aligned)
    counts = joined.groupBy(*group, "player_id").pivot("alignment", list(ALIGNMENTS)).count()
    counts = counts.withColumns({f"ps_targets_{a}_count": nz(a) for a in ALIGNMENTS}).drop(*ALIGNMENTS)
    total = sum((F.col(f"ps_targets_{a}_count") for a in ALIGNMENTS), F.lit(0))
    counts = counts.withColumn("ps_targets_total", total)
    return counts.withColumns(
        {f"ps_targets_{a}_share": ratio(F.col(f"ps_targets_{a}_count"), F.col("ps_targets_total"), 0.0) for a in ALIGNMENTS}
    )


def scripted_flags(plays: DataFrame, keys: Sequence[str] = ("game_id", "posteam"), order: Sequence[str] = ("order_sequence", "play_id")) -> DataFrame:
    """Rank of each event in its team-game and the early-script flag."""
    ranked = prefix_sums(plays, list(keys), list(order), {"offense_play_rank": F.lit(1)})
    elapsed = F.coalesce(3600.0 - F.col("game_seconds_remaining"), 1800.0 - F.col("half_seconds_remaining"))
    quarter = nz("quarter_seconds_remaining", 900.0)
    late = F.col("qtr").isin(2, 4) & (quarter <= 120)
    hurry = (nz("no_huddle") == 1) & (quarter < 240)
    early = (F.col("offense_play_rank") < 20) & nz(elapsed <= 1200, True) & ~nz(late, False) & ~hurry & nz("down", 1).isin(1, 2)
    return ranked.withColumn("is_scripted_play", F.when(early, 1).otherwise(0))


# --- labels and vacancies -----------------------------------------------------------------------

# Fixed values: (label, numerator, denominator, clipped to [0, 1]).
LABEL_RATIOS = (
    ("rec_success_rate_label", "reception", "target", True),
    ("rush_success_rate_label", "rush_success_plays", "carry", True),
    ("yards_per_target_label", "receiving_yards", "target", False),
    ("yards_per_catch_label", "receiving_yards", "reception", False),
    ("air_yards_per_catch_label", "air_yards_total", "reception", False),
    ("yac_per_catch_label", "yards_after_catch_total", "reception", False),
    ("air_yards_per_target_label", "air_yards_all_targets", "target", False),
    ("yards_per_carry_label", "rushing_yards", "carry", False),
    ("td_per_target_label", "receiving_td_count", "target", True),
    ("td_per_carry_label", "rushing_td_count", "carry", True),
    ("td_per_rz_carry_label", "rushing_td_count", "red_zone_carry", True),
    ("td_per_gl_carry_label", "rushing_td_count", "goal_to_go_carry", True),
)
EPSILON = 1e-6


def with_label_ratios(df: DataFrame, team_keys: Sequence[str] = ("season", "week", "team", "game_id")) -> DataFrame:
    """Rate labels per row and shares of the team's targets and carries."""
    have = set(df.columns)

    def rate(num: Column, den: Column, clipped: bool) -> Column:
        value = num / (den + EPSILON)
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) if clipped else value

    labels = {n: rate(nz(a, 0.0), nz(b, 0.0), c) for n, a, b, c in LABEL_RATIOS if {a, b} <= have}
    out = df.withColumns(labels)
    if {*team_keys, "target", "carry"} <= have:
        out = attach_totals(out, list(team_keys), {"team_targets_total": F.sum(nz("target", 0.0)), "team_carries_total": F.sum(nz("carry", 0.0))})
        out = out.withColumns(
            {
                "target_share_label": rate(nz("target", 0.0), nz("team_targets_total", 0.0), True),
                "carry_share_label": rate(nz("carry", 0.0), nz("team_carries_total", 0.0), True),
            }
        )
    return out


def vacated_usage(df: DataFrame, unavailable: Column, usage: Mapping[str, str], keys: Sequence[str] = ("season", "week", "team", "position")) -> DataFrame:
    """Usage of unavailable players summed per group and attached to every row, 0 where none."""
    gone = df.where(unavailable).groupBy(*keys).agg(*[F.sum(source).alias(out) for out, source in usage.items()])
    return join_on(df, gone, list(keys)).withColumns({out: nz(out, 0.0) for out in usage})


def primary_by(df: DataFrame, keys: Sequence[str], entity: str, metric: str, out: str) -> DataFrame:
    """The entity with the largest metric sum per group; the greatest id wins a tie."""
    sums = df.groupBy(*keys, entity).agg(F.sum(nz(metric)).alias("_m"))
    return sums.groupBy(*keys).agg(F.max_by(entity, F.struct("_m", entity)).alias(out))


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mode per group; the smallest value wins a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def offense_history(df: DataFrame, metrics: Sequence[str], partitions: Mapping[str, Sequence[str]], week: str = "week") -> DataFrame:
    """Lag inside (season, team), then a 3-row mean of the lagged value in other partitions.

    The lag already excludes the current week, so the mean may include the current row.
    """
    lagged = prior_rows(df, ["season", "team"], week, 1, lambda w: {f"{m}_prev": F.lag(m).over(w) for m in metrics}, plan=None)
    out = lagged
    for label, keys in partitions.items():
        out = prior_rows(
            out,
            list(keys),
            [week, "team"],
            2,
            lambda w, label=label: {f"{label}_{m}_l3": F.avg(f"{m}_prev").over(w.rowsBetween(-2, 0)) for m in metrics},
            plan=None,
        )
    return out


def inactivity_history(df: DataFrame, entity: str, order: Sequence[str], inactive: str = "is_inactive", depth: str = "depth_chart_order", plan="auto") -> DataFrame:
    """Inactive games among the last five, inactive last time, and the change of the depth order."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            "recent_inactivity_count": nz(F.sum(inactive).over(last_rows(w, 5))),
            "was_inactive_last_game": nz(F.lag(inactive).over(w)),
            "depth_chart_mobility": nz(F.lag(depth).over(w) - F.col(depth)),
        }

    return prior_rows(df, entity, list(order), 5, build, plan=plan)


def prior_event_rate(df: DataFrame, keys: Sequence[str], order: str, event: str, out: str) -> DataFrame:
    """Rate of an event over all earlier weeks of the key; rows of the current week never count.

    Sums are taken per (key, week) first, so all rows of one week share one prior.
    """
    weekly = df.groupBy(*keys, order).agg(F.sum(nz(event, 0.0)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    prior = prefix_sums(weekly, list(keys), order, {"_ps": F.col("_s"), "_pn": F.col("_n")}, plan=None)
    prior = prior.select(*keys, order, ratio(F.col("_ps"), F.col("_pn")).alias(out))
    return join_on(df, prior, [*keys, order])


def tail_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], n: int, out: str, first: bool = False) -> DataFrame:
    """The last (first) ``n`` rows per key as an ordered array of structs.

    Rows are thinned to ``n`` per (key, salt) before the final merge, so no task ever holds more
    than ``n`` rows of a key per salt, whatever the key's size.
    """
    salts = 64
    entry = F.struct(*[F.col(o) for o in order], *[F.col(v) for v in values])
    spread = df.select(*keys, entry.alias("_e")).withColumn("_salt", F.pmod(F.xxhash64("_e"), F.lit(salts)))
    ordering = F.col("_e").asc() if first else F.col("_e").desc()
    thin = spread.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(ordering))).where(F.col("_k") <= n)
    merged = thin.groupBy(*keys).agg(F.sort_array(F.collect_list("_e"), asc=first).alias("_a"))
    kept = F.slice("_a", 1, n)
    return merged.select(*keys, (kept if first else F.reverse(kept)).alias(out))
