"""Feature plans: one path for training and scoring.

Scoring rows are appended to history as rows without outcomes, the windows run over both, and only
the scoring rows are kept. Training and serving therefore share every expression.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.cutoff import CutoffPolicy, with_horizons
from ..functions.depth import with_air_yards_history, with_catch_history, with_catch_priors, with_depth_estimates, with_depth_priors
from ..functions.injuries import eligible
from ..functions.labels import LeakPolicy, drop_same_event, guard_leaks, schema_snapshot, with_labels, write_schema_snapshot
from ..functions.roles import with_position_group, with_role_features
from ..functions.travel import team_rows, with_calendar
from ..functions.usage import with_usage_features
from ..operators.asof import asof_join
from ..operators.grains import context_history, context_totals, entity_totals, lagged_means
from ..operators.keys import as_list, join_on, latest_by, nz, seconds_between
from ..operators.prior import event_rate_history, last_rows, prior_rows, rolling_ratios
from ..operators.slices import group_sizes, tasks_for
from ..schema import union_relaxed
from ..session import cut_lineage

SCORED = "_scored"


def history_and_scaffold(history: DataFrame, scaffold: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``step`` over history plus scaffold rows and return the scaffold rows only."""
    both = union_relaxed(history.withColumn(SCORED, F.lit(0)), scaffold.withColumn(SCORED, F.lit(1)))
    return step(both).where(F.col(SCORED) == 1).drop(SCORED)


def build_scaffold(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """One row per eligible player and game."""
    sides = team_rows(games)
    kept = [c for c in rosters.columns if c in ("season", "week", "team") or c not in sides.columns]
    rows = sides.join(rosters.select(*kept), ["season", "week", "team"], "inner")
    rows = rows.where(eligible(rows)).dropDuplicates(["player_id", "game_id"])
    return with_calendar(rows, "start_time_utc") if "start_time_utc" in rows.columns else rows


def zero_usage_rows(players: DataFrame, rosters: DataFrame, schedule: DataFrame, zero: Sequence[str], keys: Sequence[str] = ("season", "week", "team", "player_id")) -> DataFrame:
    """Players on the roster without any usage row, as zero rows in the usage frame."""
    windows = players.select("season", "week").distinct()
    listed = rosters.join(windows, ["season", "week"], "left_semi")
    sides = team_rows(schedule, keep=[c for c in ("season", "week", "game_id", "game_date") if c in schedule.columns])
    expected = listed.join(sides, ["season", "week", "team"], "inner")
    missing = expected.join(players.select(*keys).distinct(), list(keys), "left_anti")
    missing = missing.withColumns({z: F.lit(0) for z in zero if z in players.columns})
    return union_relaxed(players, missing.select(*[c for c in missing.columns if c in players.columns]))


def attach_context(df: DataFrame, history: DataFrame, as_of: str, cutoff: str, team: str, features: Sequence[str], prefix: str = "") -> DataFrame:
    """Latest context row of a team known at the cutoff; missing features become 0."""
    right = history.select(F.col("team").alias(team), F.col(as_of).alias("_as_of"), *features)
    joined = asof_join(df, right, team, cutoff, "_as_of", list(features))
    return joined.withColumns({f"{prefix}{c}": nz(c, 0.0) for c in features})


# Statistics that are rolled per game, and the contexts they are rolled in.
ROLLED = (
    "touchdowns", "target", "carry", "pass_attempt", "red_zone_target", "red_zone_carry", "goal_to_go_target",
    "goal_to_go_carry", "short_yard_carry", "third_down_carry", "receiving_yards", "rushing_yards", "passing_yards",
    "ps_route_participation_pct", "ps_route_participation_plays", "ps_targets_total", "ps_targets_slot_count",
    "ps_targets_wide_count", "ps_targets_inline_count", "ps_targets_backfield_count", "ps_targets_slot_share",
    "ps_targets_wide_share", "ps_targets_inline_share", "ps_targets_backfield_share", "ps_total_touches",
    "ps_scripted_touches", "ps_scripted_touch_share",
)
CONTEXTS: Mapping[str, Sequence[str]] = {"vs_any": (), "with_team": ("team",), "vs_team": ("opponent",)}
#: Games against one opponent from which a rate in that context counts.
LEAST_SUPPORT = 4


#: Roster rows up to which a roster is sent to all tasks.
BROADCAST_ROSTER = 4_000_000
#: Column of a row's bit among the values of its game, and how many values have one.
BIT, BITS = "_bit", 63


def players_of_sides(sides: DataFrame, roster: DataFrame, on: Sequence[str], game: str = "game_id", counted: str | None = None) -> DataFrame:
    """Every side of a game with each player of its roster, laid out by game.

    There are many times more rows than sides, so the sides are moved, in tasks by the number of rows they become, and the roster is
    sent to them, a list of players for each of its groups; what is then grouped by game and player is not moved again. Larger rosters meet the
    sides in an ordinary join.

    ``counted`` is a column of the sides that is counted per player and game by ``distinct_of_game``. Each of its values in a game is
    given a bit where the rows are still sides, so that the many rows of players need only one aggregate; games of more sides
    than ``BITS`` go without.
    """
    sides, roster = cut_lineage(sides), cut_lineage(roster)
    members, groups = roster.count(), roster.select(*on).distinct().count()
    if members > BROADCAST_ROSTER:
        return sides.join(roster, list(on), "inner")
    rows, most = group_sizes(sides, game)
    laid = sides.repartition(tasks_for(sides, rows * members / max(1, groups)), game)
    if counted is not None and most <= BITS:
        laid = laid.withColumn(BIT, F.dense_rank().over(Window.partitionBy(game).orderBy(counted)))
        laid = laid.withColumn(BIT, F.when(F.col(counted).isNotNull(), F.expr(f"shiftleft(1L, {BIT} - 1)")))
    own = [c for c in roster.columns if c not in on]
    lists = cut_lineage(roster.groupBy(*on).agg(F.collect_list(F.struct(*own)).alias("_players")))
    kept = [c for c in laid.columns if c not in on]
    return laid.join(F.broadcast(lists), list(on), "inner").select(*on, *kept, F.inline("_players"))


def distinct_of_game(rows: DataFrame, counted: str) -> Column:
    """Number of distinct ``counted`` in a grouping of ``players_of_sides`` within a game: by their bits where they were given."""
    return F.bit_count(F.coalesce(F.bit_or(BIT), F.lit(0).cast("bigint"))).cast("bigint") if BIT in rows.columns else F.countDistinct(counted)


def rolled_ratios(players: DataFrame, stats: Sequence[str], contexts: Mapping[str, Sequence[str]], entity: str, day: str, windows: Sequence[int], season: str) -> DataFrame:
    """Ratios per (context, entity, context keys, day): one shuffle of the players for all contexts."""
    totals = context_totals(players, entity, day, contexts, stats, extra=[season])
    dims = sorted({c for keys in contexts.values() for c in keys})
    named = {s: (f"{s}_num", "denom") for s in stats}
    ratios = rolling_ratios(totals, ["ctx", entity, *dims], day, named, windows, slice_of={"season": season}, support="_support")
    renames = {f"{s}_l{n}": f"{n}g_{s}_per_game" for s in stats for n in windows}
    renames |= {f"{s}_season": f"season_{s}_per_game" for s in stats} | {f"{s}_lifetime": f"lifetime_{s}_per_game" for s in stats}
    return ratios.withColumnsRenamed(renames).drop("denom", *[f"{s}_num" for s in stats])


def per_game_rolling(players: DataFrame, stats: Sequence[str], entity: str = "player_id", day: str = "game_date", windows: Sequence[int] = (1, 3, 5), season: str = "season") -> DataFrame:
    """``<n>g_<stat>_per_game`` ratios, season to date and lifetime, per entity."""
    return rolled_ratios(players, stats, {"vs_any": ()}, entity, day, windows, season).drop("ctx", "_support")


def with_rolling(players: DataFrame, stats: Sequence[str] = ROLLED, contexts: Mapping[str, Sequence[str]] = CONTEXTS, entity: str = "player_id", day: str = "game_date", windows: Sequence[int] = (1, 3, 5), season: str = "season", rows: DataFrame | None = None) -> DataFrame:
    """The rows of ``players``, or the ``rows`` given, with the ratios of all contexts, named by context.

    A ratio against one opponent needs ``LEAST_SUPPORT`` earlier games against it, in every window.
    """
    stats = [s for s in stats if s in players.columns]
    ratios = rolled_ratios(players, stats, contexts, entity, day, windows, season)
    made = [c for c in ratios.columns if c.endswith("_per_game")]
    out = players if rows is None else rows
    for name, keys in contexts.items():
        end = "" if name == "vs_any" else f"_{name}"
        enough = F.col("_support") >= LEAST_SUPPORT if name == "vs_team" else F.lit(True)
        chosen = ratios.where(F.col("ctx") == name).select(entity, *keys, day, *[F.when(enough, F.col(c)).alias(f"{c}{end}") for c in made])
        out = join_on(out, chosen, [entity, *keys, day])
    return out


def player_game_features(players: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Rolling usage, team and opponent contexts, shares, roles and depth on the player-game grain."""
    out = with_rolling(players)
    history = context_history(players)
    team_cols = [c for c in history.columns if c.startswith("team_ctx_")]
    opp_cols = [c for c in history.columns if c.startswith("opp_ctx_")]
    out = join_on(out, history.select("season", "week", "team", *team_cols), ["season", "week", "team"])
    defence = history.select("season", "week", F.col("team").alias("opponent"), *opp_cols)
    out = join_on(out, defence, ["season", "week", "opponent"])
    if positions is not None:
        out = join_on(out, positions, "player_id")
    out = with_catch_history(out)
    if "air_yards_all_targets" in out.columns:
        out = with_air_yards_history(out)
    out = with_usage_features(out)
    if "position" in out.columns:
        for step in (with_depth_priors, with_depth_estimates, with_catch_priors, with_position_group, with_role_features):
            out = out.transform(step)
    return out


def feature_matrix(
    plays: DataFrame,
    metadata: DataFrame | None = None,
    positions: DataFrame | None = None,
    policy: CutoffPolicy | None = None,
    label_version: str = "v1_any_offense",
    identifiers: Sequence[str] = ("season", "week", "game_id", "game_date", "player_id", "player_name", "team", "opponent"),
    targets: Sequence[str] = (),
    snapshot_path: str | None = None,
) -> DataFrame:
    """Plays to a guarded, labelled feature matrix with one row per (player, game, horizon).

    Windows run on the unfiltered history; rows without snapshots are dropped last. Columns that tell
    what happened in the event go, unless the label version or ``targets`` declare them. The schema
    and what was banned are written under ``snapshot_path``.
    """
    from ..plans.asof_metadata import attach_asof_metadata

    policy = policy or CutoffPolicy()
    players = with_labels(entity_totals(plays, ["season", "week", "game_id", "game_date"]), label_version)
    features = player_game_features(players, positions)
    labels = [c for c in features.columns if c.startswith(("anytime_td", "td_count"))]
    features, report = guard_leaks(drop_same_event(features), LeakPolicy(), allow=[*identifiers, *labels, *targets])
    if snapshot_path is not None:
        write_schema_snapshot(features.sparkSession, schema_snapshot(features, report, label_version=label_version), snapshot_path)
    features = with_horizons(features, policy.horizons)
    if metadata is not None:
        features = attach_asof_metadata(features, metadata, drop_rows=policy.drop_missing_snapshots)
    return features


def refresh_contexts(players: DataFrame, end_date) -> DataFrame:
    """Context history of all games up to a date."""
    return context_history(players.where(F.col("game_date") <= F.lit(end_date).cast(players.schema["game_date"].dataType)))


def rate_histories(df: DataFrame, event: str, season: str = "season", week: str = "week") -> DataFrame:
    """Event-rate history per team, opponent and position bucket, joined back on the week.

    Each history is built on one row per (key, week), so hot teams cost no more than others.
    """
    out = df.withColumn("_unit", F.col(season) * 100 + F.col(week))
    families = {"team": ["team"], "opp": ["opponent"], "team_pos": ["team", "position_group"], "opp_pos": ["opponent", "position_group"]}
    for label, keys in families.items():
        if not set(keys) <= set(df.columns):
            continue
        weekly = out.groupBy(*keys, season, "_unit").agg(F.max(F.col(event)).alias("_hit"))
        history = event_rate_history(weekly, keys, "_unit", "_hit", f"{label}_{event}", season=season, plan=None)
        out = join_on(out, history.drop("_hit", season), [*keys, "_unit"])
    return out.drop("_unit")


def serve_snap_history(rows: DataFrame, history: DataFrame, entity: str, ts: str, carried: Mapping[str, str]) -> DataFrame:
    """Fill serving rows from the entity's stored history, strictly before each row.

    Days since the last event, the last *non-null* depth order, and ``carried`` columns that are
    NULL on the row.
    """
    past = history.select(entity, F.col(ts).alias("_past_ts"), *[F.col(v).alias(f"_h_{k}") for k, v in carried.items()])
    out = asof_join(rows, past, entity, ts, "_past_ts", [f"_h_{k}" for k in carried], allow_exact=False, matched_ts="_last_ts")
    filled = {k: F.coalesce(F.col(k), F.col(f"_h_{k}")) if k in rows.columns else F.col(f"_h_{k}") for k in carried}
    out = out.withColumns(filled | {"days_since_last_event": seconds_between(F.col(ts), F.col("_last_ts")) / 86400})
    out = out.drop("_last_ts", *[f"_h_{k}" for k in carried])
    if "depth_chart_order" in history.columns:
        depth = history.where(F.col("depth_chart_order").isNotNull()).select(entity, F.col(ts).alias("_past_ts"), F.col("depth_chart_order").alias("depth_chart_order_prev"))
        out = asof_join(out, depth, entity, ts, "_past_ts", ["depth_chart_order_prev"], allow_exact=False)
    return out


def with_baseline(rows: DataFrame, baseline: DataFrame, entity: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Value, else the entity's latest baseline, with the source per column: actual, baseline, none."""
    last = latest_by(baseline, entity, [F.col(o) for o in order], columns).select(entity, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = join_on(rows, last, entity)
    out: dict[str, Column] = {}
    for c in columns:
        source = F.when(F.col(c).isNotNull(), "actual").when(F.col(f"_b_{c}").isNotNull(), "baseline").otherwise("none")
        out |= {f"{c}_source": source, c: F.coalesce(F.col(c), F.col(f"_b_{c}"))}
    # The sources read the old values, so they are added before the columns change.
    joined = joined.withColumns({k: v for k, v in out.items() if k.endswith("_source")})
    return joined.withColumns({k: v for k, v in out.items() if not k.endswith("_source")}).drop(*[f"_b_{c}" for c in columns])


def snap_history(df: DataFrame, entity: str | Sequence[str] = "player_id", order: str | Sequence[str] = "game_date", pct: str = "offense_pct", plan="auto") -> DataFrame:
    """Participation history: previous, last-3 mean, last-5 spread, ceiling, floor, starter rate."""

    def build(w: WindowSpec) -> dict[str, Column]:
        five, seen = last_rows(w, 5), F.count(pct).over(last_rows(w, 5))
        std = F.when(seen >= 2, F.stddev_samp(pct).over(five))
        mean = F.when(seen >= 2, F.avg(pct).over(five))
        started = F.sum(F.when(F.col(pct) > 0.5, 1).otherwise(0)).over(five)
        return {
            "snap_offense_pct_prev": F.lag(pct).over(w),
            "snap_offense_pct_l3": F.avg(pct).over(last_rows(w, 3)),
            "snap_pct_std_l5": std,
            "snap_pct_mean_l5": mean,
            "max_snap_pct_l5": F.max(pct).over(five),
            "min_snap_pct_l5": F.min(pct).over(five),
            # The divisor is the window length, not the rows seen.
            "starter_rate_l5": started / 5,
            "snap_volatility_cv_l5": std / F.greatest(mean, F.lit(0.01)),
        }

    out = prior_rows(df, as_list(entity), as_list(order), 5, build, plan=plan)
    out = out.withColumns(
        {
            "has_no_snap_history": F.when(F.col("snap_offense_pct_l3").isNull(), 1).otherwise(0),
            "was_backup_last_game": F.when(F.col("snap_offense_pct_prev") < 0.20, 1).when(F.col("snap_offense_pct_prev").isNotNull(), 0),
        }
    )
    if "team_ctx_offensive_plays_l3" in df.columns:
        plays = F.col("team_ctx_offensive_plays_l3")
        ceiling = F.col("max_snap_pct_l5") * plays
        out = out.withColumns({"snap_ceiling_l5": ceiling, "capped_expected_snaps_l3": F.least(plays * F.col("snap_offense_pct_l3"), ceiling)})
    return out


def market_history(df: DataFrame, entity: str, order: Sequence[str], prob: str, out: str = "market_prob_l3") -> DataFrame:
    """Mean market probability of this and the two earlier events; it is known before the event."""
    return prior_rows(df, entity, list(order), 2, lambda w: {out: F.avg(prob).over(w.rowsBetween(-2, 0))})


def pre_snap_history(df: DataFrame, metrics: Sequence[str], entity: str = "player_id", order: Sequence[str] = ("game_date",), plan="auto") -> DataFrame:
    """``ps_hist_<metric>_prev`` and ``_l3`` per player."""
    return lagged_means(df, [entity], order[0], {m: (1, 3) for m in metrics}, "ps_hist_", plan=plan)
