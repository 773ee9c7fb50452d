"""The feature matrix as a graph of stages.

Six grains are written once, each laid out by the key that the stages above it work by:

======================  ====================================  =====================================================
grain                   key it is bucketed by                 made from
======================  ====================================  =====================================================
``player_drive``        game                                  plays, exploded to roles and summed
``games``               player                                drives, summed in place
``snaps`` (optional)    player                                the participation feed
``player_game``         player                                games, snaps, positions: windows over a player's games
``game_feeds``          game                                  schedule and side feeds, all as of the cutoff
``sides``               game                                  team and opponent of a game with their histories
======================  ====================================  =====================================================

Plays that come laid out by game (``laid_out``) are summed to drives and games without a move; only a player's games are then moved to
their player. A table bucketed by player serves every grouping, window and join whose keys include the player without moving rows
again, so all player stages (three rolling contexts, drive, catch, air-yard, snap and alignment history) run in place on
one table: no stage has a join back to its rows. Everything about a team, an opponent or a game is gathered on the far
smaller grain of game sides, also the rates by position, as a map in the side's row. Player rows then move once more, to
their side. ``stages`` may be kept and assembled again for other horizons.

Windows see all history before rows are dropped; a player's games of one day never see each other. Joins of bucketed tables on more
keys than the bucket key stay local only with ``spark.sql.requireAllClusterKeysForCoPartition=false``, which ``write_grain``
sets for the session.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cutoff import CutoffPolicy, cutoff_label, drop_missing, guard_snapshots, known_flags
from ..functions.depth import with_air_yards_history, with_catch_history, with_catch_priors, with_depth_estimates, with_depth_priors
from ..functions.labels import LeakPolicy, drop_same_event, guard_leaks, schema_snapshot, with_labels, write_schema_snapshot
from ..functions.roles import with_position_group, with_role_features
from ..functions.travel import team_rows, with_calendar, with_gap_features, with_sequence
from ..functions.usage import with_gap_fillers, with_usage_features
from ..functions.weather import attach_forecast, with_context_flags
from ..operators.asof import asof_join
from ..operators.grains import (
    CONTEXT_RATES, CONTEXT_SUMS, CONTEXT_VOLUMES, ROLE_SUMS, ROLES, context_week_totals, drive_history, drive_measures, explode_roles, lagged_means,
    pace_history, pace_metrics, pass_splits, passing_profile, rush_splits, split_history,
)
from ..operators.keys import join_on
from ..operators.prior import event_rate_history
from ..operators.slices import group_sizes, hot_floor
from ..session import cut_lineage, shared_folder
from .asof_metadata import SNAPSHOTS, build_asof_metadata
from .features import CONTEXTS, LEAST_SUPPORT, ROLLED, pre_snap_history, snap_history

PLAYER, GAME = "player_id", "game_id"
#: Rows for which a grain gets another bucket.
BUCKET_ROWS = 1_000_000
#: Rows of a player's games below which a task spends more time on making its many windows than on the rows.
WINDOW_ROWS = 20_000


@dataclass(frozen=True)
class Feeds:
    """What a matrix is made of. Only ``plays`` and ``schedule`` are needed.

    ``plays`` has role flags and player ids by role; ``schedule`` one row per game with ``start``, ``home_team``, ``away_team``;
    ``snaps`` and ``alignment`` one row per player and game; side feeds have ``game_id`` and the time columns of
    ``build_asof_metadata``; ``odds`` may have lines, which are taken as of the cutoff.
    """

    plays: DataFrame
    schedule: DataFrame
    positions: DataFrame | None = None
    snaps: DataFrame | None = None
    alignment: DataFrame | None = None
    injuries: DataFrame | None = None
    rosters: DataFrame | None = None
    odds: DataFrame | None = None
    forecasts: DataFrame | None = None
    start: str = "game_start_utc"


@dataclass(frozen=True)
class Stages:
    """The written tables from which a matrix is assembled."""

    player_game: DataFrame
    sides: DataFrame
    game_feeds: DataFrame


def write_grain(df: DataFrame, name: str, key: str, rows: int | None = None, order: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed by ``key`` into the shared folder and read it back; one move of its rows, none if ``df`` is laid out so already."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = buckets or buckets_of(df, key) or most_buckets(spark, rows or 0)
    table = f"tidemark_{name}_{uuid.uuid4().hex}"
    laid = df.repartition(buckets, key)
    laid.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", shared_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def most_buckets(spark: SparkSession, rows: int) -> int:
    """Buckets of a grain: one for each partition of a shuffle, more for many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def buckets_of(df: DataFrame, key: str) -> int | None:
    """Tasks of ``df`` if its rows lie by hash of ``key``: a hint that spares a move, never for results."""
    try:
        plan = df._jdf.queryExecution().executedPlan()
    except AttributeError:
        return None
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    found = re.fullmatch(rf"hashpartitioning\({re.escape(key)}#\d+L?, (\d+)\)", plan.outputPartitioning().toString())
    return int(found[1]) if found else None


def laid_out(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once, by ``key`` in buckets of a quarter of ``BUCKET_ROWS``: what is grouped by it and more keys, which may be many
    wide groups, follows without another move. With a hot key rows stay as they come. One narrow count."""
    rows, most = group_sizes(df, key)
    if most > hot_floor(df):
        return cut_lineage(df)
    return write_grain(df, name, key, rows=4 * rows)


def drop_grains(spark: SparkSession) -> None:
    """Forget the grains of this session's catalog; their files stay with the shared folder."""
    for table in spark.catalog.listTables():
        if table.name.startswith("tidemark_"):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")


# --- player stages ----------------------------------------------------------------------------


def player_drives(plays: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Sums per player, game and drive over all roles; the first of the written grains."""
    have = set(plays.columns)
    measures = list(dict.fromkeys(out for role in roles for out, source in ROLE_SUMS[role].items() if source in have))
    extras = {
        "short_yard_carry": {"carry", "ydstogo"}, "third_down_carry": {"carry", "down"}, "air_yards_total": {"complete_pass", "air_yards"},
        "rush_success_plays": {"yards_gained"}, "touchdowns": {"touchdown_player_id", "touchdown"},
    }
    measures += [n for n, needs in extras.items() if needs <= have]
    keys = [c for c in ("season", "week", GAME, "game_date", "drive") if c in have]
    rows = explode_roles(plays, [*keys, "posteam", "defteam"], roles, measures)
    # Where plays lie by game, in place; else map-side sums first.
    return rows.groupBy(*keys, PLAYER, "player_name", F.col("posteam").alias("team"), F.col("defteam").alias("opponent")).agg(*[F.sum(n).alias(n) for n in measures])


def player_games(drives: DataFrame) -> DataFrame:
    """Games of a player from drives that are bucketed by player or game, with the drive counts of the game."""
    fixed = {"season", "week", GAME, "game_date", "drive", PLAYER, "player_name", "team", "opponent"}
    measures = [c for c in drives.columns if c not in fixed]
    grain = ["season", "week", GAME, "game_date", PLAYER, "player_name"]
    # A minimum of text cannot live in a hash aggregate and would sort all drives. So each row comes twice, once for its sums and once for its
    # team and opponent; both are summed by hash, and the text is compared among the few rows of a game.
    text = ["team", "opponent"]
    drive = ["drive"] if "drive" in drives.columns else []
    none = lambda names: [F.lit(None).cast(drives.schema[n].dataType).alias(n) for n in names]
    uses = F.array(F.struct(F.lit(True).alias("_sums"), *drive, *none(text)), F.struct(F.lit(False).alias("_sums"), *none(drive), *text))
    rows = drives.select(*grain, *measures, F.explode(uses).alias("_u")).select(*grain, *measures, "_u.*")
    made = {}
    if drive:
        rows = rows.groupBy(*grain, "_sums", *drive, *text).agg(*[F.sum(m).alias(m) for m in measures])
        rows = rows.withColumnRenamed("touchdowns", "touchdown") if "touchdowns" in measures else rows
        made = drive_measures(rows)
    sums = [F.sum("touchdown" if m == "touchdowns" and drive else m).alias(m) for m in measures]
    games = rows.groupBy(*grain, "_sums", *text).agg(*sums, *[c.alias(n) for n, c in made.items()])
    held = {m: F.max(F.when(F.col("_sums"), F.col(m))).alias(m) for m in (*measures, *made)}
    return games.groupBy(*grain).agg(*[held[m] for m in measures], *[F.min(c).alias(c) for c in text], *[held[m] for m in made])


def rolling_in_place(players: DataFrame, stats: Sequence[str] = ROLLED, contexts: Mapping[str, Sequence[str]] = CONTEXTS, entity: str = PLAYER, day: str = "game_date", windows: Sequence[int] = (1, 3, 5), season: str = "season") -> DataFrame:
    """Rolling, season and lifetime ratios of every context as windows over the rows themselves.

    Days are ranked densely within entity and context, and frames are ranges of ranks, so several rows of one day are one step
    and never see each other. All windows partition by the entity first: rows that lie together by entity are not moved.
    """
    stats = [s for s in stats if s in players.columns]
    out = players
    for name, keys in contexts.items():
        end = "" if name == "vs_any" else f"_{name}"
        whole = ", ".join([entity, *keys])
        frames = {f"{n}g": f"PARTITION BY {whole} ORDER BY _day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING" for n in windows}
        frames["lifetime"] = f"PARTITION BY {whole} ORDER BY _day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        frames["season"] = f"PARTITION BY {whole}, {season} ORDER BY _day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        # One text for all columns of a context: they are parsed and resolved together.
        sums = [f"sum(coalesce({s}, 0)) OVER ({over}) AS _{label}_{s}" for label, over in frames.items() for s in stats]
        rows = [f"count(1) OVER ({over}) AS _{label}" for label, over in frames.items()]
        held = [f"`{c}`" for c in out.columns]
        out = out.selectExpr("*", f"dense_rank() OVER (PARTITION BY {whole} ORDER BY {day}) AS _day").selectExpr(*held, *sums, *rows)
        enough = f" AND _lifetime >= {LEAST_SUPPORT}" if name == "vs_team" else ""
        out = out.selectExpr(*held, *[f"CASE WHEN _{label} > 0{enough} THEN _{label}_{s} / _{label} END AS `{label}_{s}_per_game{end}`" for label in frames for s in stats])
    return out


def player_stage(feeds: Feeds, label_version: str) -> DataFrame:
    """All features of a player's own history, written by player."""
    drives = write_grain(player_drives(feeds.plays), "player_drive", GAME)
    games = cut_lineage(player_games(drives))
    spark, rows = games.sparkSession, games.count()
    buckets = min(most_buckets(spark, rows), max(spark.sparkContext.defaultParallelism, -(-rows // WINDOW_ROWS)))
    games = with_labels(write_grain(games, "games", PLAYER, order=["game_date"], buckets=buckets), label_version)
    for name, extra in (("snaps", feeds.snaps), ("alignment", feeds.alignment)):
        if extra is not None:
            held = write_grain(extra.withColumnRenamed(PLAYER, f"_{PLAYER}").withColumnRenamed(GAME, f"_{GAME}"), name, f"_{PLAYER}", buckets=buckets)
            games = games.join(held, (games[PLAYER] == held[f"_{PLAYER}"]) & (games[GAME] == held[f"_{GAME}"]), "left").drop(f"_{PLAYER}", f"_{GAME}")
    if feeds.positions is not None:
        held = write_grain(feeds.positions.select(F.col(PLAYER).alias(f"_{PLAYER}"), "position"), "positions", f"_{PLAYER}", buckets=buckets)
        games = games.join(held, games[PLAYER] == held[f"_{PLAYER}"], "left").drop(f"_{PLAYER}")
    out = rolling_in_place(games)
    if "drive_count" in out.columns:
        # The drive sums of the game itself go; what they tell of the past stays.
        out = drive_history(out, order="game_date", plan=None).withColumnRenamed("data_as_of", "drive_data_as_of")
    out = with_catch_history(out, plan=None)
    if "air_yards_all_targets" in out.columns:
        out = with_air_yards_history(out, plan=None)
    if "offense_pct" in out.columns:
        out = snap_history(out, plan=None)
    aligned = [c for c in out.columns if c.startswith("ps_") and not c.startswith("ps_hist_") and c in ROLLED]
    if aligned:
        out = pre_snap_history(out, aligned, plan=None)
    if "position" in out.columns:
        out = with_position_group(out)
    return write_grain(out, "player_game", PLAYER, order=["game_date"], buckets=buckets)


# --- team and game stages ------------------------------------------------------------------------


def position_rates(players: DataFrame, event: str, keys: Sequence[str], prefix: str) -> DataFrame:
    """``season, week`` and the keys with the event rates of all earlier weeks, by position group in one map where positions are known."""
    unit = F.col("season") * 100 + F.col("week")
    rates = [f"{prefix}_rate_{n}" for n in ("1", "2", "season", "lifetime")]
    # A week's flag is summed map-side, so a team with a third of all rows is a few rows of the shuffle.
    weekly = players.groupBy(*keys, "season", "week").agg(F.max(event).alias("_hit")).withColumn("_unit", unit)
    out = event_rate_history(weekly, list(keys), "_unit", "_hit", prefix, season="season", plan=None).drop("_hit", "_unit")
    if "position_group" not in players.columns:
        return out
    split = [*keys, "position_group"]
    weekly = players.where(F.col("position_group").isNotNull()).groupBy(*split, "season", "week").agg(F.max(event).alias("_hit")).withColumn("_unit", unit)
    by_group = event_rate_history(weekly, split, "_unit", "_hit", prefix, season="season", plan=None)
    entry = F.struct(F.col("position_group"), F.struct(*rates))
    maps = by_group.groupBy(*keys, "season", "week").agg(F.map_from_entries(F.collect_list(entry)).alias(f"{prefix}_by_position"))
    return join_on(out, maps, [*keys, "season", "week"])


def week_context(players: DataFrame, group: str, prefix: str) -> DataFrame:
    """What a team did, or what was done against it, in its weeks before: one row per season, week and team.

    Players lie together, so each is summed in place and counted once; only sums of a team's players are moved.
    """
    present = [c for c in CONTEXT_SUMS if c in players.columns]
    mine = players.groupBy(PLAYER, "season", "week", group).agg(F.max("game_date").alias("game_date"), *[F.sum(c).alias(c) for c in present])
    spans = {m: (1, 3, 5) for m in CONTEXT_RATES} | {m: (1, 3) for m in CONTEXT_VOLUMES}
    lagged = lagged_means(context_week_totals(mine, group), ["season", "team"], "game_date", spans, prefix, f"{prefix}data_as_of", fill=0.0)
    return lagged.select("season", "week", "team", *[c for c in lagged.columns if c.startswith(prefix)])


def side_stage(feeds: Feeds, players: DataFrame, event: str) -> DataFrame:
    """Team and opponent of every game with what each had done before it."""
    plays, start = feeds.plays, feeds.start
    kept = [c for c in feeds.schedule.columns if c not in ("home_score", "away_score")]
    sides = team_rows(feeds.schedule, keep=kept)
    if {"stadium_lat", "stadium_lon", "stadium_tz", "team_home_tz"} <= set(sides.columns):
        sides = with_sequence(sides, start=start)
    else:
        sides = with_gap_features(sides, "team", [start], start, depth=None, plan=None)
    sides = with_calendar(sides, start)
    by_week = ["season", "week"]
    sides = join_on(sides, week_context(players, "team", "team_ctx_"), [*by_week, "team"])
    sides = join_on(sides, week_context(players, "opponent", "opp_ctx_").withColumnRenamed("team", "opponent"), [*by_week, "opponent"])
    have = set(plays.columns)
    if {"qtr", "no_huddle", "pass_oe", "score_differential", "half_seconds_remaining", "qb_spike", "qb_kneel", "pass"} <= have:
        pace = pace_history(pace_metrics(plays, last_week=None)).withColumnRenamed("posteam", "team")
        sides = join_on(sides, pace.drop("season", "week", "game_date"), [GAME, "team"])
    if {"success", "epa", "yards_gained"} <= have:
        for made, flag_ in ((pass_splits, "pass_attempt"), (rush_splits, "rush_attempt")):
            if flag_ in have:
                splits = split_history(made(plays)).withColumnRenamed("defteam", "opponent")
                sides = join_on(sides, splits, [*by_week, "opponent"])
    if {"passer_player_id", "air_yards", "qb_dropback", "completion", "passing_yards"} <= have:
        profile = passing_profile(plays, ["season", "week", "posteam"], "qb_profile_team_")
        metrics = [c for c in profile.columns if c.startswith("qb_profile_team_")]
        profile = profile.withColumn("_o", F.col("season") * 1000 + F.col("week"))
        lags = lagged_means(profile, ["posteam"], "_o", {m: (1, 3) for m in metrics}).select(*by_week, F.col("posteam").alias("team"), *[f"{m}_{e}" for m in metrics for e in ("prev", "l3")])
        sides = join_on(sides, lags, [*by_week, "team"])
    for keys, prefix in ((["team"], f"team_{event}"), (["opponent"], f"opp_{event}")):
        sides = join_on(sides, position_rates(players, event, keys, prefix), [*keys, *by_week])
    return write_grain(sides, "sides", GAME, order=["team"])


def feed_stage(feeds: Feeds, policy: CutoffPolicy, hours: float, audit_path: str | None = None) -> DataFrame:
    """One row per game: its cutoff, what was known by then, and lines and forecast as of the cutoff."""
    lead = replace(policy, default=hours, by_season_type=None)
    meta = build_asof_metadata(feeds.schedule, feeds.injuries, feeds.rosters, feeds.odds, feeds.forecasts, lead, start=feeds.start)
    # One row per game, made from whole feeds: written before each join that reads it several times.
    out = cut_lineage(guard_snapshots(meta, [s for s in SNAPSHOTS if s in meta.columns], "cutoff_ts", audit_path))
    if feeds.odds is not None:
        lines = [c for c in feeds.odds.columns if c not in (GAME, "odds_snapshot_ts")]
        if lines:
            odds = feeds.odds.select(GAME, F.col("odds_snapshot_ts").alias("_line_ts"), *lines)
            out = cut_lineage(asof_join(out, odds, GAME, "cutoff_ts", "_line_ts", lines))
    if feeds.forecasts is not None and {"temp_f", "wind_speed_mph", "precip_probability_pct"} <= set(feeds.forecasts.columns):
        out = attach_forecast(out, feeds.forecasts, "cutoff_ts", GAME)
        venue = [c for c in ("roof",) if c in feeds.schedule.columns]
        out = with_context_flags(join_on(out, feeds.schedule.select(GAME, *venue), GAME) if venue else out)
    return write_grain(out.drop("season", "week", "game_date", feeds.start), "game_feeds", GAME)


# --- assembly ----------------------------------------------------------------------------------


def build_stages(feeds: Feeds, policy: CutoffPolicy | None = None, label_version: str = "v1_any_offense", hours: float | None = None, audit_path: str | None = None) -> Stages:
    """Write all grains of one cutoff."""
    policy = policy or CutoffPolicy()
    players = player_stage(feeds, label_version)
    return Stages(players, side_stage(feeds, players, "anytime_td"), feed_stage(feeds, policy, policy.default if hours is None else hours, audit_path))


def assemble(stages: Stages, only_known: bool) -> DataFrame:
    """Player rows beside their side and game; row-wise features follow."""
    players, sides, games = stages.player_game, stages.sides, stages.game_feeds
    side_columns = [c for c in sides.columns if c not in players.columns]
    held = sides.select(F.col(GAME).alias("_game"), F.col("team").alias("_team"), *side_columns)
    held = held.join(games.select(F.col(GAME).alias("_g"), *[c for c in games.columns if c != GAME and c not in players.columns and c not in side_columns]), F.col("_game") == F.col("_g"), "left").drop("_g")
    rows = players.join(held, (F.col(GAME) == F.col("_game")) & (F.col("team") == F.col("_team")), "left").drop("_game", "_team")
    maps = [c for c in rows.columns if c.endswith("_by_position")]
    for name in maps:
        prefix = name.removesuffix("_by_position")
        mine = F.element_at(name, F.col("position_group"))
        rows = rows.withColumns({f"{prefix.split('_')[0]}_pos_{prefix.split('_', 1)[1]}_rate_{n}": F.when(F.col("position_group").isNotNull(), mine[f"{prefix}_rate_{n}"]) for n in ("1", "2", "season", "lifetime")})
    rows = rows.drop(*maps)
    if "cutoff_ts" in rows.columns:
        present = [s for s in SNAPSHOTS if s in rows.columns]
        rows = known_flags(rows.withColumn("decision_cutoff_ts", F.col("cutoff_ts")), present, "decision_cutoff_ts")
        rows = drop_missing(rows, present, only_known) if present else rows
    rows = with_gap_fillers(with_usage_features(rows))
    if "position" in rows.columns:
        for step in (with_depth_priors, with_depth_estimates, with_catch_priors, with_role_features):
            rows = rows.transform(step)
    return rows


IDENTIFIERS = ("season", "week", GAME, "game_date", PLAYER, "player_name", "team", "opponent")


def matrix(
    feeds: Feeds,
    policy: CutoffPolicy | None = None,
    label_version: str = "v1_any_offense",
    identifiers: Sequence[str] = IDENTIFIERS,
    targets: Sequence[str] = (),
    snapshot_path: str | None = None,
    audit_path: str | None = None,
) -> DataFrame:
    """A guarded, labelled matrix with one row per player, game and horizon of the policy.

    Player and team stages are made once; only what depends on the cutoff is made again for each horizon. What tells the
    outcome goes by the leak guard's full lists, except labels, identifiers and ``targets``; the schema and what was banned are
    written under ``snapshot_path``, rows later than their cutoff under ``audit_path``.
    """
    policy = policy or CutoffPolicy()
    stages = build_stages(feeds, policy, label_version, policy.horizons[0], audit_path)
    out = None
    for k, hours in enumerate(policy.horizons):
        games = stages.game_feeds if k == 0 else feed_stage(feeds, policy, hours, audit_path)
        rows = assemble(replace(stages, game_feeds=games), policy.drop_missing_snapshots)
        labels = [c for c in rows.columns if c.startswith(("anytime_td", "td_count"))]
        rows, report = guard_leaks(drop_same_event(rows), LeakPolicy(), allow=[*identifiers, *labels, *targets])
        if snapshot_path is not None:
            write_schema_snapshot(rows.sparkSession, schema_snapshot(rows, report, label_version=label_version, cutoff=cutoff_label(hours)), f"{snapshot_path}/{cutoff_label(hours)}")
        rows = rows.withColumn("decision_horizon_hours", F.lit(float(hours)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
