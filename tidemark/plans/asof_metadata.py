"""As-of metadata: one row per game with its cutoff and the snapshots known by then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cutoff import CutoffPolicy, drop_missing, known_flags, with_cutoff
from ..operators.asof import latest_known
from ..operators.keys import flag, join_on, seconds_between

SNAPSHOTS = ("injury_snapshot_ts", "roster_snapshot_ts", "odds_snapshot_ts", "forecast_snapshot_ts")


def build_asof_metadata(
    schedule: DataFrame,
    injuries: DataFrame | None = None,
    rosters: DataFrame | None = None,
    odds: DataFrame | None = None,
    forecasts: DataFrame | None = None,
    policy: CutoffPolicy | None = None,
    start: str = "game_start_utc",
    season_type: str | None = None,
) -> DataFrame:
    """Cutoff per game, then per feed the latest snapshot at or before it.

    Every feed is cut at the cutoff inside its join. Feeds carry ``game_id`` and a time column:
    ``reported_at``, ``snapshot_ts``, ``odds_snapshot_ts``, ``forecast_generated_ts``.
    """
    keep = [c for c in ("game_id", "season", "week", "game_date", start, season_type) if c and c in schedule.columns]
    games = schedule.select(*keep).dropDuplicates(["game_id"])
    date = "game_date" if "game_date" in keep else None
    games = with_cutoff(games, start, out="cutoff_ts", date=date, season_type=season_type, policy=policy)
    out = games
    if injuries is not None:
        found = latest_known(injuries, games, "game_id", "reported_at", "cutoff_ts", [], "injury_snapshot_ts", "injury_reports_used")
        out = join_on(out, found, "game_id").withColumns(
            {
                "injury_snapshot_source": F.when(F.col("injury_snapshot_ts").isNotNull(), "historical").otherwise("none"),
                "injury_reports_used": F.coalesce("injury_reports_used", F.lit(0)),
            }
        )
    if rosters is not None:
        found = latest_known(rosters, games, "game_id", "snapshot_ts", "cutoff_ts", [], "roster_snapshot_ts")
        out = join_on(out, found, "game_id").withColumn(
            "roster_snapshot_lag_hours", seconds_between(F.col("cutoff_ts"), F.col("roster_snapshot_ts")) / 3600
        )
    if odds is not None:
        found = latest_known(odds, games, "game_id", "odds_snapshot_ts", "cutoff_ts", [], "odds_snapshot_at")
        out = join_on(out, found.withColumnRenamed("odds_snapshot_at", "odds_snapshot_ts"), "game_id")
    if forecasts is not None:
        detail = [c for c in ("forecast_is_backfill", "forecast_is_historical", "forecast_source_detail", "forecast_provider") if c in forecasts.columns]
        found = latest_known(forecasts, games, "game_id", "forecast_generated_ts", "cutoff_ts", detail, "forecast_snapshot_ts")
        names = [F.col(c) for c in ("forecast_source_detail", "forecast_provider") if c in detail]
        source = F.coalesce(*names, F.lit("forecast"))
        old = [F.coalesce(F.col(c), F.lit(False)) for c in ("forecast_is_backfill", "forecast_is_historical") if c in detail]
        for condition in old:
            source = F.when(condition, "backfill").otherwise(source)
        found = found.withColumn("forecast_snapshot_source", source).drop(*detail)
        out = join_on(out, found, "game_id").withColumn("forecast_snapshot_source", F.coalesce("forecast_snapshot_source", F.lit("none")))
    return out


def attach_asof_metadata(df: DataFrame, metadata: DataFrame, snapshots: Sequence[str] = SNAPSHOTS, drop_rows: bool | None = None) -> DataFrame:
    """Join the metadata to rows by game; refreshed columns win over columns already present."""
    present = [s for s in snapshots if s in metadata.columns]
    fresh = metadata.withColumn("decision_cutoff_ts", F.col("cutoff_ts"))
    old = [c for c in fresh.columns if c in df.columns and c != "game_id"]
    renamed = df.withColumnsRenamed({c: f"__old_{c}" for c in old})
    joined = join_on(renamed, fresh, "game_id")
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__old_{c}")) for c in old}).drop(*[f"__old_{c}" for c in old])
    joined = known_flags(joined, present, "decision_cutoff_ts")
    return drop_missing(joined, present, drop_rows)


def horizon_rows(metadata: DataFrame, hours: Sequence[float], start: str = "game_start_utc") -> DataFrame:
    """Metadata repeated per decision horizon with its own cutoff."""
    from ..functions.cutoff import hours_before, with_horizons

    rows = with_horizons(metadata, hours)
    return rows.withColumn("cutoff_ts", hours_before(F.col(start), F.col("decision_horizon_hours")))


def coverage_ok(coverage: DataFrame, minimum: dict[str, float]) -> DataFrame:
    """1 per feed whose share of snapshots known at the cutoff reaches its minimum."""
    share = F.col("known_at_cutoff") / F.greatest(F.col("non_null"), F.lit(1))
    limit = F.lit(0.9)
    for feed, value in minimum.items():
        limit = F.when(F.col("feed") == feed, value).otherwise(limit)
    return coverage.withColumns({"share": share, "ok": flag(share >= limit)})
