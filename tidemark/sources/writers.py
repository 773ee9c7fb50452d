"""Writers: partition replacement, append-only caches, upserts, logs, outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expectations import guard_availability
from ..operators.keys import as_list, latest_by
from ..schema import union_relaxed
from ..session import cut_lineage


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("season", "week"), compression: str = "zstd") -> None:
    """Replace exactly the partitions present in ``df``.

    The rebalance hint gathers rows by partition value, splits a hot partition over as many tasks
    as its size needs and merges tiny ones, so files come out evenly sized.
    """
    by = list(by)
    even = df.hint("rebalance", *by)
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*by).parquet(path)


def write_days(df: DataFrame, path: str, day: str = "date") -> None:
    write_partitions(df, path, [day])


def append_missing_days(totals: DataFrame, path: str, day: str = "date") -> DataFrame:
    """Append only days the cache does not hold yet; returns the rows that were new.

    The anti-join runs on distinct days, read from the partition folders of the cache.
    """
    present = read_if_exists(totals.sparkSession, path)
    fresh = totals
    if present is not None:
        fresh = totals.join(present.select(F.col(day).cast(totals.schema[day].dataType).alias(day)).distinct(), day, "left_anti")
    fresh = cut_lineage(fresh)
    fresh.write.mode("append").partitionBy(day).option("compression", "zstd").parquet(path)
    return fresh


def read_cache(spark: SparkSession, path: str, start, end, entities: DataFrame | None = None, entity: str = "player_id", context: str | None = None, day: str = "date") -> DataFrame:
    """Range read of a daily cache: partition pruning by day, semi join by entity."""
    df = spark.read.parquet(path)
    kind = df.schema[day].dataType
    df = df.where(F.col(day).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    if context is not None:
        df = df.where(F.col("ctx") == context)
    return df.join(entities.select(entity).distinct(), entity, "left_semi") if entities is not None else df


def upsert(existing: DataFrame | None, new: DataFrame, keys: str | Sequence[str], version: Sequence[Column] | None = None) -> DataFrame:
    """Union that keeps one row per key: the greatest version, new rows winning ties."""
    if existing is None:
        both = new.withColumn("_new", F.lit(1))
    else:
        both = union_relaxed(existing.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1)))
    data = [c for c in both.columns if c != "_new"]
    order = [*(version or []), F.col("_new"), F.xxhash64(*data)]
    keys = as_list(keys)
    out = latest_by(both, keys, order, [c for c in data if c not in keys])
    return out.select(*data)


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], version: Sequence[Column] | None = None) -> None:
    """Upsert that reads and rewrites only the partitions touched by ``new``."""
    existing = read_if_exists(new.sparkSession, path)
    if existing is not None:
        touched = new.select(*by).distinct()
        existing = existing.join(touched, list(by), "left_semi")
    write_partitions(cut_lineage(upsert(existing, new, list(keys), version)), path, by)


def arrival_rows(df: DataFrame, feed: str, label: str, collected_at: Column, start: str, snapshot: str, metadata: Sequence[str] = ()) -> DataFrame:
    """Arrival log rows: minutes from collection to the start and since the snapshot, JSON metadata."""

    def minutes(late: Column, early: Column) -> Column:
        return F.round((F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 60e6, 3)

    extra = F.to_json(F.struct(*[F.col(c) for c in metadata])) if metadata else F.lit(None).cast("string")
    return df.withColumns(
        {
            "feed": F.lit(feed),
            "snapshot_label": F.lit(label),
            "collected_at": collected_at,
            "minutes_until_kickoff": minutes(F.col(start), collected_at),
            "minutes_since_snapshot": minutes(collected_at, F.col(snapshot)),
            "metadata_json": extra,
        }
    ).drop(*metadata)


def _write_run(df: DataFrame, path: str, run: str, by: Sequence[str] = ()) -> None:
    """Write the rows of one run; a job that runs again replaces them instead of doubling them."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "run").parquet(path)


def log_arrivals(rows: DataFrame, path: str, run: str = "0") -> None:
    """Add the arrivals of one run to the log, by feed."""
    _write_run(rows, path, run, ["feed"])


def append_history(df: DataFrame, path: str, stamp: Column | None = None, run: str = "0") -> None:
    """Add one run's snapshot of metrics with its time."""
    _write_run(df.withColumn("recorded_at", stamp if stamp is not None else F.current_timestamp()), path, run)


def write_matrix(df: DataFrame, path: str, horizon: str = "decision_horizon_hours", floats: bool = True) -> None:
    """Feature matrix, one partition per horizon; doubles become floats only here."""
    casts = {c: F.col(c).cast("float") for c, t in df.dtypes if t == "double" and c != horizon} if floats else {}
    write_partitions(df.withColumns(casts) if casts else df, path, [horizon])


# Leading columns of the prediction output, and the prediction column of each flavour.
OUTPUT_COLUMNS = ("player_name", "team", "position", "opponent", "game_date", "week", "season", "game_id")
FLAVOURS = {
    "prob_anytime_td_flat": ("pred_anytime_td",),
    "prob_anytime_td_global": ("pred_anytime_td_structured_global", "pred_anytime_td_structured"),
    "prob_anytime_td_moe": ("pred_anytime_td_structured_moe",),
}


def format_output(df: DataFrame, final: str, threshold: float, debug_prefixes: Sequence[str] = (), rank_by: str = "prob_anytime_td_moe") -> DataFrame:
    """One probability per model flavour after the availability guards, the decision, implied odds.

    Ranked by the chosen probability, then date, team and name.
    """
    have = set(df.columns)
    guarded = df.withColumn("_final", F.col(final).cast("double"))
    for out, sources in FLAVOURS.items():
        source = next((c for c in sources if c in have), None)
        guarded = guarded.withColumn(out, F.col(source).cast("double") if source else F.lit(None).cast("double"))
    for name in ("_final", *FLAVOURS):
        guarded = guard_availability(guarded, name)
    odds = F.when(F.col(rank_by) > 0, 1.0 / F.col(rank_by))
    debug = [c for c in df.columns if debug_prefixes and c.startswith(tuple(debug_prefixes))]
    lead = [c for c in OUTPUT_COLUMNS if c in have]
    out = guarded.select(
        *lead, *FLAVOURS, odds.alias("implied_decimal_odds"), F.when(F.col("_final") >= threshold, 1).otherwise(0).alias("prediction"),
        F.lit(float(threshold)).alias("model_threshold"), *[c for c in ("player_id",) if c in have], *debug,
    )
    ties = [F.asc(c) for c in ("game_date", "team", "player_name", "player_id") if c in out.columns]
    return out.orderBy(F.desc_nulls_last(rank_by), *ties)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
