"""Readers: partitioned, schema-tolerant, pruned."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_status, normalize_code
from ..operators.keys import latest_by
from ..schema import conform, union_relaxed


def read_partitioned(spark: SparkSession, base: str, schema: T.StructType | None = None, merge: bool = True, where: str | None = None) -> DataFrame:
    """A hive-partitioned dataset whose files may differ in columns.

    With a schema the footers need not be merged, which matters for many files. ``where`` on
    partition columns prunes folders; on others it is pushed to the scan.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.option("mergeSchema", str(merge and schema is None).lower()).parquet(base)
    df = df.where(where) if where else df
    return conform(df, schema, keep_extra=True) if schema is not None else df


def only_seasons(df: DataFrame, seasons: Iterable[int] | None, column: str = "season") -> DataFrame:
    """Keep seasons; on a partition column only their folders are listed."""
    return df if seasons is None else df.where(F.col(column).isin(sorted({int(s) for s in seasons})))


def between_days(df: DataFrame, day: str, start, end) -> DataFrame:
    """Typed date range, inclusive; the literals are cast, never the column, so it prunes."""
    kind = df.schema[day].dataType
    return df.where(F.col(day).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def read_union(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Files of incompatible schemas: read one by one, widen, union by name."""
    return union_relaxed(*[spark.read.format(fmt).load(p) for p in paths])


def read_plays_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV (also gzipped) with a given schema; no inference pass over the data."""
    return spark.read.csv(paths, header=True, schema=schema, enforceSchema=False)


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or parquet by suffix."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    return spark.read.parquet(path)


def read_transactions(spark: SparkSession, path: str, schema: T.StructType | None = None, seasons: Iterable[int] | None = None, date: str = "date") -> DataFrame:
    """JSON-lines transaction feed with typed dates; the season starts in March."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.json(path).withColumn("transaction_date", F.to_timestamp(F.col(date)))
    rows = rows.withColumn("season", F.year("transaction_date") - F.when(F.month("transaction_date") < 3, 1).otherwise(0))
    return only_seasons(rows.where(F.col("transaction_date").isNotNull()), seasons)


def read_arrival_logs(spark: SparkSession, base: str) -> DataFrame:
    """Arrival logs of all feeds with typed timestamps."""
    df = spark.read.option("mergeSchema", "true").parquet(base)
    stamps = [c for c in ("game_start_ts", "feed_timestamp", "feed_timestamp_min", "collected_at") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps})


def latest_date(df: DataFrame, day: str):
    """Greatest date; parquet footers answer it without reading rows where aggregates push down."""
    return df.agg(F.max(day).alias("d")).first()["d"]


def seasons_of(df: DataFrame, column: str = "season") -> list[int]:
    return sorted(r[column] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def games_on(schedule: DataFrame, day) -> DataFrame:
    """Events of one date in starting order."""
    kept = schedule.where(F.col("gameday").cast("date") == F.lit(day).cast("date"))
    return kept.orderBy("start_time_utc", "game_id") if "start_time_utc" in schedule.columns else kept.orderBy("game_id")


def game_info(schedule: DataFrame, game_id: str, columns: Sequence[str] = ("game_id", "start_time_utc")) -> DataFrame:
    """Start time or other metadata of one event."""
    return schedule.where(F.col("game_id") == game_id).select(*[c for c in columns if c in schedule.columns])


@dataclass(frozen=True)
class Dimension:
    """How a season-keyed dimension is read: contract, codes, status columns, row version."""

    keys: tuple[str, ...]
    schema: T.StructType | None = None
    codes: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    version: str | None = None
    renames: Mapping[str, str] = field(default_factory=dict)


DIMENSIONS = {
    "rosters": Dimension(("season", "week", "team", "player_id"), codes=("team",), statuses=("status",)),
    "roster_snapshots": Dimension(("game_id", "team", "player_id", "snapshot_ts"), codes=("team",), statuses=("status",)),
    "depth_charts": Dimension(("season", "week", "team", "player_id"), codes=("team",)),
    "injuries": Dimension(("season", "week", "player_id", "reported_at"), codes=("team",), statuses=("report_status", "practice_status")),
    "transactions": Dimension(("player_id", "transaction_date")),
    "snap_counts": Dimension(("season", "week", "team", "player_id"), codes=("team",)),
    "qb_profiles": Dimension(("season", "week", "team"), codes=("team",), version="dropbacks"),
    "travel": Dimension(("season", "week", "team"), codes=("team",)),
    "schedule": Dimension(("game_id",), codes=("home_team", "away_team"), renames={"game_time_eastern": "gametime"}),
}


def prepare_dimension(df: DataFrame, kind: str, seasons: Iterable[int] | None = None, teams: Mapping[str, str] | None = None) -> DataFrame:
    """One path for every dimension: rename, prune seasons, normalise codes, one row per key.

    Rows without a full key are left out; the greatest ``version`` wins among duplicates.
    """
    spec = DIMENSIONS[kind]
    df = df.withColumnsRenamed({a: b for a, b in spec.renames.items() if a in df.columns})
    if "season" in df.columns:
        df = only_seasons(df, seasons)
    df = conform(df, spec.schema, keep_extra=True) if spec.schema is not None else df
    columns = {c: normalize_code(F.col(c), teams or {}) for c in spec.codes if c in df.columns}
    columns |= {c: clean_status(F.col(c)) for c in spec.statuses if c in df.columns}
    df = df.withColumns(columns) if columns else df
    df = df.na.drop(subset=[k for k in spec.keys if k in df.columns])
    if spec.version and spec.version in df.columns:
        order = [F.coalesce(F.col(spec.version).cast("double"), F.lit(-1.0)), F.xxhash64(*df.columns)]
        return latest_by(df, list(spec.keys), order)
    return df.dropDuplicates(list(spec.keys))


def load_dimension(spark: SparkSession, kind: str, base: str, seasons: Iterable[int] | None = None, teams: Mapping[str, str] | None = None) -> DataFrame:
    return prepare_dimension(read_partitioned(spark, base), kind, seasons, teams)
