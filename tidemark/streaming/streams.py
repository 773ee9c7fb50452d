"""Structured Streaming forms of the incremental work.

Windows over the last N rows are not a stream operation; streams keep daily totals, deduplicated
feeds and latency tables current, and the batch plans read those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.asof import asof_join
from ..plans.incremental import SeededHistory
from ..session import cut_lineage
from ..sources.writers import read_if_exists, upsert_partitions, write_partitions


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; each file is read once."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def daily_totals_stream(
    events: DataFrame, entity: str, ts: str, stats: Sequence[str], delay: str = "1 day", contexts: Sequence[str] = (), flags: Mapping[str, str] | None = None
) -> DataFrame:
    """Running totals per (entity, context, day).

    Rows later than the watermark are dropped (``numRowsDroppedByWatermark`` counts them); rows
    within it update their day.
    """
    shaped = events.withColumns({n: F.expr(e) for n, e in (flags or {}).items()}) if flags else events
    shaped = shaped.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    totals = shaped.groupBy(F.window("_event_time", "1 day"), F.col(entity), *[F.col(c) for c in contexts]).agg(
        F.count(F.lit(1)).alias("denom"), *[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(f"{s}_num") for s in stats]
    )
    return totals.select(F.to_date("window.start").alias("date"), entity, *contexts, *[f"{s}_num" for s in stats], "denom")


def run_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], by: Sequence[str], mode: str = "update", version: str | None = None) -> StreamingQuery:
    """Write a stream into a partitioned table, one row per key.

    Each micro-batch rewrites only the partitions it touches. A batch that is run again writes the
    same rows, so a restart after a lost driver leaves the table as it should be.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        # The batch is used more than once; a stateful plan must run only once.
        kept = cut_lineage(batch)
        if not kept.isEmpty():
            upsert_partitions(kept, path, keys, by, [F.col(version)] if version else None)

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


#: Rows that a bucket of a hashed table should hold at most.
BUCKET_ROWS = 1_000_000


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_count(expected_rows: int, rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that a table laid out anew with twice the buckets splits each in two."""
    return 1 << max(0, -(-expected_rows // rows) - 1).bit_length()


def upsert_buckets(new: DataFrame, path: str, keys: Sequence[str], buckets: int, version: Sequence[Column] | None = None) -> None:
    """Upsert into a table laid out by hash of its keys: only the buckets that ``new`` has keys in are read and written."""
    upsert_partitions(new.withColumn("_bucket", bucket_of(keys, buckets)), path, keys, ["_bucket"], version)


def run_bucket_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], buckets: int, mode: str = "update", version: str | None = None) -> StreamingQuery:
    """``run_upsert`` for tables without a column to partition by: a micro-batch costs the buckets of its keys, not the table."""

    def write(batch: DataFrame, _epoch: int) -> None:
        kept = cut_lineage(batch)
        if not kept.isEmpty():
            upsert_buckets(kept, path, keys, buckets, [F.col(version)] if version else None)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def late_rows_stream(events: DataFrame, ts: str, delay_seconds: float, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that come after their day may be closed, one partition a micro-batch.

    A day may be closed once the greatest time of the batches before, less the delay, has passed its end; the totals stream closes
    it then or one batch later, so no row that it drops is missing here. The greatest times are kept beside the late rows, one row a
    batch. A batch that runs again replaces its own partitions.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = cut_lineage(batch.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))))
        marks = read_if_exists(spark, f"{path}/marks")
        before = None if marks is None else marks.where(F.col("batch") < epoch).agg(F.max("top")).first()[0]
        top = kept.agg(F.max("_t")).first()[0]
        if top is not None:
            mark = spark.createDataFrame([(max(top, before or top), epoch)], "top bigint, batch bigint")
            write_partitions(mark, f"{path}/marks", ["batch"])
        if before is not None:
            closes = F.unix_micros((F.to_date(ts) + F.expr("INTERVAL 1 DAY")).cast("timestamp"))
            late = kept.where(closes <= before - int(delay_seconds * 1e6)).drop("_t").withColumn("batch", F.lit(epoch).cast("bigint"))
            write_partitions(late, f"{path}/rows", ["batch"])

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def repair_days(raw: DataFrame, late: DataFrame | None, path: str, entity: str, ts: str, stats: Sequence[str]) -> None:
    """Sum the days that late rows fall on anew from the raw feed and replace their partitions.

    The feed is read between the first and the last such day only. It does no harm to name a day that lost no row, so ``late`` may
    hold more rows than the totals stream dropped, and a repair may run again.
    """
    if late is None:
        return
    days = cut_lineage(late.select(F.to_date(ts).alias("date")).distinct())
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if span["a"] is None:
        return
    kind = raw.schema[ts].dataType
    after = F.date_add(F.lit(span["b"]), 1).cast(kind)
    rows = raw.where((F.col(ts) >= F.lit(span["a"]).cast(kind)) & (F.col(ts) < after)).withColumn("date", F.to_date(ts)).join(days, "date", "left_semi")
    totals = rows.groupBy("date", entity).agg(*[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(f"{s}_num") for s in stats], F.count(F.lit(1)).alias("denom"))
    write_partitions(totals, path, ["date"])


def first_version_stream(feed: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Keep the first row of each key that arrives within the watermark."""
    stamped = feed.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    return stamped.dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")


def latency_stream(feed: DataFrame, ts: str, minutes: str, keys: Sequence[str], width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Latency per feed and window with approximate percentiles (a bounded sketch per group)."""
    stamped = feed.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    points = F.percentile_approx(minutes, [0.1, 0.5, 0.9], 1000)
    out = stamped.groupBy(F.window("_event_time", width), *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(minutes).alias("mean"), F.max(minutes).alias("max"), points.alias("_q")
    )
    return out.select(
        F.col("window.start").alias("window_start"), *keys, "n", "mean", "max",
        F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90"),
    )


def known_before_stream(events: DataFrame, feed: DataFrame, key: str, event_ts: str, feed_ts: str, lookback: str, delay: str = "2 hours") -> DataFrame:
    """Stream-stream join of events with feed rows of the last ``lookback``; state is bounded by both watermarks."""
    left = events.withColumn("_l", F.col(event_ts).cast("timestamp")).withWatermark("_l", delay)
    right = feed.withColumn("_r", F.col(feed_ts).cast("timestamp")).withWatermark("_r", delay).withColumnRenamed(key, "_rkey")
    near = (F.col(key) == F.col("_rkey")) & (F.col("_r") <= F.col("_l")) & (F.col("_r") >= F.col("_l") - F.expr(f"INTERVAL {lookback}"))
    return left.join(right, near, "inner").drop("_rkey", "_l", "_r")


def latest_known_stream(
    events: DataFrame, feed: DataFrame, key: str, event_id: str, event_ts: str, feed_ts: str, columns: Sequence[str], lookback: str, delay: str = "2 hours"
) -> DataFrame:
    """Live as-of in one streaming plan: every event with the latest feed row of its key in the ``lookback`` before it, or none.

    A left outer join of both streams is followed by a stateful latest-of-key aggregate. Both watermarks and the lookback bound the
    state of the join, the event's time that of the aggregate; a row is emitted once, when the watermark has passed it.
    """
    left = events.withColumn("_l", F.col(event_ts).cast("timestamp")).withWatermark("_l", delay)
    right = feed.select(F.col(key).alias("_rkey"), F.col(feed_ts).cast("timestamp").alias("_r"), F.struct(F.col(feed_ts).alias("matched_ts"), *columns).alias("_row")).withWatermark("_r", delay)
    near = (F.col(key) == F.col("_rkey")) & (F.col("_r") <= F.col("_l")) & (F.col("_r") >= F.col("_l") - F.expr(f"INTERVAL {lookback}"))
    joined = left.join(right, near, "left_outer")
    latest = joined.groupBy(event_id, key, "_l").agg(F.max_by("_row", F.struct("_r", "_row")).alias("_row"))
    return latest.select(event_id, key, F.col("_l").alias(event_ts), "_row.*")


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that a stream has finished with to Parquet files, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attach_history_stream(
    events: DataFrame, history: DataFrame | SeededHistory, on: Sequence[str], event_ts: str, history_ts: str, columns: Sequence[str],
    path: str, checkpoint: str, by: Sequence[str], keys: Sequence[str],
) -> StreamingQuery:
    """Live as-of: each micro-batch is matched against the stored history with the batch operator.

    A ``SeededHistory`` is read from the seed before the batch's first day; a plain frame is read whole.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        kept = cut_lineage(batch)
        if kept.isEmpty():
            return
        if isinstance(history, SeededHistory):
            matched = history.attach(kept, event_ts)
        else:
            matched = asof_join(kept, history, list(on), event_ts, history_ts, columns, matched_ts="matched_ts")
        upsert_partitions(matched, path, keys, by)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def run_to_end(query: StreamingQuery) -> StreamingQuery:
    """Wait until everything available is processed."""
    query.awaitTermination()
    return query


def dropped_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they were later than the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for progress in query.recentProgress for op in progress["stateOperators"])
