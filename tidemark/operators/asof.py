"""As-of joins.

The sides are unioned and one window carries the latest right payload forward: linear, one
shuffle, no candidate pairs. The payload travels as one struct, so a latest row with NULL fields
is kept as it is and never mixed with an older one. Hot keys are cut into time slices; each
slice starts with the last right row of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import as_list, join_on, latest_by, seconds_between
from .slices import HOT, SLICE, SlicePlan, add_slices, lookup_join, plan_slices


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance_seconds: float | None = None,
    tie_break: Sequence[str] = (),
    matched_ts: str | None = None,
    plan: SlicePlan | str | None = "auto",
) -> DataFrame:
    """Left rows with the ``columns`` of the nearest right row at or before (after) ``left_ts``.

    Among right rows that share key and time the greatest by ``tie_break`` wins. Left rows with a NULL key or time match
    nothing but are kept. ``matched_ts`` names an output column for the time of the match.
    """
    on = as_list(on)
    columns = list(columns)
    forward = direction == "forward"
    if direction not in ("backward", "forward"):
        raise ValueError(direction)

    payload = F.struct(F.col(right_ts).alias("_rt"), *columns)
    rank = F.struct(*[F.col(c) for c in (*tie_break, *columns)]) if tie_break or columns else F.struct(right_ts)
    left_type = left.select(F.struct("*").alias("s")).schema["s"].dataType
    feed = right.where(F.col(right_ts).isNotNull()).select(
        *on, F.col(right_ts).alias("_t"), F.lit(None).cast(left_type).alias("_left"), payload.alias("_payload"), rank.alias("_rank")
    )
    tagged = left.select(
        *on, F.col(left_ts).alias("_t"), F.struct("*").alias("_left"),
        *[F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in ("_payload", "_rank")],
    )
    both = tagged.unionByName(feed)

    # Order of the two sides at one time: a backward exact match needs the right row first.
    is_left = F.col("_left").isNotNull()
    left_last = allow_exact != forward
    side = F.when(is_left, F.lit(1 if left_last else 0)).otherwise(F.lit(0 if left_last else 1))
    both = both.withColumn("_side", side)

    if plan == "auto":
        plan = plan_slices(both, on, "_t")
    hot = plan is not None and plan.any_hot
    if hot:
        # Many right rows of a hot key may share one time, which no slice can divide: keep the
        # greatest of each (key, time) first. Ordinary keys leave that to the window's order.
        feed = feed.groupBy(*on, "_t").agg(F.max_by(F.struct("_payload", "_rank"), F.col("_rank")).alias("_b"))
        feed = feed.select(*on, "_t", F.lit(None).cast(left_type).alias("_left"), "_b._payload", "_b._rank")
        both = tagged.unionByName(feed).withColumn("_side", side)
    both = add_slices(both, plan) if hot else both.withColumns({SLICE: F.lit(0), HOT: F.lit(False)})

    if hot:
        pick = F.min_by if forward else F.max_by
        summary = both.where(HOT).groupBy(*on, SLICE).agg(
            pick(F.struct("_t", "_payload"), F.when(F.col("_payload").isNotNull(), F.col("_t"))).alias("_edge"),
        )
        across = Window.partitionBy(*on).orderBy(F.col(SLICE).desc() if forward else F.col(SLICE))
        carried = F.last(F.when(F.col("_edge")["_payload"].isNotNull(), F.col("_edge")), ignorenulls=True)
        seeds = (
            summary.withColumn("_seed", carried.over(across.rowsBetween(Window.unboundedPreceding, -1)))
            .where(F.col("_seed").isNotNull())
            .select(
                *on,
                F.col("_seed")["_t"].alias("_t"),
                F.lit(None).cast(both.schema["_left"].dataType).alias("_left"),
                F.col("_seed")["_payload"].alias("_payload"),
                F.lit(None).cast(both.schema["_rank"].dataType).alias("_rank"),
                F.lit(0 if left_last else 1).alias("_side"),
                SLICE,
                F.lit(True).alias(HOT),
            )
        )
        both = both.unionByName(seeds.select(*both.columns))

    known = F.col("_t").isNotNull()
    for key in on:
        known = known & F.col(key).isNotNull()
    # Rows without a key or time match nothing: deal them over many groups instead of one.
    both = both.withColumn(SLICE, F.when(known, F.col(SLICE)).otherwise(-1 - F.pmod(F.xxhash64("_left"), F.lit(4096)).cast("int")))
    order = [F.col("_t").desc_nulls_last(), F.col("_side").desc()] if forward else [F.col("_t").asc_nulls_first(), F.col("_side")]
    order.append(F.col("_rank").asc_nulls_first())
    window = Window.partitionBy(*on, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_payload", ignorenulls=True).over(window)
    matched = both.withColumn("_found", F.when(known, found)).where(is_left)
    if tolerance_seconds is not None:
        gap = F.abs(seconds_between(F.col("_t"), F.col("_found")["_rt"]))
        matched = matched.withColumn("_found", F.when(gap <= tolerance_seconds, F.col("_found")))
    out = [F.col("_left")[c].alias(c) for c in left.columns]
    out += [F.col("_found")[c].alias(c) for c in columns]
    if matched_ts:
        out.append(F.col("_found")["_rt"].alias(matched_ts))
    return matched.select(*out)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    tolerance_seconds: float,
    prefer: str = "nearest",
    tie_break: Sequence[str] = (),
    matched_ts: str | None = None,
) -> DataFrame:
    """Match within a tolerance on both sides.

    ``nearest`` takes the smaller distance (the earlier row on equal distance); ``backward_first``
    takes the backward match where there is one and fills the rest from the forward match.
    """
    columns = list(columns)
    payload = "_p"
    packed = right.select(*as_list(on), F.col(right_ts), *tie_break, F.struct(F.col(right_ts).alias("_at"), *columns).alias(payload))
    step = asof_join(left, packed.withColumnRenamed(payload, "_back"), on, left_ts, right_ts, ["_back"], "backward", True, tolerance_seconds, tie_break)
    step = asof_join(step, packed.withColumnRenamed(payload, "_fwd"), on, left_ts, right_ts, ["_fwd"], "forward", True, tolerance_seconds, tie_break)
    back, fwd = F.col("_back"), F.col("_fwd")
    if prefer == "backward_first":
        chosen = F.coalesce(back, fwd)
    else:
        to_back = seconds_between(F.col(left_ts), back["_at"])
        to_fwd = seconds_between(fwd["_at"], F.col(left_ts))
        chosen = F.when(back.isNull(), fwd).when(fwd.isNull(), back).when(to_fwd < to_back, fwd).otherwise(back)
    step = step.withColumn("_chosen", chosen)
    out = [F.col(c) for c in left.columns] + [F.col("_chosen")[c].alias(c) for c in columns]
    if matched_ts:
        out.append(F.col("_chosen")["_at"].alias(matched_ts))
    return step.select(*out)


def latest_known(
    feed: DataFrame,
    cutoffs: DataFrame,
    on: str | Sequence[str],
    ts: str,
    cutoff: str,
    columns: Sequence[str],
    ts_out: str,
    count_out: str | None = None,
) -> DataFrame:
    """Per cutoff row, the latest feed row at or before the cutoff and the number of usable rows.

    ``cutoffs`` holds one row per key, so the join emits each feed row at most once and the
    reduction is a partial aggregate; nothing is collected per key.
    """
    on = as_list(on)
    pruned = feed.select(*dict.fromkeys([*on, ts, *columns]))
    usable = lookup_join(pruned, cutoffs.select(*on, cutoff), on, "inner").where(F.col(ts) <= F.col(cutoff))
    # Without a payload a plain maximum stays in a hash aggregate; a struct would sort the feed.
    best = F.max_by(F.struct(ts, *columns), F.struct(ts, *columns)) if columns else F.max(ts)
    aggs = [best.alias("_last")]
    if count_out:
        aggs.append(F.count(F.lit(1)).alias(count_out))
    latest = usable.groupBy(*on).agg(*aggs)
    out = [F.col("_last")[ts].alias(ts_out), *[F.col("_last")[c].alias(c) for c in columns]] if columns else [F.col("_last").alias(ts_out)]
    if count_out:
        out.append(F.col(count_out))
    return latest.select(*on, *out)


def assign_next_or_last(
    left: DataFrame,
    calendar: DataFrame,
    on: str | Sequence[str],
    left_ts: str,
    calendar_ts: str,
    label: str,
    out: str,
) -> DataFrame:
    """Label of the first calendar entry at or after ``left_ts``, else of the key's last entry."""
    on = as_list(on)
    step = asof_join(left, calendar.withColumnRenamed(label, "_next"), on, left_ts, calendar_ts, ["_next"], "forward")
    last = latest_by(calendar, on, [F.col(calendar_ts), F.col(label)], [label]).withColumnRenamed(label, "_last")
    return join_on(step, last, on, "left").withColumn(out, F.coalesce("_next", "_last")).drop("_next", "_last")
