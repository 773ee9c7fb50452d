"""Flagship plan: point-in-time context of every purchase.

Daily totals per user feed prior-day and month-to-date ratios; the user's latest view known at a
decision cutoff before the purchase is attached as of that cutoff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cutoff import with_cutoff
from ..operators.asof import asof_join
from ..operators.keys import seconds_between
from ..operators.prior import rolling_ratios


def daily_totals(events: DataFrame) -> DataFrame:
    """One row per (user, day): events, purchases and value. Map-side combined."""
    return (
        events.withColumns({"day": F.to_date("ts"), "bought": F.when(F.col("event_type") == "purchase", 1).otherwise(0)})
        .groupBy("user_id", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bought").alias("purchases"), F.sum("value").alias("total"))
        .withColumn("month", F.trunc("day", "month"))
    )


def user_day_history(events: DataFrame) -> DataFrame:
    """Prior-3-day and month-to-date purchase rate and mean value, excluding the day itself."""
    totals = daily_totals(events)
    # One row per calendar day and user: groups are bounded by the calendar, so no slice plan.
    return rolling_ratios(
        totals,
        "user_id",
        "day",
        {"purchase_rate": ("purchases", "n"), "mean_value": ("total", "n")},
        windows=(3,),
        slice_of={"mtd": "month"},
        lifetime=False,
        plan=None,
    )


def purchase_context(events: DataFrame, cutoff_hours: float = 6.0) -> DataFrame:
    history = user_day_history(events).select(
        "user_id", "day", "purchase_rate_l3", "mean_value_l3", "purchase_rate_mtd", "mean_value_mtd"
    )
    purchases = events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", "ts", "value", F.to_date("ts").alias("day")
    )
    views = events.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"), F.col("event_id").alias("view_id")
    )
    decided = with_cutoff(purchases, start="ts", hours=cutoff_hours, out="cutoff_ts")
    matched = asof_join(
        decided, views, "user_id", "cutoff_ts", "view_ts", ["view_id", "view_value"], matched_ts="view_ts", tie_break=["view_id"]
    )
    return (
        matched.join(history, ["user_id", "day"], "left")
        .withColumns(
            {
                "view_known": F.when(F.col("view_ts").isNotNull(), 1).otherwise(0),
                "hours_since_view": seconds_between(F.col("ts"), F.col("view_ts")) / 3600,
            }
        )
        .drop("day")
    )
