"""Ordered slices of hot keys.

A window partitioned by a key puts the whole key into one task. Where a key may hold a third
of all rows that task never ends, so ordered operators here cut hot keys into slices along the
order column and carry the needed state from slice to slice.

``plan_slices`` runs one column-pruned, map-side combined count per key. A key is *hot* when it
holds more than ``floor`` rows, whatever its share, and is cut so that a slice holds about
``floor`` rows; up to ``SKETCH_POINTS`` slices a key. There is at most one hot key and one edge per
``floor`` rows of the frame, so the slice table stays that much smaller than the data; it is
broadcast only while it is measured to be short. Keys that are not hot keep the plain one-shuffle
window. Rows that share one order value stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import as_list, join_on, order_value

FLOOR_CONF = "spark.tidemark.hot.floor"
DEFAULT_FLOOR = 2_000_000
SMALL_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 4096
#: Most slices of one key, and how closely their edges are placed.
SKETCH_POINTS = 16_384
SKETCH_ACCURACY = 60_000

#: Rows of a task where a layout is made for groupings that hold nearly every row.
TASK_ROWS = 500_000

SLICE = "_slice"
HOT = "_hot"
#: The order value while slices are given; no caller's column has this name.
PLACE = "__slice_place"


@dataclass(frozen=True)
class SlicePlan:
    """Edges of the hot keys; ``table`` is None when there are none."""

    keys: tuple[str, ...]
    order: str
    table: DataFrame | None

    @property
    def any_hot(self) -> bool:
        return self.table is not None


def looks_small(df: DataFrame) -> bool:
    """The optimizer's own size estimate is small: a hint for spreading work, never for results."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    except AttributeError:
        return False


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Give a small input to all cores before a costly row-wise step (parsing, exploding).

    A small file is one scan task however many cores there are; moving it costs little. Large
    inputs already come in many splits and are left alone.
    """
    if not looks_small(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*by))


def short(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have few rows; else left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _floor(df: DataFrame, floor: int | None) -> int:
    return int(floor if floor is not None else df.sparkSession.conf.get(FLOOR_CONF, str(DEFAULT_FLOOR)))


def hot_floor(df: DataFrame) -> int:
    """Rows beyond which a key is hot."""
    return _floor(df, None)


def hot_keys(df: DataFrame, keys: Sequence[str], floor: int | None = None) -> tuple[list, float] | None:
    """Rows (key columns and ``_n``) of the keys with more than ``floor`` rows, and that number; None when
    there are none. One narrow, map-side combined count."""
    floor = _floor(df, floor)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per ``floor`` rows of the frame.
    top = counts.where(F.col("_n") > floor).collect()
    return (top, floor) if top else None


def dealt(df: DataFrame, keys: str | Sequence[str], weight: float = 1.0) -> DataFrame:
    """``df`` laid out by hash of ``keys`` in tasks of about ``TASK_ROWS / weight`` rows, so that groupings by these and more keys follow
    without another shuffle and hold a bounded number of groups; ``df`` itself if some key is hot. One narrow count.

    A grouping's own shuffle is cut by compressed bytes, of which a task's table of groups may be a large multiple.
    """
    rows, most = group_sizes(df, keys)
    if most > _floor(df, None):
        return df
    return df.repartition(tasks_for(df, rows * weight), *as_list(keys))


def group_sizes(df: DataFrame, keys: str | Sequence[str]) -> tuple[int, int]:
    """Rows of ``df`` and of its largest group. One narrow, map-side combined count."""
    size = df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    return size["rows"] or 0, size["most"] or 0


def tasks_for(df: DataFrame, rows: float) -> int:
    """Tasks among which ``rows`` rows are dealt: ``TASK_ROWS`` each, or all cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def has_hot_key(df: DataFrame, keys: str | Sequence[str], floor: int | None = None) -> bool:
    """Whether any key holds more than ``floor`` rows."""
    return hot_keys(df, as_list(keys), floor) is not None


def lookup_join(big: DataFrame, small: DataFrame, keys: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a large frame to one with few rows per key, NULL equal to NULL, however skewed ``big`` is.

    The rows of ``small`` for hot keys are broadcast if they are counted to be few; all other rows meet
    in an ordinary join, for which the hot rows carry a salt that matches nothing and are dealt over
    all tasks. One pass over ``big`` and exact.
    """
    keys = as_list(keys)
    found = hot_keys(big, keys)
    if found is None:
        return join_on(big, small, keys, how)
    values = [c for c in small.columns if c not in keys]
    fields = [T.StructField(big.schema[k].name, big.schema[k].dataType) for k in keys]
    table = big.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found[0]], T.StructType(fields))
    packed = small.select(*keys, F.struct(F.lit(1).alias("_in"), *values).alias("_v"))
    chosen = join_on(table.withColumn("_is_hot", F.lit(True)), packed.withColumnRenamed("_v", "_hv"), keys, "left")
    marked = join_on(big, short(chosen), keys, "left")
    plain = [c for c, t in big.dtypes if "map<" not in t]
    salt = F.when(F.col("_is_hot"), 1 + F.pmod(F.xxhash64(*plain), F.lit(4096))).otherwise(F.lit(0).cast("bigint"))
    cold = packed.withColumn("_salt", F.lit(0).cast("bigint")).withColumnRenamed("_v", "_cv")
    joined = join_on(marked.withColumn("_salt", salt), cold, [*keys, "_salt"], "left")
    value = F.coalesce("_hv", "_cv")
    out = joined.withColumn("_value", value)
    if how == "inner":
        out = out.where(F.col("_value._in") == 1)
    return out.select(*[F.col(c) for c in big.columns], *[F.col("_value")[c].alias(c) for c in values])


def plan_slices(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    floor: int | None = None,
) -> SlicePlan:
    """Find the hot keys of ``df`` and the order values at which they are cut."""
    keys = as_list(keys)
    spark = df.sparkSession
    slim = df.select(*keys, order_value(df, order).alias(PLACE))
    found = hot_keys(df, keys, floor)
    if found is None:
        return SlicePlan(tuple(keys), order, None)
    top, share = found

    key_fields = [slim.schema[k] for k in keys]
    sizes = spark.createDataFrame(
        [tuple(row[k] for k in keys) + (row["_n"],) for row in top],
        T.StructType([T.StructField(f.name, f.dataType) for f in key_fields] + [T.StructField("_n", T.LongType())]),
    )
    needed = max(math.ceil(row["_n"] / share) for row in top)
    sketched = min(SKETCH_POINTS, 1 << max(10, (4 * needed - 1).bit_length()))
    probs = [i / sketched for i in range(1, sketched)]
    points = F.percentile_approx(PLACE, probs, SKETCH_ACCURACY).alias("_points")
    if keys:
        sketch = join_on(slim, short(sizes), keys, "inner").groupBy(*keys).agg(F.max("_n").alias("_n"), points)
    else:
        sketch = slim.agg(F.count(F.lit(1)).alias("_n"), points)

    rows = []
    for row in sketch.collect():
        wanted = min(sketched, max(2, math.ceil(row["_n"] / share)))
        step = sketched / wanted
        picked = sorted({row["_points"][min(len(row["_points"]) - 1, round(i * step) - 1)] for i in range(1, wanted)})
        width = max(1, math.isqrt(len(picked)))
        fine = [picked[i : i + width] for i in range(0, len(picked), width)]
        rows.append(tuple(row[k] for k in keys) + ([chunk[-1] for chunk in fine], fine, width))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in key_fields]
        + [
            T.StructField("_coarse", T.ArrayType(T.DoubleType())),
            T.StructField("_fine", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("_width", T.IntegerType()),
        ]
    )
    return SlicePlan(tuple(keys), order, spark.createDataFrame(rows, schema))


def add_slices(df: DataFrame, plan: SlicePlan, order: str | None = None) -> DataFrame:
    """Add ``_slice`` (monotone in the order column inside a key) and ``_hot``."""
    if plan.table is None:
        return df.withColumns({SLICE: F.lit(0), HOT: F.lit(False)})
    x = order_value(df, order or plan.order)
    base = df.withColumn(PLACE, x)
    if plan.keys:
        wide = join_on(base, short(plan.table), list(plan.keys), "left")
    else:
        edges = plan.table
        wide = base.withColumns({c: edges.select(c).scalar() for c in ("_coarse", "_fine", "_width")})
    chunk = F.size(F.filter("_coarse", lambda e: e < F.col(PLACE)))
    inner = F.size(F.filter(F.get("_fine", chunk), lambda e: e < F.col(PLACE)))
    number = F.when(
        F.col("_coarse").isNotNull(),
        chunk * F.col("_width") + F.when(chunk < F.size("_fine"), inner).otherwise(0),
    ).otherwise(0)
    return wide.withColumns({SLICE: number.cast("int"), HOT: F.col("_coarse").isNotNull()}).drop(
        "_coarse", "_fine", "_width", PLACE
    )


def desc_of(order: Sequence[Column]) -> list[Column]:
    """Reverse of an ascending, NULLS FIRST order."""
    return [c.desc_nulls_last() for c in order]
