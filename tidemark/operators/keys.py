"""Small column and join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(names: str | Sequence[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def ratio(num: Column, den: Column, otherwise: Column | float | None = None) -> Column:
    """``num / den`` where ``den > 0``; NULL (or ``otherwise``) elsewhere, never NaN."""
    expr = F.when(den > 0, num / den)
    return expr if otherwise is None else expr.otherwise(otherwise)


def nz(column: Column | str, default: float | int = 0) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(default))


def flag(condition: Column) -> Column:
    """0/1 integer of a condition; NULL counts as 0."""
    return F.when(condition, 1).otherwise(0)


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` alone would skip it)."""
    out = column
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(column.isNotNull(), out)


def add_all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "left",
    prefix: str = "__r_",
) -> DataFrame:
    """Join on equally named keys, NULL equal to NULL, keeping the left key columns once.

    ``eqNullSafe`` is still an equi-join to Spark, so hash partitioning, runtime broadcast by
    measured size and skew splitting all apply.
    """
    keys = as_list(keys)
    renamed = right.withColumnsRenamed({k: prefix + k for k in keys})
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[prefix + k]) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[prefix + k for k in keys])


def attach_totals(df: DataFrame, keys: str | Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates back on every row.

    ``agg().over(partitionBy(keys))`` would pull one whole group into a single task. Here the
    group is pre-aggregated map-side and the totals joined back by a join that spreads hot keys.
    """
    from .slices import lookup_join

    totals = df.groupBy(*as_list(keys)).agg(*[c.alias(n) for n, c in aggs.items()])
    return lookup_join(df, totals, keys)


def latest_by(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the row with the greatest ``order``. A partial aggregate, no window sort."""
    keys = as_list(keys)
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col("_best")[c].alias(c) for c in columns])


def order_value(df: DataFrame, name: str) -> Column:
    """A numeric image of an order column, monotone in it."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(dtype, T.NumericType):
        return column.cast("double")
    raise TypeError(f"{name}: order columns must be numeric, date or timestamp, not {dtype}")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds (with fraction) between two timestamps, NTZ or instant."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1e6)
