"""Building blocks of derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Spec = tuple[str, Sequence[str], Column]


def derive(df: DataFrame, specs: Iterable[Spec]) -> DataFrame:
    """Add every column whose inputs exist, in one projection."""
    have = set(df.columns)
    columns = {name: column for name, needs, column in specs if set(needs) <= have}
    return df.withColumns(columns) if columns else df


def or0(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def bounded(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip; NULL stays NULL."""
    out = column
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(column.isNotNull(), out)


def tier(value: Column, cuts: Sequence[tuple[float, float]], default: float = 0, below: bool = False) -> Column:
    """First matching label of ``(threshold, label)`` pairs, tested in the given order."""
    out = None
    for threshold, label in cuts:
        hit = value < threshold if below else value > threshold
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def lookup(key: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """Map a key through a fixed small table."""
    out = None
    for label, value in table.items():
        out = F.when(key == label, F.lit(value)) if out is None else out.when(key == label, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds; a NULL condition does not hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))
