"""Chronological splits and purged folds.

Fold tables hold one row per (group, fold); rows join them by group. Group positions come from
prefix sums, so a long list of groups is not pulled into one task.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import attach_totals, join_on, nz, ratio
from ..operators.prior import prefix_sums
from ..operators.slices import lookup_join
from ..session import cut_lineage


def split_by_dates(df: DataFrame, day: str, train_end, val_end, test_end=None, out: str = "split") -> DataFrame:
    """train up to ``train_end``, val up to ``val_end``, test up to ``test_end`` (all inclusive).

    Rows after ``test_end`` stay unlabelled.
    """
    d = F.col(day)
    label = F.when(d <= F.lit(train_end), "train").when(d <= F.lit(val_end), "val")
    label = label.when(d <= F.lit(test_end), "test") if test_end is not None else label.when(d.isNotNull(), "test")
    return df.withColumn(out, label)


def split_by_fraction(df: DataFrame, day: str, train: float = 0.7, val: float = 0.15, test: float | None = None, out: str = "split") -> DataFrame:
    """Fractions of the distinct dates, oldest first; a date is never divided.

    Each part ends at date number ``floor(share * n) - 1`` (at least 0), shares cumulated.
    """
    test = max(0.0, 1.0 - train - val) if test is None else test
    if min(train, val, test) < 0:
        raise ValueError("split fractions must not be negative")
    total = train + val + test
    train, val, test = (0.7, 0.15, 0.15) if total <= 0 else (train / total, val / total, test / total)
    days = df.where(F.col(day).isNotNull()).select(day).distinct()
    ranked = prefix_sums(days, [], day, {"_rank": F.lit(1)}, plan=None)
    ranked = ranked.withColumn("_n", days.agg(F.count(F.lit(1)).alias("n")).scalar())

    def last(share: float) -> Column:
        return F.greatest(F.least(F.floor(F.col("_n") * share + 1e-9) - 1, F.col("_n") - 1), F.lit(0))

    r = F.col("_rank")
    label = F.when(r <= last(train), "train").when(r <= last(train + val), "val").when(r <= last(train + val + test), "test")
    return join_on(df, ranked.select(day, label.alias(out)), day)


def split_production(df: DataFrame, day: str, cut, out: str = "split") -> DataFrame:
    """Everything up to the cut date trains; later rows stay unlabelled."""
    return df.withColumn(out, F.when(F.col(day).cast("date") <= F.lit(cut).cast("date"), "train"))


def split_rolling_weeks(
    df: DataFrame,
    val_weeks: tuple[int, int] | None,
    test_weeks: tuple[int, int] | None,
    train_weeks: tuple[int, int] | None = None,
    post_weeks: tuple[int, int] | None = None,
    out: str = "split",
) -> DataFrame:
    """Week windows in the last season; earlier seasons train.

    A window that holds no played week takes its length from the end of the weeks still free.
    Weeks of the season that no window takes are tested. Only the distinct week numbers of one
    season reach the driver.
    """
    last = df.agg(F.max("season").alias("s")).first()["s"]
    weeks = sorted(r["week"] for r in df.where((F.col("season") == last) & F.col("week").isNotNull()).select("week").distinct().collect())

    def take(window: tuple[int, int] | None, free: list[int]) -> list[int]:
        if window is None:
            return []
        inside = [w for w in weeks if window[0] <= w <= window[1]]
        span = max(0, window[1] - window[0] + 1)
        return inside or (free[-span:] if span else [])

    test = take(test_weeks, weeks)
    free = [w for w in weeks if w not in test]
    val = take(val_weeks, free)
    free = [w for w in free if w not in val]
    train = [w for w in free if train_weeks and train_weeks[0] <= w <= train_weeks[1]] or free
    rest = [w for w in weeks if w not in {*train, *val, *test}]
    post = [w for w in weeks if post_weeks and post_weeks[0] <= w <= post_weeks[1]]
    current, week = F.col("season") == last, F.col("week")
    label = F.when(F.col("season") < last, "train")
    for name, chosen in (("val", val), ("test", [*test, *rest, *post]), ("train", train)):
        if chosen:
            label = label.when(current & week.isin(chosen), name)
    return df.withColumn(out, label)


def group_label(df: DataFrame, group: str | None = None, day: str | None = None) -> Column:
    """Label of the fold group: a given column, season-week, or the date."""
    have = set(df.columns)
    if group and group in have:
        return nz(F.col(group).cast("string"), "__missing__")
    if {"season", "week"} <= have:
        return F.concat_ws("-", nz("season", -1).cast("string"), nz("week", -1).cast("string"))
    return nz(F.date_format(F.col(day), "yyyy-MM-dd"), "__missing__")


def embargo_to_groups(df: DataFrame, group: str, day: str, embargo_days: int) -> int:
    """Whole groups that cover an embargo in days, by the mean number of groups first seen per day."""
    if embargo_days <= 0:
        return 0
    first = df.where(F.col(group).isNotNull() & F.col(day).isNotNull()).groupBy(group).agg(F.min(F.to_date(day)).alias("_d"))
    row = first.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_d").alias("d")).first()
    per_day = row["n"] / row["d"] if row["d"] else 1.0
    return max(1, math.ceil(per_day * embargo_days))


def group_stats(df: DataFrame, group: str, ts: str) -> DataFrame:
    """Groups in time order: first and last time, position, number of groups."""
    stats = df.where(F.col(group).isNotNull() & F.col(ts).isNotNull()).groupBy(group).agg(
        F.min(ts).alias("t_min"), F.max(ts).alias("t_max")
    )
    placed = prefix_sums(stats, [], ["t_min", group], {"position": F.lit(1)})
    return placed.withColumn("n_groups", stats.agg(F.count(F.lit(1)).alias("n")).scalar())


def test_size(n_groups: int, n_splits: int, given: int | None = None, cap: int | None = None) -> int:
    """Groups per test block."""
    if given is not None:
        if given <= 0 or given > n_groups:
            raise ValueError("test group size must be between 1 and the number of groups")
        return min(given, cap) if cap else given
    size = max(1, n_groups // max(n_splits + 1, 2))
    return min(size, cap) if cap else size


def purged_folds(
    df: DataFrame,
    group: str,
    ts: str,
    n_splits: int,
    purge_days: float = 0.0,
    purge_groups: int = 0,
    embargo_groups: int = 0,
    max_train_groups: int | None = None,
    test_groups: int | None = None,
    max_test_groups: int | None = None,
) -> DataFrame:
    """Fold table ``(group, fold, role)``.

    Test blocks fill the end of the timeline. A training group precedes its block by more than
    ``purge_groups`` groups and ends before the block's start minus ``purge_days``. An embargo
    concerns groups *after* a block, which train nothing here, so it only labels them. A fold whose
    training side is purged away is left out.
    """
    stats = group_stats(df, group, ts)
    n = stats.count()
    if n < n_splits + 1:
        raise ValueError(f"{n} groups cannot fill {n_splits} folds")
    size = test_size(n, n_splits, test_groups, max_test_groups)
    if n_splits * size > n:
        raise ValueError("test blocks need more groups than there are")
    long = stats.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.lit(n - n_splits * size) + F.col("fold") * size
    tested = (F.col("position") >= start) & (F.col("position") < start + size)
    long = attach_totals(long.withColumn("_test", tested), "fold", {"_begins": F.min(F.when(F.col("_test"), F.col("t_min")))})
    purge = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(purge_days * 86400.0).cast("decimal(18,6)"))
    early = (F.col("position") < start - purge_groups) & (F.col("t_max").cast("timestamp") < F.col("_begins").cast("timestamp") - purge)
    after = (F.col("position") >= start + size) & (F.col("position") < start + size + embargo_groups)
    role = F.when(F.col("_test"), "test").when(early, "train").when(after, "embargo")
    table = long.withColumn("role", role).where(F.col("role").isNotNull())
    if max_train_groups is not None:
        trained = table.where("role = 'train'")
        ranked = prefix_sums(trained.withColumn("_back", -F.col("position")), "fold", "_back", {"_age": F.lit(1)})
        table = table.where("role != 'train'").withColumns({"_back": F.lit(0), "_age": F.lit(0)}).unionByName(
            ranked.where(F.col("_age") < max_train_groups).withColumn("_back", F.lit(0)), allowMissingColumns=True
        )
    table = attach_totals(table, "fold", {"_train": F.sum(F.when(F.col("role") == "train", 1).otherwise(0))})
    return cut_lineage(table.where(F.col("_train") > 0).select(group, "fold", "role", "position"))


def block_folds(
    df: DataFrame, group: str, order: str, n_splits: int, gap: int = 0, post_gap: int = 0,
    max_train_groups: int | None = None, max_test_groups: int | None = None, test_groups: int | None = None,
) -> DataFrame:
    """Fold table over contiguous blocks of groups, by position only; empty folds are left out."""
    stats = group_stats(df, group, order)
    n = stats.count()
    if n_splits + 1 > n:
        raise ValueError(f"{n_splits + 1} folds need more than {n} groups")
    size = test_groups or min(n // (n_splits + 1), max_test_groups or n)
    if size * n_splits > n:
        raise ValueError("test blocks need more groups than there are")
    long = stats.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.lit(n - n_splits * size) + F.col("fold") * size
    lowest = F.greatest(start - gap - max_train_groups, F.lit(0)) if max_train_groups is not None else F.lit(0)
    p = F.col("position")
    after = (p >= start + size) & (p < start + size + post_gap)
    role = F.when((p >= start) & (p < start + size), "test").when((p >= lowest) & (p < start - gap) & ~after, "train")
    table = long.withColumn("role", role).where(F.col("role").isNotNull())
    table = attach_totals(table, "fold", {"_train": F.sum(F.when(F.col("role") == "train", 1).otherwise(0))})
    return cut_lineage(table.where(F.col("_train") > 0).select(group, "fold", "role", "position"))


def assign_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """One row per (row, fold) with its role."""
    return lookup_join(df, folds.select(group, "fold", "role"), group, "inner")


def fold_summary(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows and groups per fold and role."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_on(folds, sizes, group, "inner")
    return joined.groupBy("fold", "role").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("groups"))


def positive_rate_by_fold(df: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    joined = assign_folds(df, folds, group)
    return joined.groupBy("fold", "role").agg(ratio(F.sum(label), F.count(label)).alias("positive_rate"))
