"""Strictly-prior windows.

"Prior" always excludes the current row. Two shapes:

* ``prior_rows``   last N rows before the current one (lags, rolling sums, means, deviations);
* ``prefix_sums``  everything before the current row (season-to-date, lifetime, ranks).

Both take a total order and run one window per (key, slice): plain for ordinary keys, sliced
with a halo or a carry for hot keys (see :mod:`tidemark.operators.slices`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import as_list, attach_totals, join_on, nz, ratio
from .slices import HOT, SLICE, SlicePlan, add_slices, plan_slices

CONTEXT = "_context"


def _window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    parts = [F.col(k) for k in keys] or [F.lit(0)]
    return Window.partitionBy(*parts).orderBy(*[F.col(o) for o in order])


def prior_rows(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    reach: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    plan: SlicePlan | str | None = "auto",
) -> DataFrame:
    """Add window columns that look back at most ``reach`` rows.

    ``build`` gets the window (partitioned and ordered, without a frame) and returns the columns.
    Several dicts may be chained by returning columns that only use input columns. ``plan=None``
    says that the caller knows the groups are bounded, e.g. one row per day of a calendar.
    """
    keys, order = as_list(keys), as_list(order)
    if plan == "auto":
        plan = plan_slices(df, keys, order[0])
    if plan is None or not plan.any_hot:
        return df.withColumns(dict(build(_window(keys, order))))

    columns = df.columns
    base = add_slices(df, plan)
    hot = base.where(HOT)
    in_slice = _window([*keys, SLICE], order)
    backwards = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    tail = hot.withColumn("_from_end", F.row_number().over(backwards)).where(F.col("_from_end") <= reach)

    # Per hot key at most a few thousand slices: which later slices still see this one's tail?
    sizes = hot.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, reach)
    later = F.collect_list(F.struct(F.col(SLICE).alias("to"), F.col("_n").alias("n"))).over(ahead)
    reachable = (
        sizes.withColumn("_later", later)
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_later"), F.lit(1)))))
        .where(F.size("_later") > 0)
        .select(
            *keys,
            SLICE,
            F.element_at("_later", F.col("_i"))["to"].alias("_to"),
            F.aggregate(
                F.slice("_later", F.lit(1), F.col("_i") - 1), F.lit(0).cast("bigint"), lambda a, e: a + e["n"]
            ).alias("_between"),
        )
        .where(F.col("_between") < reach)
    )
    halo = (
        join_on(tail, reachable, [*keys, SLICE], "inner")
        .where(F.col("_from_end") + F.col("_between") <= reach)
        .withColumn(SLICE, F.col("_to"))
        .select(*columns, SLICE, F.lit(True).alias(CONTEXT))
    )
    both = base.select(*columns, SLICE, F.lit(False).alias(CONTEXT)).unionByName(halo)
    return both.withColumns(dict(build(in_slice))).where(~F.col(CONTEXT)).drop(SLICE, CONTEXT)


def _reversed(df: DataFrame, name: str) -> Column:
    """A numeric image of an order column that falls as it rises; NULL, first in rising order, comes last."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        value = F.unix_date(name).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(F.col(name).cast("timestamp"))
    elif isinstance(kind, T.IntegralType):
        value = F.col(name).cast("bigint")
    else:
        return F.coalesce(-F.col(name).cast("double"), F.lit(float("inf")))
    return F.coalesce(-value, F.lit((1 << 63) - 1))


def later_rows(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    reach: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    plan: SlicePlan | str | None = "auto",
) -> DataFrame:
    """Add window columns that look ahead at most ``reach`` rows.

    ``build`` gets the window in falling order: ``lag`` is the next row and the frame ``-n .. -1`` the next ``n`` rows. Hot
    keys are cut along the falling order, and each slice is given the rows that follow it, as ``prior_rows`` gives those before.
    """
    keys, order = as_list(keys), as_list(order)
    names = {f"_falling{k}": _reversed(df, o) for k, o in enumerate(order)}
    return prior_rows(df.withColumns(names), keys, list(names), reach, build, plan).drop(*names)


def prefix_sums(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    sums: Mapping[str, Column],
    plan: SlicePlan | str | None = "auto",
) -> DataFrame:
    """Add exclusive running sums: each output is the sum over all earlier rows, 0 on the first."""
    keys, order = as_list(keys), as_list(order)
    if plan == "auto":
        plan = plan_slices(df, keys, order[0])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if plan is None or not plan.any_hot:
        frame = before(_window(keys, order))
        return df.withColumns({n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in sums.items()})

    measures = {f"_m_{n}": c for n, c in sums.items()}
    base = add_slices(df.withColumns(measures), plan)
    slice_totals = base.groupBy(*keys, SLICE).agg(*[F.sum(m).alias(f"_s{m}") for m in measures])
    across = before(Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(SLICE))
    carry = slice_totals.select(
        *keys, SLICE, *[F.coalesce(F.sum(f"_s{m}").over(across), F.lit(0)).alias(f"_c{m}") for m in measures]
    )
    wide = join_on(base, carry, [*keys, SLICE], "left")
    frame = before(_window([*keys, SLICE], order))
    out = wide.withColumns(
        {n: F.coalesce(F.sum(f"_m_{n}").over(frame), F.lit(0)) + F.col(f"_c_m_{n}") for n in sums}
    )
    return out.drop(SLICE, HOT, *measures, *[f"_c{m}" for m in measures])


# --- expression builders over an unframed window --------------------------------------------


def last_rows(window: WindowSpec, n: int) -> WindowSpec:
    """Frame of the ``n`` rows before the current one."""
    return window.rowsBetween(-n, -1)


def prior_mean(column: str | Column, window: WindowSpec, n: int) -> Column:
    return F.avg(column).over(last_rows(window, n))


def prior_sum(column: str | Column, window: WindowSpec, n: int) -> Column:
    return F.sum(column).over(last_rows(window, n))


def prior_ratio(num: str | Column, den: str | Column, window: WindowSpec, n: int) -> Column:
    """Σnum / Σden over the ``n`` prior rows; NULL without prior rows or with a zero denominator."""
    return ratio(prior_sum(num, window, n), prior_sum(den, window, n))


def rolling_ratios(
    df: DataFrame,
    keys: str | Sequence[str],
    day: str,
    stats: Mapping[str, tuple[str, str]],
    windows: Sequence[int] = (1, 3, 5),
    slice_of: Mapping[str, str] | None = None,
    lifetime: bool = True,
    min_support: Mapping[str, float] | None = None,
    plan: SlicePlan | str | None = None,
    support: str | None = None,
) -> DataFrame:
    """Rolling, to-date and lifetime ratios for rows that hold one (key, day) total each.

    ``stats`` maps a feature name to its (numerator, denominator) columns. ``slice_of`` maps a
    suffix to a column that restarts the running total (``{"season": "season"}`` gives
    season-to-date). ``min_support`` maps a feature name to the least *prior* denominator below
    which its lifetime ratio is NULL. ``support`` names a column for the prior denominator of the
    first feature.
    """
    keys = as_list(keys)
    min_support = dict(min_support or {})

    def rolling(w: WindowSpec) -> dict[str, Column]:
        return {
            f"{name}_l{n}": prior_ratio(num, den, w, n) for name, (num, den) in stats.items() for n in windows
        }

    out = prior_rows(df, keys, day, max(windows), rolling, plan=plan) if windows else df
    measured = sorted({c for pair in stats.values() for c in pair})
    for suffix, restart in (slice_of or {}).items():
        out = prefix_sums(
            out, [*keys, restart], day, {f"_to_{c}": F.col(c) for c in measured}, plan=plan
        )
        out = out.withColumns(
            {f"{n}_{suffix}": ratio(F.col(f"_to_{a}"), F.col(f"_to_{b}")) for n, (a, b) in stats.items()}
        ).drop(*[f"_to_{c}" for c in measured])
    if lifetime:
        out = prefix_sums(out, keys, day, {f"_to_{c}": F.col(c) for c in measured}, plan=plan)
        columns = {}
        for name, (num, den) in stats.items():
            value = ratio(F.col(f"_to_{num}"), F.col(f"_to_{den}"))
            if name in min_support:
                value = F.when(F.col(f"_to_{den}") >= min_support[name], value)
            columns[f"{name}_lifetime"] = value
        if support:
            columns[support] = nz(f"_to_{next(iter(stats.values()))[1]}")
        out = out.withColumns(columns).drop(*[f"_to_{c}" for c in measured])
    return out


def event_rate_history(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    event: str,
    prefix: str,
    season: str | None = None,
    plan: SlicePlan | str | None = "auto",
) -> DataFrame:
    """Event rate of the last one and two units, of the season so far and of all time.

    The first unit of a key has no history and yields NULL.
    """
    keys = as_list(keys)
    x = F.col(event).cast("double")
    out = prior_rows(
        df,
        keys,
        order,
        2,
        lambda w: {f"{prefix}_rate_1": F.avg(x).over(last_rows(w, 1)), f"{prefix}_rate_2": F.avg(x).over(last_rows(w, 2))},
        plan=plan,
    )
    one = F.when(x.isNotNull(), 1).otherwise(0)
    sums = {"_s": F.coalesce(x, F.lit(0.0)), "_n": one}
    if season:
        season_plan = plan if plan in (None, "auto") else "auto"
        out = prefix_sums(out, [*keys, season], order, sums, plan=season_plan)
        out = out.withColumn(f"{prefix}_rate_season", ratio(F.col("_s"), F.col("_n"))).drop("_s", "_n")
    out = prefix_sums(out, keys, order, sums, plan=plan)
    return out.withColumn(f"{prefix}_rate_lifetime", ratio(F.col("_s"), F.col("_n"))).drop("_s", "_n")


def runs(
    df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], label: str, out: str = "run_length"
) -> DataFrame:
    """Gaps and islands: position of each row inside its run of equal labels.

    The island is the number of label changes so far; the length counts rows since the change,
    as the running row number minus the row number at which the island began.
    """
    keys, order = as_list(keys), as_list(order)
    plan = plan_slices(df, keys, order[0])
    step = prior_rows(df, keys, order, 1, lambda w: {"_was": F.lag(label).over(w), "_first": F.lag(F.lit(1)).over(w).isNull()}, plan=plan)
    changed = F.when(F.col("_first") | ~F.col(label).eqNullSafe(F.col("_was")), 1).otherwise(0)
    numbered = prefix_sums(step.withColumn("_changed", changed), keys, order, {"_rn": F.lit(1), "_earlier": F.col("_changed")}, plan=plan)
    island = numbered.withColumn("_island", F.col("_earlier") + F.col("_changed"))
    started = attach_totals(island, [*keys, "_island"], {"_start": F.min("_rn")})
    return started.withColumn(out, (F.col("_rn") - F.col("_start") + 1).cast("int")).drop(
        "_was", "_first", "_changed", "_rn", "_earlier", "_island", "_start"
    )
