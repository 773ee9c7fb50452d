"""Exact order statistics without collecting a group.

``percentile`` and ``median`` hold every distinct value of a group in one buffer. Here values are
first counted per (group, value), then ranked by exclusive prefix sums (sliced for hot groups),
and the wanted ranks picked by a conditional aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import as_list, attach_totals, join_on
from .prior import prefix_sums
from .slices import has_hot_key, plan_slices


def value_ranks(df: DataFrame, keys: str | Sequence[str], value: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with count ``_c``, rows before ``_before`` and group size ``_total``.

    ``extra`` adds more sums per distinct value (``name``, ``name_before``, ``name_total``), e.g.
    positives.
    """
    keys = as_list(keys)
    extra = dict(extra or {})
    valued = df.where(F.col(value).isNotNull())
    counts = valued.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(n) for n, c in extra.items()])
    sums = {"_before": F.col("_c")} | {f"{n}_before": F.col(n) for n in extra}
    # Distinct values are at most the rows, so the cheap row count rules out hot groups first.
    plan = plan_slices(counts, keys, value) if has_hot_key(valued, keys) else None
    ranked = prefix_sums(counts, keys, value, sums, plan=plan)
    totals = {"_total": F.col("_c")} | {f"{n}_total": F.col(n) for n in extra}
    if plan is None or not plan.any_hot:
        # Bounded groups: the total shares the window's partitioning, no join and no second scan.
        whole = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
        return ranked.withColumns({n: F.sum(c).over(whole) for n, c in totals.items()})
    if keys:
        return attach_totals(ranked, keys, {n: F.sum(c) for n, c in totals.items()})
    row = counts.agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    return ranked.withColumns({n: row.select(n).scalar() for n in totals})


def quantiles(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """One row per group with a column per named probability.

    ``linear`` interpolates between the neighbours of ``p * (n - 1)``, ``higher`` takes the upper,
    ``lower`` the lower neighbour.
    """
    keys = as_list(keys)
    ranked = value_ranks(df, keys, value)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")), F.col(value)))

    picks = {}
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        # Guard products such as 0.7 * 10 that land a hair off an integer.
        position = F.round(position, 9)
        picks[f"_lo_{name}"] = at(F.floor(position))
        picks[f"_hi_{name}"] = at(F.ceil(position))
        picks[f"_w_{name}"] = F.max(position - F.floor(position))
    grouped = (ranked.groupBy(*keys) if keys else ranked.groupBy()).agg(*[c.alias(n) for n, c in picks.items()])
    out = []
    for name in probs:
        low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        chosen = {"linear": low + (high - low) * weight, "higher": high, "lower": low}[method]
        out.append(chosen.alias(name))
    return grouped.select(*keys, *out)


def median(df: DataFrame, keys: str | Sequence[str], value: str, name: str) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def quantile_edges(df: DataFrame, value: str, bins: int, outer: tuple[float, float] | None = None) -> DataFrame:
    """One row with ``edges``: the distinct sorted bin edges of equal-mass binning."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    row = quantiles(df, [], value, probs)
    names = [F.col(n) for n in probs]
    if outer is not None:
        names = [F.lit(float(outer[0])), *names[1:-1], F.lit(float(outer[1]))]
    return row.select(F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def quantile_bucket(df: DataFrame, value: str, bins: int, out: str = "bucket", outer: tuple[float, float] | None = None) -> DataFrame:
    """Equal-mass buckets, right-closed, duplicate edges dropped, lowest edge included.

    ``outer`` puts the outermost edges elsewhere, so rows tied at the lowest value keep a bucket of
    their own. The edges are a one-row scalar subquery, so no row of the data is moved to bucket it.
    """
    edges = quantile_edges(df, value, bins, outer)
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return (
        df.withColumn("_edges", edges.scalar())
        .withColumn(out, F.when(F.col(value).isNotNull(), number))
        .drop("_edges")
    )


def flag_top_quantile(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    q: float,
    out: str,
    method: str = "higher",
) -> DataFrame:
    """1 where a non-null ``value`` reaches its group's quantile (that of all rows, NULL as 0,
    where the group has none)."""
    keys = as_list(keys)
    local = quantiles(df, keys, value, {"_cut": q}, method)
    filled = df.select(F.coalesce(F.col(value), F.lit(0.0)).alias(value))
    overall = quantiles(filled, [], value, {"_all": q}, method)
    wide = join_on(df, local, keys, "left").withColumn("_all", overall.scalar())
    cut = F.coalesce(F.col("_cut"), F.col("_all"))
    return wide.withColumn(out, F.when(F.col(value) >= cut, 1).otherwise(0)).drop("_cut", "_all")
