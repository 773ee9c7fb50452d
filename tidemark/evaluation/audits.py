"""Data audits: profiles, coverage, latency, label checks, bucket scans, associations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.market import erf
from ..operators.keys import attach_totals, flag, join_on, nz, ratio
from ..operators.quantiles import quantile_bucket, quantiles, value_ranks
from .scores import probability_metrics

# --- column profiles -------------------------------------------------------------------------------


def _names(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def coverage_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: rows, non-null, coverage, distinct values (``exact=False``: sketched). One aggregate over the data."""
    columns = list(columns or [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))])
    distinct = F.countDistinct if exact else F.approx_count_distinct
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)])
    out = wide.select("_rows", F.explode(entries).alias("_e")).select(F.col("_rows").alias("rows"), "_e.*")
    return out.withColumns(
        {
            "missing": F.col("rows") - F.col("non_null"),
            "coverage_pct": F.round(100.0 * ratio(F.col("non_null"), F.col("rows"), 0.0), 2),
            "uniqueness_pct": F.round(100.0 * ratio(F.col("distinct"), F.col("non_null"), 0.0), 2),
            "likely_categorical": flag((100.0 * ratio(F.col("distinct"), F.col("non_null"), 0.0) < 5) | (F.col("distinct") < 50)),
            "has_duplicates": flag(F.col("distinct") < F.col("non_null")),
        }
    )


def melt(df: DataFrame, columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """Long (column, value) rows of several columns; the row count grows by the column list only."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*").where(F.col("value").isNotNull())


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per numeric column: moments, exact quartiles, IQR outliers and values outside a given range."""
    columns = list(columns or _names(df, T.NumericType))
    long = melt(df, columns)
    stats = long.groupBy("column").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    quart = quantiles(long, ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    table = join_on(stats, quart, "column")
    reach = (F.col("q75") - F.col("q25")) * 1.5
    fences = table.select("column", (F.col("q25") - reach).alias("_lo"), (F.col("q75") + reach).alias("_hi"))
    # One fence row per column, a table as small as the schema: sent to the rows, as a shuffle would put a whole column into one task.
    outside = join_on(long, F.broadcast(fences), "column", "inner").groupBy("column").agg(
        F.sum(flag(F.col("value") < F.col("_lo"))).alias("outliers_low"),
        F.sum(flag(F.col("value") > F.col("_hi"))).alias("outliers_high"),
        F.min(F.when(F.col("value") < F.col("_lo"), F.col("value"))).alias("extreme_low"),
        F.max(F.when(F.col("value") > F.col("_hi"), F.col("value"))).alias("extreme_high"),
    )
    table = join_on(table, outside, "column").withColumn(
        "outlier_pct", 100.0 * (F.col("outliers_low") + F.col("outliers_high")) / F.col("n")
    )
    if ranges:
        below = F.lit(0)
        above = F.lit(0)
        for name, (low, high) in ranges.items():
            mine = F.col("column") == name
            below = below + F.sum(flag(mine & (F.col("value") < low)))
            above = above + F.sum(flag(mine & (F.col("value") > high)))
        checks = long.groupBy("column").agg(below.alias("below_min"), above.alias("above_max"))
        table = join_on(table, checks, "column")
    return table


# Texts that hide a missing value.
SUSPICIOUS = ("unknown", "null", "none", "n/a", "error", r"\?", "undefined")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def categorical_profile(df: DataFrame, columns: Sequence[str], expected: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per text column: distinct values, blanks, suspicious and unexpected values."""
    long = melt(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    odd = F.lower("value").rlike("|".join(SUSPICIOUS))
    aggs = {
        "distinct": F.count(F.lit(1)),
        "rows": F.sum("n"),
        "empty": F.sum(F.when(F.col("value") == "", F.col("n")).otherwise(0)),
        "suspicious": F.sum(F.when(odd, F.col("n")).otherwise(0)),
    }
    if expected:
        hit = F.lit(False)
        for name, values in expected.items():
            hit = hit | ((F.col("column") == name) & F.col("value").isin(list(values)))
        known = F.col("column").isin(list(expected))
        aggs["unexpected_values"] = F.sum(flag(known & ~hit))
    return long.groupBy("column").agg(*[c.alias(n) for n, c in aggs.items()])


def datetime_profile(df: DataFrame, columns: Sequence[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Per time column: first, last, span, distinct dates, values outside a range of years."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("timestamp_ntz").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*").where(F.col("value").isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n"), F.min("value").alias("earliest"), F.max("value").alias("latest"),
        F.datediff(F.max(F.to_date("value")), F.min(F.to_date("value"))).alias("span_days"), F.countDistinct(F.to_date("value")).alias("unique_dates"),
    ]
    if years:
        aggs += [F.sum(flag(F.year("value") < years[0])).alias("before_min_year"), F.sum(flag(F.year("value") > years[1])).alias("after_max_year")]
    return long.groupBy("column").agg(*aggs)


def missing_pattern(df: DataFrame, column: str, by: str, date: str | None = None) -> DataFrame:
    """Where a column is missing: counts per category and the date range of the gaps."""
    aggs = [F.count(F.lit(1)).alias("missing")]
    if date:
        aggs += [F.min(date).alias("earliest"), F.max(date).alias("latest")]
    return df.where(F.col(column).isNull()).groupBy(by).agg(*aggs)


def sparse_columns(profile: DataFrame, limits: Mapping[str, float], default: float = 0.5) -> DataFrame:
    """Columns missing more often than expected; ``limits`` gives the share expected by name."""
    share = 1 - F.col("coverage_pct") / 100
    limit = F.lit(default)
    for name, value in limits.items():
        limit = F.when(F.col("column") == name, value).otherwise(limit)
    return profile.where(share > limit)


# --- feeds -------------------------------------------------------------------------------------------


def snapshot_coverage(df: DataFrame, snapshots: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows with each snapshot, overall or by horizon."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(flag(F.col(s).isNotNull())).alias(f"{s}_coverage") for s in snapshots])


def knownness(df: DataFrame, snapshots: Mapping[str, str], cutoff: str) -> DataFrame:
    """Per feed: non-null, known at the cutoff, its rate over all rows, violations after it."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n_{f}") for f, c in snapshots.items()],
        *[F.sum(flag(F.col(c) <= F.col(cutoff))).alias(f"k_{f}") for f, c in snapshots.items()],
        *[F.sum(flag(F.col(c) > F.col(cutoff))).alias(f"v_{f}") for f, c in snapshots.items()],
    )
    entries = F.array(
        *[F.struct(F.lit(f).alias("feed"), F.col(f"n_{f}").alias("non_null"), F.col(f"k_{f}").alias("known_at_cutoff"), F.col(f"v_{f}").alias("violations")) for f in snapshots]
    )
    out = wide.select("_rows", F.explode(entries).alias("_e")).select(F.col("_rows").alias("rows"), "_e.*")
    return out.withColumn("known_rate", ratio(F.col("known_at_cutoff"), F.col("rows")))


LATENCY_POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def latency_summary(df: DataFrame, keys: Sequence[str], minutes: str) -> DataFrame:
    """Distribution of arrival latency per feed and label, with exact percentiles."""
    stats = df.where(F.col(minutes).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(minutes).alias("mean"), F.stddev_samp(minutes).alias("std"), F.min(minutes).alias("min"), F.max(minutes).alias("max")
    )
    return join_on(stats, quantiles(df, list(keys), minutes, LATENCY_POINTS), list(keys))


def arrival_summary(df: DataFrame, keys: Sequence[str], ts: str, start: str, category: str) -> DataFrame:
    """Arrivals per game and team: first, last, rows, distinct categories, minutes to the start.

    Categories are a small code list (positions, kinds), so the set per group stays small.
    """
    out = df.groupBy(*keys).agg(
        F.min(ts).alias("first_arrival"), F.max(ts).alias("last_arrival"), F.count(F.lit(1)).alias("rows"),
        F.array_join(F.sort_array(F.collect_set(category)), ",").alias("categories"), F.max(start).alias("start"),
    )
    to_go = (F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(F.col("last_arrival").cast("timestamp"))) / 60e6
    return out.withColumn("minutes_to_start", F.round(to_go, 3))


# --- label and chain audits ------------------------------------------------------------------------


def label_audit(df: DataFrame, label: str, opportunities: str, count: str) -> DataFrame:
    """Does label times opportunities rebuild the count? Error quantiles and a pass flag."""
    usable = df.where(nz(opportunities, 0.0) > 0)
    error = F.abs(F.col(label) * F.col(opportunities) - nz(count, 0.0))
    shaped = usable.select(error.alias("_e"), F.col(label).isNull().cast("int").alias("_null"))
    stats = shaped.agg(
        F.count(F.lit(1)).alias("n_with_opp"), F.sum("_null").alias("null_labels"), F.avg("_e").alias("mae"), F.max("_e").alias("max_abs_err"),
        F.avg(flag(F.col("_e") > 0.25)).alias("share_gt_quarter"), F.avg(flag(F.col("_e") > 0.5)).alias("share_gt_half"),
    )
    tail = quantiles(shaped, [], "_e", {"p95": 0.95, "p99": 0.99})
    passed = (F.col("null_labels") == 0) & (F.col("share_gt_quarter") <= 0.01) & (F.col("share_gt_half") <= 0.001)
    return stats.withColumns({"p95": tail.select("p95").scalar(), "p99": tail.select("p99").scalar(), "passed": flag(passed), "label": F.lit(label)})


def label_outliers(df: DataFrame, label: str, opportunities: str, count: str, keys: Sequence[str], k: int = 25) -> DataFrame:
    """The k rows whose label misses the count most."""
    error = F.abs(F.col(label) * F.col(opportunities) - nz(count, 0.0))
    shaped = df.where(nz(opportunities, 0.0) > 0).select(*keys, error.alias("abs_error"))
    return shaped.orderBy(F.desc("abs_error"), *keys).limit(k)


def chain_diagnostics(df: DataFrame, columns: Sequence[str], gates: Sequence[str] = ()) -> DataFrame:
    """Per chain column: non-null share, mean, p10, p50, p90; for gates the pass rate as mean."""
    long = melt(df, [*columns, *gates])
    stats = long.groupBy("column").agg(F.count("value").alias("non_null"), F.avg("value").alias("mean"))
    stats = join_on(stats, quantiles(long, ["column"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "column")
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.withColumn("non_null_share", F.col("non_null") / rows)


def weekly_monitor(df: DataFrame, keys: Sequence[str], score: str, label: str, source: str | None = None, width: str | None = None) -> DataFrame:
    """Weekly AUC, average precision, Brier, positive rate, fallback rate, mean interval width."""
    extra: dict[str, Column] = {}
    if source:
        extra["fallback_rate"] = F.avg(flag(F.col(source) == "heuristic"))
    if width:
        extra["mean_interval_width"] = F.avg(width)
    return probability_metrics(df, score, label, list(keys), extra)


# --- bucket scans ------------------------------------------------------------------------------------


def hit_rate_by_flag(df: DataFrame, flags: Sequence[str], target: str) -> DataFrame:
    """Target rate per flag value; one pass over unpivoted flags."""
    entries = [F.struct(F.lit(c).alias("flag"), F.col(c).cast("int").alias("value")) for c in flags]
    long = df.select(F.col(target).cast("double").alias("_y"), F.explode(F.array(*entries)).alias("_e")).select("_y", "_e.*")
    return long.where(F.col("value").isNotNull()).groupBy("flag", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("hit_rate"))


def hit_rate_by_bucket(df: DataFrame, feature: str, target: str, bins: int = 4) -> DataFrame:
    """Target rate per equal-mass bucket of a feature."""
    binned = quantile_bucket(df, feature, bins, "bucket").where(F.col("bucket").isNotNull())
    return binned.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("hit_rate"), F.min(feature).alias("low"), F.max(feature).alias("high")
    )


def add_expressions(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """User columns from SQL expressions."""
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def bucket_columns(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), bins: int = 5, keep: int = 20, limit: int = 30) -> DataFrame:
    """``<c>_q<bins>`` buckets of numbers; rare levels of wide categories become OTHER."""
    out = df
    for c in numeric:
        out = quantile_bucket(out, c, bins, f"{c}_q{bins}")
    for c in categorical:
        levels = top_values(out, c, limit + 1).collect()
        if len(levels) > limit:
            common = [r["value"] for r in levels[:keep]]
            out = out.withColumn(f"{c}_cat", F.when(F.col(c).isin(common), F.col(c)).otherwise("OTHER"))
        else:
            out = out.withColumn(f"{c}_cat", F.col(c))
    return out


def bucket_scan(df: DataFrame, buckets: Sequence[str], error: str, score: str, label: str, level: int = 1, min_count: int = 50, top: int = 200) -> DataFrame:
    """Error rate, mean score, observed rate and bias per bucket combination; the worst ``top``.

    All combinations of ``level`` columns share one grouping-sets aggregation, and the report is
    a distributed top-k.
    """
    names = [str(b) for b in buckets]
    shaped = df.select(*[F.col(b).cast("string").alias(b) for b in names], F.col(error).cast("double").alias("_e"), F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"))
    # Sum to the finest combination first, so that grouping sets expand the small table.
    base = shaped.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.sum("_e").alias("_e"), F.sum("_s").alias("_s"), F.sum("_y").alias("_y"))
    sets = [[F.col(c) for c in combo] for combo in combinations(names, level)]
    grouped = base.groupingSets(sets, *[F.col(c) for c in names]).agg(
        F.grouping_id().alias("_g"), F.sum("_n").alias("count"), F.sum("_e").alias("_e"), F.sum("_s").alias("_s"), F.sum("_y").alias("_y")
    )
    width = len(names)
    used = [((F.col("_g").cast("bigint").bitwiseAND(F.lit(1 << (width - 1 - i)))) == 0) for i in range(width)]
    feature = F.array_join(F.array_compact(F.array(*[F.when(u, F.lit(n)) for u, n in zip(used, names, strict=True)])), "+")
    bucket = F.array_join(F.array_compact(F.array(*[F.when(u, nz(F.col(n), "NULL")) for u, n in zip(used, names, strict=True)])), "|")
    present = F.lit(True)
    for u, n in zip(used, names, strict=True):
        present = present & (~u | F.col(n).isNotNull())
    report = grouped.where(present & (F.col("count") >= min_count)).select(
        feature.alias("feature"), bucket.alias("bucket"), "count", (F.col("_e") / F.col("count")).alias("error_rate"),
        (F.col("_s") / F.col("count")).alias("avg_prob"), (F.col("_y") / F.col("count")).alias("actual_rate"),
    )
    report = report.withColumn("bias", F.col("avg_prob") - F.col("actual_rate"))
    return report.orderBy(F.desc("error_rate"), "feature", "bucket").limit(top)


def history_bias(df: DataFrame, volume: str, error: str, edges: Sequence[float], entity: str | None = None, log10: bool = False) -> DataFrame:
    """Error rate by history volume; per entity first, so that busy entities do not dominate."""
    shaped = df.select(*( [entity] if entity else []), nz(volume, 0.0).alias("_v"), F.col(error).cast("double").alias("_e"))
    if entity:
        shaped = shaped.groupBy(entity).agg(F.max("_v").alias("_v"), F.avg("_e").alias("_e"))
    v = F.col("_v")
    if log10:
        bucket = F.greatest(F.floor(F.log10(F.when(v == 0, 1.0).otherwise(v))), F.lit(0)).cast("int")
    else:
        bucket = F.lit(None).cast("int")
        for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            bucket = F.when((v >= low) & (v < high), i).otherwise(bucket)
    return shaped.groupBy(bucket.alias("bucket")).agg(F.avg("_e").alias("error_rate"), F.count("_e").alias("n")).where("bucket is not null")


# --- associations ------------------------------------------------------------------------------------


def ks_distance(df: DataFrame, value: str, label: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance with its asymptotic p-value."""
    ranked = value_ranks(df.where(F.col(label).isNotNull()), [], value, {"_pos": flag(F.col(label) == 1)})
    based = ranked.withColumns({"_p": F.col("_pos_total"), "_n": F.col("_total") - F.col("_pos_total")})
    up_pos, up_all = F.col("_pos_before") + F.col("_pos"), F.col("_before") + F.col("_c")
    gap = F.abs(up_pos / F.col("_p") - (up_all - up_pos) / F.col("_n"))
    out = based.agg(F.max(gap).alias("ks"), F.max("_p").alias("n_pos"), F.max("_n").alias("n_neg"))
    m = F.sqrt(F.col("n_pos") * F.col("n_neg") / (F.col("n_pos") + F.col("n_neg")))
    lam = m * F.col("ks")
    series = sum(((2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    return out.withColumn("p_value", F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))))


#: Degrees of freedom up to which the tail is a finite series; beyond, the cube root of ``x / dof`` is normal to 1e-6.
SERIES_DOF = 1000


def chi_square_tail(x: Column, degrees: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom, in memory that does not grow with them."""
    dof = F.least(degrees, F.lit(SERIES_DOF))
    spread = 2.0 / (9.0 * degrees)
    z = (F.cbrt(x / degrees) - (1.0 - spread)) / F.sqrt(spread)
    wide = 0.5 * (1.0 - erf(z / 2.0**0.5))
    h = x / 2
    even = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(dof / 2).cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * h / i).alias("t"), (acc["s"] + F.when(dof >= 4, acc["t"] * h / i).otherwise(0.0)).alias("s")),
    )["s"] * F.exp(-h)
    first = F.sqrt(h) / (3.141592653589793**0.5 / 2)
    odd_sum = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.floor((dof - 1) / 2).cast("int"), F.lit(2))), F.struct(first.alias("t"), first.alias("s")),
        lambda acc, i: F.struct((acc["t"] * h / (i - 0.5)).alias("t"), (acc["s"] + F.when(dof >= 5, acc["t"] * h / (i - 0.5)).otherwise(0.0)).alias("s")),
    )["s"]
    odd = 1.0 - erf(F.sqrt(h)) + F.when(dof >= 3, odd_sum * F.exp(-h)).otherwise(0.0)
    tail = F.when(degrees > SERIES_DOF, wide).when(dof % 2 == 0, even).otherwise(odd)
    return F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0))


def crosstab_statistics(df: DataFrame, a: str, b: str, min_rows: int = 0, corrected: bool = False) -> DataFrame:
    """Chi-square, degrees of freedom, p-value and bias-corrected Cramér's V of two categories.

    ``n (Σ o² / (row · column) - 1)`` covers empty cells without forming them. ``corrected`` moves the
    cells of a 2x2 table half a row (at most their deviation) towards independence: all four
    deviate by the same ``sqrt(chi² / Σ 1/expected)``, and ``Σ 1/expected`` is ``n³ / Π margins``.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    cells = attach_totals(cells, "_a", {"_row": F.sum("_o")}).where(F.col("_row") >= min_rows)
    cells = attach_totals(cells, "_b", {"_col": F.sum("_o")})
    sums = cells.agg(
        F.sum("_o").alias("n"), F.sum(F.col("_o") * F.col("_o") / (F.col("_row") * F.col("_col"))).alias("_q"),
        F.countDistinct("_a").alias("r"), F.countDistinct("_b").alias("k"),
        F.min("_row").alias("_r1"), F.max("_row").alias("_r2"), F.min("_col").alias("_c1"), F.max("_col").alias("_c2"),
    )
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    chi2 = F.greatest(n * (F.col("_q") - 1), F.lit(0.0))
    if corrected:
        inverse = n * n * n / (F.col("_r1") * F.col("_r2") * F.col("_c1") * F.col("_c2"))
        deviation = F.sqrt(chi2 / inverse)
        moved = deviation - F.least(F.lit(0.5), deviation)
        chi2 = F.when((r == 2) & (k == 2), moved * moved * inverse).otherwise(chi2)
    phi = F.greatest(chi2 / n - (k - 1) * (r - 1) / (n - 1), F.lit(0.0))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    out = sums.withColumns({"chi2": chi2, "dof": ((r - 1) * (k - 1)).cast("int")})
    return out.withColumns(
        {
            "cramers_v": F.sqrt(phi / F.greatest((rc - 1) * (kc - 1), F.lit(1e-12))),
            "p_value": F.when(F.col("dof") > 0, chi_square_tail(F.col("chi2"), F.col("dof"))),
            "score": F.col("chi2") / F.greatest(F.col("dof"), F.lit(1)),
        }
    ).drop("_q", "_r1", "_r2", "_c1", "_c2")


def screen_separators(df: DataFrame, label: str, columns: Sequence[str], alpha: float = 0.001, d_min: float = 0.1, min_rows: int = 30, min_n: int = 50, wide: int = 30) -> DataFrame:
    """Which columns separate the label: KS for wide numbers, chi-square for the others."""
    numbers = set(_names(df, T.NumericType))
    counts = {c: df.select(c).where(F.col(c).isNotNull()).distinct().limit(wide + 1).count() for c in columns if c in numbers}
    report = None
    for c in columns:
        if c in numbers and counts[c] > wide:
            row = ks_distance(df, c, label).where((F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n) & (F.col("ks") > d_min))
            row = row.select(F.lit(c).alias("column"), F.lit("ks").alias("test"), F.col("ks").alias("statistic"), "p_value")
        else:
            row = crosstab_statistics(df, c, label, min_rows, corrected=True).where(F.col("r") > 1)
            row = row.select(F.lit(c).alias("column"), F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value")
        report = row if report is None else report.unionByName(row)
    return report.where(F.col("p_value") < alpha)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties, from one row per distinct pair."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    for side in ("_x", "_y"):
        ranks = value_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x if side == "_x" else y).cast("double").alias(side)), [], side)
        ranks = ranks.select(side, (F.col("_before") + (F.col("_c") + 1) / 2).alias(f"r{side}"))
        pairs = join_on(pairs, ranks, side, "inner")
    w, a, b = F.col("_w"), F.col("r_x"), F.col("r_y")
    s = pairs.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab")
    )
    cov = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    spread = F.sqrt((F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b")))
    return s.select(F.when(spread > 0, cov / spread).alias("rho"), F.col("n"))


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """VIF per column: ``1 / (1 - R²)`` of the column on the others, infinite if they determine it.

    One aggregate gives the k by k correlations (nulls count as the column mean); k is the number
    of columns, so only a small matrix reaches the driver.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    filled = df.select(*[nz(F.col(c).cast("double"), means[c] or 0.0).alias(c) for c in columns])
    pairs = list(combinations(range(len(columns)), 2))
    row = filled.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    matrix = np.eye(len(columns))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"] or 0.0
    out = {}
    for i, c in enumerate(columns):
        others = [j for j in range(len(columns)) if j != i]
        explained = float(matrix[i, others] @ np.linalg.pinv(matrix[np.ix_(others, others)]) @ matrix[others, i])
        out[c] = 1.0 / (1.0 - explained) if explained < 1 - 1e-12 else float("inf")
    return out


def univariate_scores(df: DataFrame, label: str, residual: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """|correlation| with the residual for numbers, chi-square per degree of freedom for categories."""
    wide = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(residual))).alias(c) for c in numeric])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in numeric])
    out = wide.select(F.explode(entries).alias("_e")).select("_e.*")
    for c in categorical:
        out = out.unionByName(crosstab_statistics(df, c, label).select(F.lit(c).alias("feature"), "score"))
    return out
