"""Probability calibration, split conformal intervals and per-fold models on Spark ML.

Every calibrator learns from one row per (distinct score, label) with a weight, never from raw
rows, so fitting moves a pre-aggregated table only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import as_list, attach_totals, clip, flag, join_on, nz
from ..operators.quantiles import quantiles, value_ranks
from ..session import cut_lineage
from .scores import ece, equal_width_bin, select_threshold

Apply = Callable[[DataFrame, str, str], DataFrame]
EPS = 1e-6


def _weighted(df: DataFrame, score: str, label: str) -> DataFrame:
    p = clip(F.col(score).cast("double"), EPS, 1 - EPS)
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(p.alias("_p"), F.col(label).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).cast("double").alias("_w")
    )


def histogram_rates(df: DataFrame, score: str, label: str, bins: int = 20) -> DataFrame:
    """Smoothed rate ``(positives + 1) / (n + 2)`` per equal-width bin that holds rows."""
    p = clip(F.col(score).cast("double"), EPS, 1 - EPS)
    return df.groupBy(equal_width_bin(p, bins).alias("bin")).agg(
        ((F.sum(F.col(label).cast("double")) + 1) / (F.count(label) + 2)).alias("rate"), F.count(label).alias("n")
    )


def fit_histogram(df: DataFrame, score: str, label: str, bins: int = 20) -> Apply:
    """Rates become a fixed array of ``bins`` numbers; empty bins give 0.5."""
    found = {r["bin"]: r["rate"] for r in histogram_rates(df, score, label, bins).collect()}
    rates = F.array(*[F.lit(float(found.get(i, 0.5))) for i in range(bins)])

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        number = equal_width_bin(clip(F.col(source).cast("double"), EPS, 1 - EPS), bins)
        return frame.withColumn(out, F.get(rates, number))

    return apply


#: Most Newton steps of a logistic fit, and the change of a weight at which it has settled.
STEPS, SETTLED = 25, 1e-10


def logistic_weights(table: DataFrame, features: Mapping[str, Callable[[Column], Column]]) -> tuple[float, list[float]]:
    """Intercept and weights by re-weighted least squares from sufficient statistics.

    Rows ``_p, _y, _w`` are summed per exact score once; each step is one aggregate of the gradient and of the normal
    equations, a handful of numbers that the driver solves.
    """
    sums = cut_lineage(table.groupBy("_p").agg(F.sum("_w").alias("_n"), F.sum(F.col("_y") * F.col("_w")).alias("_hits")))
    x = [F.lit(1.0), *(f(F.col("_p")) for f in features.values())]
    k, beta = len(x), np.zeros(len(features) + 1)
    for _ in range(STEPS):
        z = sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-z))
        rows = sums.select("_n", "_hits", p.alias("_q"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
        slope, bend = F.col("_hits") - F.col("_n") * F.col("_q"), F.col("_n") * F.col("_q") * (1 - F.col("_q"))
        aggs = [F.sum(slope * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum(bend * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rows.agg(*aggs).first()
        if row["g0"] is None:
            break
        bends = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.lstsq(bends + 1e-12 * np.eye(k), np.array([row[f"g{i}"] for i in range(k)]), rcond=None)[0]
        beta = beta + np.clip(step, -8.0, 8.0)
        if np.abs(step).max() < SETTLED:
            break
    return float(beta[0]), [float(b) for b in beta[1:]]


def _logistic(df: DataFrame, score: str, label: str, features: Mapping[str, Callable[[Column], Column]]) -> Apply:
    intercept, weights = logistic_weights(_weighted(df, score, label), features)

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        p = clip(F.col(source).cast("double"), EPS, 1 - EPS)
        z = sum((w * f(p) for w, f in zip(weights, features.values(), strict=True)), F.lit(intercept))
        return frame.withColumn(out, 1.0 / (1.0 + F.exp(-z)))

    return apply


def fit_platt(df: DataFrame, score: str, label: str) -> Apply:
    """Logistic regression on the log-odds of the score."""
    return _logistic(df, score, label, {"_logit": lambda p: F.log(p / (1 - p))})


def fit_beta(df: DataFrame, score: str, label: str) -> Apply:
    """Logistic regression on ``log p`` and ``log(1 - p)``."""
    return _logistic(df, score, label, {"_lp": lambda p: F.log(p), "_lq": lambda p: F.log(1 - p)})


def fit_isotonic(df: DataFrame, score: str, label: str) -> Apply:
    """Isotonic regression on one weighted mean per exact score; linear between the knots.

    The fit pools violators inside score ranges first, one task each, and its last step sees only
    the pooled blocks.
    """
    table = _weighted(df, score, label).groupBy("_p").agg(
        (F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("_y"), F.sum("_w").alias("_w")
    )
    model = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w").fit(table)

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        shaped = frame.withColumn("_p", clip(F.col(source).cast("double"), EPS, 1 - EPS))
        return model.setPredictionCol(out).transform(shaped).drop("_p")

    return apply


def fit_raw(df: DataFrame, score: str, label: str) -> Apply:
    return lambda frame, source, out: frame.withColumn(out, F.col(source))


FITTERS = {"sigmoid": fit_platt, "isotonic": fit_isotonic, "beta": fit_beta, "hist": fit_histogram, "raw": fit_raw}


def out_of_fold(df: DataFrame, folds: DataFrame, group: str, score: str, label: str, method: str, out: str = "oof") -> DataFrame:
    """Calibrated score of each test row by the fold's own calibrator; the raw score elsewhere."""
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    parts, tested = [], folds.where("role = 'test'").select(group).distinct()
    for number in numbers:
        table = folds.where(F.col("fold") == number)
        train = join_on(df, table.where("role = 'train'").select(group), group, "inner")
        test = join_on(df, table.where("role = 'test'").select(group), group, "inner")
        parts.append(FITTERS[method](train, score, label)(test, score, out))
    rest = df.join(tested, group, "left_anti").withColumn(out, F.col(score))
    for part in parts:
        rest = rest.unionByName(part.select(*rest.columns))
    return rest


def choose_calibrator(df: DataFrame, folds: DataFrame, group: str, score: str, label: str, methods: Sequence[str] = ("sigmoid", "isotonic", "beta", "hist", "raw")) -> tuple[str, float, float, Apply]:
    """(method, its out-of-fold equal-mass ECE, threshold, calibrator fitted on all rows)."""
    best = None
    for method in methods:
        # The score table is ranked, bucketed and searched for a threshold: keep it once.
        oof = cut_lineage(out_of_fold(df, folds, group, score, label, method).select("oof", label))
        error = ece(oof, "oof", label, 10, mass=True).first()["ece"]
        if best is None or error < best[1]:
            best = (method, error, oof)
    method, error, oof = best
    threshold = select_threshold(oof, "oof", label, "f1").first()["threshold"]
    return method, error, threshold, FITTERS[method](df, score, label)


def fit_mean_calibration(df: DataFrame, pred: str, actual: str) -> Apply:
    """Linear mean correction of a regression score."""
    row = df.agg(F.regr_slope(actual, pred).alias("a"), F.regr_intercept(actual, pred).alias("b")).first()
    slope = 1.0 if row["a"] is None else row["a"]
    shift = 0.0 if row["b"] is None else row["b"]
    return lambda frame, source, out: frame.withColumn(out, slope * F.col(source) + shift)


# --- conformal intervals --------------------------------------------------------------------------


def conformal_quantile(df: DataFrame, residual: str, alpha: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """The ``ceil((n + 1)(1 - alpha))``-th smallest residual, capped at the largest."""
    keys = as_list(keys)
    ranked = value_ranks(df, keys, residual)
    rank = F.least(F.ceil((F.col("_total") + 1) * (1 - alpha) - 1e-9), F.col("_total")) - 1
    hit = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    return grouped.agg(F.max(F.when(hit, F.col(residual))).alias("q"), F.max("_total").alias("n"))


def conformal_intervals(calibration: DataFrame, target: DataFrame, pred: str, actual: str, alpha: float = 0.1, clip_lower: float | None = None) -> DataFrame:
    """``lower`` and ``upper`` around the prediction of each target row."""
    residuals = calibration.select(F.abs(F.col(actual) - F.col(pred)).alias("_r"))
    q = conformal_quantile(residuals, "_r", alpha).select("q").scalar()
    out = target.withColumn("q", q)
    low = F.col(pred) - F.col("q")
    low = F.greatest(low, F.lit(clip_lower)) if clip_lower is not None else low
    return out.withColumns({"lower": low, "upper": F.col(pred) + F.col("q")})


def interval_report(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage, mean and median width, and point errors."""
    y, p = F.col(actual), F.col(pred)
    shaped = df.withColumn("_width", F.col("upper") - F.col("lower"))
    grouped = shaped.groupBy(*keys) if keys else shaped.groupBy()
    stats = grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag((y >= F.col("lower")) & (y <= F.col("upper")))).alias("coverage"),
        F.avg("_width").alias("width_mean"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.avg(F.abs(p - y)).alias("mae"), F.avg(p - y).alias("bias"),
    )
    middle = quantiles(shaped, list(keys), "_width", {"width_median": 0.5})
    return join_on(stats, middle, list(keys)) if keys else stats.withColumn("width_median", middle.scalar())


def sum_components(parts: Sequence[DataFrame], key: str | Sequence[str], pred: str, actual: str) -> DataFrame:
    """Rows present in every component, with summed predictions and outcomes.

    Unions and counts instead of a chain of joins: one shuffle whatever the number of components.
    """
    keys = as_list(key)
    tagged = None
    for i, part in enumerate(parts):
        slim = part.select(*keys, F.col(pred).alias("_p"), F.col(actual).alias("_y"), F.lit(i).alias("_i"))
        tagged = slim if tagged is None else tagged.unionByName(slim)
    summed = tagged.groupBy(*keys).agg(F.sum("_p").alias(pred), F.sum("_y").alias(actual), F.countDistinct("_i").alias("_n"))
    return summed.where(F.col("_n") == len(parts)).drop("_n")


def conformal_sum(parts: Sequence[DataFrame], key: str | Sequence[str], pred: str, actual: str, alpha: float = 0.1, group: Sequence[str] = ()) -> DataFrame:
    """Interval report of summed components, optionally summed again per group (team sums)."""
    total = sum_components(parts, key, pred, actual)
    if group:
        total = total.groupBy(*group).agg(F.sum(pred).alias(pred), F.sum(actual).alias(actual))
    return interval_report(conformal_intervals(total, total, pred, actual, alpha, 0.0), actual, pred)


# --- models ----------------------------------------------------------------------------------------


def fit_model(df: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", task: str = "binary", weight: str | None = None, seed: int = 42, **params):
    """A Spark ML chain of assembler and learner; missing features count as 0."""
    learners = {
        ("gbt", "binary"): GBTClassifier, ("linear", "binary"): LogisticRegression,
        ("gbt", "regression"): GBTRegressor, ("linear", "regression"): LinearRegression,
    }
    options = {"featuresCol": "_features", "labelCol": "_label", **params}
    if kind == "gbt":
        options |= {"seed": seed, "maxIter": params.get("maxIter", 20)}
    if weight:
        options["weightCol"] = weight
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    shaped = df.where(F.col(label).isNotNull()).withColumns({f: nz(F.col(f).cast("double"), 0.0) for f in features} | {"_label": F.col(label).cast("double")})
    return Pipeline(stages=[assembler, learners[(kind, task)](**options)]).fit(shaped)


def score_model(model, df: DataFrame, features: Sequence[str], out: str, task: str = "binary") -> DataFrame:
    original = df.columns
    kept = df.select("*", *[F.col(f).alias(f"_keep_{f}") for f in features]).withColumns({f: nz(F.col(f).cast("double"), 0.0) for f in features})
    scored = model.transform(kept)
    value = vector_to_array("probability")[1] if task == "binary" else F.col("prediction")
    return scored.select(*[F.col(f"_keep_{c}").alias(c) if c in features else F.col(c) for c in original], value.alias(out))


def cross_fit(df: DataFrame, folds: DataFrame, group: str, features: Sequence[str], label: str, out: str = "oof", kind: str = "linear", task: str = "binary", weight: str | None = None) -> DataFrame:
    """Out-of-fold scores of the test rows of every fold; one model per fold, fitted distributed."""
    parts = None
    for number in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        table = folds.where(F.col("fold") == number)
        train = join_on(df, table.where("role = 'train'").select(group), group, "inner")
        test = join_on(df, table.where("role = 'test'").select(group), group, "inner")
        model = fit_model(train, features, label, kind, task, weight)
        part = score_model(model, test, features, out, task).withColumn("fold", F.lit(number))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fit_experts(df: DataFrame, segment: str, segments: Sequence[str], features: Sequence[str], label: str, min_rows: int = 100, fallback: str | None = None, cap: Callable[[Column], Column] | None = None, kind: str = "linear", task: str = "regression") -> Apply:
    """One model per segment; rows of unknown or thin segments use the fallback segment's model.

    ``cap`` is a Column-to-Column hook applied to every score.
    """
    counts = {r[segment]: r["count"] for r in df.where(F.col(segment).isin(list(segments))).groupBy(segment).count().collect()}
    models = {s: fit_model(df.where(F.col(segment) == s), features, label, kind, task) for s in segments if counts.get(s, 0) >= min_rows}
    if not models:
        raise ValueError("no segment has enough rows")
    default = fallback if fallback in models else next(iter(models))

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        routed = frame.withColumn("_route", F.when(F.col(source).isin(list(models)), F.col(source)).otherwise(default))
        scored = None
        for name, model in models.items():
            part = score_model(model, routed.where(F.col("_route") == name), features, out, task)
            scored = part if scored is None else scored.unionByName(part)
        value = cap(F.col(out)) if cap else F.col(out)
        return scored.withColumn(out, value).drop("_route")

    return apply


def with_upstream(df: DataFrame, predictions: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join prediction frames of earlier problems by key."""
    for frame in predictions:
        fresh = [c for c in frame.columns if c in keys or c not in df.columns]
        df = join_on(df, frame.select(*fresh), list(keys))
    return df


def reconcile_counts(df: DataFrame, keys: Sequence[str], expected: str, allotted: str) -> DataFrame:
    """Expected group totals next to what the rows of the group were given."""
    out = attach_totals(df, list(keys), {"group_allotted": F.sum(allotted), "group_expected": F.max(expected)})
    return out.withColumn("group_gap", F.col("group_allotted") - F.col("group_expected"))


def conformal_rank(n: int, alpha: float) -> int:
    return min(n, math.ceil((n + 1) * (1 - alpha)))
