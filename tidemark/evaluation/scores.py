"""Evaluation of score columns.

Rank-based measures work on one row per distinct score (counts and positives), ranked by exclusive
prefix sums; no window over raw rows and no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import as_list, clip, flag, join_on, nz, ratio
from ..operators.quantiles import quantile_bucket, quantiles, value_ranks

MACHINE_EPS = 2.220446049250313e-16


def score_ranks(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with ``n``, ``pos``, what lies below them, and group totals."""
    keys = as_list(keys)
    labelled = df.where(F.col(label).isNotNull()).select(*keys, score, F.col(label).cast("double").alias("_y"))
    return value_ranks(labelled, keys, score, {"_pos": F.col("_y")}).withColumnRenamed("_pos_total", "_positives")


def _group(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def ranking_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact AUC (ties count half) and average precision."""
    keys = as_list(keys)
    ranked = score_ranks(df, score, label, keys)
    negatives = F.col("_total") - F.col("_positives")
    neg, neg_below = F.col("_c") - F.col("_pos"), F.col("_before") - F.col("_pos_before")
    above_or_equal = F.col("_total") - F.col("_before")
    precision = (F.col("_positives") - F.col("_pos_before")) / above_or_equal
    out = _group(ranked, keys).agg(
        F.sum(F.col("_pos") * (neg_below + neg / 2)).alias("_wins"),
        F.sum(F.col("_pos") * precision).alias("_ap"),
        F.max("_positives").alias("_p"),
        F.max(negatives).alias("_n"),
    )
    return out.select(
        *keys,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_wins") / (F.col("_p") * F.col("_n"))).alias("auc"),
        F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("average_precision"),
    )


def probability_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Count, positive rate, Brier, log-loss (clipped at machine epsilon) and AUC."""
    keys = as_list(keys)
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    q = clip(p, MACHINE_EPS, 1 - MACHINE_EPS)
    usable = df.where(p.isNotNull() & y.isNotNull())
    plain = _group(usable, keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("positive_rate"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    ranks = ranking_metrics(usable, score, label, keys)
    if keys:
        return join_on(plain, ranks, keys)
    return plain.withColumns({c: ranks.select(c).scalar() for c in ("auc", "average_precision")})


# --- calibration ---------------------------------------------------------------------------------


def equal_width_bin(p: Column, bins: int) -> Column:
    """Left-closed bins on [0, 1]; 1.0 falls into the last."""
    return F.greatest(F.least(F.floor(p * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def reliability(df: DataFrame, score: str, label: str, bin_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per bin: rows, positives, mean score, observed rate."""
    return df.groupBy(*as_list(keys), bin_column).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("double")).alias("positives"),
        F.avg(F.col(score).cast("double")).alias("mean_pred"),
        F.avg(F.col(label).cast("double")).alias("emp_rate"),
    )


def ece(df: DataFrame, score: str, label: str, bins: int = 15, keys: Sequence[str] = (), mass: bool = False) -> DataFrame:
    """Expected and maximum calibration error with equal-width or equal-mass bins.

    Equal-mass edges run from 0 to 1, so rows tied at the lowest score are a bin of their own.
    """
    keys = as_list(keys)
    if mass:
        binned = quantile_bucket(df, score, bins, "_bin", outer=(0.0, 1.0))
    else:
        binned = df.withColumn("_bin", equal_width_bin(F.col(score), bins))
    table = reliability(binned, score, label, "_bin", keys)
    gap = F.abs(F.col("mean_pred") - F.col("emp_rate"))
    return _group(table, keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p = successes / n
    z2 = z * z
    center = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return center - half, center + half


def calibration_table(df: DataFrame, score: str, label: str, bins: int = 10, min_bin: int = 50) -> DataFrame:
    """Equal-mass bins of at least ``max(10, n / (4 bins), min_bin)`` rows with Wilson intervals."""
    table = reliability(quantile_bucket(df, score, bins, "bin"), score, label, "bin")
    total = df.where(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(10), F.floor(total.scalar() / (bins * 4)), F.lit(min_bin))
    low, high = wilson(F.col("positives"), F.col("n"))
    return table.where(F.col("n") >= least).withColumns(
        {"wilson_low": low, "wilson_high": high, "abs_gap": F.abs(F.col("mean_pred") - F.col("emp_rate"))}
    )


def brier_decomposition(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score and its reliability, resolution and uncertainty on equal-mass bins."""
    binned = quantile_bucket(df, score, bins, "_bin")
    err = (F.col(score) - F.col(label)) * (F.col(score) - F.col(label))
    table = binned.groupBy("_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos"),
        F.sum(F.col(score).cast("double")).alias("sp"), F.sum(err.cast("double")).alias("se"),
    )
    # At most ``bins`` rows from here on.
    sums = table.agg(
        F.sum("n").alias("N"), F.sum("pos").alias("P"), F.sum("se").alias("E"),
        F.sum(F.pow(F.col("sp") / F.col("n") - F.col("pos") / F.col("n"), 2) * F.col("n")).alias("rel"),
        F.sum(F.pow(F.col("pos"), 2) / F.col("n")).alias("pp"),
    )
    base = F.col("P") / F.col("N")
    return sums.select(
        (F.col("E") / F.col("N")).alias("brier"),
        (F.col("rel") / F.col("N")).alias("reliability"),
        (F.col("pp") / F.col("N") - base * base).alias("resolution"),
        (base * (1 - base)).alias("uncertainty"),
    )


def confidence_deciles(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Eleven bins by tenths with 1.0 apart: count, accuracy, mean score, observed rate."""
    p, y = F.col(score), F.col(label).cast("double")
    number = F.when(p >= 1.0, 10).otherwise(F.least(F.greatest(F.floor(p * 10), F.lit(0)), F.lit(10))).cast("int")
    hit = flag((p >= threshold).cast("int") == y.cast("int"))
    return df.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(p).alias("avg_confidence"), F.avg(y).alias("actual_positive_rate")
    )


def calibration_summary(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean squared and largest gap between mean score and observed rate over equal-width bins."""
    table = reliability(df.withColumn("_bin", equal_width_bin(F.col(score), bins)), score, label, "_bin")
    gap = F.abs(F.col("mean_pred") - F.col("emp_rate"))
    return table.agg(F.avg(gap * gap).alias("calibration_mse"), F.max(gap).alias("calibration_max"))


# --- regression ----------------------------------------------------------------------------------


def tail_threshold(train: DataFrame, test: DataFrame, actual: str, pred: str, mode: str = "train_quantile", value: float = 0.9, k: float | None = None) -> Column:
    """Cut above which a row is in the tail, as a one-row scalar subquery."""
    if mode in ("train_quantile", "quantile", "pred_quantile"):
        source, column = {"train_quantile": (train, actual), "quantile": (test, actual), "pred_quantile": (test, pred)}[mode]
        return quantiles(source, [], column, {"q": value}).scalar()
    if mode == "iqr":
        edges = quantiles(train, [], actual, {"a": 0.25, "b": 0.75})
        factor = 1.5 if k is None else k
        return edges.select(F.col("b") + factor * (F.col("b") - F.col("a"))).scalar()
    if mode == "mean_sigma":
        factor = 2.0 if k is None else k
        return train.agg(F.avg(actual) + factor * F.stddev_pop(actual)).scalar()
    return F.lit(float(value))


def regression_metrics(
    df: DataFrame, pred: str, actual: str, train: DataFrame | None = None, tail_mode: str = "train_quantile",
    tail_value: float = 0.9, min_support: int = 20, tie_break: Sequence[str] = (),
) -> DataFrame:
    """Errors, explained variance, a mean baseline, tail errors and the top five percent by score."""
    train = train if train is not None else df
    y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    base = df.select(y.alias("y"), p.alias("p"), (p - y).alias("e"), *tie_break).withColumns(
        {
            "_m": train.agg(F.avg(actual)).scalar(),
            "_cut": tail_threshold(train, df, actual, pred, tail_mode, tail_value),
            "ae": F.abs(F.col("e")),
        }
    )
    tail = F.col("y") >= F.col("_cut")
    stats = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg("ae").alias("mae"),
        F.avg("e").alias("bias"),
        (1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop("y") * F.count("y"))).alias("r2"),
        (1 - F.var_pop("e") / F.var_pop("y")).alias("explained_variance"),
        F.sqrt(F.avg(F.pow(F.col("y") - F.col("_m"), 2))).alias("baseline_rmse"),
        F.avg(F.abs(F.col("y") - F.col("_m"))).alias("baseline_mae"),
        F.sum(flag(tail)).alias("outlier_support"),
        F.sqrt(F.avg(F.when(tail, F.col("e") * F.col("e")))).alias("outlier_rmse"),
        F.avg(F.when(tail, F.col("ae"))).alias("outlier_mae"),
        F.max("_cut").alias("outlier_threshold"),
        F.avg("y").alias("_mean_y"),
    )
    enough = F.col("outlier_support") >= min_support
    stats = stats.withColumns({c: F.when(enough, F.col(c)) for c in ("outlier_rmse", "outlier_mae")})
    middle = quantiles(base, [], "ae", {"mdae": 0.5})
    top = top_share(base.withColumn("_tail", flag(tail)), "p", 0.05, {"recall_top5pct": ("_tail", "avg"), "_mean_top": ("y", "avg")})
    return stats.withColumns(
        {
            "mdae": middle.scalar(),
            "recall_top5pct": top.select("recall_top5pct").scalar(),
            "lift_top5pct": top.select("_mean_top").scalar() / F.col("_mean_y"),
        }
    ).drop("_mean_y")


def top_share(df: DataFrame, score: str, share: float, means: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Means over the top ``share`` of rows by score (at least one row).

    Ties at the cut share the remaining places evenly, so the result does not depend on row order.
    """
    sums = {f"_s_{out}": F.col(column).cast("double") for out, (column, _) in means.items()}
    ranked = value_ranks(df, [], score, sums)
    wanted = F.greatest(F.lit(1), F.floor(F.col("_total") * share))
    above = F.col("_total") - F.col("_before") - F.col("_c")
    taken = F.least(F.col("_c"), F.greatest(wanted - above, F.lit(0)))
    part = taken / F.col("_c")
    return ranked.agg(*[(F.sum(F.col(f"_s_{out}") * part) / F.sum(taken)).alias(out) for out in means])


def decile_errors(df: DataFrame, pred: str, actual: str, bins: int = 10) -> DataFrame:
    binned = quantile_bucket(df, pred, bins, "decile")
    e = F.col(pred) - F.col(actual)
    return binned.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


# --- selective decisions and thresholds ----------------------------------------------------------


def selective_metrics(df: DataFrame, decision: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics on accepted rows; a decision of -1 abstains."""
    d, y = F.col(decision), F.col(label)
    ok = d != -1
    counts = {
        "n_total": F.count(F.lit(1)), "n_accepted": F.sum(flag(ok)), "_right": F.sum(flag(ok & (d == y))),
        "_tp": F.sum(flag((d == 1) & (y == 1))), "_fp": F.sum(flag((d == 1) & (y != 1))), "_fn": F.sum(flag((d == 0) & (y == 1))),
    }
    out = _group(df, as_list(keys)).agg(*[c.alias(n) for n, c in counts.items()])
    some = F.col("n_accepted") > 0
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    precision, recall = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return out.withColumns(
        {
            "coverage": F.col("n_accepted") / F.col("n_total"),
            "accuracy_sel": F.when(some, F.col("_right") / F.col("n_accepted")),
            "precision_sel": F.when(some, precision),
            "recall_sel": F.when(some, recall),
            "f1_sel": F.when(some, ratio(2 * tp, 2 * tp + fp + fn, 0.0)),
        }
    ).drop("_right", "_tp", "_fp", "_fn")


def risk_coverage(df: DataFrame, label: str, positive: str, negative: str, abstain: str, steps: int = 20) -> DataFrame:
    """Risk and coverage at evenly spaced limits of the abstain score.

    Each row falls into the first step that accepts it; running sums over the steps do the sweep.
    """
    span = df.agg(F.min(abstain).alias("lo"), F.max(abstain).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    based = df.withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / (steps - 1)
    place = F.when(width > 0, F.least(F.ceil((F.col(abstain) - F.col("_lo")) / width - 1e-12), F.lit(steps - 1))).otherwise(0)
    right = flag((F.col(positive) > F.col(negative)).cast("int") == F.col(label))
    counts = based.groupBy(F.greatest(place, F.lit(0)).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("_n"), F.sum(right).alias("_r"))
    # One row per step, a fixed number of them.
    grid = span.select(F.col("lo"), F.col("hi"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    filled = grid.join(counts, "step", "left").withColumns({"_n": nz("_n"), "_r": nz("_r")})
    through = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = filled.withColumns({"_cn": F.sum("_n").over(through), "_cr": F.sum("_r").over(through), "_all": F.sum("_n").over(whole)})
    return swept.select(
        "step",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (steps - 1)).alias("threshold"),
        (F.col("_cn") / F.col("_all")).alias("coverage"),
        F.when(F.col("_cn") > 0, 1 - F.col("_cr") / F.col("_cn")).otherwise(1.0).alias("risk"),
    )


def threshold_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score used as "score >= threshold": rates, precision, recall, F1, accuracy."""
    ranked = score_ranks(df, score, label)
    tp = F.col("_positives") - F.col("_pos_before")
    chosen = F.col("_total") - F.col("_before")
    fp, negatives = chosen - tp, F.col("_total") - F.col("_positives")
    precision, recall = tp / chosen, F.when(F.col("_positives") > 0, tp / F.col("_positives"))
    return ranked.select(
        F.col(score).alias("threshold"),
        F.when(negatives > 0, fp / negatives).alias("fpr"),
        recall.alias("tpr"),
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / (precision + recall + 1e-16)).alias("f1"),
        ((tp + negatives - fp) / F.col("_total")).alias("accuracy"),
    )


def select_threshold(df: DataFrame, score: str, label: str, method: str = "f1", target: float | None = None, max_fpr: float = 0.1) -> DataFrame:
    """One row with the chosen threshold.

    ``roc``: lowest threshold within the false-positive limit. ``precision``, ``recall``, ``f1``:
    best value (lowest threshold on ties), or the highest threshold reaching ``target``.
    ``accuracy``: best value, lowest threshold on ties.
    """
    table = threshold_table(df, score, label)
    t = F.col("threshold")
    if method == "roc":
        within = F.min(F.when(F.col("fpr") <= max_fpr, t))
        return table.agg(F.coalesce(within, F.max_by(t, F.struct(F.col("tpr"), t))).alias("threshold"))
    metric = F.col({"prc": "f1"}.get(method, method))
    best = F.max_by(t, F.struct(metric, -t))
    if target is not None:
        return table.agg(F.coalesce(F.max(F.when(metric >= target, t)), best).alias("threshold"))
    return table.agg(best.alias("threshold"))


# --- over time and over segments -----------------------------------------------------------------


def walk_forward(df: DataFrame, day: str, score: str, label: str, window_days: int = 30, bins: int = 10) -> DataFrame:
    """Per day: expected, observed, cumulative difference, Brier, log-loss, AUC, trailing ECE.

    After the first aggregation every table has one row per (day, bin), bounded by the calendar.
    """
    daily = probability_metrics(df, score, label, [day], {"expected": F.sum(score), "observed": F.sum(F.col(label).cast("double"))})
    through = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("cumulative_gap", F.sum(F.col("observed") - F.col("expected")).over(through))
    binned = df.withColumn("_bin", equal_width_bin(F.col(score), bins)).groupBy(day, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(score).cast("double")).alias("_p"), F.sum(F.col(label).cast("double")).alias("_y")
    )
    # Each day also counts for the following days of its trailing window.
    reach = binned.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(window_days - 1)))).withColumn(day, F.date_add(day, F.col("_at")))
    trailing = reach.groupBy(day, "_bin").agg(F.sum("_n").alias("n"), F.sum("_p").alias("p"), F.sum("_y").alias("y"))
    error = trailing.groupBy(day).agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("trailing_ece"))
    return join_on(daily, error, day)


def segment_metrics(df: DataFrame, actual: str, preds: Mapping[str, str], segment: str, binary: bool = False) -> DataFrame:
    """Errors of several predictions by segment, one row per (segment, prediction)."""
    options = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("pred")) for n, c in preds.items()])
    long = df.select(segment, F.col(actual).cast("double").alias("_y"), F.explode(options).alias("_m")).select(
        segment, "_y", "_m.model", "_m.pred"
    ).where(F.col("pred").isNotNull())
    e = F.col("pred") - F.col("_y")
    table = long.groupBy(segment, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop("_y") * F.count("_y"))).alias("r2"),
    )
    if binary:
        table = join_on(table, ranking_metrics(long, "pred", "_y", [segment, "model"]), [segment, "model"])
    return table


def expected_vs_actual(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Mean expected, mean actual, bias, MAE and correlation per metric family and segment."""
    aggs = []
    for name, (expected, actual) in pairs.items():
        x, y = F.col(expected).cast("double"), F.col(actual).cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [
            F.avg(F.when(both, x)).alias(f"{name}_expected"), F.avg(F.when(both, y)).alias(f"{name}_actual"),
            F.avg(x - y).alias(f"{name}_bias"), F.avg(F.abs(x - y)).alias(f"{name}_mae"), F.corr(x, y).alias(f"{name}_corr"),
        ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def compare_runs(current: DataFrame, previous: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Change of each metric between two runs; rows of one run only are new or missing."""
    a = current.select(key, *[F.col(m).alias(f"_a_{m}") for m in metrics], F.lit(1).alias("_in_a"))
    b = previous.select(key, *[F.col(m).alias(f"_b_{m}") for m in metrics], F.lit(1).alias("_in_b"))
    both = a.join(b, key, "full")
    status = F.when(F.col("_in_b").isNull(), "new").when(F.col("_in_a").isNull(), "missing").otherwise("common")
    return both.select(key, status.alias("status"), *[(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(f"delta_{m}") for m in metrics])


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column: compared rows, differing rows, largest difference. NULL against a value differs."""
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = join_on(a, b, list(keys), "inner")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        x, y = F.col(f"_a_{c}").cast("double"), F.col(f"_b_{c}").cast("double")
        differs = (x.isNull() != y.isNull()) | nz(F.abs(x - y) > tolerance, False)
        aggs += [F.sum(flag(differs)).alias(f"_d_{c}"), F.max(F.abs(x - y)).alias(f"_m_{c}")]
    wide = both.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_d_{c}").alias("differing"), F.col(f"_m_{c}").alias("max_difference")) for c in columns])
    return wide.select(F.col("_n").alias("compared"), F.explode(entries).alias("_e")).select("compared", "_e.*")
