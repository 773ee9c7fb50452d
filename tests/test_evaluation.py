"""Scores, splits, calibration, conformal intervals and audits against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.evaluation import audits as A
from tidemark.evaluation import calibration as K
from tidemark.evaluation import scores as M
from tidemark.evaluation import splits as X


@pytest.fixture(params=["plain", "sliced"])
def path(request):
    if request.param == "sliced":
        request.getfixturevalue("hot")
    return request.param


def sample(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = round(rng.random(), 2) if i % 3 else 0.5
        out.append((i, p, 1 if rng.random() < p else 0, f"g{i % 6}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 10)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id int, p double, y int, g string, day date")


def brute_auc(data):
    pos = [r[1] for r in data if r[2] == 1]
    neg = [r[1] for r in data if r[2] == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_counts_ties_half(spark, path):
    data = sample()
    got = rows(M.ranking_metrics(frame(spark, data), "p", "y"))[0]
    assert got["auc"] == pytest.approx(brute_auc(data))
    by_group = {r["g"]: r["auc"] for r in rows(M.ranking_metrics(frame(spark, data), "p", "y", ["g"]))}
    for g in by_group:
        assert by_group[g] == pytest.approx(brute_auc([r for r in data if r[3] == g]))


def test_one_class_has_no_auc(spark):
    got = rows(M.probability_metrics(frame(spark, [(1, 0.0, 1, "a", None), (2, 1.0, 1, "a", None)]), "p", "y"))[0]
    assert got["auc"] is None and got["n"] == 2 and math.isfinite(got["log_loss"])


def test_average_precision(spark, path):
    data = sample()
    got = rows(M.ranking_metrics(frame(spark, data), "p", "y"))[0]["average_precision"]
    total = sum(r[2] for r in data)
    expected, seen = 0.0, 0.0
    for t in sorted({r[1] for r in data}, reverse=True):
        picked = [r for r in data if r[1] >= t]
        recall = sum(r[2] for r in picked) / total
        expected += (recall - seen) * sum(r[2] for r in picked) / len(picked)
        seen = recall
    assert got == pytest.approx(expected)


def test_ece_edges(spark):
    data = [(0, 0.0, 0, "", None), (1, 1.0, 1, "", None), (2, 0.2, 1, "", None), (3, 0.19, 0, "", None)]
    got = rows(M.reliability(frame(spark, data).withColumn("b", M.equal_width_bin(F.col("p"), 5)), "p", "y", "b"), "b")
    assert [(r["b"], r["n"]) for r in got] == [(0, 2), (1, 1), (4, 1)]
    assert rows(M.ece(frame(spark, data), "p", "y", 5))[0]["ece"] == pytest.approx((2 * abs(0.095 - 0) + abs(0.2 - 1)) / 4)


@pytest.mark.parametrize("method", ["f1", "accuracy"])
def test_threshold_is_the_best_one(spark, path, method):
    data = sample()
    chosen = rows(M.select_threshold(frame(spark, data), "p", "y", method))[0]["threshold"]

    def value(t):
        tp = sum(1 for r in data if r[1] >= t and r[2] == 1)
        fp = sum(1 for r in data if r[1] >= t and r[2] == 0)
        fn = sum(1 for r in data if r[1] < t and r[2] == 1)
        tn = len(data) - tp - fp - fn
        return 2 * tp / (2 * tp + fp + fn) if method == "f1" else (tp + tn) / len(data)

    assert value(chosen) == pytest.approx(max(value(t) for t in {r[1] for r in data}))


def test_threshold_within_false_positive_limit(spark):
    data = sample()
    chosen = rows(M.select_threshold(frame(spark, data), "p", "y", "roc", max_fpr=0.2))[0]["threshold"]
    negatives = [r[1] for r in data if r[2] == 0]
    fpr = lambda t: sum(v >= t for v in negatives) / len(negatives)
    assert fpr(chosen) <= 0.2 and all(fpr(t) > 0.2 for t in {r[1] for r in data} if t < chosen)


def test_top_share_splits_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.5, 0.0), (0.2, 0.0)], "p double, y double")
    assert rows(M.top_share(df, "p", 0.25, {"hit": ("y", "avg")}))[0]["hit"] == pytest.approx(0.5)


def test_conformal_quantile_and_cap(spark, path):
    values = [float(v) for v in range(1, 101)]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    assert rows(K.conformal_quantile(df, "r", 0.1))[0]["q"] == sorted(values)[math.ceil(101 * 0.9) - 1]
    assert rows(K.conformal_quantile(df, "r", 0.001))[0]["q"] == 100.0


def test_conformal_coverage_and_sums(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, float(i), i + rng.gauss(0, 5)) for i in range(400)], "id int, p double, y double")
    report = rows(K.interval_report(K.conformal_intervals(df, df, "p", "y", 0.2), "y", "p"))[0]
    assert 0.8 <= report["coverage"] <= 0.82
    summed = rows(K.sum_components([df, df.where("id < 100")], "id", "p", "y"), "id")
    assert len(summed) == 100 and summed[3]["p"] == 6.0


def test_fraction_split_keeps_dates_whole(spark):
    data = sample()
    got = rows(X.split_by_fraction(frame(spark, data), "day", 0.5, 0.25))
    per_day = {}
    for r in got:
        per_day.setdefault(r["day"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per_day.values())
    order = [next(iter(per_day[d])) for d in sorted(per_day)]
    assert order == sorted(order, key=["train", "val", "test"].index) and order.count("train") == 15


def test_date_and_production_split(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 4)], "day date")
    got = rows(X.split_by_dates(df, "day", dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)), "day")
    assert [r["split"] for r in got] == ["train", "val", "test", None]
    assert [r["split"] for r in rows(X.split_production(df, "day", dt.date(2024, 1, 2)), "day")] == ["train", "train", None, None]


def test_rolling_weeks_fall_back_to_last_weeks(spark):
    df = spark.createDataFrame([(2023, 1)] + [(2024, w) for w in range(1, 11)], "season int, week int")
    got = {(r["season"], r["week"]): r["split"] for r in rows(X.split_rolling_weeks(df, (15, 16), (17, 18)))}
    assert [got[(2024, w)] for w in (6, 7, 8, 9, 10)] == ["train", "val", "val", "test", "test"] and got[(2023, 1)] == "train"


def test_purged_folds_never_overlap(spark, path):
    data = sample(600)
    df = frame(spark, data).withColumn("ts", F.col("day").cast("timestamp")).withColumn("grp", F.date_format("day", "yyyyMMdd"))
    folds = rows(X.purged_folds(df, "grp", "ts", 3, purge_days=2, purge_groups=1, embargo_groups=2, max_train_groups=10), "fold", "position")
    for fold in (0, 1, 2):
        test = [r["position"] for r in folds if r["fold"] == fold and r["role"] == "test"]
        train = [r["position"] for r in folds if r["fold"] == fold and r["role"] == "train"]
        later = [r["position"] for r in folds if r["fold"] == fold and r["role"] == "embargo"]
        assert test and 0 < len(train) <= 10 and max(train) < min(test) - 2
        assert later == [p for p in (max(test) + 1, max(test) + 2) if p < 60]
    with pytest.raises(ValueError):
        X.purged_folds(df.where("id < 10"), "grp", "ts", 3)


def test_block_folds_match_positions(spark):
    data = sample(120)
    df = frame(spark, data).withColumn("grp", F.col("day").cast("string"))
    folds = rows(X.block_folds(df, "grp", "day", 3, gap=1, max_train_groups=4), "fold", "position")
    got = {(f, role): [r["position"] for r in folds if r["fold"] == f and r["role"] == role] for f in (0, 1, 2) for role in ("train", "test")}
    assert got[(0, "test")] == [3, 4, 5] and got[(0, "train")] == [0, 1]
    assert got[(2, "test")] == [9, 10, 11] and got[(2, "train")] == [4, 5, 6, 7]


def test_group_labels_and_embargo(spark):
    df = spark.createDataFrame([(2024, 1, dt.date(2024, 1, 1), "a"), (2024, 1, dt.date(2024, 1, 1), "b"), (None, 2, dt.date(2024, 1, 2), "c")], "season int, week int, day date, g string")
    assert [r["l"] for r in rows(df.select(X.group_label(df).alias("l")))] == ["2024-1", "2024-1", "-1-2"]
    assert [r["l"] for r in rows(df.select(X.group_label(df, "g").alias("l")))] == ["a", "b", "c"]
    assert X.embargo_to_groups(df, "g", "day", 2) == 3 and X.embargo_to_groups(df, "g", "day", 0) == 0


def test_calibrators_reduce_error(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        p = round(rng.random(), 3)
        data.append((i, p, 1 if rng.random() < p**2 else 0))
    df = spark.createDataFrame(data, "id int, p double, y int")
    raw = rows(M.ece(df, "p", "y", 10))[0]["ece"]
    for method in ("sigmoid", "isotonic", "beta", "hist"):
        out = K.FITTERS[method](df, "p", "y")(df, "p", "q")
        assert rows(M.ece(out, "q", "y", 10))[0]["ece"] < raw / 2, method
        assert "p" in out.columns and out.count() == 3000


def test_isotonic_matches_pool_adjacent_violators(spark):
    xs, ys = [0.1, 0.2, 0.3, 0.4, 0.5], [0, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(xs, ys, strict=True)), "p double, y int")
    got = [r["q"] for r in rows(K.fit_isotonic(df, "p", "y")(df, "p", "q"), "p")]
    assert got == pytest.approx([0.0, 0.5, 0.5, 1.0, 1.0])


def test_isotonic_keeps_scores_closer_than_six_digits_apart(spark):
    df = spark.createDataFrame([(0.3 + i * 1e-9, i % 2 if i < 4 else 1) for i in range(8)], "p double, y int")
    got = [r["q"] for r in rows(K.fit_isotonic(df, "p", "y")(df, "p", "q"), "p")]
    assert got == pytest.approx([0.0, 0.5, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0])


def test_equal_mass_ece_keeps_ties_at_the_lowest_score_apart(spark):
    rng = random.Random(8)
    data = [(0.1 if i % 4 == 0 else round(rng.uniform(0.1, 0.9), 4), int(rng.random() < 0.4)) for i in range(400)]
    p, y = (np.array([r[k] for r in data], float) for k in (0, 1))
    edges = np.quantile(p, np.linspace(0, 1, 11))
    edges[0], edges[-1] = 0, 1
    edges = np.unique(edges)
    place = np.digitize(p, edges[1:-1], right=True)
    wanted = sum(abs(y[place == b].mean() - p[place == b].mean()) * (place == b).mean() for b in set(place))
    df = spark.createDataFrame(data, "p double, y int")
    assert rows(M.ece(df, "p", "y", 10, mass=True))[0]["ece"] == pytest.approx(wanted)


def test_purged_away_folds_are_left_out(spark):
    df = spark.createDataFrame([(f"g{d}", dt.datetime(2024, 1, 1 + d)) for d in range(6)], "grp string, ts timestamp")
    assert X.purged_folds(df, "grp", "ts", 3, purge_days=30).count() == 0
    assert {r["fold"] for r in rows(X.purged_folds(df, "grp", "ts", 3, purge_days=2.5))} == {0, 1, 2} - {r for r in range(3) if r + 3 - 3 < 0}


def test_two_by_two_screen_is_corrected(spark):
    data = [("a", 0)] * 30 + [("a", 1)] * 20 + [("b", 0)] * 20 + [("b", 1)] * 30
    df = spark.createDataFrame(data, "c string, y int")
    got = rows(A.crosstab_statistics(df, "c", "y", corrected=True))[0]
    assert got["chi2"] == pytest.approx(3.24) and got["p_value"] == pytest.approx(0.0719, abs=2e-4)
    assert rows(A.crosstab_statistics(df, "c", "y"))[0]["chi2"] == pytest.approx(4.0)
    assert A.screen_separators(df, "y", ["c"], alpha=0.05).count() == 0


def test_cross_fit_scores_only_test_rows(spark):
    data = sample(400)
    df = frame(spark, data).withColumn("grp", F.col("day").cast("string"))
    folds = X.block_folds(df, "grp", "day", 2)
    got = rows(K.cross_fit(df, folds, "grp", ["p"], "y"))
    tested = {r["grp"] for r in rows(folds) if r["role"] == "test"}
    assert {r["grp"] for r in got} == tested and all(0 <= r["oof"] <= 1 for r in got)
    assert len(got) == sum(1 for r in data if str(r[4]) in tested)


def test_experts_route_and_fall_back(spark):
    data = [("a", float(i), 2.0 * i) for i in range(50)] + [("b", float(i), -1.0 * i) for i in range(50)] + [("z", 3.0, 0.0)]
    df = spark.createDataFrame(data, "s string, x double, y double")
    apply = K.fit_experts(df, "s", ["a", "b"], ["x"], "y", min_rows=10, fallback="b", cap=lambda c: F.least(c, F.lit(50.0)))
    got = {(r["s"], r["x"]): r["e"] for r in rows(apply(df, "s", "e"))}
    assert got[("a", 10.0)] == pytest.approx(20, abs=0.5) and got[("a", 49.0)] == 50.0
    assert got[("z", 3.0)] == pytest.approx(-3, abs=0.5)


def test_ks_matches_brute_force(spark, path):
    data = sample()
    got = rows(A.ks_distance(frame(spark, data), "p", "y"))[0]
    pos, neg = [r[1] for r in data if r[2]], [r[1] for r in data if not r[2]]
    cdf = lambda xs, t: sum(x <= t for x in xs) / len(xs)
    assert got["ks"] == pytest.approx(max(abs(cdf(pos, t) - cdf(neg, t)) for t in {r[1] for r in data}))
    assert 0 <= got["p_value"] <= 1


@pytest.mark.parametrize("x, dof, expected", [(3.841, 1, 0.05), (5.991, 2, 0.05), (7.815, 3, 0.05), (18.307, 10, 0.05), (24.996, 15, 0.05), (0.0, 4, 1.0)])
def test_chi_square_tail(spark, x, dof, expected):
    df = spark.createDataFrame([(x, dof)], "x double, d int")
    assert rows(df.select(A.chi_square_tail(F.col("x"), F.col("d")).alias("p")))[0]["p"] == pytest.approx(expected, abs=2e-4)


def test_crosstab_and_screen(spark):
    data = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 10 + [("b", 0)] * 30
    df = spark.createDataFrame(data, "c string, y int").withColumn("noise", (F.monotonically_increasing_id() % 2).cast("int"))
    got = rows(A.crosstab_statistics(df, "c", "y"))[0]
    assert got["chi2"] == pytest.approx(20.0) and got["dof"] == 1 and got["p_value"] < 1e-4
    assert [r["column"] for r in rows(A.screen_separators(df, "y", ["c", "noise"], alpha=0.001))] == ["c"]


def test_spearman_and_vif(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    z = rng.normal(size=200)
    data = [(float(a), float(a + 0.1 * b), float(b), float(round(a))) for a, b in zip(x, z, strict=True)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    ranks = lambda v: np.array([(np.sum(v < t) + (np.sum(v == t) + 1) / 2) for t in v])
    expected = np.corrcoef(ranks(x), ranks(np.round(x)))[0, 1]
    assert rows(A.spearman(df, "a", "d"))[0]["rho"] == pytest.approx(expected)
    vif = A.variance_inflation(df, ["a", "b", "c"])
    assert vif["a"] > 50 and vif["b"] > 50


def test_bucket_scan_counts_all_levels(spark):
    data = [("a", "x", 1)] * 60 + [("a", "y", 0)] * 60 + [("b", "x", 0)] * 40
    df = spark.createDataFrame(data, "u string, v string, e int").withColumns({"p": F.lit(0.5), "y": F.lit(1)})
    got = {(r["feature"], r["bucket"]): (r["count"], r["error_rate"]) for r in rows(A.bucket_scan(df, ["u", "v"], "e", "p", "y", 2))}
    assert got == {("u+v", "a|x"): (60, 1.0), ("u+v", "a|y"): (60, 0.0)}
    one = {(r["feature"], r["bucket"]): r["count"] for r in rows(A.bucket_scan(df, ["u", "v"], "e", "p", "y", 1))}
    assert one == {("u", "a"): 120, ("v", "x"): 100, ("v", "y"): 60}


def test_profiles(spark):
    df = spark.createDataFrame([(float(i), "x" if i % 2 else None) for i in range(20)] + [(1000.0, "unknown")], "n double, s string")
    cover = {r["column"]: r for r in rows(A.coverage_profile(df, exact=True))}
    assert cover["s"]["missing"] == 10 and cover["n"]["coverage_pct"] == 100.0
    num = rows(A.numeric_profile(df, ["n"], {"n": (5, 500)}))[0]
    assert (num["outliers_high"], num["extreme_high"], num["below_min"], num["above_max"]) == (1, 1000.0, 5, 1)
    assert rows(A.categorical_profile(df, ["s"]))[0]["suspicious"] == 1
    buckets = A.bucket_columns(df, ["n"], ["s"], bins=5)
    assert {"n_q5", "s_cat"} <= set(buckets.columns)
    assert [r["column"] for r in rows(A.sparse_columns(A.coverage_profile(df, exact=True), {"s": 0.1}))] == ["s"]
    assert rows(A.missing_pattern(df, "s", "n"))[0]["missing"] == 1


def test_coverage_share(spark):
    from tidemark.plans.asof_metadata import coverage_ok

    df = spark.createDataFrame([(10, 5, 11), (10, 10, 9), (10, None, 9)], "cut int, a int, b int")
    known = A.knownness(df, {"injury": "a", "odds": "b"}, "cut")
    got = {r["feed"]: (r["share"], r["ok"]) for r in rows(coverage_ok(known, {"injury": 0.95, "odds": 0.9}))}
    assert got["injury"] == (1.0, 1) and got["odds"] == (pytest.approx(2 / 3), 0)


def test_chi_square_tail_of_many_degrees(spark):
    """Constant memory for any number of degrees of freedom; both sides of the switch agree."""
    near = spark.createDataFrame([(1000.0 + d, 1000 + k) for d in (-40.0, 0.0, 30.0, 90.0) for k in (0, 1)], "x double, d int")
    found = {(r["x"], r["d"]): r["p"] for r in rows(near.select("x", "d", A.chi_square_tail(F.col("x"), F.col("d")).alias("p")))}
    for x in {x for x, _ in found}:
        # One more degree moves the tail by the density, about 0.009 at most.
        assert 0 <= found[x, 1001] - found[x, 1000] < 0.0095
    wide = spark.createDataFrame([(100000.0, 100000), (100447.0, 100000), (101000.0, 100000)], "x double, d int")
    got = [r["p"] for r in rows(wide.select(A.chi_square_tail(F.col("x"), F.col("d")).alias("p"), "x"), "x")]
    assert got[0] == pytest.approx(0.49941, abs=1e-4) and got[1] == pytest.approx(0.1588, abs=5e-4) and got[2] == pytest.approx(0.01287, abs=2e-4)


def test_newton_fit_equals_the_likelihood_maximum(spark):
    """Weights at which the gradient vanishes, from counts per score; a fit without rows keeps zero."""
    import numpy as np

    from tidemark.evaluation import calibration as K

    rng = np.random.default_rng(3)
    p = rng.choice(np.linspace(0.05, 0.95, 19), 3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.4 + 1.7 * np.log(p / (1 - p)))))).astype(int)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int")
    features = {"_lp": lambda c: F.log(c), "_lq": lambda c: F.log(1 - c)}
    intercept, weights = K.logistic_weights(K._weighted(df, "p", "y"), features)
    x = np.stack([np.ones_like(p), np.log(p), np.log(1 - p)], axis=1)
    q = 1 / (1 + np.exp(-(x @ np.array([intercept, *weights]))))
    assert np.abs(x.T @ (y - q)).max() < 1e-5
    assert K.logistic_weights(K._weighted(df.where("p > 2"), "p", "y"), features) == (0.0, [0.0, 0.0])
