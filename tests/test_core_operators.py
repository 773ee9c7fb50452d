"""Windows, as-of joins and order statistics against brute force, plain and sliced."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join, asof_nearest, assign_next_or_last, latest_known
from tidemark.operators.prior import last_rows, prefix_sums, prior_rows, rolling_ratios, runs
from tidemark.operators.quantiles import flag_top_quantile, quantile_bucket, quantiles, value_ranks
from tidemark.operators.slices import plan_slices


def skewed(n=600, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 30)}"
        out.append((key, rng.randint(0, 400), i, round(rng.random() * 10, 3), rng.randint(0, 1)))
    return out


@pytest.fixture(params=["plain", "sliced"])
def path(request):
    if request.param == "sliced":
        request.getfixturevalue("hot")
    return request.param


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t int, id int, x double, hit int")


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_hot_keys_are_found_and_bounded(spark, hot):
    plan = plan_slices(frame(spark, skewed()), "k", "t")
    table = {r["k"]: r for r in plan.table.collect()}
    assert set(table) == {"hot"}
    edges = [e for chunk in table["hot"]["_fine"] for e in chunk]
    assert edges == sorted(set(edges)) and 5 <= len(edges) <= 40


def test_cold_data_needs_no_slices(spark):
    assert not plan_slices(frame(spark, skewed()), "k", "t").any_hot


def test_prior_rows_matches_brute_force(spark, path):
    data = skewed()
    df = prior_rows(
        frame(spark, data), "k", ["t", "id"], 5,
        lambda w: {"m3": F.avg("x").over(last_rows(w, 3)), "s5": F.stddev("x").over(last_rows(w, 5)), "p": F.lag("x").over(w)},
    )
    got = {r["id"]: r for r in rows(df)}
    assert len(got) == len(data)
    for group in by_key(data).values():
        xs = [r[3] for r in group]
        for i, row in enumerate(group):
            g = got[row[2]]
            before = xs[max(0, i - 3):i]
            assert g["m3"] == (pytest.approx(np.mean(before)) if before else None)
            five = xs[max(0, i - 5):i]
            assert g["s5"] == (pytest.approx(np.std(five, ddof=1)) if len(five) > 1 else None)
            assert g["p"] == (xs[i - 1] if i else None)


def test_prefix_sums_matches_brute_force(spark, path):
    data = skewed()
    got = {r["id"]: r for r in rows(prefix_sums(frame(spark, data), "k", ["t", "id"], {"c": F.lit(1), "s": F.col("x")}))}
    for group in by_key(data).values():
        total = 0.0
        for i, row in enumerate(group):
            assert got[row[2]]["c"] == i and got[row[2]]["s"] == pytest.approx(total)
            total += row[3]


def test_prefix_sums_without_keys(spark, path):
    data = skewed()
    got = {r["id"]: r["c"] for r in rows(prefix_sums(frame(spark, data), [], ["t", "id"], {"c": F.lit(1)}))}
    for i, row in enumerate(sorted(data, key=lambda r: (r[1], r[2]))):
        assert got[row[2]] == i


def test_runs_restart_on_change(spark, path):
    data = skewed()
    got = {r["id"]: r["run_length"] for r in rows(runs(frame(spark, data), "k", ["t", "id"], "hit"))}
    for group in by_key(data).values():
        length, last = 0, None
        for row in group:
            length = length + 1 if row[4] == last else 1
            last = row[4]
            assert got[row[2]] == length


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_matches_brute_force(spark, path, direction, exact):
    left, right = skewed(400, 1), skewed(300, 2)
    ldf = frame(spark, left).select("k", "t", "id")
    rdf = frame(spark, right).select("k", F.col("t").alias("rt"), F.col("id").alias("rid"), "x")
    got = {r["id"]: r for r in rows(asof_join(ldf, rdf, "k", "t", "rt", ["rid", "x"], direction, exact, tie_break=["rid"], matched_ts="at"))}
    assert len(got) == len(left)
    for key, t, ident, *_ in left:
        if direction == "backward":
            ok = [r for r in right if r[0] == key and (r[1] < t or (exact and r[1] == t))]
            best = max(ok, key=lambda r: (r[1], r[2]), default=None)
        else:
            ok = [r for r in right if r[0] == key and (r[1] > t or (exact and r[1] == t))]
            best = min(ok, key=lambda r: (r[1], -r[2]), default=None)
        assert (got[ident]["rid"], got[ident]["at"]) == ((best[2], best[1]) if best else (None, None))


def test_asof_keeps_null_payload_of_the_latest_row(spark):
    left = spark.createDataFrame([("a", 10, 1), (None, 10, 2), ("a", None, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 1, "old", 5), ("a", 9, None, 6), (None, 1, "x", 7)], "k string, rt int, s string, n int")
    got = rows(asof_join(left, right, "k", "t", "rt", ["s", "n"]), "id")
    assert [(r["s"], r["n"]) for r in got] == [(None, 6), (None, None), (None, None)]


def test_asof_cutoff_edges(spark):
    """Exactly at, just before and just after the cutoff."""
    left = spark.createDataFrame([("a", 100, 1), ("b", 100, 2), ("c", 100, 3), ("d", 100, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 100, 1), ("b", 99, 2), ("c", 101, 3)], "k string, rt int, v int")
    assert [r["v"] for r in rows(asof_join(left, right, "k", "t", "rt", ["v"]), "id")] == [1, 2, None, None]
    assert [r["v"] for r in rows(asof_join(left, right, "k", "t", "rt", ["v"], allow_exact=False), "id")] == [None, 2, None, None]


def test_nearest_prefers_smaller_distance(spark):
    ts = lambda c: F.timestamp_seconds(c)
    left = spark.createDataFrame([("a", 1000)], "k string, s int").select("k", ts("s").alias("t"))
    right = spark.createDataFrame([("a", 900, 1), ("a", 1050, 2)], "k string, s int, v int").select("k", ts("s").alias("rt"), "v")
    assert rows(asof_nearest(left, right, "k", "t", "rt", ["v"], 3600))[0]["v"] == 2
    assert rows(asof_nearest(left, right, "k", "t", "rt", ["v"], 3600, "backward_first"))[0]["v"] == 1
    assert rows(asof_nearest(left, right, "k", "t", "rt", ["v"], 10))[0]["v"] is None


def test_next_or_last_and_latest_known(spark):
    cal = spark.createDataFrame([("a", 10, 1), ("a", 20, 2)], "k string, d int, w int")
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 25), ("b", 5)], "k string, t int")
    got = rows(assign_next_or_last(left, cal, "k", "t", "d", "w", "week"), "k", "t")
    assert [r["week"] for r in got] == [1, 1, 2, None]
    cut = spark.createDataFrame([("a", 15)], "k string, cut int")
    got = rows(latest_known(cal, cut, "k", "d", "cut", ["w"], "seen", "used"))
    assert got == [{"k": "a", "seen": 10, "w": 1, "used": 1}]


@pytest.mark.parametrize("method", ["linear", "higher", "lower"])
def test_quantiles_match_numpy(spark, path, method):
    data = skewed()
    got = {r["k"]: r for r in rows(quantiles(frame(spark, data), "k", "x", {"a": 0.7, "b": 0.5, "c": 0.0, "d": 1.0}, method))}
    for key, group in by_key(data).items():
        xs = [r[3] for r in group]
        for name, q in (("a", 0.7), ("b", 0.5), ("c", 0.0), ("d", 1.0)):
            assert got[key][name] == pytest.approx(np.quantile(xs, q, method=method))


@pytest.mark.parametrize("size, cut", [(1, 0), (2, 1), (4, 3), (5, 3)])
def test_higher_quantile_on_small_groups(spark, size, cut):
    df = spark.createDataFrame([("g", float(i)) for i in range(size)], "k string, x double")
    assert rows(quantiles(df, "k", "x", {"q": 0.7}, "higher"))[0]["q"] == float(cut)


def test_value_ranks_are_exact(spark, path):
    data = skewed()
    got = rows(value_ranks(frame(spark, data), [], "t", {"pos": F.col("hit")}), "t")
    seen = pos = 0
    for r in got:
        assert (r["_before"], r["pos_before"], r["_total"]) == (seen, pos, len(data))
        seen += r["_c"]
        pos += r["pos"]
    assert seen == len(data)


def test_quantile_bucket_is_right_closed(spark):
    import pandas as pd

    xs = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0, 9.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    got = [r["bucket"] for r in rows(quantile_bucket(df, "x", 4), "id")]
    assert got == pd.qcut(xs, 4, labels=False, duplicates="drop").tolist()


def test_flag_top_quantile_falls_back_to_all_rows(spark):
    data = [("a", float(i) / 10) for i in range(5)] + [("b", None)] * 2
    got = rows(flag_top_quantile(spark.createDataFrame(data, "k string, x double"), "k", "x", 0.7, "top"))
    assert sum(r["top"] for r in got if r["k"] == "a") == 2
    assert sum(r["top"] for r in got if r["k"] == "b") == 0


def test_rolling_ratio_is_null_without_history_or_denominator(spark):
    data = [("a", 1, 1, 2), ("a", 2, 0, 0), ("a", 3, 1, 1)]
    df = spark.createDataFrame(data, "k string, d int, num int, den int")
    got = rows(rolling_ratios(df, "k", "d", {"r": ("num", "den")}, windows=(1, 3), min_support={"r": 3}), "d")
    assert [r["r_l1"] for r in got] == [None, 0.5, None]
    assert [r["r_l3"] for r in got] == [None, 0.5, 0.5]
    assert [r["r_lifetime"] for r in got] == [None, None, None]
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r.values())


def test_rows_after_the_cutoff_do_not_change_features(spark):
    data = [("a", d, d % 2, 1) for d in range(10)]
    columns = "k string, d int, num int, den int"
    stats = {"r": ("num", "den")}
    full = rolling_ratios(spark.createDataFrame(data, columns), "k", "d", stats).where("d <= 5")
    changed = [r if r[1] <= 5 else (r[0], r[1], 99, 1) for r in data]
    other = rolling_ratios(spark.createDataFrame(changed, columns), "k", "d", stats).where("d <= 5")
    assert rows(full, "d") == rows(other, "d")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_and_totals_on_hot_keys(spark, path, how):
    from tidemark.operators.keys import attach_totals
    from tidemark.operators.slices import lookup_join

    data = skewed() + [(None, 1, 10_000 + i, 1.0, 0) for i in range(60)]
    df = frame(spark, data)
    small = spark.createDataFrame([("hot", 1, None), ("k1", 2, "x"), (None, 3, "n")], "k string, v int, s string")
    got = {r["id"]: (r["v"], r["s"]) for r in rows(lookup_join(df, small, "k", how))}
    table = {"hot": (1, None), "k1": (2, "x"), None: (3, "n")}
    wanted = {r[2]: table.get(r[0], (None, None)) for r in data if how == "left" or r[0] in table}
    assert got == wanted
    totals = {r["id"]: (r["n"], round(r["sx"], 6)) for r in rows(attach_totals(df, "k", {"n": F.count(F.lit(1)), "sx": F.sum("x")}))}
    for key in {r[0] for r in data}:
        group = [r for r in data if r[0] == key]
        assert {totals[r[2]] for r in group} == {(len(group), round(sum(r[3] for r in group), 6))}


def test_rows_ahead_of_hot_keys_equal_a_plain_lead(spark, hot):
    """Look-ahead over keys that are cut into slices, with ties broken by the second column, nulls first."""
    from pyspark.sql import Window

    from tidemark.functions.expectations import shifted_target
    from tidemark.operators.prior import later_rows

    df = spark.range(600).select((F.col("id") % 5 / 4).cast("int").alias("k"), F.when(F.col("id") % 97 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7919 % 150).cast("int"))).alias("d"), "id", (F.col("id") * 31 % 101).alias("v"))
    w = Window.partitionBy("k").orderBy("d", "id")
    wanted = {r["id"]: (r["a"], r["b"]) for r in df.select("id", F.lead("v", 2).over(w).alias("a"), F.sum("v").over(w.rowsBetween(1, 3)).alias("b")).collect()}
    out = later_rows(df, "k", ["d", "id"], 3, lambda w: {"a": F.lag("v", 2).over(w), "b": F.sum("v").over(w.rowsBetween(-3, -1))})
    assert {r["id"]: (r["a"], r["b"]) for r in out.collect()} == wanted
    ahead = {r["id"]: r["n"] for r in shifted_target(df, ["k"], ["d", "id"], "v", -2, "n").collect()}
    assert ahead == {i: a for i, (a, _) in wanted.items() if a is not None}
