"""Queries: score evaluation, splits, conformal intervals, audits, associations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..evaluation import audits as A
from ..evaluation import calibration as K
from ..evaluation import scores as M
from ..evaluation import splits as X
from ..functions.expectations import expected_value, fit_team_totals, sample_weights, scale_to_team_totals, tail_parameters
from ..operators.quantiles import flag_top_quantile, quantile_bucket, quantiles
from ..session import cut_lineage
from .registry import query, r, rd, rounded, rs

_SCORED = {
    "id": "o_orderkey", "cust": "o_custkey", "day": "CAST(o_orderdate AS DATE)", "ts": "o_orderdate", "season": "year(o_orderdate)", "week": "month(o_orderdate)", "team": "o_custkey % 16",
    "segment": "o_orderpriority", "status": "o_orderstatus", "y": "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END",
    "p": "floor((o_totalprice / 600000 + CAST(o_orderkey * 37 % 100 AS DOUBLE) / 1000) * 1000) / 1000", "p2": "CAST(o_custkey * 13 % 97 AS DOUBLE) / 97",
    "price": "o_totalprice", "guess": "o_totalprice * 0.9 + CAST(o_orderkey % 101 AS DOUBLE) * 300", "guess2": "CAST(o_custkey % 500 AS DOUBLE) * 900",
}


def scored(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*[f"{e} AS {n}" for n, e in _SCORED.items()])


S = "s AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SCORED.items()) + " FROM orders)"
RANKED = "rk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s)"
AUC = "(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))"
LOGLOSS = "avg(-(y * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + (1 - y) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))))"


def edges_sql(col: str, bins: int, source: str = "s", name: str = "ed") -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"{name} AS (SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) AS e FROM {source})"


def bucket_sql(col: str, name: str = "ed") -> str:
    return f"(SELECT len(list_filter(e[2:len(e) - 1], lambda x: x < {col})) FROM {name})"


@query(
    "auc_rank_sum",
    f"""WITH {S}, {RANKED}, d AS (SELECT p, count(*) AS c, sum(y) AS pos FROM s GROUP BY p), a AS (SELECT *, sum(c) OVER (ORDER BY p DESC) AS cc, sum(pos) OVER (ORDER BY p DESC) AS cp FROM d)
SELECT {r(AUC, 'auc')}, {r('(SELECT sum(pos * cp / cc) / sum(pos) FROM a)', 'average_precision')} FROM rk""",
)
def _auc(t) -> DataFrame:
    return rounded(M.ranking_metrics(scored(t.orders), "p", "y"))


@query(
    "probability_metrics_by_season",
    f"""WITH {S}, rk AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY p) + (count(*) OVER (PARTITION BY season, p) - 1) / 2.0 AS r FROM s)
SELECT season, count(*) AS n, {rs({'positive_rate': 'avg(y)', 'brier': 'avg((p - y) * (p - y))', 'log_loss': LOGLOSS, 'auc': AUC})} FROM rk GROUP BY season""",
)
def _probability_metrics(t) -> DataFrame:
    return rounded(M.probability_metrics(scored(t.orders), "p", "y", ["season"]).drop("average_precision"))


@query(
    "ece_equal_width",
    f"""WITH {S}, b AS (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY 1) SELECT {r('sum(n * abs(c - a)) / sum(n)', 'ece')}, {r('max(abs(c - a))', 'mce')} FROM b""",
)
def _ece_equal_width(t) -> DataFrame:
    return rounded(M.ece(scored(t.orders), "p", "y", 15))


@query(
    "ece_equal_mass",
    f"""WITH {S}, tied AS (SELECT greatest(p, 0.2) AS q, y FROM s), ed AS (SELECT list_sort(list_distinct([0.0, 1.0] || quantile_cont(q, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM tied), b AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x < q)) AS b, count(*) AS n, avg(q) AS c, avg(y) AS a FROM tied, ed GROUP BY 1) SELECT {r('sum(n * abs(c - a)) / sum(n)', 'ece')}, {r('max(abs(c - a))', 'mce')} FROM b""",
)
def _ece_equal_mass(t) -> DataFrame:
    """A score with many ties at its lowest value."""
    tied = scored(t.orders).withColumn("q", F.greatest("p", F.lit(0.2)))
    return rounded(M.ece(tied, "q", "y", 10, mass=True))


@query(
    "calibration_table",
    f"""WITH {S}, {edges_sql('p', 10)}, b AS (SELECT {bucket_sql('p')} AS bin, count(*) AS n, CAST(sum(y) AS DOUBLE) AS positives, avg(p) AS mp, avg(y) AS er FROM s GROUP BY 1)
SELECT bin, n, positives, {rs({'mean_pred': 'mp', 'emp_rate': 'er', 'abs_gap': 'abs(mp - er)',
 'wilson_low': '(er + 3.8414588206941236/(2*n)) / (1 + 3.8414588206941236/n) - 1.959963984540054 * sqrt(er*(1-er)/n + 3.8414588206941236/(4*n*n)) / (1 + 3.8414588206941236/n)',
 'wilson_high': '(er + 3.8414588206941236/(2*n)) / (1 + 3.8414588206941236/n) + 1.959963984540054 * sqrt(er*(1-er)/n + 3.8414588206941236/(4*n*n)) / (1 + 3.8414588206941236/n)'})}
FROM b WHERE n >= greatest(10, floor((SELECT count(*) FROM s) / 40.0), 50)""",
)
def _calibration_table(t) -> DataFrame:
    return rounded(M.calibration_table(scored(t.orders), "p", "y"))


@query(
    "brier_decomposition",
    f"""WITH {S}, {edges_sql('p', 10)}, b AS (SELECT {bucket_sql('p')} AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY 1), g AS (SELECT avg(y) AS m, count(*) AS n, avg((p - y) * (p - y)) AS br FROM s)
SELECT {rs({'brier': 'any_value(g.br)', 'reliability': 'sum(b.n * (c - a) * (c - a)) / any_value(g.n)', 'resolution': 'sum(b.n * (a - g.m) * (a - g.m)) / any_value(g.n)', 'uncertainty': 'any_value(g.m * (1 - g.m))'})} FROM b, g""",
)
def _brier_decomposition(t) -> DataFrame:
    return rounded(M.brier_decomposition(scored(t.orders), "p", "y"))


@query(
    "confidence_deciles",
    f"""WITH {S} SELECT CAST(CASE WHEN p >= 1 THEN 10 ELSE least(floor(p * 10), 10) END AS INT) AS bin, count(*) AS n, {rs({'accuracy': 'avg(CASE WHEN (p >= 0.5)::INT = y THEN 1 ELSE 0 END)', 'avg_confidence': 'avg(p)', 'actual_positive_rate': 'avg(y)'})} FROM s GROUP BY 1""",
)
def _confidence_deciles(t) -> DataFrame:
    return rounded(M.confidence_deciles(scored(t.orders), "p", "y"))


@query(
    "calibration_summary",
    f"WITH {S}, b AS (SELECT least(floor(p * 10), 9) AS b, avg(p) AS c, avg(y) AS a FROM s GROUP BY 1) SELECT {rs({'calibration_mse': 'avg((c - a) * (c - a))', 'calibration_max': 'max(abs(c - a))'})} FROM b",
)
def _calibration_summary(t) -> DataFrame:
    return rounded(M.calibration_summary(scored(t.orders), "p", "y"))


@query(
    "regression_report",
    f"""WITH {S}, k AS (SELECT quantile_cont(price, 0.9) AS cut, avg(price) AS m, count(*) AS n FROM s), e AS (SELECT guess - price AS e, price AS y, guess AS p, k.* FROM s, k),
topn AS (SELECT * FROM e ORDER BY p DESC LIMIT (SELECT greatest(1, floor(0.05 * n))::BIGINT FROM k))
SELECT count(*) AS n, CAST(sum((y >= cut)::INT) AS BIGINT) AS outlier_support, {rs({'rmse': 'sqrt(avg(e * e))', 'mae': 'avg(abs(e))', 'mdae': 'median(abs(e))', 'bias': 'avg(e)', 'r2': '1 - sum(e * e) / (var_pop(y) * count(*))', 'explained_variance': '1 - var_pop(e) / var_pop(y)',
 'baseline_rmse': 'sqrt(avg((y - m) * (y - m)))', 'baseline_mae': 'avg(abs(y - m))', 'outlier_rmse': 'sqrt(avg(e * e) FILTER (y >= cut))', 'outlier_mae': 'avg(abs(e)) FILTER (y >= cut)', 'outlier_threshold': 'any_value(cut)',
 'recall_top5pct': '(SELECT avg((y >= cut)::INT) FROM topn)', 'lift_top5pct': '(SELECT avg(y) FROM topn) / avg(y)'}, 4)} FROM e""",
)
def _regression_report(t) -> DataFrame:
    return rounded(M.regression_metrics(scored(t.orders), "guess", "price"), 4)


@query(
    "decile_errors",
    f"WITH {S}, {edges_sql('guess', 10)} SELECT {bucket_sql('guess')} AS decile, count(*) AS n, {rs({'rmse': 'sqrt(avg((guess - price) * (guess - price)))', 'mae': 'avg(abs(guess - price))'}, 4)} FROM s GROUP BY 1",
)
def _decile_errors(t) -> DataFrame:
    return rounded(M.decile_errors(scored(t.orders), "guess", "price"), 4)


@query(
    "selective_metrics",
    f"""WITH {S}, d AS (SELECT *, CASE WHEN p BETWEEN 0.3 AND 0.4 THEN -1 WHEN p > 0.4 THEN 1 ELSE 0 END AS d FROM s)
SELECT segment, count(*) AS n_total, count(*) FILTER (d <> -1) AS n_accepted, {rs({'coverage': 'avg((d <> -1)::INT)', 'accuracy_sel': 'avg((d = y)::INT) FILTER (d <> -1)', 'precision_sel': 'coalesce(count(*) FILTER (d = 1 AND y = 1) / nullif(count(*) FILTER (d = 1), 0), 0)',
 'recall_sel': 'coalesce(count(*) FILTER (d = 1 AND y = 1) / nullif(count(*) FILTER (d <> -1 AND y = 1), 0), 0)', 'f1_sel': 'coalesce(2 * count(*) FILTER (d = 1 AND y = 1) / nullif(2 * count(*) FILTER (d = 1 AND y = 1) + count(*) FILTER (d = 1 AND y = 0) + count(*) FILTER (d = 0 AND y = 1), 0), 0)'})} FROM d GROUP BY 1""",
)
def _selective_metrics(t) -> DataFrame:
    d = scored(t.orders).withColumn("d", F.expr("CASE WHEN p BETWEEN 0.3 AND 0.4 THEN -1 WHEN p > 0.4 THEN 1 ELSE 0 END"))
    return rounded(M.selective_metrics(d, "d", "y", ["segment"]))


@query(
    "risk_coverage_curve",
    f"""WITH {S}, k AS (SELECT min(p2) AS lo, max(p2) AS hi, count(*) AS n FROM s), g AS (SELECT i AS step, lo + (hi - lo) * i / 19 AS threshold, n FROM k, range(20) t(i))
SELECT CAST(step AS INT) AS step, {rs({'threshold': 'threshold', 'coverage': '(SELECT count(*) FROM s WHERE p2 <= threshold + 1e-12) / n', 'risk': '(SELECT coalesce(1 - avg(((p > 0.4)::INT = y)::INT), 1) FROM s WHERE p2 <= threshold + 1e-12)'})} FROM g""",
)
def _risk_coverage_curve(t) -> DataFrame:
    base = scored(t.orders).withColumn("half", F.lit(0.4))
    return rounded(M.risk_coverage(base, "y", "p", "half", "p2"))


_TH = f"""{S}, d AS (SELECT p, count(*) AS c, sum(y) AS pos FROM s GROUP BY p), k AS (SELECT p AS threshold, sum(c) OVER w AS n, sum(pos) OVER w AS tp, sum(c) OVER () AS total, sum(pos) OVER () AS np FROM d WINDOW w AS (ORDER BY p DESC)),
m AS (SELECT threshold, (n - tp) / (total - np) AS fpr, tp / np AS rec, tp / n AS prec, (tp + (total - np) - (n - tp)) / total AS acc FROM k), q AS (SELECT *, 2 * prec * rec / (prec + rec + 1e-16) AS f1 FROM m)"""


@query("threshold_table", f"WITH {_TH} SELECT {rs({'threshold': 'threshold', 'fpr': 'fpr', 'tpr': 'rec', 'precision': 'prec', 'recall': 'rec', 'f1': 'f1', 'accuracy': 'acc'})} FROM q")
def _threshold_table(t) -> DataFrame:
    return rounded(M.threshold_table(scored(t.orders), "p", "y"))


@query(
    "threshold_choice",
    f"""WITH {_TH} SELECT 'roc' AS method, {r('min(threshold) FILTER (fpr <= 0.1)', 'threshold')} FROM q UNION ALL SELECT 'f1', round(max_by(threshold, (f1, -threshold)) + 1e-9, 6) FROM q
UNION ALL SELECT 'accuracy', round(max_by(threshold, (acc, -threshold)) + 1e-9, 6) FROM q UNION ALL SELECT 'precision_target', round(max(threshold) FILTER (rec >= 0.8) + 1e-9, 6) FROM q""",
)
def _threshold_choice(t) -> DataFrame:
    s = scored(t.orders)
    out = None
    for name, args in (("roc", {}), ("f1", {}), ("accuracy", {}), ("precision_target", {"target": 0.8})):
        method = "recall" if name == "precision_target" else name
        part = M.select_threshold(s, "p", "y", method, **args).select(F.lit(name).alias("method"), rd("threshold").alias("threshold"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "walk_forward_daily",
    f"""WITH {S}, rk AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY p) + (count(*) OVER (PARTITION BY day, p) - 1) / 2.0 AS r FROM s),
d AS (SELECT day, count(*) AS n, sum(p) AS expected, sum(y) AS observed, avg((p - y) * (p - y)) AS brier, CASE WHEN count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 THEN {AUC} END AS auc FROM rk GROUP BY day),
b AS (SELECT day, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS p, sum(y) AS y FROM s GROUP BY ALL),
t AS (SELECT d.day, b.b, sum(b.n) AS n, sum(b.p) AS p, sum(b.y) AS y FROM d JOIN b ON b.day BETWEEN d.day - INTERVAL 29 DAY AND d.day GROUP BY ALL), e AS (SELECT day, sum(abs(p - y)) / sum(n) AS te FROM t GROUP BY day)
SELECT CAST(d.day AS VARCHAR) AS day, d.n, {rs({'expected': 'expected', 'observed': 'observed', 'cumulative_gap': 'sum(observed - expected) OVER (ORDER BY d.day)', 'brier': 'brier', 'auc': 'auc', 'trailing_ece': 'te'})} FROM d JOIN e USING (day)""",
)
def _walk_forward_daily(t) -> DataFrame:
    out = M.walk_forward(scored(t.orders), "day", "p", "y", 30)
    return rounded(out.select(F.col("day").cast("string").alias("day"), "n", "expected", "observed", "cumulative_gap", "brier", "auc", "trailing_ece"))


@query(
    "segment_comparison",
    f"""WITH {S}, l AS (SELECT segment, price AS y, 'global' AS model, guess AS p FROM s UNION ALL SELECT segment, price, 'expert', guess2 FROM s)
SELECT segment, model, count(*) AS n, {rs({'mae': 'avg(abs(p - y))', 'rmse': 'sqrt(avg((p - y) * (p - y)))', 'r2': '1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))'}, 4)} FROM l GROUP BY ALL""",
)
def _segment_comparison(t) -> DataFrame:
    return rounded(M.segment_metrics(scored(t.orders), "price", {"global": "guess", "expert": "guess2"}, "segment"), 4)


@query(
    "expected_vs_actual",
    f"WITH {S} SELECT segment, count(*) AS n, {rs({'price_expected': 'avg(guess)', 'price_actual': 'avg(price)', 'price_bias': 'avg(guess - price)', 'price_mae': 'avg(abs(guess - price))', 'price_corr': 'corr(guess, price)'}, 4)} FROM s GROUP BY 1",
)
def _expected_vs_actual(t) -> DataFrame:
    return rounded(M.expected_vs_actual(scored(t.orders), {"price": ("guess", "price")}, ["segment"]), 4)


@query(
    "baseline_diff",
    f"""WITH {S}, c AS (SELECT season AS k, avg((p - y) * (p - y)) AS b, avg(y) AS rate FROM s WHERE season >= 1996 GROUP BY 1), v AS (SELECT season AS k, avg((p2 - y) * (p2 - y)) AS b, avg(p) AS rate FROM s WHERE season <= 2000 GROUP BY 1)
SELECT k, CASE WHEN v.b IS NULL THEN 'new' WHEN c.b IS NULL THEN 'missing' ELSE 'common' END AS status, {rs({'delta_b': 'c.b - v.b', 'delta_rate': 'c.rate - v.rate'})} FROM c FULL JOIN v USING (k)""",
)
def _baseline_diff(t) -> DataFrame:
    s = scored(t.orders)
    cur = s.where("season >= 1996").groupBy(F.col("season").alias("k")).agg(F.avg(F.expr("(p - y) * (p - y)")).alias("b"), F.avg("y").alias("rate"))
    old = s.where("season <= 2000").groupBy(F.col("season").alias("k")).agg(F.avg(F.expr("(p2 - y) * (p2 - y)")).alias("b"), F.avg("p").alias("rate"))
    return rounded(M.compare_runs(cur, old, "k", ["b", "rate"]))


@query(
    "parity_check",
    "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders), b AS (SELECT k, CASE WHEN k % 10 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN k % 7 = 0 THEN NULL ELSE cust END AS cust FROM a) "
    "SELECT 'price' AS \"column\", count(*) AS compared, count(*) FILTER (abs(a.price - b.price) > 1e-6) AS differing, round(max(abs(a.price - b.price)), 4) AS max_difference FROM a JOIN b USING (k) "
    "UNION ALL SELECT 'cust', count(*), count(*) FILTER (b.cust IS NULL), 0.0 FROM a JOIN b USING (k)",
)
def _parity_check(t) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    b = a.select("k", F.expr("CASE WHEN k % 10 = 0 THEN price + 1 ELSE price END AS price"), F.expr("CASE WHEN k % 7 = 0 THEN NULL ELSE cust END AS cust"))
    out = M.parity(a, b, ["k"], ["price", "cust"])
    return out.withColumn("max_difference", F.round("max_difference", 4))


# --- splits and folds ------------------------------------------------------------------------


@query(
    "chronological_split",
    f"""WITH {S}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM s)),
l AS (SELECT day, CASE WHEN rk <= greatest(floor(n * 0.7 + 1e-9) - 1, 0) THEN 'train' WHEN rk <= floor(n * 0.85 + 1e-9) - 1 THEN 'val' WHEN rk <= n - 1 THEN 'test' END AS split FROM d)
SELECT split, count(*) AS n, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM s JOIN l USING (day) GROUP BY 1""",
)
def _chronological_split(t) -> DataFrame:
    out = X.split_by_fraction(scored(t.orders), "day")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query(
    "rolling_week_split",
    f"""WITH {S}, m AS (SELECT max(season) AS ls FROM s) SELECT CASE WHEN season < ls THEN 'train' WHEN week BETWEEN 5 AND 6 THEN 'val' WHEN week >= 7 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM s, m GROUP BY 1""",
)
def _rolling_week_split(t) -> DataFrame:
    out = X.split_rolling_weeks(scored(t.orders), val_weeks=(5, 6), test_weeks=(7, 8))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_FOLD = f"""{S}, g AS (SELECT season * 100 + week AS grp, min(ts) AS a, max(ts) AS b, count(*) AS rows FROM s GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY a, grp) - 1 AS pos, count(*) OVER () AS n FROM g),
f AS (SELECT o.*, i AS fold, n - 5 * (n // 6) + i * (n // 6) AS st, n // 6 AS sz FROM o, range(5) t(i)), x AS (SELECT *, min(CASE WHEN pos >= st AND pos < st + sz THEN a END) OVER (PARTITION BY fold) AS begins FROM f)"""


@query(
    "purged_folds",
    f"""WITH {_FOLD}, z AS (SELECT fold, rows, CASE WHEN pos >= st AND pos < st + sz THEN 'test' WHEN pos < st - 2 AND b < begins - INTERVAL 400 DAY THEN 'train' WHEN pos >= st + sz AND pos < st + sz + 1 THEN 'embargo' END AS role FROM x), z2 AS (SELECT * FROM z WHERE fold IN (SELECT fold FROM z WHERE role = 'train'))
SELECT CAST(fold AS INT) AS fold, role, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS groups FROM z2 WHERE role IS NOT NULL GROUP BY ALL""",
)
def _purged_folds(t) -> DataFrame:
    s = scored(t.orders).withColumn("grp", F.col("season") * 100 + F.col("week"))
    folds = X.purged_folds(s, "grp", "ts", 5, purge_days=400, purge_groups=2, embargo_groups=1)
    return X.fold_summary(s, folds, "grp")


@query(
    "block_folds",
    f"""WITH {_FOLD}, z AS (SELECT fold, rows, CASE WHEN pos >= st AND pos < st + sz THEN 'test' WHEN pos >= greatest(st - 1 - 24, 0) AND pos < st - 1 THEN 'train' END AS role FROM x)
SELECT CAST(fold AS INT) AS fold, role, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS groups FROM z WHERE role IS NOT NULL GROUP BY ALL""",
)
def _block_folds(t) -> DataFrame:
    s = scored(t.orders).withColumn("grp", F.col("season") * 100 + F.col("week"))
    return X.fold_summary(s, X.block_folds(s, "grp", "ts", 5, gap=1, max_train_groups=24), "grp")


@query(
    "sample_weights",
    f"""WITH {S}, m AS (SELECT max(season) AS ls FROM s), k AS (SELECT max(week) AS lw FROM s, m WHERE season = ls),
w AS (SELECT id, least(greatest(pow(0.6, ls - season) * CASE WHEN season = ls THEN 1 + 0.5 * least(week / lw, 1) ELSE 1 END * CASE WHEN season = ls THEN 1.5 ELSE 1 END * CASE WHEN season = ls AND y > 0 THEN 1.2 ELSE 1 END * CASE WHEN season = ls AND week >= 4 THEN 1.1 ELSE 1 END, 0.1), 3.0) AS w FROM s, m, k)
SELECT id, {r('w / avg(w) OVER ()', 'sample_weight')} FROM w""",
)
def _sample_weights(t) -> DataFrame:
    config = {"season_decay": 0.6, "current_season_week_boost": 0.5, "current_season_multiplier": 1.5, "current_season_positive_multiplier": 1.2, "recent_week_boost_start": 4, "recent_week_boost_multiplier": 1.1}
    return rounded(sample_weights(scored(t.orders), config, "y").select("id", "sample_weight"))


# --- conformal, team totals, survival ---------------------------------------------------------


@query(
    "conformal_interval",
    f"""WITH {S}, q AS (SELECT list_sort(list(abs(price - guess)))[least(count(*), ceil((count(*) + 1) * 0.9 - 1e-9))::BIGINT] AS q FROM s), i AS (SELECT s.*, greatest(guess - q, 0) AS lo, guess + q AS hi FROM s, q)
SELECT segment, count(*) AS n, {rs({'coverage': 'avg((price BETWEEN lo AND hi)::INT)', 'width_mean': 'avg(hi - lo)', 'width_median': 'median(hi - lo)', 'rmse': 'sqrt(avg((guess - price) * (guess - price)))', 'mae': 'avg(abs(guess - price))', 'bias': 'avg(guess - price)'}, 3)} FROM i GROUP BY 1""",
)
def _conformal_interval(t) -> DataFrame:
    s = scored(t.orders)
    return rounded(K.interval_report(K.conformal_intervals(s, s, "guess", "price", 0.1, 0.0), "price", "guess", ["segment"]), 3)


@query(
    "conformal_component_sums",
    f"""WITH {S}, a AS (SELECT id, team, season, price + price / 2 AS y, guess + guess2 / 2 AS p FROM s WHERE status <> 'P' AND segment <> '5-LOW'), g AS (SELECT team, season, sum(y) AS y, sum(p) AS p FROM a GROUP BY ALL),
q AS (SELECT list_sort(list(abs(y - p)))[least(count(*), ceil((count(*) + 1) * 0.9 - 1e-9))::BIGINT] AS q FROM g), i AS (SELECT g.*, greatest(p - q, 0) AS lo, p + q AS hi FROM g, q)
SELECT count(*) AS n, {rs({'coverage': 'avg((y BETWEEN lo AND hi)::INT)', 'width_mean': 'avg(hi - lo)', 'width_median': 'median(hi - lo)', 'rmse': 'sqrt(avg((p - y) * (p - y)))', 'mae': 'avg(abs(p - y))', 'bias': 'avg(p - y)'}, 2)} FROM i""",
)
def _conformal_component_sums(t) -> DataFrame:
    s = scored(t.orders)
    one = s.where("status <> 'P'").select("id", "team", "season", F.col("price").alias("y"), F.col("guess").alias("p"))
    two = s.where("segment <> '5-LOW'").select("id", "team", "season", (F.col("price") / 2).alias("y"), (F.col("guess2") / 2).alias("p"))
    return rounded(K.conformal_sum([one, two], ["id", "team", "season"], "p", "y", 0.1, ["team", "season"]), 2)


@query(
    "team_total_scaling",
    f"""WITH {S}, b AS (SELECT id, season, week, team, p, y, CASE WHEN id % 11 = 0 THEN NULL ELSE 15 + team END AS it, p2 AS w FROM s), m AS (SELECT avg(it) AS mt FROM b), c AS (SELECT b.*, coalesce(it, mt) AS imp, mt FROM b, m),
g AS (SELECT season, week, team, avg(imp) AS ai, sum(y) AS ac FROM c GROUP BY ALL), k AS (SELECT least(12, greatest(3, sum(ai) / sum(ac))) AS dv, sum(ai) AS si, sum(ac) AS sa FROM g), k2 AS (SELECT dv, least(3, greatest(0.25, sa / (si / dv))) AS gs FROM k),
e AS (SELECT c.*, k2.*, avg(imp) OVER z / dv AS ex, sum(p) OVER z AS sp, avg(w) OVER z AS mw FROM c, k2 WINDOW z AS (PARTITION BY season, week, team)),
f AS (SELECT *, p * least(greatest(coalesce(CASE WHEN sp >= 0.1 THEN ex / sp END, gs), 0.25), 3) * least(greatest(1 + 0.5 * (CASE WHEN mw > 0 THEN w / mw ELSE w END - 1), 0.25), 4) AS v FROM e),
h AS (SELECT *, sum(v) OVER (PARTITION BY season, week, team) AS sv FROM f)
SELECT id, {r('least(greatest(v * CASE WHEN sv > 0 THEN ex / sv ELSE 1 END, 0), 1)', 'scaled')} FROM h""",
)
def _team_total_scaling(t) -> DataFrame:
    s = scored(t.orders).withColumn("team_implied_total", F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(15 + team AS DOUBLE) END"))
    fit = fit_team_totals(s, "y", weights=["p2"])
    return rounded(scale_to_team_totals(s, "p", fit, "scaled").select("id", "scaled"))


@query(
    "survival_expected_value",
    f"""WITH {S}, h AS (SELECT id, p AS a, p2 AS b, p * 0.5 AS c, p2 * 0.4 AS d FROM s), x AS (SELECT *, least(greatest(d * 0.35, 0), 1) AS e FROM h),
cl AS (SELECT id, least(greatest(a, 1e-6), 1 - 1e-6) AS a, least(greatest(b, 1e-6), 1 - 1e-6) AS b, least(greatest(c, 1e-6), 1 - 1e-6) AS c, least(greatest(d, 1e-6), 1 - 1e-6) AS d, least(greatest(e, 1e-6), 1 - 1e-6) AS e FROM x),
m AS (SELECT id, a, least(a, b) AS b, least(a, b, c) AS c, least(a, b, c, d) AS d, least(a, b, c, d, e) AS e FROM cl)
SELECT id, {rs({'pmf_0': '1 - a', 'pmf_1': 'a - b', 'pmf_4': 'd - e', 'pmf_5': 'e', 'expected_value': '(a - b) + 2 * (b - c) + 3 * (c - d) + 4 * (d - e) + 5.6 * e'})} FROM m""",
)
def _survival_expected_value(t) -> DataFrame:
    h = scored(t.orders).selectExpr("id", "p AS a", "p2 AS b", "p * 0.5D AS c", "p2 * 0.4D AS d")
    out = expected_value(h, ["a", "b", "c", "d"], 5.6)
    return rounded(out.select("id", "pmf_0", "pmf_1", "pmf_4", "pmf_5", "expected_value"))


@query(
    "tail_parameters",
    f"SELECT l_returnflag, {rs({'tail_ratio': 'count(*) FILTER (l_linenumber >= 5) / nullif(count(*) FILTER (l_linenumber >= 4), 0)', 'tail_mean': 'avg(l_linenumber) FILTER (l_linenumber >= 5)'})} FROM lineitem GROUP BY 1",
)
def _tail_parameters(t) -> DataFrame:
    return rounded(tail_parameters(t.lineitem, "l_linenumber", ["l_returnflag"]))


@query(
    "histogram_calibration",
    f"WITH {S} SELECT CAST(least(floor(least(greatest(p, 1e-6), 1 - 1e-6) * 20), 19) AS INT) AS bin, count(*) AS n, {r('(sum(y) + 1) / (count(*) + 2)', 'rate')} FROM s GROUP BY 1",
)
def _histogram_calibration(t) -> DataFrame:
    return rounded(K.histogram_rates(scored(t.orders), "p", "y"))


def _newton_sql(steps: int) -> str:
    """Newton steps of a logistic fit with one feature, one after another, each an aggregate over all rows."""
    out = ["b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(1, steps + 1):
        sums = f"SELECT any_value(a) AS a, any_value(b) AS b, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) AS h11 FROM (SELECT d.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM d, b{k - 1})"
        out.append(f"b{k} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM ({sums}))")
    return ", ".join(out)


@query(
    "platt_calibration",
    f"WITH {S}, c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS pc FROM s WHERE p IS NOT NULL AND y IS NOT NULL), d AS (SELECT ln(pc / (1 - pc)) AS x, y FROM c), {_newton_sql(16)} "
    f"SELECT CAST(least(floor(pc * 20), 19) AS INT) AS bin, count(*) AS n, {r('avg(1 / (1 + exp(-(a + b * ln(pc / (1 - pc))))))', 'calibrated')} FROM c, b16 GROUP BY 1",
)
def _platt_calibration(t) -> DataFrame:
    """Logistic calibration of all scores, by bin."""
    s = scored(t.orders).where("p is not null and y is not null")
    out = K.fit_platt(s, "p", "y")(s, "p", "calibrated")
    pc = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    bins = F.least(F.floor(pc * 20), F.lit(19)).cast("int").alias("bin")
    return rounded(out.groupBy(bins).agg(F.count(F.lit(1)).alias("n"), F.avg("calibrated").alias("calibrated")))


@query("mean_calibration", f"SELECT o_orderkey, {r('a * o_custkey + b', 'fitted', 3)} FROM orders, (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)")
def _mean_calibration(t) -> DataFrame:
    out = K.fit_mean_calibration(t.orders, "o_custkey", "o_totalprice")(t.orders, "o_custkey", "fitted")
    return rounded(out.select("o_orderkey", "fitted"), 3)


@query("calibrator_choice")
def _calibrator_choice(t) -> DataFrame:
    """Out-of-fold ECE of each calibrator (iterative fits, so rows only)."""
    s = scored(t.orders).withColumn("grp", F.col("season") * 100 + F.col("week"))
    folds = X.block_folds(s, "grp", "ts", 2, gap=1)
    out = None
    for method in ("sigmoid", "beta", "isotonic", "hist", "raw"):
        oof = cut_lineage(K.out_of_fold(s, folds, "grp", "p", "y", method).select("oof", "y"))
        error = M.ece(oof, "oof", "y", 10, mass=True).select(F.lit(method).alias("method"), "ece", "mce")
        out = error if out is None else out.unionByName(error)
    return out


@query("cross_fitted_scores")
def _cross_fitted_scores(t) -> DataFrame:
    """Out-of-fold scores of a per-fold logistic model (iterative fits, so rows only)."""
    s = scored(t.orders).withColumn("grp", F.col("season") * 100 + F.col("week"))
    folds = X.purged_folds(s, "grp", "ts", 2, purge_groups=1)
    return K.cross_fit(s, folds, "grp", ["p", "p2"], "y").select("id", "fold", "y", "oof")


@query("segment_experts")
def _segment_experts(t) -> DataFrame:
    """One linear model per segment with a fallback and a cap hook (iterative fits, so rows only)."""
    s = scored(t.orders)
    apply = K.fit_experts(s, "segment", ["1-URGENT", "2-HIGH", "5-LOW"], ["guess", "guess2"], "price", min_rows=50, fallback="5-LOW", cap=lambda c: F.greatest(c, F.lit(0.0)))
    return apply(s, "segment", "expert").select("id", "segment", "expert")


# --- quantile conventions -----------------------------------------------------------------------


@query(
    "quantile_higher_flags",
    """WITH c AS (SELECT o_custkey % 60 AS g, o_orderkey, o_totalprice AS v FROM orders), q AS (SELECT g, list_sort(list(v))[CAST(ceil(round(0.7 * (count(*) - 1), 9)) AS BIGINT) + 1] AS cut FROM c GROUP BY g)
SELECT o_orderkey, CASE WHEN v >= cut THEN 1 ELSE 0 END AS top FROM c JOIN q USING (g)""",
)
def _quantile_higher_flags(t) -> DataFrame:
    base = t.orders.select("o_orderkey", (F.col("o_custkey") % 60).alias("g"), F.col("o_totalprice").alias("v"))
    return flag_top_quantile(base, "g", "v", 0.7, "top").select("o_orderkey", "top")


@query("group_quantiles", f"SELECT l_suppkey, {rs({'q25': 'quantile_cont(l_extendedprice, 0.25)', 'med': 'median(l_extendedprice)', 'q90': 'quantile_cont(l_extendedprice, 0.9)'}, 4)} FROM lineitem GROUP BY 1")
def _group_quantiles(t) -> DataFrame:
    return rounded(quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"q25": 0.25, "med": 0.5, "q90": 0.9}), 4)


@query("quantile_buckets", f"WITH l AS (SELECT l_quantity AS q FROM lineitem), {edges_sql('q', 7, 'l')} SELECT {bucket_sql('q')} AS bucket, count(*) AS n, min(q) AS low, max(q) AS high FROM l GROUP BY 1")
def _quantile_buckets(t) -> DataFrame:
    return quantile_bucket(t.lineitem, "l_quantity", 7).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


# --- audits ---------------------------------------------------------------------------------------


@query(
    "column_coverage",
    "WITH l AS (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag, l_quantity AS qty, l_suppkey AS supp FROM lineitem), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\" FROM l" for c in ("flag", "qty", "supp"))
    + ") SELECT *, rows - non_null AS missing, round(100.0 * non_null / rows, 2) AS coverage_pct, round(100.0 * \"distinct\" / non_null, 2) AS uniqueness_pct, CASE WHEN 100.0 * \"distinct\" / non_null < 5 OR \"distinct\" < 50 THEN 1 ELSE 0 END AS likely_categorical, CASE WHEN \"distinct\" < non_null THEN 1 ELSE 0 END AS has_duplicates FROM m",
)
def _column_coverage(t) -> DataFrame:
    base = t.lineitem.selectExpr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag", "l_quantity AS qty", "l_suppkey AS supp")
    return A.coverage_profile(base, exact=True)


_NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "numeric_profile",
    "WITH "
    + ", ".join(f"k{i} AS (SELECT quantile_cont({c}, 0.25) AS a, median({c}) AS m, quantile_cont({c}, 0.75) AS b FROM lineitem)" for i, c in enumerate(_NUM))
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, min({c}) AS min, max({c}) AS max, {rs({'mean': f'avg({c})', 'std': f'stddev_samp({c})', 'q25': 'any_value(a)', 'median': 'any_value(m)', 'q75': 'any_value(b)'}, 4)}, count(*) FILTER ({c} < a - 1.5 * (b - a)) AS outliers_low, count(*) FILTER ({c} > b + 1.5 * (b - a)) AS outliers_high, "
        f"min({c}) FILTER ({c} < a - 1.5 * (b - a)) AS extreme_low, max({c}) FILTER ({c} > b + 1.5 * (b - a)) AS extreme_high, {r(f'100.0 * (count(*) FILTER ({c} < a - 1.5 * (b - a)) + count(*) FILTER ({c} > b + 1.5 * (b - a))) / count(*)', 'outlier_pct', 4)}, "
        f"{'count(*) FILTER (l_quantity < 5)' if i == 0 else '0'} AS below_min, {'count(*) FILTER (l_quantity > 45)' if i == 0 else '0'} AS above_max FROM lineitem, k{i}"
        for i, c in enumerate(_NUM)
    ),
)
def _numeric_profile(t) -> DataFrame:
    return rounded(A.numeric_profile(t.lineitem, _NUM, {"l_quantity": (5, 45)}), 4)


@query(
    "categorical_profile",
    "WITH l AS (SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders) SELECT 's' AS \"column\", count(DISTINCT s) AS \"distinct\", count(s) AS rows, count(*) FILTER (s = '') AS empty, 0 AS suspicious, count(DISTINCT s) FILTER (s NOT IN ('F', 'O')) AS unexpected_values FROM l "
    "UNION ALL SELECT 'p', count(DISTINCT p), count(p), count(*) FILTER (p = ''), 0, 0 FROM l",
)
def _categorical_profile(t) -> DataFrame:
    base = t.orders.select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return A.categorical_profile(base, ["s", "p"], {"s": ["F", "O"]})


@query(
    "datetime_profile",
    "SELECT 'o_orderdate' AS \"column\", count(*) AS n, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INT) AS span_days, count(DISTINCT CAST(o_orderdate AS DATE)) AS unique_dates, "
    "count(*) FILTER (year(o_orderdate) < 1996) AS before_min_year, count(*) FILTER (year(o_orderdate) > 2000) AS after_max_year FROM orders",
)
def _datetime_profile(t) -> DataFrame:
    return A.datetime_profile(t.orders, ["o_orderdate"], (1996, 2000))


@query("top_values", "SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _top_values(t) -> DataFrame:
    return A.top_values(t.lineitem, "l_suppkey", 10)


@query(
    "snapshot_coverage",
    f"WITH {S}, h AS (SELECT *, unnest([2.0, 6.0, 24.0]) AS hz FROM s) SELECT hz AS horizon, count(*) AS rows, {rs({'feed_a_coverage': 'avg(CASE WHEN id % 9 >= hz / 6 THEN 1 ELSE 0 END)', 'feed_b_coverage': 'avg(CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END)'})} FROM h GROUP BY 1",
)
def _snapshot_coverage(t) -> DataFrame:
    from ..functions.cutoff import with_horizons

    h = with_horizons(scored(t.orders), [2.0, 6.0, 24.0], "horizon").withColumns(
        {"feed_a": F.when(F.col("id") % 9 >= F.col("horizon") / 6, F.col("ts")), "feed_b": F.when(F.col("id") % 4 != 0, F.col("ts"))}
    )
    return rounded(A.snapshot_coverage(h, ["feed_a", "feed_b"], ["horizon"]))


@query(
    "knownness_audit",
    f"""WITH {S}, f AS (SELECT ts AS cutoff, CASE WHEN id % 4 <> 0 THEN ts - INTERVAL 3 HOUR END AS a, CASE WHEN id % 5 = 0 THEN ts + INTERVAL 1 HOUR WHEN id % 5 = 1 THEN ts END AS b FROM s)
SELECT 'injury' AS feed, count(*) AS rows, count(a) AS non_null, count(*) FILTER (a <= cutoff) AS known_at_cutoff, count(*) FILTER (a > cutoff) AS violations, {r('count(*) FILTER (a <= cutoff) / count(*)', 'known_rate')} FROM f
UNION ALL SELECT 'odds', count(*), count(b), count(*) FILTER (b <= cutoff), count(*) FILTER (b > cutoff), round(count(*) FILTER (b <= cutoff) / count(*) + 1e-9, 6) FROM f""",
)
def _knownness_audit(t) -> DataFrame:
    f = scored(t.orders).withColumns(
        {"a": F.when(F.col("id") % 4 != 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")), "b": F.when(F.col("id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).when(F.col("id") % 5 == 1, F.col("ts"))}
    )
    return rounded(A.knownness(f, {"injury": "a", "odds": "b"}, "ts"))


@query(
    "feed_latency",
    f"SELECT event_type AS feed, count(*) AS n, {rs({'mean': 'avg(value)', 'std': 'stddev_samp(value)', 'min': 'min(value)', 'max': 'max(value)', **{f'p{int(q * 100)}': f'quantile_cont(value, {q})' for q in (0.1, 0.25, 0.5, 0.75, 0.9)}})} FROM events GROUP BY 1",
)
def _feed_latency(t) -> DataFrame:
    return rounded(A.latency_summary(t.events.withColumnRenamed("event_type", "feed"), ["feed"], "value"))


@query(
    "feed_arrivals",
    f"""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(ts) AS first_arrival, max(ts) AS last_arrival, count(*) AS rows, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS categories,
  round(round((epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY) - epoch_us(max(ts))) / 60e6, 3) + 1e-6, 3) AS minutes_to_start FROM events GROUP BY user_id, CAST(ts AS DATE)""",
)
def _feed_arrivals(t) -> DataFrame:
    e = t.events.withColumns({"day": F.to_date("ts").cast("string"), "start": F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")})
    out = A.arrival_summary(e, ["user_id", "day"], "ts", "start", "event_type").drop("start")
    return out.withColumn("minutes_to_start", rd("minutes_to_start", 3))


@query(
    "label_audit",
    f"""WITH e AS (SELECT abs(l_linenumber / (l_quantity + 1e-6) * l_quantity - CASE WHEN l_partkey % 400 = 0 THEN l_linenumber + 1 ELSE l_linenumber END) AS e FROM lineitem)
SELECT 'rate' AS label, count(*) AS n_with_opp, 0 AS null_labels, CASE WHEN avg((e > 0.25)::INT) <= 0.01 AND avg((e > 0.5)::INT) <= 0.001 THEN 1 ELSE 0 END AS passed, {rs({'mae': 'avg(e)', 'max_abs_err': 'max(e)', 'share_gt_quarter': 'avg((e > 0.25)::INT)', 'share_gt_half': 'avg((e > 0.5)::INT)', 'p95': 'quantile_cont(e, 0.95)', 'p99': 'quantile_cont(e, 0.99)'})} FROM e""",
)
def _label_audit(t) -> DataFrame:
    base = t.lineitem.selectExpr("l_linenumber / (l_quantity + 1e-6D) AS rate", "l_quantity AS opp", "CASE WHEN l_partkey % 400 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS cnt")
    return rounded(A.label_audit(base, "rate", "opp", "cnt"))


@query(
    "chain_diagnostics",
    f"""WITH {S} SELECT 'p' AS "column", count(p) AS non_null, {rs({'mean': 'avg(p)', 'p10': 'quantile_cont(p, 0.1)', 'p50': 'median(p)', 'p90': 'quantile_cont(p, 0.9)', 'non_null_share': 'count(p) / count(*)'})} FROM s
UNION ALL SELECT 'gate', count(*), {', '.join(f'round({e} + 1e-9, 6)' for e in ('avg((p > 0.4)::INT)', 'quantile_cont((p > 0.4)::INT, 0.1)', 'median((p > 0.4)::INT)', 'quantile_cont((p > 0.4)::INT, 0.9)', '1.0'))} FROM s""",
)
def _chain_diagnostics(t) -> DataFrame:
    s = scored(t.orders).withColumn("gate", F.when(F.col("p") > 0.4, 1).otherwise(0))
    return rounded(A.chain_diagnostics(s, ["p"], ["gate"]))


@query(
    "weekly_monitor",
    f"""WITH {S}, rk AS (SELECT *, rank() OVER (PARTITION BY season, week ORDER BY p) + (count(*) OVER (PARTITION BY season, week, p) - 1) / 2.0 AS r FROM s)
SELECT season, week, count(*) AS n, {rs({'positive_rate': 'avg(y)', 'brier': 'avg((p - y) * (p - y))', 'auc': AUC, 'fallback_rate': "avg((status = 'P')::INT)", 'mean_interval_width': 'avg(p2)'})} FROM rk GROUP BY ALL""",
)
def _weekly_monitor(t) -> DataFrame:
    s = scored(t.orders).withColumn("source", F.when(F.col("status") == "P", "heuristic").otherwise("model"))
    return rounded(A.weekly_monitor(s, ["season", "week"], "p", "y", "source", "p2").drop("log_loss", "average_precision"))


@query(
    "hit_rate_by_flag",
    f"""WITH {S}, l AS (SELECT y, unnest([{{'flag': 'late', 'value': (week > 6)::INT}}, {{'flag': 'final', 'value': (status = 'F')::INT}}]) AS e FROM s) SELECT e.flag AS flag, e.value AS value, count(*) AS n, {r('avg(y)', 'hit_rate')} FROM l GROUP BY ALL""",
)
def _hit_rate_by_flag(t) -> DataFrame:
    s = scored(t.orders).withColumns({"late": F.when(F.col("week") > 6, 1).otherwise(0), "final": F.when(F.col("status") == "F", 1).otherwise(0)})
    return rounded(A.hit_rate_by_flag(s, ["late", "final"], "y"))


@query("hit_rate_by_bucket", f"WITH {S}, {edges_sql('price', 4)} SELECT {bucket_sql('price')} AS bucket, count(*) AS n, min(price) AS low, max(price) AS high, {r('avg(y)', 'hit_rate')} FROM s GROUP BY 1")
def _hit_rate_by_bucket(t) -> DataFrame:
    out = A.hit_rate_by_bucket(scored(t.orders), "price", "y", 4)
    return out.withColumn("hit_rate", rd("hit_rate"))


_SCAN = f"{S}, k AS (SELECT *, ((p > 0.4)::INT <> y)::INT AS err, CAST(season AS VARCHAR) AS se FROM s)"
_SCAN_COLS = f"count(*) AS count, {rs({'error_rate': 'avg(err)', 'avg_prob': 'avg(p)', 'actual_rate': 'avg(y)', 'bias': 'avg(p) - avg(y)'})}"


def _scan(t) -> DataFrame:
    return scored(t.orders).withColumns({"err": F.when((F.col("p") > 0.4).cast("int") != F.col("y"), 1).otherwise(0), "se": F.col("season").cast("string")})


@query(
    "bucket_scan_single",
    f"""WITH {_SCAN} SELECT 'segment' AS feature, segment AS bucket, {_SCAN_COLS} FROM k GROUP BY 2 HAVING count(*) >= 50 UNION ALL SELECT 'status', status, {_SCAN_COLS} FROM k GROUP BY 2 HAVING count(*) >= 50 UNION ALL SELECT 'se', se, {_SCAN_COLS} FROM k GROUP BY 2 HAVING count(*) >= 50""",
)
def _bucket_scan_single(t) -> DataFrame:
    return rounded(A.bucket_scan(_scan(t), ["segment", "status", "se"], "err", "p", "y", 1))


@query(
    "bucket_scan_pairs",
    f"""WITH {_SCAN} SELECT 'segment+status' AS feature, segment || '|' || status AS bucket, {_SCAN_COLS} FROM k GROUP BY 2 HAVING count(*) >= 50 UNION ALL SELECT 'segment+se', segment || '|' || se, {_SCAN_COLS} FROM k GROUP BY 2 HAVING count(*) >= 50
UNION ALL SELECT 'status+se', status || '|' || se, {_SCAN_COLS} FROM k GROUP BY 2 HAVING count(*) >= 50""",
)
def _bucket_scan_pairs(t) -> DataFrame:
    return rounded(A.bucket_scan(_scan(t), ["segment", "status", "se"], "err", "p", "y", 2))


@query(
    "history_volume_bias",
    f"""WITH {_SCAN}, v AS (SELECT cust, count(*) AS n, avg(err) AS e FROM k GROUP BY 1) SELECT CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 WHEN n < 15 THEN 2 ELSE 3 END AS bucket, {r('avg(e)', 'error_rate')}, count(*) AS n FROM v GROUP BY 1""",
)
def _history_volume_bias(t) -> DataFrame:
    from ..operators.keys import attach_totals

    base = attach_totals(_scan(t), "cust", {"volume": F.count(F.lit(1))})
    return rounded(A.history_bias(base, "volume", "err", (0, 5, 10, 15, 1e9), "cust"))


@query("user_expressions", f"WITH {S} SELECT id, price / 1000 AS kprice, CASE WHEN p > 0.5 THEN 'high' ELSE 'low' END AS band FROM s")
def _user_expressions(t) -> DataFrame:
    return A.add_expressions(scored(t.orders), {"kprice": "price / 1000", "band": "CASE WHEN p > 0.5 THEN 'high' ELSE 'low' END"}).select("id", "kprice", "band")


# --- associations -----------------------------------------------------------------------------------


@query(
    "ks_distance",
    f"""WITH {S}, d AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM s GROUP BY p), c AS (SELECT sum(a) OVER (ORDER BY p) AS ca, sum(b) OVER (ORDER BY p) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM d)
SELECT {r('max(abs(ca / na - cb / nb))', 'ks')}, CAST(max(na) AS BIGINT) AS n_pos, CAST(max(nb) AS BIGINT) AS n_neg FROM c""",
)
def _ks_distance(t) -> DataFrame:
    out = A.ks_distance(scored(t.orders), "p", "y").select("ks", "n_pos", "n_neg")
    return rounded(out.withColumns({c: F.col(c).cast("bigint") for c in ("n_pos", "n_neg")}))


@query(
    "cramers_v",
    f"""WITH {S}, o AS (SELECT segment AS a, status AS b, CAST(count(*) AS DOUBLE) AS o FROM s GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM o),
x AS (SELECT any_value(n) AS n, any_value(n) * (sum(o * o / (ra * cb)) - 1) AS chi2, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM m),
z AS (SELECT *, greatest(chi2 / n - (k - 1) * (r - 1) / (n - 1), 0) AS phi, r - (r - 1) * (r - 1) / (n - 1) AS rc, k - (k - 1) * (k - 1) / (n - 1) AS kc FROM x)
SELECT n, r, k, CAST((r - 1) * (k - 1) AS INT) AS dof, {rs({'chi2': 'chi2', 'cramers_v': 'sqrt(phi / greatest((rc - 1) * (kc - 1), 1e-12))', 'score': 'chi2 / ((r - 1) * (k - 1))'}, 5)} FROM z""",
)
def _cramers_v(t) -> DataFrame:
    return rounded(A.crosstab_statistics(scored(t.orders), "segment", "status").drop("p_value"), 5)


@query(
    "spearman",
    f"""WITH {S}, k AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS a, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS b FROM s) SELECT {r('corr(a, b)', 'rho')}, count(*) AS n FROM k""",
)
def _spearman(t) -> DataFrame:
    return A.spearman(scored(t.orders), "price", "p2").select(rd("rho").alias("rho"), F.col("n").cast("bigint").alias("n"))


@query("separator_screen")
def _separator_screen(t) -> DataFrame:
    """Columns that separate the label, with test statistics and p-values (p-values are series)."""
    return A.screen_separators(scored(t.orders), "y", ["p", "p2", "guess", "segment", "status", "week"], alpha=0.05)


@query(
    "univariate_scores",
    f"""WITH {S}, z AS (SELECT 'p' AS feature, {r('abs(corr(p, y - p2))', 'score', 5)} FROM s UNION ALL SELECT 'guess', round(abs(corr(guess, y - p2)) + 1e-8, 5) FROM s) SELECT * FROM z""",
)
def _univariate_scores(t) -> DataFrame:
    s = scored(t.orders).withColumn("res", F.col("y") - F.col("p2"))
    return rounded(A.univariate_scores(s, "y", "res", ["p", "guess"]), 5)
