"""Plans, sources, sinks and streams."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import labels
from tidemark.functions.cutoff import CutoffPolicy
from tidemark.operators.prior import last_rows, prior_rows
from tidemark.plans import asof_metadata as AM
from tidemark.plans import features as FP
from tidemark.schema import conform, missing_columns, schema_drift, schema_hash, schema_snapshot, union_relaxed
from tidemark.sources import readers, writers
from tidemark.streaming import streams


def test_serving_equals_training(spark):
    """A scaffold row gets the features the same event gets once it is history."""
    data = [("a", d, float(d * d)) for d in range(1, 9)] + [("b", 1, 2.0), ("c", 7, 1.0)]
    full = spark.createDataFrame(data, "k string, d int, x double")

    def step(df):
        return prior_rows(df, "k", "d", 3, lambda w: {"m": F.avg("x").over(last_rows(w, 3)), "p": F.lag("x").over(w)})

    trained = {(r["k"], r["d"]): (r["m"], r["p"]) for r in rows(step(full))}
    served = FP.history_and_scaffold(full.where("d < 7"), full.where("d = 7").select("k", "d"), step)
    for r in rows(served):
        assert (r["m"], r["p"]) == trained[(r["k"], r["d"])]


def test_baseline_sources(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", None)], "player_id string, ps double")
    base = spark.createDataFrame([("b", 1, 5.0), ("b", 2, 7.0)], "player_id string, d int, ps double")
    got = rows(FP.with_baseline(df, base, "player_id", ["ps"], ["d"]), "player_id")
    assert [(r["ps"], r["ps_source"]) for r in got] == [(1.0, "actual"), (7.0, "baseline"), (None, "none")]


def test_asof_metadata_share_before_cutoff(spark):
    start = dt.datetime(2024, 9, 8, 17)
    games = spark.createDataFrame([("g1", 2024, 1, start.date(), start), ("g2", 2024, 1, start.date(), None)], "game_id string, season int, week int, game_date date, game_start_utc timestamp")
    hours = lambda h: start - dt.timedelta(hours=h)
    injuries = spark.createDataFrame([("g1", hours(20)), ("g1", hours(6)), ("g1", hours(5))], "game_id string, reported_at timestamp")
    odds = spark.createDataFrame([("g1", hours(1))], "game_id string, odds_snapshot_ts timestamp")
    got = {r["game_id"]: r for r in rows(AM.build_asof_metadata(games, injuries=injuries, odds=odds, policy=CutoffPolicy()))}
    assert got["g1"]["injury_snapshot_ts"] == hours(6) and got["g1"]["injury_reports_used"] == 2
    assert got["g1"]["odds_snapshot_ts"] is None and got["g2"]["injury_snapshot_source"] == "none"
    assert got["g2"]["cutoff_ts"] == dt.datetime(2024, 9, 6, 12)
    attached = AM.attach_asof_metadata(games.select("game_id"), AM.build_asof_metadata(games, injuries=injuries), ["injury_snapshot_ts"], drop_rows=True)
    assert [r["game_id"] for r in rows(attached)] == ["g1"]


def test_serve_snap_history_is_strictly_before(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    hist = spark.createDataFrame([("a", day(1), 10.0, 1), ("a", day(8), 20.0, None), ("a", day(15), 30.0, 3)], "p string, ts timestamp, snaps double, depth_chart_order int")
    now = spark.createDataFrame([("a", day(15))], "p string, ts timestamp")
    got = rows(FP.serve_snap_history(now, hist, "p", "ts", {"prev": "snaps"}))[0]
    assert (got["prev"], got["days_since_last_event"], got["depth_chart_order_prev"]) == (20.0, 7.0, 1)


def test_feature_matrix_end_to_end(spark, tmp_path):
    data = []
    for week in range(1, 6):
        for i in range(12):
            data.append((2024, week, f"g{week}", dt.date(2024, 9, week), "A" if i % 2 else "B", "B" if i % 2 else "A", f"q{i % 2}", f"w{i % 4}", 1, 1 if i % 3 == 0 else 0, 50, 7, 1))
    plays = spark.createDataFrame(data, "season int, week int, game_id string, game_date date, posteam string, defteam string, passer_player_id string, receiver_player_id string, pass int, pass_touchdown int, yardline_100 int, yards_gained int, complete_pass int")
    from tidemark.functions import plays as P

    for step in (P.with_role_indicators, P.with_masked_yards, P.with_credit, P.with_zone_usage):
        plays = plays.transform(step)
    plays = plays.withColumns({"air_yards": F.lit(5.0), "yards_after_catch": F.lit(2.0), "rusher_player_id": F.lit(None).cast("string"), "rush_touchdown": F.lit(0)})
    positions = spark.createDataFrame([(f"w{i}", "WR") for i in range(4)] + [("q0", "QB"), ("q1", "QB")], "player_id string, position string")
    out = FP.feature_matrix(plays, positions=positions, policy=CutoffPolicy(horizons=(1.5, 6.0)), snapshot_path=str(tmp_path / "schema"))
    assert not set(out.columns) & (set(labels.SAME_EVENT) - {"td_count"})
    rolled = [c for c in out.columns if "_per_game" in c]
    stats = [c for c in FP.ROLLED if f"1g_{c}_per_game" in rolled]
    assert {"touchdowns", "target", "carry", "receiving_yards", "red_zone_target"} <= set(stats)
    assert sorted(rolled) == sorted(f"{w}_{s}_per_game{e}" for w in ("1g", "3g", "5g", "season", "lifetime") for s in stats for e in ("", "_with_team", "_vs_team"))
    written = json.loads(spark.read.text(str(tmp_path / "schema")).first()["value"])
    assert written["label_version"] == "v1_any_offense" and "1g_target_per_game" in written["columns"]
    got = rows(out.where("player_id = 'w0' and decision_horizon_hours = 6.0"), "week")
    assert len(got) == 5 and got[0]["1g_target_per_game"] is None and got[1]["1g_target_per_game"] == 3.0
    assert {"team_ctx_pass_rate_l3", "wr_snap_trend" if "snap_offense_pct_prev" in out.columns else "position_group", "anytime_td"} <= set(out.columns)
    assert out.count() == 2 * 5 * 6
    # Against one opponent a rate needs four earlier games.
    assert [r["1g_target_per_game_vs_team"] for r in got] == [None, None, None, None, 3.0]


def test_schema_helpers(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2.5, 3)], "a double, c int")
    got = rows(union_relaxed(a, b))
    assert got == [{"a": 1.0, "b": "x", "c": None}, {"a": 2.5, "b": None, "c": 3}]
    assert schema_hash(a) == schema_hash(a.select("b", "a")) != schema_hash(a.withColumn("a", F.col("a").cast("long")))
    drift = schema_drift(a, T.StructType([T.StructField("a", T.LongType()), T.StructField("z", T.StringType())]))
    assert drift.changed and drift.added == ["b"] and drift.removed == ["z"] and drift.retyped == ["a"]
    assert missing_columns(a, ["a", "q"], ["b", "o"]) == {"missing_required": ["q"], "missing_optional": ["o"], "unexpected": []}
    assert '"tag": "label"' in schema_snapshot(a, {"a": "label"})
    assert conform(a, T.StructType([T.StructField("z", T.DateType()), T.StructField("a", T.StringType())])).dtypes == [("z", "date"), ("a", "string")]


def test_partition_replace_and_union_read(spark, tmp_path):
    path = str(tmp_path / "weekly")
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "season int, week int, v string")
    writers.write_partitions(df, path)
    writers.write_partitions(df.where("season = 1 and week = 1").withColumn("v", F.lit("z")), path)
    assert sorted(r["v"] for r in rows(readers.read_partitioned(spark, path))) == ["b", "c", "z"]
    assert readers.only_seasons(readers.read_partitioned(spark, path), [2]).count() == 1
    assert readers.seasons_of(df) == [1, 2] and readers.latest_date(df, "week") == 2
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    df.write.parquet(one)
    df.withColumn("season", F.col("season").cast("string")).withColumn("n", F.lit(1)).write.parquet(two)
    assert dict(readers.read_union(spark, [one, two]).dtypes) == {"season": "string", "week": "int", "v": "string", "n": "int"}


def test_text_sources(spark, tmp_path):
    csv = tmp_path / "plays.csv"
    csv.write_text("game_id,season,down\ng1,2024,3\ng2,2023,\n")
    schema = T.StructType([T.StructField("game_id", T.StringType()), T.StructField("season", T.IntegerType()), T.StructField("down", T.IntegerType())])
    assert [r["down"] for r in rows(readers.read_plays_csv(spark, str(csv), schema), "game_id")] == [3, None]
    assert readers.read_predictions(spark, str(csv)).count() == 2
    feed = tmp_path / "tx.json"
    feed.write_text('{"date": "2024-02-01", "player_raw": "A B", "notes": "x"}\n{"date": "2024-09-01", "player_raw": "C"}\n{"date": null}\n')
    got = rows(readers.read_transactions(spark, str(feed)), "transaction_date")
    assert [r["season"] for r in got] == [2023, 2024]


def test_append_upsert_and_outputs(spark, tmp_path):
    path = str(tmp_path / "cache")
    day = lambda d: dt.date(2024, 1, d)
    first = spark.createDataFrame([("a", day(1), 1)], "player_id string, date date, n int").withColumn("ctx", F.lit("vs_any"))
    late = spark.createDataFrame([("a", day(1), 99), ("a", day(2), 2)], "player_id string, date date, n int").withColumn("ctx", F.lit("vs_any"))
    writers.append_missing_days(first, path)
    assert writers.append_missing_days(late, path).count() == 1
    got = rows(writers.read_cache(spark, path, "2024-01-01", "2024-01-02", first, "player_id", "vs_any"), "date")
    assert [r["n"] for r in got] == [1, 2]
    old = spark.createDataFrame([("k", 1, "old"), ("l", 1, "keep")], "id string, v int, x string")
    new = spark.createDataFrame([("k", 1, "new")], "id string, v int, x string")
    assert [r["x"] for r in rows(writers.upsert(old, new, "id", [F.col("v")]), "id")] == ["new", "keep"]
    for run in ("a", "b", "a"):
        writers.append_history(new, str(tmp_path / "hist"), run=run)
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 2
    writers.write_matrix(spark.createDataFrame([(1.5, 6.0)], "f double, decision_horizon_hours double"), str(tmp_path / "m"))
    assert dict(spark.read.parquet(str(tmp_path / "m")).dtypes)["f"] == "float"
    preds = spark.createDataFrame([("b", 0.2, 0.9), ("a", 0.8, 0.1)], "player_name string, pred_anytime_td double, pred_anytime_td_structured_moe double")
    out = rows(writers.format_output(preds, "pred_anytime_td", 0.5))
    assert [(r["player_name"], r["prediction"]) for r in out] == [("b", 0), ("a", 1)]
    writers.write_csv(preds, str(tmp_path / "p.csv"))
    assert readers.read_predictions(spark, str(tmp_path / "p.csv")).count() == 2


def _write_events(spark, folder, data):
    spark.createDataFrame(data, "id int, k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(folder)


EVENTS = "id int, k string, ts timestamp, v double"


def test_stream_late_rows(spark, tmp_path):
    """A late row inside the watermark updates its day; one beyond it is dropped and counted."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        totals = streams.daily_totals_stream(streams.file_stream(spark, src, schema), "k", "ts", ["v"], "1 day")
        return streams.run_to_end(streams.run_upsert(totals, out, check, ["k", "date"], ["date"]))

    _write_events(spark, src, [(1, "a", at(1), 1.0), (2, "a", at(3), 5.0)])
    run()
    _write_events(spark, src, [(3, "a", at(2, 12), 2.0), (4, "a", at(3, 1), 1.0)])
    run()
    _write_events(spark, src, [(5, "a", at(1, 5), 100.0), (6, "a", at(5), 1.0)])
    query = run()
    got = {r["date"].day: (r["v_num"], r["denom"]) for r in rows(spark.read.parquet(out))}
    assert got == {1: (1.0, 1), 2: (2.0, 1), 3: (6.0, 2), 5: (1.0, 1)}
    assert streams.dropped_rows(query) == 1


def test_stream_dedupe_and_join(spark, tmp_path):
    src = str(tmp_path / "src")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    _write_events(spark, src, [(1, "a", at(1), 1.0), (2, "a", at(2), 2.0), (3, "b", at(3), 3.0)])
    schema = spark.createDataFrame([], EVENTS).schema
    feed = streams.file_stream(spark, src, schema)

    def collect(df, name):
        out, check = str(tmp_path / name), str(tmp_path / f"{name}-check")
        df.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return rows(spark.read.parquet(out))

    assert sorted(r["k"] for r in collect(streams.first_version_stream(feed, ["k"], "ts", "1 day"), "dedupe")) == ["a", "b"]
    left = feed.select(F.col("id").alias("lid"), "k", F.col("ts").alias("lts"))
    right = feed.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    pairs = collect(streams.known_before_stream(left, right, "k", "lts", "rts", "6 hours"), "join")
    assert sorted((r["lid"], r["rid"]) for r in pairs) == [(1, 1), (2, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("kind, columns", [("rosters", "season int, week int, team string, player_id string, status string")])
def test_dimension_is_normalised(spark, kind, columns):
    df = spark.createDataFrame([(2024, 1, " oak ", "p", " act "), (2024, 1, "OAK", "p", "ACT"), (2023, 1, "SF", "q", ""), (2024, 1, "SF", None, "x")], columns)
    got = rows(readers.prepare_dimension(df, kind, [2024], {"OAK": "LV"}))
    assert [(r["team"], r["status"]) for r in got] == [("LV", "ACT")]
