"""The stage graph of the feature matrix, stored state of windows and as-of joins, hashed upserts and late days."""

import datetime as dt
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.labels import SAME_EVENT
from tidemark.operators.asof import asof_join
from tidemark.operators.prior import rolling_ratios
from tidemark.plans import features as FP
from tidemark.plans import matrix as M
from tidemark.plans.incremental import RollingStore, SeededHistory
from tidemark.queries import matrix as Q
from tidemark.queries.registry import Tables
from tidemark.streaming import streams


def games(spark):
    rng = random.Random(3)
    data = []
    for player in range(6):
        for k in range(25):
            day = dt.date(2023, 12, 1) + dt.timedelta(days=rng.randint(0, 60))
            data.append((f"p{player}", day, day.year, rng.choice("AB"), rng.choice("CDE"), f"g{k}", rng.choice([None, 0, 1, 5]), rng.randint(0, 3)))
    return spark.createDataFrame(data, "player_id string, game_date date, season int, team string, opponent string, game_id string, target int, carry int")


def test_rolling_in_place_equals_joined_contexts(spark):
    """Several games of one day, two seasons, nulls: the same ratios without a join."""
    df = games(spark).cache()
    wanted = FP.with_rolling(df, ["target", "carry"])
    got = M.rolling_in_place(df, ["target", "carry"])
    assert set(got.columns) == set(wanted.columns)
    made = sorted(c for c in got.columns if c.endswith(("per_game", "_with_team", "_vs_team")))
    key = ["player_id", "game_date", "game_id", "team", "opponent"]

    def table(frame):
        return sorted((tuple(str(r[k]) for k in key), [None if r[c] is None else round(r[c], 9) for c in made]) for r in frame.collect())

    assert table(got) == table(wanted)


def exchanges(df) -> list[str]:
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_player_stages_move_no_row_again(spark):
    """Over the written grain, games and all windows of a player run without an exchange, and so does the next write."""
    df = games(spark).withColumns({"week": F.month("game_date"), "player_name": F.lit(None).cast("string"), "drive": F.lit(1), "touchdowns": F.lit(0)})
    grain = M.write_grain(df, "test_drive", "player_id")
    played = M.player_games(grain)
    out = M.rolling_in_place(played)
    assert not exchanges(out), exchanges(out)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(exchanges(out.repartition(buckets, "player_id"))) == 0
    both = out.alias("a").join(grain.select(F.col("player_id").alias("p"), F.col("game_id").alias("g")), (F.col("player_id") == F.col("p")) & (F.col("game_id") == F.col("g")))
    assert all("Broadcast" in x for x in exchanges(both)), exchanges(both)
    M.drop_grains(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]


def test_games_of_a_player_are_summed_without_sorting_drives(spark):
    rng = random.Random(5)
    data = [(2020, rng.randint(1, 2), rng.choice([None, 1, 2, 3]), None, rng.choice("ab"), None, rng.choice([None, 7, 8]), rng.choice([None, "A", "B"]), rng.choice(["X", "Y"]), rng.randint(0, 1), rng.choice([None, 2.0]), rng.randint(0, 1)) for _ in range(300)]
    drives = spark.createDataFrame(data, "season int, week int, game_id long, game_date date, player_id string, player_name string, drive long, team string, opponent string, target long, receiving_yards double, touchdowns long")
    for rows in (drives, drives.drop("drive")):
        wanted = {}
        for r in rows.collect():
            wanted.setdefault((r["week"], r["game_id"], r["player_id"]), []).append(r)
        found = {(r["week"], r["game_id"], r["player_id"]): r for r in M.player_games(rows).collect()}
        assert found.keys() == wanted.keys()
        least = lambda of, c: min((r[c] for r in of if r[c] is not None), default=None)
        for k, of in wanted.items():
            got, yards = found[k], [r["receiving_yards"] for r in of if r["receiving_yards"] is not None]
            assert [got["team"], got["opponent"], got["target"], got["touchdowns"]] == [least(of, "team"), least(of, "opponent"), sum(r["target"] for r in of), sum(r["touchdowns"] for r in of)]
            assert got["receiving_yards"] == (sum(yards) if yards else None)
            if "drive" in rows.columns:
                by = {d: [r for r in of if r["drive"] == d] for d in {r["drive"] for r in of}}
                assert [got["drive_count"], got["drive_touch_drives"], got["drive_td_drives"]] == [len(by), *[sum(any(r[c] for r in x) for x in by.values()) for c in ("target", "touchdowns")]]
    lines = M.player_games(drives)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [("partial_min(team" in x) for x in lines if "Aggregate(" in x and "min(team" in x] == [False, True]
    assert not any("SortAggregate" in x and "drive" in x.split("functions=")[0] for x in lines)


def test_plays_by_game_become_drives_and_games_in_place(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(M, "BUCKET_ROWS", 4000)
    spark.conf.set("spark.tidemark.hot.floor", "2000000")
    plays = Q.feeds(Tables(spark, sf)).plays
    drives = M.player_drives(plays)
    buckets = M.buckets_of(drives, "game_id")
    assert buckets and buckets > int(spark.conf.get("spark.sql.shuffle.partitions")) and not exchanges(drives)
    grain = M.write_grain(drives, "test_drive", "game_id")
    assert M.buckets_of(grain.groupBy("game_id", "drive").count(), "game_id") == buckets
    assert not exchanges(M.player_games(grain))
    # A hot game stays spread, with the same rows.
    spark.conf.set("spark.tidemark.hot.floor", "1")
    spread = Q.feeds(Tables(spark, sf)).plays
    assert M.buckets_of(M.player_drives(spread), "game_id") is None
    assert spread.exceptAll(plays).isEmpty() and plays.exceptAll(spread).isEmpty()
    M.drop_grains(spark)


def test_few_games_lie_in_few_buckets(spark, sf, monkeypatch):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    laid = {}
    keep = M.write_grain
    monkeypatch.setattr(M, "write_grain", lambda df, name, key, *a, **k: laid.setdefault(name, (keep(df, name, key, *a, **k), k.get("buckets")))[0])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(4 * cores))
        M.player_stage(Q.feeds(Tables(spark, sf)), "v1_any_offense")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert {n: b for n, (_, b) in laid.items() if n in ("games", "snaps", "positions", "player_game")} == {n: cores for n in ("games", "snaps", "positions", "player_game")}
    assert laid["player_game"][0].count() == laid["games"][0].count() > 0
    M.drop_grains(spark)


def test_matrix_is_guarded_and_has_every_stage(spark, sf, tmp_path):
    from tidemark.functions.cutoff import CutoffPolicy

    feeds = Q.feeds(Tables(spark, sf))
    out = M.matrix(feeds, CutoffPolicy(drop_missing_snapshots=False), snapshot_path=str(tmp_path / "schema"))
    names = set(out.columns)
    assert not names & (set(SAME_EVENT) - {"td_count"}) and set(Q.SHOWN) <= names and {"decision_horizon_hours", "anytime_td", "game_day_of_week"} <= names
    assert len(out.columns) > 500 and out.select("player_id", "game_id").distinct().count() == out.select("player_id").count() > 0
    assert os.listdir(tmp_path / "schema") == ["h06h"]


def files_read(df) -> set[str]:
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def daily(spark, days=40, users=7):
    rng = random.Random(9)
    data = [(f"u{u}", dt.date(2023, 12, 10) + dt.timedelta(days=d), float(rng.randint(0, 9)), rng.randint(1, 4)) for u in range(users) for d in range(days) if rng.random() < 0.5]
    return spark.createDataFrame(data, "user string, day date, v double, denom int").withColumn("season", F.year("day")).cache()


def one_pass(df):
    out = rolling_ratios(df, ["user"], "day", {"v": ("v", "denom")}, (1, 3, 5), {"season": "season"})
    return {(r["user"], r["day"]): [None if r[c] is None else round(r[c], 9) for c in ("v_l1", "v_l3", "v_l5", "v_season", "v_lifetime")] for r in out.collect()}


def stored(store):
    names = ("v_l1_ratio", "v_l3_ratio", "v_l5_ratio", "v_season_ratio", "v_lifetime_ratio")
    return {(r["user"], r["day"]): [None if r[c] is None else round(r[c], 9) for c in names] for r in store.features().collect()}


def test_days_in_any_order_equal_one_pass(spark, tmp_path):
    df, first = daily(spark), dt.date(2023, 12, 10)
    store = RollingStore(spark, str(tmp_path / "rolling"), "user", ["v"])
    spans = [(0, 10), (10, 20), (30, 36), (20, 30), (36, 40), (12, 13)]  # the fourth comes late, the last again
    starts = []
    for a, b in spans:
        part = df.where((F.col("day") >= first + dt.timedelta(days=a)) & (F.col("day") < first + dt.timedelta(days=b)))
        starts.append(store.add_days(part))
    assert starts[0] is None and starts[3] < first + dt.timedelta(days=20) and starts[4] >= first + dt.timedelta(days=30)
    assert stored(store) == one_pass(df)
    assert store.add_days(df.where("day is null")) is None


def test_a_new_day_reads_no_old_one(spark, tmp_path):
    df, first = daily(spark), dt.date(2023, 12, 10)
    store = RollingStore(spark, str(tmp_path / "rolling"), "user", ["v"])
    store.add_days(df.where(F.col("day") < first + dt.timedelta(days=30)))
    start = store.start_of(first + dt.timedelta(days=30))
    store.add_days(df.where(F.col("day") >= first + dt.timedelta(days=30)))
    read = {f.split("day=")[1][:10] for f in files_read(store.pending(start))}
    assert read and min(read) > start.isoformat()
    plan = store.rolled(start)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len([x for x in plan.splitlines() if "hashpartitioning" in x]) <= 2


def test_seeded_history_equals_whole_history(spark, tmp_path):
    rng = random.Random(4)
    at = dt.datetime(2024, 1, 1)
    feed = [(f"k{rng.randint(0, 9)}", at + dt.timedelta(minutes=rng.randint(0, 30 * 1440)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(600)]
    ask = [(i, f"k{rng.randint(0, 10)}", at + dt.timedelta(minutes=rng.randint(0, 30 * 1440))) for i in range(300)]
    feed = spark.createDataFrame(feed, "k string, fts timestamp_ntz, v double")
    ask = spark.createDataFrame(ask, "i long, k string, ts timestamp_ntz")
    held = SeededHistory(spark, str(tmp_path / "feed"), "k", "fts", ["v"])
    for a, b in ((1, 8), (8, 12), (12, 25), (25, 31), (9, 11)):  # the last days come again
        held.add(feed.where(F.dayofmonth("fts").between(a, b - 1)))
    wanted = {r["i"]: (r["v"], r["m"]) for r in asof_join(ask, feed, "k", "ts", "fts", ["v"], matched_ts="m").collect()}
    got = {}
    for a, b in ((1, 10), (10, 14), (14, 31)):
        part = ask.where(F.dayofmonth("ts").between(a, b - 1))
        got |= {r["i"]: (r["v"], r["matched_ts"]) for r in held.attach(part, "ts").collect()}
    assert got == {i: w for i, w in wanted.items() if i in got} and len(got) >= 290
    files = files_read(held.known_to(dt.date(2024, 1, 26), dt.date(2024, 1, 27)))
    days = sorted(f.split("day=")[1][:10] for f in files if "day=" in f)
    assert days[0] >= "2024-01-25" and days[-1] <= "2024-01-27" and len([f for f in files if "seed=" in f]) >= 1


def test_bucket_upsert_rewrites_only_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("version"), F.lit("a").alias("v"))
    streams.upsert_buckets(first, path, ["k"], 64, [F.col("version")])

    def files():
        return {b: tuple(sorted(os.listdir(f"{path}/{b}"))) for b in os.listdir(path) if b.startswith("_bucket=")}

    before = files()
    some = spark.createDataFrame([(3, 2, "b"), (1999, 2, "b"), (5000, 1, "c"), (4, 0, "old")], "k long, version int, v string")
    streams.upsert_buckets(some, path, ["k"], 64, [F.col("version")])
    changed = [b for b in before if files()[b] != before[b]]
    assert len(before) == 64 and 1 <= len(changed) <= 4
    out = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(out) == 2001 and (out[3], out[1999], out[5000], out[4], out[7]) == ("b", "b", "c", "a", "a")
    assert [streams.bucket_count(n, 10) for n in (0, 10, 11, 20, 21, 80, 81)] == [1, 1, 2, 2, 4, 8, 16]


def test_repair_sums_late_days_anew(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    feed, out, late = (str(tmp_path / n) for n in ("feed", "out", "late"))
    schema = "u long, ts timestamp_ntz, v long"
    files = [[(1, at, 1), (2, at, 2)], [(1, at + dt.timedelta(days=9), 3)], [(2, at + dt.timedelta(days=10), 4)], [(1, at, 10), (3, at + dt.timedelta(days=10), 5)], [(2, at, 20)]]
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
    raw = spark.read.parquet(feed)
    stream = streams.file_stream(spark, feed, raw.schema, files_per_batch=1)
    totals = streams.daily_totals_stream(stream, "u", "ts", ["v"], delay="1 day")
    query = streams.run_to_end(streams.run_upsert(totals, out, str(tmp_path / "c1"), ["u", "date"], ["date"]))
    assert streams.dropped_rows(query) >= 1
    streams.run_to_end(streams.late_rows_stream(stream, "ts", 86400, late, str(tmp_path / "c2")))
    held = spark.read.parquet(f"{late}/rows")
    for _ in range(2):  # a repair may run again
        streams.repair_days(raw, held, out, "u", "ts", ["v"])
    got = {(r["u"], r["date"].day): (r["v_num"], r["denom"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1): (11, 2), (2, 1): (22, 2), (1, 10): (3, 1), (2, 11): (4, 1), (3, 11): (5, 1)}
    streams.repair_days(raw, None, out, "u", "ts", ["v"])
    streams.repair_days(raw, held.where("u < 0"), out, "u", "ts", ["v"])
    assert len(rows(spark.read.parquet(out))) == 5


@pytest.mark.parametrize("name", ["season", "week"])
def test_position_rates_carry_positions_in_a_map(spark, name):
    df = spark.createDataFrame([(2024, w, "A", g, int(w % 2 == (g == "RB"))) for w in range(1, 6) for g in ("RB", "WR")], "season int, week int, team string, position_group string, hit int")
    out = rows(M.position_rates(df, "hit", ["team"], "team_hit").orderBy("week"))
    assert name in out[0] and out[4]["team_hit_by_position"]["RB"]["team_hit_rate_2"] == 0.5 and out[0]["team_hit_rate_1"] is None and out[4]["team_hit_rate_1"] == 1.0


def test_chained_stateful_as_of_emits_matched_and_unmatched_rows(spark, tmp_path):
    """A left outer stream-stream join and a latest-of-key aggregate in one plan, stopped and started again."""
    at = dt.datetime(2024, 1, 1)
    hours = [
        ([(1, "a", 10), (2, "b", 11)], [("a", 8, 1.0), ("a", 9, 2.0), ("a", 10, 3.0), ("b", 12, 9.0)]),
        ([(3, "a", 30), (4, "c", 31)], [("a", 29, None)]),
        ([(99, "z", 500)], [("z", 500, 0.0)]),
        ([(100, "z", 900)], [("z", 900, 0.0)]),
    ]
    left, right, out = (str(tmp_path / n) for n in ("l", "r", "out"))
    for events, feed in hours:
        spark.createDataFrame([(i, k, at + dt.timedelta(hours=h)) for i, k, h in events], "i long, k string, ts timestamp_ntz").write.mode("append").parquet(left)
        spark.createDataFrame([(k, at + dt.timedelta(hours=h), v) for k, h, v in feed], "k string, fts timestamp_ntz, v double").write.mode("append").parquet(right)
        both = spark.readStream.schema("i long, k string, ts timestamp_ntz").parquet(left), spark.readStream.schema("k string, fts timestamp_ntz, v double").parquet(right)
        known = streams.latest_known_stream(*both, "k", "i", "ts", "fts", ["v"], "5 HOURS", "1 hour")
        streams.run_to_end(streams.append_stream(known, out, str(tmp_path / "check")))
    got = {r["i"]: (r["v"], None if r["matched_ts"] is None else (r["matched_ts"] - at).total_seconds() / 3600) for r in spark.read.parquet(out).where("i < 99").collect()}
    assert got == {1: (3.0, 10.0), 2: (None, None), 3: (None, 29.0), 4: (None, None)}
