"""Faults that only larger inputs show: sliced columns by any name, whole columns or pairs in one task, layouts of bounded tasks."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.evaluation import audits as A
from tidemark.operators import grains as G
from tidemark.operators import slices
from tidemark.plans import features as FP
from tidemark.queries import matrix
from tidemark.queries.registry import Tables


def physical(df):
    """The plan, as run where the frame was collected."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_correlation_of_sliced_columns(spark, hot):
    df = spark.range(400).select((F.col("id") * 7 % 389).alias("a"), (F.col("id") * F.col("id") % 211).alias("b"))
    spark.conf.set("spark.tidemark.hot.floor", "1000000")
    wanted = rows(A.spearman(df, "a", "b"))
    spark.conf.set("spark.tidemark.hot.floor", "20")
    found = rows(A.spearman(df, "a", "b"))
    assert found[0]["n"] == wanted[0]["n"] == 400 and found[0]["rho"] == pytest.approx(wanted[0]["rho"])


def test_fences_travel_to_the_rows(spark):
    df = spark.range(300).select((F.col("id") % 50).cast("double").alias("v"), F.when(F.col("id") == 7, 9e9).otherwise(F.col("id")).alias("w"))
    # Without statistics a join of the two aggregates would be dealt by column, all rows of one column to one task.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.numeric_profile(df, ["v", "w"])
        got = {r["column"]: r for r in rows(out)}
        plan = physical(A.numeric_profile(df, ["v", "w"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan
    assert got["w"]["outliers_high"] == 1 and got["v"]["outliers_high"] == 0 and got["w"]["extreme_high"] == 9e9


def shuffles(df):
    """Exchanges of the final plan of a collected frame, those that reuse another not counted."""
    return sum("Exchange" in line and "Broadcast" not in line and "Reused" not in line for line in physical(df).split("== Initial Plan ==")[0].splitlines())


def test_players_of_sides_move_only_the_sides(spark):
    sides = spark.createDataFrame([(g, w, t) for g in range(6) for w in (1, 2) for t in ("A", "B")] + [(None, 1, "A"), (9, None, "A"), (9, 1, "C")], "game_id long, week int, team string")
    roster = spark.createDataFrame([(1, "A", p) for p in range(5)] + [(2, "A", 1), (2, "B", 1), (1, "B", 9), (None, "A", 7)], "week int, team string, player_id long")
    wanted = sides.join(roster, ["week", "team"]).groupBy("player_id", "game_id").agg(F.min("team").alias("team"), F.countDistinct("team").alias("sides"))
    found = FP.players_of_sides(sides, roster, ["week", "team"]).groupBy("player_id", "game_id").agg(F.min("team").alias("team"), F.countDistinct("team").alias("sides"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert shuffles(found) == 1


def test_values_of_a_game_are_counted_in_one_aggregate(spark, monkeypatch):
    sides = spark.createDataFrame([(g, w, t) for g in range(6) for w in (1, 2) for t in ("A", "B")] + [(None, 1, "A"), (9, None, "A"), (9, 1, "C"), (3, 1, "A"), (3, 1, None)], "game_id long, week int, team string")
    roster = spark.createDataFrame([(1, "A", p) for p in range(5)] + [(2, "A", 1), (2, "B", 1), (1, "B", 9), (None, "A", 7), (1, "A", 1), (1, "A", None)], "week int, team string, player_id long")
    joined = sides.join(roster, ["week", "team"])
    wanted = joined.groupBy("player_id", "game_id").agg(F.min("team").alias("team"), F.countDistinct("team").alias("sides"))
    for bits, passes in ((63, 2), (3, 4)):
        monkeypatch.setattr(FP, "BITS", bits)
        made = FP.players_of_sides(sides, roster, ["week", "team"], counted="team")
        assert sorted(map(str, made.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
        found = made.groupBy("player_id", "game_id").agg(F.min("team").alias("team"), FP.distinct_of_game(made, "team").alias("sides"))
        assert found.schema == wanted.schema and sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
        after = physical(found).split("== Initial Plan ==")[0].split("Generate")[0]
        assert after.count("Aggregate") == passes and shuffles(found) == 1


def test_groupings_follow_one_bounded_layout(spark, monkeypatch):
    monkeypatch.setattr(slices, "TASK_ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 40).alias("e"), (F.col("id") % 7).alias("d"), F.col("id").cast("double").alias("v"))
    laid = slices.dealt(df, ["e"])
    assert laid.rdd.getNumPartitions() == 10
    out = G.context_totals(df.withColumn("o", F.col("d") % 3), "e", "d", {"any": [], "vs": ["o"]}, ["v"])
    assert sum(r["denom"] for r in out.collect()) == 2000 and shuffles(out) == 1


def test_a_hot_key_keeps_its_partial_sums(spark, hot):
    df = spark.range(100).select(F.lit(1).alias("e"), "id")
    assert slices.dealt(df, "e") is df


def test_given_rows_get_the_ratios_of_all_players(spark):
    df = spark.range(300).select((F.col("id") % 4).alias("player_id"), (F.col("id") % 3).alias("team"), (F.col("id") % 5).alias("opponent"), F.expr("date_add(DATE '2020-01-01', CAST(id % 30 AS INT))").alias("game_date"), F.lit(2020).alias("season"), (F.col("id") % 9).alias("target"))
    keys = ["player_id", "team", "opponent", "game_date"]
    wanted = FP.with_rolling(df, ["target"]).drop("target", "season").distinct()
    found = FP.with_rolling(df, ["target"], rows=df.select(*keys).distinct())
    assert sorted(map(str, found.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_feeds_of_the_matrix_join_once(spark, sf):
    feeds = matrix.feeds(Tables(spark, sf))
    assert not [n for n in ("plays", "injuries", "odds", "forecasts") if "Join" in physical(getattr(feeds, n))]
