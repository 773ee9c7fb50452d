"""Column families and guards on tiny frames."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import cutoff, injuries, labels, market, plays, roles, text, travel, weather
from tidemark.functions.expectations import (
    TeamTotals, expected_value, gated_predictions, label_gate, reconcile, sample_weights, scale_to_team_totals, shifted_target, with_labels_joined,
)
from tidemark.functions.usage import with_gap_fillers, with_historical_shares


def test_label_components(spark):
    data = [("rush", 1, 0, 0, 1), ("rec", 0, 1, 0, 1), ("pass", 0, 0, 1, 1), ("def", 0, 0, 0, 1)]
    df = spark.createDataFrame(data, "player_id string, rushing_td_count long, receiving_td_count long, passing_td long, touchdowns long")
    got = {r["player_id"]: r for r in rows(labels.with_labels(df))}
    assert [got[k]["anytime_td_offense"] for k in ("rush", "rec", "pass", "def")] == [1, 1, 1, 0]
    assert [got[k]["anytime_td_all"] for k in ("rush", "rec", "pass", "def")] == [1, 1, 1, 1]
    assert [got[k]["anytime_td_skill"] for k in ("rush", "rec", "pass", "def")] == [1, 1, 0, 0]
    assert all(r["anytime_td"] == r["anytime_td_offense"] for r in got.values())


def test_label_alias_and_missing_parts(spark):
    got = rows(labels.with_labels(spark.createDataFrame([("a", 1)], "player_id string, touchdowns long"), "v1_any_all"))[0]
    assert got["anytime_td"] == got["anytime_td_all"] == 1 and got["td_count"] == 1
    with pytest.raises(ValueError):
        labels.with_labels(spark.range(1), "nope")


def test_leak_guard_bans_outcomes_and_keeps_allowed(spark):
    names = ["market_anytime_td_prob", "final_score", "postgame_anytime_td", "actual_td_count", "safe_feature"]
    assert set(labels.find_leaks(names)) == {"final_score", "postgame_anytime_td", "actual_td_count"}
    assert set(labels.find_leaks(labels.SAME_EVENT)) == set(labels.SAME_EVENT)
    realised = ["passing_yards", "pass_attempt", "carry", "offense_pct", "ps_targets_total", "touchdown_player_id", "x_final", "postgame_a", "POSTGAME"]
    assert set(labels.find_leaks([*realised, "1g_carry_per_game", "carry_l3", "poster"])) == set(realised)
    df = spark.createDataFrame([("g", 1.0, 1, 2)], "game_id string, safe_feature double, postgame_anytime_td int, final_score int")
    out, report = labels.guard_leaks(df)
    assert out.columns == ["game_id", "safe_feature"] and set(report.dropped) == {"postgame_anytime_td", "final_score"}
    with pytest.raises(ValueError):
        labels.guard_leaks(df, on_leak="raise")
    kept, _ = labels.guard_leaks(df, allow=["final_score"])
    assert "final_score" in kept.columns
    only, _ = labels.guard_leaks(df, allow=["game_id"], allow_prefixes=["safe_"], only_allowed=True)
    assert only.columns == ["game_id", "safe_feature"]


@pytest.mark.parametrize("n", [1500, 5000])
def test_report_sequence_holds_every_report(spark, n):
    start = dt.datetime(2024, 1, 1)
    data = [("p", start + dt.timedelta(minutes=i), ("FULL", "LIMITED", "DID NOT PARTICIPATE")[i % 3], None if i else "OUT", start + dt.timedelta(days=30)) for i in range(n)]
    df = spark.createDataFrame(data, "player_id string, reported_at timestamp, practice_status string, report_status string, decision_cutoff_ts timestamp")
    got = rows(injuries.report_summary(df, ["player_id"], start=None))[0]
    assert got["injury_report_count"] == n and got["injury_practice_status_sequence"].count(">") == n - 1
    assert got["injury_game_designation"] == "OUT" and got["injury_practice_status"] == data[-1][2]
    assert sum(got[f"injury_practice_{k}_last3"] for k in ("dnp", "limited", "full")) == 3


def test_horizon_columns():
    names = ["market_anytime_td_prob", "market_anytime_td_prob_2h", "market_anytime_td_prob_6h", "other_feature"]
    assert labels.select_horizon(names, "cutoff") == ["market_anytime_td_prob", "other_feature"]
    assert labels.select_horizon(names[:3], "6h") == ["market_anytime_td_prob_6h"]
    assert labels.select_horizon(names, "h120m") == ["market_anytime_td_prob_2h", "other_feature"]


def test_targets_and_feature_selection(spark):
    df = spark.createDataFrame([(1, 2, 5), (None, 3, 5)], "anytime_td int, hist_a int, hist_b int")
    typed = labels.with_targets(df, {"anytime_td": "tinyint", "td_count": "bigint"})
    assert dict(typed.dtypes)["anytime_td"] == "tinyint" and rows(typed)[0]["td_count"] is None
    assert labels.require_target(df, "anytime_td") == 1
    with pytest.raises(ValueError):
        labels.require_target(df, "anytime_td", 2)
    with pytest.raises(ValueError):
        labels.with_targets(df, {"absent": "int"}, strict=True)
    assert labels.select_features(df, ["hist_"], discard=["x"]) == ["hist_a", "hist_b"]
    assert labels.select_features(df, ["hist_"], constant_check=True) == ["hist_a"]


def test_suffix_policy(spark):
    df = spark.createDataFrame([(1.0, "x", 1, 2)], "weather_t double, weather_conditions string, weather_x_flag int, weather_gen_ts int")
    out = labels.apply_suffix_policy(df)
    assert dict(out.dtypes) == {"weather_t": "float", "weather_x_flag": "tinyint"}


def test_cutoffs(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 7, 18), dt.date(2024, 1, 7), "REG"), (None, dt.date(2024, 1, 7), "REG"), (dt.datetime(2024, 1, 7, 18), dt.date(2024, 1, 7), "POST")],
        "st timestamp_ntz, d date, kind string",
    )
    policy = cutoff.policy_from_config({"hours_before_kickoff": 6, "season_type_overrides": {"POST": 1.5}, "horizons_hours": [6, 1.5, 6], "drop_missing_snapshots": "no"})
    got = [r["decision_cutoff_ts"] for r in rows(cutoff.with_cutoff(df, "st", date="d", season_type="kind", policy=policy))]
    assert got == [dt.datetime(2024, 1, 7, 12), dt.datetime(2024, 1, 5, 12), dt.datetime(2024, 1, 7, 16, 30)]
    assert policy.horizons == (1.5, 6.0) and not policy.drop_missing_snapshots
    assert [cutoff.cutoff_label(h) for h in (1.5, 2, 6)] == ["h090m", "h02h", "h06h"]
    with cutoff.cutoff_policy(cutoff.CutoffPolicy(default=2.0)):
        assert cutoff.active_policy().default == 2.0
    assert cutoff.active_policy().default == 6.0


def test_known_flags_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 10), (2, 10, 10), (3, 11, 10), (4, None, 10)], "id int, snap int, cut int")
    got = rows(cutoff.known_flags(df, ["snap"], "cut"), "id")
    assert [r["snap_missing"] for r in got] == [0, 0, 0, 1]
    assert [r["snap_known_at_cutoff"] for r in got] == [1, 1, 0, 0]
    path = str(tmp_path / "audit")
    assert [r["id"] for r in rows(cutoff.guard_snapshots(df, ["snap"], "cut", path), "id")] == [1, 2, 4]
    late = rows(spark.read.parquet(path))
    assert late[0]["id"] == 3 and late[0]["late_feeds"] == ["snap"]
    assert cutoff.drop_missing(df, ["snap"]).count() == 3 and cutoff.drop_missing(df, ["snap"], False).count() == 4


def test_unavailability_ignores_roster_status(spark):
    df = spark.createDataFrame([("OUT", None), (None, "doubtful"), ("Inactive", "x")], "injury_game_designation string, injury_report_status string")
    assert [r["u"] for r in rows(df.select(injuries.unavailable(df).alias("u")))] == [True, True, True]
    status = spark.createDataFrame([("OUT",), ("IR",)], "status string")
    assert [r["u"] for r in rows(status.select(injuries.unavailable(status).alias("u")))] == [False, False]


def test_weather_flags(spark):
    schema = "roof string, weather_wind_mph double, weather_wind_gust_mph double, weather_precip_probability_pct double"
    df = spark.createDataFrame([("outdoors", 20.0, 25.0, 10.0), ("DOME", 20.0, 25.0, 90.0), (None, 1.0, 2.0, 0.0)], schema)
    got = rows(weather.with_context_flags(df))
    assert [(r["roof_is_indoor_flag"], r["weather_bad_passing_flag"]) for r in got] == [(0, 1), (1, 0), (0, 0)]
    bare = rows(weather.with_context_flags(spark.createDataFrame([(30.0,)], "weather_wind_mph double")))[0]
    assert bare["weather_bad_passing_flag"] == 1 and bare["roof"] is None


def test_wind_features(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, 10.0), (90.0, 10.0), (nan, 10.0), (45.0, 0.0), (None, 5.0)], "winddir double, windspeed double")
    got = rows(weather.with_wind_features(df))
    assert got[0]["wind_cos"] == pytest.approx(1) and got[1]["wind_sin"] == pytest.approx(1)
    assert all(r["wind_sin"] == 0 and r["wind_cos"] == 0 for r in got[2:])
    assert got[0]["wind_resistance"] == pytest.approx(0.1) and got[0]["wind_assistance"] == pytest.approx(-10)
    assert weather.with_wind_features(df.limit(0)).count() == 0


def test_cloud_cover_last_keyword_wins(spark):
    df = spark.createDataFrame([("Partly cloudy", 5.0), ("Rain, fog", 5.0), ("odd", 5.0), ("Clear", 0.0), ("mostly cloudy", 5.0)], "conditions string, windspeed double").withColumn("cloudcover", F.lit(None).cast("double"))
    assert [r["cloudcover"] for r in rows(weather.clean_observed(df))] == [50.0, 95.0, 50.0, 0.0, 50.0]


def test_eastern_time_and_dst(spark):
    df = spark.createDataFrame([("2024-01-07", "13:00"), ("2024-07-07", "13:00"), ("2024-03-10", "02:30"), ("2024-11-03", "01:30"), ("2024-11-03", "00:30"), ("2024-11-03", "02:30")], "d string, t string")
    got = [r["u"] for r in rows(df.select(travel.eastern_to_utc(F.col("d"), F.col("t")).alias("u")))]
    naive = [u.replace(tzinfo=None) if u else None for u in got]
    assert naive[0] == dt.datetime(2024, 1, 7, 18) and naive[1] == dt.datetime(2024, 7, 7, 17)
    assert naive[2] == dt.datetime(2024, 3, 10, 7, 30)
    assert naive[3] is None
    assert naive[4] == dt.datetime(2024, 11, 3, 4, 30) and naive[5] == dt.datetime(2024, 11, 3, 7, 30)


def test_time_zones_and_distance(spark):
    df = spark.createDataFrame([("America/New_York", dt.datetime(2024, 1, 1, 18, 30)), ("America/Denver", dt.datetime(2024, 7, 1, 18, 30))], "z string, t timestamp")
    got = rows(df.select(travel.tz_offset_hours(F.col("z"), F.col("t")).alias("o"), travel.local_hour(F.col("z"), F.col("t")).alias("h")))
    assert [(r["o"], r["h"]) for r in got] == [(-5.0, 13.5), (-6.0, 12.5)]
    km = spark.range(1).select(travel.haversine_km(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)).alias("k"))
    assert rows(km)[0]["k"] == pytest.approx(3935.75, abs=1)


def test_fill_timestamps(spark):
    base = dt.datetime(2024, 1, 1)
    data = [("g", 1, None), ("g", 2, base), ("g", 3, None), ("g", 4, base + dt.timedelta(seconds=4)), ("g", 5, None), ("h", 1, None)]
    got = [r["ts"] for r in rows(travel.fill_timestamps(spark.createDataFrame(data, "k string, n int, ts timestamp_ntz"), "k", ["n"], "ts"), "k", "n")]
    assert got == [base - dt.timedelta(milliseconds=10), base, base + dt.timedelta(seconds=2), base + dt.timedelta(seconds=4), base + dt.timedelta(seconds=4, milliseconds=10), None]


def test_names(spark):
    df = spark.createDataFrame([("Saquon Barkley",), ("C.McCaffrey",), ("Odell Beckham Jr.",), ("Cher",), ("Amon-Ra St. Brown III",)], "n string")
    got = rows(df.select(text.short_name(F.col("n")).alias("s"), text.last_name(F.col("n")).alias("l"), text.name_key(F.col("n")).alias("k")))
    assert [r["s"] for r in got[:2]] == ["S.Barkley", "C.McCaffrey"] and got[3]["s"] == "Cher"
    assert [r["l"] for r in got] == ["barkley", "mccaffrey", "beckham", "cher", "brown"]
    assert got[4]["k"] == "amonrastbrowniii"
    cand = spark.createDataFrame([("Mike O'Neil (Michael) / Michael Oneil, ",)], "r string").select(text.alias_candidates(F.col("r")).alias("c"))
    assert rows(cand)[0]["c"] == ["Mike ONeil", "Michael Oneil"]


def test_id_mapping_with_name_fallback(spark):
    rows_ = spark.createDataFrame([("p1", "a"), ("p9", "b"), (None, "c")], "pfr string, nm string")
    ids = spark.createDataFrame([("p1", "g1", "x"), ("p2", "g2", "b")], "pfr string, gsis string, nm string")
    got = {r["nm"]: r["gsis"] for r in rows(text.map_ids(rows_, ids, "pfr", "gsis", ["nm"]))}
    assert got == {"a": "g1", "b": "g2", "c": None}


def test_odds_values(spark):
    df = spark.createDataFrame([(-150.0, -3.0), (130.0, 0.0), (0.0, 7.0)], "p double, s double")
    got = rows(df.select(market.american_to_prob(F.col("p")).alias("a"), market.spread_to_win_prob(F.col("s")).alias("w")))
    assert got[0]["a"] == pytest.approx(0.6) and got[1]["a"] == pytest.approx(100 / 230) and got[2]["a"] is None
    assert got[1]["w"] == pytest.approx(0.5, abs=1e-6) and got[0]["w"] == pytest.approx(0.5882, abs=1e-3)


def test_play_outcome_priority(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (0, 1, 0, 0), (0, 1, 1, 0), (0, 0, 0, 0)], "interception int, pass int, complete_pass int, penalty int")
    assert [r["play_outcome"] for r in rows(plays.with_outcome(df))] == ["interception", "pass", "pass_complete", "other"]


def test_credit_order(spark):
    df = spark.createDataFrame([("x", 1, "r"), (None, 1, "r"), (None, 0, "r"), (None, 1, None)], "td_player_id string, rush_touchdown int, rusher_player_id string")
    assert [(r["touchdown_player_id"], r["touchdown"]) for r in rows(plays.with_credit(df))] == [("x", 1), ("r", 1), (None, 0), (None, 0)]


def test_position_groups_and_trend(spark):
    df = spark.createDataFrame([("HB", "DNP", "LP", "FP"), ("S", "Full", "Limited", "Limited"), ("QB", "LP", None, "FP")], "position string, injury_practice_status_day1 string, injury_practice_status_day2 string, injury_practice_status_day3 string")
    got = rows(roles.with_practice_trend(roles.with_position_group(df)))
    assert [r["position_group"] for r in got] == ["RB", "WR", "QB"]
    assert [(r["practice_trend_up"], r["practice_trend_down"]) for r in got] == [(1, 0), (0, 1), (0, 0)]


def test_shares_and_gap_fillers(spark):
    df = spark.createDataFrame([(3.0, 30.0), (3.0, 0.0)], "1g_target_per_game double, team_ctx_targets_prev double")
    assert [r["hist_target_share_prev"] for r in rows(with_historical_shares(df))] == [0.1, 0.0]
    assert rows(with_gap_fillers(df))[0]["practice_trend_up"] == 0


def test_reconcile_scales_to_target(spark):
    df = spark.createDataFrame([("a", 2.0, 8.0), ("a", 2.0, 8.0), ("b", 100.0, 8.0), ("c", 0.0, 8.0)], "g string, v double, t double")
    got = [round(r["v"], 4) for r in rows(reconcile(df, "v", "t", ["g"]), "g")]
    assert got == [4.0, 4.0, 25.0, 0.0]


def test_gates(spark):
    df = spark.createDataFrame([(0.6, 10.0, 0.2), (0.4, 10.0, 0.2), (0.6, 0.0, 0.2)], "pred_availability_active double, pred_snaps double, pred_usage_targets double")
    got = rows(gated_predictions(df))
    assert [(r["pred_snaps"], r["pred_usage_targets"], r["gate_snaps_global"]) for r in got] == [(10.0, 0.2, 1), (0.0, 0.0, 0), (0.0, 0.0, 1)]
    base = spark.createDataFrame([(1, 0.0), (0, 3.0), (None, None)], "is_inactive int, snaps_label double")
    assert [r["g"] for r in rows(base.select(label_gate(base, "snaps").alias("g")))] == [False, True, True]
    assert [r["g"] for r in rows(base.select(label_gate(base, "usage_targets").alias("g")))] == [False, True, False]


def test_team_totals_keep_group_sum(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.2, 20.0, 1.0), (1, 1, "a", 0.3, 20.0, 3.0)], "season int, week int, team string, p double, team_implied_total double, w double")
    got = rows(scale_to_team_totals(df, "p", TeamTotals(divisor=20.0, weights=("w",))))
    assert sum(r["p"] for r in got) == pytest.approx(1.0) and got[1]["p"] > got[0]["p"]


def test_survival_monotone_and_mass(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.1, 0.2)], "a double, b double, c double, d double")
    got = rows(expected_value(df, ["a", "b", "c", "d"], 5.5))[0]
    s = [got[f"survival_{i}"] for i in range(1, 6)]
    assert s == sorted(s, reverse=True) and sum(got[f"pmf_{i}"] for i in range(6)) == pytest.approx(1)


def test_sample_weights(spark):
    df = spark.createDataFrame([(2022, 1, 1.0), (2024, 1, 2.0)], "season int, week int, target double")
    got = [r["sample_weight"] for r in rows(sample_weights(df, {"normalize": False}, opportunity="target"), "season")]
    assert got == [pytest.approx(0.36), pytest.approx(2.0)]


def test_targets_from_other_frames(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, t int, v int")
    assert [(r["k"], r["n"]) for r in rows(shifted_target(df, ["k"], ["t"], "v", 1, "n"), "k", "t")] == [("a", 5)]
    assert [(r["k"], r["n"]) for r in rows(shifted_target(df, ["k"], ["t"], "v", -1, "n"), "k", "t")] == [("a", 6)]
    stats = spark.createDataFrame([("a", 1, 0.5)], "k string, t int, y double")
    assert [r["y"] for r in rows(with_labels_joined(df, stats, ["k", "t"], "y"), "k", "t")] == [0.5, None, None]


def test_consensus_of_small_and_of_hot_events_agree(spark, monkeypatch):
    """One aggregation for small groups, ranked slices beyond the bound: the same figures."""
    from tidemark.functions import market

    quotes = []
    for game in range(4):
        for book in range(5):
            for outcome, price in (("H", -110 - book), ("A", 100 + 5 * book), ("Over", -105), ("Under", None)):
                quotes += [(game, "H", "A", f"b{book}", m, outcome, None if price is None else float(price + game), None if m == "h2h" else float(book % 3)) for m in ("h2h", "spreads", "totals")]
    quotes += [(9, "H", "A", None, "h2h", "H", -120.0, None), (9, "H", "A", None, "h2h", "H", None, None)]
    df = spark.createDataFrame(quotes, "game int, home_team string, away_team string, book string, market string, outcome string, price double, point double")
    found = []
    for bound in (10_000, 1):
        monkeypatch.setattr(market, "SMALL_GROUP", bound)
        out = market.consensus(df, ["game", "home_team", "away_team"])
        found.append([{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in rows(out.select(sorted(out.columns)), "game")])
    assert found[0] == found[1] and len(found[0]) == 5


def test_consensus_of_small_events_lays_quotes_out_once(spark):
    """Quotes move once, as slim columns; no list of an event is half filled before that, and figures are those of plain Python."""
    from statistics import median, pstdev

    from tidemark.functions import market

    prices = {1: [-120.0, 105.0, -110.0], 2: [130.0, -115.0, 100.0, 100.0], None: [-101.0], 3: []}
    quotes = [(game, "H", "A", f"b{i % 3}", "h2h", "H", None, p, None) for game, ps in prices.items() for i, p in enumerate(ps)]
    quotes += [(game, "H", "A", None, "totals", "Over", None, -105.0 - i, 40.0 + i) for game, ps in prices.items() for i in range(len(ps))]
    quotes += [(3, "H", "A", "b0", "h2h", "H", None, None, None)]
    schema = "game int, home_team string, away_team string, book string, market string, outcome string, description string, price double, point double"
    out = market.consensus(spark.createDataFrame(quotes, schema), ["game"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved, at_scan = plan.count("Exchange"), plan[plan.index("Exchange"):]
    assert moved == 1 and "Aggregate" not in at_scan and "home_team" not in plan
    found = {r["game"]: r for r in rows(out)}
    assert set(found) == set(prices)
    for game, ps in prices.items():
        lines = [40.0 + i for i in range(len(ps))]
        got = found[game]
        assert got["moneyline_home"] == (median(ps) if ps else None) and got["total_line"] == (median(lines) if lines else None)
        assert got["total_line_std"] == (pytest.approx(pstdev(lines)) if len(lines) > 1 else None)
        assert got["moneyline_book_count"] == (min(3, len(ps)) or 1) and got["total_book_count"] == (1 if ps else None)
        assert got["spread_line"] is None and got["spread_book_count"] is None
