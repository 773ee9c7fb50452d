"""Queries: feeds and their formats, row and column rules, contexts, streams in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..evaluation import calibration, splits
from ..functions import expectations, labels, plays, text, travel, usage
from ..operators.keys import join_on
from ..plans import features as FP
from ..plans.incremental import RollingStore
from ..session import cut_lineage, shared_folder
from ..sources import readers, writers
from ..streaming import streams
from .frames import player_games, player_games_sql
from .registry import query, r, rounded, rs

# --- rows and columns ------------------------------------------------------------------------------


@query("season_type_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def _season_type(t) -> DataFrame:
    rows = t.orders.withColumn("season_type", F.when(F.col("o_orderkey") % 3 == 0, "POST").when(F.col("o_orderkey") % 3 == 1, " reg").otherwise("REG"))
    return plays.only_season_type(rows).select("o_orderkey", "o_totalprice")


@query("active_rows", f"WITH {player_games_sql('player_id', 'game_id', 'target', 'red_zone_carry')} SELECT player_id, game_id, target, red_zone_carry FROM pg WHERE target <> 0 OR red_zone_carry <> 0")
def _active_rows(t) -> DataFrame:
    return plays.active_rows(player_games(t.lineitem, "player_id", "game_id", "target", "red_zone_carry"), ["target", "red_zone_carry", "absent"])


@query("same_event_columns", f"WITH {player_games_sql('player_id', 'game_id', 'air_yards_total')} SELECT player_id, game_id, air_yards_total, air_yards_total / 10 AS target_share_l3 FROM pg")
def _same_event_columns(t) -> DataFrame:
    rows = player_games(t.lineitem, "player_id", "game_id", "air_yards_total", "target", "carry", "touchdowns", "receiving_yards").withColumns({"target_share": F.lit(0.5), "target_share_l3": F.col("air_yards_total") / 10})
    guarded, report = labels.guard_leaks(labels.drop_same_event(rows))
    assert set(report.dropped) == {"target", "carry", "touchdowns", "receiving_yards"}
    return guarded


@query("horizon_columns", "SELECT c_custkey, c_acctbal * 6 AS price_6h FROM customer")
def _horizon_columns(t) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("price"), (F.col("c_acctbal") * 2).alias("price_2h"), (F.col("c_acctbal") * 6).alias("price_6h"))
    return rows.select(*labels.select_horizon(rows.columns, "h360m"))


@query("feature_selection", "SELECT l_orderkey, l_linenumber, l_quantity AS hist_a, l_tax AS hist_b, l_extendedprice AS extra FROM lineitem")
def _feature_selection(t) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("hist_a"), F.col("l_tax").alias("hist_b"), F.lit(7).alias("hist_same"), F.col("l_discount").alias("hist_out"), F.col("l_extendedprice").alias("extra"))
    chosen = labels.select_features(rows, ["hist_"], include=["extra"], discard=["hist_out"], constant_check=True)
    return rows.select("l_orderkey", "l_linenumber", *chosen)


@query(
    "label_gates",
    f"WITH {player_games_sql('player_id', 'target', 'carry')}, g AS (SELECT 'td_conv_rec' AS problem, player_id, target AS v FROM pg UNION ALL SELECT 'td_conv_rush', player_id, carry FROM pg UNION ALL SELECT 'snaps', player_id, 1 FROM pg) SELECT problem, player_id, count(*) AS n FROM g WHERE v > 0 GROUP BY ALL",
)
def _label_gates(t) -> DataFrame:
    rows = player_games(t.lineitem, "player_id", "target", "carry")
    parts = [rows.where(expectations.label_gate(rows, p)).select(F.lit(p).alias("problem"), "player_id") for p in ("td_conv_rec", "td_conv_rush", "snaps")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("problem", "player_id").agg(F.count(F.lit(1)).alias("n"))


@query("typed_targets", f"WITH {player_games_sql('game_id', 'player_id', 'target', 'receiving_yards')} SELECT game_id, player_id, CAST(target AS BIGINT) AS target, CAST(receiving_yards AS DOUBLE) AS receiving_yards, CAST(NULL AS TINYINT) AS anytime_td FROM pg")
def _typed_targets(t) -> DataFrame:
    rows = player_games(t.lineitem, "game_id", "player_id", "target", "receiving_yards")
    return labels.with_targets(rows, {n: labels.TARGET_TYPES[n] for n in ("target", "receiving_yards", "anytime_td")})


@query("suffix_policy", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT) AS weather_temp, CAST(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS TINYINT) AS weather_dome_flag FROM lineitem")
def _suffix_policy(t) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("weather_temp"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("weather_dome_flag"),
        F.col("l_shipdate").alias("weather_seen_ts"), F.col("l_comment" if "l_comment" in t.lineitem.columns else "l_returnflag").alias("weather_conditions"),
    )
    return labels.apply_suffix_policy(rows)


# --- joins ----------------------------------------------------------------------------------------


@query(
    "id_mapping",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 150 END AS src, 'Supplier#' || lpad(CAST(p_partkey % 130 AS VARCHAR), 9, '0') AS s_name FROM part),
m AS (SELECT s_suppkey AS src, min(s_nationkey + 1000) AS gid FROM supplier GROUP BY 1), n AS (SELECT s_name, min(s_nationkey + 1000) AS gid FROM supplier GROUP BY 1)
SELECT p_partkey, coalesce(m.gid, n.gid) AS gid FROM p LEFT JOIN m ON p.src = m.src LEFT JOIN n ON p.s_name = n.s_name""",
)
def _id_mapping(t) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 150).alias("src"), F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 130).cast("string"), 9, "0")).alias("s_name"))
    mapping = t.supplier.select(F.col("s_suppkey").alias("src"), "s_name", (F.col("s_nationkey") + 1000).alias("gid"))
    return text.map_ids(rows, mapping, "src", "gid", ["s_name"]).select("p_partkey", "gid")


@query("out_of_frame_target", "SELECT o_orderkey, c_acctbal AS target FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0")
def _out_of_frame_target(t) -> DataFrame:
    stats = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("target"))
    rows = t.orders.select("o_orderkey", "o_custkey", F.lit(-1.0).alias("target"))
    return expectations.with_labels_joined(rows, stats, ["o_custkey"], "target").select("o_orderkey", "target")


@query("upstream_predictions", "SELECT o_orderkey, o_totalprice / 2 AS pred_a, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 4 END AS pred_b FROM orders")
def _upstream_predictions(t) -> DataFrame:
    base = t.orders.select("o_orderkey")
    a = t.orders.select("o_orderkey", (F.col("o_totalprice") / 2).alias("pred_a"))
    b = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") / 4).alias("pred_b"), F.lit(0.0).alias("pred_a"))
    return calibration.with_upstream(base, [a, b], ["o_orderkey"])


@query(
    "reconciled_counts",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS given, o_totalprice / 5000 AS expected FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT l_orderkey, sum(given) AS a, max(expected) AS e FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, {rs({'group_allotted': 'a', 'group_expected': 'e', 'group_gap': 'a - e'})} FROM l JOIN g USING (l_orderkey)""",
)
def _reconciled_counts(t) -> DataFrame:
    rows = join_on(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("given")), t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 5000).alias("expected")), "l_orderkey", "inner")
    out = calibration.reconcile_counts(rows, ["l_orderkey"], "expected", "given")
    return rounded(out.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("group_allotted", "group_expected", "group_gap")]))


# --- history --------------------------------------------------------------------------------------


def _ratio_sql(name: str, keys: str, gate: bool) -> str:
    frames = {f"{k}g_target_per_game": f"(PARTITION BY {keys} ORDER BY game_date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (1, 3, 5)}
    frames |= {"season_target_per_game": f"(PARTITION BY {keys}, season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}
    frames |= {"lifetime_target_per_game": f"(PARTITION BY {keys} ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}
    support = f"sum(n) OVER {frames['lifetime_target_per_game']} >= 4" if gate else "true"
    end = "" if name == "vs_any" else f"_{name}"
    values = {f"{c}{end}": f"CASE WHEN {support} THEN sum(t) OVER {w} / sum(n) OVER {w} END" for c, w in frames.items()}
    return f"{name} AS (SELECT {keys}, game_date, {rs(values)} FROM (SELECT {keys}, game_date, season, sum(t) AS t, sum(n) AS n FROM d GROUP BY ALL))"


@query(
    "rolling_contexts",
    f"""WITH {player_games_sql('player_id', 'team', 'opponent', 'game_date', 'season', 'target')}, d AS (SELECT player_id, team, opponent, game_date, season, CAST(sum(target) AS DOUBLE) AS t, count(*) AS n FROM pg GROUP BY ALL),
{_ratio_sql('vs_any', 'player_id', False)}, {_ratio_sql('with_team', 'player_id, team', False)}, {_ratio_sql('vs_team', 'player_id, opponent', True)}
SELECT d.player_id, d.team, d.opponent, CAST(d.game_date AS VARCHAR) AS game_date, vs_any.* EXCLUDE (player_id, game_date), with_team.* EXCLUDE (player_id, team, game_date), vs_team.* EXCLUDE (player_id, opponent, game_date)
FROM d JOIN vs_any USING (player_id, game_date) JOIN with_team USING (player_id, team, game_date) JOIN vs_team USING (player_id, opponent, game_date)""",
)
def _rolling_contexts(t) -> DataFrame:
    """Ratios in three contexts; against one opponent every window needs four earlier games."""
    rows = player_games(t.lineitem, "player_id", "team", "opponent", "game_date", "season", "target")
    # Equal rows get equal ratios: they are made one while they are narrow.
    out = FP.with_rolling(rows, ["target"], rows=rows.select("player_id", "team", "opponent", "game_date").distinct())
    return rounded(out.withColumn("game_date", F.col("game_date").cast("string")))


@query(
    "pre_snap_history",
    f"""WITH {player_games_sql('player_id', 'game_date', 'target')}, d AS (SELECT player_id, game_date, CAST(sum(target) AS DOUBLE) AS routes FROM pg GROUP BY ALL)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, {rs({'ps_hist_routes_prev': 'lag(routes) OVER w', 'ps_hist_routes_l3': 'avg(routes) OVER w3'})} FROM d
WINDOW w AS (PARTITION BY player_id ORDER BY game_date), w3 AS (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def _pre_snap_history(t) -> DataFrame:
    days = player_games(t.lineitem, "player_id", "game_date", "target").groupBy("player_id", "game_date").agg(F.sum("target").cast("double").alias("routes"))
    out = FP.pre_snap_history(days, ["routes"])
    return rounded(out.select("player_id", F.col("game_date").cast("string").alias("game_date"), "ps_hist_routes_prev", "ps_hist_routes_l3"))


@query(
    "eastern_kickoffs",
    """WITH k AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 24) HOUR + INTERVAL 30 MINUTE AS local FROM orders),
u AS (SELECT o_orderkey, local, timezone('America/New_York', local) AS moment FROM k)
SELECT o_orderkey, CASE WHEN timezone('America/New_York', moment - INTERVAL 1 HOUR) = local OR timezone('America/New_York', moment + INTERVAL 1 HOUR) = local THEN NULL ELSE CAST(epoch(moment) AS BIGINT) END AS start_s FROM u
WHERE timezone('America/New_York', moment) = local""",
)
def _eastern_kickoffs(t) -> DataFrame:
    """Local kick-off times of every day of seven years, clock changes included; skipped hours are left out."""
    clock = F.format_string("%02d:30:00", F.col("o_orderkey") % 24)
    utc = travel.eastern_to_utc(F.to_date("o_orderdate"), clock)
    rows = t.orders.select("o_orderkey", F.to_timestamp(F.concat_ws(" ", F.to_date("o_orderdate").cast("string"), clock)).alias("local"), utc.alias("utc"))
    kept = rows.where(F.col("utc").isNull() | (F.from_utc_timestamp("utc", "America/New_York") == F.col("local")))
    return kept.select("o_orderkey", F.unix_timestamp("utc").alias("start_s"))


# --- formats --------------------------------------------------------------------------------------

_LINES = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"


@query("csv_plays", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def _csv_plays(t) -> DataFrame:
    """Two gzipped CSV seasons read under one schema."""
    base = shared_folder(t.spark, "plays-csv")
    rows = t.lineitem.selectExpr("CAST(l_orderkey AS BIGINT) AS l_orderkey", "CAST(l_linenumber AS INT) AS l_linenumber", "CAST(l_quantity AS DOUBLE) AS l_quantity", "l_returnflag")
    for part in (0, 1):
        rows.where(F.col("l_orderkey") % 2 == part).write.option("header", "true").option("compression", "gzip").csv(f"{base}/{part}")
    back = readers.read_plays_csv(t.spark, [f"{base}/0", f"{base}/1"], T.StructType.fromDDL(_LINES))
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("predictions_by_suffix", "SELECT 'csv' AS kind, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'parquet', o_orderkey, o_totalprice FROM orders")
def _predictions_by_suffix(t) -> DataFrame:
    base = shared_folder(t.spark, "predictions")
    rows = t.orders.selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey", "CAST(o_totalprice AS DOUBLE) AS o_totalprice")
    rows.write.option("header", "true").csv(f"{base}/p.csv")
    rows.write.parquet(f"{base}/p.parquet")
    schema = T.StructType.fromDDL("o_orderkey long, o_totalprice double")
    parts = [readers.read_predictions(t.spark, f"{base}/p.{kind}", schema).select(F.lit(kind).alias("kind"), "*") for kind in ("csv", "parquet")]
    return parts[0].unionByName(parts[1])


@query("union_of_schemas", "SELECT CAST(n_nationkey AS DOUBLE) AS key, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT CAST(c_custkey AS DOUBLE), NULL, CAST(c_acctbal AS DOUBLE) FROM customer")
def _union_of_schemas(t) -> DataFrame:
    base = shared_folder(t.spark, "schemas")
    t.nation.selectExpr("CAST(n_nationkey AS INT) AS key", "n_name AS name").write.parquet(f"{base}/a")
    t.customer.selectExpr("CAST(c_custkey AS DOUBLE) AS key", "CAST(c_acctbal AS DOUBLE) AS balance").write.parquet(f"{base}/b")
    return readers.read_union(t.spark, [f"{base}/a", f"{base}/b"])


@query(
    "transaction_feed",
    "WITH o AS (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END AS season FROM orders) SELECT season, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o WHERE season IN (1994, 1996) GROUP BY 1",
)
def _transaction_feed(t) -> DataFrame:
    path = shared_folder(t.spark, "transactions")
    t.orders.selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS date").write.json(path)
    back = readers.read_transactions(t.spark, path, T.StructType.fromDDL("o_orderkey long, date string"), [1994, 1996])
    return back.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("day_partitions", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) AS n FROM events GROUP BY ALL")
def _day_partitions(t) -> DataFrame:
    """Two writes of the same days leave one copy of each."""
    path = shared_folder(t.spark, "days")
    rows = t.events.select("event_id", "event_type", F.to_date("ts").alias("date"))
    writers.write_days(rows.where("event_id % 2 = 0"), path)
    writers.write_days(rows, path)
    return t.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("history_runs", "SELECT run, o_orderpriority, count(*) AS n FROM orders, (VALUES ('a'), ('b')) v(run) GROUP BY ALL")
def _history_runs(t) -> DataFrame:
    """A run that is written again replaces itself; other runs stay."""
    path = shared_folder(t.spark, "history")
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    for run, part in (("a", rows.withColumn("o_orderpriority", F.lit("old"))), ("b", rows), ("a", rows), ("a", rows)):
        writers.append_history(part, path, F.to_timestamp(F.lit("2024-01-01")), run)
    return t.spark.read.parquet(path).groupBy("run", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("matrix_by_horizon", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS price, h AS decision_horizon_hours FROM orders, (VALUES (1.5::DOUBLE), (6.0::DOUBLE)) v(h)")
def _matrix_by_horizon(t) -> DataFrame:
    path = shared_folder(t.spark, "matrix")
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.explode(F.array(F.lit(1.5), F.lit(6.0))).alias("decision_horizon_hours"))
    writers.write_matrix(rows, path)
    return t.spark.read.parquet(path).withColumn("decision_horizon_hours", F.col("decision_horizon_hours").cast("double"))


@query(
    "group_labels",
    "WITH g AS (SELECT *, year(o_orderdate) || '-' || month(o_orderdate) AS grp, CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT grp, min(day) AS d FROM g GROUP BY 1), e AS (SELECT greatest(1, ceil(count(*) / count(DISTINCT d) * 10)) AS n FROM f) "
    "SELECT o_orderkey, grp AS by_week, coalesce(o_orderpriority, '__missing__') AS by_column, strftime(day, '%Y-%m-%d') AS by_day, CAST(n AS INT) AS embargo_groups FROM g, e",
)
def _group_labels(t) -> DataFrame:
    """Fold groups by season and week, by a column and by day, and an embargo of ten days in groups."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.to_date("o_orderdate").alias("day"))
    rows = rows.withColumn("by_week", splits.group_label(rows)).withColumn("by_column", splits.group_label(rows, "o_orderpriority"))
    rows = rows.withColumn("by_day", splits.group_label(rows.drop("season", "week"), day="day"))
    return rows.select("o_orderkey", "by_week", "by_column", "by_day", F.lit(splits.embargo_to_groups(rows, "by_week", "day", 10)).alias("embargo_groups"))


@query(
    "local_hours",
    "WITH z AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 9.0 WHEN 1 THEN 5.5 ELSE -7.0 END AS off, o_orderdate + o_orderkey % 24 * INTERVAL '1' HOUR AS moment FROM orders), l AS (SELECT *, moment + CAST(off * 60 AS INT) * INTERVAL '1' MINUTE AS loc FROM z) "
    f"SELECT o_orderkey, {rs({'offset_hours': 'off', 'local_hour': 'hour(loc) + minute(loc) / 60'})} FROM l",
)
def _local_hours(t) -> DataFrame:
    zone = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'Asia/Tokyo' WHEN 1 THEN 'Asia/Kolkata' ELSE 'America/Phoenix' END")
    at = F.expr("o_orderdate + o_orderkey % 24 * INTERVAL '1' HOUR")
    rows = t.orders.select("o_orderkey", zone.alias("zone"), at.alias("at"))
    return rounded(rows.select("o_orderkey", travel.tz_offset_hours(F.col("zone"), F.col("at")).alias("offset_hours"), travel.local_hour(F.col("zone"), F.col("at")).cast("double").alias("local_hour")))


@query(
    "gap_fillers",
    f"SELECT p_partkey AS player_id, {rs({'vacated_targets_l3': 'CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END', 'vacated_carries_l3': '0', 'practice_trend_up': 'coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 2 END, 0)', 'practice_trend_down': '0'})} FROM part",
)
def _gap_fillers(t) -> DataFrame:
    rows = t.part.selectExpr("p_partkey AS player_id", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS vacated_targets_l3", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 2 AS DOUBLE) END AS practice_trend_up")
    out = usage.with_gap_fillers(rows)
    return rounded(out.select("player_id", *[F.col(c).cast("double").alias(c) for c in ("vacated_targets_l3", "vacated_carries_l3", "practice_trend_up", "practice_trend_down")]))


@query(
    "context_refresh",
    f"""WITH {player_games_sql('season', 'week', 'team', 'opponent', 'player_id', 'game_date', 'pass_attempt', 'carry', 'target')}, k AS (SELECT * FROM pg WHERE game_date <= DATE '1999-06-30'),
w AS (SELECT season, week, team, max(game_date) AS d, sum(pass_attempt) AS a, sum(carry) AS c, sum(target) AS tg FROM k GROUP BY ALL)
SELECT season, week, team, {rs({'pass_rate_l3': 'coalesce(avg(CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0 END) OVER x, 0)', 'targets_prev': 'coalesce(lag(tg) OVER (PARTITION BY season, team ORDER BY d), 0)'})} FROM w WINDOW x AS (PARTITION BY season, team ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def _context_refresh(t) -> DataFrame:
    """Contexts of all games up to a date, the team's own side."""
    rows = player_games(t.lineitem, "season", "week", "team", "opponent", "player_id", "game_date", "pass_attempt", "carry", "target")
    out = FP.refresh_contexts(rows, "1999-06-30")
    sides = rows.where(F.col("game_date") <= F.lit("1999-06-30").cast("date")).groupBy("season", "week", "team").agg(F.max("game_date").alias("game_date"))
    out = out.join(sides, ["season", "week", "team", "game_date"])
    return rounded(out.select("season", "week", "team", F.col("team_ctx_pass_rate_l3").alias("pass_rate_l3"), F.col("team_ctx_targets_prev").alias("targets_prev")))


# --- streams --------------------------------------------------------------------------------------


def _in_files(rows: DataFrame, parts: list, feed: str) -> int:
    """Write parts of the rows one after another, each with Spark's own files; the files of the first."""
    counts = []
    for part in parts:
        rows.where(part).write.mode("append").parquet(feed)
        counts.append(len(rows.sparkSession.read.parquet(feed).inputFiles()))
    return counts[0]


@query("stream_in_batches", f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS denom, {r('sum(value)', 'value_num')} FROM events GROUP BY ALL")
def _stream_in_batches(t) -> DataFrame:
    """Four parts in no order of time, about one a batch, with a stop and a restart after half of them."""
    feed, out, check = (shared_folder(t.spark, n) for n in ("feed", "totals", "totals-check"))
    rows = cut_lineage(t.events.select("event_id", "user_id", "ts", "value"))
    span = rows.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    for half in (0, 1):
        files = _in_files(rows, [F.col("event_id") * 7 % 4 == k for k in range(2 * half, 2 * half + 2)], feed)
        stream = streams.file_stream(t.spark, feed, rows.schema, files_per_batch=max(1, files // (1 + 2 * half)))
        totals = streams.daily_totals_stream(stream, "user_id", "ts", ["value"], delay=f"{span + 2} days")
        streams.run_to_end(streams.run_upsert(totals, out, check, ["user_id", "date"], ["date"]))
    return rounded(t.spark.read.parquet(out).select("user_id", F.col("date").cast("string").alias("date"), "denom", "value_num"))


@query("stream_late_repair", f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS denom, {r('sum(value)', 'value_num')} FROM events GROUP BY ALL")
def _stream_late_repair(t) -> DataFrame:
    """A tenth of the rows comes after all others, far behind the watermark: the stream drops them, the days are summed anew."""
    feed, out, late = (shared_folder(t.spark, n) for n in ("feed", "totals", "late"))
    rows = cut_lineage(t.events.select("event_id", "user_id", "ts", "value"))
    middle = rows.agg((F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)"))).first()[0] or 0
    is_late, first = F.col("event_id") % 10 == 0, F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    files = _in_files(rows, [first & ~is_late, ~first & ~is_late, is_late], feed)
    stream = streams.file_stream(t.spark, feed, rows.schema, files_per_batch=max(1, files))
    totals = streams.daily_totals_stream(stream, "user_id", "ts", ["value"], delay="1 day")
    streams.run_to_end(streams.run_upsert(totals, out, shared_folder(t.spark, "totals-check"), ["user_id", "date"], ["date"]))
    streams.run_to_end(streams.late_rows_stream(stream, "ts", 86400, late, shared_folder(t.spark, "late-check")))
    raw = t.spark.read.parquet(feed)
    streams.repair_days(raw, writers.read_if_exists(t.spark, f"{late}/rows"), out, "user_id", "ts", ["value"])
    return rounded(t.spark.read.parquet(out).select("user_id", F.col("date").cast("string").alias("date"), "denom", "value_num"))


@query("stream_bucket_upsert", "SELECT user_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _stream_bucket_upsert(t) -> DataFrame:
    """Last event of every user over several micro-batches, in a table laid out by hash of the user."""
    feed, out = shared_folder(t.spark, "feed"), shared_folder(t.spark, "buckets")
    rows = t.events.select("user_id", "ts", "event_id")
    files = _in_files(rows, [F.col("event_id") % 4 == k for k in range(4)], feed)
    buckets = max(16, streams.bucket_count(t.events.select("user_id").distinct().count()))
    stream = streams.file_stream(t.spark, feed, rows.schema, files_per_batch=max(1, files)).withColumn("version", F.struct("ts", "event_id"))
    streams.run_to_end(streams.run_bucket_upsert(stream, out, shared_folder(t.spark, "buckets-check"), ["user_id"], buckets, "append", "version"))
    return t.spark.read.parquet(out).select("user_id", "ts", "event_id")


@query(
    "rolling_in_runs",
    f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, year(ts) AS season, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, {rs({f'value_l{k}_ratio': f'sum(v) OVER w{k} / sum(n) OVER w{k}' for k in (1, 3, 5)})}, {r('sum(v) OVER ws / sum(n) OVER ws', 'value_season_ratio')}, {r('sum(v) OVER wl / sum(n) OVER wl', 'value_lifetime_ratio')} FROM d
WINDOW w1 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 ws AS (PARTITION BY user_id, season ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wl AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _rolling_in_runs(t) -> DataFrame:
    """Days added in three runs, the last of them out of order; later runs start from stored state."""
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day"), F.year("ts").alias("season")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("denom"))
    daily = cut_lineage(daily)
    cuts = [r_[0] for r_ in daily.agg(F.explode(F.expr("transform(percentile_approx(unix_date(day), array(0.4, 0.6, 0.8)), x -> date_from_unix_date(x))"))).collect()]
    store = RollingStore(t.spark, shared_folder(t.spark, "rolling"), "user_id", ["value"])
    if len(cuts) == 3:
        day = F.col("day")
        for run in (day <= cuts[0], (day > cuts[0]) & (day <= cuts[1]), day > cuts[2], (day > cuts[1]) & (day <= cuts[2])):
            store.add_days(daily.where(run))
    else:
        store.add_days(daily)
    out = store.features()
    return rounded(out.select("user_id", F.col("day").cast("string").alias("day"), *[c for c in out.columns if c.endswith("_ratio")]))


@query(
    "stream_latest_known",
    f"""WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL), j AS (SELECT p.event_id, p.user_id, v.ts, v.view_id FROM events p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL '7' DAY WHERE p.event_type = 'purchase')
SELECT event_id, user_id, max(ts) AS matched_ts, max_by(view_id, ts) AS view_id FROM j GROUP BY ALL""",
)
def _stream_latest_known(t) -> DataFrame:
    """Purchases with the last view of the seven days before, both as streams, with a restart in the middle; some have none."""
    feeds = [shared_folder(t.spark, n) for n in ("purchases", "views")]
    out, check = shared_folder(t.spark, "known"), shared_folder(t.spark, "known-check")
    rows = cut_lineage(t.events.select("event_id", "user_id", "ts", "event_type"))
    middle = rows.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0] or 0
    first = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    # A row of nobody far ahead moves the watermark past the last event.
    ahead = rows.agg((F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), "ts")
    later = ahead.select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    for parts in ([rows.where(first)], [rows.where(~first)], [ahead], [later]):
        for folder, kind in zip(feeds, ("purchase", "view"), strict=True):
            for part in parts:
                chosen = part.where(F.col("event_type") == kind) if "event_type" in part.columns else part
                chosen.select("event_id", "user_id", "ts").write.mode("append").parquet(folder)
        schema = "event_id bigint, user_id bigint, ts timestamp_ntz"
        bought, seen = (t.spark.readStream.schema(schema).parquet(f) for f in feeds)
        seen = seen.select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("view_id"))
        known = streams.latest_known_stream(bought, seen, "user_id", "event_id", "ts", "vts", ["view_id"], "7 DAYS", "1 hour")
        streams.run_to_end(streams.append_stream(known, out, check))
    return t.spark.read.parquet(out).where("event_id >= 0").select("event_id", "user_id", "matched_ts", "view_id")
