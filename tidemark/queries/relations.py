"""Queries: joins, unions, snapshots, markets, weather, travel, text, sources and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cutoff, injuries, market, text, travel, weather
from ..operators.asof import asof_join
from ..operators.keys import attach_totals, join_on, latest_by
from ..operators.slices import dealt
from ..plans import asof_metadata as AM
from ..plans import features as FP
from ..plans.incremental import SeededHistory
from ..schema import conform, schema_summary, union_relaxed, with_defaults
from ..session import shared_folder
from ..sources import readers, writers
from ..streaming import streams
from .frames import player_games, player_games_sql
from .registry import query, r, rd, rounded, rs

# --- joins and sets ------------------------------------------------------------------------------


@query(
    "dimension_fan_in",
    "SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def _dimension_fan_in(t) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    out = join_on(t.orders.select("o_orderkey", "o_custkey"), c, "o_custkey")
    out = join_on(out, t.nation, "n_nationkey")
    out = join_on(out, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("anti_join_no_activity", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def _anti_join(t) -> DataFrame:
    big = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("semi_join_entities", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def _semi_join(t) -> DataFrame:
    chosen = t.part.where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(chosen, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "full_outer_contexts",
    "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) "
    "SELECT k, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(q, 0) AS q FROM a FULL JOIN b USING (k)",
)
def _full_outer(t) -> DataFrame:
    k = F.col("l_orderkey").alias("k")
    a = t.lineitem.where("l_returnflag = 'R'").groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    b = t.lineitem.where("l_linestatus = 'O'").groupBy(k).agg(F.sum("l_quantity").alias("q"))
    return a.join(b, "k", "full").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.lit(0.0)).alias("q"))


@query("group_share_labels", f"SELECT o_orderkey, {r('o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey)', 'share')} FROM orders")
def _group_share(t) -> DataFrame:
    out = attach_totals(t.orders, "o_custkey", {"total": F.sum("o_totalprice")})
    return rounded(out.select("o_orderkey", (F.col("o_totalprice") / F.col("total")).alias("share")))


@query(
    "team_rows_unpivot",
    "SELECT l_orderkey AS game_id, l_linenumber, unnest([{'team': l_suppkey, 'opponent': l_partkey, 'is_home': 1}, {'team': l_partkey, 'opponent': l_suppkey, 'is_home': 0}], recursive := true) FROM lineitem",
)
def _team_rows(t) -> DataFrame:
    games = t.lineitem.select(F.col("l_orderkey").alias("game_id"), "l_linenumber", F.col("l_suppkey").alias("home_team"), F.col("l_partkey").alias("away_team"))
    return travel.team_rows(games, keep=["game_id", "l_linenumber"])


@query(
    "zero_usage_rows",
    f"""WITH {player_games_sql('season', 'week', 'team', 'player_id', 'game_id', 'target', 'carry')}, u AS (SELECT season, week, team, player_id, min(game_id) AS game_id, CAST(sum(target) AS BIGINT) AS target, CAST(sum(carry) AS BIGINT) AS carry FROM pg GROUP BY ALL),
ro AS (SELECT DISTINCT year(o_orderdate) AS season, month(o_orderdate) AS week, o_custkey % 32 AS team, o_custkey AS player_id FROM orders),
sc AS (SELECT season, week, team, min(game_id) AS game_id FROM u GROUP BY ALL)
SELECT season, week, team, player_id, game_id, target, carry FROM u UNION ALL
SELECT ro.season, ro.week, ro.team, ro.player_id, sc.game_id, 0, 0 FROM ro JOIN sc USING (season, week, team) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.season = ro.season AND u.week = ro.week AND u.team = ro.team AND u.player_id = ro.player_id)""",
)
def _zero_usage(t) -> DataFrame:
    """The customers of every month as its roster, against the whole usage table."""
    pg = player_games(t.lineitem, "season", "week", "team", "player_id", "game_id", "target", "carry")
    u = pg.groupBy("season", "week", "team", "player_id").agg(F.min("game_id").alias("game_id"), F.sum("target").cast("bigint").alias("target"), F.sum("carry").cast("bigint").alias("carry"))
    roster = t.orders.selectExpr("year(o_orderdate) AS season", "month(o_orderdate) AS week", "o_custkey % 32 AS team", "o_custkey AS player_id").distinct()
    schedule = u.groupBy("season", "week", "team").agg(F.min("game_id").alias("game_id")).select("season", "week", "game_id", F.col("team").alias("home_team"), F.lit(None).cast("bigint").alias("away_team"))
    return FP.zero_usage_rows(u, roster, schedule, ["target", "carry"]).select("season", "week", "team", "player_id", "game_id", "target", "carry")


@query(
    "relaxed_union",
    "SELECT c_custkey AS k, CAST(c_nationkey AS DOUBLE) AS v, c_mktsegment AS seg, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_acctbal FROM supplier",
)
def _relaxed_union(t) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"), F.col("c_mktsegment").alias("seg"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_acctbal").alias("bal"))
    return union_relaxed(a, b)


@query(
    "history_plus_scaffold",
    f"""WITH h AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'), s AS (SELECT o_custkey, o_orderdate, o_orderkey, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'),
u AS (SELECT * FROM h UNION ALL SELECT * FROM s) SELECT o_orderkey, {rs({'l3': 'avg(o_totalprice) OVER w3', 'prev': 'avg(o_totalprice) OVER w1'}, 4)} FROM u
WINDOW w3 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w1 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)
QUALIFY o_orderdate >= TIMESTAMP '2001-01-01'""",
)
def _history_plus_scaffold(t) -> DataFrame:
    """Serving path: windows over history plus outcome-free scaffold rows, scaffold kept."""
    from ..operators.prior import last_rows, prior_rows

    cols = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    cut = F.lit("2001-01-01").cast("timestamp_ntz")

    def step(df: DataFrame) -> DataFrame:
        return prior_rows(df, "o_custkey", ["o_orderdate", "o_orderkey"], 3, lambda w: {"l3": F.avg("o_totalprice").over(last_rows(w, 3)), "prev": F.avg("o_totalprice").over(last_rows(w, 1))})

    out = FP.history_and_scaffold(cols.where(F.col("o_orderdate") < cut), cols.where(F.col("o_orderdate") >= cut).drop("o_totalprice"), step)
    return rounded(out.select("o_orderkey", "l3", "prev"), 4)


@query(
    "upsert_keep_last",
    "WITH u AS (SELECT o_orderkey % 5000 AS k, o_orderdate AS v, o_orderkey AS id, o_totalprice AS price FROM orders) SELECT k, max_by(id, (v, id)) AS id, max_by(price, (v, id)) AS price, max(v) AS v FROM u GROUP BY k",
)
def _upsert(t) -> DataFrame:
    u = t.orders.select((F.col("o_orderkey") % 5000).alias("k"), F.col("o_orderdate").alias("v"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    old, new = u.where("v < TIMESTAMP_NTZ '1998-06-01'"), u.where("v >= TIMESTAMP_NTZ '1998-06-01'")
    return writers.upsert(old, new, "k", [F.col("v"), F.col("id")])


@query(
    "fill_empty_rows",
    "WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders) SELECT k, CASE WHEN a IS NULL AND b IS NULL THEN -1.0 ELSE a END AS a, CASE WHEN a IS NULL AND b IS NULL THEN 'new' ELSE b END AS b FROM o",
)
def _fill_empty(t) -> DataFrame:
    o = t.orders.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS b")
    source = t.orders.selectExpr("o_orderkey AS k", "CAST(-1 AS DOUBLE) AS a", "'new' AS b")
    return market.fill_empty_rows(o, source, ["k"], ["a", "b"])


@query(
    "coalesce_override",
    "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END AS v FROM orders",
)
def _coalesce_override(t) -> DataFrame:
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("v"))
    fresh = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return market.coalesce_update(base, fresh, ["k"], ["v"])


@query(
    "manual_override_map",
    "WITH d AS (SELECT n_regionkey AS season, n_name AS team, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'coach ' || n_nationkey END AS oc FROM nation), m AS (SELECT n_regionkey AS season, n_name AS team, 'manual ' || n_nationkey AS oc FROM nation WHERE n_regionkey = 2) "
    "SELECT season, team, coalesce(upper(m.oc), nullif(upper(d.oc), ''), upper('TEAM_' || team)) AS oc FROM d FULL JOIN m USING (season, team)",
)
def _manual_override(t) -> DataFrame:
    d = t.nation.selectExpr("n_regionkey AS season", "n_name AS team", "CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('coach ', n_nationkey) END AS oc")
    m = t.nation.where("n_regionkey = 2").selectExpr("n_regionkey AS season", "n_name AS team", "concat('manual ', n_nationkey) AS oc")
    return market.override_map(d, m, ["season", "team"], "oc")


@query(
    "snapshot_override_known",
    "WITH s AS (SELECT user_id, max(ts) AS snap, max_by(value, ts) AS value FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.event_id, CASE WHEN s.snap <= e.ts THEN s.value END AS value FROM events e LEFT JOIN s USING (user_id) WHERE e.event_type = 'click'",
)
def _snapshot_override(t) -> DataFrame:
    snaps = t.events.where("event_type = 'error'").select("user_id", F.col("ts").alias("snap"), "value")
    rows = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return injuries.known_snapshot_values(rows, snaps, ["user_id"], "snap", "ts", ["value"]).select("event_id", "value")


@query(
    "history_fallback",
    f"""WITH {player_games_sql('season', 'week', 'player_id', 'target')}, h AS (SELECT player_id, season, week, CAST(sum(target) AS DOUBLE) AS f FROM pg WHERE season < 2001 GROUP BY ALL), l AS (SELECT player_id, max_by(f, season * 100 + week) AS f FROM h GROUP BY 1),
r AS (SELECT DISTINCT player_id, season, week FROM pg WHERE season >= 2000) SELECT r.player_id, r.season, r.week, coalesce(h.f, l.f) AS f FROM r LEFT JOIN h USING (player_id, season, week) LEFT JOIN l ON l.player_id = r.player_id""",
)
def _history_fallback(t) -> DataFrame:
    pg = player_games(t.lineitem, "season", "week", "player_id", "target")
    h = pg.where("season < 2001").groupBy("player_id", "season", "week").agg(F.sum("target").cast("double").alias("f"))
    rows = pg.where("season >= 2000").select("player_id", "season", "week").distinct()
    return injuries.with_history_fallback(rows, h, "player_id", ["player_id", "season", "week"], ["season", "week"], ["f"])


@query(
    "baseline_fallback",
    "WITH b AS (SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS bv FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) "
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, bv) AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'actual' WHEN bv IS NOT NULL THEN 'baseline' ELSE 'none' END AS price_source FROM orders LEFT JOIN b USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
)
def _baseline_fallback(t) -> DataFrame:
    """All orders, on one side of a date or the other."""
    rows = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price")
    base = t.orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price"))
    return FP.with_baseline(rows, base, "o_custkey", ["price"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "price", "price_source")


@query(
    "serving_snap_history",
    f"""WITH h AS (SELECT o_custkey, o_orderdate AS d, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL), s AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')
SELECT s.o_orderkey, h.v AS price, {r('(epoch_us(s.o_orderdate) - epoch_us(h.d)) / 86400e6', 'days_since_last_event')} FROM s ASOF LEFT JOIN h ON s.o_custkey = h.o_custkey AND s.o_orderdate > h.d""",
)
def _serving_snap_history(t) -> DataFrame:
    h = t.orders.where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("v"))
    s = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'").select("o_orderkey", "o_custkey", "o_orderdate")
    out = FP.serve_snap_history(s, h, "o_custkey", "o_orderdate", {"price": "v"})
    return rounded(out.select("o_orderkey", "price", "days_since_last_event"))


@query(
    "player_scaffold",
    f"""WITH {player_games_sql('season', 'week', 'game_id', 'team', 'opponent', 'player_id', 'position')}, g AS (SELECT season, week, game_id, min(team) AS home_team, min(opponent) AS away_team FROM pg GROUP BY ALL),
ro AS (SELECT DISTINCT season, week, team, player_id, position, CASE player_id % 5 WHEN 0 THEN 'IR-R' WHEN 1 THEN 'CUT' ELSE 'ACT' END AS status, CASE WHEN player_id % 7 = 0 THEN 'Doubtful' END AS dg FROM pg),
s AS (SELECT season, week, game_id, home_team AS team, away_team AS opponent, 1 AS is_home FROM g UNION ALL SELECT season, week, game_id, away_team, home_team, 0 FROM g)
SELECT player_id, game_id, min(team) AS team, count(DISTINCT team) AS sides FROM (SELECT s.*, ro.player_id FROM s JOIN ro USING (season, week, team) WHERE position IN ('QB','RB','WR','TE') AND status = 'ACT' AND dg IS NULL) GROUP BY player_id, game_id""",
)
def _player_scaffold(t) -> DataFrame:
    pg = player_games(t.lineitem, "season", "week", "game_id", "team", "opponent", "player_id", "position")
    games = pg.groupBy("season", "week", "game_id").agg(F.min("team").alias("home_team"), F.min("opponent").alias("away_team"))
    roster = pg.select("season", "week", "team", "player_id", "position").distinct().withColumns(
        {"status": F.expr("CASE player_id % 5 WHEN 0 THEN 'IR-R' WHEN 1 THEN 'CUT' ELSE 'ACT' END"), "injury_game_designation": F.expr("CASE WHEN player_id % 7 = 0 THEN 'Doubtful' END")}
    )
    roster = roster.where(injuries.eligible(roster)).select("season", "week", "team", "player_id").distinct()
    rows = FP.players_of_sides(travel.team_rows(games), roster, ["season", "week", "team"], counted="team")
    return rows.groupBy("player_id", "game_id").agg(F.min("team").alias("team"), FP.distinct_of_game(rows, "team").alias("sides"))


# --- as-of metadata ----------------------------------------------------------------------------------

_META_SQL = """g AS (SELECT user_id AS game_id, max(ts) AS st, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1), c AS (SELECT game_id, CASE WHEN game_id % 10 = 0 THEN CAST(d AS TIMESTAMP) - INTERVAL 36 HOUR ELSE st - INTERVAL 6 HOUR END AS cut FROM g),
i AS (SELECT c.game_id, max(ts) AS ts, count(*) AS n FROM c JOIN events e ON e.user_id = c.game_id AND e.event_type = 'error' AND e.ts <= c.cut GROUP BY 1),
ro AS (SELECT c.game_id, max(ts) AS ts FROM c JOIN events e ON e.user_id = c.game_id AND e.event_type = 'view' AND e.ts <= c.cut GROUP BY 1),
od AS (SELECT c.game_id, max(ts) AS ts FROM c JOIN events e ON e.user_id = c.game_id AND e.event_type = 'click' AND e.ts <= c.cut GROUP BY 1),
fc AS (SELECT c.game_id, max(ts) AS ts, max_by(value, ts) AS v FROM c JOIN events e ON e.user_id = c.game_id AND e.event_type = 'signup' AND e.ts <= c.cut GROUP BY 1),
m AS (SELECT c.game_id, c.cut AS cutoff_ts, i.ts AS injury_snapshot_ts, CAST(coalesce(i.n, 0) AS BIGINT) AS injury_reports_used, CASE WHEN i.ts IS NULL THEN 'none' ELSE 'historical' END AS injury_snapshot_source, ro.ts AS roster_snapshot_ts,
  od.ts AS odds_snapshot_ts, fc.ts AS forecast_snapshot_ts, CASE WHEN fc.ts IS NULL THEN 'none' WHEN fc.v > 100 THEN 'backfill' ELSE 'live_pull' END AS forecast_snapshot_source FROM c LEFT JOIN i USING (game_id) LEFT JOIN ro USING (game_id) LEFT JOIN od USING (game_id) LEFT JOIN fc USING (game_id))"""


def _metadata(t) -> DataFrame:
    e = t.events.withColumnRenamed("user_id", "game_id")
    games = e.groupBy("game_id").agg(F.max("ts").alias("st"), F.max(F.to_date("ts")).alias("game_date")).withColumn("game_start_utc", F.when(F.col("game_id") % 10 != 0, F.col("st")))

    def feed(kind: str, ts: str) -> DataFrame:
        return e.where(F.col("event_type") == kind).withColumnRenamed("ts", ts)

    forecasts = feed("signup", "forecast_generated_ts").withColumns({"forecast_is_backfill": F.col("value") > 100, "forecast_source_detail": F.lit("live_pull")})
    return AM.build_asof_metadata(games, feed("error", "reported_at"), feed("view", "snapshot_ts"), feed("click", "odds_snapshot_ts"), forecasts, cutoff.CutoffPolicy())


@query("asof_metadata", f"WITH {_META_SQL} SELECT *, {r('(epoch_us(cutoff_ts) - epoch_us(roster_snapshot_ts)) / 3600e6', 'roster_snapshot_lag_hours')} FROM m")
def _asof_metadata(t) -> DataFrame:
    return rounded(_metadata(t).drop("game_start_utc", "game_date"))


@query(
    "attach_known_flags",
    f"""WITH {_META_SQL} SELECT e.event_id, m.cutoff_ts AS decision_cutoff_ts, (m.odds_snapshot_ts IS NULL)::INT AS odds_snapshot_ts_missing, coalesce((m.odds_snapshot_ts <= m.cutoff_ts)::INT, 0) AS odds_snapshot_ts_known_at_cutoff FROM events e JOIN m ON e.user_id = m.game_id
WHERE m.injury_snapshot_ts IS NOT NULL AND m.roster_snapshot_ts IS NOT NULL AND m.odds_snapshot_ts IS NOT NULL AND m.forecast_snapshot_ts IS NOT NULL""",
)
def _attach_known_flags(t) -> DataFrame:
    rows = t.events.select("event_id", F.col("user_id").alias("game_id"))
    out = AM.attach_asof_metadata(rows, _metadata(t), drop_rows=True)
    return out.select("event_id", "decision_cutoff_ts", "odds_snapshot_ts_missing", "odds_snapshot_ts_known_at_cutoff")


@query(
    "snapshot_guard",
    f"""WITH {_META_SQL}, x AS (SELECT e.event_id, e.ts, m.cutoff_ts, m.odds_snapshot_ts, e.ts > m.cutoff_ts AS late FROM events e JOIN m ON e.user_id = m.game_id) SELECT event_id, late::INT AS violation FROM x""",
)
def _snapshot_guard(t) -> DataFrame:
    rows = t.events.select("event_id", F.col("ts").alias("feed_ts"), F.col("user_id").alias("game_id"))
    joined = join_on(rows, _metadata(t).select("game_id", "cutoff_ts"), "game_id")
    clean, late = cutoff.split_violations(joined, ["feed_ts"], "cutoff_ts")
    return clean.select("event_id", F.lit(0).alias("violation")).unionByName(late.select("event_id", F.lit(1).alias("violation")))


@query(
    "horizon_cutoffs",
    "SELECT o_orderkey, h AS decision_horizon_hours, o_orderdate - to_microseconds(CAST(h * 3600000000 AS BIGINT)) AS cutoff_ts, CASE WHEN CAST(h * 60 AS INT) % 60 = 0 THEN format('h{:02d}h', CAST(h AS INT)) ELSE format('h{:03d}m', CAST(h * 60 AS INT)) END AS label FROM orders, (SELECT unnest([1.5::DOUBLE, 6.0, 24.0]) AS h)",
)
def _horizon_cutoffs(t) -> DataFrame:
    out = AM.horizon_rows(t.orders.select("o_orderkey", F.col("o_orderdate").alias("game_start_utc")), [1.5, 6.0, 24.0])
    return out.withColumn("label", cutoff.cutoff_label_column(F.col("decision_horizon_hours"))).drop("game_start_utc")


@query(
    "context_asof_attach",
    f"""WITH h AS (SELECT s.s_nationkey AS team, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL),
h2 AS (SELECT team, CAST(d AS TIMESTAMP) AS as_of, q FROM h), o AS (SELECT o_orderkey, c_nationkey AS team, o_orderdate - INTERVAL 6 HOUR AS cut FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o.o_orderkey, coalesce(h2.q, 0) AS ctx_q FROM o ASOF LEFT JOIN h2 ON o.team = h2.team AND o.cut >= h2.as_of""",
)
def _context_asof_attach(t) -> DataFrame:
    ship = t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team")), "l_suppkey")
    h = ship.groupBy("team", F.to_date("l_shipdate").cast("timestamp_ntz").alias("data_as_of")).agg(F.sum("l_quantity").alias("q"))
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team")), "o_custkey")
    o = cutoff.with_cutoff(o.select("o_orderkey", "team", "o_orderdate"), "o_orderdate", 6.0, "cut")
    return FP.attach_context(o, h, "data_as_of", "cut", "team", ["q"], "ctx_").select("o_orderkey", "ctx_q")


@query(
    "participation_history",
    f"""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, CAST(o_orderkey * 31 % 101 AS DOUBLE) / 100 AS x FROM orders)
SELECT o_orderkey, {rs({'snap_offense_pct_prev': 'lag(x) OVER w', 'snap_offense_pct_l3': 'avg(x) OVER w3', 'snap_pct_std_l5': 'CASE WHEN count(*) OVER w5 >= 2 THEN stddev_samp(x) OVER w5 END', 'max_snap_pct_l5': 'max(x) OVER w5', 'starter_rate_l5': 'sum((x > 0.5)::INT) OVER w5 / 5',
 'snap_volatility_cv_l5': 'CASE WHEN count(*) OVER w5 >= 2 THEN stddev_samp(x) OVER w5 / greatest(avg(x) OVER w5, 0.01) END'})}, CASE WHEN count(*) OVER w3 = 0 THEN 1 ELSE 0 END AS has_no_snap_history FROM o
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w3 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def _participation_history(t) -> DataFrame:
    o = t.orders.selectExpr("o_custkey", "o_orderdate", "o_orderkey", "CAST(o_orderkey * 31 % 101 AS DOUBLE) / 100 AS offense_pct")
    out = FP.snap_history(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    return rounded(out.select("o_orderkey", "snap_offense_pct_prev", "snap_offense_pct_l3", "snap_pct_std_l5", "max_snap_pct_l5", "starter_rate_l5", "snap_volatility_cv_l5", "has_no_snap_history"))


@query(
    "market_history",
    f"SELECT o_orderkey, {r('avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'l3', 4)} FROM orders",
)
def _market_history(t) -> DataFrame:
    return rounded(FP.market_history(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "l3").select("o_orderkey", "l3"), 4)


@query(
    "catch_and_air_history",
    f"""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderkey % 7 AS rec, o_orderkey % 7 + o_orderkey % 5 AS tgt, CAST(o_orderkey % 60 AS DOUBLE) AS air FROM orders)
SELECT o_orderkey, {rs({'hist_catch_rate_career': 'least(coalesce(sum(rec) OVER wl, 0) / (coalesce(sum(tgt) OVER wl, 0) + 1e-6), 1)', 'hist_catch_rate_l3': 'least(coalesce(sum(rec) OVER w3, 0) / (coalesce(sum(tgt) OVER w3, 0) + 1e-6), 1)', 'hist_catch_rate_l5': 'least(coalesce(sum(rec) OVER w5, 0) / (coalesce(sum(tgt) OVER w5, 0) + 1e-6), 1)',
 'hist_air_yards_sum_l3': 'coalesce(sum(air) OVER w3, 0)', 'hist_targets_l5': 'coalesce(sum(tgt) OVER w5, 0)', 'air_yards_prev_game': 'coalesce(lag(air) OVER w, 0)'})}, CAST(coalesce(sum(tgt) OVER w5, 0) AS INT) AS hist_targets_count_l5 FROM o
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), wl AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 w3 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def _catch_and_air(t) -> DataFrame:
    from ..functions.depth import with_air_yards_history, with_catch_history

    o = t.orders.selectExpr("o_custkey", "o_orderdate", "o_orderkey", "o_orderkey % 7 AS reception", "o_orderkey % 7 + o_orderkey % 5 AS target", "CAST(o_orderkey % 60 AS DOUBLE) AS air_yards_all_targets")
    order = ["o_orderdate", "o_orderkey"]
    out = with_air_yards_history(with_catch_history(o, "o_custkey", order), "o_custkey", order)
    return rounded(out.select("o_orderkey", "hist_catch_rate_career", "hist_catch_rate_l3", "hist_catch_rate_l5", "hist_air_yards_sum_l3", "hist_targets_l5", "air_yards_prev_game", "hist_targets_count_l5"))


# --- markets -------------------------------------------------------------------------------------------


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    return f"sign({x}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x})))"


@query(
    "odds_math",
    f"""WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE CAST(p_partkey % 500 - 250 AS DOUBLE) END AS price, CAST(p_size AS DOUBLE) / 2 - 13 AS spread FROM part)
SELECT p_partkey, {rs({'prob': 'CASE WHEN price > 0 THEN 100 / (price + 100) WHEN price < 0 THEN -price / (-price + 100) END', 'win': '0.5 * (1 + ' + erf_sql('(-spread / (13.45 * sqrt(2)))') + ')', 'change': 'CASE WHEN price <> 0 THEN (spread - price) / abs(price) END'})} FROM o""",
)
def _odds_math(t) -> DataFrame:
    o = t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_partkey % 500 - 250 AS DOUBLE) END AS price", "CAST(p_size AS DOUBLE) / 2 - 13 AS spread")
    return rounded(o.select("p_partkey", market.american_to_prob(F.col("price")).alias("prob"), market.spread_to_win_prob(F.col("spread")).alias("win"), market.pct_change(F.col("spread"), F.col("price")).alias("change")))


# Nested snapshots: one JSON text per (order, shipment), four outcomes each, from the row's own values.
_ODDS_JSON = (
    "concat('{{\"data\":{{\"bookmakers\":[{{\"key\":\"b', CAST(l_linenumber AS VARCHAR(9)), '\",\"markets\":[{{\"key\":\"h2h\",\"outcomes\":[{{\"name\":\"H\",\"price\":', CAST(l_partkey % 300 - 150 AS VARCHAR(9)), '}},{{\"name\":\"A\",\"price\":', CAST(l_suppkey + 100 AS VARCHAR(9)),"
    " '}}]}},{{\"key\":\"spreads\",\"outcomes\":[{{\"name\":\"H\",\"price\":-110,\"point\":', CAST(l_partkey % 14 - 7 AS VARCHAR(9)), '}},{{\"name\":\"A\",\"price\":-105}}]}},{{\"key\":\"totals\",\"outcomes\":[{{\"name\":\"Over\",\"price\":-', CAST(l_suppkey + 1 AS VARCHAR(9)), ',\"point\":', CAST(l_partkey % 20 + 35 AS VARCHAR(9)), '}}]}}]}}]}}}}')"
).replace("{{", "{").replace("}}", "}")


@query(
    "odds_consensus",
    f"""WITH q AS (SELECT l_orderkey AS event, l_linenumber AS b, CAST(l_partkey % 300 - 150 AS DOUBLE) AS h, CAST(l_suppkey + 100 AS DOUBLE) AS a, CAST(l_partkey % 14 - 7 AS DOUBLE) AS sp, CAST(-(l_suppkey + 1) AS DOUBLE) AS ov, CAST(l_partkey % 20 + 35 AS DOUBLE) AS tl FROM lineitem),
m AS (SELECT event, median(h) AS h, median(a) AS a, median(sp) AS sp, median(tl) AS tl, median(ov) AS ov, count(DISTINCT b) AS nb, CASE WHEN count(*) >= 2 THEN stddev_pop(sp) END AS sps, CASE WHEN count(*) >= 2 THEN stddev_pop(tl) END AS tls FROM q GROUP BY 1),
p AS (SELECT *, CASE WHEN h > 0 THEN 100 / (h + 100) WHEN h < 0 THEN -h / (-h + 100) END AS ph, 100 / (a + 100) AS pa FROM m)
SELECT event, {rs({'moneyline_home': 'h', 'moneyline_away': 'a', 'spread_line': 'sp', 'total_line': 'tl', 'total_over_price': 'ov', 'moneyline_book_count': 'nb', 'spread_line_std': 'sps', 'total_line_std': 'tls', 'implied_prob_home': 'ph', 'moneyline_vig': 'ph + pa - 1'})} FROM p""",
)
def _odds_consensus(t) -> DataFrame:
    snaps = t.lineitem.selectExpr("l_orderkey AS event", f"{_ODDS_JSON} AS payload", "'H' AS home_team", "'A' AS away_team")
    outcomes = market.explode_outcomes(snaps, ["event", "home_team", "away_team"])
    out = market.consensus(outcomes, ["event"])
    names = ["moneyline_home", "moneyline_away", "spread_line", "total_line", "total_over_price", "moneyline_book_count", "spread_line_std", "total_line_std", "implied_prob_home", "moneyline_vig"]
    return rounded(out.select("event", *[F.col(n).cast("double").alias(n) for n in names]))


_SNAP = "CASE l_linenumber % 5 WHEN 0 THEN 'cutoff' WHEN 1 THEN '2h' WHEN 2 THEN '6h' WHEN 3 THEN '24h' ELSE 'open' END"


@query(
    "odds_snapshot_moves",
    f"""WITH q AS (SELECT l_orderkey AS event, {_SNAP} AS lab, avg(l_quantity) AS s, avg(l_tax) AS v FROM lineitem GROUP BY ALL), w AS (SELECT event, {', '.join(f"max(s) FILTER (lab = '{k}') AS s{k}, max(v) FILTER (lab = '{k}') AS v{k}" for k in ('cutoff', '2h', '6h', '24h', 'open'))} FROM q GROUP BY 1)
SELECT event, {rs({'spread_line': 'scutoff', 'spread_line_open': 'sopen', 'spread_line_delta': 'scutoff - sopen', 'spread_line_delta_6h': 'scutoff - s6h', 'moneyline_vig_delta_24h': 'vcutoff - v24h', 'moneyline_vig_pct_delta': 'CASE WHEN vopen <> 0 THEN (vcutoff - vopen) / abs(vopen) END',
 'spread_line_move_max_abs': 'greatest(abs(scutoff - sopen), abs(scutoff - s24h), abs(scutoff - s6h), abs(scutoff - s2h))'})} FROM w""",
)
def _odds_snapshot_moves(t) -> DataFrame:
    # Labels and then columns of an event are made where its rows lie.
    q = dealt(t.lineitem, "l_orderkey").groupBy(F.col("l_orderkey").alias("event"), F.expr(_SNAP).alias("lab")).agg(F.avg("l_quantity").alias("spread_line"), F.avg("l_tax").alias("moneyline_vig"))
    out = market.largest_move(market.snapshot_columns(q, ["event"], "lab", ["spread_line", "moneyline_vig"]), "spread_line")
    return rounded(out.select("event", "spread_line", "spread_line_open", "spread_line_delta", "spread_line_delta_6h", "moneyline_vig_delta_24h", "moneyline_vig_pct_delta", "spread_line_move_max_abs"))


@query(
    "player_price_consensus",
    f"""WITH q AS (SELECT user_id AS g, ts, value AS price, 'Ann O''Neil-' || chr(CAST(97 + event_id % 26 AS INT)) || CASE WHEN event_id % 2 = 0 THEN ' Jr.' ELSE '' END AS nm, CASE WHEN event_id % 9 = 0 THEN 'No ' ELSE 'Yes' END AS oc, date_trunc('day', ts) AS snap FROM events),
st AS (SELECT g, max(ts) AS st FROM q GROUP BY 1), us AS (SELECT q.*, 'o''neil-' || chr(CAST(97 + ascii(substring(nm, 12, 1)) - 97 AS INT)) AS k FROM q JOIN st USING (g) WHERE epoch_us(snap) <= floor((epoch_us(st) - 900000000) / 300000000) * 300000000),
nw AS (SELECT g, max(snap) AS mx FROM us GROUP BY 1), p AS (SELECT us.g, k, median(price) AS m FROM us JOIN nw ON us.g = nw.g AND us.snap = nw.mx WHERE lower(trim(oc)) <> 'no' GROUP BY ALL),
pl AS (SELECT DISTINCT g, substring(nm, 12, 1) AS c FROM q) SELECT pl.g AS game_id, pl.c, {r('p.m', 'odds_anytime_td_price')} FROM pl LEFT JOIN p ON p.g = pl.g AND p.k = 'o''neil-' || pl.c""",
)
def _player_price_consensus(t) -> DataFrame:
    q = t.events.selectExpr(
        "user_id AS game_id", "ts", "value AS price", "concat('Ann O\\'Neil-', chr(97 + event_id % 26), CASE WHEN event_id % 2 = 0 THEN ' Jr.' ELSE '' END) AS description",
        "CASE WHEN event_id % 9 = 0 THEN 'No ' ELSE 'Yes' END AS outcome", "CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS snapshot_ts",
    )
    q = attach_totals(q, "game_id", {"start_ts": F.max("ts")})
    pl = q.select("game_id", F.substring("description", 12, 1).alias("c")).distinct().withColumn("player_name", F.concat(F.lit("B. O'Neil-"), F.col("c")))
    return rounded(market.player_consensus(q, pl).select("game_id", "c", "odds_anytime_td_price"))


@query(
    "stored_odds_attach",
    "WITH od AS (SELECT o_custkey % 100 AS h, o_orderpriority AS a, max_by(o_totalprice, (o_orderdate, o_totalprice)) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT o_orderkey, price, CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END AS has_odds FROM orders LEFT JOIN od ON o_custkey % 150 = h AND o_orderpriority = a",
)
def _stored_odds(t) -> DataFrame:
    odds = t.orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 100).alias("h"), F.col("o_orderpriority").alias("a"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("odds_snapshot_ts"))
    # The price breaks ties of the snapshot time.
    odds = odds.groupBy("h", "a", "odds_snapshot_ts").agg(F.max("price").alias("price"))
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 150).alias("h"), F.col("o_orderpriority").alias("a"))
    return market.attach_stored_odds(rows, odds, ["price"], ["h", "a"]).select("o_orderkey", "price", "has_odds")


# --- weather -----------------------------------------------------------------------------------------------

_FC = {
    "game_id": "user_id", "forecast_generated_ts": "ts", "forecast_lead_hours": "event_id % 100", "temp_f": "CAST(event_id % 90 AS DOUBLE)", "wind_speed_mph": "CAST(event_id % 25 AS DOUBLE)", "wind_gust_mph": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 31 AS DOUBLE) END",
    "precip_probability_pct": "CAST(event_id % 101 AS DOUBLE)", "precip_amount_in": "CAST(event_id % 30 AS DOUBLE) / 100", "snow_amount_in": "CAST(event_id % 60 AS DOUBLE) / 100", "roof": "CASE event_id % 5 WHEN 0 THEN 'Dome' WHEN 1 THEN 'outdoors' WHEN 2 THEN 'retractable (open)' END",
}


def _fc(t) -> DataFrame:
    return t.events.where("event_type = 'view'").selectExpr(*[f"{e} AS {n}" for n, e in _FC.items()])


_FC_SQL = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FC.items()) + ", lag(temp_f) OVER w AS pt, lag(wind_speed_mph) OVER w AS pw, lag(precip_probability_pct) OVER w AS pp FROM (SELECT *, " + ", ".join(f"{_FC[n]} AS {n}" for n in ("temp_f", "wind_speed_mph", "precip_probability_pct")) + " FROM events WHERE event_type = 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts))"
_UNC = lambda table, d: "CASE forecast_lead_hours " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + f" ELSE {d} END"


@query(
    "forecast_asof_features",
    f"""WITH {_FC_SQL}, g AS (SELECT event_id, user_id, ts - INTERVAL 12 HOUR AS cut FROM events WHERE event_type = 'purchase')
SELECT g.event_id, f.forecast_generated_ts AS weather_forecast_generated_ts, {rs({'weather_temp_air_f': 'temp_f', 'weather_temp_trend': 'temp_f - pt', 'weather_wind_trend': 'wind_speed_mph - pw', 'weather_precip_prob_trend': 'precip_probability_pct - pp', 'weather_forecast_uncertainty_temp': f'CASE WHEN forecast_lead_hours IS NOT NULL THEN {_UNC(weather.TEMP_UNCERTAINTY, 4.5)} END',
 'weather_forecast_uncertainty_wind': f'CASE WHEN forecast_lead_hours IS NOT NULL THEN {_UNC(weather.WIND_UNCERTAINTY, 3.5)} END'})},
 CASE WHEN greatest(coalesce(wind_speed_mph, 0), coalesce(wind_gust_mph, 0)) >= 20 THEN 1 ELSE 0 END AS weather_extreme_wind_flag, CASE WHEN coalesce(temp_f, 60) <= 32 THEN 1 ELSE 0 END AS weather_freezing_flag,
 CASE WHEN coalesce(precip_probability_pct, 0) >= 70 OR coalesce(precip_amount_in, 0) >= 0.25 OR coalesce(snow_amount_in, 0) >= 0.5 THEN 1 ELSE 0 END AS weather_heavy_precip_flag,
 CASE WHEN regexp_matches(upper(coalesce(roof, '')), 'DOME|INDOOR|RETRACTABLE|CLOSED') THEN 1 ELSE 0 END AS roof_is_indoor_flag,
 CASE WHEN NOT regexp_matches(upper(coalesce(roof, '')), 'DOME|INDOOR|RETRACTABLE|CLOSED') AND (greatest(coalesce(wind_speed_mph, 0), coalesce(wind_gust_mph, 0) * 0.8) >= 17 OR coalesce(precip_probability_pct, 0) >= 60 OR coalesce(precip_amount_in, 0) >= 0.25 OR coalesce(snow_amount_in, 0) >= 0.25
  OR greatest(coalesce(wind_speed_mph, 0), coalesce(wind_gust_mph, 0)) >= 20 OR coalesce(temp_f, 60) <= 32) THEN 1 ELSE 0 END AS weather_bad_passing_flag
FROM g ASOF LEFT JOIN f ON g.user_id = f.game_id AND g.cut >= f.forecast_generated_ts""",
)
def _forecast_asof(t) -> DataFrame:
    games = cutoff.with_cutoff(t.events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("game_id"), "ts"), "ts", 12.0)
    out = weather.with_context_flags(weather.attach_forecast(games, _fc(t)))
    return rounded(out.select("event_id", "weather_forecast_generated_ts", "weather_temp_air_f", "weather_temp_trend", "weather_wind_trend", "weather_precip_prob_trend", "weather_forecast_uncertainty_temp", "weather_forecast_uncertainty_wind",
                              "weather_extreme_wind_flag", "weather_freezing_flag", "weather_heavy_precip_flag", "roof_is_indoor_flag", "weather_bad_passing_flag"))


_WX = {
    "id": "event_id", "home_team_abbr": "CASE event_id % 6 WHEN 0 THEN 'DET' WHEN 1 THEN 'MIA' WHEN 2 THEN 'SEA' WHEN 3 THEN 'GB' WHEN 4 THEN 'HOU' END", "conditions": "CASE event_id % 7 WHEN 0 THEN 'Rain, Overcast' WHEN 1 THEN 'Partly cloudy' WHEN 2 THEN 'Clear' WHEN 3 THEN 'Snow fog' WHEN 4 THEN 'cloudy' WHEN 5 THEN 'x' END",
    "precip": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 9 AS DOUBLE) END", "precipprob": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END", "winddir": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 360 AS DOUBLE) END",
    "wind_bearing": "CASE WHEN event_id % 10 = 0 THEN 90.0 END", "windspeed": "CASE WHEN event_id % 15 = 0 THEN NULL ELSE CAST(event_id % 12 AS DOUBLE) END", "cloudcover": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END",
}


@query(
    "observed_weather_cleaning",
    f"""WITH w AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _WX.items())} FROM events), r AS (SELECT *, CASE WHEN home_team_abbr IN ('DET', 'HOU') OR (home_team_abbr IN ('HOU', 'MIA', 'SEA') AND regexp_matches(lower(conditions), 'rain|snow|thunderstorm|drizzle|showers')) THEN 1 ELSE 0 END AS is_roof_closed FROM w),
d AS (SELECT *, coalesce(winddir, wind_bearing) AS wd0 FROM r), e AS (SELECT *, CASE WHEN wd0 IS NULL AND (windspeed IS NULL OR windspeed = 0) THEN 0 ELSE wd0 END AS wd, CASE WHEN wd0 IS NULL AND windspeed IS NULL THEN 0 ELSE windspeed END AS ws FROM d)
SELECT id, is_roof_closed, {rs({'precip': 'coalesce(precip, 0)', 'precipprob': 'coalesce(precipprob, 0)', 'winddir': 'wd', 'windspeed': 'ws',
 'cloudcover': "CASE WHEN cloudcover IS NOT NULL THEN cloudcover WHEN is_roof_closed = 1 OR ws = 0 THEN 0 WHEN conditions LIKE '%fog%' THEN 95 WHEN lower(conditions) LIKE '%rain%' THEN 80 WHEN conditions ILIKE '%cloudy%' THEN 50 WHEN conditions = 'Clear' THEN 0 ELSE 50 END",
 'wind_sin': 'CASE WHEN ws > 0 AND wd IS NOT NULL THEN sin(radians(wd)) ELSE 0 END', 'wind_cos': 'CASE WHEN ws > 0 AND wd IS NOT NULL THEN cos(radians(wd)) ELSE 0 END', 'headwind_component': 'ws * cos(radians(wd))', 'wind_y': 'ws * sin(radians(wd))', 'wind_resistance': 'ws * ws * 0.001', 'wind_assistance': '-(ws * cos(radians(wd)))'})} FROM e""",
)
def _observed_weather(t) -> DataFrame:
    w = t.events.selectExpr(*[f"CAST({e} AS DOUBLE) AS {n}" if n == "wind_bearing" else f"{e} AS {n}" for n, e in _WX.items()])
    out = weather.with_wind_features(weather.clean_observed(weather.with_roof_status(w)))
    return rounded(out.select("id", "is_roof_closed", "precip", "precipprob", "winddir", "windspeed", "cloudcover", "wind_sin", "wind_cos", "headwind_component", "wind_y", "wind_resistance", "wind_assistance"))


@query(
    "observed_weather_attach",
    f"""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr, avg(value) AS windspeed FROM events WHERE event_type = 'view' GROUP BY ALL), e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hr FROM events WHERE event_type = 'error'),
b AS (SELECT e.*, h.hr AS bh, h.windspeed AS bw FROM e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.hr >= h.hr), f AS (SELECT e.event_id, h.hr AS fh, h.windspeed AS fw FROM e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.hr <= h.hr),
m AS (SELECT b.event_id, CASE WHEN b.hr - bh <= INTERVAL 6 HOUR THEN bw WHEN fh - b.hr <= INTERVAL 6 HOUR THEN fw END AS w, coalesce(b.hr - bh <= INTERVAL 6 HOUR, false) OR coalesce(fh - b.hr <= INTERVAL 6 HOUR, false) AS hit FROM b JOIN f USING (event_id))
SELECT event_id, {r('CASE WHEN event_id % 4 = 0 THEN 0 ELSE w END', 'windspeed')}, hit::INT AS weather_matched FROM m""",
)
def _observed_weather_attach(t) -> DataFrame:
    hourly = t.events.where("event_type = 'view'").groupBy("user_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hr")).agg(F.avg("value").alias("windspeed"))
    rows = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    out = weather.attach_observed(rows, hourly, ["user_id"], "ts", "hr", ["windspeed"], 6 * 3600.0, F.col("event_id") % 4 == 0)
    return rounded(out.select("event_id", "windspeed", "weather_matched"))


@query(
    "forecast_schedule",
    "WITH g AS (SELECT o_orderkey, o_orderdate, unnest([1.0, 6.0, 24.0, 96.0]) AS h FROM orders) SELECT o_orderkey, h AS forecast_lead_hours, o_orderdate - to_hours(CAST(h AS INT)) AS forecast_generated_ts, (o_orderdate - to_hours(CAST(h AS INT)) < TIMESTAMP '2000-06-01' - INTERVAL 30 MINUTE)::INT AS forecast_is_backfill, (o_orderdate < TIMESTAMP '2000-06-01')::INT AS forecast_is_historical "
    "FROM g WHERE o_orderdate - to_hours(CAST(h AS INT)) <= TIMESTAMP '2000-06-01' + INTERVAL 1 MINUTE",
)
def _forecast_schedule(t) -> DataFrame:
    games = t.orders.select("o_orderkey", F.col("o_orderdate").alias("start_time_utc"))
    out = weather.forecast_schedule(games, [1.0, 6.0, 24.0, 96.0], F.lit("2000-06-01").cast("timestamp_ntz"))
    return out.select("o_orderkey", "forecast_lead_hours", "forecast_generated_ts", "forecast_is_backfill", "forecast_is_historical")


@query("unit_conversion", f"SELECT event_id, {rs({'temp': 'value * 9 / 5 + 32', 'windspeed': 'value * 0.621371'})} FROM events")
def _unit_conversion(t) -> DataFrame:
    return rounded(weather.to_imperial(t.events.select("event_id", F.col("value").alias("temp"), F.col("value").alias("windspeed"))))


# --- travel and time ------------------------------------------------------------------------------------------

_LAT, _LON = "CAST(o_orderkey * 7 % 40 AS DOUBLE) + 25", "-CAST(o_orderkey * 13 % 50 AS DOUBLE) - 70"
_HAV = "2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(lag(lat) OVER w)) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lag(lon) OVER w)) / 2), 2)))"


@query(
    "travel_sequence",
    f"""WITH o AS (SELECT o_custkey AS team, o_orderdate AS st, max(o_orderkey) AS id FROM orders GROUP BY ALL), g AS (SELECT *, {_LAT.replace('o_orderkey', 'id')} AS lat, {_LON.replace('o_orderkey', 'id')} AS lon, (id % 3 > 0)::INT AS home FROM o),
a AS (SELECT *, row_number() OVER w AS num, (epoch_us(st) - epoch_us(lag(st) OVER w)) / 86400e6 AS rest, {_HAV} AS km, row_number() OVER w - row_number() OVER (PARTITION BY team, home ORDER BY st) AS isl FROM g WINDOW w AS (PARTITION BY team ORDER BY st)),
b AS (SELECT *, row_number() OVER (PARTITION BY team, home, isl ORDER BY st) AS run, avg(km) OVER w3 AS km3, avg(rest) OVER w3 AS rest3 FROM a WINDOW w3 AS (PARTITION BY team ORDER BY st ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT id, CAST(num AS INT) AS season_game_number, {rs({'rest_days': 'rest', 'travel_km': 'km', 'travel_miles': 'km * 0.621371', 'travel_km_rolling3': 'km3', 'rest_days_rolling3': 'rest3'}, 4)}, CAST(CASE WHEN home = 1 THEN run ELSE 0 END AS INT) AS consecutive_home_games,
 CAST(CASE WHEN home = 1 THEN 0 ELSE run END AS INT) AS consecutive_road_games, CASE WHEN rest <= 5 THEN 1 ELSE 0 END AS is_short_week, CASE WHEN rest >= 10 THEN 1 ELSE 0 END AS is_long_rest, CASE WHEN rest >= 13 THEN 1 ELSE 0 END AS bye_week_flag FROM b""",
)
def _travel_sequence(t) -> DataFrame:
    games = t.orders.groupBy(F.col("o_custkey").alias("team"), F.col("o_orderdate").alias("start_time_utc")).agg(F.max("o_orderkey").alias("id"))
    games = games.selectExpr("*", f"{_LAT.replace('o_orderkey', 'id')} AS stadium_lat", f"{_LON.replace('o_orderkey', 'id')} AS stadium_lon", "CASE WHEN id % 3 > 0 THEN 1 ELSE 0 END AS is_home", "'America/New_York' AS stadium_tz", "'America/Denver' AS team_home_tz")
    out = travel.with_sequence(games)
    return rounded(out.select("id", "season_game_number", "rest_days", "travel_km", "travel_miles", "travel_km_rolling3", "rest_days_rolling3", "consecutive_home_games", "consecutive_road_games", "is_short_week", "is_long_rest", "bye_week_flag"), 4)


@query(
    "event_clock",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate AS st, l_linenumber AS q, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey % 1000 END AS rem FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, st + to_seconds(CAST(CASE WHEN rem IS NULL THEN 0 WHEN q BETWEEN 1 AND 4 THEN (q - 1) * 900 + 900 - least(rem, 900) ELSE 3600 + (q - 5) * 600 + 600 - least(rem, 600) END AS INT)) AS utc_ts FROM c""",
)
def _event_clock(t) -> DataFrame:
    rem = F.expr("CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey % 1000 END")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", travel.event_clock(F.col("l_shipdate"), F.col("l_linenumber"), rem).cast("timestamp_ntz").alias("utc_ts"))


@query(
    "missing_timestamps",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts FROM events), f AS (SELECT *, last_value(ts IGNORE NULLS) OVER a AS b, first_value(ts IGNORE NULLS) OVER z AS n FROM e
 WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, coalesce(ts, make_timestamp(CAST(floor((epoch_us(b) + epoch_us(n)) / 2) AS BIGINT)), b + INTERVAL 10 MILLISECOND, n - INTERVAL 10 MILLISECOND) AS ts FROM f""",
)
def _missing_timestamps(t) -> DataFrame:
    e = t.events.selectExpr("user_id", "event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts")
    return travel.fill_timestamps(e, "user_id", ["event_id"], "ts").select("user_id", "event_id", "ts")


@query(
    "gap_features",
    f"""SELECT o_orderkey, {rs({'minutes_since_last': "floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / 60e6)", 'rest_days_since_last': "floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / 60e6) / 1440", 'depth_order_delta': 'o_totalprice - lag(o_totalprice) OVER w'}, 3)} FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _gap_features(t) -> DataFrame:
    out = travel.with_gap_features(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "o_totalprice")
    return rounded(out.select("o_orderkey", F.col("minutes_since_last").cast("double").alias("minutes_since_last"), "rest_days_since_last", "depth_order_delta"), 3)


@query(
    "label_changes",
    """WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus <> lag(o_orderstatus) OVER w THEN 1 ELSE 0 END AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, c AS changed_last_game, greatest(c, coalesce(lag(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0)) AS changed_last2 FROM a""",
)
def _label_changes(t) -> DataFrame:
    out = travel.with_changes(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", "changed")
    return out.select("o_orderkey", "changed_last_game", "changed_last2")


@query("calendar_parts", "SELECT event_id, CAST(hour(ts) AS INT) AS game_start_hour_utc, CAST(isodow(ts) AS INT) AS game_day_of_week FROM events")
def _calendar_parts(t) -> DataFrame:
    return travel.with_calendar(t.events, "ts").select("event_id", "game_start_hour_utc", "game_day_of_week")


# --- text ---------------------------------------------------------------------------------------------------


@query(
    "name_normalisation",
    r"""WITH c AS (SELECT conv_id, turn, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM conversations), n AS (SELECT conv_id, turn, list_filter(w, lambda x: x <> '') AS w FROM c)
SELECT conv_id, turn, CASE WHEN len(w) >= 2 THEN substring(w[1], 1, 1) || '.' || w[len(w)] WHEN len(w) = 1 THEN w[1] ELSE '' END AS short,
 CASE WHEN len(w) >= 2 AND lower(w[len(w)]) IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') THEN lower(w[len(w) - 1]) ELSE lower(coalesce(w[len(w)], '')) END AS last, lower(array_to_string(w, '')) AS key FROM n""",
)
def _name_normalisation(t) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda w: w != "")
    n = t.conversations.withColumn("name", F.array_join(words, " "))
    return n.select("conv_id", "turn", text.short_name(F.col("name")).alias("short"), text.last_name(F.col("name")).alias("last"), text.name_key(F.col("name")).alias("key"))


@query(
    "alias_match",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) END AS s_suppkey, CASE WHEN c_custkey % 4 = 3 THEN 'Nobody ' || c_custkey ELSE 'Supplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0') END AS matched_name FROM customer",
)
def _alias_match(t) -> DataFrame:
    raw = F.expr("CASE WHEN c_custkey % 4 = 3 THEN concat('Nobody ', c_custkey) ELSE concat('Unknown (x), Supplier#', lpad(CAST(c_custkey % 100 AS STRING), 9, '0'), ' (alias) / Other') END")
    rows = t.customer.select("c_custkey", raw.alias("raw"))
    known = t.supplier.select("s_name", "s_suppkey")
    out = text.match_aliases(rows, "c_custkey", "raw", known, "s_name", "s_suppkey")
    return out.select("c_custkey", F.col("s_suppkey").cast("double").alias("s_suppkey"), "matched_name")


@query("code_normalisation", "SELECT c_custkey, CASE upper(c_mktsegment) WHEN 'HOUSEHOLD' THEN 'HH' WHEN 'MACHINERY' THEN 'MA' ELSE c_mktsegment END AS code, regexp_replace(c_name, '#0*', ' #') AS name FROM customer")
def _code_normalisation(t) -> DataFrame:
    code = text.normalize_code(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")), {"HOUSEHOLD": "HH", "MACHINERY": "MA"})
    spaced = text.clean_text(F.regexp_replace("c_name", "#0*", "   #"))
    kept = F.when(code.isin("HH", "MA"), code).otherwise(F.upper(code))
    return t.customer.select("c_custkey", kept.alias("code"), spaced.alias("name"))


# --- sequences of reports ---------------------------------------------------------------------------------------

_REP = "CASE event_id % 4 WHEN 0 THEN 'DID NOT PARTICIPATE' WHEN 1 THEN 'Limited' WHEN 2 THEN 'FULL' END"
_RS = "CASE event_id % 5 WHEN 0 THEN 'OUT' WHEN 1 THEN 'Questionable' END"


@query(
    "report_summary",
    f"""WITH e AS (SELECT user_id, ts, upper({_REP}) AS pr, upper({_RS}) AS rp, max(ts) OVER (PARTITION BY user_id) - INTERVAL 24 HOUR AS cut FROM events), k AS (SELECT * FROM e WHERE ts <= cut),
p AS (SELECT user_id, list(pr ORDER BY ts) FILTER (pr IS NOT NULL) AS ps, list(rp ORDER BY ts) FILTER (rp IS NOT NULL) AS rs, list(ts ORDER BY ts) AS tt, any_value(cut) AS cut, count(*) AS n,
 count(*) FILTER (pr = 'DID NOT PARTICIPATE') AS dnp, count(*) FILTER (pr = 'LIMITED') AS lim FROM k GROUP BY 1)
SELECT user_id, n AS injury_report_count, dnp AS injury_practice_dnp_count, lim AS injury_practice_limited_count, ps[1] AS injury_practice_status_day1, ps[2] AS injury_practice_status_day2, ps[3] AS injury_practice_status_day3, rs[len(rs)] AS injury_game_designation, ps[len(ps)] AS injury_practice_status,
 array_to_string(ps, '>') AS injury_practice_status_sequence, CAST(len(list_filter(ps[greatest(len(ps) - 2, 1):], lambda x: x = 'DID NOT PARTICIPATE')) AS BIGINT) AS injury_practice_dnp_last3,
 {rs({'injury_hours_since_last_report': 'floor((epoch_us(cut) - epoch_us(tt[len(tt)])) / 60e6) / 60', 'injury_hours_between_last_reports': 'floor((epoch_us(tt[len(tt)]) - epoch_us(tt[len(tt) - 1])) / 60e6) / 60'})} FROM p""",
)
def _report_summary(t) -> DataFrame:
    e = attach_totals(t.events, "user_id", {"last": F.max("ts")})
    e = cutoff.with_cutoff(e.selectExpr("user_id", "ts AS reported_at", f"{_REP} AS practice_status", f"{_RS} AS report_status", "last"), "last", 24.0)
    out = injuries.report_summary(e, ["user_id"], start=None)
    return rounded(out.select("user_id", "injury_report_count", "injury_practice_dnp_count", "injury_practice_limited_count", "injury_practice_status_day1", "injury_practice_status_day2", "injury_practice_status_day3", "injury_game_designation",
                              "injury_practice_status", "injury_practice_status_sequence", F.col("injury_practice_dnp_last3").cast("bigint").alias("injury_practice_dnp_last3"), "injury_hours_since_last_report", "injury_hours_between_last_reports"))


# --- schema and sources --------------------------------------------------------------------------------------------


@query(
    "schema_summary",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{ty}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, CAST((count(*) - count({c})) / count(*) AS DOUBLE) AS null_share FROM customer" for c, ty in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))),
)
def _schema_summary(t) -> DataFrame:
    return schema_summary(t.customer)


@query("conform_and_defaults", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, NULL::INT AS absent, 'UNKNOWN' AS status FROM customer")
def _conform_and_defaults(t) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("c_custkey", T.DoubleType()), T.StructField("c_name", T.StringType()), T.StructField("absent", T.IntegerType())])
    return with_defaults(conform(t.customer, schema), {"status": "UNKNOWN"})


@query("date_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def _date_range_scan(t) -> DataFrame:
    return readers.between_days(t.orders, "o_orderdate", "1997-01-01", "1997-03-31").select("o_orderkey", "o_totalprice")


@query(
    "dimension_prepare",
    "SELECT year(o_orderdate) AS season, month(o_orderdate) AS week, 'N' || (o_custkey % 12) AS team, max(o_totalprice) AS dropbacks FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL",
)
def _dimension_prepare(t) -> DataFrame:
    rows = t.orders.selectExpr("year(o_orderdate) AS season", "month(o_orderdate) AS week", "concat(' N', o_custkey % 12, ' ') AS team", "o_totalprice AS dropbacks")
    return readers.prepare_dimension(rows, "qb_profiles", [1996, 1997])


@query("partitioned_round_trip", "SELECT year(o_orderdate) AS season, month(o_orderdate) AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) IN (1996, 1999) GROUP BY ALL")
def _partitioned_round_trip(t) -> DataFrame:
    """Write by (season, week), replace one season, read back with pruning and a merged schema."""
    path = shared_folder(t.spark, "weekly")
    rows = t.orders.withColumns({"season": F.year("o_orderdate"), "week": F.month("o_orderdate")})
    writers.write_partitions(rows.withColumn("o_totalprice", F.lit(0.0)), path)
    writers.write_partitions(rows, path)
    back = readers.only_seasons(readers.read_partitioned(t.spark, path), [1996, 1999])
    return back.groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("daily_cache_append", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
def _daily_cache_append(t) -> DataFrame:
    """Append-only day cache: the second run adds only days the first did not write."""
    path = shared_folder(t.spark, "cache")
    days = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("denom")).withColumn("ctx", F.lit("vs_any"))
    writers.append_missing_days(days.where("dayofmonth(date) <= 20"), path)
    writers.append_missing_days(days, path)
    cache = writers.read_cache(t.spark, path, "2024-01-01", "2024-01-31", t.events.select("user_id"), "user_id", "vs_any")
    return cache.groupBy(F.col("date").cast("string").alias("date")).agg(F.sum("denom").cast("bigint").alias("n"))


@query("arrival_log", "SELECT event_id, round(CAST(epoch_us(ts + INTERVAL 90 MINUTE) - epoch_us(ts + INTERVAL 10 MINUTE) AS DOUBLE) / 60e6, 3) AS minutes_until_kickoff, 10.0 AS minutes_since_snapshot, event_type AS kind FROM events")
def _arrival_log(t) -> DataFrame:
    path = shared_folder(t.spark, "arrivals")
    base = t.events.select("event_id", "event_type", F.col("ts").alias("feed_timestamp"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("game_start_ts"))
    rows = writers.arrival_rows(base, "odds", "cutoff", F.col("feed_timestamp") + F.expr("INTERVAL 10 MINUTES"), "game_start_ts", "feed_timestamp", ["event_type"])
    writers.log_arrivals(rows, path)
    back = readers.read_arrival_logs(t.spark, path)
    return back.select("event_id", "minutes_until_kickoff", "minutes_since_snapshot", F.get_json_object("metadata_json", "$.event_type").alias("kind"))


@query(
    "ranked_output",
    "SELECT o_orderkey AS player_id, round(CAST(o_orderkey % 100 AS DOUBLE) / 100, 6) AS prob_anytime_td_flat, CASE WHEN o_orderkey % 100 >= 50 THEN 1 ELSE 0 END AS prediction FROM orders",
)
def _ranked_output(t) -> DataFrame:
    base = t.orders.select(F.col("o_orderkey").alias("player_id"), (F.col("o_orderkey") % 100 / 100).alias("pred_anytime_td"), F.to_date("o_orderdate").alias("game_date"))
    out = writers.format_output(base, "pred_anytime_td", 0.5, rank_by="prob_anytime_td_flat")
    return out.select("player_id", F.round("prob_anytime_td_flat", 6).alias("prob_anytime_td_flat"), "prediction")


@query("point_lookup", "SELECT o_orderkey AS game_id, o_orderdate AS start_time_utc FROM orders WHERE o_orderkey = 17")
def _point_lookup(t) -> DataFrame:
    return readers.game_info(t.orders.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("start_time_utc")), 17)


# --- streams --------------------------------------------------------------------------------------------------------


def _event_stream(t) -> DataFrame:
    return streams.file_stream(t.spark, t.sf_dir, t.events.schema, "events.parquet")


@query(
    "stream_daily_totals",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id, {r('sum(value)', 'value_num', 4)}, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS bought_num, count(*) AS denom FROM events GROUP BY ALL",
)
def _stream_daily_totals(t) -> DataFrame:
    path, check = shared_folder(t.spark, "daily"), shared_folder(t.spark, "daily-check")
    flags = {"bought": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"}
    totals = streams.daily_totals_stream(_event_stream(t), "user_id", "ts", ["value", "bought"], "2 days", flags=flags)
    streams.run_to_end(streams.run_upsert(totals, path, check, ["user_id", "date"], ["date"]))
    out = t.spark.read.parquet(path)
    return out.select(F.col("date").cast("string").alias("date"), "user_id", rd("value_num", 4).alias("value_num"), F.col("bought_num").cast("bigint").alias("bought_num"), "denom")


@query("stream_upsert_last", "SELECT user_id, event_type, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM events GROUP BY ALL")
def _stream_upsert_last(t) -> DataFrame:
    path, check = shared_folder(t.spark, "upsert"), shared_folder(t.spark, "upsert-check")
    feed = _event_stream(t).select("user_id", "event_type", "ts", "event_id")
    streams.run_to_end(streams.run_upsert(feed, path, check, ["user_id", "event_type"], ["event_type"], "append", "ts"))
    return t.spark.read.parquet(path).select("user_id", "event_type", "ts", "event_id")


@query(
    "stream_asof_history",
    "WITH v AS (SELECT user_id, ts AS vts, value AS view_value FROM events WHERE event_type = 'view') SELECT p.event_id, p.user_id, v.vts AS matched_ts, v.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.vts",
)
def _stream_asof_history(t) -> DataFrame:
    """Purchases of four spans of time in four micro-batches, each against a seed and the days it spans."""
    path, check, feed = (shared_folder(t.spark, n) for n in ("asof", "asof-check", "purchases"))
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("value").alias("view_value"))
    purchases = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    history = SeededHistory(t.spark, shared_folder(t.spark, "views"), "user_id", "vts", ["view_value"])
    edges = [x[0] for x in t.events.agg(F.explode(F.expr("transform(percentile_approx(unix_date(cast(ts as date)), array(0.25, 0.5, 0.75)), x -> date_from_unix_date(x))"))).collect()]
    spans = list(zip([None, *edges], [*edges, None], strict=True))

    def inside(day: str, low, high) -> Column:
        above = F.lit(True) if low is None else F.to_date(day) > F.lit(low)
        return above if high is None else above & (F.to_date(day) <= F.lit(high))

    files = 0
    for low, high in spans:  # the feed comes in by day; each time a seed for the next days is left
        history.add(views.where(inside("vts", low, high)))
        purchases.where(inside("ts", low, high)).write.mode("append").parquet(feed)
        files = files or len(t.spark.read.parquet(feed).inputFiles())
    stream = streams.file_stream(t.spark, feed, purchases.schema, files_per_batch=max(1, files))
    streams.run_to_end(streams.attach_history_stream(stream, history, ["user_id"], "ts", "vts", ["view_value"], path, check, ["day"], ["event_id", "day"]))
    return t.spark.read.parquet(path).select("event_id", "user_id", "matched_ts", "view_value")


@query("stream_latency_windows", f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, {rs({'mean': 'avg(value)', 'max': 'max(value)'})} FROM events GROUP BY ALL")
def _stream_latency(t) -> DataFrame:
    path, check = shared_folder(t.spark, "latency"), shared_folder(t.spark, "latency-check")
    table = streams.latency_stream(_event_stream(t), "ts", "value", ["event_type"]).withColumn("day", F.to_date("window_start"))
    streams.run_to_end(streams.run_upsert(table, path, check, ["event_type", "day"], ["day"]))
    return rounded(t.spark.read.parquet(path).select("event_type", F.col("day").cast("string").alias("day"), "n", "mean", "max"))


@query(
    "feature_matrix",
    f"""WITH {player_games_sql('player_id', 'game_date', 'season', 'target')}, d AS (SELECT player_id, game_date, season, CAST(sum(target) AS DOUBLE) AS t, count(*) AS n FROM pg GROUP BY ALL)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, {rs({f'{k}g_target_per_game': f'sum(t) OVER w{k} / sum(n) OVER w{k}' for k in (1, 3, 5)})}, {r('sum(t) OVER ws / sum(n) OVER ws', 'season_target_per_game')}, {r('sum(t) OVER wl / sum(n) OVER wl', 'lifetime_target_per_game')} FROM d
WINDOW w1 AS (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 ws AS (PARTITION BY player_id, season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wl AS (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _feature_matrix(t) -> DataFrame:
    rows = player_games(t.lineitem, "player_id", "game_date", "season", "target")
    out = FP.per_game_rolling(rows, ["target"])
    return rounded(out.drop("season").withColumn("game_date", F.col("game_date").cast("string")))


@query(
    "team_rate_histories",
    f"""WITH {player_games_sql('season', 'week', 'team', 'opponent', 'touchdowns')}, u AS (SELECT *, season * 100 + week AS unit, (touchdowns > 1)::INT AS hit FROM pg), a AS (SELECT team, season, unit, max(hit) AS h FROM u GROUP BY ALL), b AS (SELECT opponent, season, unit, max(hit) AS h FROM u GROUP BY ALL),
ah AS (SELECT team, unit, avg(h) OVER w1 AS r1, avg(h) OVER w2 AS r2, avg(h) OVER ws AS rsn, avg(h) OVER wl AS rl FROM a WINDOW w1 AS (PARTITION BY team ORDER BY unit ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY team ORDER BY unit ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
 ws AS (PARTITION BY team, season ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wl AS (PARTITION BY team ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bh AS (SELECT opponent, unit, avg(h) OVER (PARTITION BY opponent ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rl FROM b)
SELECT u.team, u.opponent, u.unit, count(*) AS n, {rs({'team_r1': 'any_value(ah.r1)', 'team_r2': 'any_value(ah.r2)', 'team_rs': 'any_value(ah.rsn)', 'team_rl': 'any_value(ah.rl)', 'opp_rl': 'any_value(bh.rl)'})} FROM u JOIN ah ON u.team = ah.team AND u.unit = ah.unit JOIN bh ON u.opponent = bh.opponent AND u.unit = bh.unit GROUP BY u.team, u.opponent, u.unit""",
)
def _team_rate_histories(t) -> DataFrame:
    rows = player_games(t.lineitem, "season", "week", "team", "opponent", "touchdowns").withColumn("hit", F.when(F.col("touchdowns") > 1, 1).otherwise(0))
    out = FP.rate_histories(rows, "hit")
    return rounded(out.groupBy("team", "opponent", (F.col("season") * 100 + F.col("week")).alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.max("team_hit_rate_1").alias("team_r1"), F.max("team_hit_rate_2").alias("team_r2"), F.max("team_hit_rate_season").alias("team_rs"), F.max("team_hit_rate_lifetime").alias("team_rl"), F.max("opp_hit_rate_lifetime").alias("opp_rl"),
    ))


@query("top_k_report", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 5")
def _top_k_report(t) -> DataFrame:
    out = t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return out.orderBy(F.desc("total"), "l_suppkey").limit(5)


@query("asof_contexts_strict", "WITH v AS (SELECT user_id, ts AS vts, max(event_id) AS vid FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, CAST(v.vid AS DOUBLE) AS vid FROM events p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.vts")
def _asof_strict(t) -> DataFrame:
    v = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("event_id").cast("double").alias("vid"))
    return asof_join(t.events.select("event_id", "user_id", "ts"), v, "user_id", "ts", "vts", ["vid"], allow_exact=False).select("event_id", "vid")


@query("dedupe_latest_profile", "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p FROM lineitem) SELECT k, max_by(n, (q, p)) AS n, max(q) AS q FROM l GROUP BY k")
def _dedupe_latest_profile(t) -> DataFrame:
    base = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return latest_by(base, "k", [F.col("q"), F.col("p")], ["n", "q"])
