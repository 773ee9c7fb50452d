"""Queries: flagship, cutoffs, as-of joins, prior windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cutoff
from ..operators.asof import asof_join, asof_nearest, latest_known
from ..operators.keys import latest_by, ratio, seconds_between
from ..operators.prior import event_rate_history, rolling_ratios, runs
from ..plans.purchase_context import daily_totals, purchase_context
from .registry import query, r, rd, rounded, rs

DAYS_SQL = """
days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n,
         count(*) FILTER (event_type = 'purchase') AS purchases, sum(value) AS total
  FROM events GROUP BY ALL)"""


@query(
    "purchase_context",
    f"""
WITH {DAYS_SQL},
hist AS (
  SELECT user_id, day,
    sum(purchases) OVER w3 / nullif(sum(n) OVER w3, 0) AS purchase_rate_l3,
    sum(total) OVER w3 / nullif(sum(n) OVER w3, 0) AS mean_value_l3,
    sum(purchases) OVER wm / nullif(sum(n) OVER wm, 0) AS purchase_rate_mtd,
    sum(total) OVER wm / nullif(sum(n) OVER wm, 0) AS mean_value_mtd
  FROM days
  WINDOW w3 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         wm AS (PARTITION BY user_id, date_trunc('month', day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT event_id, user_id, ts, value, ts - INTERVAL 6 HOUR AS cutoff_ts, CAST(ts AS DATE) AS day
      FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts AS view_ts, value AS view_value, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT p.user_id, p.event_id, p.ts, p.value, p.cutoff_ts, v.view_id::DOUBLE AS view_id, v.view_value, v.view_ts,
  {r('h.purchase_rate_l3', 'purchase_rate_l3')}, {r('h.mean_value_l3', 'mean_value_l3')},
  {r('h.purchase_rate_mtd', 'purchase_rate_mtd')}, {r('h.mean_value_mtd', 'mean_value_mtd')},
  (v.view_ts IS NOT NULL)::INT AS view_known,
  {r("(epoch_us(p.ts) - epoch_us(v.view_ts)) / 3600e6", 'hours_since_view')}
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.cutoff_ts >= v.view_ts
LEFT JOIN hist h ON h.user_id = p.user_id AND h.day = p.day
""",
)
def _purchase_context(t) -> DataFrame:
    return rounded(purchase_context(t.events).withColumn("view_id", F.col("view_id").cast("double")))


@query(
    "rolling_ratio_prior",
    f"""
WITH {DAYS_SQL}
SELECT user_id, CAST(day AS VARCHAR) AS day,
  {rs({f'{name}_l{n}': f'sum({num}) OVER w{n} / nullif(sum(n) OVER w{n}, 0)' for name, num in (('purchase_rate', 'purchases'), ('mean_value', 'total')) for n in (1, 3, 5)})},
  {rs({f'{name}_lifetime': f'sum({num}) OVER wl / nullif(sum(n) OVER wl, 0)' for name, num in (('purchase_rate', 'purchases'), ('mean_value', 'total'))})},
  {rs({f'{name}_mtd': f'sum({num}) OVER wm / nullif(sum(n) OVER wm, 0)' for name, num in (('purchase_rate', 'purchases'), ('mean_value', 'total'))})}
FROM days
WINDOW w1 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING),
  w3 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  wl AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  wm AS (PARTITION BY user_id, date_trunc('month', day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
def _rolling_ratio_prior(t) -> DataFrame:
    out = rolling_ratios(
        daily_totals(t.events),
        "user_id",
        "day",
        {"purchase_rate": ("purchases", "n"), "mean_value": ("total", "n")},
        slice_of={"mtd": "month"},
    )
    return rounded(out.drop("n", "purchases", "total", "month").withColumn("day", F.col("day").cast("string")))


@query(
    "support_gate",
    f"""
WITH d AS (SELECT o_custkey % 200 AS cust, o_orderpriority AS prio, CAST(o_orderdate AS DATE) AS day,
                  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS hits, count(*) AS n
           FROM orders GROUP BY ALL),
w AS (SELECT *, sum(hits) OVER wl AS ph, sum(n) OVER wl AS pn FROM d
      WINDOW wl AS (PARTITION BY cust, prio ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT cust, prio, CAST(day AS VARCHAR) AS day,
  {r('CASE WHEN pn >= 4 THEN ph / pn END', 'hit_rate')}
FROM w
""",
)
def _support_gate(t) -> DataFrame:
    """Sparse-context ratio that needs a prior denominator of at least 4."""
    days = (
        t.orders.groupBy(
            (F.col("o_custkey") % 200).alias("cust"), F.col("o_orderpriority").alias("prio"), F.to_date("o_orderdate").alias("day")
        )
        .agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("hits"), F.count(F.lit(1)).alias("n"))
    )
    out = rolling_ratios(days, ["cust", "prio"], "day", {"hit_rate": ("hits", "n")}, windows=(), min_support={"hit_rate": 4})
    return out.select("cust", "prio", F.col("day").cast("string").alias("day"), rd("hit_rate_lifetime").alias("hit_rate"))


@query(
    "asof_backward",
    """
WITH v AS (SELECT user_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.view_ts, v.view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts
""",
)
def _asof_backward(t) -> DataFrame:
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(left, views, "user_id", "ts", "view_ts", ["view_value"], matched_ts="view_ts")


@query(
    "asof_forward",
    """
WITH v AS (SELECT user_id, ts AS click_ts, event_id::DOUBLE AS click_id FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, p.ts, v.click_ts, v.click_id
FROM (SELECT * FROM events WHERE event_type = 'signup') p
ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.click_ts
""",
)
def _asof_forward(t) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").cast("double").alias("click_id"))
    left = t.events.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return asof_join(left, clicks, "user_id", "ts", "click_ts", ["click_id"], "forward", matched_ts="click_ts")


@query(
    "asof_transactions_age",
    f"""
WITH ship AS (SELECT o_custkey, l_shipdate, sum(l_quantity) AS qty
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o.o_orderkey, o.o_custkey, s.l_shipdate AS last_ship, {r('s.qty', 'last_qty')},
  {r("(epoch_us(o.o_orderdate) - epoch_us(s.l_shipdate)) / 86400e6", 'days_since_ship')}
FROM orders o ASOF LEFT JOIN ship s ON o.o_custkey = s.o_custkey AND o.o_orderdate >= s.l_shipdate
""",
)
def _asof_transactions_age(t) -> DataFrame:
    """Latest shipment of the customer at each order, with its age in days."""
    shipped = (
        t.lineitem.select("l_orderkey", "l_shipdate", "l_quantity")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_shipdate")
        .agg(F.sum("l_quantity").alias("last_qty"))
    )
    left = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = asof_join(left, shipped, "o_custkey", "o_orderdate", "l_shipdate", ["last_qty"], matched_ts="last_ship")
    age = seconds_between(F.col("o_orderdate"), F.col("last_ship")) / 86400
    return rounded(out.withColumn("days_since_ship", age).drop("o_orderdate"))


@query(
    "asof_tolerance_fill",
    """
WITH s AS (SELECT user_id, ts AS sample_ts, value AS sample FROM events WHERE event_type = 'view'),
l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
b AS (SELECT l.*, s.sample_ts, s.sample FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.sample_ts),
f AS (SELECT l.event_id, s.sample_ts, s.sample FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts <= s.sample_ts)
SELECT b.event_id, b.user_id, b.ts,
  CASE WHEN b.ts - b.sample_ts <= INTERVAL 12 HOUR THEN b.sample WHEN f.sample_ts - b.ts <= INTERVAL 12 HOUR THEN f.sample END AS sample,
  CASE WHEN b.ts - b.sample_ts <= INTERVAL 12 HOUR THEN b.sample_ts WHEN f.sample_ts - b.ts <= INTERVAL 12 HOUR THEN f.sample_ts END AS sample_ts
FROM b JOIN f USING (event_id)
""",
)
def _asof_tolerance_fill(t) -> DataFrame:
    """Backward match within 12 h, the rest filled from the forward match."""
    samples = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("sample_ts"), F.col("value").alias("sample"))
    left = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return asof_nearest(left, samples, "user_id", "ts", "sample_ts", ["sample"], 12 * 3600, "backward_first", matched_ts="sample_ts")


@query(
    "nearest_within_hours",
    """
WITH s AS (SELECT user_id, ts AS sample_ts, value AS sample FROM events WHERE event_type = 'view'),
l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT l.event_id, l.user_id, l.ts,
  min_by(s.sample, abs(epoch_us(l.ts) - epoch_us(s.sample_ts))) AS sample
FROM l LEFT JOIN s ON l.user_id = s.user_id AND s.sample_ts BETWEEN l.ts - INTERVAL 3 HOUR AND l.ts + INTERVAL 3 HOUR
GROUP BY ALL
""",
)
def _nearest_within_hours(t) -> DataFrame:
    samples = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("sample_ts"), F.col("value").alias("sample"))
    left = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_nearest(left, samples, "user_id", "ts", "sample_ts", ["sample"], 3 * 3600)


@query(
    "next_or_last_assignment",
    """
WITH g AS (SELECT o_custkey AS c, o_orderdate AS d, max(o_orderkey) AS k FROM orders GROUP BY ALL),
lst AS (SELECT c, max_by(k, d) AS k FROM g GROUP BY c),
s AS (SELECT l_orderkey, l_shipdate, o_custkey AS c FROM (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)
SELECT s.l_orderkey, s.l_shipdate, s.c, coalesce(g.k, lst.k) AS assigned
FROM s ASOF LEFT JOIN g ON s.c = g.c AND s.l_shipdate <= g.d LEFT JOIN lst ON lst.c = s.c
""",
)
def _next_or_last_assignment(t) -> DataFrame:
    """First order on or after each shipment date, else the customer's last order."""
    orders = t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"))
    left = (
        t.lineitem.select("l_orderkey", "l_shipdate").distinct()
        .join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c")), F.col("l_orderkey") == F.col("o_orderkey"))
        .drop("o_orderkey")
    )
    from ..operators.asof import assign_next_or_last

    return assign_next_or_last(left, orders, "c", "l_shipdate", "d", "k", "assigned")


@query(
    "latest_snapshot_known",
    f"""
WITH c AS (SELECT user_id, max(ts) - INTERVAL 48 HOUR AS cutoff FROM events WHERE event_type = 'purchase' GROUP BY 1),
f AS (SELECT e.user_id, e.ts, e.value FROM events e JOIN c USING (user_id) WHERE event_type = 'view' AND e.ts <= c.cutoff)
SELECT user_id, max(ts) AS view_ts, max_by(value, ts) AS value, count(*) AS n_views FROM f GROUP BY 1
""",
)
def _latest_snapshot_known(t) -> DataFrame:
    cutoffs = cutoff.with_cutoff(
        t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last")), "last", 48.0, "cutoff"
    )
    return latest_known(t.events.where("event_type = 'view'"), cutoffs, "user_id", "ts", "cutoff", ["value"], "view_ts", "n_views")


@query(
    "event_rate_history",
    f"""
WITH d AS (SELECT o_custkey % 300 AS c, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season,
                  max((o_orderpriority = '1-URGENT')::INT) AS hit FROM orders GROUP BY ALL)
SELECT c, CAST(day AS VARCHAR) AS day,
  {rs({'hit_rate_1': 'avg(hit) OVER w1', 'hit_rate_2': 'avg(hit) OVER w2', 'hit_rate_season': 'avg(hit) OVER ws', 'hit_rate_lifetime': 'avg(hit) OVER wl'})}
FROM d
WINDOW w1 AS (PARTITION BY c ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING),
  w2 AS (PARTITION BY c ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
  ws AS (PARTITION BY c, season ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  wl AS (PARTITION BY c ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
def _event_rate_history(t) -> DataFrame:
    days = t.orders.groupBy(
        (F.col("o_custkey") % 300).alias("c"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season")
    ).agg(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("hit"))
    out = event_rate_history(days, "c", "day", "hit", "hit", season="season", plan=None)
    return rounded(out.drop("season", "hit").withColumn("day", F.col("day").cast("string")))


@query(
    "islands_run_length",
    """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
  row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rs FROM orders)
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus,
  CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus, rn - rs ORDER BY rn) AS INT) AS run_length FROM o
""",
)
def _islands_run_length(t) -> DataFrame:
    cols = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return runs(cols, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query(
    "latest_row_per_entity",
    """
SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate,
  max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1
""",
)
def _latest_row_per_entity(t) -> DataFrame:
    return latest_by(t.orders, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate", "o_totalprice"])
