"""Interval and as-of joins, ranks over whole tables, and aggregates that are merged later."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import joins as J
from veil.operators import sketches as K
from veil.operators.ordering import with_ranks
from veil.plans import rounds  # noqa: F401  shared derived tables
from veil.plans.registry import query
from veil.session import cut_lineage


@query("shipments_during_waits", "J14 J15", """
WITH waits AS (SELECT l_orderkey, l_linenumber, l_partkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS since,
  datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS until, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT w.l_orderkey, w.l_linenumber, count(*) AS shipments, round(sum(s.l_quantity), 3) AS quantity
FROM waits w JOIN waits s ON w.l_partkey = s.l_partkey AND s.until BETWEEN w.since AND w.until GROUP BY ALL""")
def _(t):
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    waits = lines.select("l_orderkey", "l_linenumber", "l_partkey", day("o_orderdate").alias("since"), day("l_shipdate").alias("until"))
    shipped = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = shipped.select("l_partkey", day("l_shipdate").alias("on"), day("l_shipdate").alias("to"), "l_quantity")
    pairs = J.interval_join(waits, shipped, ["l_partkey"], ("since", "until"), ("on", "to"))
    return pairs.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("shipments"), F.round(F.sum("l_quantity"), 3).alias("quantity")
    )


@query("last_view_before", "W09", """
SELECT l.event_id, l.user_id, r.view_id, round(r.value, 6) AS value FROM (SELECT * FROM events WHERE event_type <> 'view') l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) r
ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(t):
    views = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), "value")
    others = t.events.filter("event_type <> 'view'").select("event_id", "user_id", "ts")
    found = J.as_of_join(others, views, ["user_id"], "ts", "seen")
    return found.select("event_id", "user_id", F.col("match.view_id").alias("view_id"), F.round("match.value", 6).alias("value"))


@query("view_within_the_hour", "W09", """
SELECT l.event_id, r.view_id FROM (SELECT *, epoch_ms(ts) AS ms FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, epoch_ms(ts) AS ms, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) r
ON l.user_id = r.user_id AND l.ms >= r.ms WHERE r.ms IS NOT NULL AND l.ms - r.ms <= 3600000""")
def _(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    views = t.events.filter("event_type = 'view'").select("user_id", ms.alias("seen"), F.col("event_id").alias("view_id"))
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", ms.alias("ms"))
    found = J.as_of_join(bought, views, ["user_id"], "ms", "seen", within=3_600_000)
    return found.filter("match IS NOT NULL").select("event_id", F.col("match.view_id").alias("view_id"))


@query("round_ranks", "G15 G30", """
SELECT event_id, row_number() OVER (ORDER BY privacy_score, event_id) AS row_number, rank() OVER p AS rank, dense_rank() OVER p AS dense_rank,
  round(percent_rank() OVER p, 9) AS percent_rank, round(cume_dist() OVER p, 9) AS cume_dist, ntile(10) OVER (ORDER BY privacy_score, event_id) AS ntile
FROM rounds WINDOW p AS (ORDER BY privacy_score)""")
def _(t):
    ranked = with_ranks(t.rounds.select("event_id", "privacy_score"), ["privacy_score"], ["event_id"], 10)
    return ranked.select(
        "event_id", "row_number", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), "ntile"
    )


def _day(t):
    return F.to_date("ts")


@query("merged_distinct_counts", "G20 G23", """
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, true AS close FROM events GROUP BY event_type""")
def _(t):
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))
    found = exact
    close = F.lit(True)
    for value, name in (("user_id", "users"), ("event_id", "events")):
        daily = cut_lineage(K.daily_distinct(t.events, _day(t), ["event_type"], value), "daily")
        found = found.join(K.merged_distinct(daily, ["event_type"]).withColumnRenamed("distinct", f"_{name}"), "event_type")
        close = close & (F.abs(F.col(f"_{name}") - F.col(name)) <= F.col(name) * K.distinct_bound())
    return found.select("event_type", "users", "events", close.alias("close"))


@query("merged_quantiles", "G15 G30", """
SELECT event_type, count(value) AS n, round(quantile_disc(value, 0.5), 6) AS median, round(quantile_disc(value, 0.99), 6) AS p99, true AS close FROM events GROUP BY event_type""")
def _(t):
    daily = cut_lineage(K.daily_histogram(t.events, _day(t), ["event_type"], "value"), "daily")
    found = K.merged_quantiles(daily, ["event_type"], [0.5, 0.99])
    # exact ranks beside the estimates: the same rank ceil(q * n) that the histogram answers
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    exact = t.events.groupBy("event_type").agg(F.count("value").alias("n"), disc(0.5).alias("median"), disc(0.99).alias("p99"))
    near = lambda a, b: F.abs(a - b) <= F.abs(b) * (K.ACCURACY + 1e-9) + K.LEAST
    close = near(F.col("quantiles")[0], F.col("median")) & near(F.col("quantiles")[1], F.col("p99")) & (F.col("count") == F.col("n"))
    return exact.join(found, "event_type").select("event_type", "n", F.round("median", 6).alias("median"), F.round("p99", 6).alias("p99"), close.alias("close"))
