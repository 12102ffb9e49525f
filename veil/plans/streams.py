"""Streaming queries, drained with the available-now trigger and compared with batch answers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from veil.functions.numbers import exact_mean
from veil.operators.ordering import latest
from veil.plans import rounds  # noqa: F401  shared derived tables
from veil.plans.derived import DERIVED
from veil.plans.registry import query
from veil.plans.sources import log_lines
from veil.session import scratch_path
from veil.streaming import counters as C
from veil.streaming.run import drain


def derived_stream(t, name: str):
    """The events file as a stream, reshaped like a derived table."""
    # a glob serves a single file and a folder of files alike
    folder = os.path.join(t.sf_dir, "events.parque[t]")
    schema = t.events.schema
    stream = C.parquet_stream(t.spark, folder, schema)
    stream.createOrReplaceTempView("events")
    out = t.spark.sql(DERIVED[name])
    t.events.createOrReplaceTempView("events")
    return out


@query("usage_totals_stream", "T03 G23", """
SELECT model_id, role, count(*) AS calls, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok FROM usage_log GROUP BY ALL""")
def _(t):
    emitted = drain(C.usage_totals(derived_stream(t, "usage_log")), "update", "usage")
    return latest(emitted, ["model_id", "role"], [F.col("batch")]).drop("batch")


@query("rate_windows_stream", "T04 W10", """
WITH e AS (SELECT role, epoch(ts) AS s FROM usage_log),
w AS (SELECT role, CAST(floor(s / 300) AS BIGINT) * 300 - k * 300 AS start FROM e, (VALUES (0), (1)) AS v(k)), m AS (SELECT max(floor(s)) AS m FROM e)
SELECT start, role, count(*) AS calls, count(*) > 2 AS over_limit FROM w GROUP BY start, role""")
def _(t):
    windows = C.rate_windows(derived_stream(t, "usage_log"), "role", "10 minutes", "5 minutes", 2)
    emitted = drain(windows, "update", "rate")
    last = latest(emitted, ["start", "role"], [F.col("batch")])
    return last.select(F.unix_timestamp("start").alias("start"), "role", "calls", "over_limit")


@query("progress_stream", "T01 G39", """
SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS start, config, count(*) AS rounds, exact_mean(privacy_score) AS privacy, exact_mean(utility_score) AS utility FROM rounds GROUP BY ALL""")
def _(t):
    emitted = drain(C.progress_windows(derived_stream(t, "rounds"), "1 day"), "update", "progress")
    last = latest(emitted, ["start", "config"], [F.col("batch")])
    return last.select(
        F.unix_timestamp("start").alias("start"), "config", "rounds", F.round("privacy", 6).alias("privacy"), F.round("utility", 6).alias("utility")
    )


@query("log_monitor_stream", "T01 S10", """
SELECT count(*) AS lines, exact_mean(p / 10) AS privacy, count(*) FILTER (WHERE event_type <> 'error') AS successes FROM log_events WHERE u > 0""")
def _(t):
    path = scratch_path(t.spark, "live-log")
    log_lines(t).select("value").write.text(path)
    emitted = drain(C.log_stream(t.spark, path), "append", "log")
    return emitted.agg(
        F.count(F.lit(1)).alias("lines"), exact_mean("privacy").alias("privacy"), F.count_if("success").alias("successes")
    )


@query("new_versions_stream", "T02", "SELECT DISTINCT profile_id, config FROM rounds")
def _(t):
    fresh = C.new_versions(derived_stream(t, "rounds"), ["profile_id", "config"])
    return drain(fresh.select("profile_id", "config"), "append", "versions")


@query("stop_decisions_stream", "T05 W01", "SELECT profile_id, config, CAST(round AS INT) AS round, stopped FROM kept_early")
def _(t):
    return drain(C.stop_decisions(derived_stream(t, "rounds")), "append", "stops")


# hours that a round may be late, and that a run is waited for
LATE, PATIENCE = 1, 24


@query("round_gaps_stream", "T05 T02", f"""
WITH given AS (SELECT * FROM rounds WHERE NOT (profile_id % 7 = 3 AND round = 2)),
pre AS (SELECT *, row_number() OVER (PARTITION BY profile_id, config ORDER BY round) AS k, count(*) OVER run AS n, max(epoch_ms(ts)) OVER run AS last
  FROM given WINDOW run AS (PARTITION BY profile_id, config)),
dec AS (SELECT *, round >= 2 AND ((privacy_score >= 0.9 AND utility_score >= 0.7) OR utility_score < 0.3
  OR min(privacy_score) OVER (PARTITION BY profile_id, config ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 0.8) AS stopped FROM pre WHERE k = round),
kept AS (SELECT *, coalesce(max(CAST(stopped AS INT)) OVER (PARTITION BY profile_id, config ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dec)
SELECT profile_id, config, CAST(round AS INT) AS round, stopped, false AS missing, CAST(0 AS INT) AS held FROM kept WHERE before = 0
UNION ALL SELECT profile_id, config, CAST(max(round) + 1 AS INT), false, true, CAST(any_value(n) - count(*) AS INT) FROM dec GROUP BY profile_id, config
HAVING NOT bool_or(stopped) AND any_value(n) > count(*)
  AND any_value(last) + {PATIENCE * 3600000} < (SELECT max(epoch_ms(ts)) - {LATE * 3600000} FROM given)""")
def _(t):
    given = derived_stream(t, "rounds").filter("NOT (profile_id % 7 = 3 AND round = 2)")
    return drain(C.timed_stop_decisions(given, f"{LATE} hours", PATIENCE * 3600), "append", "gaps")
