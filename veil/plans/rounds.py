"""Round-loop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.numbers import exact_mean
from veil.operators import rounds as R
from veil.operators.ordering import with_position
from veil.plans.derived import DERIVED
from veil.plans.registry import query

_RUN = "PARTITION BY profile_id, config ORDER BY round"
DERIVED["kept_early"] = f"""
SELECT * FROM (SELECT *, coalesce(max(CAST(stopped AS INT)) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT *, row_number() OVER ({_RUN}) >= 2 AND ((privacy_score >= 0.9 AND utility_score >= 0.7) OR utility_score < 0.3
   OR min(privacy_score) OVER ({_RUN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 0.8) AS stopped FROM rounds) a) b WHERE before = 0"""
DERIVED["kept_target"] = f"""
SELECT * FROM (SELECT *, coalesce(max(CAST(stopped AS INT)) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT *, (privacy_score >= 0.8 AND utility_score >= 0.6) OR utility_score < 0.3 AS stopped FROM rounds) a) b WHERE before = 0"""
DERIVED["finals"] = """
SELECT profile_id, config, arg_max(privacy_score, round) AS final_privacy, arg_max(utility_score, round) AS final_utility,
  count(*) AS total_rounds, sum(elapsed) AS total_time FROM kept_target GROUP BY profile_id, config"""


def finals(t):
    return R.final_rounds(R.stop_at_target(t.rounds))


@query("early_stop_rounds", "W01", "SELECT profile_id, config, round, stopped FROM kept_early")
def _(t):
    return R.stop_early(t.rounds).select("profile_id", "config", "round", "stopped")


@query("target_stop_rounds", "W02", "SELECT profile_id, config, round, stopped FROM kept_target")
def _(t):
    return R.stop_at_target(t.rounds).select("profile_id", "config", "round", "stopped")


@query("final_rounds", "W04", """
SELECT profile_id, config, final_privacy, final_utility, total_rounds, round(total_time, 6) AS total_time FROM finals""")
def _(t):
    return finals(t).withColumn("total_time", F.round("total_time", 6))


@query("metric_trends", "W05", f"""
SELECT profile_id, config, round, round(CASE WHEN lag(privacy_score) OVER w IS NULL THEN 0 ELSE (privacy_score - lag(privacy_score) OVER w)
  / nullif(lag(privacy_score) OVER w, 0) * 100 END, 6) AS privacy_score_trend, round(CASE WHEN lag(utility_score) OVER w IS NULL THEN 0 ELSE
  (utility_score - lag(utility_score) OVER w) / nullif(lag(utility_score) OVER w, 0) * 100 END, 6) AS utility_score_trend
FROM rounds WINDOW w AS ({_RUN})""")
def _(t):
    out = R.trends(t.rounds, ["privacy_score", "utility_score"])
    return out.select(
        "profile_id", "config", "round", *[F.round(c, 6).alias(c) for c in ("privacy_score_trend", "utility_score_trend")]
    )


@query("overall_privacy_change", "W06", """
WITH f AS (SELECT profile_id, config, arg_min(privacy_score, round) AS first, arg_max(privacy_score, round) AS last FROM rounds GROUP BY ALL)
SELECT profile_id, config, first, last, round((last - first) / nullif(first, 0) * 100, 6) AS change FROM f""")
def _(t):
    return R.overall_change(t.rounds, "privacy_score", R.RUN).withColumn("change", F.round("change", 6))


@query("previous_round_text", "J17", f"""
SELECT profile_id, config, round, anonymized_text, lag(anonymized_text) OVER ({_RUN}) AS anonymized_text_prev1 FROM rounds""")
def _(t):
    return R.previous_text(t.rounds)


@query("method_round_means", "G10 K09", """
SELECT config, round, exact_mean(privacy_score) AS privacy, exact_mean(utility_score) AS utility,
  round(avg(CAST(attack_success AS INT)), 6) AS attack_success_rate FROM rounds GROUP BY ALL""")
def _(t):
    return R.method_round_means(t.rounds)


_STATS = """count(*) AS samples, exact_mean(final_privacy) AS privacy_mean, round(stddev_pop(final_privacy), 6) AS privacy_std,
  min(final_privacy) AS privacy_min, max(final_privacy) AS privacy_max, exact_mean(final_utility) AS utility_mean,
  round(stddev_pop(final_utility), 6) AS utility_std, min(final_utility) AS utility_min, max(final_utility) AS utility_max,
  round(avg(CASE WHEN final_privacy >= 0.8 THEN 1 ELSE 0 END), 6) AS pass_rate,
  round(avg(CASE WHEN final_privacy >= 0.8 AND final_utility >= 0.6 THEN 1 ELSE 0 END), 6) AS optimal_share"""


@query("score_statistics", "G15 G20", f"SELECT {_STATS} FROM finals")
def _(t):
    return R.score_statistics(finals(t), [], "final_privacy", "final_utility")


@query("config_comparison", "G21 U01", f"""
SELECT source, config, {_STATS} FROM (SELECT 'log' AS source, config, final_privacy, final_utility FROM finals UNION ALL
  SELECT 'raw', config, privacy_score, utility_score FROM rounds) x GROUP BY source, config""")
def _(t):
    raw = t.rounds.select(
        F.lit("raw").alias("source"), "config", F.col("privacy_score").alias("final_privacy"),
        F.col("utility_score").alias("final_utility"),
    )
    both = finals(t).withColumn("source", F.lit("log")).unionByName(raw, allowMissingColumns=True)
    return R.score_statistics(both, ["source", "config"], "final_privacy", "final_utility")


@query("run_statistics", "G16", """
SELECT count(*) AS processed, exact_mean(privacy_score) AS privacy, exact_mean(utility_score) AS utility,
  count(CASE WHEN round % 2 = 1 THEN 1 END) AS judged, exact_mean(CASE WHEN round % 2 = 1 THEN elapsed END) AS quality FROM rounds""")
def _(t):
    judged = F.when(F.col("round") % 2 == 1, F.col("elapsed"))
    return t.rounds.agg(
        F.count(F.lit(1)).alias("processed"), exact_mean("privacy_score").alias("privacy"),
        exact_mean("utility_score").alias("utility"), F.count(judged).alias("judged"),
        exact_mean(judged).alias("quality"),
    )


_SUCCESS = """SELECT config, concat(CAST(count(*) FILTER (WHERE final_privacy >= 0.8) AS VARCHAR), '/', CAST(count(*) AS VARCHAR), ' (',
  CAST(round(count(*) FILTER (WHERE final_privacy >= 0.8) / count(*) * 100, 1) AS VARCHAR), '%)') AS success FROM finals GROUP BY config"""


@query("success_rate_text", "G17", _SUCCESS)
def _(t):
    return R.success_text(finals(t))


@query("success_rate_parsed", "P27", f"""
WITH s AS ({_SUCCESS}) SELECT config, CAST(split_part(success, '/', 1) AS BIGINT) AS successes,
  CAST(split_part(split_part(success, '/', 2), ' ', 1) AS BIGINT) AS total,
  CAST(regexp_extract(success, '\\(([0-9.]+)%', 1) AS DOUBLE) AS percent FROM s""")
def _(t):
    return R.success_text(finals(t)).select("config", *R.parse_success_text(F.col("success")))


@query("rounds_distribution", "G18", """
SELECT config, total_rounds, count(*) AS runs, round(count(*) / sum(count(*)) OVER (PARTITION BY config) * 100, 6) AS percent
FROM finals GROUP BY config, total_rounds""")
def _(t):
    return R.rounds_distribution(finals(t))


@query("score_histogram", "G19", """
WITH s AS (SELECT config, min(total_time) AS lo, max(total_time) AS hi FROM finals GROUP BY config)
SELECT config, CAST(least(floor((total_time - lo) / (hi - lo) * 30), 29) AS INT) AS bin, count(*) AS n FROM finals JOIN s USING (config) GROUP BY ALL""")
def _(t):
    return R.histogram(finals(t), ["config"], "total_time")


@query("run_progress", "G39", """
WITH p AS (SELECT config, count(DISTINCT profile_id) AS done, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS minutes FROM rounds GROUP BY config)
SELECT config, done, round(done / 1000 * 100, 6) AS percent, round(CAST(done / minutes AS DOUBLE), 6) AS rate,
  round(CAST((1000 - done) / (done / minutes) AS DOUBLE), 3) AS minutes_left FROM p""")
def _(t):
    return R.progress(t.rounds, ["config"], 1000).select(
        "config", "done", F.round("percent", 6).alias("percent"), F.round("rate", 6).alias("rate"),
        F.round("minutes_left", 3).alias("minutes_left"),
    )


@query("round_cumulative_versions", "K04", """
WITH m AS (SELECT username, max(version) AS last FROM utility GROUP BY username)
SELECT k.round, username, version, bleu FROM (SELECT u.*, unnest(range(greatest(version, 1), last + 1)) AS round
  FROM utility u JOIN m USING (username) WHERE last >= 1) k""")
def _(t):
    return R.cumulative_versions(t.utility, ["username"]).select(
        F.col("round").cast("bigint").alias("round"), "username", "version", "bleu"
    )


@query("result_rows", "K05", """
SELECT profile_id, config, count(*) AS n, string_agg(concat(CAST(round AS VARCHAR), ':', CAST(CAST(round(privacy_score * 10) AS INT) AS VARCHAR),
  CASE WHEN attack_success THEN '!' ELSE '' END), ' ' ORDER BY round) AS rounds FROM rounds GROUP BY ALL""")
def _(t):
    shown = F.transform(
        "rounds",
        lambda r: F.concat(
            r.round.cast("string"), F.lit(":"), F.round(r.privacy_score * 10).cast("int").cast("string"),
            F.when(r.attack_success, "!").otherwise(""),
        ),
    )
    return R.result_rows(t.rounds).select(
        "profile_id", "config", F.size("rounds").cast("long").alias("n"), F.array_join(shown, " ").alias("rounds")
    )


@query("round_robin_configs", "J16", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, CASE CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 AS INT)
  WHEN 0 THEN 'mixed-a' WHEN 1 THEN 'mixed-b' ELSE 'single' END AS config FROM documents""")
def _(t):
    return R.assign_configs(t.documents.select("doc_id"), "doc_id", ["mixed-a", "mixed-b", "single"])


@query("offset_window", "P10", """
SELECT event_id, position FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events) x
WHERE position BETWEEN 100 AND 349""")
def _(t):
    return with_position(t.events.select("event_id"), "event_id").filter("position BETWEEN 100 AND 349")


@query("sampled_quality_checks", "B13", """
SELECT profile_id, config, round FROM rounds WHERE round = 5 OR (round = 1 AND
  CAST(concat('0x', substr(md5(CAST(profile_id AS VARCHAR)), 1, 4)) AS INT) % 10 < 3)""")
def _(t):
    return R.needs_quality_check(t.rounds, F.col("profile_id").cast("string"), 0.3, 5).select("profile_id", "config", "round")
