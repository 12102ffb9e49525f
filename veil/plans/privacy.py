"""Privacy scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import matching as M
from veil.functions.numbers import exact_mean
from veil.functions.similarity import word_set
from veil.operators import evaluation as E
from veil.operators import privacy as P
from veil.plans import evaluation  # noqa: F401  shared derived tables
from veil.plans.derived import DERIVED
from veil.plans.registry import query

KEYS = ["username", "version"]

_WORDS = " OR ".join(f"(contains(g, '{w}') AND contains(t, '{w}'))" for w in M.LEVEL_WORDS + M.DECADES)
DERIVED["attack_truth"] = """
SELECT v.username, v.version, t.pii_type, lower(trim(t.estimate)) AS estimate
FROM (SELECT DISTINCT username, version FROM predictions) v JOIN truth t ON t.username = v.username"""
DERIVED["attack_matches"] = rf"""
WITH g AS (SELECT p.username, p.version, p.pii_type, rank, lower(guess) AS g, lower(trim(t.estimate)) AS t
  FROM guess_rows p JOIN truth t ON t.username = p.username AND t.pii_type = p.pii_type WHERE model = 'judge-a'),
w AS (SELECT *, list_distinct(list_filter(string_split_regex(g, '\s+'), lambda x: x <> '')) AS wg,
  list_distinct(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS wt,
  TRY_CAST(nullif(regexp_extract(g, '[0-9]+\.?[0-9]*'), '') AS DOUBLE) AS ng,
  TRY_CAST(nullif(regexp_extract(t, '[0-9]+\.?[0-9]*'), '') AS DOUBLE) AS nt FROM g),
s AS (SELECT *, greatest(len(list_intersect(wg, wt)) / len(list_distinct(list_concat(wg, wt))),
  CASE WHEN ng IS NULL OR nt IS NULL THEN 0 WHEN ng = nt THEN 1 ELSE greatest(0, 1 - abs(ng - nt) / greatest(ng, nt)) END,
  CASE WHEN {_WORDS} THEN 1 ELSE 0 END) AS sim,
  g = t OR (length(t) > 2 AND (contains(t, g) OR contains(g, t))) AS hit FROM w),
m AS (SELECT username, version, pii_type, max(sim) AS best, arg_min(CASE WHEN g = t THEN 1.0 ELSE 0.9 END, rank) FILTER (WHERE hit) AS exact,
  max(CASE WHEN g = t THEN 1 ELSE 0 END) AS verbatim, max(CASE WHEN contains(g, t) THEN 1 ELSE 0 END) AS inside
  FROM s GROUP BY ALL),
c AS (SELECT username, version, pii_type, CAST(coalesce(TRY_CAST(nullif(regexp_extract(certainty, '[0-9]+'), '') AS INT), 3) AS INT) AS certainty
  FROM predictions WHERE model = 'judge-a')
SELECT a.username, a.version, a.pii_type, a.estimate, coalesce(c.certainty, 0) AS certainty, coalesce(verbatim, 0) AS verbatim,
  inside, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN best >= 0.7 THEN 'semantic' WHEN best >= 0.3 THEN 'partial' ELSE 'none' END AS match_type,
  CAST(coalesce(exact, best, 0) AS DOUBLE) AS similarity
FROM attack_truth a LEFT JOIN m USING (username, version, pii_type) LEFT JOIN c USING (username, version, pii_type)"""
DERIVED["attack_leaks"] = """
SELECT *, least(1.0, CASE match_type WHEN 'exact' THEN 1.0 WHEN 'semantic' THEN 0.6 * similarity WHEN 'partial' THEN 0.3 * similarity ELSE 0 END
  * (0.4 + certainty / 5 * 0.6)) AS leak FROM attack_matches"""
DERIVED["sample_privacy"] = """
SELECT username, version, greatest(0.0, 1 - avg(leak)) AS privacy_score,
  avg(CASE WHEN match_type <> 'none' AND leak > 0.3 THEN 1.0 ELSE 0 END) AS attack_success_rate, count(*) AS attributes
FROM attack_leaks GROUP BY username, version"""


def results(t):
    samples = t.predictions.select(*KEYS).distinct()
    truth = samples.join(t.truth, "username").select(*KEYS, "pii_type", "estimate")
    inferred = t.predictions.filter("model = 'judge-a'").select(
        *KEYS, "pii_type", E.guess_list(F.col("guess")).alias("guesses"),
        F.coalesce(F.regexp_extract("certainty", "([0-9]+)", 1).try_cast("int"), F.lit(3)).alias("certainty"),
    )
    return P.attack_results(truth, inferred, KEYS)


@query("attack_match_classes", "X07 X08 X09 U04", """
SELECT username, version, pii_type, certainty, match_type, round(similarity, 6) AS similarity, round(CAST(leak AS DOUBLE), 6) AS leak
FROM attack_leaks""")
def _(t):
    return results(t).select(
        *KEYS, "pii_type", "certainty", "match_type", F.round("similarity", 6).alias("similarity"),
        F.round("leak", 6).alias("leak"),
    )


@query("sample_privacy_scores", "X10", """
SELECT username, version, round(CAST(privacy_score AS DOUBLE), 6) AS privacy_score, round(CAST(attack_success_rate AS DOUBLE), 6) AS attack_success_rate,
  attributes, coalesce(u.meaning / 10, 0.8) AS utility_score, privacy_score >= 0.8 AND coalesce(u.meaning / 10, 0.8) >= 0.6 AS success
FROM sample_privacy LEFT JOIN (SELECT username, version, meaning FROM utility WHERE version > 0) u USING (username, version)""")
def _(t):
    utility = t.utility.filter("version > 0").select(*KEYS, (F.col("meaning") / 10).alias("utility_score"))
    return P.sample_scores(results(t), KEYS, utility).select(
        *KEYS, F.round("privacy_score", 6).alias("privacy_score"),
        F.round("attack_success_rate", 6).alias("attack_success_rate"), "attributes", "utility_score", "success",
    )


@query("samples_without_truth", "X10", """
SELECT DISTINCT username, version, CAST(1 AS DOUBLE) AS privacy_score, CAST(0 AS DOUBLE) AS attack_success_rate FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.username = p.username AND t.hardness > 0)""")
def _(t):
    samples = t.predictions.select(*KEYS).distinct()
    truth = t.truth.filter("hardness > 0").join(samples, "username")
    return P.samples_without_truth(samples, truth, KEYS)


@query("binary_privacy_scores", "X11", """
SELECT username, version, exact_mean(CASE WHEN verbatim = 1 THEN 1 - certainty / 5 ELSE 1 END) AS privacy_score
FROM attack_matches GROUP BY username, version""")
def _(t):
    return P.binary_privacy(results(t), KEYS).withColumn("privacy_score", F.round("privacy_score", 6))


@query("privacy_by_attribute", "G15 X09", """
SELECT pii_type, match_type, count(*) AS attacks, exact_mean(leak) AS mean_leak, round(stddev_pop(leak), 6) AS std_leak
FROM attack_leaks GROUP BY ALL""")
def _(t):
    return results(t).groupBy("pii_type", "match_type").agg(
        F.count(F.lit(1)).alias("attacks"), exact_mean("leak").alias("mean_leak"),
        F.round(F.stddev_pop("leak"), 6).alias("std_leak"),
    )


@query("batch_privacy_statistics", "G15", """
SELECT count(*) AS samples, exact_mean(privacy_score) AS privacy_mean, round(stddev_pop(privacy_score), 6) AS privacy_std,
  round(min(privacy_score), 6) AS privacy_min, round(max(privacy_score), 6) AS privacy_max,
  round(avg(CASE WHEN privacy_score >= 0.8 THEN 1 ELSE 0 END), 6) AS success_rate FROM sample_privacy""")
def _(t):
    return P.sample_scores(results(t), KEYS).agg(
        F.count(F.lit(1)).alias("samples"),
        exact_mean("privacy_score").alias("privacy_mean"),
        F.round(F.stddev_pop("privacy_score"), 6).alias("privacy_std"),
        F.round(F.min("privacy_score"), 6).alias("privacy_min"),
        F.round(F.max("privacy_score"), 6).alias("privacy_max"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
    )


@query("attack_success_heuristic", "X12 U04", r"""
WITH p AS (SELECT username, version, p.pii_type, lower(guess) AS g, lower(estimate) AS t FROM predictions p JOIN truth USING (username, pii_type))
SELECT username, version, pii_type, contains(g, t) OR len(list_intersect(list_distinct(list_filter(string_split_regex(g, '\s+'), lambda x: x <> '')),
  list_distinct(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')))) > 2 AS success FROM p""")
def _(t):
    return t.predictions.join(t.truth, ["username", "pii_type"]).select(
        *KEYS, "pii_type", M.attack_succeeds(F.col("guess"), F.col("estimate")).alias("success")
    )


@query("long_answers", "X13", "SELECT username, ord, length(text) > 50 AS success FROM comments")
def _(t):
    return t.comments.select("username", "ord", (F.length("text") > 50).alias("success"))


@query("leaked_attributes", "G38", """
WITH s AS (SELECT username, version, pii_type, CASE WHEN verbatim = 1 THEN 'leaked' WHEN inside = 1 THEN 'partial' ELSE 'protected' END AS status
  FROM attack_matches WHERE inside IS NOT NULL)
SELECT username, version, coalesce(string_agg(CASE WHEN status = 'leaked' THEN pii_type END, ', ' ORDER BY pii_type), '') AS leaked,
  coalesce(string_agg(CASE WHEN status = 'partial' THEN pii_type END, ', ' ORDER BY pii_type), '') AS partial,
  coalesce(string_agg(CASE WHEN status = 'protected' THEN pii_type END, ', ' ORDER BY pii_type), '') AS protected
FROM s GROUP BY username, version""")
def _(t):
    lowered = results(t).withColumn("guesses", F.transform("guesses", lambda g: F.lower(g)))
    return P.leak_partition(lowered, KEYS)


@query("word_overlap", "U04", r"""
WITH w AS (SELECT username, ord, list_distinct(list_filter(string_split_regex(lower(original), '\s+'), lambda x: x <> '')) AS a,
  list_distinct(list_filter(string_split_regex(lower(adapted), '\s+'), lambda x: x <> '')) AS b FROM turn_pairs)
SELECT username, ord, CAST(len(list_intersect(a, b)) AS INT) AS common, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS together FROM w""")
def _(t):
    a, b = word_set(F.lower("original")), word_set(F.lower("adapted"))
    return t.turn_pairs.select(
        "username", "ord", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("together")
    )
