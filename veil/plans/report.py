"""Reports over evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import report as R
from veil.plans.derived import DERIVED
from veil.plans.registry import query


def _names(column: str) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SETTING_NAMES.items()).join(
        [f"CASE {column} ", f" ELSE {column} END"]
    )


_CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ATTRIBUTE_CODES.items())

# SQL side only: the Spark side goes through the operators.
DERIVED["eval_labelled"] = f"""
SELECT e.*, CASE WHEN is_correct LIKE '[1%' THEN 1 ELSE 0 END AS hit,
  CASE WHEN is_correct LIKE '%1%' THEN 1 ELSE 0 END AS any_hit,
  concat({_names("regexp_replace(anon_setting, '_real$', '')")}, CASE WHEN anon_setting LIKE '%real%' THEN '-Real' ELSE '' END,
    ' ', CAST(anon_level AS STRING)) AS label,
  least(utility_bleu, 1.0) AS bleu, least(utility_rouge, 1.0) AS rouge,
  (least(utility_readability, 10.0) / 10 + least(utility_meaning, 10.0) / 10 + least(utility_rouge, 1.0)) / 3 AS comb,
  (least(utility_readability, 10.0) / 10 + least(utility_meaning, 10.0) / 10) / 2 AS model
FROM eval_rows e WHERE gt_certainty >= 3"""
DERIVED["eval_norm"] = f"""
SELECT id, anon_setting, anon_level, res_level, hit, any_hit, bleu, rouge, comb, model, utility_readability, utility_meaning,
  CASE pii_type {_CODES} END AS pii_type, CASE WHEN hit = 1 THEN certainty ELSE 0 END AS certainty,
  CASE WHEN label = b.base THEN 'Base' ELSE label END AS setting,
  CASE WHEN label = b.base THEN 'Base' ELSE split_part(label, ' ', 1) END AS fam
FROM eval_labelled, (SELECT label AS base FROM eval_labelled WHERE anon_level = 0 GROUP BY label
   ORDER BY sum(hit) DESC, label LIMIT 1) b
WHERE anon_level > 0 OR label = b.base"""
DERIVED["num_pred"] = "SELECT count(*) / count(DISTINCT setting) AS n FROM eval_norm"


def trusted(t):
    return t.eval_rows.filter(F.col("gt_certainty") >= 3)


def scored(t):
    return R.mark_first_correct(R.normalise(trusted(t)))


@query("privacy_utility_by_setting", "G01 G02 P11 P14 P15 P16 P18", """
SELECT setting AS full_anon_setting, any_value(fam) AS model_family, exact_mean(comb) AS utility,
  round(sum(hit) / any_value(n), 6) AS correctness, round(avg(certainty), 6) AS certainty, count(*) AS rows
FROM eval_norm, num_pred GROUP BY setting""")
def _(t):
    return R.privacy_utility(scored(t))


@query("privacy_bleu_by_setting", "G01", """
SELECT setting AS full_anon_setting, any_value(fam) AS model_family, exact_mean(bleu) AS utility,
  round(sum(hit) / any_value(n), 6) AS correctness, round(avg(certainty), 6) AS certainty, count(*) AS rows
FROM eval_norm, num_pred GROUP BY setting""")
def _(t):
    return R.privacy_utility(scored(t), "utility_bleu")


@query("base_setting_choice", "G02", """
SELECT label AS full_anon_setting, CAST(sum(hit) AS BIGINT) AS hits FROM eval_labelled WHERE anon_level = 0
GROUP BY label ORDER BY hits DESC, label LIMIT 1""")
def _(t):
    raw = trusted(t).withColumn("correct", R.correctness_vector(F.col("is_correct")))
    return R.base_setting(
        raw.withColumn("full_anon_setting", R.setting_label(F.col("anon_setting"), F.col("anon_level")))
    )


@query("normalised_eval_rows", "P14 P16 P17 P29 G02", """
SELECT anon_setting, id, pii_type, anon_level, setting AS full_anon_setting, round(bleu, 6) AS utility_bleu,
  round(rouge, 6) AS utility_rouge, round(comb, 6) AS utility_comb, round(model, 6) AS utility_model,
  hit = 1 AS first_correct, CAST(certainty AS DOUBLE) AS certainty FROM eval_norm""")
def _(t):
    return scored(t).select(
        "anon_setting", "id", "pii_type", "anon_level", "full_anon_setting",
        *[F.round(c, 6).alias(c) for c in ("utility_bleu", "utility_rouge", "utility_comb", "utility_model")],
        "first_correct", "certainty",
    )


@query("correctness_vectors", "P15", """
SELECT event_id, CASE is_correct WHEN '[1, 0]' THEN '1,0,0' WHEN '[0, 1, 0]' THEN '0,1,0' WHEN '[1]' THEN '1,0,0'
  WHEN '[0]' THEN '0,0,0' WHEN '[]' THEN '0,0,0' ELSE '1,1,0' END AS vector FROM eval_rows""")
def _(t):
    return t.eval_rows.select(
        "event_id", F.concat_ws(",", R.correctness_vector(F.col("is_correct")).cast("array<string>")).alias("vector")
    )


@query("setting_labels", "P29 P17 P18", f"""
SELECT code, concat(name, real, ' ', lvl) AS label, split_part(concat(name, real), ' ', 1) AS model_family, rows
FROM (SELECT concat(anon_setting, '-', CAST(anon_level AS STRING)) AS code, CAST(anon_level AS STRING) AS lvl,
  CASE WHEN anon_setting LIKE '%real%' THEN '-Real' ELSE '' END AS real,
  {_names("regexp_replace(anon_setting, '_real$', '')")} AS name, count(*) AS rows FROM eval_rows GROUP BY ALL) t""")
def _(t):
    codes = t.eval_rows.groupBy(F.concat_ws("-", "anon_setting", F.col("anon_level").cast("string")).alias("code")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    label = R.label_of_code(F.col("code"))
    return codes.select("code", label.alias("label"), R.family(label).alias("model_family"), "rows")


@query("distinct_settings_and_profiles", "U03", """
SELECT count(DISTINCT anon_setting) AS settings, count(DISTINCT id) AS profiles, count(DISTINCT pii_type) AS attributes
FROM eval_rows""")
def _(t):
    return t.eval_rows.agg(
        F.countDistinct("anon_setting").alias("settings"),
        F.countDistinct("id").alias("profiles"),
        F.countDistinct("pii_type").alias("attributes"),
    )


@query("selected_settings", "P12 P13 J09", """
SELECT setting AS full_anon_setting, pii_type, count(*) AS rows FROM eval_norm
WHERE fam NOT IN ('Yi-34B-Base','GPT-4-Base','GPT-3.5-Base','Yi-34B-Base-Real','GPT-4-Base-Real','GPT-3.5-Base-Real')
  AND fam NOT IN ('Dou-SD','GPT-4-Span','Dou-SD-Real','GPT-4-Span-Real')
  AND anon_level <= 2 AND pii_type IN ('LOC','AGE','OCCP','POBP') GROUP BY setting, pii_type""")
def _(t):
    chosen = R.select_settings(scored(t), ["no-base", "base_ablation", "iter=1", "iter=2"])
    return R.select_attributes(chosen, ["fair"]).groupBy("full_anon_setting", "pii_type").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("named_settings", "P12 P13", """
SELECT setting AS full_anon_setting, count(*) AS rows FROM eval_norm WHERE setting IN ('Base', 'Azure 1', 'GPT-4-AA 2')
GROUP BY setting""")
def _(t):
    chosen = R.select_settings(scored(t), ["Base", "Azure 1", "GPT-4-AA 2"])
    return R.select_attributes(chosen, ["all"]).groupBy("full_anon_setting").agg(F.count(F.lit(1)).alias("rows"))


@query("correct_counts_by_axis", "G03", """
SELECT setting AS full_anon_setting, fam AS model_family, pii_type, anon_level, CAST(sum(hit) AS BIGINT) AS correct
FROM eval_norm
GROUP BY GROUPING SETS ((fam, anon_level), (fam, anon_level, pii_type), (pii_type, setting), (pii_type), (setting))
HAVING sum(hit) > 0""")
def _(t):
    return R.correct_counts(scored(t))


@query("location_resolution", "G04 J07", """
WITH loc AS (SELECT setting, fam, hit, CASE WHEN res_level = 1 THEN 2 ELSE res_level END - 1 AS lvl FROM eval_norm
  WHERE pii_type = 'LOC'),
hits AS (SELECT setting, fam, lvl, count(*) AS correct FROM loc WHERE hit = 1 GROUP BY ALL),
base AS (SELECT lvl, count(*) AS total FROM loc WHERE setting = 'Base' GROUP BY lvl HAVING sum(hit) > 0)
SELECT setting AS full_anon_setting, fam AS model_family, CAST(3 - lvl AS INT) AS res_level, correct, total,
  round(correct / total, 6) AS normalised
FROM hits JOIN base USING (lvl) WHERE fam IN ('GPT-4-AA', 'Azure') AND CAST(split_part(setting, ' ', 2) AS INT) <= 3""")
def _(t):
    return R.location_resolution(scored(t))


@query("accuracy_and_certainty", "G05 P19", """
WITH chosen AS (SELECT * FROM eval_norm WHERE fam IN ('GPT-4-AA', 'Azure')),
m AS (SELECT avg(certainty) AS mean FROM chosen WHERE certainty <> 0),
w AS (SELECT setting, round(sum(hit) / any_value(n), 6) AS accuracy,
   round((avg(CASE WHEN certainty = 0 THEN mean ELSE certainty END) - 1) * 0.25, 6) AS certainty
   FROM chosen, m, num_pred GROUP BY setting)
SELECT setting AS full_anon_setting, 'accuracy' AS metric, CAST(accuracy AS DOUBLE) AS value FROM w
UNION ALL SELECT setting, 'certainty', CAST(certainty AS DOUBLE) FROM w""")
def _(t):
    return R.accuracy_and_certainty(scored(t))


_TICKS = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY anon_setting, id, pii_type ORDER BY anon_level) AS pos,
   lag(any_hit) OVER (PARTITION BY anon_setting, id, pii_type ORDER BY anon_level) AS prev_any
   FROM eval_norm WHERE anon_setting NOT LIKE '%real%'),
flagged AS (SELECT *, max(CASE WHEN pos > 1 AND hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY anon_setting, id, pii_type
   ORDER BY anon_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_wrong FROM ordered),
ticks AS (SELECT *, row_number() OVER (PARTITION BY anon_setting, id, pii_type ORDER BY anon_level) AS nth
   FROM flagged WHERE pos > 1 AND hit = 1 AND was_wrong = 1 QUALIFY nth = 1)"""


@query("reidentification_ticks", "W03", f"""
WITH {_TICKS}
SELECT anon_setting, id, pii_type, anon_level, CAST(certainty AS DOUBLE) AS certainty, prev_any = 1 AS prev_any_correct
FROM ticks""")
def _(t):
    return R.reidentified(scored(t))


@query("switch_statistics", "G06 W03", f"""
WITH {_TICKS},
tick_sums AS (SELECT pii_type, anon_level, count(*) AS n, sum(certainty) AS c, sum(prev_any) AS p FROM ticks GROUP BY ALL),
plain AS (SELECT pii_type, anon_level, CAST(sum(hit) AS BIGINT) AS num_correct, round(avg(certainty), 6) AS certainty_avg,
  round(avg(CASE WHEN hit = 1 THEN certainty END), 6) AS certainty_correct FROM ordered GROUP BY ALL)
SELECT plain.*, coalesce(n, 0) AS num_correct_not_prev, CAST(round(coalesce(c / n, 0), 6) AS DOUBLE) AS certainty_correct_not_prev,
  CAST(coalesce(p, 0) AS BIGINT) AS prev_has_any_correct FROM plain LEFT JOIN tick_sums USING (pii_type, anon_level)""")
def _(t):
    return R.switch_statistics(scored(t))


@query("first_wrong_level", "W07", """
WITH lv AS (SELECT anon_setting, id FROM eval_norm GROUP BY ALL HAVING count(DISTINCT anon_level) > 2)
SELECT anon_setting, id, pii_type, CAST(coalesce(min(CASE WHEN hit = 0 THEN anon_level END), 1) AS INT) AS first_wrong
FROM eval_norm JOIN lv USING (anon_setting, id) GROUP BY ALL""")
def _(t):
    return R.first_wrong_level(scored(t))


@query("attribute_counts", "G07", """
SELECT pii_type, round(count(id) / (SELECT count(DISTINCT setting) FROM eval_norm), 6) AS count FROM eval_norm GROUP BY pii_type""")
def _(t):
    return R.attribute_counts(scored(t))


@query("setting_attribute_table", "G08", """
SELECT setting AS full_anon_setting, pii_type, exact_mean(comb) AS utility, round(avg(hit), 6) AS correctness,
  count(*) AS rows FROM eval_norm GROUP BY ALL""")
def _(t):
    return R.setting_attribute_table(scored(t))


@query("base_predictions_per_attribute", "G09", """
SELECT pii_type, count(*) AS predictions FROM eval_norm WHERE setting = 'Base' GROUP BY pii_type""")
def _(t):
    return scored(t).filter(F.col("full_anon_setting") == "Base").groupBy("pii_type").agg(
        F.count("first_correct").alias("predictions")
    )


_GRID = ", ".join(
    f"exact_mean(CASE WHEN pii_type = '{a}' THEN comb END) AS \"{a}\"" for a in R.TABLE_ATTRIBUTES
)


@query("utility_grid", "K06", f"SELECT setting AS full_anon_setting, {_GRID} FROM eval_norm GROUP BY setting")
def _(t):
    return R.utility_grid(scored(t))


@query("correctness_markdown", "K06", """
SELECT concat('| ', setting, ' | ', pii_type, ' | ', CAST(count(*) AS VARCHAR), ' | ', CAST(sum(hit) AS VARCHAR), ' |') AS line
FROM eval_norm GROUP BY setting, pii_type""")
def _(t):
    table = scored(t).groupBy("full_anon_setting", "pii_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("first_correct").cast("long")).alias("hits")
    )
    return R.markdown_table(table)


@query("utility_backfill", "J05", """
WITH donor AS (SELECT id, pii_type, anon_level, count(*) AS n, min(bleu) AS bleu, min(rouge) AS rouge, min(comb) AS comb,
   min(model) AS model, min(utility_readability) AS r, min(utility_meaning) AS m
   FROM eval_norm WHERE anon_setting = 'gpt4_turbo_full' GROUP BY id, pii_type, anon_level)
SELECT anon_setting, e.id, e.pii_type, e.anon_level,
  round(CASE WHEN e.bleu = 0 AND n = 1 THEN d.bleu ELSE e.bleu END, 6) AS utility_bleu,
  round(CASE WHEN e.bleu = 0 AND n = 1 THEN d.comb ELSE e.comb END, 6) AS utility_comb,
  CASE WHEN e.bleu = 0 AND n = 1 THEN d.r ELSE e.utility_readability END AS utility_readability,
  CASE WHEN e.bleu <> 0 THEN 'own' WHEN n = 1 THEN 'filled' ELSE 'unresolved' END AS utility_source
FROM eval_norm e LEFT JOIN donor d ON e.id = d.id AND e.pii_type = d.pii_type AND e.anon_level = d.anon_level""")
def _(t):
    return R.backfill_utility(scored(t)).select(
        "anon_setting", "id", "pii_type", "anon_level",
        F.round("utility_bleu", 6).alias("utility_bleu"), F.round("utility_comb", 6).alias("utility_comb"),
        "utility_readability", "utility_source",
    )


@query("privacy_utility_moves", "W12", """
WITH p AS (SELECT setting, any_value(fam) AS fam, exact_mean(comb) AS u, round(sum(hit) / any_value(n), 6) AS c,
   CAST(split_part(setting, ' ', 2) AS INT) AS step FROM eval_norm, num_pred WHERE setting <> 'Base' GROUP BY setting)
SELECT fam AS model_family, step, round(lead(c) OVER w - c, 6) AS dx, round(lead(u) OVER w - u, 6) AS dy FROM p
WINDOW w AS (PARTITION BY fam ORDER BY step) QUALIFY lead(c) OVER w IS NOT NULL""")
def _(t):
    return R.frontier_steps(R.privacy_utility(scored(t)))


_MEANS = """exact_mean(bleu) AS utility_bleu, exact_mean(rouge) AS utility_rouge, exact_mean(comb) AS utility_comb,
 exact_mean(model) AS utility_model, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS rows, round(avg(hit), 6) AS accuracy"""


@query("level_means", "G11 Y10", f"SELECT anon_level, {_MEANS} FROM eval_norm GROUP BY anon_level")
def _(t):
    return R.level_summary(scored(t), ["anon_level"])


@query("attribute_level_means", "G12", f"SELECT pii_type, anon_level, {_MEANS} FROM eval_norm GROUP BY ALL")
def _(t):
    return R.level_summary(scored(t), ["pii_type", "anon_level"])


_ROUNDS = """
raw AS (SELECT 0 AS round, round(avg(CASE WHEN contains(lower(split_part(guess, ';', 1)), lower(estimate)) THEN 1.0 ELSE 0 END), 6) AS accuracy,
  CAST(1 AS DOUBLE) AS bleu, CAST(1 AS DOUBLE) AS rouge, count(*) AS rows
  FROM predictions JOIN truth USING (username, pii_type) WHERE version = 0),
summary AS (SELECT * FROM raw UNION ALL SELECT anon_level, round(avg(hit), 6), exact_mean(bleu), exact_mean(rouge), count(*)
  FROM eval_norm WHERE anon_level > 0 GROUP BY anon_level)"""


def _summary(t):
    raw = t.predictions.filter("version = 0").join(t.truth, ["username", "pii_type"])
    return R.round_summary(raw, scored(t))


@query("round_summary", "G13", f"WITH {_ROUNDS} SELECT * FROM summary")
def _(t):
    return _summary(t)


@query("best_rounds", "G14", f"""
WITH {_ROUNDS} SELECT arg_min(round, accuracy * 1000 + round * 1e-9) AS least_accuracy,
  arg_max(round, bleu * 1000 - round * 1e-9) AS most_bleu, arg_max(round, bleu * (1 - accuracy) * 1000 - round * 1e-9) AS best_trade
FROM summary""")
def _(t):
    return R.best_rounds(_summary(t))
