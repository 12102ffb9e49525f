"""Catalogue, usage and cost queries. Cards come from `part`, usage from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import catalogue as C
from veil.operators import report as R
from veil.operators.ordering import top_k
from veil.plans.derived import DERIVED
from veil.plans.registry import query

DERIVED["cards"] = """
SELECT *, defense * 0.4 + instruction * 0.3 + language * 0.3 AS defender_score, attack * 0.4 + reasoning * 0.3 + language * 0.3 AS attacker_score,
  evaluation * 0.4 + reasoning * 0.4 + instruction * 0.2 AS evaluator_score FROM model_cards"""


def cards(t):
    return C.with_role_scores(t.model_cards)


@query("role_scores", "B16", """
SELECT model_id, round(defender_score, 6) AS defender_score, round(attacker_score, 6) AS attacker_score, round(evaluator_score, 6) AS evaluator_score FROM cards""")
def _(t):
    return cards(t).select("model_id", *[F.round(f"{r}_score", 6).alias(f"{r}_score") for r in C.ROLES])


@query("model_costs", "O01", """
SELECT model_id, round(cost_in, 6) AS input_cost, round(cost_out / 2, 6) AS output_cost, round(cost_in + cost_out / 2, 6) AS total_cost FROM model_cards""")
def _(t):
    return C.compare_costs(t.model_cards, 1000, 500).select(
        "model_id", *[F.round(c, 6).alias(c) for c in ("input_cost", "output_cost", "total_cost")]
    )


@query("recommended_models", "O02", """
SELECT model_id, provider, round((cost_in + cost_out) * 500, 6) AS cost_per_m FROM model_cards WHERE (cost_in + cost_out) * 500 <= 700""")
def _(t):
    return C.recommended(t.model_cards, 700.0).select("model_id", "provider", F.round("cost_per_m", 6).alias("cost_per_m"))


@query("models_for_role", "O03", """
SELECT model_id, round(attacker_score, 6) AS score FROM cards JOIN provider_cards USING (provider) WHERE available AND attacker_score >= 0.5""")
def _(t):
    return C.available_for_role(cards(t), t.provider_cards, "attacker", 0.5).select("model_id", F.round("score", 6).alias("score"))


@query("models_by_mean_score", "O03", """
SELECT model_id, round((defender_score + attacker_score + evaluator_score) / 3, 6) AS score FROM cards JOIN provider_cards USING (provider) WHERE available""")
def _(t):
    return C.available_for_role(cards(t), t.provider_cards, None).select("model_id", F.round("score", 6).alias("score"))


_PICKS = {
    "best_performing": "attacker_score DESC",
    "cost_optimized": "cost_in",
    "balanced": "attacker_score / (cost_in + cost_out + 0.01) DESC",
    "heterogeneous": "attacker_score DESC",
    "round_robin": "coalesce(n, 0)",
}


@query("role_selection", "O04", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{s}' AS strategy, c.model_id FROM cards c LEFT JOIN (SELECT model_id, count(*) AS n FROM usage_log WHERE role = 'attacker' GROUP BY model_id) u
  ON u.model_id = c.model_id {"WHERE provider <> 'provider-1'" if s == 'heterogeneous' else ''} ORDER BY {o}, attacker_score DESC, ordinal LIMIT 1) {s}""" for s, o in _PICKS.items()))
def _(t):
    out = None
    for s in _PICKS:
        used = ["provider-1"] if s == "heterogeneous" else []
        pick = C.select_for_role(cards(t), "attacker", s, t.usage_log, used).select(F.lit(s).alias("strategy"), "model_id")
        out = pick if out is None else out.unionByName(pick)
    return out


_SEEDS = range(6)


@query("random_role_selection", "O04", " UNION ALL ".join(f"""
SELECT * FROM (SELECT CAST({n} AS INT) AS seed, model_id FROM cards ORDER BY md5(concat('{n}:', CAST(model_id AS VARCHAR))), defender_score DESC, ordinal LIMIT 1) s{n}"""
    for n in _SEEDS))
def _(t):
    out = None
    for n in _SEEDS:
        pick = C.select_for_role(cards(t), "defender", "random", seed=n).select(F.lit(n).alias("seed"), "model_id")
        out = pick if out is None else out.unionByName(pick)
    return out


@query("heterogeneous_triple", "O05", """
WITH d AS (SELECT 'defender' AS role, model_id, provider FROM cards ORDER BY defender_score DESC, ordinal LIMIT 1),
a AS (SELECT 'attacker', model_id, provider FROM cards WHERE provider <> (SELECT provider FROM d) ORDER BY attacker_score DESC, ordinal LIMIT 1),
e AS (SELECT 'evaluator', model_id, provider FROM cards WHERE provider NOT IN (SELECT provider FROM d UNION SELECT provider FROM a) ORDER BY evaluator_score DESC, ordinal LIMIT 1)
SELECT * FROM d UNION ALL SELECT * FROM a UNION ALL SELECT * FROM e""")
def _(t):
    return C.heterogeneous_triple(cards(t))


_COST = "sum(in_tok) / 1000 * any_value(cost_in) + sum(out_tok) / 1000 * any_value(cost_out)"
DERIVED["usage_model_role"] = f"""
SELECT u.model_id, provider, role, count(*) AS calls, sum(in_tok + out_tok) AS tokens, {_COST} AS cost
FROM usage_log u JOIN model_cards c ON c.model_id = u.model_id GROUP BY u.model_id, provider, role"""


@query("usage_report", "G22 J08", """
WITH s AS (SELECT *, sum(cost) OVER (PARTITION BY model_id) * calls / sum(calls) OVER (PARTITION BY model_id) AS rc FROM usage_model_role)
SELECT model_id, provider, role, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(CASE WHEN role IS NOT NULL THEN sum(rc) ELSE sum(cost) END, 4) AS cost, CASE WHEN model_id IS NOT NULL THEN round(sum(cost) / sum(calls), 6) END AS cost_per_call
FROM s GROUP BY GROUPING SETS ((), (model_id), (provider), (role))""")
def _(t):
    return C.usage_report(t.usage_log, t.model_cards).withColumns(
        {"cost": F.round("cost", 4), "cost_per_call": F.round("cost_per_call", 6)}
    )


@query("usage_accumulation", "G23", """
SELECT model_id, role, calls, CAST(tokens AS BIGINT) AS tokens, round(cost, 4) AS cost FROM usage_model_role""")
def _(t):
    return C.usage_by_model_role(t.usage_log, t.model_cards).select("model_id", "role", "calls", "tokens", F.round("cost", 4).alias("cost"))


DERIVED["published_usage"] = """
SELECT user_id, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'deepseek-chat' WHEN 2 THEN 'qwen-plus' ELSE 'gpt-4-turbo' END AS model_id,
  CAST(floor(value * 10) AS BIGINT) AS in_tok, CAST(floor(value * 5) AS BIGINT) AS out_tok FROM events"""


@query("published_price_costs", "B17 J08", """
SELECT p.model_id, provider, regional, round(sum(in_tok) / 1000 * any_value(ci) + sum(out_tok) / 1000 * any_value(co), 4) AS cost FROM published_usage p
JOIN (VALUES ('gpt-4o', 'openai', false, 2.5::DOUBLE, 10.0::DOUBLE), ('deepseek-chat', 'deepseek', true, 0.14, 0.28), ('qwen-plus', 'qwen', true, 0.40, 1.0),
  ('gpt-4-turbo', 'openai', false, 10.0, 30.0)) AS v(m, provider, regional, ci, co) ON v.m = p.model_id GROUP BY ALL""")
def _(t):
    prices = C.first_price(C.published_prices(t.spark))
    sums = t.published_usage.groupBy("model_id").agg(F.sum("in_tok").alias("i"), F.sum("out_tok").alias("o"))
    return sums.join(prices, "model_id").select(
        "model_id", "provider", "regional", F.round(C.call_cost(F.col("i"), F.col("o")), 4).alias("cost")
    )


@query("price_markdown", "B17 K06", """
SELECT concat('| ', model_id, ' | ', provider, ' | ', CAST(ordinal AS VARCHAR), ' |') AS line FROM model_cards""")
def _(t):
    return R.markdown_table(t.model_cards.select("model_id", "provider", "ordinal"))


@query("accessibility_lists", "G24", """
SELECT list, provider FROM (
 SELECT 'regional' AS list, provider FROM provider_cards WHERE regional UNION ALL SELECT 'international', provider FROM provider_cards WHERE international
 UNION ALL SELECT 'requires_vpn', provider FROM provider_cards WHERE requires_vpn UNION ALL SELECT 'blocked', provider FROM provider_cards WHERE blocked
 UNION ALL SELECT 'free_tier', provider FROM provider_cards WHERE free_tier UNION ALL SELECT 'credit_card', provider FROM provider_cards WHERE credit_card
 UNION ALL SELECT 'local_payment', provider FROM provider_cards WHERE NOT credit_card UNION ALL SELECT concat('registration_', difficulty), provider FROM provider_cards) x""")
def _(t):
    return C.accessibility_lists(t.provider_cards)


@query("model_comparison", "G25", """
WITH m AS (SELECT *, (defender_score + attacker_score + evaluator_score) / 3 AS mean FROM cards),
r AS (SELECT *, row_number() OVER (ORDER BY cost_in, ordinal) AS cr, row_number() OVER (ORDER BY mean DESC, ordinal) AS sr, row_number() OVER (ORDER BY defender_score DESC, ordinal) AS d,
 row_number() OVER (ORDER BY attacker_score DESC, ordinal) AS a, row_number() OVER (ORDER BY evaluator_score DESC, ordinal) AS e FROM m)
SELECT model_id, provider, round(mean, 6) AS mean_score, CAST(cr AS INT) AS cost_rank, CAST(sr AS INT) AS score_rank,
  concat_ws(',', CASE WHEN d = 1 THEN 'defender' END, CASE WHEN a = 1 THEN 'attacker' END, CASE WHEN e = 1 THEN 'evaluator' END) AS best_for FROM r""")
def _(t):
    return C.model_comparison(cards(t)).withColumn("mean_score", F.round("mean_score", 6))


@query("cost_summary", "G26", """
SELECT provider, CASE WHEN regional THEN 'regional' ELSE 'international only' END AS reach, count(*) AS models, round(avg(cost_in), 6) AS cost_in, round(avg(cost_out), 6) AS cost_out
FROM model_cards JOIN provider_cards USING (provider) WHERE available GROUP BY ALL""")
def _(t):
    return C.cost_summary(t.model_cards, t.provider_cards)


@query("run_cost", "B14", """
WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT role, model_id, c.provider, 5 * n AS calls, round(5 * n * 1000 / 1000 * cost_in + 5 * n * 500 / 1000 * cost_out, 4) AS total_cost,
  round((5 * n * 1000 / 1000 * cost_in + 5 * n * 500 / 1000 * cost_out) / n, 6) AS cost_per_profile, CASE WHEN c.provider IS NULL THEN concat('no price for ', role, ': ', model_id) END AS warning
FROM (VALUES ('defender', 'Brand#3'), ('attacker', 'Brand#7'), ('evaluator', 'Brand#99')) AS v(role, model_id) LEFT JOIN model_cards c USING (model_id), n""")
def _(t):
    profiles = t.events.agg(F.countDistinct("user_id")).scalar()
    chosen = {"defender": "Brand#3", "attacker": "Brand#7", "evaluator": "Brand#99"}
    return C.run_cost(t.model_cards, chosen, profiles, 5, 1000, 500).withColumns(
        {"total_cost": F.round("total_cost", 4), "cost_per_profile": F.round("cost_per_profile", 6)}
    )


@query("call_volume", "B15", """
SELECT o_orderpriority AS config, 2 * 3 * count(*) AS plain, 2 * 3 * count(*) + count(*) AS with_quality, round(count(*) / (6 * count(*)) * 100, 6) AS increase FROM orders GROUP BY o_orderpriority""")
def _(t):
    n = t.orders.groupBy(F.col("o_orderpriority").alias("config")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("config", *C.call_volume(F.col("n"), 2, 1.0))


@query("excess_calls", "W10", """
WITH s AS (SELECT role, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS calls FROM usage_log GROUP BY ALL)
SELECT role, second, calls, CAST(sum(calls) OVER (PARTITION BY role ORDER BY second RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing,
  sum(calls) OVER (PARTITION BY role ORDER BY second RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM s""")
def _(t):
    return C.excess_calls(t.usage_log, "role", "ts", 2, 600)


@query("first_records", "O06", """
SELECT record_id, skill_id FROM (SELECT record_id, skill_id, row_number() OVER (PARTITION BY skill_id ORDER BY ts, record_id) AS rn FROM executions) x WHERE rn <= 10""")
def _(t):
    rows = t.executions.select("record_id", "skill_id", "ts")
    return top_k(rows, ["skill_id"], [F.col("ts"), F.col("record_id")], 10).select("record_id", "skill_id")


@query("first_prompts", "O07", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20")
def _(t):
    return t.documents.select("doc_id").orderBy("doc_id").limit(20)


@query("category_order", "O08", """
SELECT e.pii_type, CAST(o AS INT) AS position, count(*) AS rows FROM eval_rows e JOIN (VALUES ('gender', 0), ('occupation', 1), ('married', 2), ('location', 3), ('age', 4), ('pobp', 5), ('education', 6), ('income', 7)) AS v(p, o)
ON v.p = e.pii_type GROUP BY ALL""")
def _(t):
    shown = F.array(*[F.lit(a) for a in R.TABLE_ATTRIBUTES])
    from veil.operators.ordering import lookup

    counts = t.eval_rows.groupBy("pii_type").agg(F.count(F.lit(1)).alias("rows"))
    place = (F.array_position(shown, lookup(R.ATTRIBUTE_CODES, F.col("pii_type"))) - 1).cast("int")
    return counts.select("pii_type", place.alias("position"), "rows").orderBy("position")
