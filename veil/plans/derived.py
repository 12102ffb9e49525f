"""Domain-shaped tables derived from the given ones, in SQL that both engines read.

Every row of the base table is used; keys come from integer arithmetic on the row id, so the tables
need no window and no shuffle, and groups per profile are bounded by construction.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def pick(index: str, values: list[str]) -> str:
    """CASE text choosing values[index]; numbers are passed through, None becomes NULL."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE CAST({index} AS INT) {whens} END"


def div(a: str, n: int) -> str:
    return f"CAST(floor({a} / {n}) AS BIGINT)"


def scaled(n: float, m: int) -> str:
    """floor(value * n) % m as BIGINT."""
    return f"(CAST(floor(value * {n}) AS BIGINT) % {m})"


ATTRIBUTES = ["age", "gender", "location", "occupation", "married", "income", "education", "pobp"]

PLACES = ["zurich, switzerland", "paris, france", "berlin, germany", "madrid, spain"]
PLACE_GUESSES = ["zurich", "france", "berlin, germany", "madrit, spain", "zurich, swiss", "paris, france"]
_U = div("event_id", 32)

_TRUTH = {
    "age": pick(f"{_U} % 4", ["25", "30-40", "41", "33"]),
    "gender": pick(f"{_U} % 2", ["male", "female"]),
    "location": pick(f"{_U} % 4", PLACES),
    "occupation": pick(f"{_U} % 4", ["nurse", "software engineer", "teacher", "chef"]),
    "married": pick(f"{_U} % 6", ["no relation", "in a relationship", "married", "divorced", "single", "engaged"]),
    "income": pick(f"{_U} % 6", ["no", "low", "medium", "middle", "high", "very high"]),
    "education": pick(
        f"{_U} % 7",
        ["hs", "college", "phd in physics", "masters in law", "studying bachelors of art", "business degree",
         "trade school"],
    ),
    "pobp": pick(f"{_U} % 4", list(reversed(PLACES))),
}
_GUESS = {
    "age": ["20 - 30 years", "35", "between 25 and 35", "unknown", "250", "38-42"],
    "gender": ["male", "female", "Man", "femal"],
    "location": PLACE_GUESSES,
    "occupation": ["software enginer", "registered nurse", "Teacher", "cook", "nurse"],
    "married": ["single, no relation", "in a relation", "maried", "divorced", "no relation"],
    "income": ["none", "low", "middle", "high", "very high (150k)"],
    "education": ["college degree", "hs diploma", "phd", "in college", "highschool"],
    "pobp": PLACE_GUESSES,
}


def _by_attribute(options: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {options[a]}" for i, a in enumerate(ATTRIBUTES))
    return f"CASE CAST(event_id % 8 AS INT) {whens} END"


def _guess(scale: float) -> str:
    return _by_attribute({a: pick(scaled(scale, len(v)), v) for a, v in _GUESS.items()})


_WORDY = "text"

DERIVED: dict[str, str] = {
    "comments": """
SELECT concat('u', CAST(conv_id AS STRING)) AS username, turn AS ord, role AS subreddit,
  1400000000 + conv_id * 1000 + (7 - turn) * 10 AS epoch, text FROM conversations""",
    "predictions": f"""
SELECT event_id, concat('u', CAST({_U} AS STRING)) AS username,
  CAST({div('event_id', 8)} % 4 AS INT) AS version,
  CASE WHEN user_id % 3 = 0 THEN 'judge-b' ELSE 'judge-a' END AS model,
  {pick('event_id % 8', ATTRIBUTES)} AS pii_type,
  concat('because of ', event_type) AS inference,
  concat({_guess(1)}, '; ', {_guess(3)}, '; ', {_guess(7)}) AS guess,
  {pick(scaled(2, 5), ['4', 'certainty: 3', 'unknown', None, '2 of 5'])} AS certainty
FROM events""",
    "truth": f"""
SELECT username, pii_type, 'human' AS reviewer, min(estimate) AS estimate, min(hardness) AS hardness,
  min(certainty) AS certainty, min(level) AS level
FROM (SELECT concat('u', CAST({_U} AS STRING)) AS username, {pick('event_id % 8', ATTRIBUTES)} AS pii_type,
  {_by_attribute(_TRUTH)} AS estimate, CAST({_U} % 4 AS INT) AS hardness,
  CAST(1 + ({_U} + event_id) % 5 AS INT) AS certainty, CAST(1 + {_U} % 3 AS INT) AS level FROM events) t
GROUP BY username, pii_type""",
    "utility": f"""
SELECT username, version, max(readability) AS readability, max(meaning) AS meaning,
  max(hallucination) AS hallucination, max(bleu) AS bleu, max(rouge1) AS rouge1
FROM (SELECT concat('u', CAST({_U} AS STRING)) AS username, CAST({div('event_id', 8)} % 4 AS INT) AS version,
  CAST({scaled(10, 11)} AS DOUBLE) AS readability, CAST({scaled(7, 11)} AS DOUBLE) AS meaning,
  CAST({scaled(3, 2)} AS DOUBLE) AS hallucination, CAST({scaled(100, 101)} AS DOUBLE) / 100 AS bleu,
  CAST({scaled(9, 101)} AS DOUBLE) / 100 AS rouge1 FROM events) t
GROUP BY username, version""",
    "eval_rows": f"""
SELECT event_id,
  {pick(div('event_id', 32) + ' % 5', ['gpt4_turbo_full', 'azure_full', 'gpt35_full', 'yi_full_base', 'span_yao_full_real'])} AS anon_setting,
  concat('p', CAST({div('event_id', 160)} AS STRING)) AS id,
  {pick(div('event_id', 4) + ' % 8', ATTRIBUTES)} AS pii_type,
  CAST(event_id % 4 AS INT) AS anon_level, CAST(1 + user_id % 3 AS INT) AS res_level,
  CAST(1 + {scaled(3, 5)} AS INT) AS gt_hardness, CAST(1 + {scaled(5, 5)} AS INT) AS gt_certainty,
  CAST(1 + {scaled(1, 5)} AS INT) AS certainty,
  {pick(scaled(2, 6), ['[1, 0]', '[0, 1, 0]', '[1]', '[0]', '[]', '[1, 1, 0]'])} AS is_correct,
  CAST({scaled(10, 12)} AS DOUBLE) AS utility_readability, CAST({scaled(7, 12)} AS DOUBLE) AS utility_meaning,
  CAST({scaled(3, 2)} AS DOUBLE) AS utility_hallucinations,
  CASE WHEN {div('event_id', 32)} % 5 = 2 AND {scaled(1, 3)} = 0 THEN CAST(0 AS DOUBLE)
    ELSE CAST(1 + {scaled(6, 120)} AS DOUBLE) / 100 END AS utility_bleu,
  CAST({scaled(100, 121)} AS DOUBLE) / 100 AS utility_rouge
FROM events""",
    "rounds": f"""
SELECT event_id, {div('event_id', 5)} AS profile_id,
  {pick(div('event_id', 5) + ' % 3', ['mixed-a', 'mixed-b', 'single'])} AS config,
  CAST(1 + event_id % 5 AS INT) AS round,
  CAST({scaled(10, 11)} AS DOUBLE) / 10 AS privacy_score, CAST({scaled(7, 11)} AS DOUBLE) / 10 AS utility_score,
  event_type = 'error' AS attack_success, value / 100 AS elapsed, ts,
  concat('text ', event_type, ' ', CAST({scaled(1, 50)} AS STRING)) AS anonymized_text
FROM events""",
    "usage_log": f"""
SELECT event_id, ts, concat('Brand#', CAST(1 + user_id % 25 AS STRING)) AS model_id,
  {pick(div('user_id', 25) + ' % 3', ['defender', 'attacker', 'evaluator'])} AS role,
  CAST(floor(value * 10) AS BIGINT) AS in_tok, CAST(floor(value * 5) AS BIGINT) AS out_tok FROM events""",
    "model_cards": """
SELECT p_brand AS model_id, CAST(substr(p_brand, 7) AS INT) AS ordinal,
  concat('provider-', CAST(CAST(substr(p_brand, 7) AS INT) % 6 AS STRING)) AS provider,
  CAST(sum(p_size) % 97 AS DOUBLE) / 100 AS cost_in, CAST(sum(p_size) % 89 AS DOUBLE) / 50 AS cost_out,
  CAST(count(*) % 11 AS DOUBLE) / 10 AS defense, CAST(sum(p_size) % 11 AS DOUBLE) / 10 AS attack,
  CAST(max(p_partkey) % 11 AS DOUBLE) / 10 AS evaluation, CAST(min(p_partkey) % 11 AS DOUBLE) / 10 AS reasoning,
  CAST((sum(p_size) + 3) % 11 AS DOUBLE) / 10 AS instruction, CAST((count(*) + 5) % 11 AS DOUBLE) / 10 AS language
FROM part GROUP BY p_brand""",
    "provider_cards": """
SELECT concat('provider-', CAST(k AS STRING)) AS provider, k AS ordinal, k % 2 = 0 AS regional, k % 3 <> 0 AS international,
  k % 4 = 1 AS requires_vpn, k % 5 = 2 AS blocked, k % 3 = 1 AS free_tier, k % 2 = 1 AS credit_card,
  CASE WHEN n % 5 = 0 THEN 'very_easy' WHEN n % 5 = 1 THEN 'easy' WHEN n % 5 = 2 THEN 'medium'
    WHEN n % 5 = 3 THEN 'hard' ELSE 'very_hard' END AS difficulty,
  n % 7 <> 0 AS available
FROM (SELECT CAST(substr(p_brand, 7) AS INT) % 6 AS k, count(*) AS n FROM part
      GROUP BY CAST(substr(p_brand, 7) AS INT) % 6) t""",
    "skill_rows": """
SELECT p_partkey AS skill_id, p_name AS name, p_type AS description,
  CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'atomic' WHEN 1 THEN 'functional' ELSE 'planning' END AS category,
  CASE CAST(p_size % 4 AS INT) WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'deprecated' ELSE 'archived' END AS status,
  CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'manual' WHEN 1 THEN 'ai_generated' ELSE 'evolved' END AS method,
  CAST(p_size AS DOUBLE) / 50 AS quality, CAST(p_partkey % 10 AS DOUBLE) / 10 AS success_rate,
  p_partkey % 13 = 0 AS needs_review
FROM part""",
    "skill_deps": """
SELECT DISTINCT l_partkey AS skill_id, l_suppkey AS dep_id FROM lineitem""",
    "executions": """
SELECT event_id AS record_id, ts, user_id AS skill_id, event_type <> 'error' AS success, value / 100 AS execution_time,
  value > 450 AS timeout_exceeded,
  CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'KeyError: k'
    WHEN 1 THEN 'ValueError: v' WHEN 2 THEN 'TypeError: t' ELSE 'other' END END AS error_message FROM events""",
    "text_pairs": """
SELECT doc_id, lang, text AS original, replace(replace(replace(text, ' the ', ' a '), 'ion', ''), 'eau', 'o') AS adapted
FROM documents""",
    "turn_pairs": """
SELECT concat('u', CAST(conv_id AS STRING)) AS username, turn AS ord, text AS original,
  replace(replace(replace(text, ' the ', ' a '), 'ion', ''), 'eau', 'o') AS adapted FROM conversations""",
}


class Tables:
    """Lazy access to base and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        if name in DERIVED:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run a text over base and derived tables; plans are resolved at once, so views may be replaced later."""
        from veil.plans.registry import with_derived

        full = with_derived(text)
        for name in BASE:
            if name in full:
                self.__getattr__(name).createOrReplaceTempView(name)
        return self.spark.sql(full)
