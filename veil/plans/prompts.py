"""Prompt, model-stage and loop queries; models are replayed from tables or computed from the prompt row."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import evaluation as E
from veil.operators import loop as L
from veil.operators import prompts as P
from veil.operators import privacy as PO
from veil.plans import privacy as PP
from veil.plans import quality  # noqa: F401  shared derived tables
from veil.plans.derived import DERIVED
from veil.plans.registry import query


def lit(s: str) -> str:
    """SQL text literal with line breaks as chr(10)."""
    return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n")) + ")"


def case(table: dict[str, str], column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


# attributes of a conversation's author: two of the eight, so that every profile has some
DERIVED["turn_attributes"] = """
SELECT DISTINCT concat('u', CAST(conv_id AS STRING)) AS username, CASE CAST((conv_id + turn) % 4 AS INT) WHEN 0 THEN 'age' WHEN 1 THEN 'income' WHEN 2 THEN 'location' ELSE 'occupation' END AS pii_type
FROM conversations"""
DERIVED["blocks"] = """
SELECT username, CAST(0 AS BIGINT) AS part, string_agg(concat(strftime(to_timestamp(epoch), '%Y-%m-%d'), ': ', text), chr(10) ORDER BY subreddit, epoch, ord) AS block FROM comments GROUP BY ALL"""


def blocks(t):
    return P.comment_blocks(t.comments)


def digest(df):
    return df.select("username", F.col("part").cast("long").alias("part"), F.md5("prompt").alias("digest"))


_B, _M, _A = P.INFER_BLOCK


@query("inference_prompts", "B01 P02", f"""
WITH a AS (SELECT username, string_agg({case(P.ATTRIBUTE_TITLES, 'pii_type', 'pii_type')}, ', ' ORDER BY pii_type) AS names,
  string_agg(concat({lit(_B)}, pii_type, {lit(_M)}, {case(P.ATTRIBUTE_OPTIONS, 'pii_type', "''")}, {lit(_A)}), '' ORDER BY pii_type) AS form FROM turn_attributes GROUP BY username)
SELECT username, part, md5(concat(replace({lit(P.INFER_HEADER)}, '{{pii}}', names), chr(10), chr(10), block, chr(10), chr(10), {lit(P.INFER_FOOTER)}, form)) AS digest FROM blocks JOIN a USING (username)""")
def _(t):
    return digest(P.inference_prompts(blocks(t), t.turn_attributes))


DERIVED["turn_predictions"] = """
SELECT username, pii_type, concat('because of ', pii_type) AS inference, concat(username, '; other') AS guess FROM turn_attributes"""


def _anon_sql(level: int) -> str:
    return f"""
WITH n AS (SELECT username, string_agg(concat('Type: ', pii_type, chr(10), 'Inference: ', inference, chr(10), 'Guess: ', guess, chr(10)), '' ORDER BY pii_type) AS notes FROM turn_predictions GROUP BY username)
SELECT username, part, md5(concat({lit(P.ANON_HEADERS[level])}, chr(10), chr(10), block, {lit(chr(10) * 2 + 'Inferences:' + chr(10) * 2)}, notes, chr(10), chr(10), {lit(P.ANON_FOOTER)})) AS digest FROM blocks JOIN n USING (username)"""


for _level in (1, 2, 3):

    @query(f"anonymise_prompts_level_{_level}", "B02", _anon_sql(_level))
    def _(t, level=_level):
        return digest(P.anonymise_prompts(blocks(t), P.inference_notes(t.turn_predictions), t.turn_attributes, level))


@query("anonymise_prompts_baseline", "B02", f"""
WITH a AS (SELECT username, string_agg({case(P.ATTRIBUTE_TITLES, 'pii_type', 'pii_type')}, ' ' ORDER BY pii_type) AS names FROM turn_attributes GROUP BY username)
SELECT username, part, md5(concat(replace({lit(P.ANON_HEADERS[0])}, '{{pii}}', names), chr(10), chr(10), block, chr(10), chr(10), {lit(P.ANON_FOOTER)})) AS digest FROM blocks JOIN a USING (username)""")
def _(t):
    return digest(P.anonymise_prompts(blocks(t), None, t.turn_attributes, 0))


@query("judge_prompts", "B03", f"""
SELECT doc_id, md5(concat({lit(P.JUDGE_HEADER)}, {lit(chr(10) * 2 + 'Original text:' + chr(10) * 2)}, original, {lit(chr(10) + 'Adapted text:' + chr(10) * 2)}, adapted)) AS digest FROM text_pairs""")
def _(t):
    return t.text_pairs.select("doc_id", F.md5(P.judge_prompt(F.col("original"), F.col("adapted"))).alias("digest"))


@query("equivalence_prompts", "B04", f"""
SELECT event_id, concat({lit(P.EQUAL_HEADER)}, array_to_string(list_transform(list_filter(list_transform(string_split(guess, ';'), lambda g: trim(g)), lambda g: g <> ''),
  lambda g: concat(chr(10), 'Ground truth: ', estimate, chr(10), 'Prediction: ', g, chr(10))), '')) AS prompt FROM predictions JOIN truth USING (username, pii_type)""")
def _(t):
    rows = t.predictions.join(t.truth, ["username", "pii_type"])
    return rows.select("event_id", P.equivalence_prompt(F.col("estimate"), E.guess_list(F.col("guess"))).alias("prompt"))


@query("rendered_prompts", "B05", """
SELECT doc_id, md5(concat('H ', lang, chr(10), 'one', chr(10), chr(10), 'two', chr(10), text, chr(10), 'F')) AS digest FROM documents""")
def _(t):
    shots = F.array_join(F.array(F.lit("one"), F.lit("two")), "\n\n")
    text = P.render(
        "{header}\n{shots}\n{body}\n{footer}", header=F.concat(F.lit("H "), F.col("lang")), shots=shots, footer=F.lit("F"), body=F.col("text")
    )
    return t.documents.select("doc_id", F.md5(text).alias("digest"))


@query("improvement_feedback", "B06", """
SELECT event_id, CASE WHEN attack_success THEN concat('BREACH: the attacker found ''', anonymized_text, '''. Generalise more. Utility ', printf('%.2f', utility_score))
 WHEN privacy_score < 0.7 THEN concat('WEAK (', printf('%.2f', privacy_score), '): the attacker guessed ''', anonymized_text, '''. Utility ', printf('%.2f', utility_score))
 ELSE concat('GOOD (', printf('%.2f', privacy_score), '): the guess ''', anonymized_text, ''' failed. Utility ', printf('%.2f', utility_score)) END AS feedback FROM rounds""")
def _(t):
    c = F.col
    return t.rounds.select(
        "event_id", P.improvement_feedback(c("anonymized_text"), c("attack_success"), c("privacy_score"), c("utility_score")).alias("feedback")
    )


@query("leak_reports", "B06 G38", """
WITH s AS (SELECT username, version, pii_type, CASE WHEN verbatim = 1 THEN 'leaked' WHEN inside = 1 THEN 'partial' ELSE 'protected' END AS status FROM attack_matches WHERE inside IS NOT NULL),
l AS (SELECT username, version, string_agg(CASE WHEN status = 'leaked' THEN pii_type END, ', ' ORDER BY pii_type) AS a, string_agg(CASE WHEN status = 'partial' THEN pii_type END, ', ' ORDER BY pii_type) AS b,
  string_agg(CASE WHEN status = 'protected' THEN pii_type END, ', ' ORDER BY pii_type) AS c FROM s GROUP BY username, version)
SELECT username, version, concat(CASE WHEN a IS NOT NULL THEN concat('Leaked: ', a, chr(10)) ELSE '' END, CASE WHEN b IS NOT NULL THEN concat('Nearly leaked: ', b, chr(10)) ELSE '' END,
  CASE WHEN c IS NOT NULL THEN concat('Protected: ', c, chr(10)) ELSE '' END, CASE WHEN bleu >= 0.7 THEN 'utility is good' WHEN bleu >= 0.5 THEN 'utility is acceptable' ELSE 'utility is low' END, '; ',
  CASE WHEN privacy_score < 0.5 THEN 'rewrite heavily' WHEN privacy_score < 0.7 THEN 'blur more' ELSE 'keep this level' END) AS report
FROM l JOIN sample_privacy USING (username, version) JOIN utility USING (username, version)""")
def _(t):
    results = PP.results(t)
    parts = PO.leak_partition(results.withColumn("guesses", F.transform("guesses", lambda g: F.lower(g))), PP.KEYS)
    scores = PO.sample_scores(results, PP.KEYS).select(*PP.KEYS, "privacy_score")
    c = F.col
    return parts.join(scores, PP.KEYS).join(t.utility, PP.KEYS).select(
        *PP.KEYS, P.leak_report(c("leaked"), c("partial"), c("protected"), c("privacy_score"), c("bleu")).alias("report")
    )


@query("replayed_answers", "B07", """
SELECT doc_id, length(text) AS chars, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    stored = t.labels.select("doc_id", F.col("quality").cast("string").alias("answer"))
    asked = t.documents.select("doc_id", F.col("text").alias("prompt"))
    return P.replay(stored, "doc_id")(asked).select(
        "doc_id", F.length("prompt").cast("long").alias("chars"), F.col("answer").cast("int").alias("quality")
    )


@query("batched_model_calls", "B07", "SELECT doc_id, md5(reverse(text)) AS answer FROM documents")
def _(t):
    asked = t.documents.select("doc_id", F.col("text").alias("prompt"))
    return P.live(lambda s: s.str[::-1], concurrency=8)(asked).select("doc_id", F.md5("answer").alias("answer"))


@query("inference_stage", "B08 J03", """
SELECT username, a.pii_type, CASE WHEN a.pii_type = 'age' THEN 'seen' ELSE 'MISSING' END AS inference, CASE WHEN a.pii_type = 'age' THEN username ELSE '' END AS guesses
FROM (SELECT DISTINCT username FROM blocks JOIN turn_attributes USING (username)) b, (SELECT unnest(['age', 'gender']) AS pii_type) a
WHERE username NOT IN (SELECT username FROM comments WHERE ord >= 7)""")
def _(t):
    answer = F.concat(F.lit("Type: age\nInference: seen\nGuess: "), F.col("username"), F.lit("\nCertainty: 3"))
    done = t.comments.filter("ord >= 7")
    out = L.infer_stage(blocks(t), t.turn_attributes, done, P.computed(answer), ["age", "gender"])
    return out.select("username", "pii_type", "inference", F.array_join("guesses", "|").alias("guesses"))


@query("anonymise_stage", "B09 X14", """
SELECT username, CAST(row_number() OVER (PARTITION BY username ORDER BY subreddit, epoch, ord) - 1 AS INT) AS ord, md5(replace(text, chr(10), ' ')) AS digest FROM comments""")
def _(t):
    flat = t.comments.withColumn("text", F.translate("text", "\n", " "))
    done = t.comments.filter("false")
    # the stand-in model repeats the dated comment lines of its prompt after the mark
    body = F.split_part(F.split_part("prompt", F.lit("\n\n"), F.lit(2)), F.lit("\n\nInferences"), F.lit(1))
    model = P.computed(F.concat(F.lit("ok\n#"), body))
    out = L.anonymise_stage(flat, P.inference_notes(t.turn_predictions), t.turn_attributes, done, model)
    return out.select("username", "ord", F.md5("text").alias("digest"))


DERIVED["versioned_comments"] = """
SELECT username, ord, subreddit, epoch, version, CASE WHEN version = 0 THEN text ELSE replace(text, 'e', '*') END AS text FROM comments, (VALUES (0), (1)) AS v(version)"""


@query("second_model_stage", "B11 B08", """
SELECT username, version, 'age' AS pii_type, CAST(length(string_agg(text, chr(10))) AS INT) AS inference
FROM versioned_comments WHERE NOT (version = 1 AND username IN (SELECT username FROM comments WHERE ord >= 6)) GROUP BY username, version""")
def _(t):
    done = t.comments.filter("ord >= 6").select("username", F.lit(1).alias("version")).distinct()
    # the stand-in model tells how long the comments of its prompt are, dates left out
    body = F.regexp_replace(F.split_part("prompt", F.lit("\n\n"), F.lit(2)), r"(?m)^[0-9]{4}-[0-9]{2}-[0-9]{2}: ", "")
    model = P.computed(F.concat(F.lit("Type: age\nInference: "), F.length(body).cast("string")))
    flat = t.versioned_comments.withColumn("text", F.translate("text", "\n", " "))
    out = L.infer_versions_stage(flat, t.turn_attributes, done, model, ["age"])
    return out.select("username", "version", "pii_type", F.col("inference").cast("int").alias("inference"))


@query("plain_versions", "B12 B09 B10", """
SELECT username, version, CAST(ord AS INT) AS ord, md5(CASE version WHEN 0 THEN t WHEN 1 THEN replace(t, 'e', '*') ELSE replace(replace(t, 'e', '*'), 'e', '*') END) AS digest
FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM comments) c, (VALUES (0), (1), (2)) AS v(version)""")
def _(t):
    flat = t.comments.withColumn("text", F.translate("text", "\n", " "))
    body = F.split_part(F.split_part("prompt", F.lit("\n\n"), F.lit(2)), F.lit("\n\nInferences"), F.lit(1))
    anonymiser = P.computed(F.concat(F.lit("ok\n#"), F.replace(body, F.lit("e"), F.lit("*"))))
    inferer = P.computed(F.lit("Type: age\nInference: seen\nGuess: 30\nCertainty: 3"))
    judge = P.computed(F.lit('{"readability": {"score": 9}, "meaning": {"score": 9}, "hallucinations": {"score": 1}}'))
    texts, _, _ = L.run_versions(flat, t.turn_attributes, inferer, anonymiser, judge, ["age"], 2)
    return texts.select("username", "version", F.col("ord").cast("int").alias("ord"), F.md5("text").alias("digest"))


# two anonymised versions of every document, keyed like (profile, version)
DERIVED["version_pairs"] = """
SELECT doc_id * 2 AS doc_id, original, adapted FROM text_pairs
UNION ALL SELECT doc_id * 2 + 1, original, replace(replace(adapted, ' of ', ' '), 'e', 'ee') FROM text_pairs"""
DERIVED["version_counts"] = DERIVED["bleu_counts"].replace("text_pairs", "version_pairs")
DERIVED["version_bleu"] = DERIVED["bleu_wide"].replace("bleu_counts", "version_counts")
DERIVED["version_tokens"] = DERIVED["rouge_tokens"].replace("text_pairs", "version_pairs")


@query("utility_stage", "B10 A02 Y01 Y02", f"""
WITH c AS (SELECT doc_id, tok, sum(ra) AS r, sum(rb) AS h FROM (
   SELECT doc_id, unnest(a) AS tok, 1 AS ra, 0 AS rb FROM version_tokens UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM version_tokens) u GROUP BY ALL),
s AS (SELECT doc_id, 2 * sum(least(r, h)) / sum(r + h) AS rouge1 FROM c GROUP BY doc_id)
SELECT doc_id, CAST(8 AS DOUBLE) AS readability, CAST(doc_id % 10 AS DOUBLE) AS meaning, round(coalesce(rouge1, 0), 6) AS rouge1,
  round(coalesce(CASE WHEN m1 = 0 OR (m4 = 0 AND h <= 1) THEN 0 ELSE
   CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END * pow(({quality._smoothed(1)}) * ({quality._smoothed(2)}) * ({quality._smoothed(3)}) * ({quality._smoothed(4)}), 0.25) END, 0), 6) AS bleu
FROM version_pairs LEFT JOIN version_bleu USING (doc_id) LEFT JOIN s USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels)""")
def _(t):
    answer = F.concat(
        F.lit('{"readability": {"score": 8}, "meaning": {"score": '), (F.col("doc_id") % 10).cast("string"), F.lit('}, "hallucinations": {"score": 1}}')
    )
    done = t.labels.select((F.col("doc_id") * 2).alias("doc_id"))
    out = L.utility_stage(t.version_pairs, done, P.computed(answer), "doc_id")
    return out.select("doc_id", "readability", "meaning", F.round("bleu", 6).alias("bleu"), F.round("rouge1", 6).alias("rouge1"))


# ---- the loop -----------------------------------------------------------------------------------

DERIVED["loop_samples"] = """
SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS username, replace(text, chr(10), ' ') AS text, lower(split_part(replace(text, chr(10), ' '), ' ', 1)) AS word FROM conversations WHERE length(text) > 0"""
# a third of the samples have no true attribute; a defender that learns of a breach replaces the guessed word
DERIVED["loop_truth"] = """
SELECT username, 'occupation' AS pii_type, word AS estimate FROM loop_samples WHERE length(word) % 3 <> 0"""
_MASKS = ["e", "i", "a", "o", "n"]
_MASK_AT = "CASE CAST(round AS INT) " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MASKS)) + " END"
_WORDS = " OR ".join(f"(contains(g, '{w}') AND contains(w, '{w}'))" for w in ["low", "medium", "high", "very high", "20s", "30s", "40s", "50s"])


def _rounds_sql(stopped: str) -> str:
    """The loop as a recursive text: one step is one round of all samples that go on."""
    return f"""
WITH RECURSIVE r AS (
 SELECT l.username, t.estimate AS w, 0 AS round, regexp_replace(l.text, '#', '', 'g') AS anonymized, '' AS feedback, '' AS guess,
  CAST(NULL AS DOUBLE) AS privacy, CAST(NULL AS DOUBLE) AS before1, CAST(NULL AS DOUBLE) AS before2, CAST(0 AS DOUBLE) AS utility, false AS stopped, '' AS note
 FROM loop_samples l LEFT JOIN loop_truth t USING (username)
 UNION ALL
 SELECT username, w, round, anonymized, feedback, guess, privacy, before1, before2, utility, {stopped} AS stopped,
  CASE WHEN leak > 0 THEN concat('BREACH: the attacker found ''', guess, '''. Generalise more. Utility ', printf('%.2f', utility))
   WHEN privacy < 0.7 THEN concat('WEAK (', printf('%.2f', privacy), '): the attacker guessed ''', guess, '''. Utility ', printf('%.2f', utility))
   ELSE concat('GOOD (', printf('%.2f', privacy), '): the guess ''', guess, ''' failed. Utility ', printf('%.2f', utility)) END AS note
 FROM (SELECT username, w, round, anonymized, feedback, concat('occupation: ', first) AS guess, CAST(1 - leak AS DOUBLE) AS privacy, leak, before1, before2,
   CAST((10 - round) / 10 * 0.3 + (10 - 2 * round) / 10 * 0.5 + 0.2 AS DOUBLE) AS utility
  FROM (SELECT *, CASE WHEN w IS NULL THEN 0 WHEN g = w OR (length(w) > 2 AND (contains(w, g) OR contains(g, w))) THEN 1.0 WHEN {_WORDS} THEN 0.6 ELSE 0 END * (0.4 + 4 / 5 * 0.6) AS leak
   FROM (SELECT *, split_part(anonymized, ' ', 1) AS first, trim(lower(split_part(anonymized, ' ', 1))) AS g
    FROM (SELECT username, w, round + 1 AS round, note AS feedback, privacy AS before1, before1 AS before2,
      trim(replace(CASE WHEN note LIKE 'BREACH%' AND length(guess) > 12 THEN replace(anonymized, substr(guess, 13), '?') ELSE anonymized END, {_MASK_AT}, '*')) AS anonymized
     FROM r WHERE NOT stopped AND round < 5) x1) x2) x3) x4)
SELECT username, CAST(round AS INT) AS round, md5(anonymized) AS digest, feedback, guess, round(privacy, 6) AS privacy_score, round(utility, 6) AS utility_score, stopped FROM r WHERE round > 0"""


def _rounds(t, stop: str):
    mask = F.element_at(F.array(*[F.lit(m) for m in _MASKS]), F.col("round"))
    guessed = F.regexp_extract("feedback", r"(?s)^BREACH: the attacker found 'occupation: (.*)'\. Generalise more", 1)
    plain = F.regexp_replace("current", "#", "")
    defender = P.computed(F.concat(F.lit("thoughts\n#"), F.replace(F.when(guessed != "", F.replace(plain, guessed, F.lit("?"))).otherwise(plain), mask, F.lit("*"))))
    first = F.split_part("anonymized", F.lit(" "), F.lit(1))
    attacker = P.computed(F.to_json(F.create_map(F.lit("occupation"), F.struct(F.array(first).alias("guess"), F.lit(4).alias("certainty")))))
    score = lambda c: F.struct(c.alias("score"))
    judge = P.computed(
        F.to_json(F.struct(score(10 - F.col("round")).alias("readability"), score(10 - 2 * F.col("round")).alias("meaning"), score(F.lit(1)).alias("hallucinations")))
    )
    out = L.run_rounds(t.loop_samples.select("username", "text"), t.loop_truth, defender, attacker, judge, stop=stop)
    return out.select(
        "username", "round", F.md5("anonymized").alias("digest"), "feedback", "guess", F.round("privacy_score", 6).alias("privacy_score"),
        F.round("utility_score", 6).alias("utility_score"), "stopped",
    )


@query("anonymisation_rounds", "B12 W02 B06", _rounds_sql("(privacy >= 0.8 AND utility >= 0.6) OR utility < 0.3"))
def _(t):
    return _rounds(t, "target")


@query("adversarial_rounds", "B12 W01 B06", _rounds_sql(
    "round >= 2 AND ((privacy >= 0.9 AND utility >= 0.7) OR least(privacy, coalesce(before1, privacy), coalesce(before2, privacy)) >= 0.8 OR utility < 0.3)"))
def _(t):
    return _rounds(t, "early")
