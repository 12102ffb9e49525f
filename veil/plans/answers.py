"""Answer-parsing queries. Answers are composed from known values, which the SQL side reads directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import answers as A
from veil.operators import answers as O
from veil.plans import evaluation  # noqa: F401  shared derived tables
from veil.plans.derived import ATTRIBUTES, DERIVED
from veil.plans.registry import query

DERIVED["block_answers"] = """
SELECT event_id, pii_type, inference, guess, concat('Let me think.', chr(10), 'Type: ', pii_type, chr(10), 'Infrence: ', inference, chr(10),
  'and more: of it', chr(10), 'and more of it', chr(10), 'Guess: ', guess, chr(10), chr(10), 'Certainty: ', coalesce(certainty, '0')) AS answer, coalesce(certainty, '0') AS certainty
FROM predictions"""


@query("typed_answer_blocks", "A01", f"""
SELECT b.event_id, a.pii_type, CASE WHEN a.pii_type = b.pii_type THEN concat(inference, chr(10), 'and more of it') ELSE 'MISSING' END AS inference,
  CASE WHEN a.pii_type = b.pii_type THEN array_to_string(list_transform(string_split(guess, ';'), lambda g: trim(g)), '|') ELSE '' END AS guesses,
  CASE WHEN a.pii_type = b.pii_type THEN certainty END AS certainty
FROM block_answers b, (SELECT unnest([{', '.join(f"'{a}'" for a in ATTRIBUTES)}]) AS pii_type) a""")
def _(t):
    return O.parse_blocks(t.block_answers, "event_id", "answer", ATTRIBUTES).withColumn("guesses", F.array_join("guesses", "|"))


DERIVED["judge_answers"] = """
SELECT event_id, CAST(floor(value) AS BIGINT) % 11 AS r, CAST(floor(value * 3) AS BIGINT) % 11 AS m, CAST(floor(value * 7) AS BIGINT) % 2 AS h,
  CAST(event_id % 4 AS INT) AS kind, event_type FROM events"""
DERIVED["judge_texts"] = """
SELECT event_id, r, m, h, kind, CASE kind WHEN 0 THEN concat('Sure. ', body, ' Done {ok}') WHEN 1 THEN body
  WHEN 2 THEN concat('Here:', chr(10), '```json', chr(10), body, chr(10), '```', chr(10), 'bye') ELSE replace(body, '}}', '}') END AS answer
FROM (SELECT *, concat('{"readability": {"explanation": "', event_type, '", "score": ', CAST(r AS STRING), '}, "meaning": {"explanation": "x", "score": "', CAST(m AS STRING),
 ' of 10"}, "hallucinations": {"explanation": "y", "score": ', CAST(h AS STRING), '}}') AS body FROM judge_answers) b"""


@query("judge_scores", "A02", """
SELECT event_id, CASE WHEN kind IN (1, 2) THEN CAST(r AS DOUBLE) ELSE 1 END AS readability, CASE WHEN kind IN (1, 2) THEN CAST(h AS DOUBLE) ELSE 1 END AS hallucinations,
  CASE WHEN kind IN (1, 2) THEN 'x' ELSE 'decoding_error' END AS why FROM judge_answers""")
def _(t):
    rows = t.judge_texts.withColumn("s", A.judge_scores(F.col("answer")))
    return rows.select("event_id", "s.readability", "s.hallucinations", F.col("s.meaning_why").alias("why"))


@query("quality_scores", "A03 A04 A05", """
SELECT event_id, CAST(r AS DOUBLE) AS readability, CASE WHEN kind IN (1, 2) THEN CAST(m AS DOUBLE) ELSE 5 END AS meaning, CAST(h AS DOUBLE) AS hallucination FROM judge_answers""")
def _(t):
    return t.judge_texts.withColumn("s", A.quality_scores(F.col("answer"))).select("event_id", "s.*")


@query("extracted_json", "A03", """
SELECT event_id, CASE kind WHEN 1 THEN answer WHEN 2 THEN trim(substr(answer, 15, length(answer) - 22)) WHEN 0 THEN substr(answer, 7) ELSE answer END AS js FROM judge_texts""")
def _(t):
    return t.judge_texts.select("event_id", A.extract_json(F.col("answer")).alias("js"))


DERIVED["attack_texts"] = """
SELECT event_id, pii_type, trim(split_part(guess, ';', 1)) AS g, CAST(event_id % 5 AS INT) AS c, CAST(floor(event_id / 8) AS BIGINT) % 3 AS kind,
  CASE CAST(floor(event_id / 8) AS BIGINT) % 3 WHEN 0 THEN concat('```json', chr(10), '{"', pii_type, '": {"inference": "i", "guess": ["', trim(split_part(guess, ';', 1)), '", "z"], "certainty": ', CAST(event_id % 5 AS STRING), '}}', chr(10), '```')
  WHEN 1 THEN concat('I think {"', pii_type, '": {"guess": "', trim(split_part(guess, ';', 1)), '"}} fits') ELSE '{"broken' END AS answer FROM predictions"""


@query("attack_answers", "A06", """
SELECT event_id, a.pii_type, CASE WHEN a.pii_type <> x.pii_type OR kind = 2 THEN '' WHEN kind = 0 THEN concat(g, '|z') ELSE g END AS guesses,
  CAST(CASE WHEN a.pii_type <> x.pii_type OR kind = 2 THEN 0 WHEN kind = 0 THEN c ELSE 3 END AS INT) AS certainty
FROM attack_texts x, (SELECT unnest(['age', 'gender', 'location']) AS pii_type) a""")
def _(t):
    truth = F.array(F.lit("age"), F.lit("gender"), F.lit("location"))
    parsed = t.attack_texts.select("event_id", A.attack_map(F.col("answer")).alias("m")).select(
        "event_id", "m", F.explode(truth).alias("pii_type")
    )
    hit = F.try_element_at("m", F.col("pii_type"))
    raw = hit["guess"]
    guesses = F.when(raw.startswith("["), F.from_json(raw, "ARRAY<STRING>")).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return parsed.select(
        "event_id", "pii_type", F.array_join(guesses, "|").alias("guesses"),
        F.when(hit.isNull(), 0).otherwise(F.coalesce(hit["certainty"], F.lit(3))).alias("certainty"),
    )


DERIVED["score_texts"] = """
SELECT event_id, p, u, concat('1. privacy score: ', CAST(p AS STRING), chr(10), 'note', chr(10), '2. Utility = ', CAST(u AS STRING), ' of 1', chr(10), CASE WHEN event_id % 3 = 0 THEN '隐私得分: 7' ELSE '' END) AS answer,
  concat('Score is ', CASE WHEN event_id % 4 = 0 THEN 'high' ELSE CAST(p AS STRING) END) AS short
FROM (SELECT event_id, CAST(CAST(floor(value * 10) AS BIGINT) % 10 AS DOUBLE) / 10 AS p, CAST(CAST(floor(value * 7) AS BIGINT) % 10 AS DOUBLE) / 10 AS u FROM events) e"""


@query("scraped_scores", "A07 A08", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE p END AS privacy, u AS utility, CASE WHEN event_id % 4 = 0 THEN 0.5::DOUBLE ELSE p END AS plain FROM score_texts""")
def _(t):
    return t.score_texts.select(
        "event_id", A.labelled_score(F.col("answer"), A.PRIVACY_LABELS).alias("privacy"),
        A.labelled_score(F.col("answer"), A.UTILITY_LABELS).alias("utility"), A.scraped_score(F.col("short"), 0.5).alias("plain"),
    )


@query("hash_delimited_bodies", "A09", r"""
SELECT username, ord, md5(trim(replace(text, '#', ''))) AS digest FROM comments""")
def _(t):
    plain = F.replace("text", F.lit("#"), F.lit(""))
    text = F.concat(plain, F.lit("# "), plain, F.lit(" # tail"))
    return t.comments.select("username", "ord", F.md5(A.after_hash(text)).alias("digest"))


DERIVED["noted_texts"] = """
SELECT doc_id, concat('  # Title', chr(10), replace(text, '. ', concat('.', chr(10))), chr(10), 'Note: x', chr(10), '  ', chr(10), ' end ') AS text FROM documents"""


@query("content_lines", "A10 A11", r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM noted_texts)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^(说明|注意|Note|Explanation|")')), chr(10))) AS body,
  md5(array_to_string(list_filter(l, lambda x: NOT starts_with(x, '#'))[1:5], chr(10))) AS top FROM l""")
def _(t):
    x = F.col("text")
    return t.noted_texts.select("doc_id", F.md5(A.content_lines(x)).alias("body"), F.md5(A.top_lines(x)).alias("top"))


DERIVED["verdict_texts"] = """
SELECT event_id, CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'yes; no; less precise' WHEN 1 THEN 'no;yes;no' WHEN 2 THEN 'less precise; less precise; yes' ELSE 'yes' END AS answer FROM events"""


@query("verdict_vectors", "A12", """
SELECT event_id, CASE answer WHEN 'yes; no; less precise' THEN '1,0,0' WHEN 'no;yes;no' THEN '0,1,0' WHEN 'yes' THEN NULL ELSE '0,0,1' END AS verdicts,
  CAST(CASE answer WHEN 'yes; no; less precise' THEN 1 WHEN 'no;yes;no' THEN 0 WHEN 'yes' THEN 0 ELSE 2 END AS INT) AS partial FROM verdict_texts""")
def _(t):
    v = A.verdicts(F.col("answer"), F.lit(3))
    return t.verdict_texts.select(
        "event_id", F.when(v.isNotNull(), F.concat_ws(",", v.cast("array<string>"))).alias("verdicts"),
        A.partial_verdicts(F.col("answer")).alias("partial"),
    )


@query("repaired_guesses", "A14", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat(pii_type, '|', array_to_string(list_transform(string_split(trim(split_part(guess, ';', 2)), ','), lambda g: trim(g)), '|')) ELSE guess END AS guesses
FROM predictions""")
def _(t):
    first = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(F.lit("My top 3 guesses: "), F.col("pii_type"), F.lit(", "), F.trim(F.split_part("guess", F.lit(";"), F.lit(2))), F.lit(", and yes")),
    ).otherwise(F.col("guess"))
    return t.predictions.select("event_id", F.array_join(A.repaired_guesses(F.array(first)), "|").alias("guesses"))


@query("loose_maps", "A15", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS u FROM events")
def _(t):
    text = F.concat(F.lit("{kind: '"), F.col("event_type"), F.lit("', user : "), F.col("user_id").cast("string"), F.lit("}"))
    m = A.loose_map(text)
    return t.events.select("event_id", m["kind"].alias("kind"), m["user"].alias("u"))


@query("generated_records", "A16 J18", """
WITH e AS (SELECT p_partkey AS key, concat(upper(p_name), CASE WHEN p_partkey % 2 = 0 THEN ' II' ELSE '' END) AS name, p_type AS d, p_name AS parent FROM part),
n AS (SELECT lower(name) AS lname, min(skill_id) AS id FROM skill_rows GROUP BY ALL)
SELECT key, name, d AS description, CAST(n.id AS VARCHAR) AS parents, 'functional' AS category FROM e JOIN n ON n.lname = lower(e.parent)
WHERE lower(name) NOT IN (SELECT lname FROM n)""")
def _(t):
    one = F.struct(
        F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, " II").otherwise("")).alias("name"),
        F.col("p_type").alias("description"), F.array(F.col("p_name"), F.lit("unknown")).alias("parent_skills"),
    )
    js = F.when(F.col("p_partkey") % 4 == 0, F.to_json(F.array(one))).otherwise(F.to_json(one))
    answers = t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("Result:\n"), js, F.lit("\nok")).alias("answer"))
    return O.generated_records(answers, "key", "answer", t.skill_rows).select(
        "key", "name", "description", F.concat_ws(",", F.col("parents").cast("array<string>")).alias("parents"), "category"
    )


# ---- changes, steps, alignment --------------------------------------------------------------------

DERIVED["reasonings"] = """
SELECT event_id, event_type, user_id, concat('Intro', chr(10), '1. Replace "', event_type, '" with "thing"', chr(10), '  because it is specific', chr(10), 'and a leak risk', chr(10), chr(10),
  'user ', CAST(user_id AS STRING), ' -> someone', chr(10), 'no risk left', chr(10), 'Step 2: check', chr(10), 'fine') AS reasoning FROM events"""


@query("change_lists", "X17", """
SELECT event_id, 1 AS change, event_type AS original, 'thing' AS anonymized, 'because it is specific and a leak risk' AS reason FROM reasonings
UNION ALL SELECT event_id, 2, concat('user ', CAST(user_id AS VARCHAR)), 'someone', 'no risk left Step 2: check fine' FROM reasonings""")
def _(t):
    return O.change_list(t.reasonings, "event_id", "reasoning")


@query("reasoning_steps", "X18", """
SELECT event_id, 1 AS step, concat('  because it is specific', chr(10), 'and a leak risk', chr(10), chr(10), 'user ', CAST(user_id AS VARCHAR), ' -> someone', chr(10), 'no risk left', chr(10)) AS analysis,
  'and a leak risk|no risk left' AS risks, concat('user ', CAST(user_id AS VARCHAR), '=someone') AS proposed FROM reasonings
UNION ALL SELECT event_id, 2, concat('fine', chr(10)), '', '' FROM reasonings""")
def _(t):
    shown = F.transform("proposed", lambda p: F.concat(p["original"], F.lit("="), p["anonymized"]))
    return O.reasoning_steps(t.reasonings, "event_id", "reasoning").select(
        "event_id", "step", "analysis", F.array_join("risks", "|").alias("risks"), F.array_join(shown, "|").alias("proposed")
    )


DERIVED["swiss_pairs"] = """
SELECT doc_id, replace(replace(replace(text, ' the ', ' Swiss '), ' la ', ' 100 CHF '), ' die ', ' high income ') AS original,
  replace(replace(replace(text, ' the ', ' here '), ' la ', ' 100 units '), ' die ', ' ') AS adapted FROM documents"""


@query("pattern_changes", "X16", r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(original, '(?i)\bSwiss\b')) AS s, len(regexp_extract_all(original, '(?i)\b[0-9]+\s*CHF\b')) AS f,
  len(regexp_extract_all(original, '(?i)\bhigh\s+income\b')) AS h, regexp_matches(adapted, '(?i)\bhere\b') AS ok, regexp_matches(adapted, '(?i)\b[0-9]+\s*units\b') AS okf FROM swiss_pairs)
SELECT doc_id, CAST(s + f + 2 * h AS INT) AS changes, CAST(CASE WHEN ok THEN 0 ELSE s END + CASE WHEN okf THEN 0 ELSE f END + 2 * h AS INT) AS removed FROM c""")
def _(t):
    c = A.pattern_changes(F.col("original"), F.col("adapted"))
    return t.swiss_pairs.withColumn("c", c).select(
        "doc_id", F.size("c").alias("changes"), F.size(F.filter("c", lambda x: x["anonymized"] == "[removed]")).alias("removed")
    )


@query("mentioned_attributes", "X19", r"""
SELECT doc_id, concat('place of "birth', CASE WHEN regexp_matches(original, '(?i)\b[0-9]+\s*CHF\b') THEN ',currency' ELSE '' END,
  CASE WHEN regexp_matches(original, '(?i)\bSwiss\b') THEN ',location' ELSE '' END, CASE WHEN regexp_matches(original, '(?i)\bhigh\s+income\b') THEN ',income' ELSE '' END) AS attributes FROM swiss_pairs""")
def _(t):
    c = A.pattern_changes(F.col("original"), F.col("adapted"))
    reasoning = F.concat(F.lit("Some **thoughts**\nType: \"Place  of `\"Birth`\nend of "), F.col("doc_id").cast("string"))
    return t.swiss_pairs.withColumn("c", c).select(
        "doc_id", F.array_join(A.mentioned_attributes(reasoning, F.col("c")), ",").alias("attributes")
    )


DERIVED["numbered_pairs"] = """
SELECT doc_id, replace(text, ' the ', ' thereabouts ') AS original, replace(text, ' the ', ' here ') AS adapted FROM documents"""


@query("line_changes", "X15", """
SELECT doc_id, CAST(len(string_split(text, ' the ')) - 1 AS INT) AS changes FROM documents""")
def _(t):
    c = A.line_changes(F.col("original"), F.col("adapted"))
    return t.numbered_pairs.withColumn("c", c).select("doc_id", F.size("c").alias("changes"))


@query("detected_changes", "X15 X16", r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(original, '(?i)\bSwiss\b')) AS s, len(regexp_extract_all(original, '(?i)\b[0-9]+\s*CHF\b')) AS f,
  len(regexp_extract_all(original, '(?i)\bhigh\s+income\b')) AS h FROM swiss_pairs)
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN s + f + 2 * h ELSE len(string_split(text, ' the ')) - 1 END AS INT) AS changes FROM c JOIN documents USING (doc_id)""")
def _(t):
    odd = t.numbered_pairs.filter("doc_id % 2 = 1")
    pairs = t.swiss_pairs.filter("doc_id % 2 = 0").unionByName(odd)  # every document, in one of two shapes
    return pairs.select("doc_id", F.size(A.detected_changes(F.col("original"), F.col("adapted"))).alias("changes"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_PIECES = """list_concat(list_concat(CASE WHEN regexp_matches({0}, '^\\s') THEN [''] ELSE [] END, regexp_extract_all({0}, '\\s+|\\S+')),
  CASE WHEN regexp_matches({0}, '\\s$') THEN [''] ELSE [] END)"""
_DIFFERS = f"r.so <> '' AND r.sa <> '' AND {_strip('r.so')} <> {_strip('r.sa')}"
_STOP = f"(regexp_matches(p.o, '^[\\s.,!?;:]+$') OR regexp_matches(p.a, '^[\\s.,!?;:]+$')) AND {_strip('r.so || p.o')} <> '' AND {_strip('r.sa || p.a')} <> ''"

# one step of the recursion is one place in all lines
@query("general_line_changes", "X15", f"""
WITH RECURSIVE zipped AS (SELECT doc_id, unnest(list_zip(string_split(original, chr(10)), string_split(adapted, chr(10)), range(1, len(string_split(original, chr(10))) + 1))) AS z FROM text_pairs),
lines AS (SELECT doc_id, z[3] AS n, z[1] AS o, z[2] AS a FROM zipped WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL AND z[2] <> '' AND z[1] <> z[2]),
split AS (SELECT doc_id, n, {_PIECES.format('o')} AS po, {_PIECES.format('a')} AS pa FROM lines),
pieces AS (SELECT doc_id, n, unnest(range(1, least(len(po), len(pa)) + 1)) AS i, unnest(po[:least(len(po), len(pa))]) AS o, unnest(pa[:least(len(po), len(pa))]) AS a,
  least(len(po), len(pa)) AS last FROM split),
r AS (
 SELECT doc_id, n, CAST(0 AS BIGINT) AS i, '' AS so, '' AS sa, CAST(NULL AS VARCHAR) AS io, CAST(NULL AS VARCHAR) AS ia, false AS done FROM split
 UNION ALL
 SELECT r.doc_id, r.n, p.i, CASE WHEN p.o = p.a THEN CASE WHEN {_DIFFERS} THEN '' ELSE r.so END ELSE CASE WHEN {_STOP} THEN '' ELSE r.so || p.o END END,
  CASE WHEN p.o = p.a THEN CASE WHEN {_DIFFERS} THEN '' ELSE r.sa END ELSE CASE WHEN {_STOP} THEN '' ELSE r.sa || p.a END END,
  CASE WHEN p.o = p.a THEN CASE WHEN {_DIFFERS} THEN r.so END ELSE CASE WHEN {_STOP} THEN r.so || p.o END END,
  CASE WHEN p.o = p.a THEN CASE WHEN {_DIFFERS} THEN r.sa END ELSE CASE WHEN {_STOP} THEN r.sa || p.a END END, p.i = p.last
 FROM r JOIN pieces p ON p.doc_id = r.doc_id AND p.n = r.n AND p.i = r.i + 1),
found AS (SELECT doc_id, {_strip('io')} AS original, {_strip('ia')} AS anonymized FROM r WHERE io IS NOT NULL
 UNION ALL SELECT doc_id, {_strip('so')}, {_strip('sa')} FROM r WHERE done AND {_DIFFERS})
SELECT doc_id, original, anonymized FROM found
WHERE length(original) > 3 AND length(anonymized) > 3 AND original <> anonymized AND abs(length(original) - length(anonymized)) > 1""")
def _(t):
    c = A.line_changes(F.col("original"), F.col("adapted"))
    return t.text_pairs.withColumn("c", F.explode_outer(c)).filter("c IS NOT NULL").select("doc_id", "c.original", "c.anonymized")


@query("aligned_comments", "X14 J15", """
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, i - 1 AS ord, md5(regexp_replace(l[i], '^\\s+|\\s+$', '', 'g')) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l) x""")
def _(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    df = t.documents.select(
        "doc_id", lines.alias("own"),
        F.concat(F.lit("thinking\n#"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("2024-01-31:"), x)), "\n")).alias("answer"),
    )
    return O.align_comments(df, "doc_id", "own", "answer").select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


DERIVED["short_answers"] = """
SELECT conv_id, turn, text, replace(text, 'ion', '') AS changed FROM conversations WHERE length(text) > 0"""


@query("aligned_by_similarity", "X14 J15", """
WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, regexp_replace(text, '[^ -~]', '_', 'g') AS own, replace(regexp_replace(text, '[^ -~]', '_', 'g'), 'ion', '') AS line FROM conversations),
s AS (SELECT a.conv_id, a.ord, a.own, b.ord AS idx, b.line, jaro_winkler_similarity(a.own, b.line) AS sim FROM o a JOIN o b ON a.conv_id = b.conv_id AND b.ord > 0),
best AS (SELECT conv_id, ord, any_value(own) AS own, arg_max(idx, sim * 1e9 - idx * 1e-3) AS idx, max(sim) AS sim FROM s GROUP BY conv_id, ord),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, idx ORDER BY ord) AS nth FROM best WHERE sim > 0.5),
e AS (SELECT o.conv_id, o.ord, CASE WHEN r.nth = 1 THEN l.line ELSE o.own END AS text FROM o LEFT JOIN r ON r.conv_id = o.conv_id AND r.ord = o.ord LEFT JOIN o l ON l.conv_id = o.conv_id AND l.ord = r.idx)
SELECT conv_id, ord, md5(text) AS digest FROM e""")
def _(t):
    flat = t.conversations.select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "_").alias("own"))
    groups = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "own"))).alias("xs"))
    own = F.transform("xs", lambda x: x["own"])
    lines = F.transform(F.slice(own, F.lit(2), F.size("xs")), lambda x: F.replace(x, F.lit("ion"), F.lit("")))
    df = groups.select("conv_id", own.alias("own"), F.array_join(lines, "\n").alias("answer"))
    return O.align_comments(df, "conv_id", "own", "answer").select("conv_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))
