"""Text quality and vector similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import quality as Q
from veil.functions import similarity as S
from veil.functions.numbers import exact_mean
from veil.operators import quality as O
from veil.plans.derived import DERIVED
from veil.plans.registry import query

DERIVED["bleu_counts"] = """
WITH toks AS (SELECT doc_id, 0 AS side, string_split(original, ' ') AS w FROM text_pairs
  UNION ALL SELECT doc_id, 1, string_split(adapted, ' ') FROM text_pairs),
pos AS (SELECT doc_id, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM toks, (VALUES (1), (2), (3), (4)) AS o(n)),
grams AS (SELECT doc_id, side, n, array_to_string(w[i:i + n - 1], chr(1)) AS gram, count(*) AS c FROM pos GROUP BY ALL)
SELECT coalesce(h.doc_id, r.doc_id) AS doc_id, coalesce(h.n, r.n) AS n, sum(least(coalesce(h.c, 0), coalesce(r.c, 0))) AS matched,
  sum(coalesce(r.c, 0)) AS ref, sum(coalesce(h.c, 0)) AS hyp
FROM (SELECT * FROM grams WHERE side = 1) h FULL OUTER JOIN (SELECT * FROM grams WHERE side = 0) r
  ON h.doc_id = r.doc_id AND h.n = r.n AND h.gram = r.gram GROUP BY ALL"""

DERIVED["bleu_wide"] = """
SELECT doc_id, CAST(max(CASE WHEN n = 1 THEN ref END) AS BIGINT) AS r, CAST(max(CASE WHEN n = 1 THEN hyp END) AS BIGINT) AS h,
  coalesce(max(CASE WHEN n = 1 THEN matched END), 0) AS m1, coalesce(max(CASE WHEN n = 2 THEN matched END), 0) AS m2,
  coalesce(max(CASE WHEN n = 3 THEN matched END), 0) AS m3, coalesce(max(CASE WHEN n = 4 THEN matched END), 0) AS m4
FROM bleu_counts GROUP BY doc_id"""


def _smoothed(n: int) -> str:
    zeros = " + ".join(f"CASE WHEN m{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1))
    total = f"greatest(h - {n - 1}, 1)"
    return f"CASE WHEN m{n} > 0 THEN m{n} / {total} ELSE ln(h) / (pow(2, {zeros}) * 5) / {total} END"


@query("sentence_bleu", "Y01", f"""
SELECT doc_id, r AS ref_len, h AS hyp_len, CASE WHEN m1 = 0 OR (m4 = 0 AND h <= 1) THEN 0 ELSE
  round(CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END * pow(({_smoothed(1)}) * ({_smoothed(2)}) * ({_smoothed(3)}) * ({_smoothed(4)}), 0.25), 6) END AS bleu
FROM bleu_wide""")
def _(t):
    out = O.sentence_bleu(t.text_pairs, "doc_id", "original", "adapted")
    return out.withColumn("bleu", F.round("bleu", 6))


DERIVED["rouge_tokens"] = """
SELECT doc_id, list_filter(string_split_regex(lower(original), '[^a-z0-9]+'), lambda x: x <> '') AS a,
  list_filter(string_split_regex(lower(adapted), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM text_pairs"""


@query("rouge_1", "Y02", """
WITH c AS (SELECT doc_id, tok, sum(ra) AS r, sum(rb) AS h FROM (
   SELECT doc_id, unnest(a) AS tok, 1 AS ra, 0 AS rb FROM rouge_tokens UNION ALL
   SELECT doc_id, unnest(b), 0, 1 FROM rouge_tokens) u GROUP BY ALL),
s AS (SELECT doc_id, sum(least(r, h)) AS m, sum(r) AS r, sum(h) AS h FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(m / nullif(h, 0), 0), 6) AS rouge1_p, round(coalesce(m / nullif(r, 0), 0), 6) AS rouge1_r,
  round(2 * m / (r + h), 6) AS rouge1_f FROM s""")
def _(t):
    out = O.rouge_1(t.text_pairs, "doc_id", "original", "adapted")
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("rouge1_p", "rouge1_r", "rouge1_f")])


@query("rouge_l", "Y02", rows_only="longest common subsequence; checked against brute force on a small fixture")
def _(t):
    out = O.rouge_l(t.text_pairs, "doc_id", "original", "adapted")
    return out.select("doc_id", "lcs", *[F.round(c, 6).alias(c) for c in ("rougeL_p", "rougeL_r", "rougeL_f")])


@query("rouge_lsum", "Y02", rows_only="union of common subsequences; checked against a table-based union on whole texts of a small fixture")
def _(t):
    out = O.rouge_lsum(t.text_pairs, "doc_id", "original", "adapted")
    return out.select("doc_id", "hits", *[F.round(c, 6).alias(c) for c in ("rougeLsum_p", "rougeLsum_r", "rougeLsum_f")])


DERIVED["set_tokens"] = r"""
SELECT doc_id, list_filter(string_split_regex(lower(original), '\s+'), lambda x: x <> '') AS a,
  list_filter(string_split_regex(lower(adapted), '\s+'), lambda x: x <> '') AS b FROM text_pairs"""


@query("set_bleu_and_rouge", "Y03 Y04", """
WITH d AS (SELECT doc_id, len(a) AS na, len(b) AS nb, len(list_distinct(a)) AS da, len(list_distinct(b)) AS db,
  len(list_intersect(a, b)) AS c FROM set_tokens)
SELECT doc_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE c / db * CASE WHEN nb > na THEN 1 ELSE exp(1 - na / nb) END END, 6) AS bleu,
  round(coalesce(2 * c / nullif(da + db, 0), 0), 6) AS rouge1 FROM d""")
def _(t):
    out = O.set_scores(t.text_pairs, "doc_id", "original", "adapted")
    return out.select("doc_id", F.round("bleu", 6).alias("bleu"), F.round("rouge1", 6).alias("rouge1"))


@query("utility_formulas", "Y05 Y06", """
SELECT username, version, round((readability / 10 * 0.3 + meaning / 10 * 0.4 + hallucination * 0.3 + bleu) / 2, 6) AS quality,
  round(readability / 10 * 0.3 + meaning / 10 * 0.5 + hallucination * 0.2, 6) AS trainer FROM utility""")
def _(t):
    r, m, h, b = (F.col(c) for c in ("readability", "meaning", "hallucination", "bleu"))
    return t.utility.select(
        "username", "version", F.round(Q.quality_utility(r, m, h, b), 6).alias("quality"),
        F.round(Q.trainer_utility(r, m, h), 6).alias("trainer"),
    )


@query("anonymisation_coverage", "Y07", """
WITH b AS (SELECT username, version, meaning, hallucination, bleu, version AS changes, CAST(readability AS INT) % 3 AS detected FROM utility),
c AS (SELECT *, CASE WHEN detected = 0 THEN 0 ELSE ((CASE WHEN changes > 0 THEN least(95, 30 + log2(changes + 1) * 15) ELSE 0 END)
  + (1 - bleu) * 100) / 2 END AS cov FROM b)
SELECT username, version, floor(cov + 0.5) AS coverage, CASE WHEN detected = 0 THEN CASE WHEN hallucination = 1 THEN 10 ELSE 0 END ELSE
  least(10, floor(hallucination * 10 * 0.3 + cov / 10 * 0.4 + meaning * 0.3 + 0.5)) END AS resistance FROM c""")
def _(t):
    d = F.col("readability").cast("int") % 3
    m, h = F.col("meaning"), F.col("hallucination")
    cov = Q.anonymisation_coverage(F.col("version"), F.col("bleu"), d)
    return t.utility.select(
        "username", "version", Q.half_up(cov).alias("coverage"), Q.inference_resistance(cov, m, h, d).alias("resistance")
    )


@query("balance_verdicts", "Y08", """
WITH c AS (SELECT username, version, readability, meaning, hallucination, bleu,
  ((CASE WHEN version > 0 THEN least(95, 30 + log2(version + 1) * 15) ELSE 0 END) + (1 - bleu) * 100) / 2 AS cov FROM utility),
r AS (SELECT *, floor(cov + 0.5) AS ratio, least(10, floor(hallucination * 10 * 0.3 + cov / 10 * 0.4 + meaning * 0.3 + 0.5)) AS res,
   floor((readability + meaning + hallucination * 10) / 3 + 0.5) AS text_total FROM c),
p AS (SELECT *, floor((ratio / 10 + floor(meaning + 0.5) + res) / 3 + 0.5) AS privacy_total,
   floor((ratio + floor(meaning + 0.5) + res) / 3 + 0.5) AS band_total FROM r)
SELECT username, version, text_total, privacy_total, CASE WHEN text_total >= 8 AND band_total >= 8 THEN 'excellent balance'
  WHEN text_total >= 7 AND band_total >= 7 THEN 'good balance' WHEN text_total >= 6 THEN 'leans to utility'
  WHEN band_total >= 6 THEN 'leans to privacy' ELSE 'needs work' END AS verdict FROM p""")
def _(t):
    r, m, h = F.col("readability"), F.col("meaning"), F.col("hallucination")
    one = F.lit(1)
    cov = Q.anonymisation_coverage(F.col("version"), F.col("bleu"), one)
    res = Q.inference_resistance(cov, m, h, one)
    text = Q.text_total(r, m, h)
    return t.utility.select(
        "username", "version", text.alias("text_total"), Q.privacy_total(cov, m, res).alias("privacy_total"),
        Q.advice_band(text, Q.advice_privacy_total(cov, m, res)).alias("verdict"),
    )


@query("text_statistics", "Y09", r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(len(w) AS INT) AS words, CAST(len(string_split(text, chr(10))) AS INT) AS lines,
  round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 6) AS mean_word FROM w""")
def _(t):
    return O.text_statistics(t.documents, "text").select(
        "doc_id", "chars", "words", "lines", F.round("mean_word", 6).alias("mean_word")
    )


@query("quality_by_language", "Y10 Y03", """
WITH d AS (SELECT doc_id, len(a) AS na, len(b) AS nb, len(list_distinct(b)) AS db, len(list_intersect(a, b)) AS c FROM set_tokens)
SELECT lang, count(*) AS docs, exact_mean(b) AS bleu
FROM (SELECT lang, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE c / db * CASE WHEN nb > na THEN 1 ELSE exp(1 - na / nb) END END AS b FROM d JOIN text_pairs USING (doc_id)) GROUP BY lang""")
def _(t):
    scored = O.set_scores(t.text_pairs, "lang", "original", "adapted")
    return scored.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), exact_mean("bleu").alias("bleu"))


@query("vector_similarity", "X20", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q), 6) AS dot, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine,
  round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings, q""")
def _(t):
    target = t.embeddings.filter("vec_id = 0").select("embedding").scalar()
    e = t.embeddings.withColumn("q", target)
    a, b = F.col("embedding"), F.col("q")
    return e.select(
        "vec_id", F.round(S.dot(a, b), 6).alias("dot"), F.round(S.cosine(a, b), 6).alias("cosine"),
        F.round(S.norm(a), 6).alias("norm"),
    )
