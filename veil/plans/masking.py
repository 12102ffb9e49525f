"""Detection and masking queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veil.functions import entities as N
from veil.operators import masking as O
from veil.plans.derived import DERIVED
from veil.plans.registry import query


def span_sql(source: str, key: str) -> str:
    """Spans by splitting, in SQL. Letters outside ASCII become '_' where no pattern class has one."""
    parts = []
    for i, (kind, pattern, conf) in enumerate(N.PATTERNS):
        text = "text" if kind in ("EMAIL", "URL") else "regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g')"
        pat = re.sub(r"^\(\?=\[[^]]*\]\)", "", pattern).replace("'", "''")
        parts.append(f"""SELECT {key} AS key, {i} AS ord, '{kind}' AS kind, CAST({conf} AS DOUBLE) AS confidence, text AS src,
  regexp_extract_all({text}, '{pat}') AS hits, string_split_regex({text}, '{pat}') AS gaps FROM {source}""")
    return f"""
SELECT key, ord, kind, confidence, src, b AS b, CAST(b + n AS INT) AS e, substr(src, b + 1, n) AS txt FROM (
 SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INT) AS b,
   CAST(length(hits[i]) AS INT) AS n
 FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({' UNION ALL '.join(parts)}) a WHERE len(hits) > 0) u) v"""


DERIVED["doc_spans"] = span_sql("documents", "doc_id")


def kept_sql(spans: str) -> str:
    return f"""
SELECT key, kind, confidence, src, b, e, txt, lag(e, 1, 0) OVER (PARTITION BY key ORDER BY b) AS prev FROM (
 WITH RECURSIVE ord AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY b, e DESC, ord) AS i FROM {spans}),
 rec AS (SELECT key, i, e AS last, true AS kept FROM ord WHERE i = 1 UNION ALL
  SELECT o.key, o.i, CASE WHEN o.b >= r.last THEN o.e ELSE r.last END, o.b >= r.last FROM rec r JOIN ord o ON o.key = r.key AND o.i = r.i + 1)
 SELECT ord.* FROM ord JOIN rec USING (key, i) WHERE kept) k"""


DERIVED["doc_kept"] = kept_sql("doc_spans")


def rebuilt_sql(kept: str, label: str, source: str, key: str) -> str:
    return f"""SELECT {key}, md5(coalesce(masked, text)) AS digest, CAST(length(coalesce(masked, text)) AS INT) AS n FROM {source} LEFT JOIN (
 SELECT key, concat(string_agg(concat(substr(src, prev + 1, b - prev), {label}), '' ORDER BY b), substr(any_value(src), max(e) + 1)) AS masked
 FROM {kept} GROUP BY key) m ON m.key = {key}"""


def _label_case(table: dict[str, str], column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


_GENERAL = (
    "CASE WHEN kind IN ('CARDINAL', 'ORDINAL') THEN CASE WHEN regexp_matches(lower(txt), 'years|old|age|y/o') THEN '[AGE]' "
    f"ELSE '[NUMBER]' END ELSE {_label_case(N.GENERAL_LABEL, 'kind', chr(39) + '[' + chr(39) + ' || kind || ' + chr(39) + ']' + chr(39))} END"
)


@query("entity_spans", "M01", """
SELECT key AS doc_id, kind, b AS start, e AS stop, txt AS text, confidence FROM doc_spans""")
def _(t):
    rows = O.span_rows(O.with_spans(t.documents, "text", keep_overlaps=True), ["doc_id"])
    return rows.select("doc_id", "kind", "start", F.col("end").alias("stop"), "text", "confidence")


@query("disjoint_spans", "M02", "SELECT key AS doc_id, kind, b AS start, e AS stop FROM doc_kept")
def _(t):
    rows = O.span_rows(O.with_spans(t.documents, "text"), ["doc_id"])
    return rows.select("doc_id", "kind", "start", F.col("end").alias("stop"))


def _digest(df, key, col):
    return df.select(key, F.md5(F.col(col)).alias("digest"), F.length(col).alias("n"))


@query("masked_asterisks", "M03 M05", rebuilt_sql("doc_kept", "'[' || repeat('*', e - b) || ']'", "documents", "doc_id"))
def _(t):
    return _digest(O.anonymise(t.documents, "text"), "doc_id", "masked")


@query("masked_families", "M03", rebuilt_sql(
    "doc_kept", f"'[' || upper({_label_case(N.KIND_FAMILY, 'kind', chr(39) + 'pii' + chr(39))}) || ']'", "documents", "doc_id"))
def _(t):
    return _digest(O.anonymise(t.documents, "text", "entity"), "doc_id", "masked")


@query("generalised_text", "M04 M05", rebuilt_sql("doc_kept", _GENERAL, "documents", "doc_id"))
def _(t):
    return _digest(O.anonymise(t.documents, "text", "generalize"), "doc_id", "masked")


DERIVED["turn_rows"] = "SELECT conv_id * 1000 + turn AS turn_key, text FROM conversations"
DERIVED["turn_spans"] = span_sql("turn_rows", "turn_key")
DERIVED["turn_kept"] = kept_sql("turn_spans")


@query("masked_version", "M06", f"""
WITH m AS ({rebuilt_sql("turn_kept", "'[' || repeat('*', e - b) || ']'", "turn_rows", "turn_key")})
SELECT concat('u', CAST(conv_id AS VARCHAR)) AS username, turn AS ord, 1 AS version, digest FROM conversations JOIN m ON turn_key = conv_id * 1000 + turn
UNION ALL SELECT concat('u', CAST(conv_id AS VARCHAR)), turn, 0, md5(text) FROM conversations""")
def _(t):
    versions = t.comments.select("username", "ord", F.lit(0).alias("version"), "text")
    return O.as_new_version(versions).select("username", "ord", "version", F.md5("text").alias("digest"))


_CATEGORY = {
    "EMAIL": "Email", "PHONE": "PhoneNumber", "URL": "URL", "IP_ADDRESS": "IP", "DATE": "DateTime", "LOCATION": "Location",
    "CARDINAL": "Quantity",
}


def _entity_table(t):
    rows = O.span_rows(O.with_spans(t.documents, "text"), ["doc_id"])
    name = F.lit("Other")
    for k, v in _CATEGORY.items():
        name = F.when(F.col("kind") == k, v).otherwise(name)
    return rows.withColumn("category", name).withColumn(
        "subcategory", F.when(F.col("kind") == "CARDINAL", "Age").otherwise(F.lit(None))
    )


@query("spliced_entities", "M07 M08", rebuilt_sql(
    "(SELECT *, lag(e, 1, 0) OVER (PARTITION BY key ORDER BY b) AS prev2 FROM doc_kept WHERE confidence >= 0.75)",
    f"'<' || upper({_label_case(_CATEGORY, 'kind', 'kind')}) || '>'", "documents", "doc_id").replace("prev +", "prev2 +").replace("b - prev)", "b - prev2)"))
def _(t):
    chosen = O.removable(_entity_table(t), 0.75).withColumn("replacement", O.entity_replacement(True))
    return _digest(O.splice(t.documents, chosen, "doc_id", "text"), "doc_id", "spliced")


@query("masked_contacts", "M09", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(1[3-9][0-9])[0-9]{4}([0-9]{4})', '\1****\2', 'g'),
  '([A-Za-z0-9_])[A-Za-z0-9_]*@([A-Za-z0-9_]+\.[A-Za-z0-9_]+)', '\1***@\2', 'g')) AS digest,
  CAST(len(regexp_extract_all(text, '1[3-9][0-9]{9}')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+@[A-Za-z0-9_]+\.[A-Za-z0-9_]+')) AS INT) AS found
FROM documents""")
def _(t):
    phones, mails = N.contacts(F.col("text"))
    return t.documents.select(
        "doc_id", F.md5(N.mask_contacts(F.col("text"))).alias("digest"), (F.size(phones) + F.size(mails)).alias("found")
    )


@query("contact_validation", "M10", r"""
WITH c AS (SELECT doc_id, regexp_extract_all(text, '1[3-9][0-9]{9}') AS p, regexp_extract_all(text, '[A-Za-z0-9_]+@[A-Za-z0-9_]+\.[A-Za-z0-9_]+') AS m,
  len(regexp_extract_all(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])')) AS strict FROM documents)
SELECT doc_id, array_to_string(p, ';') AS phones, array_to_string(m, ';') AS mails, CAST(strict AS INT) AS strict_phones,
  CAST(len(list_filter(p, lambda x: NOT regexp_matches(x, '^1[3-9][0-9]{9}$'))) + len(list_filter(m, lambda x: NOT (contains(x, '@') AND contains(x, '.')))) AS INT) AS invalid
FROM c WHERE len(p) + len(m) > 0""")
def _(t):
    phones, mails = N.contacts(F.col("text"))
    strict = F.regexp_count("text", F.lit(f"(?<![0-9]){N.MOBILE}(?![0-9])"))
    bad = F.size(F.filter(phones, lambda p: ~p.rlike(f"^{N.MOBILE}$"))) + F.size(
        F.filter(mails, lambda m: ~(m.contains("@") & m.contains(".")))
    )
    return t.documents.filter(F.size(phones) + F.size(mails) > 0).select(
        "doc_id", F.array_join(phones, ";").alias("phones"), F.array_join(mails, ";").alias("mails"),
        strict.alias("strict_phones"), bad.alias("invalid"),
    )


@query("text_chunks", "M11", """
SELECT doc_id, CAST(i * 5000 AS INT) AS off, md5(substr(text, i * 5000 + 1, 5000)) AS digest FROM
 (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil(length(text) / 5000), 1) AS BIGINT))) AS i FROM documents) c""")
def _(t):
    return t.documents.select("doc_id", F.explode(N.chunks(F.col("text"))).alias("c")).select(
        "doc_id", F.col("c.offset").alias("off"), F.md5("c.text").alias("digest")
    )


@query("numbered_braces", "M12", r"""
WITH s AS (SELECT doc_id, string_split_regex(replace(replace(text, '(', '{'), ')', '}'), '\{.*?\}') AS p FROM documents)
SELECT doc_id, CAST(len(p) - 1 AS INT) AS braces, md5(concat(p[1], array_to_string(list_transform(range(2, len(p) + 1),
  lambda i: concat('<', CAST(i - 1 AS VARCHAR), '>', p[i])), ''))) AS digest FROM s""")
def _(t):
    braced = F.translate("text", "()", "{}")
    return t.documents.select(
        "doc_id", (F.size(F.split(braced, r"\{.*?\}", -1)) - 1).alias("braces"), F.md5(N.number_braces(braced)).alias("digest")
    )


@query("substring_positions", "M13", """
WITH s AS (SELECT doc_id, string_split(text, 'tion') AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * 4), ',') AS positions
FROM s""")
def _(t):
    return t.documents.select(
        "doc_id", F.concat_ws(",", N.positions_of(F.col("text"), "tion").cast("array<string>")).alias("positions")
    )


@query("top_entities_by_source", "G37", """
WITH c AS (SELECT lang, kind, txt, count(*) AS n FROM doc_kept JOIN documents ON doc_id = key GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, kind ORDER BY n DESC, txt) AS rank FROM c)
SELECT lang, kind, string_agg(txt, ';' ORDER BY rank) AS answer FROM r WHERE rank <= 3 GROUP BY ALL""")
def _(t):
    rows = O.span_rows(O.with_spans(t.documents, "text"), ["doc_id", "lang"])
    return O.top_entities(rows, ["lang", "kind"])
