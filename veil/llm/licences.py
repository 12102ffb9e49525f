"""Licence scans by canonical digests.

A unit of text is brought to a canonical form: lines that state a copyright are left out (lines end at a line feed), letters A-Z are lowered,
spellings that licences use for the same word are made one, and punctuation and white space become one space. The
digest of the whole form is then joined to the digests of known licences brought to the same form. Units are whole
documents and every single line of them, so a document that is a licence and one that carries a notice are both found.

The known digests are a table; the join is by hash on equality. The table is counted: up to `SENT` rows it is sent to
all tasks, beyond that digests are shuffled. Per document, only the licences found travel.

A null text counts as empty; an empty form matches nothing. Repeated rows are rows of their own. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from importlib.resources import files
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.licence_texts import KNOWN

#: A line that states a copyright: the word before a sign, a year or a place for one, or a sign before a year. Comment leaders
#: may come first. Other lines that begin with the word, or with the third item "(c)" of a list, are text, as is a blank to fill in.
_YEAR = r"(?:[12][0-9]{3}|[<\[{(]\s?(?:year|years|yyyy|date|dates)\b)"
COPYRIGHT = rf"(?i)(^|\n)[ \t#*/;%!>|-]*(?:copyright[ \t:]*(?:(?:\(c\)|©|&copy;)[ \t]*[^_ \t\n]|{_YEAR})|(?:\(c\)|©)[ \t]*{_YEAR})[^\n]*"
#: ASCII punctuation, control characters and white space, and typographic quotes and dashes.
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F‐-―‘-‟• ]+"
#: Spellings of one word; applied to whole words of the form, in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("non commercial", "noncommercial"), ("https", "http"),
    ("copyright owner", "copyright holder"), ("whilst", "while"), ("fulfil", "fulfill"), ("per cent", "percent"), ("version", "v"),
)


def canonical(text: Column) -> Column:
    bare = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, "$1"), ascii_uppercase, ascii_lowercase)
    form = F.concat(F.lit(" "), F.regexp_replace(bare, PUNCTUATION, " "), F.lit(" "))
    for other, one in SPELLINGS:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(form, " +", " "))


#: Known digests that are sent to all tasks at most; a larger table is joined by a shuffle.
SENT = 100_000


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; the form stands in the expression once, so it is made once per unit."""
    return F.sha2(canonical(text).cast("binary"), 256)


#: Digest of an empty form, which matches nothing.
EMPTY = hashlib.sha256(b"").hexdigest()


#: (licence, text): full texts of the usual licences, a table of this package; small, so the driver reads it.
FULL_TEXTS = "licence_texts.parquet"


def full_texts(spark: SparkSession) -> DataFrame:
    """(licence, text): the package's own table of full licence texts."""
    table = pq.read_table(pa.BufferReader((files("veil.llm") / FULL_TEXTS).read_bytes()))
    return spark.createDataFrame([(r["licence"], r["text"]) for r in table.to_pylist()], "licence string, text string")


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]] = KNOWN, texts: DataFrame | None = None) -> DataFrame:
    """(licence, digest): one row for every known text of each licence.

    These are the texts and notices in `known` and the table `texts` (licence, text), by default that of the package.
    """
    rows = [(name, text) for name, own in known.items() for text in own]
    notices = spark.createDataFrame(rows, "licence string, text string")
    more = full_texts(spark) if texts is None else texts
    return notices.unionByName(more.select("licence", "text")).select("licence", digest(F.col("text")).alias("digest")).distinct()


def scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, digest, licence (of the whole text), line_licences, n_licence_lines.

    `docs` is a table that is read alike each time: its rows are numbered. Where several licences have one digest, the
    first by name counts for the whole text; line_licences has all of them, in order.
    """
    known = known.filter(F.col("digest") != EMPTY).select("licence", "digest").distinct()
    side = F.broadcast if known.count() <= SENT else lambda df: df
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    first = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    whole = rows.select("_row", "doc_id", digest(F.col("text")).alias("digest")).join(side(first), "digest", "left")
    lines = rows.select("_row", F.explode(F.transform(F.split("text", "\n"), digest)).alias("digest"))
    found = lines.join(side(known), "digest").groupBy("_row", "licence").agg(F.count("*").alias("n"))
    per = found.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list("licence")), ",").alias("line_licences"), F.sum("n").alias("n_licence_lines"))
    return whole.join(per, "_row", "left").select(
        "doc_id", F.nullif("digest", F.lit(EMPTY)).alias("digest"), "licence", F.coalesce("line_licences", F.lit("")).alias("line_licences"),
        F.coalesce("n_licence_lines", F.lit(0)).cast("long").alias("n_licence_lines"),
    )


def oracle_sql(known: Mapping[str, tuple[str, ...]] = KNOWN) -> str:
    """The same scan for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(n)}, {quote(t)})" for n, ts in known.items() for t in ts)
    form = f"' ' || regexp_replace(translate(regexp_replace(coalesce(text, ''), {quote(COPYRIGHT)}, '\\1', 'g'), {quote(ascii_uppercase)}, {quote(ascii_lowercase)}), {quote(PUNCTUATION)}, ' ', 'g') || ' '"
    for other, one in SPELLINGS:
        form = f"replace({form}, {quote(f' {other} ')}, {quote(f' {one} ')})"
    form = f"trim(regexp_replace({form}, ' +', ' ', 'g'))"
    return f"""
        WITH known_texts(licence, text) AS (VALUES {values} UNION ALL SELECT licence, text FROM read_parquet({quote(str(files("veil.llm") / FULL_TEXTS))})),
        known AS (SELECT DISTINCT licence, sha256({form}) AS digest FROM known_texts WHERE {form} <> ''),
        docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        whole AS (SELECT r, doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM (SELECT r, doc_id, {form} AS form FROM docs)),
        lines AS (SELECT r, sha256({form}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS text FROM docs) WHERE {form} <> ''),
        per AS (
            SELECT r, string_agg(licence, ',' ORDER BY licence) AS line_licences, CAST(sum(n) AS BIGINT) AS n_licence_lines
            FROM (SELECT r, licence, count(*) AS n FROM lines JOIN known USING (digest) GROUP BY r, licence) GROUP BY r
        )
        SELECT doc_id, w.digest, f.licence, coalesce(line_licences, '') AS line_licences, coalesce(n_licence_lines, 0) AS n_licence_lines
        FROM whole w LEFT JOIN (SELECT digest, min(licence) AS licence FROM known GROUP BY digest) f ON w.digest = f.digest LEFT JOIN per p ON w.r = p.r
    """
