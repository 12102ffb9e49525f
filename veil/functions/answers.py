"""Reading structured values out of model answers, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORED = "STRUCT<explanation: STRING, score: STRING>"
FENCE = "(?s)```(?:json)?\\s*\\n?(.*?)\\n?```"

# Line openings that mark a remark, not content.
NOTE_PREFIXES = ["说明", "注意", "Note", "Explanation", '"']
# Labels of the two scores in an evaluation answer.
PRIVACY_LABELS = ("隐私得分", "privacy")
UTILITY_LABELS = ("效用得分", "utility")


def is_json(text: Column) -> Column:
    """Exactly one JSON value: inside brackets it must parse as an array of one, so nothing may trail it."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(
        F.try_parse_json(boxed).isNotNull() & (F.size(F.from_json(boxed, "ARRAY<STRING>")) == 1), F.lit(False)
    )


def brace_span(text: Column) -> Column:
    """First '{' to last '}'; empty when there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def extract_json(text: Column) -> Column:
    """Whole text if it is JSON, else the first fenced block that is, else the brace span, else the text."""
    whole = F.trim(text)
    fenced = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(FENCE), 1), lambda m: F.trim(m)), lambda m: is_json(m)
    )
    span = brace_span(text)
    return F.when(is_json(whole), whole).otherwise(
        F.coalesce(F.try_element_at(fenced, F.lit(1)), F.when(span != "", span), text)
    )


def judge_scores(text: Column) -> Column:
    """Struct of the three scores; an answer that cannot be read counts 1 each, marked as such."""
    span = brace_span(text)
    ok = (span != "") & is_json(span)

    def part(name: str) -> list[Column]:
        return [
            F.when(ok, F.get_json_object(span, f"$.{name}.score").try_cast("double")).otherwise(1.0).alias(name),
            F.when(ok, F.get_json_object(span, f"$.{name}.explanation")).otherwise("decoding_error").alias(f"{name}_why"),
        ]

    return F.struct(*part("readability"), *part("meaning"), *part("hallucinations"))


def coerced_score(raw: Column, default: float = 5.0) -> Column:
    """A number, the first number inside a text, or the default."""
    return F.coalesce(
        raw.try_cast("double"), F.regexp_extract(raw, r"([0-9]+\.?[0-9]*)", 1).try_cast("double"), F.lit(default)
    )


def quality_scores(text: Column) -> Column:
    """Readability, meaning, hallucination by JSON where possible, else by pattern with defaults 5, 5, 0."""
    js = extract_json(text)
    ok = is_json(js) & F.trim(js).startswith("{")

    def found(name: str, default: float) -> Column:
        pattern = rf'(?is)"{name}"?\s*:\s*\{{[^}}]*"score"?\s*:\s*([0-9]+\.?[0-9]*)'
        return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(default))

    return F.struct(
        F.when(ok, coerced_score(F.get_json_object(js, "$.readability.score"))).otherwise(found("readability", 5.0)).alias("readability"),
        F.when(ok, coerced_score(F.get_json_object(js, "$.meaning.score"))).otherwise(found("meaning", 5.0)).alias("meaning"),
        F.when(ok, coerced_score(F.get_json_object(js, "$.hallucinations.score"), 0.0)).otherwise(found("hallucinations?", 0.0)).alias("hallucination"),
    )


def attack_map(text: Column) -> Column:
    """Attribute -> struct(inference, guess, certainty) of a fenced or bare JSON answer; null if unreadable."""
    fenced = F.regexp_extract(text, r"(?s)```json(.*?)```", 1)
    js = F.when(text.contains("```json"), F.trim(fenced)).otherwise(brace_span(text))
    return F.when(
        is_json(js), F.from_json(js, "MAP<STRING, STRUCT<inference: STRING, guess: STRING, certainty: INT>>")
    )


def scraped_score(text: Column, default: float) -> Column:
    """First 0.x, 1.0, 0 or 1 in a text."""
    return F.coalesce(F.regexp_extract(text, r"(0\.[0-9]+|1\.0|0|1)", 1).try_cast("double"), F.lit(default))


def labelled_score(text: Column, labels: tuple[str, str], default: float = 0.5) -> Column:
    """First number after the label, clamped to 0..1; the last labelled line wins."""
    native, latin = labels
    number = rf"(?i)(?:{native}|{latin})[^0-9\n]*([0-9]+\.?[0-9]*)"
    hits = F.transform(
        F.regexp_extract_all(text, F.lit(number), 1), lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s.cast("double")))
    )
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)).otherwise(default)


def after_hash(text: Column) -> Column:
    """Text between the first '#' and the next one, or the whole text."""
    return F.trim(F.when(text.contains("#"), F.split_part(text, F.lit("#"), F.lit(2))).otherwise(text))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_lines(text: Column) -> Column:
    """Stripped lines without blanks and remarks, joined again; the text itself if nothing is left."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(x))

    def keep(x: Column) -> Column:
        note = F.lit(False)
        for p in NOTE_PREFIXES:
            note = note | x.startswith(p)
        return (x != "") & ~note

    kept = F.filter(lines, keep)
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(text)


def top_lines(text: Column, n: int = 5) -> Column:
    """First n non-blank lines that are not headings."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, n), "\n")).otherwise(text)


def verdicts(text: Column, expected: Column) -> Column:
    """'yes; no; less precise' -> [1, 0, 0]; null when the number of verdicts is not the expected one."""
    items = F.transform(F.split(text, ";"), lambda v: F.trim(v))
    return F.when(F.size(items) == expected, F.transform(items, lambda v: F.when(v == "yes", 1).otherwise(0)))


def partial_verdicts(text: Column) -> Column:
    """How many verdicts say 'less precise'."""
    return F.size(F.filter(F.transform(F.split(text, ";"), lambda v: F.trim(v)), lambda v: v == "less precise"))


def repaired_guesses(guesses: Column) -> Column:
    """'My top 3 guesses: a, b, c' in one string -> its list."""
    first = F.coalesce(F.get(guesses, F.lit(0)), F.lit(""))
    body = F.when(first.contains(":"), F.split_part(first, F.lit(":"), F.lit(2))).otherwise(first)
    parts = F.split(body, ",")
    fixed = F.filter(F.transform(parts, lambda g: F.trim(g)), lambda g: ~F.lower(g).contains("and yes"))
    hit = F.lower(first).contains("my top 3 guesses") & (F.size(parts) > 1)
    return F.when(hit, fixed).otherwise(guesses)


def loose_map(text: Column) -> Column:
    """'{a: 1, b: x}' -> map of trimmed strings, quotes of quoted values removed."""
    body = F.regexp_replace(text, r"^\{(.*)\}$", "$1")
    value = lambda p: F.when(p.contains(":"), F.regexp_replace(F.trim(F.regexp_replace(p, "(?s)^[^:]*:", "")), "^(['\"])(.*)\\1$", "$2"))
    pairs = F.transform(F.split(body, ","), lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("key"), value(p).alias("value")))
    return keep_last(pairs)


def keep_last(pairs: Column) -> Column:
    """Map of an array of (key, value) structs; of equal keys the last one counts."""
    # held as an element of an array, pairs and names are made once a row and not again for each of them
    def kept(x: Column) -> Column:
        later = lambda i: F.slice(x["names"], i + 2, F.greatest(F.size(x["names"]) - i - 1, F.lit(0)))
        return F.map_from_entries(F.filter(x["pairs"], lambda p, i: ~F.array_contains(later(i), p["key"])))

    named = F.transform(F.array(pairs), lambda ps: F.struct(ps.alias("pairs"), F.transform(ps, lambda p: p["key"]).alias("names")))
    return F.get(F.transform(named, kept), F.lit(0))


# ---- changes between an original and its anonymised text ------------------------------------------

CHANGE = "array<struct<original:string,anonymized:string,reason:string>>"

# Known original / replacement pattern pairs, in order.
CHANGE_PATTERNS = [
    (r"\b[0-9]+\s*CHF\b", r"\b[0-9]+\s*units\b"),
    (r"\b[0-9]+\s*USD\b", r"\b[0-9]+\s*units\b"),
    (r"\b[0-9]+\s*EUR\b", r"\b[0-9]+\s*units\b"),
    (r"\bZürich\s+barbershop\b", r"\blocal\s+barbershop\b"),
    (r"\bZürich\b", r"\blocal\b"),
    (r"\bswiss\s+living\b", r"\bliving\s+here\b"),
    (r"\bSwiss\b", r"\bhere\b"),
    (r"\bWaldGänger\s+lifestyle\b", r"\bself-sufficient\s+lifestyle\b"),
    (r"\bWaldGänger\b", r"\bself-sufficient\b"),
    (r"\bhigh\s+income\b", r"\bsufficient\s+income\b"),
    (r"\bhigh\s+income\b", r"\bcomfortable\s+financially\b"),
    (r"\bsufficient\s+income\b", r"\bcomfortable\s+financially\b"),
    (r"\bcomfortable\s+financially\b", r"\bpractical\s+skill\b"),
    (r"\breddit\s+gold\b", r"\bentertainment\s+subscriptions\b"),
    (r"\bentertainment\s+subscriptions\b", r"\bpersonal\s+treats\b"),
    (r"\bonline\s+goodies\b", r"\bpersonal\s+hobbies\b"),
    (r"\bexpensive\s+professional\s+service\s+prices\b", r"\bsalon\s+routine\b"),
]
FLAGS = ["🇨🇭", "🇺🇸", "🇬🇧", "🇯🇵", "🇩🇪", "🇫🇷", "🇪🇺"]


def _change(original: Column, anonymized: Column, reason: str) -> Column:
    return F.struct(original.alias("original"), anonymized.alias("anonymized"), F.lit(reason).alias("reason"))


def _replaced_by(new: Column):
    """A one-argument function for `transform`, which would hand an index to a second argument."""
    return lambda h: F.when(new != "", _change(h, new, "PII removed/replaced")).otherwise(
        _change(h, F.lit("[removed]"), "PII removed")
    )


def _all_replaced(hits: Column):
    return lambda new: F.transform(hits, _replaced_by(new))


def _literals(pattern: str) -> list[str]:
    """The runs of letters that a pattern of CHANGE_PATTERNS asks for, in lower case."""
    return [w.lower() for w in re.split(r"\\b|\\s[*+]|\[0-9\]\+", pattern) if w]


def pattern_changes(original: Column, adapted: Column) -> Column:
    """Changes explained by a known pattern pair, then flags that disappeared."""
    found, low = [], F.lower(original)
    for before, after in CHANGE_PATTERNS:
        hits = F.regexp_extract_all(original, F.lit(f"(?i){before}"), 0)
        new = F.regexp_extract(adapted, f"(?i)({after})", 1)
        # the adapted text is searched once, not for every hit
        changes = F.flatten(F.transform(F.array(new), _all_replaced(hits)))
        # no hit without all literal words of the pattern, and these are found much faster
        lacks = reduce(lambda x, w: x | ~low.contains(w), _literals(before), F.lit(False))
        found.append(F.when(lacks, F.array().cast(CHANGE)).otherwise(changes))
    for flag in FLAGS:
        gone = original.contains(flag) & ~adapted.contains(flag)
        one = F.array(_change(F.lit(flag), F.lit("[removed]"), "Location flag emoji removed"))
        found.append(F.when(gone, one).otherwise(F.array().cast(CHANGE)))
    return F.concat(*found)


def _pieces(line: Column) -> Column:
    """Words and the white space between them, alternating, starting and ending with a word (maybe empty)."""
    lead = F.when(line.rlike(r"^\s"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    trail = F.when(line.rlike(r"\s$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(lead, F.regexp_extract_all(line, F.lit(r"\s+|\S+"), 0), trail)


def line_changes(original: Column, adapted: Column) -> Column:
    """Runs of unequal pieces at equal positions of equal-numbered lines, long and different enough to matter."""
    lines = F.arrays_zip(F.split(original, "\n").alias("o"), F.split(adapted, "\n").alias("a"))
    changed = F.filter(lines, lambda z: z["o"].isNotNull() & z["a"].isNotNull() & (z["a"] != "") & (z["o"] != z["a"]))
    blank = r"^[\s.,!?;:]+$"

    def long_enough(o: Column, a: Column) -> Column:
        return (F.length(strip(o)) > 2) & (F.length(strip(a)) > 2)

    def pushed(acc: Column, o: Column, a: Column, when: Column) -> Column:
        item = F.array(F.struct(strip(o).alias("original"), strip(a).alias("anonymized")))
        return F.when(when & long_enough(o, a), F.concat(acc["out"], item)).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        equal = p["o"] == p["a"]
        o, a = F.concat(acc["o"], p["o"]), F.concat(acc["a"], p["a"])
        differs = (acc["o"] != "") & (acc["a"] != "") & (strip(acc["o"]) != strip(acc["a"]))
        stop = (p["o"].rlike(blank) | p["a"].rlike(blank)) & (strip(o) != "") & (strip(a) != "")
        return F.struct(
            F.when(equal, F.when(differs, "").otherwise(acc["o"])).otherwise(F.when(stop, "").otherwise(o)).alias("o"),
            F.when(equal, F.when(differs, "").otherwise(acc["a"])).otherwise(F.when(stop, "").otherwise(a)).alias("a"),
            F.when(equal, pushed(acc, acc["o"], acc["a"], differs)).otherwise(pushed(acc, o, a, stop)).alias("out"),
        )

    empty = F.struct(
        F.lit("").alias("o"), F.lit("").alias("a"),
        F.array().cast("array<struct<original:string,anonymized:string>>").alias("out"),
    )

    def of_line(z: Column) -> Column:
        pieces = F.filter(
            F.arrays_zip(_pieces(z["o"]).alias("o"), _pieces(z["a"]).alias("a")),
            lambda p: p["o"].isNotNull() & p["a"].isNotNull(),
        )
        return F.aggregate(
            pieces, empty, step,
            lambda acc: pushed(
                acc, acc["o"], acc["a"],
                (acc["o"] != "") & (acc["a"] != "") & (strip(acc["o"]) != strip(acc["a"])),
            ),
        )

    runs = F.flatten(F.transform(changed, of_line))
    kept = F.filter(
        runs,
        lambda c: (F.length(c["original"]) > 3)
        & (F.length(c["anonymized"]) > 3)
        & (c["original"] != c["anonymized"])
        & (F.abs(F.length(c["original"]) - F.length(c["anonymized"])) > 1),
    )
    return F.transform(kept, lambda c: _change(c["original"], c["anonymized"], "Text modified"))


# Words that hint at an attribute inside a change.
CURRENCY = r"(?i)(?:\b(?:CHF|USD|EUR|GBP|JPY)\b|[$€£¥])"
PLACE_HINT = r"(?i)\b(?:Zürich|Zurich|Swiss|Switzerland|WaldGänger)\b|🇨🇭"
INCOME_HINT = r"(?i)\b(?:high income|sufficient income|comfortable financially|medium income|low income)\b"
SERVICE_HINT = r"(?i)\b(?:reddit gold|entertainment subscriptions|online goodies)\b"


def detected_changes(original: Column, adapted: Column) -> Column:
    """Changes explained by known patterns; only where there are none, the runs that differ line by line."""
    known = pattern_changes(original, adapted)
    return F.when(F.size(known) > 0, known).otherwise(line_changes(original, adapted))


def mentioned_attributes(reasoning: Column, changes: Column) -> Column:
    """Attribute named in a reasoning text, then hints found in the changes, without repeats."""
    clean = F.trim(F.regexp_replace(reasoning, r"[*`]", ""))
    named = F.lit("")
    for label in (r"Attribute:", r"PII\s+Type:", r"Type:"):
        hit = F.regexp_extract(clean, rf"(?i){label}\s*([^\n\r]+)", 1)
        named = F.when(hit != "", hit).otherwise(named)
    named = F.lower(F.regexp_replace(F.regexp_replace(F.trim(named), "^[\"']|[\"']$", ""), r"\s+", " "))
    stated = F.when(named.isin("", "none", "n/a"), F.array().cast("array<string>")).otherwise(F.array(named))

    def hint(name: str, test) -> Column:
        return F.when(F.exists(changes, test), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(
        F.concat(
            stated,
            hint("currency", lambda c: c["original"].rlike(CURRENCY) & c["anonymized"].rlike("(?i)units")),
            hint("location", lambda c: c["original"].rlike(PLACE_HINT) & ~c["anonymized"].rlike(PLACE_HINT)),
            hint("income", lambda c: c["original"].rlike(INCOME_HINT) | c["anonymized"].rlike(INCOME_HINT)),
            hint("subscription", lambda c: c["original"].rlike(SERVICE_HINT) | c["anonymized"].rlike(SERVICE_HINT)),
        )
    )
