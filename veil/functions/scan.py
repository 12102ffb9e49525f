"""One scan of a text for all entity patterns.

Every match begins at a word boundary before a capital, a digit, '+' or '(', or belongs to a text with '@' or 'http'. The scan goes
from one such place to the next and tries only the patterns that can begin there, each from behind its own last match on,
so it finds what a search for each pattern finds. Overlaps are then swept in one pass over the matches by start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions.entities import PATTERNS

_FIELDS = [("start", T.IntegerType()), ("end", T.IntegerType()), ("kind", T.StringType()), ("text", T.StringType()), ("confidence", T.DoubleType())]


def _array_of(fields: list[tuple[str, T.DataType]]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields]))


SPANS = _array_of(_FIELDS)
PIECES = T.StructType([T.StructField("pieces", _array_of([*_FIELDS, ("before", T.StringType())])), T.StructField("tail", T.StringType())])

_BLANKS = r" \t\n\v\f\r"


def _python(pattern: str) -> re.Pattern[str]:
    """The pattern with ASCII classes spelled out; a word boundary knows all letters."""
    return re.compile(pattern.replace(r"[-.\s]", f"[-.{_BLANKS}]").replace(r"\s", f"[{_BLANKS}]").replace(r"\d", "[0-9]"))


#: (order, kind, pattern, confidence) by what a match begins with; `SEARCHED` patterns are searched where a text has the string.
_ALL = [(i, kind, _python(p), conf) for i, (kind, p, conf) in enumerate(PATTERNS)]
SEARCHED = {"EMAIL": "@", "URL": "http"}
AT_NUMBER = [x for x in _ALL if PATTERNS[x[0]][1].startswith("(?=[0-9")]
AT_CAPITAL = [x for x in _ALL if PATTERNS[x[0]][1].startswith("(?=[A-Z")]
PLACE = re.compile(r"\b[0-9+(A-Z]")

Match = tuple[int, int, int, str, float]


def matches(text: str) -> list[Match]:
    """(start, -end, order, kind, confidence) of all matches of all patterns, sorted."""
    found: list[Match] = []
    for order, kind, pattern, conf in _ALL:
        if kind in SEARCHED and SEARCHED[kind] in text:
            found += [(m.start(), -m.end(), order, kind, conf) for m in pattern.finditer(text)]
    free = [0] * len(_ALL)
    for place in PLACE.finditer(text):
        at = place.start()
        for order, kind, pattern, conf in AT_CAPITAL if text[at].isalpha() else AT_NUMBER:
            if at >= free[order]:
                m = pattern.match(text, at)
                if m:
                    free[order] = m.end()
                    found.append((at, -m.end(), order, kind, conf))
    found.sort()
    return found


def disjoint(found: list[Match]) -> Iterator[Match]:
    """Of sorted matches, those that begin at or behind the end of the last one kept; the longest of equal starts comes first."""
    end = 0
    for m in found:
        if m[0] >= end:
            end = -m[1]
            yield m


def _series(each: Callable[[str], object], values: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else each(x) for x in values], dtype=object)


def _spans(text: str, found) -> list[dict]:
    return [{"start": a, "end": -b, "kind": k, "text": text[a:-b], "confidence": c} for a, b, _, k, c in found]


@F.pandas_udf(SPANS)
def all_spans(texts: pd.Series) -> pd.Series:
    return _series(lambda t: _spans(t, matches(t)), texts)


@F.pandas_udf(SPANS)
def disjoint_spans(texts: pd.Series) -> pd.Series:
    return _series(lambda t: _spans(t, disjoint(matches(t))), texts)


def _pieces(text: str) -> dict:
    spans, end = _spans(text, disjoint(matches(text))), 0
    for s in spans:
        s["before"] = text[end : s["start"]]
        end = s["end"]
    return {"pieces": spans, "tail": text[end:]}


@F.pandas_udf(PIECES)
def pieces(texts: pd.Series) -> pd.DataFrame:
    """The disjoint spans with the text before each, and the text behind the last."""
    none = {"pieces": None, "tail": None}
    return pd.DataFrame([none if x is None else _pieces(x) for x in texts], columns=["pieces", "tail"])
