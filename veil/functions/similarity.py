"""String and vector similarity as columns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the common-prefix boost (weight 0.1, up to 4, only above 0.7)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    # places of each character of b, the next one to try last: windows only move on, so a place that was passed stays passed
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    left, taken = [], []
    for i, ch in enumerate(a):
        rest = places.get(ch)
        if rest is None:
            continue
        while rest and rest[-1] < i - reach:
            rest.pop()
        if rest and rest[-1] <= i + reach:
            taken.append(rest.pop())
            left.append(ch)
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _each_pair_once(a: pd.Series, b: pd.Series, fn, kind) -> pd.Series:
    """Evaluate fn once per distinct pair of the Arrow batch."""
    memo: dict = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        key = (x, y)
        if key not in memo:
            memo[key] = fn(x, y)
        out.append(memo[key])
    return pd.Series(out, dtype=kind)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each_pair_once(a, b, _jaro_winkler, "float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def jaro_winkler_each(a: pd.Series, options: pd.Series) -> pd.Series:
    """Similarity of one string to each string of an array; a null string has none."""
    memo: dict = {}
    out = []
    for x, ys in zip(a, options):
        if x is None or ys is None:
            out.append(None)
            continue
        row = []
        for y in ys:
            if (x, y) not in memo:
                memo[(x, y)] = None if y is None else _jaro_winkler(x, y)
            row.append(memo[(x, y)])
        out.append(row)
    return pd.Series(out)


def jaro_winkler_to(options: Sequence[str]):
    """A function of one string: its similarity to each of a few fixed options."""
    fixed = list(options)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sims(a: pd.Series) -> pd.Series:
        memo: dict = {None: None}
        out = []
        for x in a:
            if x not in memo:
                memo[x] = [_jaro_winkler(x, y) for y in fixed]
            out.append(memo[x])
        return pd.Series(out)

    return sims


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def jaro_winkler_lists(subjects: pd.Series, options: pd.Series) -> pd.Series:
    """For each string of an array, its similarity to each string of the list at the same position."""
    memo: dict = {}

    def sim(x, y):
        if (x, y) not in memo:
            memo[(x, y)] = _jaro_winkler(x, y)
        return memo[(x, y)]

    return pd.Series(
        [
            None if xs is None or yss is None else [[sim(x, y) for y in ys] for x, ys in zip(xs, yss)]
            for xs, yss in zip(subjects, options)
        ]
    )


def common_ends(a: Sequence[str], b: Sequence[str]) -> tuple[int, int]:
    """Length of the common beginning, and of the common end of what is left."""
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last, most = 0, most - first
    while last < most and a[-1 - last] == b[-1 - last]:
        last += 1
    return first, last


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence length, one big-integer row per token of `b`.

    Equal beginnings and ends belong to it, tokens that the other side lacks don't.
    """
    first, last = common_ends(a, b)
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    both = set(a) & set(b)
    a, b = [t for t in a if t in both], [t for t in b if t in both]
    where: dict[str, int] = {}
    for i, tok in enumerate(a):
        where[tok] = where.get(tok, 0) | (1 << i)
    row, mask = (1 << len(a)) - 1, (1 << len(a)) - 1
    for tok in b:
        hit = row & where[tok]
        row = ((row + hit) | (row - hit)) & mask
    return first + last + len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of two token arrays."""
    return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def may_be_close(a: Column, b: Column) -> Column:
    """False only where Jaro-Winkler similarity can't pass 0.7, and so not 0.75, whatever the order of the characters.

    Below 0.7 the common prefix adds nothing. Matched characters are no more than those of one string that the other has
    at all, and with m of them the similarity is at most (m / |a| + m / |b| + 1) / 3.
    """
    n, m = F.char_length(a), F.char_length(b)
    left = lambda x, y: F.char_length(F.call_function("translate", x, y, F.lit("")))
    shared = F.least(n - left(a, b), m - left(b, a))
    bound = shared / F.nullif(n, F.lit(0)) + shared / F.nullif(m, F.lit(0))
    return (a == b) | F.coalesce(bound >= 1.1 - 1e-9, F.lit(False))


def is_close(a: Column, b: Column, min_sim: float = 0.75) -> Column:
    return jaro_winkler(a, b) > min_sim


def is_close_any(a: Column, options: Sequence[str], min_sim: float = 0.75) -> Column:
    return F.exists(jaro_winkler_to(options)(a), lambda s: s > min_sim)


def is_close_loose(a: Column, b: Column, min_sim: float = 0.75) -> Column:
    """Whole string for one word, any word for two to four, never for more."""
    words = F.split(a, " ")
    return (F.size(words) <= 4) & F.exists(jaro_winkler_each(b, words), lambda s: s > min_sim)


def first_best(options: Column, scores: Column) -> Column:
    """Option of the greatest score; the first wins ties; null when every score is 0."""
    best = F.array_max(scores)
    return F.when(best > 0, F.element_at(options, F.array_position(scores, best).cast("int")))


def closest(value: Column, options: Sequence[str]) -> tuple[Column, Column]:
    """(option, similarity) of the most similar of a few fixed options."""
    given = F.array(*[F.lit(o) for o in options])
    sims = jaro_winkler_to(options)(value)
    return first_best(given, sims), F.array_max(sims)


def closest_by_edits(value: Column, options: Sequence[str]) -> tuple[Column, Column]:
    """(option, edit distance) of the least edit distance; the first wins ties."""
    given = F.array(*[F.lit(o) for o in options])
    dist = F.transform(given, lambda o: F.levenshtein(value, o))
    least = F.array_min(dist)
    return F.element_at(given, F.array_position(dist, least).cast("int")), least


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 when both are empty."""
    return F.coalesce(
        F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0)
    )
