"""Clipped n-gram matches and summary-level common subsequences of two texts, one map stage over Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterator, Sequence
from itertools import chain
from math import isqrt
from operator import eq

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions.similarity import _lcs, common_ends

#: What ROUGE takes as a word of a lower-cased text.
WORD = re.compile("[a-z0-9]+")


def spaced(text: str) -> list[str]:
    return text.split(" ")


def words(text: str) -> list[str]:
    return WORD.findall(text)


def _unaligned(a: list[str], b: list[str], n: int, unequal: list[int] | None, first: int, last: int) -> tuple[Sequence[int], Sequence[int]]:
    """Starts of the n-grams of both texts that don't lie in words that the texts have at the same place."""
    if unequal is not None:
        most = len(a) - n + 1
        starts = sorted({i for j in unequal for i in range(max(0, j - n + 1), min(j + 1, most))})
        return starts, starts
    from_ = max(0, first - n + 1)
    return range(from_, max(from_, min(len(a) - last, len(a) - n + 1))), range(from_, max(from_, min(len(b) - last, len(b) - n + 1)))


def clipped_up_to(a: list[str], b: list[str], max_n: int) -> list[int]:
    """For n from 1 to `max_n`: n-grams of `b` that `a` has too, each at most as often as in `a`.

    Those that both texts have at the same place (of as many words each; otherwise, counted from the beginning or the end) are in
    both, as often as there are such places; only the others are looked up.
    """
    unequal, first, last = None, 0, 0
    if len(a) == len(b):
        unequal = [i for i, same in enumerate(map(eq, a, b)) if not same]
    else:
        first, last = common_ends(a, b)
    out = []
    for n in range(1, max_n + 1):
        if len(a) < n or len(b) < n:
            out.append(0)
            continue
        p, q = _unaligned(a, b, n, unequal, first, last)
        gram = (lambda x, i: x[i]) if n == 1 else (lambda x, i, n=n: tuple(x[i : i + n]))
        left, right = Counter([gram(a, i) for i in p]), Counter([gram(b, i) for i in q])
        if len(right) < len(left):
            left, right = right, left
        out.append(len(a) - n + 1 - len(p) + sum(min(c, right[g]) for g, c in left.items() if g in right))
    return out


def clipped(a: list[str], b: list[str], n: int) -> int:
    """n-grams of `b` that `a` has too, each at most as often as in `a`."""
    return clipped_up_to(a, b, n)[-1]


def ngram_matches(original: Column, adapted: Column, split: Callable[[str], list[str]], max_n: int) -> Column:
    """[matches of order 1 .. max_n, tokens of the original, tokens of the adapted text]; null if a text is null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            p, q = split(x), split(y)
            out.append([*clipped_up_to(p, q, max_n), len(p), len(q)])
        return pd.Series(out)

    return count(original, adapted)


def _common_places(a: Sequence[str], where: dict[str, int], b: Sequence[str | None]) -> set[int]:
    """Places in `a` of one longest common subsequence with `b`; a None in `b` stands for any run of tokens that `a` lacks.

    A big integer per token of `b` is the table's row: a bit is 0 where the length grows. Going back from the end, equal
    tokens are taken; otherwise the last token of `a` is let go if the length stays without it, else the last of `b`.
    Only some rows are kept, and those between are made again on the way back.
    """
    full = (1 << len(a)) - 1
    step = isqrt(len(b)) + 1

    def rows_after(row: int, tokens: Sequence[str | None]) -> Iterator[int]:
        for token in tokens:
            hit = row & where.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
            yield row

    kept, row = [], full
    for start in range(0, len(b), step):
        kept.append(row)
        for row in rows_after(row, b[start : start + step]):
            pass
    found, i = set(), len(a)
    for block in range(len(kept) - 1, -1, -1):
        start = block * step
        rows = list(rows_after(kept[block], b[start : start + step]))
        j = len(rows)
        while i and j:
            if a[i - 1] == b[start + j - 1]:
                i, j = i - 1, j - 1
                found.add(i)
            elif rows[j - 1] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
    return found


def _common_part(words_of: Container[str], sentence: Sequence[str]) -> list[str | None]:
    """Those of the words that the sentence has, in order, with a None for what is between and behind."""
    part: list[str | None] = []
    gap = False
    for token in sentence:
        if token in words_of:
            if gap and part:
                part.append(None)
            part.append(token)
            gap = False
        else:
            gap = True
    if gap and part:
        part.append(None)
    return part


def _union(s: tuple[str, ...], others: list[tuple[str, ...]], having: dict[str, list[int]], likely: int) -> set[int]:
    """Places of `s` in its common subsequences with any of the other sentences; `having` tells which have a token.

    A sentence adds places only if it has a token whose places aren't all found yet, so the likely one goes first, and mostly few follow.
    """
    where: dict[str, int] = {}
    open_places: dict[str, set[int]] = {}
    for i, t in enumerate(s):
        where[t] = where.get(t, 0) | 1 << i
        if t in having:
            open_places.setdefault(t, set()).add(i)
    found: set[int] = set()
    done: set[int] = set()

    def take(k: int) -> None:
        done.add(k)
        new = _common_places(s, where, _common_part(where, others[k])) - found
        found.update(new)
        for i in new:
            left = open_places[s[i]]
            left.discard(i)
            if not left:
                del open_places[s[i]]

    if open_places and likely < len(others):
        take(likely)
    while open_places:
        token = min(open_places, key=lambda t: len(having[t]))
        for k in having[token]:
            if k not in done:
                take(k)
                if token not in open_places:
                    break
        open_places.pop(token, None)  # no other sentence has it
    return found


def summary_matches(original: list[list[str]], adapted: list[list[str]]) -> int:
    """Tokens of the original's sentences in the union of their common subsequences with all adapted sentences.

    A token counts as often as both texts have it, no more.
    """
    left_a = Counter(chain.from_iterable(original))
    left_b = Counter(chain.from_iterable(adapted))
    numbers: dict[tuple[str, ...], int] = {}
    at = [numbers.setdefault(t, len(numbers)) for t in map(tuple, adapted)]
    others = list(numbers)
    having: dict[str, list[int]] = {}
    for k, other in enumerate(others):
        for t in set(other):
            having.setdefault(t, []).append(k)
    known: dict[tuple[str, ...], Sequence[int]] = {}
    hits = 0
    for n, s in enumerate(map(tuple, original)):
        if s not in known:
            known[s] = range(len(s)) if s in numbers else sorted(_union(s, others, having, at[n] if n < len(at) else 0))
        for i in known[s]:
            t = s[i]
            if left_a[t] > 0 and left_b[t] > 0:
                hits += 1
                left_a[t] -= 1
                left_b[t] -= 1
    return hits


def sentences(text: str) -> list[list[str]]:
    """The words of each line."""
    return [words(line) for line in text.split("\n")]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def subsequence_counts(a: pd.Series, b: pd.Series) -> pd.Series:
    """[length of the longest common subsequence, tokens of the original, tokens of the adapted text] of lower-cased texts."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        p, q = words(x), words(y)
        out.append([_lcs(p, q), len(p), len(q)])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def summary_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """[tokens in the union of common subsequences, tokens of the original, tokens of the adapted text] of lower-cased texts."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        p, q = sentences(x), sentences(y)
        out.append([summary_matches(p, q), sum(map(len, p)), sum(map(len, q))])
    return pd.Series(out)
