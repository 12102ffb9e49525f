"""Inputs with every odd row, and plain stand-ins to compare with."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.01"

ODD_TEXTS = [
    (1, "a b c d e"), (2, None), (3, ""), (4, " \n\t "), (5, "word " * 30_000), (6, "a b c d e"), (6, "a b c d e"), (7, "a\tb  c\nd e"),
    (8, "x" * 50_000), (9, "Ünï \U0001f600 x@y.example 10.0.0.1 +1 (988) 555-2485"), (None, "a b c d e"), (10, None),
]


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    rows = [(i, t, None if i == 3 else "en", None if i in (2, 7) else f"s{(i or 0) % 3}", len(t or ""), 1, "x", [1.5]) for i, t in ODD_TEXTS]
    names = "doc_id long, text string, lang string, source string, n_chars long, `_row` int, size string, stats array<double>"
    return spark.createDataFrame(rows, names)


def no_documents(spark):
    return odd_documents(spark).filter("false")


class Sets:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def words(rng: random.Random, parts: list[str], n: int) -> str:
    return "".join(rng.choice(parts) for _ in range(n))


def auc(y, s) -> float:
    """Share of (1, 0) pairs in order, ties as half."""
    ones, zeros = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a == 0]
    return sum((p > q) + 0.5 * (p == q) for p in ones for q in zeros) / (len(ones) * len(zeros))
