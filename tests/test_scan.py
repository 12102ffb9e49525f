"""The one-scan entity detection, against a search per pattern."""

import random
import re
import time

from pyspark.sql import functions as F

from veil.functions import scan
from veil.operators import masking as OM

PARTS = [
    "joe.doe@example.org", "a@b.co", "@", "555-123-4567", "(555) 123 4567", "+1 555 123 4567", "https://www.example.com/a?b=1", "http://", "10.0.0.255", "1.2.3.4.5",
    "Mar 3rd, 1990", "May 1 20201", "3/4/1991", "1992-05-06", "1992-05-06-07", "34 years old", "18 y.o.", "Zurich, Switzerland", "Paris, France, EU", "San Jose", "San Joses",
    "Boston", "é", "Ünï", "x9", "_", " ", "  ", "\n", "\t", ",", ".", "-", "(", "+", "7", "A", "日本", "\U0001f600", "١٢",
]


def plain_matches(text):
    out = []
    for order, (kind, _, conf) in enumerate(scan.PATTERNS):
        pattern = scan._ALL[order][2]
        out += [(m.start(), -m.end(), order, kind, conf) for m in re.finditer(pattern, text)]
    return sorted(out)


def test_one_scan_finds_what_each_pattern_finds():
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 25)))
        assert scan.matches(text) == plain_matches(text), text
    assert {k for k, *_ in scan.PATTERNS} == {m[3] for m in plain_matches(" ".join(PARTS))}


def test_kept_spans_are_disjoint_and_greedy():
    rng = random.Random(13)
    for _ in range(300):
        found = sorted((rng.randint(0, 30), -rng.randint(31, 60) // rng.randint(1, 3) - 31, k, "A", 1.0) for k in range(rng.randint(0, 8)))
        kept, end = [], 0
        for m in found:
            if m[0] >= end:
                kept.append(m)
                end = -m[1]
        assert list(scan.disjoint(found)) == kept


def test_scan_is_linear_in_hits():
    def seconds(n):
        text = "Boston 10.0.0.1 a@b.co " * n
        start = time.perf_counter()
        found = scan._pieces(text)
        assert len(found["pieces"]) == 3 * n and found["tail"] == " "
        return time.perf_counter() - start

    seconds(100)
    small, large = min(seconds(4_000) for _ in range(3)), seconds(40_000)
    assert large < 40 * small


def test_masking_odd_rows(spark):
    many = "10.0.0.1 " * 100_000
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (4, many), (4, many), (None, "Boston")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("spans", F.lit("own")).withColumn("_scan", F.lit(1))
    got = OM.anonymise(df.drop("_scan"), "text").select("k", F.length("masked").alias("n"), "spans").collect()
    assert sorted((str(r["k"]), r["n"]) for r in got) == [("1", None), ("2", 0), ("3", 200_000), ("4", 1_100_000), ("4", 1_100_000), ("None", 8)]
    assert {r["spans"] for r in got} == {"own"}
    assert OM.span_rows(OM.with_spans(df, "text", "found"), ["k"], "found").count() == 200_001
    assert OM.anonymise(df.filter("false"), "text").count() == 0
