"""What must not grow with the input: batches, calls, candidates, sorts; beside plain versions of the same results."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tests.test_timed_state import run_batches
from veil.functions.answers import keep_last, pattern_changes
from veil.functions.overlap import clipped_up_to
from veil.functions.similarity import _jaro_winkler, _lcs
from veil.operators import joins, prompts, quality, skills
from veil.sources.results import log_records
from veil.streaming import counters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_counted_once(spark):
    rows = [(1, "a b c d e\nf g", "a b x d e\nf g"), (2, None, "a"), (3, "a", None), (4, "", "")]
    pairs = spark.createDataFrame(rows, "k int, o string, a string")
    for scores in (quality.sentence_bleu, quality.rouge_l, quality.rouge_lsum):
        found = scores(pairs, "k", "o", "a")
        assert plan(found).count("ArrowEvalPython [") == 1, scores
        assert sorted(r["k"] for r in found.collect()) == [1, 4]
    assert [r["lcs"] for r in quality.rouge_l(pairs, "k", "o", "a").orderBy("k").collect()] == [6, 0]


def test_a_model_gets_small_batches(spark):
    asked = spark.range(2000).coalesce(1).select("id", F.lit("x").alias("prompt"))
    answered = prompts.live(lambda s: pd.Series([str(len(s))] * len(s)))(asked)
    assert max(int(r["answer"]) for r in answered.collect()) <= 256


def test_clipped_matches_of_texts_alike():
    r = random.Random(3)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randint(0, 12))]
        b = [x if r.random() < 0.8 else r.choice("abcde") for x in a][: r.randint(0, 14)]
        for n, got in enumerate(clipped_up_to(a, b, 4), 1):
            left, right = ([tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in (a, b))
            assert got == sum(min(left.count(g), right.count(g)) for g in set(left)), (a, b, n)


def test_jaro_winkler_of_long_texts():
    assert _jaro_winkler("a" * 30_000, "b" * 30_000) == 0.0
    assert _jaro_winkler("ab" * 20_000, "ab" * 20_000 + "c") > 0.9

    def plain(a, b):
        reach, free, left = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] and b[j] == ch:
                    free[j] = False
                    left.append(ch)
                    break
        right = [ch for ch, unused in zip(b, free) if not unused]
        return left, right

    r = random.Random(5)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in "ab")
        left, right = plain(a, b)
        m = len(left)
        jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) // 2) / m) / 3 if m else 0.0
        assert a == b or _jaro_winkler(a, b) >= jaro - 1e-12 and (jaro > 0.7 or _jaro_winkler(a, b) == jaro), (a, b)
        assert _lcs(list(a), list(b)) == _lcs(list(b), list(a))


def test_pattern_changes_of_any_case(spark):
    rows = [(1, "ZüRICH  BARBERSHOP, 5chf, swISS  living", "LIVING  here 3 units"), (2, None, "x"), (3, "Swiss swiss", None), (4, "CHF high  income", "")]
    df = spark.createDataFrame(rows, "k int, o string, a string").select("k", pattern_changes(F.col("o"), F.col("a")).alias("c"))
    found = {r["k"]: r["c"] and [(c["original"], c["anonymized"]) for c in r["c"]] or r["c"] for r in df.collect()}
    assert found[1] == [("5chf", "3 units"), ("ZüRICH  BARBERSHOP", "[removed]"), ("ZüRICH", "[removed]"), ("swISS  living", "LIVING  here"), ("swISS", "here")]
    assert found[2] is None and found[3] == [("Swiss", "[removed]"), ("swiss", "[removed]")]
    assert found[4] == [("high  income", "[removed]")] * 2
    assert "contains(lower(" in plan(df).lower()  # patterns run only where their words are


def test_keep_last(spark):
    kind = "k int, p array<struct<key:string,value:string>>"
    rows = [(1, [("a", "1"), ("b", "2"), ("a", "3")]), (2, []), (3, None), (4, [("a", None)])]
    df = spark.createDataFrame(rows, kind).select("k", keep_last(F.transform("p", lambda x: x)).alias("m"))
    assert {r["k"]: r["m"] for r in df.collect()} == {1: {"b": "2", "a": "3"}, 2: {}, 3: None, 4: {"a": None}}
    assert plan(df).count("transform(p") == 1  # the pairs are made once a row


def test_state_rows_hold_many_runs(spark, tmp_path):
    runs = [(p, 2, 0.1, 0) for p in range(3000)]
    found, left = run_batches(spark, tmp_path, [runs, [(5000, 1, 0.1, 100)]])
    assert found == [(5000, 1, False, False, 0)] and left <= counters.RUN_GROUPS
    found, left = run_batches(spark, tmp_path / "more", [runs, [(5000, 1, 0.1, 5000)], [(5000, 2, 0.1, 9000)]])
    assert found == [(p, 1, False, True, 1) for p in range(3000)] + [(5000, 1, False, False, 0), (5000, 2, False, False, 0)] and left == 1


def test_log_lines_are_sorted_once(spark):
    texts = ["评估用户: u1", "隐私: 0.5, 效用: 0.9", 'attack_result: {"age": {"guess": ["1"],', ' "certainty": 2}}', "评估用户: u2", "x"]
    lines = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(texts)], "file string, block long, seq long, value string")
    found = log_records(lines)
    tree = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert all("seq#" not in line for line in tree if line.strip(" +-:").startswith("Window"))  # windows left are over splits
    assert [(r["username"], r["privacy"], r["utility"], r["attack"] and r["attack"]["age"]["certainty"]) for r in found.orderBy("record").collect()] == [
        ("u1", 0.5, 0.9, 2), ("u2", 0.0, 0.8, None)
    ]


def test_pieces_are_not_dealt_where_no_bin_is_full(spark):
    left = spark.createDataFrame([(1, 0, 9), (1, 5, 5), (None, 1, 2)], "k int, a int, b int")
    right = spark.createDataFrame([(1, 5, 5, 1.0), (1, 20, 30, 2.0)], "k int, c int, d int, v double")
    found = joins.interval_join(left, right, ["k"], ("a", "b"), ("c", "d"))
    assert "_part" not in plan(found) and sorted(map(tuple, found.collect())) == [(1, 0, 9, 5, 5, 1.0), (1, 5, 5, 5, 5, 1.0)]
    dealt = joins.interval_join(left, right, ["k"], ("a", "b"), ("c", "d"), block=1)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, found.collect()))


def test_coupled_sets_against_all_pairs(spark):
    r = random.Random(7)
    sets = {s: {r.randint(0, 30) for _ in range(r.choice([2, 3, 4, 5, 90]))} for s in range(120)}
    rows = [(s, d) for s, ds in sets.items() for d in ds]
    found = skills.coupled_sets(spark.createDataFrame(rows, "skill_id long, dep_id long"))
    firsts = {}
    for s in sorted(sets):
        if len(sets[s]) > 1:
            firsts.setdefault(frozenset(sets[s]), s)
    wanted = {(a, b) for x, a in firsts.items() for y, b in firsts.items() if a < b and 2 * len(x & y) > len(x | y)}
    assert {(x["rep_a"], x["rep_b"]) for x in found.collect() if x["rep_a"] != x["rep_b"]} == wanted and wanted
    assert "bit_count" in plan(found)
