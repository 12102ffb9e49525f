"""BLEU, ROUGE and ROUGE-Lsum of text pairs, against tables and plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veil.functions.overlap import clipped, sentences, summary_matches
from veil.operators import quality as Q
from veil.plans.registry import callable_for, load

SF = "/root/testdata/sf0.001"


def table_places(a, b):
    """Places in `a` of the common subsequence that walking back through the whole table finds."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def table_matches(original, adapted):
    a, b, hits = Counter(sum(original, [])), Counter(sum(adapted, [])), 0
    for s in original:
        union = set().union(*[table_places(s, o) for o in adapted])
        for i in sorted(union):
            if a[s[i]] > 0 and b[s[i]] > 0:
                hits += 1
                a[s[i]] -= 1
                b[s[i]] -= 1
    return hits


def test_union_of_common_subsequences_equals_tables():
    rng = random.Random(3)
    for _ in range(400):
        make = lambda: [[rng.choice("abcde") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 5))]
        a, b = make(), make()
        if rng.random() < 0.5:
            b[0] = list(a[0])
        assert summary_matches(a, b) == table_matches(a, b), (a, b)


def test_union_counts_by_hand():
    # one line against two: "w1 w2" from the first, "w1 w3 w5" from the second; the union has four words
    a, b = sentences("w1 w2 w3 w4 w5"), sentences("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5")
    assert summary_matches(a, b) == 4
    assert summary_matches([[]], [["a"]]) == 0 and summary_matches([["a", "a"]], [["a"]]) == 1


def test_clipped_matches():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 12))] for _ in range(2))
        for n in (1, 2, 3, 4):
            left, right = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
            assert clipped(a, b, n) == sum((left & right).values())


def test_odd_pairs(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, "", ""), (4, "!!", "??"), (5, "a " * 30_000, "a " * 29_000), (6, "One two.\nThree", "three\none TWO"), (6, "a", "b")]
    pairs = spark.createDataFrame(rows, "k int, o string, a string")
    got = {r["k"]: r for r in Q.text_scores(pairs.filter("k < 6 OR o <> 'a'"), "k", "o", "a").collect()}
    assert got[1]["bleu"] is None and got[2]["bleu"] is None and len(got) == 6
    assert got[3]["rougeLsum"] == 0 and got[4]["rougeLsum"] == 0
    assert got[5]["rougeLsum"] == pytest.approx(2 * 29 / 59) and got[5]["rouge1"] == pytest.approx(2 * 29 / 59)
    assert got[6]["rougeLsum"] == 1 and got[6]["rougeL"] == pytest.approx(2 / 3)
    assert Q.rouge_lsum(pairs, "k", "o", "a").count() == 5 and Q.sentence_bleu(pairs, "k", "o", "a").count() == 5
    none = pairs.filter("false")
    assert all(f(none, "k", "o", "a").count() == 0 for f in (Q.text_scores, Q.sentence_bleu, Q.rouge_1, Q.rouge_l, Q.rouge_lsum, Q.set_scores))


def test_rouge_lsum_query_equals_tables(spark):
    rows = {r["doc_id"]: r for r in callable_for(load()["rouge_lsum"])(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 4000).collect()
    assert len(docs) > 50
    for r in docs:
        text = r["text"]
        a, b = (sentences(t.lower()) for t in (text, text.replace(" the ", " a ").replace("ion", "").replace("eau", "o")))
        assert rows[r["doc_id"]]["hits"] == table_matches(a, b)


def test_scores_need_no_shuffle(spark):
    pairs = spark.createDataFrame([(1, "a", "b")], "k int, o string, a string")
    for f in (Q.sentence_bleu, Q.rouge_1, Q.rouge_l, Q.rouge_lsum, Q.set_scores, Q.text_scores):
        assert "Exchange" not in f(pairs, "k", "o", "a")._jdf.queryExecution().executedPlan().toString()
