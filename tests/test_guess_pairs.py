"""Guess scoring on distinct pairs: against the rule row by row, with odd rows and a heavy one."""

import random

from pyspark.sql import functions as F

from veil.functions.matching import guesses_are_correct
from veil.functions.similarity import _jaro_winkler, may_be_close
from veil.operators.evaluation import score_guesses

KIND = "id int, pii_type string, estimate string, guesses array<string>"
VALUES = {
    "income": ["low", "lov", "middle", "high", "very high", "50k"], "married": ["married", "in relationship", "single", "divorced", "maried"],
    "education": ["phd", "bachelors degree", "in college", "no highschool", "hs diploma"], "gender": ["male", "female", "femal", "m", "man"],
    "location": ["zurich, switzerland", "Zurich", "geneva", "paris, france", "switzerland"], "occupation": ["nurse", "Nurses", "software engineer", "enginer software", ""],
    "age": ["34", "30-40", "35 years", "old", "12"], "pobp": ["berlin", "bern", "Bärn", "東京", "京東"],
}


def some_rows(rng, n):
    out = []
    for i in range(n):
        kind = rng.choice(list(VALUES))
        guesses = [rng.choice([rng.choice(VALUES[kind]), f" {rng.choice(VALUES[kind]).upper()} "]) for _ in range(rng.randint(0, 4))]
        out.append((i, kind, rng.choice(VALUES[kind]).lower(), guesses))
    return out


def test_pairs_equal_rows(spark):
    rows = some_rows(random.Random(3), 600)
    rows += [(10_000 + i, "location", "zurich", ["Zürich", "zurich"]) for i in range(3000)]  # one list that most rows share
    rows += [(-1, "location", None, ["x", "y"]), (-2, None, "x", ["x"]), (-3, "gender", "male", None), (-4, "occupation", "x", ["x", None]), (-5, "occupation", "x", [])]
    df = spark.createDataFrame(rows, KIND)
    usual = df.filter("id >= 0 OR id = -5")
    wanted = {r["id"]: r["v"] for r in usual.select("id", guesses_are_correct(F.col("pii_type"), F.col("estimate"), F.col("guesses")).alias("v")).collect()}
    scored = score_guesses(df.withColumn("is_correct", F.lit("old"))).collect()
    found = {r["id"]: r["is_correct"] for r in scored}
    assert len(scored) == len(rows) and {i: v for i, v in found.items() if i in wanted} == wanted
    assert found[-1] == [0, 0] and found[-2] == [0] and found[-3] is None and found[-4][0] == 1 and found[-5] == []
    assert {v for r in wanted.values() for v in r} == {0, 1}
    assert score_guesses(df.filter("false")).count() == 0


def test_nothing_near_is_ruled_out(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé\U0001f600 ") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    able = {(r["a"], r["b"]): r["m"] for r in pairs.select("a", "b", may_be_close(F.col("a"), F.col("b")).alias("m")).collect()}
    assert all(m for (a, b), m in able.items() if _jaro_winkler(a, b) > 0.75)
    assert sum(able.values()) < 0.8 * len(able)


def test_python_sees_distinct_pairs_only(spark, tmp_path):
    """What reaches Python: one row per distinct pair that can be near."""
    rows = [(i, "occupation", "nurse", ["Nurse ", "pilot", "nurses"]) for i in range(500)]
    plan = score_guesses(spark.createDataFrame(rows, KIND).repartition(4))
    plan.write.format("noop").mode("overwrite").save()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    below = text[text.index("ArrowEvalPython") :].split("\n")[1:4]
    assert any(line.strip(" +-:").startswith("Aggregate") for line in below), below
