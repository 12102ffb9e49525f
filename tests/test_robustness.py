"""The model stage and loop, streams over many files, and records with missing parts."""

import json

import pandas as pd
from pyspark.sql import functions as F

from veil.functions.answers import loose_map, repaired_guesses
from veil.operators import answers as A
from veil.operators import loop as L
from veil.operators import prompts as P
from veil.sources import profiles as S
from veil.sources import results as R
from veil.streaming import counters as C
from veil.streaming.run import drain


def counting(spark, answer):
    """A live model and the counter of prompts it was sent."""
    sent = spark.sparkContext.accumulator(0)

    def call(prompts: pd.Series) -> pd.Series:
        sent.add(len(prompts))
        return prompts.map(answer)

    return P.live(call), sent


def test_rounds_send_each_prompt_once_and_keep_all_samples(spark):
    samples = spark.createDataFrame([("a#1", "nurse at work"), ("b", "chef here"), ("c", "nobody")], "username string, text string")
    truth = spark.createDataFrame([("a#1", "occupation", "nurse"), ("b", "occupation", "pilot")], "username string, pii_type string, estimate string")
    # the defender gives way only when it is told what the attacker found
    defender, defended = counting(spark, lambda p: "why\n#" + ("hidden" if "BREACH: the attacker found 'occupation: nurse'" in p else p.split("\n\n", 1)[1]))
    attacker, attacked = counting(spark, lambda p: json.dumps({"occupation": {"guess": [p.split(" ")[0]], "certainty": 5}}))
    judge, judged = counting(spark, lambda p: '{"readability": {"score": 10}, "meaning": {"score": 10}, "hallucinations": {"score": 1}}')
    rows = L.run_rounds(samples, truth, defender, attacker, judge, max_rounds=3).orderBy("username", "round").collect()
    got = [(r["username"], r["round"], r["anonymized"], r["privacy_score"], r["stopped"]) for r in rows]
    assert got == [("a#1", 1, "nurse at work", 0.0, False), ("a#1", 2, "hidden", 1.0, True), ("b", 1, "chef here", 1.0, True), ("c", 1, "nobody", 1.0, True)]
    assert rows[1]["feedback"].startswith("BREACH") and rows[3]["attack_success_rate"] == 0.0
    assert defended.value == attacked.value == judged.value == 4


def test_early_rule_waits_for_the_second_round(spark):
    samples = spark.createDataFrame([("c", "nobody")], "username string, text string")
    truth = spark.createDataFrame([], "username string, pii_type string, estimate string")
    same = P.computed(F.concat(F.lit("#"), F.col("prompt")))
    attacker = P.computed(F.lit("not json"))
    judge = P.computed(F.lit('{"readability": {"score": 1}, "meaning": {"score": 10}, "hallucinations": {"score": 0}}'))
    rows = L.run_rounds(samples, truth, same, attacker, judge, stop="early").orderBy("round").collect()
    assert [(r["round"], r["stopped"], r["privacy_score"]) for r in rows] == [(1, False, 1.0), (2, True, 1.0)]


def long_profile(spark, n=1500):
    rows = [("u#1", i, "s" + str(i % 3), 1_400_000_000 + (n - i), f"comment {i}") for i in range(n)] + [("v", 0, "s", 1_400_000_000, "only")]
    return spark.createDataFrame(rows, "username string, ord long, subreddit string, epoch long, text string")


def test_parts_follow_the_order_of_the_whole_profile(spark):
    comments = long_profile(spark)
    whole = {r["username"]: r["block"] for r in P.comment_blocks(comments).collect()}
    assert whole["u#1"].count("\n") == 1499
    parts = P.comment_blocks(comments, 400).orderBy("username", "part").collect()
    assert [(r["username"], r["part"]) for r in parts] == [("u#1", 0), ("u#1", 1), ("u#1", 2), ("u#1", 3), ("v", 0)]
    assert "\n".join(r["block"] for r in parts if r["username"] == "u#1") == whole["u#1"]


def test_inference_is_one_result_per_profile(spark):
    comments = long_profile(spark)
    attributes = spark.createDataFrame([("u#1", "age"), ("v", "age")], "username string, pii_type string")
    model, sent = counting(spark, lambda p: "Type: age\nInference: seen\nGuess: " + p.split(": ")[1].split("\n")[0] + "\nCertainty: 3")
    out = L.infer_stage(P.comment_blocks(comments, 400), attributes, comments.filter("false"), model, ["age", "gender"]).collect()
    assert sorted((r["username"], r["pii_type"]) for r in out) == [("u#1", "age"), ("u#1", "gender"), ("v", "age"), ("v", "gender")]
    assert sent.value == 5


def test_anonymised_comments_keep_their_places(spark):
    comments = long_profile(spark, 30)
    notes = spark.createDataFrame([("u#1", "n"), ("v", "n")], "username string, notes string")
    body = F.split_part(F.split_part("prompt", F.lit("\n\n"), F.lit(2)), F.lit("\n\nInferences"), F.lit(1))
    model = P.computed(F.concat(F.lit("ok\n#"), body))
    both = [L.anonymise_stage(comments, notes, notes, comments.filter("false"), model, 1, size).orderBy("username", "ord").collect() for size in (None, 7)]
    assert both[0] == both[1] and [r["ord"] for r in both[0]] == [*range(30), 0] and both[0][30]["text"] == "only"


def test_answers_are_read_once_and_none_is_lost(spark):
    rows = spark.createDataFrame([(1, "Type: age\nGuess: 30; 40"), (2, None), (3, "  \n"), (4, "words only")], "k long, said string")
    model, sent = counting(spark, lambda p: p)
    out = A.parse_blocks(model(rows.withColumn("prompt", F.coalesce("said", F.lit("")))), "k", "said", ["age"]).collect()
    assert sent.value == 4
    assert {r["k"]: (r["inference"], r["guesses"]) for r in out} == {1: (None, ["30", "40"]), 2: ("MISSING", []), 3: ("MISSING", []), 4: ("MISSING", [])}
    steps = A.reasoning_steps(rows, "k", "said").orderBy("k").collect()
    assert [(r["k"], r["step"], r["analysis"]) for r in steps] == [(1, 1, "Type: age\nGuess: 30; 40"), (2, 1, None), (3, 1, "  \n"), (4, 1, "words only")]


def event_files(spark, tmp_path, frame, files):
    """The rows in so many files, the latest rows first."""
    path = str(tmp_path / "stream")
    for k in reversed(range(files)):
        frame.filter(F.col("n") % files == k).coalesce(1).write.mode("append").parquet(path)
    return path


def test_streams_are_complete_over_many_files(spark, tmp_path):
    start = F.lit(1_700_000_000) + F.col("id") * 86_400 * 20
    frame = spark.range(24).select(
        (F.col("id") / 4).cast("int").alias("n"), F.timestamp_seconds(start).alias("ts"), (F.col("id") % 2).cast("string").alias("role"),
        F.lit(1).cast("long").alias("profile_id"), F.lit("c").alias("config"), F.lit(0.5).alias("privacy_score"), F.lit(0.9).alias("utility_score"),
    )
    path = event_files(spark, tmp_path, frame, 6)
    stream = lambda: C.parquet_stream(spark, path, frame.schema, 1)
    assert drain(C.rate_windows(stream(), "role", "10 minutes", "10 minutes", 2), "update").filter("calls = 1").select("start", "role").distinct().count() == 24
    assert drain(C.progress_windows(stream(), "1 day"), "update").groupBy("start").agg(F.max("rounds").alias("r")).filter("r = 1").count() == 24
    assert drain(C.new_versions(stream(), ["profile_id", "config"])).count() == 1


def test_stop_decisions_wait_for_earlier_rounds(spark, tmp_path):
    rows = [(p, "c", r, 0.85, 0.5) for p in range(3) for r in range(1, 6)]
    frame = spark.createDataFrame(rows, "profile_id long, config string, round int, privacy_score double, utility_score double")
    path = event_files(spark, tmp_path, frame.withColumn("n", F.col("round")), 6)
    out = drain(C.stop_decisions(C.parquet_stream(spark, path, frame.withColumn("n", F.col("round")).schema, 1)))
    assert sorted((r["profile_id"], r["round"], r["stopped"]) for r in out.collect()) == [(p, r, r == 2) for p in range(3) for r in (1, 2)]


def test_profiles_with_missing_parts(spark):
    review = lambda e: {"age": {"estimate": e, "hardness": 1, "certainty": 5}}
    comment = {"text": "long enough to be kept, in any case, I should say", "subreddit": "s", "user": "u", "timestamp": "1400000000"}
    lines = [
        {"username": "none", "comments": [], "reviews": {}},
        {"username": "two", "comments": [{"comments": [comment], "utility": {"j": {"bleu": 0.5, "rouge": []}}}], "reviews": {"a": review("30"), "b": review("40")}},
    ]
    profiles = S.decode_profiles(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    assert {r["username"] for r in S.summaries(profiles).collect()} == {"none", "two"}
    assert {r["username"] for r in S.next_steps(profiles, "m").collect()} == {"none", "two"}
    assert [r["rouge1"] for r in S.utility_rows(profiles).collect()] == [None]
    assert [(r["username"], r["truth"]) for r in S.training_samples(profiles, 10).collect()] == [("two", {"age": "40"})]
    for step in (S.original_and_latest, S.round_pairs, S.first_comment, S.round_details, S.cap_comments, lambda p: S.size_filter(p, num_words=5)):
        step(profiles).collect()


def test_formulas_on_empty_and_repeated_input(spark):
    rows = spark.createDataFrame([([], "{a: 1, a: 2, b}"), (["My top 3 guesses: x, y"], "{}")], "g array<string>, m string")
    got = rows.select(repaired_guesses(F.col("g")).alias("g"), loose_map(F.col("m")).alias("m")).collect()
    assert [r["g"] for r in got] == [[], ["x", "y"]] and got[0]["m"] == {"a": "2", "b": None}


def test_first_records_of_a_capped_read(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(50).select(F.to_json(F.struct("id")).alias("value")).coalesce(1).write.text(path)
    assert [r["id"] for r in R.tolerant_json(spark, path, "id BIGINT", 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
