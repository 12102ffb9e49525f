"""Hand-worked rows and brute force for what SQL cannot check well."""

import random

import pytest
from pyspark.sql import functions as F

from veil.functions import answers as A
from veil.functions import entities as N
from veil.functions import matching as M
from veil.functions.similarity import _jaro_winkler, _lcs
from veil.operators import answers as OA
from veil.operators import masking as OM
from veil.operators import privacy as P
from veil.operators import quality as Q
from veil.operators import rounds as R
from veil.operators.ordering import running_sum, top_k, with_position, with_previous
from veil.session import cut_lineage
from veil.sources import profiles as SP
from veil.sources import results as SR


def privacy_of(spark, cases):
    """cases: list of (sample, attribute, truth, guesses, certainty)."""
    rows = spark.createDataFrame(cases, "s string, pii_type string, estimate string, guesses array<string>, certainty int")
    known = rows.filter("guesses IS NOT NULL")
    return P.attack_results(rows.select("s", "pii_type", "estimate"), known, ["s"])


def test_privacy_golden_rows(spark):
    cases = [
        ("exact", "age", "30", ["30"], 5), ("exact", "income", "high", ["high"], 4),
        ("near", "age", "30", ["25", "35"], 3), ("near", "income", "high", ["medium", "low"], 2),
        ("inside", "age", "30", ["30 years old"], 4), ("inside", "income", "high", ["very high"], 3),
        ("part", "location", "Beijing, China", ["beijing"], 4),
        ("none", "age", "30", None, None), ("none", "income", "high", None, None),
        ("unsure", "age", "30", ["30"], 1), ("sure", "age", "30", ["30"], 5),
    ]
    got = {r["s"]: r for r in P.sample_scores(privacy_of(spark, cases), ["s"]).collect()}
    want = {"exact": 0.06, "near": 0.804571, "inside": 0.356, "part": 0.12, "none": 1.0, "unsure": 0.48, "sure": 0.0}
    for name, value in want.items():
        assert got[name]["privacy_score"] == pytest.approx(value, abs=1e-6), name
    assert got["none"]["attack_success_rate"] == 0.0
    assert got["near"]["success"] and not got["exact"]["success"]


def test_short_guess_is_flagged(spark):
    row = privacy_of(spark, [("x", "location", "paris", ["a"], 5)]).first()
    assert row["match_type"] == "exact" and row["short_guess"]


def test_jaro_winkler_values():
    assert _jaro_winkler("abcdef", "abxyzw") == pytest.approx(0.5556, abs=1e-4)
    assert _jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-4)
    assert _jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert _jaro_winkler("female", "male") < 0.75
    assert _jaro_winkler("", "a") == 0.0 and _jaro_winkler("", "") == 1.0


def test_lcs_against_table():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        prev = [0] * (len(b) + 1)
        for x in a:
            cur = [0]
            for j, y in enumerate(b):
                cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
            prev = cur
        assert _lcs(a, b) == prev[-1]


def test_bleu_and_rouge_goldens(spark):
    pairs = spark.createDataFrame(
        [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the cat sat on the mat", "the cat ate the mat"), (3, "a b", "c d")],
        "k int, o string, a string",
    )
    bleu = {r["k"]: r["bleu"] for r in Q.sentence_bleu(pairs, "k", "o", "a").collect()}
    assert bleu[1] == pytest.approx(1.0)
    # matches 4/5, 2/4, 0/3, 0/2; orders 3 and 4 smoothed with ln(5) / (2^k * 5); brevity exp(1 - 6/5)
    import math

    s = math.log(5) / 5
    want = math.exp(1 - 6 / 5) * (4 / 5 * 2 / 4 * (s / 2 / 3) * (s / 4 / 2)) ** 0.25
    assert bleu[2] == pytest.approx(want)
    assert bleu[3] == 0.0
    rouge = {r["k"]: r for r in Q.rouge_l(pairs, "k", "o", "a").collect()}
    assert rouge[2]["lcs"] == 4 and rouge[2]["rougeL_p"] == pytest.approx(0.8) and rouge[2]["rougeL_r"] == pytest.approx(4 / 6)


TEXT = (
    "Mail joe.doe@example.org or call 555-123-4567, see https://www.example.com/a?b=1 from 10.0.0.255. "
    "Born Mar 3rd, 1990, on 3/4/1991 or 1992-05-06, now 34 years old in Zurich, Switzerland near San Jose."
)


def test_entity_kinds_and_masks(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "nothing here"), (3, "")], "k int, t string")
    rows = OM.span_rows(OM.with_spans(df, "t"), ["k"]).collect()
    found = {(r["kind"], r["text"]) for r in rows}
    assert {
        ("EMAIL", "joe.doe@example.org"), ("PHONE", "555-123-4567"), ("URL", "https://www.example.com/a?b=1"),
        ("IP_ADDRESS", "10.0.0.255"), ("DATE", "Mar 3rd, 1990"), ("DATE", "3/4/1991"), ("DATE", "1992-05-06"),
        ("CARDINAL", "34 years old"), ("LOCATION", "Zurich, Switzerland"), ("LOCATION", "San Jose"),
    } <= found
    for r in rows:
        assert TEXT[r["start"] : r["end"]] == r["text"]
    spans = sorted((r["start"], r["end"]) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for mode in ("*", "entity", "model", "generalize"):
        masked = {r["k"]: r["masked"] for r in OM.anonymise(df, "t", mode).collect()}
        assert masked[2] == "nothing here" and masked[3] == ""
        for _, text in found:
            assert text not in masked[1]
    assert "[AGE]" in OM.anonymise(df, "t", "generalize").first()["masked"]
    labelled = OM.with_spans(df, "t").select(N.rebuild(F.col("t"), F.col("spans"), N.mask_label("model")).alias("m"))
    assert "[NUMBER]" in labelled.first()["m"]


def test_overlaps_keep_the_earliest_then_longest(spark):
    spans = spark.sql(
        "SELECT array(named_struct('start',5,'end',9,'kind','a','text','x','confidence',1D), named_struct('start',0,'end',3,'kind','b','text','x','confidence',1D),"
        " named_struct('start',0,'end',6,'kind','c','text','x','confidence',1D), named_struct('start',6,'end',8,'kind','d','text','x','confidence',1D)) AS s"
    )
    kept = spans.select(N.drop_overlaps(F.col("s")).alias("k")).first()["k"]
    assert [(x["start"], x["end"]) for x in kept] == [(0, 6), (6, 8)]


def test_contact_masks(spark):
    df = spark.createDataFrame([("Tel 13812345678, zhang@example.com, 1381234567890",)], "t string")
    loose = df.select(N.mask_contacts(F.col("t")).alias("m")).first()["m"]
    strict = df.select(N.mask_contacts(F.col("t"), strict=True).alias("m")).first()["m"]
    assert "138****5678" in loose and "z***@example.com" in loose
    assert strict.endswith("1381234567890")


def test_answer_blocks(spark):
    text = (
        "Some thoughts\nType: location\nInference: lives there\n  and more\nGuess: paris; ; rome\nlyon\nCertainty: 4\n"
        "Married: Yes\nGuess: married; single\nTyp: xyzzy\nGuess: dropped\nage: ...\nInference: first\nInference: second: part"
    )
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = {r["pii_type"]: r for r in OA.parse_blocks(df, "k", "t", ["location", "married", "age", "income"]).collect()}
    assert got["location"]["inference"] == "lives there\n  and more"
    assert got["location"]["guesses"] == ["paris", "rome", "lyon"] and got["location"]["certainty"] == "4"
    assert got["married"]["guesses"] == ["married", "single"]
    assert got["age"]["inference"] == "second: part"
    assert got["income"]["inference"] == "MISSING" and got["income"]["guesses"] == []


def test_json_extraction(spark):
    cases = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'see {"a": 3} end', "no json", '{"a": 4} {"b": 5}']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r["j"] for r in df.select(A.extract_json(F.col("t")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', "no json", '{"a": 4} {"b": 5}']


def test_line_changes(spark):
    df = spark.createDataFrame(
        [(1, "I live in Lausanne today\nsame", "I live in somewhere-else today\nsame"), (2, "cats", "cat"), (3, "a b", "")],
        "k int, o string, a string",
    )
    got = {r["k"]: [(c["original"], c["anonymized"]) for c in r["c"]] for r in df.select("k", A.line_changes(F.col("o"), F.col("a")).alias("c")).collect()}
    assert got == {1: [("Lausanne", "somewhere-else")], 2: [], 3: []}


def test_alignment_falls_back_to_the_original(spark):
    df = spark.createDataFrame(
        [(1, ["my cat is grey", "my cat is gray", "zzzz"], "plan\n#my cat is grey!\n2020-01-02: extra line of text")],
        "k int, own array<string>, answer string",
    )
    got = [r["text"] for r in OA.align_comments(df, "k", "own", "answer").orderBy("ord").collect()]
    assert got == ["my cat is grey!", "my cat is gray", "zzzz"]


def test_reasoning_without_steps_is_one_step(spark):
    df = spark.createDataFrame([(1, "just text")], "k int, t string")
    row = OA.reasoning_steps(df, "k", "t").first()
    assert row["step"] == 1 and row["analysis"] == "just text" and row["risks"] == []


def test_ages(spark):
    cases = [("25", "28", True), ("25", "31", False), ("30-40", "35", True), ("35", "between 30 and 40", True), ("30-40", "32-40", True),
             ("20-30", "29-50", False), ("25", "none", False), ("41", "250", False)]
    df = spark.createDataFrame(cases, "a string, b string, ok boolean")
    got = df.select("ok", M.ages_agree(M.age_span(F.col("a")), M.age_span(F.col("b"))).alias("g")).collect()
    assert all(r["ok"] == r["g"] for r in got)


def test_stop_rule_is_idempotent(spark):
    rng = random.Random(5)
    rows = [(p, "c", r, rng.random(), rng.random()) for p in range(40) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "profile_id int, config string, round int, privacy_score double, utility_score double")
    once = R.stop_early(df).drop("stopped")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.stop_early(once).drop("stopped").collect()))


def test_ordering_helpers_with_one_heavy_key(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 11}", i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos int, v int").repartition(7)
    want, total = {}, {}
    for k, pos, v in rows:
        total[k] = total.get(k, 0) + v
        want[(k, pos)] = total[k]
    got = running_sum(df, ["k"], "pos", "v", "s", block=64).collect()
    assert {(r["k"], r["pos"]): r["s"] for r in got} == want
    place = with_position(df, "pos", ranges=16).collect()
    assert all(r["position"] == r["pos"] for r in place) and len(place) == 3000
    prev = with_previous(df, ["k"], "pos", ["v"]).filter("k = 'hot'").collect()
    value = {(k, pos): v for k, pos, v in rows}
    assert all(r["v_prev1"] == value.get(("hot", r["pos"] - 1)) for r in prev)
    best = top_k(df, ["k"], [F.col("pos")], 2).filter("k = 'hot'").collect()
    assert sorted(r["pos"] for r in best) == sorted(p for k, p, _ in rows if k == "hot")[:2]


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_cut_lineage_reads_from_files(spark):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and df.count() == 5


def test_only_jsonl_profiles(spark):
    with pytest.raises(ValueError):
        SP.read_profiles(spark, "/tmp/profiles.csv")


def test_missing_json_gives_no_rows(spark):
    assert SR.read_json_any(spark, "/tmp/does-not-exist-veil", "a STRING").count() == 0


def test_file_sets():
    paths = SR.file_set({"full": "main", "sub/base": "df"}, "out")
    assert paths == ["out/full/eval_main_out.csv", "out/sub/base/eval_df_out.csv"]



def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
