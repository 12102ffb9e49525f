"""Source and sink queries: files are written from the given tables, read back and decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.numbers import exact_mean
from veil.operators import evaluation as E
from veil.plans import evaluation as PE
from veil.plans.derived import DERIVED
from veil.plans.registry import query
from veil.session import scratch_path
from veil.sources import profiles as P
from veil.sources import results as S
from veil.sources import runs as R

# One row per turn with the profile it belongs to; the four record shapes alternate.
DERIVED["turns"] = """
SELECT conv_id, turn, role, text, concat('u', CAST(conv_id AS STRING)) AS username,
  1400000000 + conv_id * 1000 + (7 - turn) * 10 AS epoch, CAST(conv_id % 4 AS INT) AS shape FROM conversations"""
# The same turns in the three shapes that keep a comment as it is.
DERIVED["kept_turns"] = """
SELECT conv_id, turn, role, text, username, epoch, CAST(conv_id % 3 AS INT) AS shape FROM turns"""


def conversation_lines(turns):
    """Profiles as JSON lines: nested, flat, parallel arrays, synthetic."""
    comment = F.struct(
        F.col("text"), F.col("role").alias("subreddit"), F.lit("me").alias("user"), F.col("epoch").cast("string").alias("timestamp")
    )
    groups = turns.groupBy("username", "shape", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", comment.alias("c")))).alias("cs")
    )
    cs = F.transform("cs", lambda x: x["c"])
    nested_version = F.struct(cs.alias("comments"))
    reviews = F.create_map(
        F.lit("human"),
        F.create_map(F.lit("age"), F.struct(F.lit("30").alias("estimate"), F.lit(2).alias("hardness"), F.lit(4).alias("certainty"))),
    )
    feature = F.when(F.col("conv_id") % 8 == 3, "income").otherwise("city_country")
    line = (
        F.when(F.col("shape") == 0, F.to_json(F.struct("username", F.array(nested_version).alias("comments"), reviews.alias("reviews"))))
        .when(F.col("shape") == 1, F.to_json(F.struct("username", cs.alias("comments"), reviews.alias("reviews"))))
        .when(
            F.col("shape") == 2,
            F.to_json(
                F.struct(
                    F.col("username").alias("author"), F.transform(cs, lambda c: c["text"]).alias("comments"),
                    F.transform(cs, lambda c: c["subreddit"]).alias("subreddits"),
                    F.transform(cs, lambda c: c["timestamp"]).alias("timestamps"), reviews.alias("reviews"),
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.struct(F.lit(41).alias("age"), F.concat(F.lit("-"), F.col("username")).alias("sex"), F.lit("Paris, France").alias("city_country")).alias("personality"),
                    feature.alias("feature"), F.lit(3).alias("hardness"),
                    F.array_join(F.transform(cs, lambda c: c["text"]), "\n").alias("response"),
                )
            )
        )
    )
    return groups.select(line.alias("value"), F.col("shape"))


def _roundtrip(t, label="profiles"):
    """Written once per query; the folder is shared by all executors."""
    path = scratch_path(t.spark, label)
    conversation_lines(t.turns).select("value").write.text(path)
    return P.decode_profiles(t.spark.read.text(path))


# What the decoded comments must be: synthetic records lose the income feature and are split into lines.
DERIVED["decoded_comments"] = """
SELECT username, subreddit, epoch, text FROM (
 SELECT username, role AS subreddit, epoch, text FROM turns WHERE shape < 3
 UNION ALL SELECT concat('41-', username), 'synth', 1400463449, line FROM (
   SELECT username, unnest(string_split(text, chr(10))) AS line FROM turns WHERE shape = 3 AND conv_id % 8 <> 3) s WHERE line NOT IN ('', ' ')) d"""


@query("profile_comments", "S01 S02 S03 S04 W08 P06", """
SELECT username, subreddit, epoch, md5(text) AS digest FROM decoded_comments""")
def _(t):
    rows = P.comment_rows(_roundtrip(t))
    return rows.select("username", "subreddit", F.unix_timestamp("ts").alias("epoch"), F.md5("text").alias("digest"))


@query("profile_comment_order", "W08 S04", """
SELECT username, row_number() OVER (PARTITION BY username ORDER BY role, epoch) - 1 AS ord, md5(text) AS digest FROM turns""")
def _(t):
    rows = P.comment_rows(P.decode_profiles(conversation_lines(t.kept_turns).select("value")))
    return rows.select("username", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


@query("parallel_array_comments", "S02", "SELECT username, role AS subreddit, epoch, md5(text) AS digest FROM turns WHERE shape = 2")
def _(t):
    rows = P.comment_rows(P.decode_profiles(conversation_lines(t.turns).filter("shape = 2").select("value")))
    return rows.select("username", "subreddit", F.unix_timestamp("ts").alias("epoch"), F.md5("text").alias("digest"))


@query("synthetic_truth", "S03", """
SELECT DISTINCT concat('41-', username) AS username, 'synth' AS reviewer, 'location' AS pii_type, 'Paris, France' AS estimate, 3 AS hardness, 5 AS certainty
FROM turns WHERE shape = 3 AND conv_id % 8 <> 3""")
def _(t):
    return P.truth_rows(P.decode_profiles(conversation_lines(t.turns).filter("shape = 3").select("value"))).drop("level")


# ---- profiles with predictions, utility and several versions ------------------------------------


def annotated_lines(t):
    """One nested profile per user of the predictions table: at most 4 versions of 8 attributes each."""
    pred = F.struct(F.col("inference"), F.col("guess"), F.col("certainty"))
    models = (
        t.predictions.groupBy("username", "version", "model")
        .agg(F.map_from_entries(F.collect_list(F.struct("pii_type", pred))).alias("m"))
        .groupBy("username", "version")
        .agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("predictions"))
    )
    judge = F.struct(
        F.struct(F.col("readability").alias("score")).alias("readability"), F.struct(F.col("meaning").alias("score")).alias("meaning"),
        F.struct(F.col("hallucination").alias("score")).alias("hallucinations"), F.col("bleu"),
        F.array(F.struct(*[F.array(F.col("rouge1"), F.col("rouge1"), F.col("rouge1")).alias(n) for n in ("rouge1", "rougeL")])).alias("rouge"),
    )
    # two judges share the versions after the first
    name = F.when(F.col("meaning") >= 2, "judge").otherwise("judge-2")
    scores = t.utility.filter("version > 0").select("username", "version", F.create_map(name, judge).alias("utility"))
    text = F.concat(F.lit("words of "), F.col("username"), F.lit(" at version "), F.col("version").cast("string"), F.repeat(F.lit(" more"), F.col("version") * 5))
    version = F.struct("version", F.array(F.struct(text.alias("text"), F.lit("s").alias("subreddit"), F.col("username").alias("user"), F.lit("1400000000").alias("timestamp"))).alias("comments"), "predictions", "utility")
    versions = (
        models.join(scores, ["username", "version"], "left").withColumn("v", version)
        .groupBy("username").agg(F.array_sort(F.collect_list(F.struct("version", F.to_json("v").alias("j")))).alias("vs"))
    )
    review = F.struct("estimate", "hardness", "certainty", "level")
    reviews = (
        t.truth.groupBy("username").agg(F.map_from_entries(F.collect_list(F.struct("pii_type", review))).alias("r"))
        .select("username", F.to_json(F.create_map(F.lit("human"), F.col("r"))).alias("reviews"))
    )
    body = F.array_join(F.transform("vs", lambda x: x["j"]), ",")
    return versions.join(reviews, "username").select(
        "username", F.size("vs").alias("n"),
        F.concat(F.lit('{"username":"'), F.col("username"), F.lit('","comments":['), body, F.lit('],"reviews":'), F.col("reviews"), F.lit("}")).alias("value"),
    )


def annotated(t):
    return P.decode_profiles(annotated_lines(t).select("value"))


# DuckDB side: the text and size of each profile.
DERIVED["profile_versions"] = """
SELECT username, version, concat('words of ', username, ' at version ', CAST(version AS STRING), repeat(' more', version * 5)) AS text
FROM (SELECT DISTINCT username, version FROM predictions) p"""
DERIVED["profile_sizes"] = "SELECT username, count(*) AS n, max(version) AS last FROM profile_versions GROUP BY username"


@query("profile_predictions", "S04 A13 P22", """
SELECT username, version, model, pii_type, array_to_string(list_transform(string_split(guess, ';'), lambda g: trim(g)), '|') AS guesses, coalesce(certainty, '3') AS certainty
FROM predictions""")
def _(t):
    return P.prediction_rows(annotated(t)).select(
        "username", "version", "model", "pii_type", F.array_join("guesses", "|").alias("guesses"), "certainty"
    )


@query("profile_truth", "S04 P02", "SELECT username, reviewer, pii_type, estimate, hardness, certainty, level FROM truth")
def _(t):
    return P.truth_rows(annotated(t))


@query("profile_utility", "P21", """
SELECT username, version, CASE WHEN meaning >= 2 THEN 'judge' ELSE 'judge-2' END AS judge, readability, meaning, hallucination, bleu, rouge1 FROM utility WHERE version > 0""")
def _(t):
    return P.utility_rows(annotated(t)).drop("rougeL")


@query("profile_size_filter", "P01", """
SELECT username FROM profile_versions WHERE version = 0 AND len(string_split(text, ' ')) BETWEEN 6 AND 12""")
def _(t):
    return P.size_filter(annotated(t), num_comments=25, num_words=12, min_tokens=5).select("username")


@query("next_steps", "P04", """
SELECT s.username, concat(CASE WHEN bool_or(p.model = 'judge-a') THEN 'anonymize' ELSE 'inference' END,
  CASE WHEN any_value(n) > 1 AND max(u.meaning) IS NULL THEN ',utility' ELSE '' END) AS steps
FROM profile_sizes s JOIN predictions p ON p.username = s.username AND p.version = s.last
LEFT JOIN (SELECT * FROM utility WHERE version > 0 AND meaning >= 2) u ON u.username = s.username AND u.version = s.last GROUP BY s.username""")
def _(t):
    steps = P.next_steps(P.keep_model(annotated(t), "judge-a"), "judge-a")
    judged = annotated(t).select(
        "username",
        F.when((F.size("versions") > 1) & ~F.coalesce(F.map_contains_key(F.element_at("versions", -1)["utility"], "judge"), F.lit(False)), ",utility").otherwise("").alias("u"),
    )
    return steps.join(judged, "username").select("username", F.concat(F.col("steps")[0], F.col("u")).alias("steps"))


@query("unfinished_profiles", "P05", "SELECT username, CAST(n AS INT) AS versions FROM profile_sizes WHERE n <= 4")
def _(t):
    return P.unfinished(annotated(t), 4).select("username", F.size("versions").alias("versions"))


@query("original_and_latest_text", "P06", """
SELECT s.username, a.text AS original, b.text AS latest FROM profile_sizes s JOIN profile_versions a ON a.username = s.username AND a.version = 0
JOIN profile_versions b ON b.username = s.username AND b.version = s.last""")
def _(t):
    pair = P.original_and_latest(annotated(t))
    return pair.select("username", P.full_text(F.col("original")).alias("original"), P.full_text(F.col("latest")).alias("latest"))


@query("capped_comments", "P07", """
SELECT username, count(*) AS comments FROM (SELECT username, row_number() OVER (PARTITION BY username ORDER BY role, epoch) AS rn FROM turns) x
WHERE rn <= 3 GROUP BY username""")
def _(t):
    capped = P.cap_comments(P.decode_profiles(conversation_lines(t.kept_turns).select("value")), 3)
    return capped.select("username", F.size(F.col("versions")[0]["comments"]).cast("long").alias("comments"))


@query("canonical_attributes", "P08", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'income' WHEN '2-HIGH' THEN 'gender' WHEN '3-MEDIUM' THEN 'location' WHEN '5-LOW' THEN 'married' END AS pii_type
FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""")
def _(t):
    raw = {"1-URGENT": "income_level", "2-HIGH": "sex", "3-MEDIUM": "city_country", "5-LOW": "relationship_status"}
    name = F.lit("shoe_size")
    for k, v in raw.items():
        name = F.when(F.col("o_orderpriority") == k, v).otherwise(name)
    return P.canonical_attributes(t.orders.select("o_orderkey", name.alias("attribute"))).select("o_orderkey", "pii_type")


@query("single_model_predictions", "P09", "SELECT username, version, pii_type FROM predictions WHERE model = 'judge-b'")
def _(t):
    return P.prediction_rows(P.keep_model(annotated(t), "judge-b")).select("username", "version", "pii_type")


DERIVED["summary_rows"] = """
SELECT s.username, CAST(n AS INT) AS versions, t.types AS pii_types, n > 1 AS has_anonymization, u.username IS NOT NULL AS has_quality FROM profile_sizes s
JOIN (SELECT username, string_agg(pii_type, ',' ORDER BY pii_type) AS types FROM truth GROUP BY username) t USING (username)
LEFT JOIN (SELECT DISTINCT username FROM utility WHERE version > 0) u USING (username)"""


@query("profile_summaries", "P23", "SELECT * FROM summary_rows")
def _(t):
    return P.summaries(annotated(t))


@query("profile_summary_page", "P23", "SELECT * FROM summary_rows WHERE has_anonymization AND has_quality ORDER BY username LIMIT 50 OFFSET 10")
def _(t):
    return P.page(P.summaries(annotated(t), True, True), "username", 10, 50)


@query("round_details", "P24 J17", """
SELECT username, CAST(row_number() OVER w - 1 AS INT) AS round, lag(text) OVER w AS original, text AS anonymized
FROM profile_versions WHERE version = 0 OR length(trim(text)) >= 50 WINDOW w AS (PARTITION BY username ORDER BY version) QUALIFY row_number() OVER w > 1""")
def _(t):
    return P.round_details(annotated(t))


@query("last_round", "P25", """
WITH d AS (SELECT username, row_number() OVER w - 1 AS round, lag(text) OVER w AS original, text AS anonymized
 FROM profile_versions WHERE version = 0 OR length(trim(text)) >= 50 WINDOW w AS (PARTITION BY username ORDER BY version) QUALIFY row_number() OVER w > 1)
SELECT username, CAST(max(round) AS INT) AS round, arg_max(original, round) AS original, arg_max(anonymized, round) AS anonymized FROM d GROUP BY username""")
def _(t):
    return P.pick_round(P.round_details(annotated(t)), -1)


@query("training_samples", "S16", """
SELECT username, length(text) AS chars, (SELECT string_agg(concat(pii_type, '=', estimate), ';' ORDER BY pii_type) FROM truth t WHERE t.username = v.username) AS truth
FROM profile_versions v WHERE version = 0 AND length(text) >= 25""")
def _(t):
    rows = P.training_samples(annotated(t), 25)
    pairs = F.transform(F.array_sort(F.map_entries("truth")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("username", F.length("text").cast("long").alias("chars"), F.array_join(pairs, ";").alias("truth"))


@query("round_pairs", "S17", """
SELECT v.username, v.version AS round, o.text AS original, v.text AS anonymized FROM profile_versions v JOIN profile_versions o
ON o.username = v.username AND o.version = 0 WHERE v.version > 0""")
def _(t):
    return P.round_pairs(annotated(t))


@query("first_comments", "S19", "SELECT username, text FROM profile_versions WHERE version = 0 AND length(text) >= 26")
def _(t):
    return P.first_comment(annotated(t), 26)


@query("merged_comment_annotations", "U02", """
SELECT sha1(concat(text, role, username, CAST(epoch AS VARCHAR))) AS id, count(*) AS n, max(CASE WHEN role = 'user' THEN 'b=2;c=4' ELSE 'a=1;b=2;c=4' END) AS pii
FROM turns GROUP BY id""")
def _(t):
    key = P.comment_identity(F.col("text"), F.col("role"), F.col("username"), F.col("epoch"))
    left = F.when(F.col("role") == "user", F.create_map(F.lit("b"), F.lit("9"))).otherwise(
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("9"))
    )
    right = F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("4"))
    merged = F.transform(
        F.array_sort(F.map_entries(P.merge_annotations(left, right))), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return t.turns.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join(merged, ";")).alias("pii"))


# ---- files ------------------------------------------------------------------------------------


@query("eval_csv_roundtrip", "K02 S05 U01", f"""
WITH e AS ({PE._EVAL}) SELECT anon_level, pii_type, 2 * count(*) AS rows, 2 * CAST(sum(gt_hardness) AS BIGINT) AS hardness, max(is_correct) AS top FROM e GROUP BY ALL""")
def _(t):
    table = E.eval_table(PE.scored(t), t.utility.filter("version > 0"), t.truth, "run-1")
    paths = [scratch_path(t.spark, "eval-csv") for _ in range(2)]
    S.write_eval_csv(table, paths[0])
    S.write_eval_csv(S.read_eval_csv(t.spark, paths[0]), paths[1])
    return S.read_eval_csv(t.spark, paths).groupBy("anon_level", "pii_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("gt_hardness").alias("hardness"), F.max("is_correct").alias("top")
    )


@query("json_array_or_lines", "S07", "SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_returnflag")
def _(t):
    root = scratch_path(t.spark, "json-any")
    rows = t.lineitem.select("l_returnflag", "l_partkey")
    rows.filter("l_linestatus = 'F'").write.json(f"{root}/lines")
    # documents of bounded size, one array per file
    docs = t.lineitem.filter("l_linestatus = 'O'").groupBy(F.floor(F.col("l_orderkey") / 20000)).agg(
        F.to_json(F.collect_list(F.struct("l_returnflag", "l_partkey"))).alias("value")
    )
    docs.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/arrays")
    back = S.read_json_any(t.spark, root, "l_returnflag STRING, l_partkey BIGINT")
    return back.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("keys"))


@query("discovered_results", "S08", "SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS username, CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'b' END AS origin FROM customer")
def _(t):
    root = scratch_path(t.spark, "tree")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    base = t.customer.select(name.alias("username"), "c_nationkey")
    line = lambda o: F.to_json(F.struct("username", F.lit(o).alias("origin"))).alias("value")
    base.filter("c_nationkey < 12").select(line("a")).write.text(f"{root}/a/deep")
    base.select(line("b")).write.text(f"{root}/b")
    rows = S.discover(t.spark, root, "*.txt")
    return rows.select("username", F.get_json_object("value", "$.origin").alias("origin"))


def checkpoint_docs(t):
    """Checkpoint documents of at most 50 runs each."""
    rows = t.rounds.groupBy("profile_id", "config").agg(
        F.max_by("privacy_score", "round").alias("final_privacy"), F.max_by("utility_score", "round").alias("final_utility"),
        F.count(F.lit(1)).cast("int").alias("total_rounds"),
        F.array_sort(F.collect_list(F.struct("round", "privacy_score", "utility_score"))).alias("rounds"),
    )
    sample = F.struct(
        F.concat(F.lit("p"), F.col("profile_id").cast("string")).alias("username"), F.col("config").alias("config_name"),
        "final_privacy", "final_utility", "total_rounds", "rounds",
    )
    shard = F.floor(F.col("profile_id") / 50)
    docs = rows.groupBy(shard.alias("shard")).agg(F.collect_list(sample).alias("samples"))
    results = F.struct(F.lit("all").alias("config"), F.col("samples"))
    return docs.select(
        F.to_json(F.struct(F.lit("2024-01-01").alias("timestamp"), F.lit(1.5).alias("elapsed_time"), results.alias("results"))).alias("value"),
        "shard",
    )


@query("checkpoint_samples", "S09 K03 K07", """
SELECT concat('p', CAST(profile_id AS VARCHAR)) AS username, any_value(config) AS config_name, arg_max(privacy_score, round) AS final_privacy, CAST(count(*) AS INT) AS total_rounds
FROM rounds GROUP BY profile_id""")
def _(t):
    path = scratch_path(t.spark, "checkpoints")
    checkpoint_docs(t).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return S.read_checkpoint(t.spark, path).select("username", "config_name", "final_privacy", "total_rounds")


@query("most_advanced_stage", "S12 K01", """
SELECT username, CASE WHEN u IS NOT NULL THEN concat('utility_', CAST(last AS VARCHAR)) WHEN last = 0 THEN 'anonymized_0' ELSE concat('inference_', CAST(last AS VARCHAR)) END AS stage
FROM profile_sizes s LEFT JOIN (SELECT username AS u, version FROM utility WHERE version > 0 AND meaning >= 2) x ON x.u = s.username AND x.version = s.last""")
def _(t):
    path = scratch_path(t.spark, "stages")
    lines = annotated_lines(t).select("username", "value", "n")
    now = P.decode_profiles(lines.select("value"))
    judged = F.coalesce(F.map_contains_key(F.element_at("versions", -1)["utility"], "judge"), F.lit(False))
    stage = now.select("username", P.stage_name(F.col("versions"), judged).alias("stage"))
    P.write_stage(lines.withColumn("stage", F.lit("anonymized_0")), path)
    P.write_stage(lines.join(stage, "username"), path)
    return P.most_advanced(t.spark.read.text(path)).select("username", "stage")


def three_runs(t):
    """Runs of different length; a letter in texts and answers tells where they come from."""
    place = F.regexp_extract("username", "([0-9]+)$", 1).cast("long")
    whole = annotated(t).select(place.alias("position"), "username", "versions", "reviews")

    def run(letter, length, model=None):
        def own(v):
            kept = F.map_filter(v["predictions"], lambda k, _: F.lit(True) if model is None else k == model)
            marked = F.transform_values(kept, lambda _, m: F.transform_values(m, lambda k, x: F.lit(letter)))
            comments = F.transform(v["comments"], lambda c: c.withField("text", F.lit(letter)))
            return F.struct(comments.alias("comments"), marked.alias("predictions"), v["utility"].alias("utility"))

        return whole.withColumn("versions", F.transform(F.slice("versions", 1, length), own))

    a, b, c = run("A", 1, "judge-a"), run("B", 3, "judge-b"), run("C", 100)
    odd = F.when(F.col("position") % 17 == 3, F.concat("username", F.lit("x"))).otherwise(F.col("username"))
    return [a, b.filter("position % 13 <> 5"), c.withColumn("username", odd)]


@query("merged_run_files", "J04", """
WITH v AS (SELECT username, CAST(substr(username, 2) AS BIGINT) AS position, version, model,
  dense_rank() OVER (PARTITION BY username ORDER BY version) - 1 AS idx FROM (SELECT DISTINCT username, version, model FROM predictions) p
  WHERE username IN (SELECT username FROM truth))
SELECT position, username, idx AS version, model, CASE WHEN idx = 0 THEN 'A' WHEN idx < 3 AND position % 13 <> 5 THEN 'B' ELSE 'C' END AS text_of,
  CASE WHEN idx = 0 AND model = 'judge-a' THEN 'A' WHEN idx < 3 AND position % 13 <> 5 AND model = 'judge-b' THEN 'B' ELSE 'C' END AS answers_of
FROM v WHERE position % 17 <> 3""")
def _(t):
    merged = R.merge_runs_by_position(three_runs(t)).select("position", "username", F.posexplode("versions").alias("version", "v"))
    answers = merged.select("position", "username", "version", F.col("v.comments")[0]["text"].alias("text_of"), F.explode("v.predictions").alias("model", "m"))
    return answers.select("position", "username", F.col("version").cast("long").alias("version"), "model", "text_of", F.map_values("m")[0].alias("answers_of"))


@query("run_merge_exceptions", "J04", """
WITH u AS (SELECT DISTINCT username, CAST(substr(username, 2) AS BIGINT) AS position FROM predictions WHERE username IN (SELECT username FROM truth))
SELECT position, CASE WHEN position % 17 = 3 THEN 'different users' ELSE 'missing' END AS problem,
  CASE WHEN position % 17 = 3 THEN concat(username, ',', username, 'x') ELSE username END AS usernames,
  CASE WHEN position % 13 = 5 THEN 2 ELSE 3 END AS runs FROM u WHERE position % 17 = 3 OR position % 13 = 5""")
def _(t):
    return R.merge_exceptions(three_runs(t)).select("position", "problem", F.array_join("usernames", ",").alias("usernames"), F.col("runs").cast("int").alias("runs"))


def unfinished_run(t):
    """Stage files as an interrupted run leaves them, read back: (stage, value), and the lines it began with."""
    source = annotated_lines(t).select("username", "value").withColumn("p", F.regexp_extract("username", "([0-9]+)$", 1).cast("long"))
    path, start = scratch_path(t.spark, "stage-files"), scratch_path(t.spark, "source")
    source.select("value").write.text(start)
    stages = {
        "inference_0": F.col("p") % 5 != 0, "anonymized_1": F.col("p") % 3 == 0, "inference_1": F.col("p") % 3 == 0,
        "utility_1": F.col("p") % 6 == 0, "notes_7": F.col("p") % 4 == 0,
    }
    for stage, chosen in stages.items():
        half = (F.lit(stage) == "utility_1") & (F.col("p") % 7 == 1)
        value = F.when(half, F.expr("substring(value, 1, length(value) - 9)")).otherwise(F.col("value"))
        P.write_stage(source.filter(chosen).select(F.lit(stage).alias("stage"), value.alias("value")), path)
    # a line that was written twice, and a profile that the source lacks
    again = source.filter("p % 60 = 6").select(F.lit("utility_1").alias("stage"), "value")
    other = t.spark.range(1).select(F.lit("utility_9").alias("stage"), F.lit('{"username": "nobody", "comments": []}').alias("value"))
    P.write_stage(again.unionByName(other), path)
    return t.spark.read.text(path), t.spark.read.text(start)


DERIVED["run_states"] = """
SELECT username, CASE WHEN p % 6 = 0 AND (p % 7 <> 1 OR p % 60 = 6) THEN 'utility_1' WHEN p % 3 = 0 THEN 'anonymized_1' WHEN p % 5 <> 0 THEN 'inference_0' END AS stage,
  p % 6 = 0 AND p % 7 = 1 AS half, p % 60 = 6 AND p % 7 <> 1 AS twice
FROM (SELECT DISTINCT username, CAST(substr(username, 2) AS BIGINT) AS p FROM predictions WHERE username IN (SELECT username FROM truth)) u"""


@query("resumed_profiles", "S12", "SELECT username, stage FROM run_states")
def _(t):
    return R.resume(*unfinished_run(t)).select("username", "stage")


@query("resume_gate", "S12", """
SELECT count(*) AS target, count(*) AS profiles, count(*) FILTER (stage IN ('utility_1', 'anonymized_1')) AS finished,
  count(*) FILTER (stage IS NULL OR stage = 'inference_0') AS unfinished, count(*) FILTER (half) AS broken, count(*) FILTER (twice) AS repeats,
  CAST(1 AS BIGINT) AS strangers, bool_and(stage IN ('utility_1', 'anonymized_1')) AS complete FROM run_states""")
def _(t):
    written, source = unfinished_run(t)
    return R.resume_report(R.resume(written, source), written, source, "anonymized", 1)


@query("latest_checkpoint", "S18", "SELECT CAST(max(c_nationkey) AS INT) AS n FROM customer")
def _(t):
    files = t.customer.select(F.concat(F.lit("out/checkpoint_"), F.col("c_nationkey").cast("string"), F.lit(".json")).alias("file"))
    return S.latest_checkpoint(files).select("n")


@query("tolerant_lines", "S14", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    path = scratch_path(t.spark, "tolerant")
    good = F.to_json(F.struct("o_orderkey", "o_custkey"))
    t.orders.select(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("{broken "), good)).otherwise(good).alias("value")).write.text(path)
    return S.tolerant_json(t.spark, path, "o_orderkey BIGINT, o_custkey BIGINT").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys")
    )


# ---- logs -------------------------------------------------------------------------------------

DERIVED["log_events"] = """
SELECT event_id, user_id, CAST(floor(value * 10) AS BIGINT) % 11 AS p, CAST(floor(value * 7) AS BIGINT) % 11 AS u, event_type FROM events"""


def log_lines(t):
    """Three lines per event: header, scores, attack JSON; block and position give their order."""
    e = t.log_events
    parts = F.array(
        F.concat(F.lit("评估用户: user_"), F.col("user_id").cast("string"), F.lit(" (第1轮)")),
        F.concat(
            F.lit("  隐私: "), (F.col("p") / 10).cast("string"), F.lit(", 效用: "), (F.col("u") / 10).cast("string"),
            F.lit(", 成功: "), F.when(F.col("event_type") == "error", "False").otherwise("True"),
        ),
        F.concat(
            F.lit('  攻击者推理: {"age": {"guess": ["'), F.col("user_id").cast("string"), F.lit('"], "certainty": '),
            (F.col("u") % 5 + 1).cast("string"), F.lit("}} done"),
        ),
    )
    return e.select("event_id", F.posexplode(parts).alias("k", "value")).select(
        "value", F.lit("run.log").alias("file"), F.floor(F.col("event_id") / 1000).alias("block"),
        (F.col("event_id") * 3 + F.col("k")).alias("seq"),
    )


@query("log_scores", "S10 K03", """
SELECT event_id * 3 + 1 AS seq, p / 10 AS privacy, u / 10 AS utility, event_type <> 'error' AS success FROM log_events WHERE u > 0""")
def _(t):
    return S.score_lines(log_lines(t)).select("seq", "privacy", "utility", "success")


@query("log_records", "S11", """
SELECT row_number() OVER (ORDER BY event_id) AS record, concat('user_', CAST(user_id AS VARCHAR)) AS username, p / 10 AS privacy, u / 10 AS utility,
  CAST(user_id AS VARCHAR) AS guess, CAST(u % 5 + 1 AS INT) AS certainty FROM log_events""")
def _(t):
    age = F.col("attack")["age"]
    return S.log_records(log_lines(t)).select(
        "record", "username", "privacy", "utility", age["guess"][0].alias("guess"), age["certainty"].alias("certainty")
    )


def spread_log_lines(t):
    """Log lines as they are found in files: JSON over several lines, broken texts, notes with braces of their own."""
    e = t.log_events
    guess = F.concat(F.lit('"guess": ["'), F.col("user_id").cast("string"), F.lit('"]'))
    certainty = F.concat(F.lit('"certainty": '), (F.col("u") % 5 + 1).cast("string"))
    whole = F.concat(F.lit('  攻击者推理: {"age": {'), guess, F.lit(", "), certainty, F.lit("}} done {"))
    cut = F.array(F.lit('  攻击者推理: {"age": {'), F.concat(F.lit("    "), guess, F.lit(",")), F.concat(F.lit("    "), certainty))
    closed = F.concat(cut, F.array(F.lit("  }"), F.lit("} and so on }")))
    body = (
        F.when(F.col("event_type") == "error", cut)
        .when(F.col("event_type") == "view", F.concat(F.array(whole), cut))
        .when(F.col("u") % 2 == 0, closed)
        .otherwise(F.array(whole))
    )
    score = F.concat(F.lit("  隐私: "), (F.col("p") / 10).cast("string"), F.lit(", 效用: "), (F.col("u") / 10).cast("string"))
    header = F.concat(F.lit("评估用户: user_"), F.col("user_id").cast("string"), F.lit(" (第1轮)"))
    parts = F.concat(F.array(header, F.lit("note } {")), body, F.array(score))
    return e.select("event_id", F.expr("event_id div 4000").alias("part"), F.posexplode(parts).alias("k", "value"))


@query("log_file_records", "S11", """
SELECT event_id // 4000 AS part, row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) AS record,
  concat('user_', CAST(user_id AS VARCHAR)) AS username, p / 10 AS privacy, u / 10 AS utility,
  CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS guess, CASE WHEN event_type <> 'error' THEN CAST(u % 5 + 1 AS INT) END AS certainty
FROM log_events""")
def _(t):
    path = scratch_path(t.spark, "logs")
    lines = spread_log_lines(t).repartition("part").sortWithinPartitions("part", "event_id", "k")
    lines.select("part", "value").write.partitionBy("part").text(path)
    age = F.col("attack")["age"]
    return S.log_records(S.read_log(t.spark, path)).select(
        F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "record", "username", "privacy", "utility",
        age["guess"][0].alias("guess"), age["certainty"].alias("certainty"),
    )


@query("recent_log_statistics", "G40", """
WITH r AS (SELECT p / 10 AS p, u / 10 AS u FROM log_events WHERE u > 0 ORDER BY event_id DESC LIMIT 10)
SELECT count(*) AS lines, exact_mean(p) AS avg_privacy, exact_mean(u) AS avg_utility, round(avg(CASE WHEN p >= 0.8 THEN 1 ELSE 0 END) * 100, 6) AS privacy_success_rate,
  round(avg(CASE WHEN u >= 0.6 THEN 1 ELSE 0 END) * 100, 6) AS utility_success_rate FROM r""")
def _(t):
    return S.recent_statistics(S.score_lines(log_lines(t)), "seq")


@query("log_file_scores", "S10", """
SELECT count(*) AS lines, exact_mean(p / 10) AS privacy, count(*) FILTER (WHERE event_type <> 'error') AS successes FROM log_events WHERE u > 0""")
def _(t):
    path = scratch_path(t.spark, "log")
    log_lines(t).select("value").write.text(path)
    return S.score_lines(S.read_log(t.spark, path)).agg(
        F.count(F.lit(1)).alias("lines"), exact_mean("privacy").alias("privacy"), F.count_if("success").alias("successes")
    )


@query("named_file_set", "S06 S05 K02", """
SELECT pii_type, count(*) AS rows FROM judged_vectors GROUP BY pii_type""")
def _(t):
    root = scratch_path(t.spark, "file-set")
    table = E.eval_table(PE.scored(t), t.utility, t.truth, "run-1")
    paths = S.file_set({"full": "judge-a", "base": "judge-b"}, root)
    for level, path in enumerate(paths):
        S.write_eval_csv(table.filter(F.col("anon_level") % len(paths) == level), path)
    return S.read_eval_csv(t.spark, paths).groupBy("pii_type").agg(F.count(F.lit(1)).alias("rows"))


@query("mapping_documents", "S13 K08", "SELECT pii_type, raw, canonical FROM mapping")
def _(t):
    path = scratch_path(t.spark, "mapping")
    # a closed vocabulary: as many entries as distinct spellings
    docs = t.mapping.groupBy("pii_type").agg(F.map_from_entries(F.collect_list(F.struct("raw", "canonical"))).alias("m"))
    docs.select(F.to_json(F.create_map("pii_type", "m")).alias("value")).write.text(path)
    t.spark.range(1).select(F.lit("{corrupt").alias("value")).write.mode("append").text(path)
    return S.read_mapping(t.spark, path)


@query("statistics_document", "K03 G15", """
SELECT count(*) AS lines, exact_mean(p / 10) AS privacy_mean, round(stddev_pop(p / 10), 6) AS privacy_std FROM log_events WHERE u > 0""")
def _(t):
    path = scratch_path(t.spark, "statistics")
    scores = S.score_lines(log_lines(t))
    S.write_statistics(
        scores.agg(
            F.count(F.lit(1)).alias("lines"), exact_mean("privacy").alias("privacy_mean"),
            F.round(F.stddev_pop("privacy"), 6).alias("privacy_std"),
        ),
        path,
    )
    return t.spark.read.schema("lines BIGINT, privacy_mean DOUBLE, privacy_std DOUBLE").json(path)
