"""Profiles: JSON lines in three record shapes -> one declared row per profile, and long tables from it.

Map keys carry attribute, model and judge names, so schemas are declared, never inferred. Parts with
union types stay JSON text until the shape of the record is known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.answers import keep_last
from veil.operators.ordering import lookup

RAW = (
    "username STRING, author STRING, comments STRING, subreddits ARRAY<STRING>, timestamps ARRAY<STRING>, "
    "reviews MAP<STRING, MAP<STRING, STRUCT<estimate: STRING, hardness: INT, certainty: INT, level: INT>>>, "
    "personality MAP<STRING, STRING>, feature STRING, response STRING, hardness INT"
)
COMMENT_JSON = "STRUCT<text: STRING, subreddit: STRING, user: STRING, username: STRING, timestamp: STRING>"
VERSION_JSON = (
    f"STRUCT<comments: ARRAY<{COMMENT_JSON}>, predictions: MAP<STRING, MAP<STRING, STRING>>, utility: MAP<STRING, STRING>>"
)
COMMENT = "STRUCT<text: STRING, subreddit: STRING, user: STRING, epoch: DOUBLE>"
VERSION = f"STRUCT<comments: ARRAY<{COMMENT}>, predictions: MAP<STRING, MAP<STRING, STRING>>, utility: MAP<STRING, STRING>>"
JUDGE = (
    "STRUCT<readability: STRUCT<explanation: STRING, score: DOUBLE>, meaning: STRUCT<explanation: STRING, score: DOUBLE>, "
    "hallucinations: STRUCT<explanation: STRING, score: DOUBLE>, bleu: DOUBLE, "
    "rouge: ARRAY<STRUCT<rouge1: ARRAY<DOUBLE>, rougeL: ARRAY<DOUBLE>, rougeLsum: ARRAY<DOUBLE>>>>"
)
PREDICTION = "STRUCT<inference: STRING, guess: STRING, certainty: STRING>"

# Attribute names of the synthetic records, and of raw corpora in general.
SYNTHETIC_FEATURES = {
    "income_level": "income", "age": "age", "sex": "gender", "city_country": "location",
    "birth_city_country": "pobp", "education": "education", "occupation": "occupation",
    "relationship_status": "married",
}
CORPUS_ATTRIBUTES = {
    "income_level": "income", "age": "age", "sex": "gender", "city_country": "location",
    "birth_city_country": "pobp", "education_category": "education", "occupation": "occupation",
    "relationship_status": "married", "gender": "gender", "location": "location", "pobp": "pobp",
    "education": "education", "married": "married", "income": "income",
}
SYNTHETIC_EPOCH = 1400463449.0


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of `.jsonl` files with the file each came from; other extensions are refused."""
    paths = [path] if isinstance(path, str) else list(path)
    wrong = [p for p in paths if "." in p.rsplit("/", 1)[-1] and not p.endswith(".jsonl")]
    if wrong:
        raise ValueError(f"not a .jsonl source: {wrong}")
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def record_shape() -> Column:
    return (
        F.when(F.col("r.personality").isNotNull(), "synthetic")
        .when(F.col("r.subreddits").isNotNull() & F.col("r.timestamps").isNotNull(), "parallel")
        .when(F.get_json_object("r.comments", "$[0].comments").isNotNull(), "nested")
        .otherwise("flat")
    )


def _sorted(comments: Column) -> Column:
    """By (subreddit, time), equal keys in file order."""
    keyed = F.transform(
        comments, lambda c, i: F.struct(c["subreddit"].alias("s"), c["epoch"].alias("e"), i.alias("i"), c.alias("c"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def _comment(c: Column, owner: Column) -> Column:
    return F.struct(
        c["text"].alias("text"),
        F.coalesce(c["subreddit"], F.lit("synthetic")).alias("subreddit"),
        F.coalesce(c["user"], c["username"], owner).alias("user"),
        c["timestamp"].try_cast("double").alias("epoch"),
    )


def parallel_comments(texts: Column, subreddits: Column, timestamps: Column, owner: Column) -> Column:
    """Three parallel arrays -> comments; cut to the shortest array."""
    short = F.least(F.size(texts), F.size(subreddits), F.size(timestamps))
    return F.transform(
        F.slice(F.arrays_zip(texts.alias("t"), subreddits.alias("s"), timestamps.alias("e")), F.lit(1), short),
        lambda z: F.struct(
            z["t"].alias("text"), z["s"].alias("subreddit"), owner.alias("user"), z["e"].try_cast("double").alias("epoch")
        ),
    )


def synthetic_comments(response: Column, owner: Column) -> Column:
    lines = F.filter(F.split(response, "\n"), lambda x: (x != "") & (x != " "))
    return F.transform(
        lines,
        lambda x: F.struct(
            x.alias("text"), F.lit("synth").alias("subreddit"), owner.alias("user"), F.lit(SYNTHETIC_EPOCH).alias("epoch")
        ),
    )


def decode_profiles(lines: DataFrame, value: str = "value") -> DataFrame:
    """(username, versions, reviews, shape) per line, one pass whatever the mix of shapes."""
    keep = [c for c in lines.columns if c != value]
    raw = lines.withColumn("r", F.from_json(value, RAW)).withColumn("shape", record_shape())
    synth = F.col("shape") == "synthetic"
    name = F.when(
        synth, F.concat(F.col("r.personality")["age"], F.col("r.personality")["sex"])
    ).otherwise(F.coalesce("r.author", "r.username"))
    raw = raw.filter(~(synth & (F.col("r.feature") == "income"))).withColumn("username", name)
    owner = F.col("username")

    nested = F.transform(
        F.from_json("r.comments", f"ARRAY<{VERSION_JSON}>"),
        lambda v: F.struct(
            _sorted(F.transform(v["comments"], lambda c: _comment(c, owner))).alias("comments"),
            v["predictions"].alias("predictions"),
            v["utility"].alias("utility"),
        ),
    )
    single = (
        F.when(synth, synthetic_comments(F.col("r.response"), owner))
        .when(
            F.col("shape") == "parallel",
            parallel_comments(
                F.from_json("r.comments", "ARRAY<STRING>"), F.col("r.subreddits"), F.col("r.timestamps"), owner
            ),
        )
        .otherwise(F.transform(F.from_json("r.comments", f"ARRAY<{COMMENT_JSON}>"), lambda c: _comment(c, owner)))
    )
    wrapped = F.array(
        F.struct(
            _sorted(single.cast(f"ARRAY<{COMMENT}>")).alias("comments"),
            F.lit(None).cast("MAP<STRING, MAP<STRING, STRING>>").alias("predictions"),
            F.lit(None).cast("MAP<STRING, STRING>").alias("utility"),
        )
    )
    feature = lookup(SYNTHETIC_FEATURES, F.col("r.feature"))
    synthetic_review = F.create_map(
        F.lit("synth"),
        F.map_from_arrays(
            F.array(F.coalesce(feature, F.lit("unknown"))),
            F.array(
                F.struct(
                    F.try_element_at(F.col("r.personality"), F.col("r.feature")).alias("estimate"),
                    F.col("r.hardness").alias("hardness"),
                    F.lit(5).alias("certainty"),
                    F.lit(None).cast("int").alias("level"),
                )
            ),
        ),
    )
    return raw.filter(owner.isNotNull()).select(
        *keep,
        "username",
        F.when(F.col("shape") == "nested", nested.cast(f"ARRAY<{VERSION}>")).otherwise(wrapped).alias("versions"),
        F.when(synth, synthetic_review).otherwise(F.col("r.reviews")).alias("reviews"),
        "shape",
    )


def read_profiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_profiles(read_lines(spark, path))


def comment_rows(profiles: DataFrame) -> DataFrame:
    """(username, version, ord, text, subreddit, user, ts)."""
    return (
        profiles.select("username", F.posexplode("versions").alias("version", "v"))
        .select("username", "version", F.posexplode("v.comments").alias("ord", "c"))
        .select(
            "username", "version", "ord", "c.text", "c.subreddit", "c.user",
            F.timestamp_seconds(F.col("c.epoch").cast("bigint")).alias("ts"),
        )
    )


def truth_rows(profiles: DataFrame) -> DataFrame:
    """(username, reviewer, pii_type, estimate, hardness, certainty, level)."""
    return (
        profiles.select("username", F.explode("reviews").alias("reviewer", "r"))
        .select("username", "reviewer", F.explode("r").alias("pii_type", "t"))
        .select("username", "reviewer", "pii_type", "t.*")
    )


def prediction_rows(profiles: DataFrame) -> DataFrame:
    """(username, version, model, pii_type, inference, guesses, certainty); the full answer is not an attribute."""
    return (
        profiles.select("username", F.posexplode("versions").alias("version", "v"))
        .select("username", "version", F.explode("v.predictions").alias("model", "p"))
        .select("username", "version", "model", F.explode("p").alias("pii_type", "j"))
        .filter("pii_type <> 'full_answer'")
        .withColumn("j", F.from_json("j", PREDICTION))
        .select(
            "username", "version", "model", "pii_type", "j.inference",
            guess_array(F.col("j.guess")).alias("guesses"), F.coalesce("j.certainty", F.lit("3")).alias("certainty"),
        )
        .filter(F.col("inference").isNotNull() & F.col("guesses").isNotNull())
    )


def guess_array(raw: Column) -> Column:
    """Guesses given as a JSON array or as ';'-separated text."""
    listed = F.from_json(raw, "ARRAY<STRING>")
    split = F.transform(F.split(raw, ";"), lambda g: F.trim(g))
    return F.when(raw.startswith("["), listed).otherwise(split)


def utility_rows(profiles: DataFrame) -> DataFrame:
    """Flat judge scores; a score that a judge left out is -1."""
    score = lambda part: F.when(F.col(f"u.{part}").isNotNull(), F.coalesce(F.col(f"u.{part}.score"), F.lit(-1.0)))
    rouge = lambda name: F.get(F.get(F.col("u.rouge"), F.lit(0))[name], F.lit(2)).alias(name)
    return (
        profiles.select("username", F.posexplode("versions").alias("version", "v"))
        .select("username", "version", F.explode("v.utility").alias("judge", "j"))
        .withColumn("u", F.from_json("j", JUDGE))
        .select(
            "username", "version", "judge",
            score("readability").alias("readability"), score("meaning").alias("meaning"),
            score("hallucinations").alias("hallucination"), F.col("u.bleu").alias("bleu"),
            rouge("rouge1"), rouge("rougeL"),
        )
    )


# ---- predicates and projections on decoded profiles --------------------------------------------


def size_filter(
    profiles: DataFrame,
    num_comments: int | None = None,
    num_words: int | None = None,
    max_tokens: int | None = None,
    min_tokens: int | None = None,
) -> DataFrame:
    """Keep profiles within the limits of their original comments; words stand in for tokens."""
    original = F.get("versions", F.lit(0))["comments"]
    words = F.aggregate(original, F.lit(0), lambda a, c: a + F.size(F.split(c["text"], " ")))
    out = profiles
    if num_comments is not None:
        out = out.filter(F.size(original) <= num_comments)
    for limit in (num_words, max_tokens):
        if limit is not None:
            out = out.filter(words <= limit)
    if min_tokens is not None:
        out = out.filter(words > min_tokens)
    return out


def next_steps(profiles: DataFrame, model: str) -> DataFrame:
    """Steps due for the latest version of each profile."""
    last = F.try_element_at("versions", F.lit(-1))
    has = lambda m: F.coalesce(F.map_contains_key(m, model), F.lit(False))
    first = F.when(has(last["predictions"]), "anonymize").otherwise("inference")
    judge = ~has(last["utility"]) & (F.size("versions") > 1)
    steps = F.when(judge, F.array(first, F.lit("utility"))).otherwise(F.array(first))
    return profiles.select("username", steps.alias("steps"))


def unfinished(profiles: DataFrame, max_versions: int) -> DataFrame:
    return profiles.filter(F.size("versions") <= max_versions)


def original_and_latest(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "username", F.get("versions", F.lit(0))["comments"].alias("original"),
        F.try_element_at("versions", F.lit(-1))["comments"].alias("latest"),
    )


def cap_comments(profiles: DataFrame, n: int = 25) -> DataFrame:
    """First n comments of every version, for the corpus whose prompts are bounded that way."""
    return profiles.withColumn(
        "versions", F.transform("versions", lambda v: v.withField("comments", F.slice(v["comments"], 1, n)))
    )


def canonical_attributes(pairs: DataFrame, attribute: str = "attribute") -> DataFrame:
    """Raw corpus attribute names -> the eight canonical ones; others drop out."""
    return pairs.withColumn("pii_type", lookup(CORPUS_ATTRIBUTES, F.col(attribute))).filter("pii_type IS NOT NULL")


def keep_model(profiles: DataFrame, model: str) -> DataFrame:
    """Predictions of one model only."""
    return profiles.withColumn(
        "versions",
        F.transform(
            "versions", lambda v: v.withField("predictions", F.map_filter(v["predictions"], lambda k, _: k == model))
        ),
    )


def summaries(profiles: DataFrame, with_anonymisation: bool = False, with_quality: bool = False) -> DataFrame:
    """Overview rows of the profile list."""
    out = profiles.select(
        "username",
        F.size("versions").alias("versions"),
        F.coalesce(F.array_join(F.array_sort(F.map_keys(F.try_element_at(F.map_values("reviews"), F.lit(1)))), ","), F.lit("")).alias("pii_types"),
        (F.size("versions") > 1).alias("has_anonymization"),
        F.exists("versions", lambda v: F.coalesce(F.size(F.map_keys(v["utility"])) > 0, F.lit(False))).alias("has_quality"),
    )
    if with_anonymisation:
        out = out.filter("has_anonymization")
    return out.filter("has_quality") if with_quality else out


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """One page of a list in key order; Spark keeps only offset + limit rows per task."""
    return df.orderBy(key).offset(offset).limit(limit)


def full_text(comments: Column) -> Column:
    return F.array_join(F.transform(comments, lambda c: c["text"]), "\n")


def round_details(profiles: DataFrame, min_chars: int = 50) -> DataFrame:
    """Anonymisation rounds with enough text, each beside the text it started from."""
    texts = F.transform("versions", lambda v: full_text(v["comments"]))
    later = F.filter(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), lambda s: F.length(F.trim(s)) >= min_chars)
    return (
        profiles.select("username", F.concat(F.slice(texts, 1, 1), later).alias("t"))
        .select("username", "t", F.posexplode("t").alias("round", "anonymized"))
        .filter("round > 0")
        .select("username", "round", F.col("t")[F.col("round") - 1].alias("original"), "anonymized")
    )


def pick_round(details: DataFrame, index: int) -> DataFrame:
    """Round `index` of each profile; -1 is the last one."""
    if index >= 0:
        return details.filter(F.col("round") == index)
    rest = [c for c in details.columns if c != "username"]
    return details.groupBy("username").agg(F.max_by(F.struct(*rest), "round").alias("r")).select("username", "r.*")


def training_samples(profiles: DataFrame, min_chars: int = 50, limit: int | None = None) -> DataFrame:
    """Original text and true attributes of profiles with enough of both."""
    # of several reviewers the last one counts
    truth = keep_last(
        F.flatten(
            F.transform(
                F.map_values("reviews"),
                lambda m: F.transform(
                    F.filter(F.map_entries(m), lambda e: e["value"]["estimate"].isNotNull()),
                    lambda e: F.struct(e["key"].alias("key"), e["value"]["estimate"].alias("value")),
                ),
            )
        )
    )
    out = (
        profiles.withColumn("text", full_text(F.get("versions", F.lit(0))["comments"]))
        .withColumn("truth", truth)
        .filter((F.length("text") >= min_chars) & (F.size("truth") > 0))
        .select("username", "text", "truth")
    )
    return out.orderBy("username").limit(limit) if limit else out


def round_pairs(profiles: DataFrame) -> DataFrame:
    """Version 0 text beside each later version's text, both non-empty."""
    texts = profiles.select(
        "username", full_text(F.get("versions", F.lit(0))["comments"]).alias("original"),
        F.posexplode(F.transform("versions", lambda v: full_text(v["comments"]))).alias("round", "anonymized"),
    )
    return texts.filter((F.col("round") > 0) & (F.length("original") > 0) & (F.length("anonymized") > 0))


def first_comment(profiles: DataFrame, min_chars: int = 20) -> DataFrame:
    text = F.try_element_at(F.get("versions", F.lit(0))["comments"], F.lit(1))["text"]
    return profiles.select("username", text.alias("text")).filter(F.length("text") >= min_chars)


def comment_identity(text: Column, subreddit: Column, user: Column, epoch: Column) -> Column:
    """SHA-1 over what makes a comment the same comment."""
    return F.sha1(F.concat(text, subreddit, user, epoch.cast("string")))


def merge_annotations(left: Column, right: Column) -> Column:
    """Union of two maps; on equal keys the right one wins."""
    kept = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(kept, right))


# ---- writers ----------------------------------------------------------------------------------


def stage_name(versions: Column, has_utility: Column) -> Column:
    """Stage file a profile belongs to, by how far it has come."""
    n = (F.size(versions) - 1).cast("string")
    return F.when(has_utility, F.concat(F.lit("utility_"), n)).otherwise(F.concat(F.lit("inference_"), n))


def write_stage(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Append JSON lines partitioned by their `stage` column."""
    lines.select("stage", "value").write.mode(mode).partitionBy("stage").text(path)


def most_advanced(lines: DataFrame, stages: Sequence[str] = ("inference", "anonymized", "utility")) -> DataFrame:
    """Per profile the line of the furthest stage: version number first, then stage order."""
    from veil.operators.ordering import latest

    pattern = f"({'|'.join(stages)})_([0-9]+)"
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.regexp_extract("stage", pattern, 1))
    placed = lines.withColumn("n", F.regexp_extract("stage", pattern, 2).try_cast("int")).withColumn("o", order)
    named = placed.withColumn("username", F.get_json_object("value", "$.username")).filter("username IS NOT NULL")
    return latest(named, ["username"], [F.coalesce("n", F.lit(-1)), F.col("o")])
