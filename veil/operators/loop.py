"""Stages around the model call and the multi-round defend / attack / judge loop.

A model may be a paid service, so every prompt is sent once: answers that feed more than one later step are written
to the shared folder before the plan branches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.answers import after_hash, attack_map, judge_scores
from veil.functions.quality import trainer_utility
from veil.operators import prompts as P
from veil.operators.answers import align_comments, parse_blocks
from veil.operators.evaluation import without_done
from veil.operators.privacy import attack_results, sample_scores
from veil.operators.quality import text_scores
from veil.session import cut_lineage


def infer_stage(blocks: DataFrame, attributes: DataFrame, done: DataFrame, model: P.Model, names: Sequence[str]) -> DataFrame:
    """(username, pii_type, ...) inferences for profiles not done yet: prompt, call, parse.

    The answers to the parts of one profile are read as one text, in order: a later part sets a field anew.
    """
    answered = model(P.inference_prompts(without_done(blocks, done, ["username"]), attributes))
    whole = answered.groupBy("username").agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("_a"))
    joined = whole.select("username", F.array_join(F.transform("_a", lambda a: a["answer"]), "\n").alias("answer"))
    return parse_blocks(joined, "username", "answer", names)


def anonymise_stage(
    comments: DataFrame, notes: DataFrame, attributes: DataFrame, done: DataFrame, model: P.Model, level: int = 3,
    per_prompt: int | None = None,
) -> DataFrame:
    """(username, ord, text): adapted comments of profiles not done yet, by their place in (subreddit, time) order."""
    todo = without_done(comments, done, ["username"])
    prompts = P.anonymise_prompts(P.comment_blocks(todo, per_prompt), notes, attributes, level)
    originals = P.comment_parts(todo, per_prompt).select("username", "part", F.transform("xs", lambda x: x["text"]).alias("own"))
    answered = model(prompts).join(originals, ["username", "part"])
    aligned = align_comments(answered.withColumn("_key", F.struct("username", "part")), "_key", "own", "answer")
    first = F.col("_key.part") * (per_prompt or 0)
    return aligned.select("_key.username", (first + F.col("ord")).cast("int").alias("ord"), "text")


def infer_versions_stage(
    comments: DataFrame, attributes: DataFrame, done: DataFrame, model: P.Model, names: Sequence[str], skip_first: bool = False
) -> DataFrame:
    """(username, version, pii_type, ...) inferences of a second model for every version it has not judged yet.

    comments has a version column; done(username, version) is what the model has answered. `skip_first` leaves out
    version 0, which another model has judged.
    """
    todo = without_done(comments, done, ["username", "version"])
    todo = todo.filter("version > 0") if skip_first else todo
    key = F.struct("username", "version")
    blocks = P.comment_blocks(todo.withColumn("username", key).drop("version"))
    wanted = todo.select("username", "version").distinct().join(attributes, "username").select(key.alias("username"), "pii_type")
    out = infer_stage(blocks, wanted, done.select(key.alias("username")), model, names)
    rest = [c for c in out.columns if c != "username"]
    return out.select("username.username", "username.version", *rest)


def utility_stage(pairs: DataFrame, done: DataFrame, model: P.Model, key: str = "prompt_id") -> DataFrame:
    """Judge scores beside sentence BLEU, ROUGE-1, ROUGE-L and ROUGE-Lsum of every pair (original, adapted) not judged yet.

    `key` is unique; for profiles it stands for (username, version) with one row for every version after the first.
    """
    todo = without_done(pairs, done, [key]).withColumn("prompt", P.judge_prompt(F.col("original"), F.col("adapted")))
    judged = model(todo).withColumn("s", judge_scores(F.col("answer")))
    scores = text_scores(todo, key, "original", "adapted")
    names = ["bleu", "rouge1", "rougeL", "rougeLsum"]
    return (
        judged.select(key, "s.readability", "s.meaning", F.col("s.hallucinations").alias("hallucination"))
        .join(scores, key, "left")
        .select(key, "readability", "meaning", "hallucination", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    )


def stops_at_target(number: int, privacy: Column, utility: Column, target: float = 0.8, least: float = 0.6, floor: float = 0.3) -> Column:
    """Good enough in both, or a ruined text."""
    return ((privacy >= target) & (utility >= least)) | (utility < floor)


def stops_early(number: int, privacy: Column, utility: Column) -> Column:
    """From the second round on: strong privacy with utility, up to three steady rounds, or a ruined text."""
    if number < 2:
        return F.lit(False)
    steady = F.least(privacy, F.col("before1"), F.col("before2")) >= 0.8  # rounds not yet played are null and skipped
    return ((privacy >= 0.9) & (utility >= 0.7)) | steady | (utility < 0.3)


STOP_RULES = {"target": stops_at_target, "early": stops_early}


def run_rounds(
    samples: DataFrame,
    truth: DataFrame,
    defender: P.Model,
    attacker: P.Model,
    judge: P.Model,
    max_rounds: int = 5,
    stop: str = "target",
) -> DataFrame:
    """One row per (username, round): anonymised text, scores, the feedback the defender got, and whether the run stopped.

    samples(username, text), truth(username, pii_type, estimate). A sample without truth has nothing to leak: privacy
    1, no successful attack. Each round is a handful of joins over the samples still active; what the models
    answer and the result are written to the shared folder, so a lost executor resumes from there.
    """
    nothing = F.lit(None).cast("double")
    state = samples.select(
        "username", F.col("text").alias("original"), F.col("text").alias("current"), F.lit("").alias("feedback"),
        nothing.alias("before1"), nothing.alias("before2"),
    )
    done: list[DataFrame] = []
    for number in range(1, max_rounds + 1):
        asked = state.withColumn("round", F.lit(number)).withColumn(
            "prompt", P.render("{feedback}\n\n{text}", feedback=F.col("feedback"), text=F.col("current"))
        )
        defended = cut_lineage(defender(asked).withColumn("anonymized", after_hash(F.col("answer"))).drop("answer", "prompt"), "defended")
        attacked = attacker(defended.withColumn("prompt", F.col("anonymized"))).select("username", attack_map(F.col("answer")).alias("m"))
        guesses = cut_lineage(
            attacked.select("username", F.explode("m").alias("pii_type", "g")).select(
                "username", "pii_type",
                F.when(F.col("g.guess").startswith("["), F.from_json("g.guess", "ARRAY<STRING>")).otherwise(F.array("g.guess")).alias("guesses"),
                F.coalesce("g.certainty", F.lit(3)).alias("certainty"),
            ),
            "attacked",
        )
        results = attack_results(truth.join(state.select("username"), "username", "left_semi"), guesses, ["username"])
        privacy = sample_scores(results, ["username"]).select("username", "privacy_score", "attack_success_rate")
        named = F.concat_ws(": ", "pii_type", F.coalesce(F.get("guesses", F.lit(0)), F.lit("")))
        said = guesses.groupBy("username").agg(F.array_join(F.array_sort(F.collect_list(named)), ", ").alias("guess"))
        scored = judge(defended.withColumn("prompt", P.judge_prompt(F.col("original"), F.col("anonymized")))).withColumn(
            "s", judge_scores(F.col("answer"))
        )
        utility = scored.select(
            "username", "original", "anonymized", "feedback", "before1", "before2",
            trainer_utility(F.col("s.readability"), F.col("s.meaning"), F.col("s.hallucinations")).alias("utility_score"),
        )
        p, u = F.col("privacy_score"), F.col("utility_score")
        outcome = cut_lineage(
            utility.join(privacy, "username", "left").join(said, "username", "left")
            .withColumn("privacy_score", F.coalesce("privacy_score", F.lit(1.0)))
            .withColumn("attack_success_rate", F.coalesce("attack_success_rate", F.lit(0.0)))
            .withColumn("guess", F.coalesce("guess", F.lit("")))
            .withColumn("round", F.lit(number)).withColumn("stopped", STOP_RULES[stop](number, p, u)),
            f"round-{number}",
        )
        done.append(outcome)
        note = P.improvement_feedback(F.col("guess"), F.col("attack_success_rate") > 0, p, u)
        state = outcome.filter(~F.col("stopped")).select(
            "username", "original", F.col("anonymized").alias("current"), note.alias("feedback"),
            p.alias("before1"), F.col("before1").alias("before2"),
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("username", "round", "anonymized", "feedback", "guess", "privacy_score", "attack_success_rate", "utility_score", "stopped")


def run_versions(
    comments: DataFrame, attributes: DataFrame, inferer: P.Model, anonymiser: P.Model, judge: P.Model, names: Sequence[str],
    rounds: int, level: int = 3,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plain loop: infer, anonymise and score, until every profile has `rounds` versions beyond its original.

    Returns the comments (username, version, ord, text), the inferences and the utility scores (version > 0) of all versions.
    Each step's answers are written before the plan branches, so each prompt is sent once.
    """
    nobody = comments.select("username").filter("false")
    kept = comments.select("username", "ord", "subreddit", "epoch")
    place = F.row_number().over(Window.partitionBy("username").orderBy("subreddit", "epoch", "ord")) - 1
    places = cut_lineage(kept.withColumn("place", place.cast("int")), "places")
    versions = [cut_lineage(comments.select("username", "ord", "subreddit", "epoch", "text"), "version-0")]
    whole = lambda df: df.groupBy("username").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("subreddit", "epoch", "ord", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    inferences: list[DataFrame] = []
    scores: list[DataFrame] = []
    for number in range(rounds):
        now = versions[-1]
        found = cut_lineage(infer_stage(P.comment_blocks(now), attributes, nobody, inferer, names), f"inferred-{number}")
        inferences.append(found.withColumn("version", F.lit(number)))
        guesses = found.withColumn("guess", F.nullif(F.array_join("guesses", "; "), F.lit(""))).filter("inference <> 'MISSING'")
        adapted = anonymise_stage(now, P.inference_notes(guesses), attributes, nobody, anonymiser, level)
        # a profile without inferences has no prompt and keeps its comments
        new = places.join(adapted.select("username", F.col("ord").alias("place"), F.col("text").alias("_new")), ["username", "place"], "left")
        new = new.join(now.select("username", "ord", "text"), ["username", "ord"]).select(
            "username", "ord", "subreddit", "epoch", F.coalesce("_new", "text").alias("text")
        )
        versions.append(cut_lineage(new, f"version-{number + 1}"))
        pairs = whole(versions[0]).withColumnRenamed("text", "original").join(whole(versions[-1]).withColumnRenamed("text", "adapted"), "username")
        judged = cut_lineage(utility_stage(pairs, nobody, judge, "username"), f"judged-{number + 1}")
        scores.append(judged.withColumn("version", F.lit(number + 1)))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    return union([v.select("username", F.lit(n).alias("version"), "ord", "text") for n, v in enumerate(versions)]), union(inferences), union(scores)
