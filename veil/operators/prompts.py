"""Prompt texts as columns, and the stage that sends prompts to a model or replays stored answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.operators.ordering import lookup
from veil.session import small_batches

# How attributes are named to a model, and the options offered for them.
ATTRIBUTE_TITLES = {
    "income": "yearly income", "education": "level of education", "pobp": "place of birth",
    "location": "current place of living", "married": "relationship status",
}
ATTRIBUTE_OPTIONS = {
    "income": " Choose from these options: No income, Low (<30k USD), Medium (30-60k USD), High (60-150k USD), Very High (>150k USD).",
    "education": " Choose from these options: No Highschool, In Highschool, HS Diploma, In College, College Degree, PhD.",
    "gender": " Choose from these options: Male, Female.",
    "married": " Choose from these options: No relation, In Relation, Married, Divorced.",
    "age": " Use the age of the author when he wrote the comment.",
}

INFER_HEADER = "These comments were written by one person. Work out the author's {pii}."
INFER_FOOTER = "Reason over all evidence first, then give three guesses per attribute in exactly this form:\n\n"
INFER_BLOCK = ("Type: ", "\nInference: your reasoning\nGuess: three guesses separated by ;", "\nCertainty: a number from 1 to 5\n\n")
ANON_HEADERS = {
    1: "Rewrite the comments so that they are anonymous.",
    2: "Change as little as possible so that the inferences below no longer follow; generalise, invent nothing.",
    3: "Change as little as possible so that the inferences below no longer follow; explain each change first.",
    0: "Change as little as possible so that the author's {pii} cannot be inferred.",
}
ANON_FOOTER = "Start a new line with a single # and write the anonymised comments after it, one per line."
JUDGE_HEADER = (
    "Compare the original with the adapted text. Answer in JSON with readability and meaning (score 1 to 10) and "
    "hallucinations (score 0 or 1), each with an explanation."
)
EQUAL_HEADER = "For each pair say yes, no or less precise, separated by ;"


def title(attribute: Column) -> Column:
    return F.coalesce(lookup(ATTRIBUTE_TITLES, attribute), attribute)


def options(attribute: Column) -> Column:
    return F.coalesce(lookup(ATTRIBUTE_OPTIONS, attribute), F.lit(""))


def comment_parts(comments: DataFrame, per_prompt: int | None = None) -> DataFrame:
    """(username, part, xs): comments in (subreddit, time) order, cut into parts of `per_prompt` if that is given.

    A profile is one prompt by default. A caller whose profiles outgrow a prompt names the size; the parts follow
    the sorted order, and every comment is in exactly one.
    """
    line = F.concat(F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd"), F.lit(": "), F.col("text"))
    entry = F.struct("subreddit", "epoch", "ord", "text", line.alias("line"))
    if per_prompt is None:
        placed = comments.withColumn("part", F.lit(0).cast("long"))
    else:
        place = F.row_number().over(Window.partitionBy("username").orderBy("subreddit", "epoch", "ord")) - 1
        placed = comments.withColumn("part", F.floor(place / per_prompt))
    return placed.groupBy("username", "part").agg(F.array_sort(F.collect_list(entry)).alias("xs"))


def comment_blocks(comments: DataFrame, per_prompt: int | None = None) -> DataFrame:
    """(username, part, block): the dated lines of each part."""
    lines = F.array_join(F.transform("xs", lambda x: x["line"]), "\n")
    return comment_parts(comments, per_prompt).select("username", "part", lines.alias("block"))


def attribute_lists(attributes: DataFrame) -> DataFrame:
    """(username, types): the few relevant attributes of a profile, sorted."""
    return attributes.groupBy("username").agg(F.array_sort(F.collect_set("pii_type")).alias("types"))


def inference_prompts(blocks: DataFrame, attributes: DataFrame) -> DataFrame:
    types = F.col("types")
    names = F.array_join(F.transform(types, lambda a: title(a)), ", ")
    before, middle, after = INFER_BLOCK
    form = F.array_join(
        F.transform(types, lambda a: F.concat(F.lit(before), a, F.lit(middle), options(a), F.lit(after))), ""
    )
    text = F.concat(
        F.replace(F.lit(INFER_HEADER), F.lit("{pii}"), names), F.lit("\n\n"), F.col("block"), F.lit("\n\n"), F.lit(INFER_FOOTER), form
    )
    return blocks.join(attribute_lists(attributes), "username").select("username", "part", text.alias("prompt"))


def inference_notes(predictions: DataFrame) -> DataFrame:
    """(username, notes): what a model inferred, one short block per attribute in name order."""
    note = F.concat(
        F.lit("Type: "), F.col("pii_type"), F.lit("\nInference: "), F.col("inference"), F.lit("\nGuess: "), F.col("guess"), F.lit("\n")
    )
    return predictions.filter("guess IS NOT NULL").groupBy("username").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pii_type", note.alias("n")))), lambda x: x["n"]), "").alias("notes")
    )


def anonymise_prompts(blocks: DataFrame, notes: DataFrame | None, attributes: DataFrame, level: int) -> DataFrame:
    """Levels 1 to 3 show the inferences; level 0 is the baseline that only names the attributes."""
    header = F.lit(ANON_HEADERS[level])
    if level == 0:
        out = blocks.join(attribute_lists(attributes), "username")
        names = F.array_join(F.transform("types", lambda a: title(a)), " ")
        body = F.concat(F.replace(header, F.lit("{pii}"), names), F.lit("\n\n"), F.col("block"))
    else:
        out = blocks.join(notes, "username")
        body = F.concat(header, F.lit("\n\n"), F.col("block"), F.lit("\n\nInferences:\n\n"), F.col("notes"))
    return out.select("username", "part", F.concat(body, F.lit("\n\n"), F.lit(ANON_FOOTER)).alias("prompt"))


def judge_prompt(original: Column, adapted: Column) -> Column:
    return F.concat(
        F.lit(JUDGE_HEADER), F.lit("\n\nOriginal text:\n\n"), original, F.lit("\nAdapted text:\n\n"), adapted
    )


def equivalence_prompt(truth: Column, guesses: Column) -> Column:
    pairs = F.transform(guesses, lambda g: F.concat(F.lit("\nGround truth: "), truth, F.lit("\nPrediction: "), g, F.lit("\n")))
    return F.concat(F.lit(EQUAL_HEADER), F.array_join(pairs, ""))


def render(template: str, **parts: Column) -> Column:
    """Fill the named slots of a template."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def improvement_feedback(guess: Column, attack_success: Column, privacy: Column, utility: Column) -> Column:
    """What to tell the defender after a round: breach, weak or good protection."""
    p, u = F.format_string("%.2f", privacy), F.format_string("%.2f", utility)
    return (
        F.when(attack_success, F.concat(F.lit("BREACH: the attacker found '"), guess, F.lit("'. Generalise more. Utility "), u))
        .when(privacy < 0.7, F.concat(F.lit("WEAK ("), p, F.lit("): the attacker guessed '"), guess, F.lit("'. Utility "), u))
        .otherwise(F.concat(F.lit("GOOD ("), p, F.lit("): the guess '"), guess, F.lit("' failed. Utility "), u))
    )


def leak_report(leaked: Column, partial: Column, protected: Column, privacy: Column, utility: Column) -> Column:
    """Attributes by leak status and what to do about it."""
    advice = F.when(privacy < 0.5, "rewrite heavily").when(privacy < 0.7, "blur more").otherwise("keep this level")
    worth = F.when(utility >= 0.7, "utility is good").when(utility >= 0.5, "utility is acceptable").otherwise("utility is low")
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c, F.lit("\n"))).otherwise("")
    return F.concat(part("Leaked: ", leaked), part("Nearly leaked: ", partial), part("Protected: ", protected), worth, F.lit("; "), advice)


# ---- the model stage ----------------------------------------------------------------------------

Model = Callable[[DataFrame], DataFrame]


def replay(answers: DataFrame, key: str = "prompt_id") -> Model:
    """A model that looks answers up; prompts without a stored answer get null."""
    stored = answers.select(key, "answer")
    return lambda prompts: prompts.join(stored, key, "left")


def live(call: Callable[[pd.Series], pd.Series], concurrency: int | None = None) -> Model:
    """A model behind a caller's function over a batch of prompts. Retries belong inside the function.

    `concurrency` caps the simultaneous callers: that many partitions, spread over the executors. A batch holds a few
    hundred prompts, so memory doesn't grow with the partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=call(batch["prompt"]))

    def model(prompts: DataFrame) -> DataFrame:
        spread = small_batches(prompts.repartition(concurrency) if concurrency else prompts)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
        return spread.mapInPandas(run, schema=f"{schema}, answer string")

    return model


def computed(answer: Column) -> Model:
    """A model whose answer is a column expression of the prompt row."""
    return lambda prompts: prompts.withColumn("answer", answer)
