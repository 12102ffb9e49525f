"""Joining inferences to ground truth and shaping evaluation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.answers import verdicts
from veil.functions.matching import guess_is_correct, true_value
from veil.operators.ordering import earliest
from veil.operators.prompts import Model, equivalence_prompt
from veil.session import cut_lineage

META_KEYS = ["time", "timestamp"]


def guess_list(text: Column) -> Column:
    """';'-separated guesses -> trimmed non-empty array."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda g: g != "")


def certainty_value(text: Column) -> Column:
    """First integer of a certainty text, -1 when there is none."""
    return F.coalesce(F.regexp_extract(text, "([0-9]+)", 1).try_cast("int"), F.lit(-1))


def usable_truth(truth: DataFrame, attributes: Sequence[str] | None = None) -> DataFrame:
    """Reviewed attributes of some hardness, lower-cased."""
    out = truth.filter(
        ~F.col("reviewer").isin(META_KEYS) & ~F.col("pii_type").isin(META_KEYS) & (F.col("hardness") != 0)
    )
    if attributes:
        out = out.filter(F.col("pii_type").isin(list(attributes)))
    return out.withColumn("estimate", F.lower(F.trim("estimate")))


def relevant_attributes(truth: DataFrame, hardness: int = 1, certainty: int = 1) -> DataFrame:
    """Attributes of each profile that reach both thresholds for some reviewer."""
    return (
        truth.filter(~F.col("reviewer").isin(META_KEYS) & ~F.col("pii_type").isin(META_KEYS))
        .filter((F.col("hardness") >= hardness) & (F.col("certainty") >= certainty))
        .select("username", "pii_type")
        .distinct()
    )


def with_level(items: DataFrame, levels: DataFrame) -> DataFrame:
    """Resolution level per (profile, attribute); 1 where none is known."""
    known = levels.groupBy("username", "pii_type").agg(F.max("level").alias("res_level"))
    return items.join(known, ["username", "pii_type"], "left").withColumn(
        "res_level", F.coalesce("res_level", F.lit(1))
    )


def match_predictions(truth: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Truth joined to one model's predictions at every version; predictions without guesses drop out."""
    chosen = predictions.filter((F.col("model") == model) & F.col("guess").isNotNull()).select(
        "username", "pii_type", "version", "inference", guess_list(F.col("guess")).alias("guesses"),
        certainty_value(F.col("certainty")).alias("pred_certainty"),
    )
    return usable_truth(truth).join(chosen, ["username", "pii_type"])


def score_guesses(matched: DataFrame) -> DataFrame:
    """Add `is_correct`, one 0/1 per guess in rank order.

    Each distinct (attribute, truth, guess) is judged once; the verdicts go back to the distinct lists of guesses, and those to
    the rows. A list that very many rows share is one row on the other side of that join, which Spark may split.
    """
    key = ["pii_type", "estimate", "guesses"]
    lists = matched.select(*key).distinct()
    each = lists.select(*key, F.posexplode("guesses").alias("_at", "_guess")).withColumn("_guess", F.lower(F.trim("_guess")))
    pair = ["pii_type", "estimate", "_guess"]
    judged = each.select(*pair).distinct().withColumn("_ok", guess_is_correct(*map(F.col, pair)))
    verdict = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ok"))), lambda x: x["_ok"])
    known = each.join(judged, pair).groupBy(*key).agg(verdict.alias("is_correct"))
    none = F.transform("guesses", lambda g: F.lit(0))  # a null truth or guess, or no guesses
    rows = matched.drop("is_correct")
    return rows.join(known, key, "left").select(*rows.columns, F.coalesce("is_correct", none).alias("is_correct"))


def decided_guesses(scored: DataFrame, model: Model, keys: Sequence[str]) -> DataFrame:
    """`scored` with the verdicts of a model where no guess was found right.

    Ages are never asked about, nor rows without guesses; each other row is one prompt, sent once. An answer with another
    number of verdicts than guesses changes nothing. 'yes' is right; 'no' and 'less precise' are not.
    """
    known = cut_lineage(scored, "scored")
    ask = (F.col("pii_type") != "age") & (F.size("guesses") > 0) & ~F.array_contains("is_correct", 1)
    prompts = known.filter(ask).select(*keys, F.size("guesses").alias("_n"), equivalence_prompt(F.col("estimate"), F.col("guesses")).alias("prompt"))
    told = model(prompts).select(*keys, verdicts(F.col("answer"), F.col("_n")).alias("_told"))
    return known.join(told, list(keys), "left").withColumn("is_correct", F.coalesce("_told", "is_correct")).drop("_told")


def unknown_values(truth: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """True values the vocabulary does not know, after an optional mapping table: the exceptions to resolve."""
    closed = usable_truth(truth, ["married", "income", "education"]).withColumn(
        "mapped", true_value(F.col("pii_type"), F.col("estimate"))
    )
    missing = closed.filter("mapped IS NULL").select("pii_type", F.col("estimate").alias("raw")).distinct()
    return missing.join(mapping, ["pii_type", "raw"], "left_anti") if mapping is not None else missing


def normalised_values(truth: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vocabulary value of each closed attribute, from the fixed table first, then the mapping table."""
    closed = usable_truth(truth, ["married", "income", "education"])
    return (
        closed.withColumn("raw", F.lower("estimate"))
        .join(mapping.select("pii_type", "raw", "canonical"), ["pii_type", "raw"], "left")
        .withColumn("value", F.coalesce(true_value(F.col("pii_type"), F.col("estimate")), F.col("canonical")))
        .drop("canonical")
    )


def upsert_mapping(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """Mapping table with new (attribute, raw) rows taking the place of old ones."""
    kept = mapping.join(new.select("pii_type", "raw").distinct(), ["pii_type", "raw"], "left_anti")
    return kept.unionByName(earliest(new, ["pii_type", "raw"], [F.col("canonical")]))


def eval_table(scored: DataFrame, utility: DataFrame, levels: DataFrame, setting: str) -> DataFrame:
    """The 19-column evaluation rows; level 0 without utility counts as unchanged text."""
    base = F.when(F.col("version") == 0, 10.0).otherwise(0.0)
    guess = [F.coalesce(F.try_element_at("guesses", F.lit(i)), F.lit("")) for i in (1, 2, 3)]
    joined = with_level(scored.drop("level"), levels).join(utility, ["username", "version"], "left")
    return joined.select(
        F.lit(setting).alias("anon_setting"), F.col("username").alias("id"), "pii_type",
        F.col("version").alias("anon_level"), "res_level", F.col("estimate").alias("gt"),
        F.col("hardness").alias("gt_hardness"), F.col("certainty").alias("gt_certainty"),
        guess[0].alias("pred_1"), guess[1].alias("pred_2"), guess[2].alias("pred_3"),
        F.col("pred_certainty").alias("certainty"), F.lit(-1).alias("self_is_correct"),
        F.concat(F.lit("["), F.concat_ws(", ", F.col("is_correct").cast("array<string>")), F.lit("]")).alias("is_correct"),
        F.coalesce("readability", base).alias("utility_readability"),
        F.coalesce("meaning", base).alias("utility_meaning"),
        F.coalesce("hallucination", base / 10).alias("utility_hallucinations"),
        F.coalesce("bleu", base).alias("utility_bleu"),
        F.coalesce("rouge1", base).alias("utility_rouge"),
    )


def refresh_utility(eval_rows: DataFrame, utility: DataFrame) -> DataFrame:
    """Utilities of levels above 0 taken again from the profile's utility table."""
    fresh = utility.select(
        F.col("username").alias("id"), F.col("version").alias("anon_level"),
        F.struct(
            F.col("readability").alias("utility_readability"), F.col("meaning").alias("utility_meaning"),
            F.col("hallucination").alias("utility_hallucinations"), F.col("bleu").alias("utility_bleu"),
            F.col("rouge1").alias("utility_rouge"),
        ).alias("fresh"),
    )
    names = ["utility_readability", "utility_meaning", "utility_hallucinations", "utility_bleu", "utility_rouge"]
    use = (F.col("anon_level") > 0) & F.col("fresh").isNotNull()
    return eval_rows.join(fresh, ["id", "anon_level"], "left").select(
        *[c for c in eval_rows.columns if c not in names],
        *[F.when(use, F.col("fresh")[c]).otherwise(F.col(c)).alias(c) for c in names],
    )


def without_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key is not finished yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_runs(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Union of two runs by key; for each value the first run that has it wins."""
    a, b = first.alias("a"), second.alias("b")
    return a.join(b, list(keys), "full_outer").select(
        *keys,
        *[F.coalesce(F.col(f"a.{v}"), F.col(f"b.{v}")).alias(v) for v in values],
    )


def complete_profiles(expected: DataFrame, done: DataFrame, first_level: int = 0) -> DataFrame:
    """Profiles of which every version from `first_level` on has been inferred."""
    want = expected.filter(F.col("version") >= first_level).select("username", "version").distinct()
    have = done.filter(F.col("version") >= first_level).select("username", "version").distinct().withColumn("have", F.lit(1))
    return (
        want.join(have, ["username", "version"], "left")
        .groupBy("username")
        .agg(F.count(F.lit(1)).alias("versions"), F.count("have").alias("finished"))
        .filter("versions = finished")
        .select("username", "versions")
    )


def rank_credit(vectors: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Hits credited to rank k when no earlier rank was right, summed per rank."""
    earlier = F.coalesce(
        F.aggregate(F.slice(F.col(vector), F.lit(1), F.col("pos")), F.lit(0), lambda a, x: a + x), F.lit(0)
    )
    return (
        vectors.select(*keys, vector, F.posexplode(vector).alias("pos", "ok"))
        .withColumn("credit", F.greatest(F.lit(1) - earlier, F.lit(0)) * F.col("ok"))
        .groupBy((F.col("pos") + 1).alias("rank"))
        .agg(F.sum("credit").cast("long").alias("credit"), F.count(F.lit(1)).alias("guesses"))
    )
