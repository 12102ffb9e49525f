"""Privacy scores of anonymised samples from attack inferences.

Inferences are long: (sample keys, pii_type, guesses array<string>, certainty int).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.matching import best_similarity, first_containment, leak_score, leak_status, match_class


def attack_results(truth: DataFrame, inferences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per true attribute of each sample; an attribute without inference leaks nothing."""
    joined = truth.select(*keys, "pii_type", F.lower(F.trim("estimate")).alias("truth")).join(
        inferences.select(*keys, "pii_type", "guesses", "certainty"), [*keys, "pii_type"], "left"
    )
    first, best = F.col("first_hit"), F.col("best")
    return (
        joined.withColumn("guesses", F.coalesce("guesses", F.array().cast("array<string>")))
        .withColumn("certainty", F.coalesce("certainty", F.lit(0)))
        .withColumn("lowered", F.transform("guesses", lambda g: F.lower(F.trim(g))))
        .withColumn("first_hit", first_containment(F.col("truth"), F.col("lowered")))
        .withColumn("best", best_similarity(F.col("truth"), F.col("lowered")))
        .select(
            *keys, "pii_type", "truth", "guesses", "certainty",
            match_class(first, best).alias("match_type"),
            F.when(first.isNull(), best).when(first == F.col("truth"), 1.0).otherwise(0.9).alias("similarity"),
            F.coalesce(F.length(first) <= 1, F.lit(False)).alias("short_guess"),
        )
        .withColumn("leak", leak_score(F.col("match_type"), F.col("certainty"), F.col("similarity")))
    )


def sample_scores(
    results: DataFrame,
    keys: Sequence[str],
    utility: DataFrame | None = None,
    target_privacy: float = 0.8,
    min_utility: float = 0.6,
    default_utility: float = 0.8,
) -> DataFrame:
    """Privacy, attack rate and success per sample."""
    hit = (F.col("match_type") != "none") & (F.col("leak") > 0.3)
    per_sample = results.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.avg("leak")).alias("privacy_score"),
        F.avg(hit.cast("double")).alias("attack_success_rate"),
        F.count(F.lit(1)).alias("attributes"),
    )
    if utility is not None:
        per_sample = per_sample.join(utility.select(*keys, "utility_score"), list(keys), "left")
    else:
        per_sample = per_sample.withColumn("utility_score", F.lit(None).cast("double"))
    return per_sample.withColumn("utility_score", F.coalesce("utility_score", F.lit(default_utility))).withColumn(
        "success", (F.col("privacy_score") >= target_privacy) & (F.col("utility_score") >= min_utility)
    )


def samples_without_truth(samples: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples with nothing to protect: privacy 1, attack rate 0."""
    return samples.join(truth.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit(1.0).alias("privacy_score"), F.lit(0.0).alias("attack_success_rate")
    )


def binary_privacy(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Older rule: 1 - certainty / 5 where the truth is among the guesses, else 1; averaged."""
    lowered = F.transform("guesses", lambda g: F.lower(F.trim(g)))
    score = F.when(F.array_contains(lowered, F.col("truth")), F.lit(1.0) - F.col("certainty") / 5.0).otherwise(1.0)
    return results.groupBy(*keys).agg(F.avg(score).alias("privacy_score"))


def leak_partition(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attributes of each sample by leak status; attributes number a handful per sample."""
    inferred = results.filter(F.size("guesses") > 0).withColumn(
        "status", leak_status(F.col("truth"), F.col("guesses"))
    )
    names = {
        s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("pii_type")))), ", ").alias(s)
        for s in ("leaked", "partial", "protected")
    }
    return inferred.groupBy(*keys).agg(*names.values())
