"""Rounds of the defend/attack/judge loop: stop rules, finals, trends and run statistics.

(profile, config, round) is unique and a run has a small fixed maximum of rounds, so a window per
(profile, config) sees a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.numbers import exact_mean
from veil.operators.ordering import with_position, with_previous

RUN = ["profile_id", "config"]
PASS_PRIVACY, PASS_UTILITY = 0.8, 0.6


def _until_first(df: DataFrame, flag: Column, keys: Sequence[str]) -> DataFrame:
    """Rows up to and including the first flagged one."""
    earlier = Window.partitionBy(*keys).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_stop", flag)
        .withColumn("_before", F.coalesce(F.max(F.col("_stop").cast("int")).over(earlier), F.lit(0)))
        .filter("_before = 0")
        .withColumn("stopped", F.col("_stop"))
        .drop("_stop", "_before")
    )


def stop_early(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Stop from the second round on: strong privacy with utility, three steady rounds, or ruined text."""
    order = Window.partitionBy(*keys).orderBy("round")
    steady = F.min("privacy_score").over(order.rowsBetween(-2, 0)) >= 0.8
    good = (F.col("privacy_score") >= 0.9) & (F.col("utility_score") >= 0.7)
    flag = (F.row_number().over(order) >= 2) & (good | steady | (F.col("utility_score") < 0.3))
    return _until_first(df, flag, keys)


def stop_at_target(
    df: DataFrame,
    privacy: float = PASS_PRIVACY,
    utility: float = PASS_UTILITY,
    floor: float = 0.3,
    keys: Sequence[str] = RUN,
) -> DataFrame:
    flag = ((F.col("privacy_score") >= privacy) & (F.col("utility_score") >= utility)) | (F.col("utility_score") < floor)
    return _until_first(df, flag, keys)


def final_rounds(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Last kept round of each run with totals."""
    last = F.max_by(F.struct("privacy_score", "utility_score"), "round")
    return df.groupBy(*keys).agg(
        last.alias("_last"), F.count(F.lit(1)).alias("total_rounds"), F.sum("elapsed").alias("total_time")
    ).select(
        *keys,
        F.col("_last.privacy_score").alias("final_privacy"),
        F.col("_last.utility_score").alias("final_utility"),
        "total_rounds",
        "total_time",
    )


def trends(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = RUN) -> DataFrame:
    """Percent change against the previous round; 0 in the first; null when the previous value is 0."""
    shifted = with_previous(df.select(*keys, "round", *metrics), keys, "round", metrics)
    change = [
        F.when(F.col(f"{m}_prev1").isNull(), 0.0)
        .otherwise((F.col(m) - F.col(f"{m}_prev1")) / F.nullif(F.col(f"{m}_prev1"), F.lit(0.0)) * 100)
        .alias(f"{m}_trend")
        for m in metrics
    ]
    return shifted.select(*keys, "round", *change)


def overall_change(df: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Percent change from the first to the last round."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(metric, "round").alias("first"), F.max_by(metric, "round").alias("last"))
        .withColumn("change", (F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)) * 100)
    )


def previous_text(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Text of each round beside the text of the round before."""
    return with_previous(df.select(*keys, "round", "anonymized_text"), keys, "round", ["anonymized_text"])


def method_round_means(df: DataFrame) -> DataFrame:
    return df.groupBy("config", "round").agg(
        exact_mean("privacy_score").alias("privacy"),
        exact_mean("utility_score").alias("utility"),
        F.round(F.avg(F.col("attack_success").cast("double")), 6).alias("attack_success_rate"),
    )


def score_statistics(df: DataFrame, keys: Sequence[str], privacy: str, utility: str) -> DataFrame:
    """Count, mean, population deviation, range and pass shares; no rows give nulls."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        *[
            f(c).alias(f"{n}_{s}")
            for n, c in (("privacy", privacy), ("utility", utility))
            for s, f in (
                ("mean", lambda x: exact_mean(x)),
                ("std", lambda x: F.round(F.stddev_pop(x), 6)),
                ("min", F.min),
                ("max", F.max),
            )
        ],
        F.round(F.avg((F.col(privacy) >= PASS_PRIVACY).cast("double")), 6).alias("pass_rate"),
        F.round(
            F.avg(((F.col(privacy) >= PASS_PRIVACY) & (F.col(utility) >= PASS_UTILITY)).cast("double")), 6
        ).alias("optimal_share"),
    )


def success_text(finals: DataFrame, target: float = PASS_PRIVACY) -> DataFrame:
    """'s/t (p%)' per config."""
    good = F.count_if(F.col("final_privacy") >= target)
    return finals.groupBy("config").agg(good.alias("good"), F.count(F.lit(1)).alias("total")).select(
        "config",
        F.concat(
            F.col("good").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("),
            F.round(F.col("good") / F.col("total") * 100, 1).cast("string"), F.lit("%)"),
        ).alias("success"),
    )


def parse_success_text(text: Column) -> list[Column]:
    pattern = r"^([0-9]+)/([0-9]+) \(([0-9.]+)%\)$"
    return [
        F.regexp_extract(text, pattern, 1).try_cast("bigint").alias("successes"),
        F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("total"),
        F.regexp_extract(text, pattern, 3).try_cast("double").alias("percent"),
    ]


def rounds_distribution(finals: DataFrame) -> DataFrame:
    """Share of runs per number of rounds; the window runs over that short list."""
    counts = finals.groupBy("config", "total_rounds").agg(F.count(F.lit(1)).alias("runs"))
    return counts.withColumn(
        "percent", F.round(F.col("runs") / F.sum("runs").over(Window.partitionBy("config")) * 100, 6)
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between each key's least and greatest value; the last bin is closed.

    Equal values of a key are counted before anything is joined, so a key with very many rows doesn't travel whole.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    pos = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins
    return (
        counts.join(span, list(keys))
        .withColumn("bin", F.least(F.coalesce(F.floor(pos), F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.sum("_c").alias("n"))
    )


def progress(df: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """Percent done, rate per minute of event time and minutes left."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    minutes = (F.max(at) - F.min(at)) / 60000000.0
    return (
        df.groupBy(*keys)
        .agg(F.countDistinct("profile_id").alias("done"), minutes.alias("minutes"))
        .withColumn("percent", F.col("done") / F.lit(target) * 100)
        .withColumn("rate", F.col("done") / F.nullif("minutes", F.lit(0.0)))
        .withColumn("minutes_left", (F.lit(target) - F.col("done")) / F.nullif("rate", F.lit(0.0)))
    )


def cumulative_versions(df: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """For every round k >= 1 a profile reached, its versions 0..k."""
    reached = df.groupBy(*keys).agg(F.max(version).alias("_last"))
    first = F.greatest(F.col(version), F.lit(1))
    return (
        df.join(reached.filter("_last >= 1"), list(keys))
        .withColumn("round", F.explode(F.sequence(first, F.col("_last"))))
        .drop("_last")
    )


def result_rows(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row per run with its rounds in order: at most max_rounds small structs."""
    point = F.struct("round", "privacy_score", "utility_score", "attack_success")
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("rounds"))


def assign_configs(samples: DataFrame, key: str, configs: Sequence[str]) -> DataFrame:
    """Sample i of the whole table (by key) gets config i mod n."""
    names = F.array(*[F.lit(c) for c in configs])
    return with_position(samples, key).withColumn(
        "config", F.element_at(names, (F.col("position") % len(configs) + 1).cast("int"))
    )


def stable_tenth(name: Column) -> Column:
    """0..9 from the first 16 bits of the MD5 of a name; the same on every machine."""
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("int") % 10


def needs_quality_check(df: DataFrame, name: Column, rate: float, max_rounds: int) -> DataFrame:
    """The last round always, round 1 for a stable share of names."""
    sampled = (F.col("round") == 1) & (stable_tenth(name) < int(rate * 10))
    return df.filter((F.col("round") == max_rounds) | sampled)
