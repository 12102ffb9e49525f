"""Approximate aggregates that are stored per day and merged later.

A daily row holds one sketch of distinct values and one histogram of magnitudes per key. A report over any set of days merges
their small rows and is within the same bounds as one pass over all rows.

Distinct counts are HyperLogLog sketches of 2^precision registers; a merged estimate has a relative standard error of
1.04 / sqrt(2^precision) (1.6 % at 12), so it is off by more than `DISTINCT_ERROR` times that in a few cases in ten thousand.
Quantiles come from counts in buckets whose limits grow by (1 + accuracy) / (1 - accuracy): the value given for a quantile is
within the relative `accuracy` of the exact one, always. Counts add up exactly, so merged and direct histograms are equal;
merged and direct distinct estimates may differ, both within the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION, ACCURACY = 12, 0.01
#: Standard errors that a distinct count is allowed to be off by.
DISTINCT_ERROR = 4.0
#: Magnitudes below count as zero.
LEAST = 1e-9


def distinct_bound(precision: int = PRECISION) -> float:
    return DISTINCT_ERROR * 1.04 / 2 ** (precision / 2)


def _growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def _bucket(value: Column, accuracy: float) -> Column:
    """Signed bucket number; 0 for what is nearly zero."""
    size = F.ceil(F.ln(F.abs(value) / LEAST) / F.log(F.lit(_growth(accuracy)))).cast("int")
    return F.when(F.abs(value) <= LEAST, 0).when(value > 0, size).otherwise(-size)


def _middle(bucket: Column, accuracy: float) -> Column:
    """The value that stands for a bucket, within the accuracy of all values in it."""
    g = _growth(accuracy)
    size = F.pow(F.lit(g), F.abs(bucket).cast("double")) * (LEAST * 2 / (1 + g))
    return F.when(bucket == 0, 0.0).when(bucket > 0, size).otherwise(-size)


def daily_distinct(df: DataFrame, day: Column, keys: Sequence[str], value: str, precision: int = PRECISION) -> DataFrame:
    """(day, keys, sketch): one sketch of the distinct non-null values of a text or whole number a day and key."""
    return df.groupBy(day.alias("day"), *keys).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def merged_distinct(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, distinct): estimate over all days given."""
    return daily.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def daily_histogram(df: DataFrame, day: Column, keys: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(day, keys, bucket, n): counts of finite values by magnitude; at most a few thousand rows a day and key."""
    v = F.col(value).cast("double")
    usable = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return usable.groupBy(day.alias("day"), *keys, _bucket(v, accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged_quantiles(daily: DataFrame, keys: Sequence[str], quantiles: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, count, quantiles): for each q the value of rank ceil(q * count), at least 1, within the accuracy."""
    merged = daily.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    # a few thousand buckets a key, however many rows there were
    line = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    grouped = merged.groupBy(*keys).agg(line.alias("line"), F.sum("n").alias("count"))
    wanted = F.array(*[F.greatest(F.ceil(F.col("count") * F.lit(float(q))), F.lit(1)).cast("long") for q in quantiles])

    def at(rank: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            seen = acc["seen"] + x["n"]
            hit = F.coalesce(acc["found"], F.when(seen >= rank, x["bucket"]))
            return F.struct(seen.alias("seen"), hit.alias("found"))

        return _middle(F.aggregate("line", start, step)["found"], accuracy)

    return grouped.select(*keys, "count", F.transform(wanted, at).alias("quantiles"))
