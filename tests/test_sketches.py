"""Sketches that are stored per day and merged: against one pass and exact answers."""

import math
import random

from pyspark.sql import functions as F

from veil.operators import sketches as K


def some_rows(spark, n=30_000):
    rng = random.Random(6)
    rows = [(i % 31, rng.choice(["hot"] * 6 + ["b", "c"]), rng.randint(0, 9000), rng.choice([1, -1, 1]) * 10 ** rng.uniform(-3, 6)) for i in range(n)]
    rows += [(1, "odd", None, None), (1, "odd", 5, float("nan")), (2, "odd", 5, float("inf")), (2, "odd", None, 0.0), (3, "odd", 5, -7.5)]
    return spark.createDataFrame(rows, "d int, k string, u int, v double"), rows


def test_merged_histograms_equal_one_pass_and_keep_the_accuracy(spark):
    df, rows = some_rows(spark)
    wanted = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    daily = K.daily_histogram(df, F.col("d"), ["k"], "v")
    merged = {r["k"]: (r["count"], r["quantiles"]) for r in K.merged_quantiles(daily, ["k"], wanted).collect()}
    direct = {r["k"]: (r["count"], r["quantiles"]) for r in K.merged_quantiles(K.daily_histogram(df, F.lit(0), ["k"], "v"), ["k"], wanted).collect()}
    assert merged == direct and set(merged) == {"hot", "b", "c", "odd"}
    for key, (count, found) in merged.items():
        values = sorted(v for _, k, _, v in rows if k == key and v is not None and math.isfinite(v))
        assert count == len(values)
        for q, x in zip(wanted, found):
            exact = values[max(math.ceil(q * count), 1) - 1]
            assert abs(x - exact) <= K.ACCURACY * abs(exact) * (1 + 1e-9) + K.LEAST, (key, q)
    some_days = K.merged_quantiles(daily.filter("day < 5"), ["k"], [0.5]).collect()
    assert sum(r["count"] for r in some_days) == sum(d < 5 and v is not None and math.isfinite(v) for d, _, _, v in rows)
    assert K.merged_quantiles(daily.filter("false"), ["k"], [0.5]).count() == 0


def test_merged_distinct_counts_stay_inside_the_bound(spark):
    df, rows = some_rows(spark)
    daily = K.daily_distinct(df, F.col("d"), ["k"], "u")
    merged = {r["k"]: r["distinct"] for r in K.merged_distinct(daily, ["k"]).collect()}
    halves = daily.groupBy((F.col("day") % 2).alias("day"), "k").agg(F.hll_union_agg("sketch").alias("sketch"))
    twice = {r["k"]: r["distinct"] for r in K.merged_distinct(halves, ["k"]).collect()}
    direct = {r["k"]: r["distinct"] for r in K.merged_distinct(K.daily_distinct(df.repartition(5), F.lit(0), ["k"], "u"), ["k"]).collect()}
    for key, exact in ((k, len({u for _, own, u, _ in rows if own == k and u is not None})) for k in merged):
        assert all(abs(x[key] - exact) <= max(1, exact * K.distinct_bound()) for x in (twice, direct)), key
    for key, found in merged.items():
        exact = len({u for _, k, u, _ in rows if k == key and u is not None})
        assert abs(found - exact) <= max(1, exact * K.distinct_bound()), key
    assert merged["odd"] == 1 and K.distinct_bound(14) < K.distinct_bound(12) < 0.07


def test_daily_rows_are_combined_before_the_shuffle(spark):
    df, _ = some_rows(spark, 100)
    for daily in (K.daily_histogram(df, F.col("d"), ["k"], "v"), K.daily_distinct(df, F.col("d"), ["k"], "u")):
        assert "partial_" in daily._jdf.queryExecution().executedPlan().toString()
