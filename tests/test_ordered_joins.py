"""Interval joins, as-of joins and ranks over whole tables, against plain loops and SQL windows."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from veil.operators import joins as J
from veil.operators.ordering import with_ranks


@pytest.fixture
def partitions(spark):
    """Several parts even for small tables."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def spans(rng, n, ids):
    out = []
    for i in range(n):
        start = rng.choice([rng.randint(-50, 400), 77])
        out.append((ids + i, rng.choice(["a", "a", "a", "b", None]), start, start + rng.choice([0, 0, 1, 3, 10, 60, 100_000, -1])))
    return out + [(ids + n, "a", None, 5), (ids + n + 1, "b", 5, None), (ids + n + 2, "a", -(2**40), 2**40)]


@pytest.mark.parametrize("block", [5, J.BIN_ROWS])
def test_intervals_equal_a_nested_loop(spark, partitions, block):
    rng = random.Random(block)
    left, right = spans(rng, 200, 0), spans(rng, 200, 1000)
    a = spark.createDataFrame(left, "l int, k string, lo long, hi long")
    b = spark.createDataFrame(right, "r int, k string, s long, e long")
    joined = J.interval_join(a, b, ["k"], ("lo", "hi"), ("s", "e"), block)
    expected = sorted(
        (i, j) for i, k, lo, hi in left for j, m, s, e in right
        if k is not None and k == m and None not in (lo, hi, s, e) and lo <= hi and s <= e and lo <= e and s <= hi
    )
    assert sorted((r["l"], r["r"]) for r in joined.collect()) == expected and len(expected) > 1000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_points_and_nothing(spark):
    a = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "l int, lo long, hi long")
    b = spark.createDataFrame([(1, 5, 5), (1, 5, 5), (3, 0, 4)], "r int, s long, e long")
    assert sorted((r["l"], r["r"]) for r in J.interval_join(a, b, [], ("lo", "hi"), ("s", "e")).collect()) == [(1, 1), (1, 1)]
    none = J.interval_join(a.filter("false"), b, [], ("lo", "hi"), ("s", "e"))
    assert none.count() == 0 and none.columns == ["l", "lo", "hi", "r", "s", "e"]
    with pytest.raises(ValueError, match="both sides"):
        J.interval_join(a, a, [], ("lo", "hi"), ("lo", "hi"))


def test_a_hot_bin_is_many_tasks(spark, partitions):
    a = spark.range(3000).selectExpr("id AS l", "1 AS k", "10L AS lo", "12L AS hi")
    b = spark.range(20).selectExpr("id AS r", "1 AS k", "11L AS s", "11L AS e")
    joined = J.interval_join(a, b, ["k"], ("lo", "hi"), ("s", "e"), block=100)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 30_000


def plain_as_of(left, right, within=None):
    by = {}
    for k, t, v in right:
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, v is not None, v))
    out = []
    for i, k, t in left:
        rows = sorted(by.get(k, []), key=lambda x: (x[0], x[1], x[2] or 0)) if k is not None and t is not None else []
        at = bisect.bisect_right([x[0] for x in rows], t) if rows else 0
        hit = (rows[at - 1][0], rows[at - 1][2]) if at else None
        out.append((i, None if hit is None or (within is not None and t - hit[0] > within) else hit))
    return sorted(out)


@pytest.mark.parametrize("within", [None, 7])
def test_as_of_equals_a_search(spark, partitions, within):
    rng = random.Random(21)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", "d", None])
    left = [(i, key(), rng.choice([rng.randint(0, 300), 150, None])) for i in range(1500)]
    right = [(key(), rng.choice([rng.randint(0, 300), None]), rng.choice([rng.randint(0, 9), None])) for _ in range(120)]
    right += [("e", 1, 1), ("hot", 0, 1)] + [("hot", 3, 5)] * 4
    a = spark.createDataFrame(left, "i int, k string, t long").repartition(5)
    b = spark.createDataFrame(right, "k string, at long, v int").repartition(5)
    found = J.as_of_join(a, b, ["k"], "t", "at", within=within)
    got = sorted((r["i"], tuple(r["match"]) if r["match"] else None) for r in found.collect())
    assert got == plain_as_of(left, right, within)
    assert found.columns == ["k", "i", "t", "match"]


def test_as_of_carries_over_parts_without_right_rows(spark, partitions):
    """One key, one early right row, and thousands of left rows in all parts behind it."""
    left = spark.range(5000).selectExpr("'x' AS k", "id + 10 AS t")
    right = spark.createDataFrame([("x", 5, 42), ("w", 0, 1), ("x", 4000, 43)], "k string, at long, v int")
    found = J.as_of_join(left, right, ["k"], "t", "at")
    assert {(r["v"], r["n"]) for r in found.groupBy("match.v").agg(F.count("*").alias("n")).collect()} == {(42, 3990), (43, 1010)}
    none = spark.createDataFrame([], "k string, at long, v int")
    assert J.as_of_join(left, none, ["k"], "t", "at").filter("match IS NOT NULL").count() == 0
    assert J.as_of_join(left.filter("false"), right, ["k"], "t", "at").count() == 0


@pytest.mark.parametrize("rows", ["ties", "few", "one value", "distinct"])
def test_ranks_equal_windows(spark, partitions, rows):
    rng = random.Random(len(rows))
    data = {
        "ties": [(i, rng.choice([5] * 10 + [None, 1, 2, 9, rng.randint(0, 50)]), "x") for i in range(3000)],
        "few": [(1, 3, "a"), (2, 3, "b")], "one value": [(i, 7, "x") for i in range(1000)],
        "distinct": [(i, (i * 7919) % 2003, "x") for i in range(2003)],
    }[rows]
    df = spark.createDataFrame(data, "i int, v int, s string").repartition(4)
    names = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"]
    found = {r["i"]: [r[n] for n in names] for r in with_ranks(df, ["v"], ["i"], 7).collect()}
    df.createOrReplaceTempView("ranked_rows")
    wanted = spark.sql(
        "SELECT i, row_number() OVER (ORDER BY v, i) AS row_number, rank() OVER (ORDER BY v) AS rank, dense_rank() OVER (ORDER BY v) AS dense_rank,"
        " percent_rank() OVER (ORDER BY v) AS percent_rank, cume_dist() OVER (ORDER BY v) AS cume_dist, ntile(7) OVER (ORDER BY v, i) AS ntile FROM ranked_rows"
    )
    for r in wanted.collect():
        assert found[r["i"]] == pytest.approx([r[n] for n in names]), r
    assert len(found) == len(data)


def test_ranks_of_nothing_and_repeats(spark):
    none = spark.createDataFrame([], "i int, v int")
    assert with_ranks(none, ["v"], ["i"], 4).count() == 0
    same = with_ranks(spark.createDataFrame([(1, 1)] * 9, "i int, v int"), ["v"], ["i"], 4).collect()
    assert sorted(r["row_number"] for r in same) == list(range(1, 10)) and {r["rank"] for r in same} == {1} and {r["cume_dist"] for r in same} == {1.0}
