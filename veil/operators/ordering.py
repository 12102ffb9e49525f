"""Order-dependent building blocks that stay parallel when one key is very large.

A plain window puts a whole key into one task. The helpers here either rank with a limit (Spark then
trims every input partition before the shuffle), shift rows by an integer step and regroup, or
compute prefix sums block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.session import cut_lineage


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The `rank <= k` filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by `order`; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), by).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by `order`; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), by).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], back: int = 1
) -> DataFrame:
    """Add `<value>_prev<j>` for j = 1..back, the value at `step - j` of the same key.

    (keys, step) must be unique. Each row is sent to the steps that need it and regrouped on
    (keys, step), so the largest group has back + 1 rows whatever the size of a key.
    """
    rest = [c for c in df.columns if c not in (*keys, step)]
    copies = [
        F.struct(
            F.lit(j).alias("j"),
            (F.col(step) + F.lit(j)).cast(df.schema[step].dataType).alias("s"),
        )
        for j in range(back + 1)
    ]
    sent = df.withColumn("_copy", F.explode(F.array(*copies)))
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    shifted = F.struct(*values)
    aggs = [F.max(F.when(F.col("_copy.j") == 0, row)).alias("_row")]
    aggs += [F.max(F.when(F.col("_copy.j") == j, shifted)).alias(f"_p{j}") for j in range(1, back + 1)]
    out = sent.groupBy(*keys, F.col("_copy.s").alias(step)).agg(*aggs).filter(F.col("_row").isNotNull())
    return out.select(
        *keys,
        step,
        *[F.col("_row")[c].alias(c) for c in rest],
        *[F.col(f"_p{j}")[v].alias(f"{v}_prev{j}") for j in range(1, back + 1) for v in values],
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, block: int = 65536
) -> DataFrame:
    """Inclusive prefix sum of `value` by integer `pos` within keys, block by block.

    No task sees more than `block` positions of a key; block totals are one row per block.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)).cast("long"))
    totals = blocked.groupBy(*keys, "_blk").agg(F.sum(value).alias("_tot"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.sum(value).over(inside))
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_in") + F.col("_off")).cast("long"))
        .drop("_in", "_off", "_blk")
    )


def with_position(df: DataFrame, key: str, out: str = "position", ranges: int = 256) -> DataFrame:
    """0-based global position by a unique numeric key, without a single-task window.

    Range bounds come from one approximate-quantile aggregate (at most `ranges` numbers reach the
    driver); ranks are taken inside each range and shifted by the exact counts of earlier ranges.
    """
    cuts = [F.lit(i / ranges) for i in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(key, F.array(*cuts), F.lit(10000)).alias("b")).first()["b"]
    edges = sorted(set(bounds)) if bounds else []
    slot = F.lit(0)
    if edges:
        slot = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(key)))
    placed = df.withColumn("_slot", slot)
    counts = placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range, so this single-partition window has at most `ranges` rows
    before = Window.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_slot").orderBy(key)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(starts), "_slot")
        .withColumn(out, F.col("_rn") - 1 + F.col("_start"))
        .drop("_slot", "_rn", "_start")
    )


def with_ranks(df: DataFrame, order: Sequence[str], tie: Sequence[str], buckets: int | None = None) -> DataFrame:
    """`df` with its place in the order of the whole table: row_number, rank, dense_rank, percent_rank, cume_dist, and `ntile` of `buckets`.

    Rows are sorted over all tasks by `order` (ascending, nulls first), then `tie`, then a hash; equal values of `order` may fill
    any number of parts. Ranks follow from counts inside a part and one row per part (windows over those alone are in one task).
    row_number and ntile of rows that are equal in both are dealt by hash.
    """
    hashed = F.xxhash64(*df.columns)
    by = [*[F.asc_nulls_first(c) for c in (*order, *tie)], F.asc(hashed)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "ranks").withColumn("_slot", F.shiftright("_at", 33).cast("int")).withColumn("_in", F.pmod("_at", F.lit(1 << 33)))
    value = F.struct(*order)
    # equal values inside a part: how many come before them, how many there are
    groups = placed.groupBy("_slot", *[F.col(c) for c in order]).agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("_seq", F.row_number().over(Window.partitionBy("_slot").orderBy("_first")))
    parts = groups.groupBy("_slot").agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("values"),
        F.min_by(value, "_first").alias("low"), F.max_by(value, "_first").alias("high"),
        F.min_by("_n", "_first").alias("low_n"), F.max_by("_n", "_first").alias("high_n"),
    )
    # one row per part from here on
    whole, line = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_slot")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    joined = F.coalesce(F.lag("high").over(line).eqNullSafe(F.col("low")) & (F.lag("rows").over(line).isNotNull()), F.lit(False))
    parts = parts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("joined", joined)
    # a run of parts that share a value: where it begins, and how many rows it has
    head = F.when(F.col("joined") & (F.col("values") == 1), None).otherwise(F.struct((F.col("start") + F.col("rows") - F.col("high_n")).alias("begin"), F.col("_slot")))
    parts = parts.withColumn("run", F.last(head, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("run0", F.lag("run").over(line))
    sizes = parts.select(F.explode(F.array_distinct(F.array(
        F.when(F.col("joined"), F.struct(F.col("run0").alias("run"), F.col("low_n").alias("n"))),
        F.when(~F.col("joined") | (F.col("values") > 1), F.struct(F.col("run").alias("run"), F.col("high_n").alias("n"))),
    ))).alias("x")).filter("x IS NOT NULL").groupBy("x.run").agg(F.sum("x.n").alias("run_n"))
    fresh = F.col("values") - F.col("joined").cast("int")
    parts = parts.withColumn("dense0", F.coalesce(F.sum(fresh).over(before), F.lit(0)) - F.col("joined").cast("int"))
    parts = parts.withColumn("total", F.sum("rows").over(whole))
    parts = parts.join(sizes.select(F.col("run").alias("run0"), F.col("run_n").alias("low_run")), "run0", "left")
    parts = parts.join(sizes.select(F.col("run"), F.col("run_n").alias("high_run")), "run", "left")
    facts = parts.select(
        "_slot", "start", "joined", F.col("run0.begin").alias("low_start"), "low_run", "high_run", "values", "dense0", "total"
    )
    known = groups.join(F.broadcast(facts), "_slot")
    low, high = (F.col("_seq") == 1) & F.col("joined"), F.col("_seq") == F.col("values")
    known = known.select(
        F.col("_slot").alias("_of"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "start", "total",
        F.when(low, F.col("low_start")).otherwise(F.col("start") + F.col("_first")).alias("_less"),
        F.when(low, F.col("low_run")).when(high, F.col("high_run")).otherwise(F.col("_n")).alias("_same"),
        (F.col("dense0") + F.col("_seq")).alias("dense_rank"),
    )
    same = [F.col("_slot") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]]
    out = placed.join(known, same).select(
        *df.columns, (F.col("_in") + F.col("start") + 1).alias("row_number"), (F.col("_less") + 1).alias("rank"), "dense_rank",
        F.coalesce(F.col("_less") / F.nullif(F.col("total") - 1, F.lit(0)), F.lit(0.0)).alias("percent_rank"),
        ((F.col("_less") + F.col("_same")) / F.col("total")).alias("cume_dist"), "total",
    )
    if buckets is None:
        return out.drop("total")
    # the first total % buckets of them have one row more
    small, more = F.expr(f"total div {buckets}"), F.col("total") % buckets
    at, edge = F.col("row_number") - 1, more * (small + 1)
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / F.greatest(small, F.lit(1)))) + 1
    return out.withColumn("ntile", tile.cast("long")).drop("total")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Fixed small mapping as a literal map expression; null for unknown keys."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
