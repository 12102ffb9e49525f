"""Joins on intervals and on time that stay parallel: no nested loop, and no task per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.session import cut_lineage

#: Rows of one side in one bin that one task takes; more are dealt over several, each with all rows of the other side.
BIN_ROWS = 20_000
#: Bins of the next level are so many times as wide.
STEP = 8


# ---- intervals ----------------------------------------------------------------------------------


def _levels(span: tuple[str, str]) -> Column:
    """The level whose bins are at least as wide as the interval, so that it lies in two of them at most."""
    length = F.col(span[1]).cast("double") - F.col(span[0]).cast("double")
    return F.ceil(F.log(float(STEP), length + 1)).cast("int")


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(float(STEP)), level)).cast("long")


def _pieces(df: DataFrame, keys: Sequence[str], span: tuple[str, str], name: str, own: Sequence[int], other: Sequence[int]) -> DataFrame:
    """Each row at its own level, and at every wider level that the other side has rows of; one piece per bin it touches."""
    level = F.col("_l")
    # at its own level a row meets rows of that level or of narrower ones
    wanted = F.array(*[F.lit(x) for x in sorted(set(own) | set(other))])
    useful = F.filter(
        wanted, lambda x: ((x == level) & (x >= F.lit(min(other)))) | ((x > level) & x.isin(*[int(o) for o in other]))
    )
    placed = df.withColumn("_l", _levels(span)).withColumn("_level", F.explode(useful))
    first, last = _bin(F.col(span[0]), F.col("_level")), _bin(F.col(span[1]), F.col("_level"))
    row = F.struct(*df.columns)
    return placed.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_level", F.explode(F.sequence(first, last)).alias("_bin"),
        row.alias(f"_{name}"),
    )


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], block: int = BIN_ROWS
) -> DataFrame:
    """All pairs of rows with equal keys whose closed intervals have a point in common; columns of both, keys once.

    Spans name the first and last integer of an interval (days, seconds ...); a point has both equal. Rows are dealt into bins that
    are as wide as the longer interval of a pair needs, so an interval lies in two bins of its level at most however long it
    is, and a pair is reported in the bin where the later of its intervals begins. Bins with more than `block` rows of the left
    are dealt over several tasks. Null keys or bounds, and intervals that end before they begin, meet nothing. Other columns
    of the two sides must have different names.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    sides = []
    for df, (first, last) in ((left, left_span), (right, right_span)):
        usable = F.col(first) <= F.col(last)
        for k in keys:
            usable = usable & F.col(k).isNotNull()
        # a row is written once; its pieces are made on the way to the join
        sides.append(cut_lineage(df.filter(usable), "sides"))
    own, other = (
        sorted(r[0] for r in df.select(_levels(span)).distinct().collect())  # 22 levels at most
        for df, span in zip(sides, (left_span, right_span))
    )
    a, b = left_span[0], right_span[0]
    columns = [F.col(f"_left.{c}").alias(c) for c in left.columns] + [F.col(f"_right.{c}").alias(c) for c in right.columns if c not in keys]
    if not own or not other:
        return sides[0].limit(0).crossJoin(sides[1].drop(*keys).limit(0)).select(*left.columns, *[c for c in right.columns if c not in keys])
    p = _pieces(sides[0], keys, left_span, "left", own, other)
    q = _pieces(sides[1], keys, right_span, "right", other, own)
    place = [*[f"_k{i}" for i in range(len(keys))], "_level", "_bin"]
    # the left side of a full bin is dealt over parts, the right side goes to each
    full = cut_lineage(
        p.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts")).filter("_parts > 1"), "full-bins"
    )
    if not full.isEmpty():
        parts = F.coalesce("_parts", F.lit(1))
        p = p.join(full, place, "left").withColumn("_part", F.pmod(F.xxhash64("_left"), parts).cast("int")).drop("_parts")
        q = q.join(full, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        place = [*place, "_part"]
    later = F.greatest(F.col(f"_left.{a}"), F.col(f"_right.{b}"))
    meet = (
        (F.greatest(_levels(tuple(f"_left.{c}" for c in left_span)), _levels(tuple(f"_right.{c}" for c in right_span))) == F.col("_level"))
        & (F.col(f"_left.{left_span[0]}") <= F.col(f"_right.{right_span[1]}"))
        & (F.col(f"_right.{right_span[0]}") <= F.col(f"_left.{left_span[1]}"))
        & (_bin(later, F.col("_level")) == F.col("_bin"))
    )
    return p.join(q, place).filter(meet).select(*columns)


# ---- as of --------------------------------------------------------------------------------------


def sorted_slots(df: DataFrame, order: Sequence[Column], slot: str = "_slot", place: str = "_place") -> DataFrame:
    """`df` sorted over all tasks and written: `slot` numbers the parts in order, `place` the rows inside one from 0."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "slots")
    return placed.withColumn(slot, F.shiftright("_at", 33).cast("int")).withColumn(place, F.pmod("_at", F.lit(1 << 33))).drop("_at")


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, match: str = "match", within: int | None = None
) -> DataFrame:
    """Each left row with `match`, the struct of the latest right row of equal keys whose time is not after its own, or null.

    Of right rows of one time the greatest by its other columns counts (columns that can be ordered). With `within`, times are numbers and
    a match is no more than so far back. Rows with a null key or time match nothing. Both sides are sorted together over all tasks
    by key, time and a hash; inside a part the last right row is carried forward, and one row per part carries it on to the next
    ones. So a key that holds most rows is many parts.
    """
    rest = [c for c in right.columns if c not in keys]
    usable = lambda df, time: reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, time], F.lit(True))
    known = right.filter(usable(right, right_time)).select(
        *keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.struct(right_time, *[c for c in rest if c != right_time]).alias("_right"),
    )
    asked = left.withColumn("_fine", usable(left, left_time)).select(
        *keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), "_fine", F.struct(*[c for c in left.columns if c not in keys]).alias("_left"),
    )
    # of several right rows of one time one is left, combined before the shuffle
    known = known.groupBy(*keys, "_time", "_side").agg(F.max("_right").alias("_right")).withColumn("_fine", F.lit(True))
    both = known.unionByName(asked, allowMissingColumns=True)
    order = [*[F.asc_nulls_first(k) for k in keys], F.asc_nulls_first("_time"), F.asc("_side"), F.asc(F.xxhash64("_left"))]
    placed = sorted_slots(both, order)
    key = F.struct(*keys)
    inside = Window.partitionBy("_slot", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    # one row per part: its last right row, with its key
    parts = placed.filter("_side = 0").groupBy("_slot").agg(F.max_by(F.struct(key.alias("k"), "_right"), "_place").alias("last"))
    every = placed.select("_slot").distinct().join(parts, "_slot", "left")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_slot", F.last("last", ignorenulls=True).over(earlier).alias("_carry"))
    found = placed.withColumn("_own", F.last("_right", ignorenulls=True).over(inside)).join(F.broadcast(carried), "_slot")
    value = F.coalesce("_own", F.when(F.col("_carry.k") == key, F.col("_carry._right")))
    near = F.col("_fine")
    if within is not None:
        near = near & (F.col("_time") - value[right_time] <= within)
    lefts = [c for c in left.columns if c not in keys]
    return found.filter("_side = 1").select(
        *keys, *[F.col("_left")[c].alias(c) for c in lefts], F.when(near, value).alias(match)
    )
