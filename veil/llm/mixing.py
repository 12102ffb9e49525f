"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. The document rates nearest to 1 in relative entropy that meet it are
exponential in a document's size: rate = min(3, exp(lambda * size / scale)), with one lambda per source. The
lambdas are the solution of a convex dual, found by Newton steps for all sources at once: a step is one
aggregate of slopes and curvatures over all documents, kept within a bracket that is open at both ends at first, doubles
while an end is open and is halved whenever the plain step leaves it. Steps go on until every source is solved. The
rates are then rounded to whole copies: a document takes one copy more where its hash is below the
fraction, and one offset per source, found from histograms, moves those hash thresholds so that the sum
meets the target up to one document. What is left open is filled by the few documents that fit it best.

Sizes are counts of runs of other than ASCII white space; a null or empty text has size 0 and one copy at most (it
takes no words). Sources are in order of code points, null last; an empty string is a source of its own. A source
without words has target 0. Rows that repeat are rows of their own, dealt by doc_id, size and a number of
repetition. An empty table gives an empty result; extra columns pass
through `mixed`, except for those named like its results.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import scratch, written

WEIGHTS, LIMIT = (5.0, 2.0, 1.0), 3.0
#: The share of a target that the rates may leave open, and how often a step halves the bracket whatever Newton says.
OPEN, HALVING = 1e-4, 8
#: Offsets that one pass tells apart, and passes; together about as fine as the hashes.
CELLS, PASSES = 1024, 5
#: Documents per source that fill what the offset leaves open.
FITS = 4
#: Rows of one per source that are sent to all tasks at most; beyond that, copies are joined by row number.
SENT = 100_000
HASH_BITS, ID_BITS = 52, 40


def sizes(docs: DataFrame) -> DataFrame:
    """`docs` with size: the number of words of `text`."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("size", words.cast("long"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, n, source_size, largest, target) from rows of (source, size)."""
    per = written(
        sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.max("size").alias("largest")),
        "sources",
    )
    ranked = ranked_sources(per)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    weighed = written(ranked.withColumn("weight", own), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight among the sources that aren't at their limit
    while True:
        full = F.col("weight") * level > F.col("source_size") * limit
        taken, open_weight = weighed.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - taken) / open_weight if open_weight else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * limit)).drop("rank", "weight")


def ranked_sources(per: DataFrame) -> DataFrame:
    """`per` with rank: 0-based place of the source by code point, null last; ranges are ranked side by side."""
    tasks = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.col("source").isNull()
    ranges = per.withColumn("_none", none).repartitionByRange(tasks, "_none", "source").withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_none", "source"))
    return ranges.withColumn("_at", inside).join(before, "_range").withColumn("rank", F.col("_at") - 1 + F.col("_before")).drop("_range", "_none", "_at", "_before")


def rates(docs: DataFrame, targets: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(source, lam, scale): the dual solution; rate = min(limit, exp(lam * size / scale)).

    Sources at a limit need no tilt: those with target 0 have lam null and rate 0, those with target = limit x size have rate `limit`.
    """
    # equal sizes of one source have equal rates: their counts are all that the steps read
    counts = written(docs.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("c")), "size-counts")
    state = targets.filter("target > 0").select(
        "source", "target", F.col("source_size").cast("double").alias("s"), F.col("largest").cast("double").alias("scale"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    state = written(state.withColumn("done", F.col("target") >= limit * F.col("s") * (1 - 1e-12)), "dual")
    for turn in itertools.count(1):
        open_rows = state.filter("not done")
        z = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(60.0)))
        capped = rate >= limit
        slopes = (
            counts.join(open_rows.select("source", "lam", "scale"), counts["source"].eqNullSafe(open_rows["source"]))
            .groupBy(counts["source"])
            .agg(
                F.sum(F.col("c") * F.col("size") * F.when(capped, F.lit(limit)).otherwise(rate)).alias("f"),
                F.sum(F.when(~capped, F.col("c") * F.col("size") * z * rate).otherwise(0.0)).alias("d"),
            )
        )
        gap = F.col("f") - F.col("target")
        low = F.when(gap < 0, F.greatest(F.coalesce("low", "lam"), "lam")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.least(F.coalesce("high", "lam"), "lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.when(F.col("d") > 0, F.col("d"))
        # a step beyond the bracket is halved; where an end is open, the search doubles and steps are bounded
        both = F.col("low2").isNotNull() & F.col("high2").isNotNull()
        middle = (
            F.when(F.col("high2").isNull(), F.greatest(F.col("low2") * 2, F.lit(1.0)))
            .when(F.col("low2").isNull(), F.least(F.col("high2") * 2, F.lit(-1.0)))
            .otherwise((F.col("low2") + F.col("high2")) / 2)
        )
        inside = (
            F.col("step").isNotNull() & (F.col("low2").isNull() | (F.col("step") > F.col("low2"))) & (F.col("high2").isNull() | (F.col("step") < F.col("high2")))
            & (both | (F.abs(F.col("step")) < F.abs("lam") * 8 + 16)) & ~(both & F.lit(turn % HALVING == 0))
        )
        # no number lies between the ends
        closed = F.coalesce(both & ((middle <= F.col("low2")) | (middle >= F.col("high2"))), F.lit(False))
        moved = (
            state.join(slopes.withColumnRenamed("source", "src"), state["source"].eqNullSafe(F.col("src")), "left")
            .withColumn("met", F.coalesce(F.abs(gap) <= OPEN * F.col("target"), F.lit(True)))
            .withColumn("low2", low).withColumn("high2", high).withColumn("step", step)
            .withColumn("met", F.col("met") | closed)
            .select(
                "source", "target", "s", "scale",
                F.when(F.col("done") | F.col("met"), F.col("lam")).when(inside, F.col("step")).otherwise(middle).alias("lam"),
                F.when(F.col("done"), F.col("low")).otherwise(F.col("low2")).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(F.col("high2")).alias("high"),
                (F.col("done") | F.col("met")).alias("done"),
            )
        )
        state = written(moved, "dual")
        if state.filter("not done").isEmpty():
            break
    at_limit = F.col("target") >= limit * F.col("s") * (1 - 1e-12)
    return state.select("source", F.when(at_limit, F.lit(float("inf"))).otherwise(F.col("lam")).alias("lam"), "scale")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT, prefix: str = "") -> DataFrame:
    """`docs` (doc_id, source, text and others) with size, source_size, target and copies; 0 copies where the mix has none.

    The results' names begin with `prefix`; columns of `docs` with such a name are left out. `docs` is a table that is
    read alike each time: its rows are numbered. A row's copies follow from its own columns and one row of its source, so no
    text is moved while there are at most `SENT` sources and as many fillers.
    """
    key = F.monotonically_increasing_id()
    slim = sizes(docs.select("doc_id", "source", "text")).select(key.alias("_row"), "doc_id", "source", "size")
    results = ["size", "source_size", "target", "copies"]
    tilts, extra = solved(slim, weights, limit)
    rows = docs.drop(*[prefix + c for c in results]).withColumn("__row", key)
    if tilts.count() > SENT:
        found = _with_copies(slim, tilts, extra, limit).select(F.col("_row").alias("__row"), *[F.col(c).alias(prefix + c) for c in results])
        return rows.join(found, "__row").drop("__row")
    inner = F.struct(*[F.col(c) for c in rows.columns])
    given = sizes(rows.select(inner.alias("__doc"), F.col("__row").alias("_row"), "doc_id", "source", "text"))
    found = _with_copies(given.drop("text"), F.broadcast(tilts), extra, limit)
    return found.select(*[F.col("__doc")[c].alias(c) for c in rows.columns if c != "__row"], *[F.col(c).alias(prefix + c) for c in results])


def copies(sized: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """`sized` (_row, doc_id, source, size) with source_size, target and copies."""
    sized = written(sized, "sizes")
    tilts, extra = solved(sized, weights, limit)
    return _with_copies(sized, tilts, extra, limit).select("_row", "doc_id", "source", "size", "source_size", "target", "copies")


def solved(sized: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """One row per source, (src, source_size, target, lam, scale, offset), and the fillers, (_row, extra)."""
    with scratch(sized.sparkSession):
        sized = written(sized, "sizes")
        targets = written(source_targets(sized, weights, limit), "targets")
        dual = rates(sized, targets, limit)
        both = written(
            targets.join(dual.withColumnRenamed("source", "src"), targets["source"].eqNullSafe(F.col("src")), "left")
            .select(targets["source"].alias("src"), "source_size", "target", "lam", "scale"),
            "tilts",
        )
        rated = written(_rated(sized, both, limit).select("_row", "source", "size", "target", "rate", "u"), "rates")
        offset = offsets(rated, limit)
        tilts = written(
            both.join(offset.select(F.col("source").alias("own"), "offset"), F.col("src").eqNullSafe(F.col("own")), "left").drop("own"),
            "tilts", keep=True,
        )
        placed = _taken(sized, tilts, limit)
        extra = fillers(placed.filter((F.col("size") > 0) & (F.col("copies") < limit) & (F.col("target") > 0)), offset)
        return tilts, written(extra, "fillers", keep=True)


def _rated(rows: DataFrame, tilts: DataFrame, limit: float) -> DataFrame:
    """`rows` (_row, doc_id, source, size and others) with their source's columns, rate and hash."""
    raw = F.when(F.col("lam").isNull(), F.lit(0.0)).when(F.col("lam") == float("inf"), F.lit(limit)).otherwise(
        F.least(F.lit(limit), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(60.0))))
    )
    # the hash of the doc_id orders documents, however the table is split; its last bits set repeated rows apart
    low = HASH_BITS - ID_BITS
    bits = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ID_BITS), low) + F.shiftrightunsigned(F.xxhash64("_row"), 64 - low)
    u = (bits.cast("double") + 0.5) / float(1 << HASH_BITS)
    return rows.join(tilts, rows["source"].eqNullSafe(F.col("src"))).drop("src").withColumn("rate", raw).withColumn("u", u)


def _taken(rows: DataFrame, tilts: DataFrame, limit: float) -> DataFrame:
    """`rows` with the copies that rates and offsets give."""
    taken = F.greatest(F.lit(0.0), F.least(F.lit(limit), F.ceil(F.col("rate") + F.coalesce("offset", F.lit(0.0)) - F.col("u")).cast("double")))
    return _rated(rows, tilts, limit).withColumn("copies", F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(taken).cast("long"))


def _with_copies(rows: DataFrame, tilts: DataFrame, extra: DataFrame, limit: float) -> DataFrame:
    """`rows` with all their copies, fillers included."""
    side = F.broadcast(extra) if extra.count() <= SENT else extra
    return _taken(rows, tilts, limit).join(side, "_row", "left").withColumn(
        "copies", (F.col("copies") + F.coalesce("extra", F.lit(0))).cast("long")
    )


def fillers(open_rows: DataFrame, offset: DataFrame) -> DataFrame:
    """(_row, extra): per source, up to `FITS` times the largest document that fits what the target leaves open, once each."""
    slim = written(open_rows.select("_row", "source", "size", "u"), "open")
    state = offset.select("source", "rest", F.lit(None).cast("struct<size:bigint,u:double,_row:bigint>").alias("best"))
    found: list[DataFrame] = []
    for _ in range(FITS):
        own = state.select(F.col("source").alias("src"), "rest", F.col("best").alias("last"))
        row = F.struct("size", "u", "_row")
        fits = slim.join(own, slim["source"].eqNullSafe(F.col("src"))).filter(
            (F.col("size") <= F.col("rest")) & (F.col("last").isNull() | (row < F.col("last")))
        )
        state = written(
            state.drop("best").join(fits.groupBy("src").agg(F.max(row).alias("best")), state["source"].eqNullSafe(F.col("src")))
            .select("source", (F.col("rest") - F.col("best.size")).alias("rest"), "best"),
            "fits",
        )
        found.append(state.select(F.col("best._row").alias("_row"), F.lit(1).alias("extra")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def offsets(rated: DataFrame, limit: float) -> DataFrame:
    """(source, offset, rest): copies = ceil(rate + offset - u), within 0 and the limit, stay below the target by
    `rest` words, less than one document.

    Raising the offset by up to 1 adds one copy to a document where it passes u - rate + k. Each pass sums the words
    that cross in `CELLS` cells of a source's interval and keeps the cell in which the target is crossed.
    """
    words = F.col("size").cast("double")
    base = F.ceil(F.col("rate") - 1 - F.col("u"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(limit), c.cast("double")))
    # from offset -1 to 1 a document crosses twice, at these offsets
    first = F.col("u") - F.col("rate") + base
    steps = F.array(*[F.struct((first + k).alias("at"), (words * (clamp(base + k + 1) - clamp(base + k))).alias("w")) for k in range(3)])
    live = rated.filter((F.col("size") > 0) & (F.col("target") > 0))
    state = live.groupBy("source").agg(F.first("target").alias("target"), F.sum(words * clamp(base)).alias("have"))
    state = written(state.withColumn("low", F.lit(-1.0)).withColumn("width", F.lit(2.0)), "offsets")
    crossings = live.select("source", F.explode(steps).alias("x")).select("source", "x.at", "x.w").filter("w > 0")
    for _ in range(PASSES):
        own = state.select(F.col("source").alias("src"), "low", "width")
        cell = F.floor((F.col("at") - F.col("low")) / (F.col("width") / CELLS))
        cells = (
            crossings.join(own, crossings["source"].eqNullSafe(F.col("src")))
            .withColumn("cell", cell).filter((F.col("cell") >= 0) & (F.col("cell") < CELLS))
            .groupBy("src", "cell").agg(F.sum("w").alias("w"))
        )
        # CELLS rows of a source at most
        sums = cells.withColumn("upto", F.sum("w").over(Window.partitionBy("src").orderBy("cell")))
        sums = sums.join(state.select("source", "target", "have"), F.col("src").eqNullSafe(F.col("source")))
        # the last cell that the target is not passed before
        crossed = sums.filter(F.col("have") + F.col("upto") - F.col("w") <= F.col("target")).groupBy("src").agg(
            F.max_by(F.struct("cell", (F.col("upto") - F.col("w")).alias("before")), "cell").alias("c")
        )
        state = written(
            state.join(crossed, state["source"].eqNullSafe(F.col("src")), "left").select(
                "source", "target", (F.col("have") + F.coalesce("c.before", F.lit(0.0))).alias("have"),
                (F.col("low") + F.coalesce("c.cell", F.lit(0)) * F.col("width") / CELLS).alias("low"),
                (F.col("width") / CELLS).alias("width"),
            ),
            "offsets",
        )
    return state.select("source", F.col("low").alias("offset"), (F.col("target") - F.col("have")).alias("rest"))


def repeated(mix: DataFrame, columns: Sequence[str], copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as it has copies."""
    return mix.filter(F.col(copies) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns)
