"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All blocks are sorted and equal ones get the
same integer name; then adjacent names are paired and the pairs are named the same way, until each text has
one name. No hash stands for a text: two rows get one name only if all their bytes are equal.

The sort is by a 64-bit hash of the block, then by the block itself, then by row number. It deals equal blocks
over several tasks when there are many of them, so a passage that a third of all texts share does not meet in one
task. Names are (first sorted part that holds the block, rank inside that part); where the blocks of one hash span
parts, every distinct one of them takes its name from the first part that holds it. Blocks are told apart by their
bytes, also those of one hash.

Nulls count as empty texts; an empty text is one empty block. Repeated rows, also of one doc_id, are rows of
their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import batches, column, small_batches, texts_of, written

#: Bytes of a block.
BLOCK = 4096
#: Sorted parts are made of about so many blocks.
PART_ROWS = 40_000

SPACES = re.compile("[ \t-\r]+")


def normalised(text: str) -> bytes:
    """The text in UTF-8 with one space for each run of ASCII white space."""
    return SPACES.sub(" ", text).encode("utf-8", "surrogatepass")


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, pos, n, bytes, doc_id, sha): the blocks of every row; doc_id and digest stand at pos 0 only."""
    schema = "row long, pos int, n int, bytes binary, doc_id long, sha string"
    names = ["row", "pos", "n", "bytes", "doc_id", "sha"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in it:
                rows, ids = column(batch, "row").to_pylist(), column(batch, "doc_id").to_pylist()
                for row, doc, text in zip(rows, ids, texts_of(batch, "text")):
                    data = normalised(text)
                    n = max(1, -(-len(data) // block))
                    yield row, 0, n, data[:block], doc, hashlib.sha256(data).hexdigest()
                    for pos in range(1, n):
                        yield row, pos, n, data[pos * block : (pos + 1) * block], None, None

        yield from batches(each(), names, types)

    # the row number is taken once: what comes after works on one written copy of the numbered blocks
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return small_batches(numbered).mapInArrow(cut, schema)


def named(df: DataFrame, keys: list[str], out: str, parts: int) -> DataFrame:
    """Replace `keys` by an integer name, equal exactly for equal keys; all by one sort over `parts` parts.

    `keys` are non-null. The column `row` breaks ties for the sort, so equal keys may span parts.
    """
    rest = [f for f in df.schema.fields if f.name not in keys]
    kinds = [df.schema[k] for k in keys]
    columns = [f.name for f in rest] + ["part", "rank", "edge", *(f"edge_{k}" for k in keys)]

    def rank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, before, opening = TaskContext.get().partitionId(), -1, None, None
        for batch in it:
            if batch.num_rows == 0:
                continue
            cols = [column(batch, k) for k in keys]
            fresh = None
            for c in cols:
                differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
                fresh = differs if fresh is None else pc.or_(fresh, differs)
            first = tuple(c[0].as_py() for c in cols)
            steps = [0 if first == before else 1, *(int(x) for x in fresh.to_pylist())]
            before = tuple(c[len(c) - 1].as_py() for c in cols)
            ranks = []
            for s in steps:
                at += s
                ranks.append(at)
            # a part may share its first and its last hash with others: the first row of each key of these shows it, and
            # as the last hash isn't known before the end, so does the last hash of each batch
            places = column(batch, "place").to_pylist()
            opening = places[0] if opening is None else opening
            edge = [p if s and p in (opening, places[-1]) else None for s, p in zip(steps, places)]
            shown = pa.array([e is not None for e in edge])
            n = len(ranks)
            yield pa.RecordBatch.from_arrays(
                [column(batch, f.name) for f in rest]
                + [pa.array([part] * n, pa.int32()), pa.array(ranks, pa.int64()), pa.array(edge, pa.int64())]
                + [pc.if_else(shown, c, pa.scalar(None, c.type)) for c in cols],
                columns,
            )

    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in rest]
        + ["part int, rank long, edge long"]
        + [f"edge_{k.name} {k.dataType.simpleString()}" for k in kinds]
    )
    # ranges are drawn over hashes of the keys, so their sample is small however long the keys are
    place = F.xxhash64(*keys)
    ordered = df.withColumn("place", place).repartitionByRange(parts, "place", "row").sortWithinPartitions("place", *keys, "row")
    ranked = written(ordered.mapInArrow(rank, schema), "ranks")
    # a key that several parts hold has its name from the first of them; a few rows per part
    edges = [f"edge_{k}" for k in keys]
    shown = ranked.filter("edge is not null").select("part", "rank", "edge", *edges)
    spans = shown.groupBy("edge").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("edge")
    shown = written(shown.join(spans, "edge"), "edges")
    heads = shown.join(shown.groupBy("edge", *edges).agg(F.min(F.struct("part", "rank")).alias("head")), ["edge", *edges])
    heads = heads.filter("head.part <> part").select("part", "rank", F.col("head.part").alias("p"), F.col("head.rank").alias("r"))
    name = lambda p, r: F.shiftleft(p.cast("long"), 40) + r
    return ranked.join(heads, ["part", "rank"], "left").select(
        *[f.name for f in rest],
        name(F.coalesce("p", "part"), F.coalesce("r", "rank")).alias(out),
    )


def identities(docs: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """(row, doc_id, sha, n, name): rows have equal normalised texts exactly if (n, name) are equal."""
    spark = docs.sparkSession
    first = blocks(docs, block)
    sized = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(block) + 1)).first()[0] or 0
    level = written(named(first, ["bytes"], "name", _parts(spark, sized, part_rows)), "level")
    done = [level.filter("n = 1").select("row", "n", F.col("n").alias("left"), "name")]
    owners = level.filter("pos = 0").select("row", "doc_id", "sha", F.col("n").alias("blocks"))
    left = level.filter("n > 1").select("row", "pos", F.col("n"), F.col("n").alias("left"), "name")
    while True:
        size = left.count()
        if size == 0:
            break
        half: Column = F.shiftright("pos", 1)
        even = (F.col("pos") % 2) == 0
        # a last block without a partner is paired with -1, which is no name
        pairs = left.groupBy("row", "n", "left", half.alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = pairs.withColumn("left", F.shiftright(F.col("left") + 1, 1))
        level = written(named(pairs, ["a", "b"], "name", _parts(spark, size / 2, part_rows * 8)), "level")
        done.append(level.filter("left = 1").select("row", "n", "left", "name"))
        left = level.filter("left > 1").select("row", "pos", "n", "left", "name")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return owners.join(found.select("row", "n", "name"), "row").select("row", "doc_id", "sha", "n", "name")


def _parts(spark, rows: float, part_rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // part_rows) + 1)


def exact_duplicates(docs: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the smallest doc_id stays (null last); of repeated rows with that doc_id, one.
    """
    found = written(identities(docs, block, part_rows), "identities")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = written(found.groupBy("n", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    return found.join(groups, ["n", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), "row",
    )


def deduplicated(docs: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = exact_duplicates(docs, block, part_rows).filter("kept").select(F.col("row").alias("__row"))
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return numbered.join(kept, "__row", "left_semi").drop("__row")
