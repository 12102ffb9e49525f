"""Helpers that several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that holds texts: long texts then stay a small part of a worker's memory.
TEXT_ROWS = 256

#: Rows of one part of a small table, and parts that it has at least.
PART_ROWS, PARTS = 16_384, 8

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """Let Arrow batches of this session hold at most so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))
    return df


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the folder of spark.checkpoint.dir; where none is named, under the warehouse."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    top = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are deleted at the end, but for those that are kept; these go with the scope around it."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffled rows of each query go when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """The same rows from a table in the shared folder: no lineage, and safe from lost executors.

    Inside `scratch` the table goes when the scope ends; with `keep` it stays for the scope around that.
    """
    path = shared_path(df.sparkSession, label)
    scopes = _SCOPES.get()[:-1] if keep else _SCOPES.get()
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most so many narrow rows, in no more parts than these need; small tables then aren't written as many files."""
    return df.coalesce(max(PARTS, -(-rows // PART_ROWS)))


def counted(df: DataFrame, label: str, keep: bool = False, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`written`, and aggregates of its rows that the write takes on the way: no job of their own."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), label, keep)
    return out, seen.get


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, a null as an empty text."""
    return [x or "" for x in column(batch, name).to_pylist()]


def rows_to_batch(names: Sequence[str], types: Sequence[pa.DataType], rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def crc_bucket(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links a-b: (member, least member of its component), roots left out."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        old = root.copy()
        np.minimum.at(root, old[u], low)
        np.minimum.at(root, old[v], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == old).all():
            break
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def components(links: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """(node, root): the least reachable node for every node of the undirected links, `most` at most if that is known.

    Alternates large-star and small-star rounds until every component is a star; each round is two shuffles of the
    links and its result is written to the shared folder. A node with very many neighbours costs no more
    than others: its minimum is combined before the shuffle, and the join back is one that Spark may split.
    The rows of that minimum also tell, as they are written, whether a round is needed at all.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, seen = counted(edges if most is None else few_parts(edges, most), "links", n=F.count("*"))
    n = seen["n"]  # rounds add no links, and n links have 2 n nodes at most
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        # settled when nobody is both a child and a root, and each child has one root
        least, seen = counted(few_parts(least, 2 * n), "least", n=F.count(F.when(F.expr("m < u AND c > 1"), 1)))
        if not seen["n"]:
            break
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(few_parts(large.filter("u <> v").distinct(), n), "star")
        least = written(few_parts(large.groupBy("u").agg(F.min("v").alias("m")), n), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(few_parts(small.filter("u <> v").distinct(), n), "star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def batches(rows: Iterator[tuple], names: Sequence[str], types: Sequence[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield rows_to_batch(names, types, held)
            held = []
    if held:
        yield rows_to_batch(names, types, held)
