"""Centroid clustering over a VA-file.

Components become integers, floor(1024 * x). Each vector also gets an approximation of a few bits per dimension: the number of
the cell its component falls into. For a centroid, a lookup table holds per dimension and cell the least and greatest that the
component can add to the squared distance; two sums of lookups bound the distance. What all centroids have in common,
the vector's squared length, is left out of both bounds, so they are as tight as the cells allow. A vector whose
nearest centroid is certain from the intervals is settled; only where intervals overlap is the full vector read.

The sums of the clusters are carried from round to round: a vector is read in full if the approximation can't settle its old or
its new cluster, or if the two differ, and its move is added to the sums. So a round reads few full vectors once the
centroids have calmed down. The full vector lies in the same row as its cells, as fetching it by a join would move more than the
whole table. Every round is one pass without a shuffle of vectors: 8 times 65 sums come back. All arithmetic is on integers
and exact, so the result depends neither on the cells nor on how the table is split.

Cells follow quantiles of a bounded sample, their outer edges the least and greatest component of all vectors; the sample
changes what is read in full, never the result. Rows without exactly 64 components, or with null or non-finite ones, are
left out. Components are held within +-2^26, so that distances fit in a long. Rows without a vec_id are clustered but are
never first centroids. Repeated rows are vectors of their own; equal centroids leave the one with the larger
number empty, and it stays where it is. Fewer than 8 vectors give fewer centroids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import column, small_batches, written

DIMS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Bits of a cell number; vectors that the inner edges of the cells are drawn from.
BITS, SAMPLE = 4, 16_384
#: Largest size of a component.
LARGEST = 1 << 26
#: Vectors of one Arrow batch.
ROWS = 4096


def whole_components(values: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a list column are kept, and their components as integers."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    if not len(at):
        return at, np.zeros((0, dims), np.int64)
    x = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    finite = np.isfinite(x).all(axis=1)
    limit = float(LARGEST)
    return at[finite], np.floor(np.clip(x[finite], -limit / SCALE, limit / SCALE) * SCALE).astype(np.int64)


def vectors_of(table: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, data) of the kept vectors: components as little-endian 32-bit integers."""
    vec_id = table.schema["vec_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, x = whole_components(column(batch, "embedding"), dims)
            data = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id").take(pa.array(at)), data], ["vec_id", "data"])

    return small_batches(table.select("vec_id", "embedding"), ROWS).mapInArrow(run, f"vec_id {vec_id}, data binary")


def matrix(data: pa.Array, dims: int = DIMS) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def cell_edges(vectors: DataFrame, dims: int = DIMS, bits: int = BITS, sample: int = SAMPLE) -> np.ndarray:
    """dims x (cells + 1): the first and last edge are the least and greatest component of all vectors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, LARGEST), np.full(dims, -LARGEST)
        for batch in it:
            if batch.num_rows:
                x = matrix(column(batch, "data"), dims)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    ends = small_batches(vectors.select("data"), ROWS).mapInArrow(run, "dim int, low long, high long")
    ends = {r["dim"]: r for r in ends.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low, high = (np.array([ends[d][side] if d in ends else 0 for d in range(dims)], np.int64) for side in ("low", "high"))
    share = vectors.select("data", F.xxhash64("data", "vec_id").alias("h")).orderBy("h").limit(sample)
    x = matrix(share.toArrow()["data"].combine_chunks(), dims)
    cells = 1 << bits
    inner = np.quantile(x, np.arange(1, cells) / cells, axis=0).astype(np.int64) if len(x) else np.zeros((cells - 1, dims), np.int64)
    return np.concatenate([low[:, None], np.clip(inner.T, low[:, None], high[:, None]), high[:, None] + 1], axis=1)


def packed(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cell numbers in `bits` bits each, row by row."""
    wide = np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :]
    return np.packbits(wide.reshape(len(cells), -1), axis=1)


def unpacked(raw: pa.Array, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    width = -(-dims * bits // 8)
    rows = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, width)
    if bits == 4 and dims % 2 == 0:
        return np.stack([rows >> 4, rows & 15], axis=2).reshape(len(rows), dims)
    wide = np.unpackbits(rows, axis=1)[:, : dims * bits].reshape(len(rows), dims, bits)
    return np.packbits(wide, axis=2)[:, :, 0] >> (8 - bits)


def approximated(vectors: DataFrame, edges: np.ndarray, bits: int = BITS) -> DataFrame:
    """`vectors` with `cells`, their approximation."""
    vec_id, dims = vectors.schema["vec_id"].dataType.simpleString(), len(edges)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = matrix(column(batch, "data"), dims)
            cells = np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], "right") for d in range(dims)], axis=1)
            raw = pa.array([r.tobytes() for r in packed(cells, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), raw, column(batch, "data")], ["vec_id", "cells", "data"])

    return small_batches(vectors, ROWS).mapInArrow(run, f"vec_id {vec_id}, cells binary, data binary")


class Intervals:
    """Lookup tables of one set of centroids: bounds of the squared distance without the vector's own length."""

    def __init__(self, centroids: np.ndarray, edges: np.ndarray) -> None:
        first, last = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        c = centroids[:, :, None]
        ends = c * c - 2 * c * first[None], c * c - 2 * c * last[None]
        self.low, self.high = np.minimum(*ends), np.maximum(*ends)
        self.centroids = centroids

    def settled(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid with the least upper bound, and whether no other can be as near (or, with a smaller number, equally near)."""
        dims = np.arange(cells.shape[1])
        low = np.stack([table[dims, cells].sum(axis=1) for table in self.low], axis=1)
        high = np.stack([table[dims, cells].sum(axis=1) for table in self.high], axis=1)
        best = high.argmin(axis=1)
        bound = high[np.arange(len(best)), best][:, None]
        beaten = (low > bound) | ((low == bound) & (np.arange(low.shape[1]) > best[:, None]))
        beaten[np.arange(len(best)), best] = True
        return best, beaten.all(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Of full vectors, the number of the nearest centroid; ties go to the smaller number."""
        c = self.centroids
        return ((c * c).sum(axis=1)[None] - 2 * (x @ c.T)).argmin(axis=1)


def moves(file: DataFrame, edges: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> dict[tuple[int, int], int]:
    """What (cluster, dimension) gains when vectors go from their nearest centroid of `old` to that of `new`; dimension -1 counts vectors.

    Without `old` all vectors are gained. Key (-1, -1) counts the vectors that were read in full.
    """
    dims, k = new.shape[1], len(new)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = Intervals(new, edges)
        before = Intervals(old, edges) if old is not None else None
        sums, counts, read = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for batch in it:
            if not batch.num_rows:
                continue
            cells = unpacked(column(batch, "cells"), dims)
            to, sure = after.settled(cells)
            if before is None:
                needed = np.ones(len(to), bool)
            else:
                since, was_sure = before.settled(cells)
                needed = ~sure | ~was_sure | (since != to)
            at = np.flatnonzero(needed)
            if not len(at):
                continue
            x = matrix(column(batch, "data").take(pa.array(at)), dims)
            read += len(at)
            for side, sign in ((after, 1), (before, -1)):
                if side is not None:
                    own = (side.nearest(x)[:, None] == np.arange(k)).astype(np.int64)
                    sums += sign * (own.T @ x)
                    counts += sign * own.sum(axis=0)
        rows = [(-1, -1, read), *((c, -1, int(counts[c])) for c in range(k)), *((c, d, int(sums[c, d])) for c in range(k) for d in range(dims))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "gain"])

    found = small_batches(file.select("cells", "data"), ROWS).mapInArrow(run, "cluster int, dim int, gain long")
    total = found.groupBy("cluster", "dim").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain"))
    return {(r["cluster"], r["dim"]): int(r["gain"]) for r in total.collect()}  # 65 rows per centroid


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED, dims: int = DIMS) -> np.ndarray:
    """The vectors with the least SHA-256 of `seed:vec_id`."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.filter("vec_id is not null").select(name.alias("name"), "data").orderBy("name", "data").limit(k).collect()
    return np.array([np.frombuffer(r["data"], "<i4") for r in rows], np.int64).reshape(-1, dims)


def fit(file: DataFrame, edges: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after `rounds` rounds; ends sooner where a round changes none, as the rest would change none either."""
    old, now = None, start
    k, dims = start.shape
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for _ in range(rounds if k else 0):
        gain = moves(file, edges, old, now)
        for (c, d), g in gain.items():
            if c >= 0 and d < 0:
                counts[c] += g
            elif c >= 0:
                sums[c][d] += g
        following = np.array([[s // counts[c] for s in sums[c]] if counts[c] else now[c] for c in range(k)], np.int64)
        if (following == now).all():
            break
        old, now = now, following
    return now


def assigned(file: DataFrame, edges: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector: cells settle the cluster where they can, the distance is exact."""
    vec_id, dims = file.schema["vec_id"].dataType.simpleString(), centroids.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Intervals(centroids, edges)
        for batch in it:
            x = matrix(column(batch, "data"), dims)
            cluster, sure = tables.settled(unpacked(column(batch, "cells"), dims))
            cluster[~sure] = tables.nearest(x[~sure])
            distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return small_batches(file, ROWS).mapInArrow(run, f"vec_id {vec_id}, cluster int, distance long")


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def clustered(table: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of `table` (vec_id, embedding)."""
    spark = table.sparkSession
    vectors = written(vectors_of(table), "vectors")
    edges = cell_edges(vectors)
    file = written(approximated(vectors, edges), "va-file")
    centroids = fit(file, edges, first_centroids(vectors), rounds)
    if not len(centroids):  # rows without a vec_id alone
        file, centroids = file.filter("false"), np.zeros((1, DIMS), np.int64)
    rows = written(assigned(file, edges, centroids), "assigned")
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, inertia[c], sum(inertia.values()), digest(centroids[c])) for c in inertia]  # one row per centroid
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The rounds written out one after the other, on full vectors."""
    parts = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, sha256('{SEED}:' || vec_id) AS name,
                   list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIMS}
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS k, x AS c FROM kept ORDER BY name LIMIT {CENTROIDS}
        )"""]
    for n in range(rounds + 1):
        parts.append(f"""
        a{n} AS MATERIALIZED (
            SELECT r, any_value(x) AS x, any_value(vec_id) AS vec_id, min(d) AS d, arg_min(k, d * 100 + k) AS k
            FROM (SELECT r, vec_id, x, k, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
                  FROM kept CROSS JOIN c{n}) GROUP BY r
        )""")
        if n < rounds:
            parts.append(f"""
        c{n + 1} AS MATERIALIZED (
            SELECT c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
                SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
                FROM (SELECT k, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
                      FROM (SELECT k, unnest(x) AS v, unnest(range(1, {DIMS + 1})) AS i FROM a{n}) GROUP BY k, i) GROUP BY k
            ) m ON c{n}.k = m.k
        )""")
    return "WITH" + ",".join(parts) + f"""
        SELECT vec_id, a{rounds}.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON a{rounds}.k = c{rounds}.k
    """
