"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A fingerprint has 64 bits, taken by majority over the XXH64 values of a text's word shingles. Equal fingerprints
are folded first, so copies cost one row. The distinct ones are dealt over shards by the upper levels of a
vantage-point tree: a node has a vantage fingerprint v and a radius m; what lies within m goes inside, what lies
beyond goes outside, and what is inside but less than `radius` from the border goes to both. By the triangle
inequality, two fingerprints within `radius` of each other then meet in at least one shard. Each shard goes on with the
same split in memory until few are left, and compares those. Shards report spanning links of their own groups, never
all pairs; the links of all shards are joined to components on the executors.

The tree's upper levels are drawn from a bounded sample of fingerprints, so one dense cluster is split like
any other region. Null texts count as empty. Texts without words have fingerprint zero, linked like any other.
Rows that repeat are rows of their own. Rows with a null doc_id get a component like others, but never name it,
unless all rows of the component have none. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import column, components, forest, popcount, small_batches, texts_of, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Most fingerprints of the sample that the upper tree is drawn from, and fingerprints that a shard should hold.
SAMPLE, SHARD = 1 << 20, 32_768
#: Fingerprints of the sample for each shard.
DRAWN = 16
#: Groups of this size are compared pair by pair.
LEAF = 96


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = max(1, len(words) - shingle + 1)
    ends = starts[shingle : shingle + n] - 1 if len(words) > shingle else np.array([len(line)])
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """`docs` without the text, with `out`: the fingerprint as a signed 64-bit integer."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), pa.array(fps, pa.int64())], [*(f.name for f in keep), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` long"])
    return small_batches(docs).mapInArrow(run, schema)


def _split(fps: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage fingerprint, the radius that halves `fps`, and their distances; None where no radius splits them."""
    # the fingerprint farthest from the first one sees a cluster from its edge, which splits best
    v = fps[int(popcount(fps ^ fps[0]).argmax())]
    d = popcount(fps ^ v)
    low, high = int(d.min()), int(d.max())
    if low == high:
        return None
    return v, min(int(np.median(d)), high - 1), d


def upper_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer); a child below zero is the shard ~child. Without nodes, all is shard 0."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def build(fps: np.ndarray, want: int) -> int:
        nonlocal shards
        found = _split(fps) if want > 1 and len(fps) > 4 else None
        if found is None:
            shards += 1
            return -shards
        v, m, d = found
        at = len(nodes)
        nodes.append((int(v), m, 0, 0))
        nodes[at] = (int(v), m, build(fps[d <= m], want // 2), build(fps[d > m], want - want // 2))
        return at

    build(sample, leaves)
    return nodes


def shards_of(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, shard) for every shard that a fingerprint belongs to."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64)
    found: list[tuple[np.ndarray, int]] = []
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            found.append((rows, ~at))
            continue
        v, m, inner, outer = nodes[at]
        d = popcount(fps[rows] ^ np.uint64(v)).astype(np.int64)
        todo.append((inner, rows[d <= m]))
        todo.append((outer, rows[d > m - radius]))
    return np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), s) for r, s in found])


def links_within(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of the distinct `fps` that lie within `radius` of each other."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    todo, held = [fps], 0
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        found = _split(part) if len(part) > LEAF else None
        if found:
            _, m, d = found
            inner, outer = part[d <= m], part[d.astype(np.int64) > m - radius]
            if len(inner) < len(part) and len(outer) < len(part):
                todo += [inner, outer]
                continue
        for at in range(0, len(part), LEAF):
            near = popcount(part[at : at + LEAF, None] ^ part[None, at:]) <= radius
            i, j = np.nonzero(near)
            i, j = i[j > i], j[j > i]
            if len(i):
                a.append(part[at + i])
                b.append(part[at + j])
                held += len(i)
        if held > 2_000_000:  # keep what spans, not all pairs
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


def near_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that span every group of the distinct values in `fps` (one column, fp)."""
    distinct = written(fps.select("fp").filter("fp is not null").distinct(), "fingerprints")
    n = distinct.count()
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    want = min(max(-(-n // shard), tasks), SAMPLE // DRAWN)
    drawn = distinct.orderBy(F.xxhash64("fp"), "fp").limit(want * DRAWN).toArrow()["fp"].to_numpy().astype(np.int64)
    nodes = upper_tree(drawn.view(np.uint64), want)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = column(batch, "fp").to_numpy().view(np.uint64)
            at, to = shards_of(own, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array(to, pa.int32())], ["fp", "shard"])

    def compare(table: pa.Table) -> pa.Table:
        a, b = links_within(table["fp"].to_numpy().view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "fp long, shard int")
    return dealt.groupBy("shard").applyInArrow(compare, "a long, b long")


def placed(fps: DataFrame, first, radius: int) -> DataFrame:
    """(fp, first, root) per fingerprint of `fps`: `first` is the least of that column, roots name components."""
    firsts = written(fps.groupBy("fp").agg(F.min(first).alias("first")), "firsts")
    roots = components(near_links(fps, radius), "a", "b")
    return firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fp, component_id (smallest doc_id that links reach)."""
    fps = written(with_fingerprints(docs.select("doc_id", "text"), shingle=shingle), "fps")
    found = placed(fps, F.col("doc_id"), radius)
    named = written(found.groupBy("root").agg(F.min("first").alias("component_id")).join(found.select("fp", "root"), "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stay: one per component, with the smallest doc_id (null last, then by row).

    `docs` is a table that is read alike each time: its rows are numbered.
    """
    key = F.monotonically_increasing_id()
    fps = written(with_fingerprints(docs.select(key.alias("row"), "doc_id", "text"), shingle=shingle), "fps")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = placed(fps, best, radius).groupBy("root").agg(F.min("first").alias("best")).select(F.col("best.row").alias("__row"))
    return docs.withColumn("__row", key).join(written(kept, "kept"), "__row", "left_semi").drop("__row")
