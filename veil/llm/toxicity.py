"""Toxicity: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters, digits and apostrophes in lower case. Features are the distinct hashes of single
words, adjacent pairs, triples and pairs that skip one word, over the whole text; each counts once per document.
The weights are fitted by the driver on a bounded sample of labelled rows, with a learning rate of its own for
each coordinate and L1 shrinkage, which leaves few weights that are not zero. Only those are sent to the tasks.

The evidence of a document is the sum of its weights, so one passage in a long text counts as much as in a short
one. A null text counts as empty; empty texts have only the intercept. Labels that are null, or whose document is
missing, are not learned from; of several labels of one document the largest counts. Without labels the score is
0.5. Repeated rows get equal scores; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import column, small_batches, texts_of, written

#: Most labelled rows that the weights are fitted on; the sample is the same in every run.
SAMPLE = 20_000
#: Most features of all rows that the driver takes, 4 bytes each; the sample ends where they are reached, and a longer text is none of it.
FEATURES = 40_000_000
#: Hash buckets; the first is the intercept.
BUCKETS = 1 << 21
#: Documents with this score or more count as toxic.
TOXIC = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.5, 8

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct bucket numbers of one text, the intercept first."""
    words = WORD.findall(text.lower())
    seen: dict[str, int] = {}
    for w in words:
        if w not in seen:
            seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    one, two, three, skip = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    grams = [h * one, (h[:-1] * two) ^ (h[1:] * three + one), ((h[:-2] * three) ^ (h[1:-1] * two)) * one + h[2:] * skip, (h[:-2] * skip) ^ (h[2:] * one + two)]
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    mixed *= two
    at = np.unique((mixed >> np.uint64(32)) % np.uint64(buckets - 1) + np.uint64(1)).astype(np.int64)
    return np.concatenate([[0], at])


@dataclass(frozen=True)
class Weights:
    """The weights that are not zero, by bucket."""

    at: np.ndarray
    value: np.ndarray

    def dense(self, buckets: int = BUCKETS) -> np.ndarray:
        w = np.zeros(buckets, np.float32)
        w[self.at] = self.value
        return w


def learn(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows in the order given, `epochs` times."""
    z, n = np.zeros(buckets), np.zeros(buckets)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        free = at == 0  # the intercept isn't shrunk
        return np.where((np.abs(zi) <= L1) & ~free, 0.0, w)

    for _ in range(epochs):
        for at, label in zip(rows, y):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    used = np.flatnonzero(n)
    w = weights(used)
    return Weights(used[w != 0], w[w != 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Weights:
    """Weights from at most `sample` labelled rows; `labels` has doc_id and `label`."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [features(t).astype("<i4") for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in ("_o", "doc_id", "_y")), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                ["_o", "doc_id", "_y", "n", "at"],
            )

    # the join moves the labels, one small bounded table, and no texts
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("_o"), "doc_id", "_y", "text")
    rows = written(small_batches(labelled).mapInArrow(run, "_o long, doc_id long, _y int, n long, at binary"), "toxicity-sample")
    # one row per sampled document, however often its doc_id occurs: of its rows the one with the least features in order
    one = rows.groupBy("_o", "doc_id").agg(F.min(F.struct("at", "n", "_y")).alias("b")).select("_o", "doc_id", "b.at", "b.n", "b._y")
    one = written(one.filter(F.col("n") <= FEATURES), "toxicity-documents")
    taken, last = 0, None
    for r in sorted(one.select("_o", "doc_id", "n").toArrow().to_pylist(), key=lambda r: (r["_o"], r["doc_id"])):
        taken += r["n"]
        if taken > FEATURES:
            break
        last = (r["_o"], r["doc_id"])
    if last is None:
        return learn([], np.zeros(0))
    own = (F.col("_o") < last[0]) | ((F.col("_o") == last[0]) & (F.col("doc_id") <= last[1]))
    got = one.filter(own).orderBy("_o", "doc_id").select("at", "_y").toArrow()
    return learn([np.frombuffer(x, "<i4") for x in got["at"].to_pylist()], np.array(got["_y"].to_pylist(), np.float64))


def scored(docs: DataFrame, weights: Weights, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with `out`: the probability of label 1, from the whole text alone."""
    keep = [f for f in docs.schema.fields if f.name != out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        for batch in it:
            raw = np.array([dense[features(t)].sum(dtype=np.float64) for t in texts_of(batch, text)])
            values = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), pa.array(values, pa.float64())], [*(f.name for f in keep), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` double"])
    return small_batches(docs).mapInArrow(run, schema)
