"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken on the executors. The trees are grown by the driver on a bounded sample
of labelled rows (at most `SAMPLE` rows of `len(STATISTICS)` numbers) from histograms of binned values, with
second-order gains of the logistic loss. The ensemble is flattened into a few arrays, which every task gets with
its code; all rows of a batch walk down all trees together, one level per numpy step.

A null text counts as empty; empty texts have all statistics zero and get a score like any other. Labels that are
null, or whose document is missing, are not learned from; of several labels of one document the largest counts.
Without labels of both kinds, the model is a constant: the share of label 1, or 0.5 where there are none.
Repeated rows get equal scores; extra columns are ignored by the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import column, small_batches, texts_of

#: Most labelled rows that a model is fitted on; the sample is the same in every run.
SAMPLE = 20_000
#: Documents with this score or more are kept.
KEEP = 0.3
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 60, 4, 0.2, 1.0, 1.0

STATISTICS = (
    "bytes", "words", "word_bytes", "distinct_words", "top_word", "repeated_words", "lines", "line_bytes", "distinct_lines",
    "upper", "lower", "digit", "space", "punct", "high", "bang", "pipe", "symbol", "short_words", "long_words",
    "ends_full", "pair_repeats", "stop_like", "word_entropy",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _PUNCT, _HIGH, _BANG, _PIPE, _SYMBOL = range(9)


def _byte_classes() -> np.ndarray:
    kinds = np.zeros((9, 256))
    for b in range(256):
        c = chr(b)
        kinds[_HIGH, b] = b >= 128
        if b < 128:
            kinds[_UPPER, b], kinds[_LOWER, b], kinds[_DIGIT, b] = c.isupper(), c.islower(), c.isdigit()
            kinds[_SPACE, b] = c.isspace()
            kinds[_PUNCT, b] = c in ".,;:?'\"()-"
            kinds[_BANG, b], kinds[_PIPE, b] = c == "!", c == "|"
            kinds[_SYMBOL, b] = c in "#$%&*+/<=>@[\\]^_`{}~"
    return kinds


CLASSES = _byte_classes()


def statistics(text: str) -> np.ndarray:
    """The numbers of `STATISTICS` for one whole text; shares are of bytes, words or lines."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(len(STATISTICS))
    shares = CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    names: dict[bytes, int] = {}
    at = np.array([names.setdefault(w, len(names)) for w in words])
    counts = np.bincount(at)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = at[:-1] * len(names) + at[1:]
    p = counts / len(words)
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), sizes.mean(), len(names) / len(words), counts.max() / len(words),
        counts[counts > 1].sum() / len(words), np.log1p(len(lines)), np.log1p(len(data) / len(lines)), len(set(lines)) / len(lines),
        *shares,
        (sizes <= 2).mean(), (sizes >= 12).mean(), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        1 - len(np.unique(pairs)) / max(1, len(pairs)), np.sort(counts)[-10:].sum() / len(words), -(p * np.log(p)).sum(),
    ])


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """`docs` without the text, with `out`: the statistics as an array of doubles."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [statistics(t) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, f.name) for f in keep), pa.array(rows, pa.list_(pa.float64()))], [*(f.name for f in keep), out]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` array<double>"])
    return small_batches(docs).mapInArrow(run, schema)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in arrays: node i has the children 2i+1 and 2i+2; a row goes right where value > cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; infinity where all rows go left
    leaf: np.ndarray  # trees x leaves
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(x):
            return np.zeros(0)
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        while len(self.feature) and node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        raw = self.base + (self.leaf[trees, node - inner].sum(1) if len(self.feature) else 0)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40))) + np.zeros(len(x))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for rows x (n x k) with labels y (0 or 1)."""
    inner = 2**depth - 1
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        none = np.zeros((0, inner))
        return Trees(none.astype(np.int64), none, np.zeros((0, inner + 1)), base)
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: value <= cut b
    flat = binned + np.arange(k)[None, :] * BINS
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf, raw = np.zeros((trees, inner + 1)), np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * BINS) + flat).ravel()
            size = width * k * BINS
            g = np.bincount(at, np.repeat(grad, k), size).reshape(width, k, BINS).cumsum(2)
            h = np.bincount(at, np.repeat(hess, k), size).reshape(width, k, BINS).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(h < LEAST) | (ht - h < LEAST)] = 0
            for w in range(width):
                j, b = divmod(int(gain[w].argmax()), BINS)
                if gain[w, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + w], cut[t, first + w] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        slot = node - inner
        g, h = np.bincount(slot, grad, inner + 1), np.bincount(slot, hess, inner + 1)
        leaf[t] = rate * g / (h + RIDGE)
        raw += leaf[t, slot]
    return Trees(feature, cut, leaf, base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most `sample` labelled rows; `labels` has doc_id and `label`, one row per document or more."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # the join moves the labels, one small bounded table, and no texts
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    got = rows.groupBy("doc_id", "_y").agg(F.min("stats").alias("stats")).toArrow().sort_by("doc_id")
    x = np.array(got["stats"].to_pylist(), np.float64).reshape(len(got), len(STATISTICS))
    return grow(x, np.array(got["_y"].to_pylist(), np.float64))


def scored(docs: DataFrame, model: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with `out`: the probability of label 1, from the whole text alone."""
    keep = [f for f in docs.schema.fields if f.name != out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [statistics(t) for t in texts_of(batch, text)]
            values = model.scores(np.array(rows, np.float64).reshape(len(rows), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), pa.array(values, pa.float64())], [*(f.name for f in keep), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` double"])
    return small_batches(docs).mapInArrow(run, schema)
