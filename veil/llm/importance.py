"""Importance resampling toward a target distribution, over hashed word n-grams.

Words come from UTF-8 bytes: one 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter or digit,
and `bytes.split` yields what is left. A feature is a run of one to three words joined by a space; its hash is the CRC-32 of
the run before it, carried on over a space and the next word, so no joined run is ever built. Features fall into buckets, a
Counter per task reduces them, and Spark adds the Counters up by bucket. A bucket's gain is a thousand times the logarithm of
its smoothed share in the target over its share in the documents, rounded down.

A document's weight is the sum of its features' gains. Its score adds Gumbel noise from a hash of its doc_id, so the
highest scores are a sample without replacement in proportion to exp(weight / 1000), and the same in every run. Scores
are ranked by ranges: rows are sorted into parts, and a row's rank is its place in the part plus the rows of earlier parts.

Long texts are taken a block at a time, with the last two words carried on, so whole texts count in bounded memory. A null
text has no words. A null doc_id draws the noise of an empty id and loses ties. Rows that repeat a doc_id are rows of
their own, each with its rank. Without target or documents the shares are those of the smoothing alone; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import column, small_batches, texts_of, written

BUCKETS = 10_000
#: Documents with fewer words are never drawn; so many percent of the others are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20

#: A-Z to a-z; digits, a-z and the bytes of other characters stay; the rest is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

def word_blocks(text: str, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, a block at a time; no word is cut."""
    raw = text.encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(raw):
        stop = len(raw) if at + block >= len(raw) else raw.find(b" ", at + block)
        stop = len(raw) if stop < 0 else stop
        words = raw[at:stop].split()
        if words:
            yield words
        at = stop


def hashes(text: str, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of all features that end in them) for each block of a text."""
    before: list[bytes] = []
    for words in word_blocks(text, block):
        known = len(before)
        held = before + words
        spaced = [b" " + w for w in held]
        one = list(map(crc32, held))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        # what the words carried on ended in has been counted before
        fresh = one[known:] + two[max(known - 1, 0) :] + three[max(known - 2, 0) :]
        yield len(words), np.array(fresh, np.uint32)
        before = held[-2:]


def feature_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; at most `buckets` rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in it:
            for t in texts_of(batch, text):
                for _, h in hashes(t):
                    found.update((h % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["bucket", "n"])

    return small_batches(texts.select(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from all features of both tables."""

    def dense(counts: DataFrame) -> list[int]:
        n = [0] * buckets
        for r in counts.collect():  # one row per bucket
            n[r["bucket"]] = r["n"]
        return n

    s, t = dense(feature_counts(documents, buckets=buckets)), dense(feature_counts(target, buckets=buckets))
    over, under = sum(s) + float(buckets), sum(t) + float(buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * over / ((a + 1.0) * under))) for a, b in zip(s, t)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for t in texts_of(batch, "text"):
                words = features = weight = 0
                for n, h in hashes(t):
                    words, features, weight = words + n, features + len(h), weight + int(gain[h % len(gain)].sum())
                rows.append((words, features, weight))
            ids = column(batch, "doc_id")
            cols = list(zip(*rows)) if rows else [(), (), ()]
            score = [w + noise(i, seed) for w, i in zip(cols[2], ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (*cols, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {doc_id}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """`rows` with `rank`: 1, 2, 3 ... from the highest score, for the rows that are drawn; null for the others."""
    rows = written(rows.withColumn("__fit", F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id()), "weighed")
    order = [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "ranked")
    part = F.shiftright("__at", 33)
    # one row per part of the sort
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.count_if("__fit").alias("fit"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"),
        F.expr(f"sum(fit) over (partition by 0) * {percent} div 100").alias("__drawn"),
    )
    place = F.pmod("__at", F.lit(1 << 33)) + F.col("__start") + 1
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("rank", F.when(place <= F.col("__drawn"), place)).drop("__fit", "__row", "__at", "__part", "__start", "__drawn")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    return ranked(weighed(docs, gains(docs, target)))
