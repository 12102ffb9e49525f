"""Token counts, centroid clustering and importance resampling: against the public library and brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.harness import compare, connect
from tests.llm.helpers import SF, no_documents, odd_documents, words
from veil.llm import centroids, importance, token_counts
from veil.llm.queries import ORACLES, QUERIES


def public_processor():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


HARD = [
    "x" * 3000, " " * 2500, "ab" * 1500, "日本語のテキスト" * 300, "\U0001f600é\0\U00010348" * 400, "word " * 600, "<s> </s>\n" * 200, "1234567890" * 250,
    "a" * 700 + " " * 900 + "the end" * 200, "ÿ" * 2000,
]


def test_chunked_counts_equal_the_library(spark):
    rng = random.Random(11)
    parts = ["the ", "in", "tokeniz", "ation", " ", "  ", "\n", "x", "xx", "日本", "é", "\U0001f600", "0", "<s>", "▁", "\t", "\0"]
    texts = HARD + [words(rng, parts, rng.randint(0, 1500)) for _ in range(60)] + [None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = token_counts.written(docs, "t")
    whole = public_processor()
    for chunk, overlap in ((64, 8), (200, 16), (1000, 64)):
        for r in token_counts.counted(path, token_counts.public_model(), 100, chunk=chunk, overlap=overlap).collect():
            text = texts[r["doc_id"]] or ""
            assert r["n_tokens"] == len(whole.encode(text)), (chunk, text[:40])
            assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 100)


def test_a_shared_token_is_needed_to_splice(spark):
    """A run of one letter aligns with no shift of itself: its overlap widens until one chunk holds the run."""
    text = "x" * 1003
    sent = spark.sparkContext.broadcast(token_counts.public_model())
    docs = spark.createDataFrame([(0, text)], "row long, text string")
    marks = token_counts.chunk_marks(token_counts.windows(docs, 101, 8), sent, 8)
    assert token_counts.spliced(marks, 259).first()["failed"] > 0
    assert token_counts.long_counts(docs, sent, 259, 101, 8).first()["n"] == len(public_processor().encode(text))


def test_counts_of_odd_rows(spark):
    docs = token_counts.written(odd_documents(spark).withColumn("n_bytes", F.lit("old")).withColumn("part", F.lit(5)), "odd")
    found = token_counts.counted(docs, token_counts.public_model(), 4096)
    whole = public_processor()
    texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in docs.collect()}
    rows = found.collect()
    assert len(rows) == docs.count() and "text" not in found.columns
    for r in rows:
        text = texts[r["doc_id"], r["n_chars"]] or ""
        assert (r["n_tokens"], r["n_bytes"], r["_row"], r["part"]) == (len(whole.encode(text)), len(text.encode()), 1, 5)
    assert token_counts.counted(no_documents(spark), token_counts.public_model(), 4096).count() == 0


def test_counts_of_the_table_equal_the_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op11_token_counts"](spark, SF).collect()
    assert len(found) == len(texts)
    ids = sorted(texts)
    expected = dict(zip(ids, map(len, public_processor().encode([texts[i] for i in ids], num_threads=1))))
    assert {r["doc_id"]: r["n_tokens"] for r in found} == expected


def plain_clusters(rows, rounds=10, k=8):
    """Plain Lloyd rounds with Python integers; rows of (vec_id, components)."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    now = [v for _, v in sorted((r for r in kept if r[0] is not None), key=name)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for _ in range(rounds):
        own = [min(range(len(now)), key=lambda c: (square(v, now[c]), c)) for _, v in kept]
        for c in range(len(now)):
            members = [v for (_, v), o in zip(kept, own) if o == c]
            if members:
                now[c] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for i, v in kept:
        d, c = min((square(v, u), c) for c, u in enumerate(now))
        out.append((i, c, d))
    total = sum(d for _, _, d in out)
    return sorted(
        ((i, c, d, sum(e for _, b, e in out if b == c), total, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in out), key=str
    )


def some_vectors(rng, n):
    tops = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [[rng.choice([1.0, 0.25]) * rng.gauss(t, 0.3) for t in rng.choice(tops)] for _ in range(n)]


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(5)
    made = some_vectors(rng, 300)
    rows = list(enumerate(made)) + [(1000 + i, made[i % 7]) for i in range(150)]  # many copies, so ties and equal first centroids
    rows += [(2000, None), (2001, []), (2002, made[0][:63]), (2003, [None, *made[0][1:]]), (2004, [math.nan, *made[0][1:]]), (2005, [math.inf, *made[0][1:]])]
    rows += [(2006, [0.0] * 64), (3, made[9]), (None, made[10])]
    for kind in ("double", "float"):
        given = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("cells", F.lit("x")).repartition(7)
        exact = [(r["vec_id"], r["embedding"]) for r in given.collect()]
        assert sorted(map(tuple, centroids.clustered(given).collect()), key=str) == plain_clusters(exact)


def test_clusters_of_few_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert centroids.clustered(spark.createDataFrame([], kind)).count() == 0
    assert centroids.clustered(spark.createDataFrame([(None, [1.0] * 64)], kind)).count() == 0
    three = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, centroids.clustered(spark.createDataFrame(three, kind)).collect()), key=str) == plain_clusters(three)
    huge = centroids.clustered(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.5] * 64)], kind)).collect()
    assert len(huge) == 3 and {r["distance"] for r in huge} == {0}


def test_intervals_bound_the_distances():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-900, 900, (500, 64)), rng.integers(-900, 900, (8, 64))
    edges = np.concatenate([x.min(0)[:, None], np.sort(rng.integers(-900, 900, (64, 15)), axis=1).clip(x.min(0)[:, None], x.max(0)[:, None]), x.max(0)[:, None] + 1], axis=1)
    cells = np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], "right") for d in range(64)], axis=1)
    assert (centroids.unpacked(pa.array([r.tobytes() for r in centroids.packed(cells)], pa.binary())) == cells).all()
    for bits in (3, 5):
        small = cells % (1 << bits)
        assert (centroids.unpacked(pa.array([r.tobytes() for r in centroids.packed(small, bits)], pa.binary()), 64, bits) == small).all()
    tables, dims = centroids.Intervals(c, edges), np.arange(64)
    exact = ((x[:, None] - c[None]) ** 2).sum(2) - (x * x).sum(1)[:, None]
    for j in range(8):
        assert (tables.low[j][dims, cells].sum(1) <= exact[:, j]).all() and (exact[:, j] <= tables.high[j][dims, cells].sum(1)).all()
    best, sure = tables.settled(cells)
    assert (best[sure] == exact.argmin(1)[sure]).all()


def test_few_full_vectors_are_read(spark):
    """Well apart, clusters are settled by the cells; only vectors that move are read in full."""
    rng = random.Random(8)
    made = some_vectors(rng, 2000)
    vectors = centroids.written(centroids.vectors_of(spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")), "v")
    edges = centroids.cell_edges(vectors)
    file = centroids.written(centroids.approximated(vectors, edges), "f")
    now = centroids.fit(file, edges, centroids.first_centroids(vectors))
    assert centroids.moves(file, edges, None, now)[-1, -1] == 2000
    assert centroids.moves(file, edges, now, now)[-1, -1] < 1000


def test_clusters_equal_sql(spark):
    assert compare(QUERIES["op12_centroid_clustering"](spark, SF), connect(SF), ORACLES["op12_centroid_clustering"]) > 0


def plain_sample(docs, target):
    """docs: (doc_id, text); returns rows without rank ties between unlike rows."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def features(text):
        w = word.findall(lower(text))
        return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_blocks_keep_all_features():
    rng = random.Random(2)
    for _ in range(30):
        text = words(rng, ["a ", "Bc", " ", "\n", "é", "7", "-", "word ", "ÀB "], 400)
        whole = np.sort(np.concatenate([h for _, h in importance.hashes(text)] or [[]]))
        for block in (1, 5, 37):
            cut = list(importance.hashes(text, block))
            assert sum(n for n, _ in cut) == sum(n for n, _ in importance.hashes(text))
            assert (np.sort(np.concatenate([h for _, h in cut] or [[]])) == whole).all()
    assert [zlib.crc32(f.encode()) for f in ("ab", "é", "ab é")] == np.concatenate([h for _, h in importance.hashes("AB--é")]).tolist()


def sampled(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("rank", F.lit("old"))
    target = spark.createDataFrame([("A word, a WORD",), (None,), ("",)], "text string")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sampled(importance.resampled(docs, target)) == plain_sample(given, ["A word, a WORD", None, ""])
    assert importance.resampled(no_documents(spark), target).count() == 0
    assert sampled(importance.resampled(docs, target.filter("false"))) == plain_sample(given, [])


def test_ranks_over_parts_and_ties(spark):
    """Ties across parts go to the smaller doc_id; equal rows get different ranks."""
    rows = [(i, 30 if i % 4 else 5, 1, 7, i % 3) for i in range(2000)] + [(5, 30, 1, 7, 2)] * 50
    found = importance.ranked(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)).collect()
    assert len(found) == len(rows)
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    drawn = sorted((r["rank"], r["doc_id"]) for r in found if r["rank"] is not None)
    assert drawn == [(n + 1, r[0]) for n, r in enumerate(fit[: len(fit) * 5 // 100])]


def test_resampling_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = sampled(QUERIES["op13_importance_resampling"](spark, SF))
    assert found == plain_sample(docs, target) and any(r[4] == 1 for r in found)


@pytest.mark.parametrize("name", ["op11_token_counts", "op12_centroid_clustering", "op13_importance_resampling"])
def test_reruns_agree(spark, name):
    a, b = (sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str) for _ in range(2))
    assert a == b
