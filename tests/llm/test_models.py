"""The classifiers: against plain traversal and updates, and on held-out rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import auc, no_documents, odd_documents
from veil.llm import quality, toxicity
from veil.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"


def held(spark, name, label, parts, rest):
    rows = QUERIES[name](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) and 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    return [r[label] for r in out], [r["score"] for r in out], [r["predicted"] for r in out]


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    x[:200] = np.round(x[:200])  # ties
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.grow(x, y, trees=25, depth=3)

    def walk(row):
        raw = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            raw += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-raw))

    scores = model.scores(x)
    assert np.allclose(scores, [walk(r) for r in x])
    assert auc(y, scores) > 0.95


def test_trees_without_both_labels():
    assert np.allclose(quality.grow(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))), 0.5)
    assert (quality.grow(np.ones((4, 3)), np.ones(4)).scores(np.ones((2, 3))) > 0.9).all()


def test_statistics_of_odd_texts():
    assert not quality.statistics("").any() and not quality.statistics(" \n ").any()
    a = dict(zip(quality.STATISTICS, quality.statistics("AA bb!! bb!!\nAA bb!! bb!!")))
    assert a["words"] == math.log1p(6) and a["distinct_words"] == 2 / 6 and a["distinct_lines"] == 0.5 and a["bang"] > 0


def test_quality_odd_rows(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1), (5, 0), (5, None), (6, 0), (6, 1), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels.withColumn("_y", F.lit(7)))
    found = quality.scored(docs.withColumn("score", F.lit("old")), model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["_row"] == 1 for r in found)
    assert len({r["score"] for r in found if r["text"] in (None, "", " \n\t ")}) == 1
    none = quality.fit(no_documents(spark), labels)
    assert quality.scored(no_documents(spark), none).count() == 0


def test_quality_on_held_out_rows(spark):
    y, s, p = held(spark, "op3_quality_classifier", "quality", 5, 0)
    assert auc(y, s) > 0.98 and np.mean([a == b for a, b in zip(y, p)]) > 0.97


def test_updates_equal_the_plain_rule():
    rng = np.random.default_rng(6)
    rows = [np.unique(np.concatenate([[0], rng.integers(1, 40, 6)])) for _ in range(80)]
    y = np.array([float(5 in r or 7 in r) for r in rows])
    found = toxicity.learn(rows, y, buckets=40, epochs=3)
    z, n = [0.0] * 40, [0.0] * 40

    def weight(i):
        if abs(z[i]) <= toxicity.L1 and i:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) if z[i] else 0.0

    for _ in range(3):
        for r, label in zip(rows, y):
            w = {int(i): weight(int(i)) for i in r}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    assert np.allclose(found.dense(40), [weight(i) if n[i] else 0 for i in range(40)], atol=1e-5)
    assert 0 < len(found.at) < 40


def test_toxicity_features_are_order_sensitive_and_whole():
    a, b = set(toxicity.features("you bad thing").tolist()), set(toxicity.features("thing bad you").tolist())
    assert a != b and 0 in a and len(a) == 1 + 3 + 2 + 1 + 1
    assert toxicity.features("").tolist() == [0]
    assert set(toxicity.features("idiot").tolist()) <= set(toxicity.features("word " * 50_000 + "idiot").tolist())


def test_toxicity_odd_rows(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1), (5, 0), (6, None), (99, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels)
    found = toxicity.scored(docs.withColumn("score", F.lit("old")), weights).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    none = toxicity.fit(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(no_documents(spark), none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    y, s, p = held(spark, "op9_toxicity", "toxic", 3, 1)
    assert auc(y, s) > 0.95
    assert np.mean([b for a, b in zip(y, p) if a == 0]) < 0.01


def test_repeated_ids_are_one_row_of_the_sample(spark, monkeypatch):
    """A doc_id that occurs very often among the labelled brings one list of features to the driver."""
    often = spark.range(200_000).selectExpr("CASE WHEN id < 199000 THEN 7 ELSE id END AS doc_id", "concat('word ', id % 3, ' thing') AS text")
    labels = often.select("doc_id").distinct().selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    seen = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda rows, y, *a: seen.append(len(rows)) or learn(rows, y, *a))
    toxicity.fit(often, labels, sample=100)
    toxicity.fit(often.unionByName(often.limit(10)), labels.filter("doc_id = 7"))
    assert seen == [100, 1]


def test_texts_over_the_feature_bound_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 60)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(200 if i == 3 else 4))) for i in range(20)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda rows, y, *a: seen.append([len(r) for r in rows]) or toxicity.Weights(np.zeros(0, int), np.zeros(0)))
    toxicity.fit(docs, docs.selectExpr("doc_id", "1 AS toxic"))
    assert 0 < sum(seen[0]) <= 60 and max(seen[0]) < 60
