"""Source mixing against plain targets, and the pipeline stage by stage."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SF, no_documents, odd_documents
from tests.llm.test_duplicates import jaccard_keepers
from veil.llm import bpe, mixing, quality
from veil.llm.common import written
from veil.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows):
    """Target words of each source, from (source, size) rows."""
    size = collections.Counter()
    for s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), {}
    while len(full) < len(size):
        rest = [s for s in size if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * size[s]]
        if not over:
            return size, full | {s: level * weight[s] for s in rest}
        full |= {s: 3 * size[s] for s in over}
    return size, full


def check_mix(rows, sources):
    size, target = plain_targets([(sources[r["doc_id"]], r["size"]) for r in rows])
    taken = collections.Counter()
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    return target, taken


def test_mix_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op6_source_mix"](spark, SF).collect()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[d["doc_id"]]["size"] == words(d["text"]) for d in docs)
    target, taken = check_mix(rows, {d["doc_id"]: d["source"] for d in docs})
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op6_source_mix"](spark, SF).collect()}
    assert again == {i: r["taken"] for i, r in by.items()}


def test_mix_does_not_depend_on_the_split(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")

    def taken(df):
        slim = mixing.sizes(df).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "size")
        return {r["doc_id"]: r["copies"] for r in mixing.copies(slim).collect()}

    assert taken(docs) == taken(docs.repartition(7, "text"))


def test_mix_of_uneven_sources(spark):
    rows = [(i, "big", "w " * (1 + i % 9)) for i in range(600)] + [(1000 + i, f"s{i % 7}", "w " * (i % 5)) for i in range(60)]
    rows += [(2000, None, "one two"), (2001, "", "x"), (2002, "zero", None), (2003, "zero", ""), (2004, "long", "w " * 20_000), (2005, "long", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.mixed(docs).withColumn("taken", F.col("size") * F.col("copies"))
    found = mix.collect()
    assert len(found) == len(rows)
    target, taken = check_mix(found, {i: s for i, s, _ in rows})
    for s in ("big", "s0", "s1", "s2"):
        assert abs(taken[s] - target[s]) <= 2
    assert mixing.repeated(mix, docs.columns).count() == sum(r["copies"] for r in found)


def test_rates_are_exponential_in_size(spark):
    rows = [(i, s, 1 + (i * 7) % 40) for s in ("a", "b", "c") for i in range(200)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = written(mixing.source_targets(sized), "targets")
    for r in targets.join(mixing.rates(sized, targets), "source").collect():
        total = sum(n * min(3.0, math.exp(r["lam"] * n / r["scale"])) for _, s, n in rows if s == r["source"])
        assert abs(total - r["target"]) <= 2e-4 * r["target"]


def plain_tilt(counts, target, limit=3.0):
    """lam of rate = min(limit, exp(lam * size)), by bisection."""
    total = lambda x: sum(c * n * min(limit, math.exp(min(60.0, x * n))) for n, c in counts.items())
    low, high = -1.0, 1.0
    while total(low) > target:
        low *= 2
    while total(high) < target:
        high *= 2
    for _ in range(200):
        low, high = ((low + high) / 2, high) if total((low + high) / 2) < target else (low, (low + high) / 2)
    return low


def test_rates_where_one_document_is_very_long(spark):
    sources = {"a": [(10 + i % 21, 1) for i in range(400)], "b": [(1 + i % 40, 1) for i in range(200)] + [(20_000, 1)], "c": [(20, 3000), (20_000, 1), (1_000_000, 1)], "d": [(1, 5000), (3_000_000, 1)]}
    sized = spark.createDataFrame([(s, n) for s, rows in sources.items() for n, c in rows for _ in range(c)], "source string, size long")
    wanted = {"a": 1.5, "b": 0.002, "c": 0.01, "d": 1e-4}
    size = {s: sum(n * c for n, c in rows) for s, rows in sources.items()}
    rows = [(s, float(size[s]), max(n for n, _ in sources[s]), size[s] * w) for s, w in wanted.items()]
    targets = written(spark.createDataFrame(rows, "source string, source_size double, largest long, target double"), "targets")
    for r in mixing.rates(sized, targets).collect():
        counts = collections.Counter()
        for n, c in sources[r["source"]]:
            counts[n] += c
        tilt, target = r["lam"] / r["scale"], size[r["source"]] * wanted[r["source"]]
        rate = lambda n, x: min(3.0, math.exp(min(60.0, x * n)))
        assert abs(sum(c * n * rate(n, tilt) for n, c in counts.items()) - target) <= 2e-4 * target
        exact = plain_tilt(counts, target)
        assert all(math.isclose(rate(n, tilt), rate(n, exact), rel_tol=2e-3, abs_tol=1e-6) for n in counts)


def test_copies_by_source_equal_copies_by_row(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_source = mixing.mixed(docs)
    plan = by_source._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(str, by_source.collect())) == sorted(map(str, mixing.mixed(docs).collect()))


def test_mix_odd_rows(spark):
    docs = odd_documents(spark)
    found = mixing.mixed(docs)
    assert found.count() == docs.count() and found.filter("copies is null or copies < 0 or copies > 3").isEmpty()
    assert found.filter("`_row` <> 1").isEmpty()
    assert mixing.mixed(no_documents(spark)).count() == 0


def test_mix_stage_keeps_values_of_clashing_columns(spark):
    docs = odd_documents(spark).withColumn("target", F.lit("own")).withColumn("copies", F.lit(77)).withColumn("source_size", F.lit(None).cast("date"))
    docs = written(docs, "clashing")
    found = corpus_pipeline.mixed_documents(spark, docs, SMALL)
    assert found.schema == docs.schema and not found.isEmpty()
    assert {(r["size"], r["target"], r["copies"], r["source_size"]) for r in found.collect()} == {("x", "own", 77, None)}


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), f"test-{name}"))
    return docs


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_stage_rejects_junk_and_keeps_the_rest(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    marked = labels.join(stages[0].select("doc_id"), "doc_id").collect()
    good, bad = [r["doc_id"] for r in marked if r["quality"] == 1], [r["doc_id"] for r in marked if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.05 * len(bad)


def test_duplicate_stages_equal_brute_force(stages):
    given = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in stages[1].collect()}
    least = {}
    for i, t in given.items():
        least[t] = min(i, least.get(t, i))
    assert sorted(least.values()) == sorted(r["doc_id"] for r in stages[2].collect())
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    near = [rows[i][0] for i in jaccard_keepers(rows)]
    assert near == sorted(r["doc_id"] for r in stages[3].collect()) and len(near) < len(rows)


def test_mix_and_token_stages(stages):
    rows = [(r["doc_id"], r["source"], words(r["text"])) for r in stages[3].collect()]
    _, target = plain_targets([(s, n) for _, s, n in rows])
    taken = collections.Counter()
    for r in stages[4].collect():
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    tokens = stages[5].collect()
    assert len(tokens) == stages[4].count() and all(r["exact"] for r in tokens)
    encode = bpe.encoder(*bpe.public_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert all(bytes(r["ids"]) == encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) // 4 for r in tokens)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).filter("not exact").isEmpty()
    assert quality.KEEP == 0.3


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, no_documents(spark)):
            found = stage(spark, given, SMALL)
            assert found.count() <= 3 * docs.count() and (name == "byte_bpe" or found.columns == docs.columns)
