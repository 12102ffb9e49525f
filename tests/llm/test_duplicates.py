"""Exact and near duplicates against brute force."""

import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.harness import compare, connect
from tests.llm.helpers import SF, Sets, no_documents, odd_documents
from veil.llm import block_names, caps, common, near_copies, simhash
from veil.llm.common import components, forest, written
from veil.llm.queries import ORACLES, QUERIES


def test_exact_against_sql(spark):
    assert compare(QUERIES["op7_exact_dedup"](spark, SF), connect(SF), ORACLES["op7_exact_dedup"]) == 1000


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("block, part_rows", [(4, 30), (4096, 40_000)])
def test_exact_with_hot_blocks_over_many_parts(spark, block, part_rows):
    rng = random.Random(block)
    hot = "same passage "
    rows = [(i, hot * rng.randint(0, 4) + rng.choice(["", "x", "y z"]) + hot * rng.randint(0, 2)) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, hot + " "), (1003, hot.replace(" ", "\n\t")), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = block_names.exact_duplicates(docs, block, part_rows).collect()
    groups = expected_exact(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    assert len(found) == len(rows)
    for r in found:
        same = groups[re.sub(r"[\x20\x09-\x0D]+", " ", texts[r["doc_id"]] or "")]
        assert r["keep_id"] == min(same) and r["group_size"] == len(same)
    assert sum(r["kept"] for r in found) == len(groups)


def test_exact_where_blocks_share_a_hash(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(block_names.F, "xxhash64", lambda *keys: F.pmod(real(*keys), F.lit(2)))
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["aaaa", "bbbb", "cccc", "dddd"]) for _ in range(rng.randint(1, 3)))) for i in range(300)]
    found = block_names.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 30).collect()
    groups = expected_exact(rows)
    texts = dict(rows)
    assert all(r["keep_id"] == min(groups[texts[r["doc_id"]]]) and r["group_size"] == len(groups[texts[r["doc_id"]]]) for r in found)


def test_exact_odd_rows(spark):
    docs = odd_documents(spark)
    kept = block_names.deduplicated(docs, block=64)
    rows = kept.collect()
    assert kept.columns == docs.columns and len(rows) == 6
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 4, 5, 8, 9]
    assert block_names.exact_duplicates(no_documents(spark)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    sets = Sets(len(fps))
    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2):
            sets.join(i, i + 1 + int(j))
    return [sets.find(i) for i in range(len(x))]


def test_fingerprints():
    for text in ("", "  \n", "A", "A b", "A B c", "a b c d", "x\x1cy z\x0bq É", "w " * 3000, "one two three four five six seven"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(rng):
    base = rng.integers(0, 2**63, 800, dtype=np.uint64)
    flip = lambda x, k: np.bitwise_xor.reduce(np.array([x, *(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))], np.uint64))
    near = [flip(b, int(rng.integers(1, 4))) for b in base[:400]] + [flip(base[0], int(rng.integers(1, 7))) for _ in range(900)]
    return np.unique(np.concatenate([base, np.array(near, np.uint64)]))


def test_trees_find_every_link():
    x = clustered(np.random.default_rng(7))
    exact = plain_components(x.tolist())
    nodes = simhash.upper_tree(x[::3], 16)
    at, shard = simhash.shards_of(x, nodes, 2)
    place = {v: i for i, v in enumerate(x.tolist())}
    for links in ([simhash.links_within(x, 2)], [simhash.links_within(x[at[shard == s]], 2) for s in np.unique(shard)]):
        sets = Sets(len(x))
        for a, b in links:
            for p, q in zip(a.tolist(), b.tolist()):
                sets.join(place[p], place[q])
        assert [sets.find(i) for i in range(len(x))] == exact


def test_components_of_shards(spark):
    x = clustered(np.random.default_rng(8)).view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in x] * 2, "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(fps, shard=100), "a", "b").collect()}
    exact = plain_components(x.view(np.uint64).tolist())
    groups = {}
    for v, c in zip(x.tolist(), exact):
        groups.setdefault(c, set()).add(v)
    for g in groups.values():
        assert {roots.get(v, v) for v in g} == {min(g)}


def test_long_chain_of_links(spark):
    chain = list(range(300))
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame(list(zip(chain, chain[1:])) + [(5, 5), (1000, 1001)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(1, 300)} | {1001: 1000}
    a, b = forest(np.array(chain[:-1]), np.array(chain[1:]))
    assert sorted(a.tolist()) == list(range(1, 300)) and set(b.tolist()) == {0}


def test_near_query_against_brute_force(spark):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    ids = sorted(given)
    fps = [int(found[i]["fingerprint"], 16) for i in ids]
    assert all(plain_fingerprint(given[i]) == f for i, f in list(zip(ids, fps))[::10])
    assert [found[i]["component_id"] for i in ids] == [ids[c] for c in plain_components(fps)]


def test_near_odd_rows(spark):
    docs = odd_documents(spark)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in found}
    assert {c for (i, _), c in by.items() if i in (2, 3, 4, 10)} == {2} and {c for (i, _), c in by.items() if i in (1, 6, 7, None)} == {1}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 8, 9]
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_each_component_keeps_one_row(spark):
    rows = [(None, "alone without an id"), (None, "two of these rows"), (None, "two of these rows"), (7, "first text of seven"), (7, "quite another text with the same id")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "ids")
    for kept in (simhash.representatives(docs), near_copies.representatives(docs)):
        assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in rows})


def tables_of(monkeypatch, work):
    """What `work` returns, and the labels of the tables that it writes on the way."""
    labels, real = [], common.shared_path

    def noted(spark, label):
        labels.append(label)
        return real(spark, label)

    with monkeypatch.context() as m:
        m.setattr(common, "shared_path", noted)
        return work(), labels


def test_stars_need_no_round(spark, monkeypatch):
    stars = spark.createDataFrame([(9, 1), (1, 5), (7, 1), (7, 1), (4, 2), (3, 3)], "a long, b long")
    found, labels = tables_of(monkeypatch, lambda: components(stars, "a", "b").collect())
    assert {r["node"]: r["root"] for r in found} == {9: 1, 5: 1, 7: 1, 4: 2}
    assert labels == ["links", "least"]
    nothing, labels = tables_of(monkeypatch, lambda: components(stars.filter("a = 3"), "a", "b").collect())
    assert nothing == [] and labels == ["links"]
    for links in ([(3, 1), (3, 2)], [(2, 1), (3, 2)]):  # a child of two roots, a root that is a child
        found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
        assert {r["node"]: r["root"] for r in found} == {2: 1, 3: 1}


def test_counts_are_taken_by_the_write(spark):
    for rows in (1000, 0):
        for df in (spark.range(rows), spark.range(rows).groupBy("id").count().select("id"), spark.range(1000).join(spark.range(rows), "id")):
            out, seen = common.counted(df.repartition(5), "counted", n=F.count("*"), odd=F.count(F.when(F.col("id") % 2 == 1, 1)))
            assert seen == {"n": rows, "odd": rows // 2} and out.count() == rows


def jaccard_keepers(rows):
    """Rows (index) that stay by brute force."""
    sets = []
    for _, t in rows:
        w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").strip(" \t\n\r\v\f"))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w != [""] else set())
    joined = Sets(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a & sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                joined.join(i, j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(joined.find(i), []).append((d is None, d or 0, i))
    return sorted(min(v)[2] for v in best.values())


@pytest.mark.parametrize("share", [1, 3, near_copies.SHARE])
def test_near_copies_against_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(near_copies.frequent_shingles, "__defaults__", (share,))
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(share)
    passage = [f"p{k}" for k in range(12)]
    texts = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 5, 6, 9, 30, 80, 200]))] for _ in range(120)]
    base = [f"b{k}" for k in range(100)]
    texts += [base[: rng.randint(70, 100)] + [f"x{rng.randrange(9)}"] * rng.randint(0, 4) for _ in range(80)]
    for t in texts[:100] * 2:
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
        texts.append(t + passage * rng.randint(0, 1))
    rows = [(rng.choice([None, *range(900)]), rng.choice([" ", "\n", "  "]).join(t)) for t in texts] + [(5, None), (None, " "), (3, ""), (901, rng.choice(texts)[0].upper())]
    docs = written(spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at int").coalesce(1), "near")
    exact = jaccard_keepers(rows)
    assert sorted(r["at"] for r in near_copies.representatives(docs).collect()) == exact
    assert len(exact) < len(rows) - 80


def test_near_stage_against_jaccard(spark):
    docs = block_names.deduplicated(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = written(docs, "distinct")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = sorted(r["doc_id"] for r in corpus_pipeline.dissimilar_documents(spark, docs, SF).collect())
    assert kept == [rows[i][0] for i in jaccard_keepers(rows)] and len(kept) < len(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (0, 1, 120, 130, 900, 1100, 40_000):
        base = np.unique(rng.integers(0, 2**63, n + 1).astype(np.uint64))
        for share in (0.0, 0.05, 0.12, 0.3):
            other = np.unique(np.where(rng.random(len(base)) < share, rng.integers(0, 2**63, len(base)).astype(np.uint64), base))[: max(1, int(len(base) * 0.9))]
            x, y = near_copies.sketch(base), near_copies.sketch(other)
            bits = min(len(x), len(y)) * 8
            a, b = near_copies.folded([x, y], bits)
            apart, exact = int(np.bitwise_count(a ^ b).sum()), len(np.setxor1d(base, other))
            assert apart <= exact and (exact > bits // 8 or apart >= exact - 2 * exact**2 / bits - 16)
            assert not near_copies.similarity(base, other)[0] or 9 * apart <= len(base) + len(other)


@pytest.mark.parametrize("few, crowd", [(0, 64), (16, 100)])
def test_crowds_of_near_copies_stay_out_of_pairs(spark, monkeypatch, few, crowd):
    rng = random.Random(few)
    base = [f"b{k}" for k in range(100)]
    texts = []
    for _ in range(160):  # copies of one text whose similarity lies around the limit
        t = list(base)
        for k in rng.sample(range(100), rng.randint(1, 4)):
            t[k] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    docs = written(spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, at int").coalesce(1), "near")
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    asked, compared = [], near_copies.compared

    def counted(pairs, docs):
        found = compared(pairs, docs)
        asked.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "compared", counted)
    assert sorted(r["at"] for r in near_copies.representatives(docs).collect()) == jaccard_keepers(rows)
    assert sum(asked) <= 12 * len(rows)


def test_turns_of_near_copies_write_few_tables(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for k in range(60):  # chains of texts: only neighbours are near, so several turns link
        base = [f"b{k}_{i}" for i in range(60)]
        texts += [" ".join(base[i : i + 50]) for i in range(0, 10, 2)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = written(spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, at int").coalesce(1), "near")
    turns, real = [], near_copies.compared
    monkeypatch.setattr(near_copies, "compared", lambda pairs, docs: turns.append(0) or real(pairs, docs))
    kept, labels = tables_of(monkeypatch, lambda: sorted(r["at"] for r in near_copies.representatives(docs).collect()))
    assert kept == jaccard_keepers(rows)
    assert len(turns) >= 3 and len(labels) <= 30 + 12 * len(turns), (len(labels), len(turns), labels)


@pytest.mark.parametrize("sent", [0, 1_000])
def test_near_copies_of_many_asked_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(near_copies, "FEW_SENT", sent)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join([*base[: 100 - k % 7], f"x{k}"])) for k in range(40)] + [(90 + k, f"y{k}") for k in range(20)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), "many")
    at = {r["doc_id"]: r["row"] for r in docs.select("doc_id", F.monotonically_increasing_id().alias("row")).collect()}
    pairs = [(at[k], at[0]) for k in range(1, 40)] + [(at[90 + k], at[3]) for k in range(5)]
    found = near_copies.compared(spark.createDataFrame(pairs, "a long, b long"), docs).collect()
    shingles, texts = near_copies.shingler(), {at[d]: t for d, t in rows}
    exact = {(a, b): near_copies.similarity(shingles(texts[a]), shingles(texts[b])) for a, b in pairs}
    assert len(found) == len(pairs) and {(r["a"], r["b"]): (r["near"], r["d"]) for r in found} == exact


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x"))


@pytest.mark.parametrize("block", [16, caps.BLOCK])
def test_caps_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    x = np.concatenate([base, base[:120] + 0.3 * rng.standard_normal((120, 32)), base[:1] + 0.12 * rng.standard_normal((150, 32)), base[:5] * 3.0])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + k, x[7].tolist()) for k in range(3)] + [(7, x[7].tolist())]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, [float("inf")] * 32), (2005, [1.0, 2.0]), (None, x[7].tolist()), (2006, [])]
    found = caps.near_duplicates(vectors(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    sets = Sets(len(rows))
    for a, b in zip(*np.nonzero(near)):
        sets.join(int(a), int(b))
    got = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
    exact = near.sum(1) - 1
    links = [got[i]["n_links"] for i, _ in rows]
    assert all(a <= b for a, b in zip(links, exact)) and sum(links) >= 0.9 * exact.sum()
    same = [got[i]["component_id"] == rows[sets.find(k)][0] for k, (i, _) in enumerate(rows)]
    assert np.mean(same) > 0.95 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in odd if i is not None)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is None] == [(0, None, False)]


def near_vectors(seed=5, n=2000, dims=64):
    """Vectors far apart, some near copies, a group of near copies and one of equal vectors; (vec_id, embedding)."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    near = base[: n // 10] + 0.4 * rng.standard_normal((n // 10, dims))
    x = np.concatenate([base, near, base[:1] + 0.2 * rng.standard_normal((200, dims)), np.repeat(base[1:2], 50, 0)]).astype(np.float32)
    return x[rng.permutation(len(x))]


def test_caps_keep_little_on_disk(spark, monkeypatch):
    x = near_vectors()
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tables, seen, real = [], [], common.shared_path

    def size(folders, start=""):
        at = [os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names if f.startswith(start)]
        return sum(os.path.getsize(f) for f in at if os.path.exists(f))

    def noted(session, label):
        seen.append((size(tables), size(local, "shuffle_") - before))
        tables.append(real(session, label).removeprefix("file:"))
        return tables[-1]

    monkeypatch.setattr(common, "shared_path", noted)
    before = size(local, "shuffle_")
    found = caps.near_duplicates(rows)
    assert found.filter("n_links > 0").count() > 400
    assert max(t + s for t, s in seen) < 4 * x.nbytes, (seen, x.nbytes)
    assert [os.path.basename(t).split("-")[0] for t in tables if os.path.exists(t)] == ["members"]


@pytest.mark.parametrize("block, choices, bundle, dense", [(40, caps.CHOICES, 0, 10), (40, 10, caps.BUNDLE, caps.DENSE), (caps.BLOCK, 10, 300, 10)])
def test_caps_in_rounds(spark, monkeypatch, block, choices, bundle, dense):
    x = near_vectors(n=600)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(3)
    rows = written(rows, "given")
    monkeypatch.setattr(caps, "CELLS", 512)
    monkeypatch.setattr(caps, "DENSE", dense)
    monkeypatch.setattr(caps, "LEAST", 4)
    monkeypatch.setattr(caps, "PAIRS", 64)
    monkeypatch.setattr(caps, "BLOCK", block)
    monkeypatch.setattr(caps, "CHOICES", choices)
    assert (caps.code_for(600, 64).wide() > 1) == (choices == 10)
    monkeypatch.setattr(caps, "BUNDLE", bundle)
    once = sorted(caps.near_duplicates(rows).collect())
    monkeypatch.setattr(caps, "ROUND_BYTES", 1)
    found, labels = tables_of(monkeypatch, lambda: sorted(caps.near_duplicates(rows).collect()))
    assert labels.count("cap-links") > 4 and found == once
    m = x.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    exact = (m @ m.T >= 0.9).sum(1) - 1
    assert all(r["n_links"] <= e for r, e in zip(found, exact)) and sum(r["n_links"] for r in found) >= 0.995 * exact.sum()


def test_dense_groups_are_compared_once(monkeypatch):
    """Pairs with a filter in common are left out before they are compared, all others are met once."""
    monkeypatch.setattr(caps, "DENSE", 2)
    monkeypatch.setattr(caps, "LEAST", 1)
    rng = np.random.default_rng(2)
    for cut in (0, 130):
        has = rng.random((300, 40)) < np.where(np.arange(40) < 10, 0.75, 0.02)
        row, own = np.nonzero(has)
        first = np.searchsorted(row, np.arange(301))
        met = np.zeros((300, 300), int)
        for x, y in caps._uncommon(300, cut, first[:-1], first[1:], own):
            met[np.ix_(x, y)] += 1
        met = np.triu(met + (met.T if cut == 0 else 0), 1)
        apart = np.triu(has.astype(int) @ has.T.astype(int) == 0, 1)
        if cut:
            apart[:cut, :cut] = apart[cut:] = False
        assert (met[apart] >= 1).all() and (met > 0).sum() < 0.2 * 300 * 300 / 2
        assert not cut or met.max() == 1


def test_caps_on_nothing(spark):
    assert caps.near_duplicates(vectors(spark, [(1, [1.0])]).filter("false")).count() == 0
    assert [r["n_links"] for r in caps.near_duplicates(vectors(spark, [(1, None), (2, None)])).collect()] == [0, 0]


def test_cap_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for n in (1000, 50_000, 10_000_000):
        code = caps.code_for(n, 64)
        tables = code.vectors()
        shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decoded(x, code, tables), caps.decoded(y, code, tables))]
        assert np.mean(shared) >= 0.9


def test_decoding_finds_all_directions():
    code = caps.code_for(200, 16)
    tables = code.vectors()
    x = np.random.default_rng(1).standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cuts = code.cuts()
    for v, found in zip(x, caps.decoded(x, code, tables)):
        exact = []
        for t, (turn, lists) in enumerate(tables):
            parts = [(v @ turn)[cuts[j] : cuts[j + 1]] @ c.T for j, c in enumerate(lists)]
            total = parts[0]
            for p in parts[1:]:
                total = np.add.outer(total, p).ravel()
            exact += [int(i) + t * code.choices**code.blocks for i in np.flatnonzero(total >= code.alpha)]
        assert set(exact) == set(found.tolist())
