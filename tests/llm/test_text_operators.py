"""BPE, chat formatting, personal data and licence scans against the plain way to do the same."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.harness import compare, connect
from tests.llm.helpers import SF, no_documents, odd_documents, words
from veil.llm import bpe, chat, licences, pii
from veil.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_merges_equal_the_library(vocabulary, library):
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "\t", "'s", "'S", "é", " ", "\x1c", "\x85", "1", "٣", "!", "\U0001f600", "​", "ab" * 30, " " * 7, "\r\n", "ſ"]
    encode = bpe.encoder(*vocabulary)
    for text in [*(words(rng, parts, rng.randint(0, 60)) for _ in range(2000)), "a" * 5000 + "xyz" * 3000, "<|endoftext|>"]:
        assert ids(encode(text)) == library.encode_ordinary(text)


def test_merges_by_the_batch_equal_those_of_one(vocabulary):
    rng = random.Random(2)
    parts = ["a", "b", "e", "r", "th", "ing", "é", "ß", "\U0001f600", "1", "Q", "z", "ſ", "\x85"]
    pieces = {words(rng, parts, rng.randint(1, 14)) for _ in range(3000)} | {"x" * 47, "x" * 48, "x" * 49}
    known = bpe._Pieces(vocabulary[0])
    known.learn(pieces, *bpe.merges(vocabulary[0]))
    short = list(known)
    assert len(short) > 0.8 * len(pieces)
    assert all(ids(known[p]) == bpe.merged(p.encode(), vocabulary[0]) for p in short)


@pytest.mark.parametrize("window, overlap", [(40, 16), (64, 64)])
def test_stitched_windows_equal_the_library(spark, vocabulary, library, window, overlap):
    rng = random.Random(window)
    parts = ["a", "b", " ", "\n", "  ", "'s", "'re", "'", "é", " ", "1", "12", "!", "??", "\U0001f600", "ab" * 30, " " * 7, "\r\n"]
    texts = {i: words(rng, parts, rng.randint(0, 150)) for i in range(200)} | {1000: None, 1001: "", 1002: "a" * 700, 1003: " " * 300 + "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = bpe.decode(bpe.encode(docs, *vocabulary, window=window, overlap=overlap), vocabulary[0]).collect()
    assert len(found) == len(texts)
    for r in found:
        assert ids(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["bytes"]) == (texts[r["doc_id"]] or "").encode()


def test_bpe_odd_rows(spark, vocabulary, library):
    docs = odd_documents(spark).withColumn("ids", F.lit("old"))
    found = bpe.encode(docs, *vocabulary).collect()
    assert len(found) == docs.count() and set(found[0].asDict()) == {*docs.columns} - {"text"}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(ids(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]] or "") for r in found)
    assert all(r["_row"] == 1 for r in found)
    assert bpe.encode(no_documents(spark), *vocabulary).count() == 0


def test_bpe_query_over_the_table(spark, library):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(found) == len(given)
    for r in found[::7]:
        own = library.encode_ordinary(given[r["doc_id"]])
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(given[r["doc_id"]].encode()).hexdigest()


def test_chat_round_trip_of_conflicting_texts():
    rng = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", " [/INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN ", "<</TURN>>", "\\", "<", "[", "/", "s>", "a", " ", "\n", ">", "<\\s>", "[\\INST]"]
    for _ in range(10_000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "a>b\\", "", ">"]), words(rng, parts, rng.randint(0, 8))) for _ in range(rng.randint(1, 4))]
        stream = "".join("".join(chat.format_turn(r, t)) for r, t in turns)
        at, found = 0, []
        while turn := chat.parse(stream, at):
            found.append(turn[:2])
            at = turn[2]
        assert found == turns and at == len(stream)
    assert "".join(chat.format_turn("user", "plain")) == "[INST] plain [/INST]"


def test_chat_rows_and_mask(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a </s> b"), (1, 1, "assistant", "a </s> b"), (1, None, "system", None),
        (2, 0, None, "[INST]"), (None, 0, "assistant", "x" * 50_000), (2, 1, "assistant", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    rendered = chat.formatted(turns)
    for r in rendered.collect():
        if r["role"] == "assistant":
            assert chat.unescape(r["formatted"][r["loss_from"] : r["loss_to"]]) == r["text"]
        else:
            assert r["loss_from"] is None
    got = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 16 and got[1]["loss_sha256"] == sha("a </s> b" * 2)
    assert got[1]["turns_sha256"] == sha("system\n\nuser\nhi\nassistant\na </s> b\nassistant\na </s> b\n")
    assert got[2]["turns_sha256"] == sha("\n[INST]\nassistant\n\n") and got[None]["loss_chars"] == 50_000
    assert chat.read_back(chat.formatted(turns.filter("false"))).count() == 0


@pytest.mark.parametrize("name", ["op2_chat_format", "op10_licence_scan"])
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) > 0


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "1", "2", "25", "256", "@", "@", ".", " ", "-", "+", "(", ")", "b.c", "x@y.z", "4111111111111111", "1.2.3.4", "é", "+1 (988) 555-2485"]
    for _ in range(20_000):
        text = words(rng, parts, rng.randint(0, 25))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)  # in linear time


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    pair = rng.normal(size=(3, 3, 3))
    exact = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(4):
            exact[i, y[i]] += w
    exact /= exact.sum(1, keepdims=True)
    assert np.allclose(pii.marginals(unary, edges, pair, rounds=60), exact, atol=1e-4)


def test_skip_factors_add_similar_tokens_and_keep_the_base(spark):
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))
    text = "mail bob.42@mail8.example.com, then bob.42@mail8.example.com or BOB.42@mail8 at noon; rooms 12 3 in 2024"
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], field)[0]
    assert [text[s:e] for k, s, e in added] == ["BOB.42@mail8"]
    plain = "In 2024 we had 12 rooms, 3 of them at 10:30 for 3.14 or 1,200 people."
    assert pii.added_spans([plain], [[]], field) == [[]]


def test_pii_rows(spark):
    docs = odd_documents(spark).withColumn("spans", F.lit(0))
    found = pii.with_spans(docs, pii.fit(docs)).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r["spans"] for r in found}
    assert [(s["kind"], s["base"]) for s in by[9]][:3] == [(0, True), (1, True), (3, True)] and by[2] == [] and by[3] == []
    assert pii.with_spans(no_documents(spark), pii.fit(no_documents(spark))).count() == 0


def test_pii_query_over_the_table(spark):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op5_pii"](spark, SF).collect()
    assert len(found) == len(given)
    for r in found:
        base = plain_spans(given[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[0] == k for b in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def card(rng, valid):
    """Sixteen digits in groups of four that pass the check sum, or don't."""
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        if pii.luhn(digits) == valid:
            return " ".join(digits[i : i + 4] for i in range(0, 16, 4))


def test_skip_factors_carry_a_label(spark):
    """Of sixteen digits the groups alone say little: only a card elsewhere in the document makes a copy with a wrong digit one."""
    rng = random.Random(4)
    field = pii.fit(spark.createDataFrame([(f"pay {card(rng, i % 2 == 0)} now and {card(rng, i % 2 == 0)} then",) for i in range(400)], "text string"))
    without = pii.Field(field.shape, field.adjacent, np.zeros_like(field.skip))
    own = card(rng, True)
    wrong = own[:-1] + str((int(own[-1]) + 1) % 10)
    far = f"card {own} , " + "then some words " * 50
    for text, expected in ((far + f"again {wrong} end", True), (far + f"again {card(rng, False)} end", False)):
        base = pii.base_spans(text)
        assert [text[a:b] for _, a, b in base] == [own]
        added = [text[a:b] for _, a, b in pii.added_spans([text], [base], field)[0]]
        assert bool(added) == expected and all(x in wrong and len(x) >= 9 for x in added)
        assert pii.added_spans([text], [base], without) == [[]]


def test_keys_are_of_entities():
    def linked(text):
        t = pii.tokens_of(text, pii.base_spans(text))
        return {(text[t.start[a] : t.end[a]], text[t.start[b] : t.end[b]]) for a, b in t.skips}

    assert linked("bob.smith42@mail8.example.com x Bob.Smith42@mail8") == {("bob.smith42@mail8.example.com", "Bob.Smith42@mail8")}
    assert linked("10.0.0.1 x 10.0.0.1. x 10.0.0.2") == {("10.0.0.1", "10.0.0.1.")}
    cards = linked("4111 1111 1111 1111 x 4111 1111 1111 1112")
    assert cards == {("4111", "4111"), ("1111", "1111"), ("1111", "1112")} and not linked("4111 1111 1111 1111 x 5222 2222 2222 2222")
    assert ("2485", "555-2485") in linked("+1 988 555 2485 x (988) 555-2485")
    many = pii.tokens_of("a1@b " * 40, [])
    assert len(many.skips) == 39 + 38 and {a for a, _ in many.skips} == set(range(39))


def test_no_cut_in_long_documents(spark):
    """Far occurrences, many spans over one token, and tokens late in a document all count."""
    far = "start q7@z.example.com " + " ".join(f"w{i} gap" for i in range(400)) + " end q7@z"
    t = pii.tokens_of(far, pii.base_spans(far))
    assert (0, len(t.label) - 1) in t.skips
    glued = ",".join(f"a{i}@b.co" for i in range(12))
    assert pii.tokens_of("x" + glued, [(0, 500, 501)] * 9 + [(3, 60, 64)]).label == [3]
    unary = np.zeros((41, pii.LABELS))
    unary[0, 2] = 40.0
    edges = np.array([(i, i + 1) for i in range(40)])
    pair = np.repeat(np.diag([30.0] * pii.LABELS)[None], 40, 0)
    assert pii.marginals(unary, edges, pair).argmax(1).tolist() == [2] * 41  # 40 links away
    assert pii._clear_of([(0, 4), (2, 9), (20, 22)], [(0, 1, 3), (1, 8, 12), (2, 9, 12), (3, 19, 21), (0, 22, 30)]) == [(2, 9, 12), (0, 22, 30)]


def test_training_reads_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "train", lambda docs: seen.append([len(d[1]) for d in docs]) or pii.empty_field())
    docs = spark.createDataFrame([(f"doc{i} " + "7 " * 399,) for i in range(30)] + [("9 " * 9000,)], "text string")
    pii.fit(docs)
    assert sorted(seen[0]) == [400] * 30 + [9000]
    monkeypatch.setattr(pii, "SAMPLE_TOKENS", 2000)
    pii.fit(docs)
    assert seen[1] == [400] * 5


def test_licence_spellings(spark):
    mit = licences.KNOWN["MIT"][1]
    british = "Copyright (c) 2020 Some One\n" + mit.replace("license", "licence").replace("sublicense", "sub-licence").upper()
    rows = [(1, mit), (2, british), (3, mit + " And more."), (4, None), (5, ""), (6, "text\n  released under the MIT licence!\nmore"), (6, "---"), (None, mit)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit("x"))
    got = licences.scanned(docs, licences.known_digests(spark)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["digest"] is None): r for r in got}
    assert by[1, False]["licence"] == by[2, False]["licence"] == by[None, False]["licence"] == "MIT"
    assert by[3, False]["licence"] is None and by[4, True]["licence"] is None
    assert by[6, False]["line_licences"] == "MIT" and by[6, False]["n_licence_lines"] == 1 and by[6, True]["n_licence_lines"] == 0
    assert licences.scanned(docs.filter("false"), licences.known_digests(spark)).count() == 0


def test_full_licence_texts(spark):
    texts = {}
    for r in licences.full_texts(spark).collect():
        texts.setdefault(r["licence"], []).append(r["text"])
    usual = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-SA-4.0"}
    assert usual <= set(texts)
    rows = [(i, n, f"Copyright (c) 2024 Some One\n\n{t.upper()}") for i, (n, t) in enumerate((n, t) for n in sorted(texts) for t in texts[n])]
    bsd = """BSD 3-Clause License\n\nCopyright (c) 2020, A Holder\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.\n\n* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n
* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.\n
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER\nCAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE\nOF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    rows.append((len(rows), "BSD-3-Clause", bsd))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    found = {r["doc_id"]: r["licence"] for r in licences.scanned(docs, licences.known_digests(spark)).collect()}
    assert found == {i: n for i, n, _ in rows}
    one = spark.createDataFrame([("Own-1.0", "You may do as I say.")], "licence string, text string")
    own = licences.scanned(spark.createDataFrame([(1, "you may do as I say")], "doc_id long, text string"), licences.known_digests(spark, texts=one))
    assert own.first()["licence"] == "Own-1.0"
