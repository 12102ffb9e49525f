"""Personal data: base patterns, and a skip-chain conditional random field that carries labels across a document.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field then labels every token that
has a digit or an at sign (all other tokens are fixed to "none"; they cut the chain into segments that don't depend on
each other). Its factors are: the shape of a token and of its neighbours, the labels of adjacent tokens, and the
labels of distant tokens of the same or a similar entity: addresses with one local part, numbers (over all adjacent number tokens) that
begin or end with the same digits, dotted numbers of the same parts. Each occurrence is joined to the one before and to the
first, so a label reaches all of them in two steps. Labels are inferred by loopy sum-product messages over all segments of
a batch of documents at once, until none changes. Tokens that patterns found are clamped to their label; where the field is sure that other
tokens belong to an entity, their span is added. Base spans always stay, and no added span overlaps one.

The factors are trained piecewise on the base labels of a bounded sample of whole documents: shapes by multinomial logistic regression, the
labels of adjacent and of similar tokens from how often they go together.

A null text counts as empty and has no spans. Positions are code points, end exclusive. Rows are independent of each
other; other columns pass through. An empty table gives an empty result and trains a field that adds nothing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import column, small_batches, texts_of, written

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1

#: Most documents of the training sample, and most tokens of all of them; the sample ends with the last whole document that fits.
SAMPLE, SAMPLE_TOKENS = 4_000, 300_000
#: Marginal probability from which a span is added; how much of an old message stays, and the change that counts as none.
SURE, DAMPING, STILL = 0.9, 0.3, 1e-6
#: From this round on steps shrink by this factor, so messages that would go in circles come to rest.
CALM, SHRINK = 60, 0.95
#: Skip factors favour equal labels by at most this much (log odds), so a shape that is clear is not outvoted.
SKIP_MOST = 3.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the same matches as with three parts required, but a run of digits is passed in one step
_IP = re.compile(r"([0-9]+)(?:\.([0-9]+)\.([0-9]+)\.([0-9]+))?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s]+")
_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            done = end.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if m[4] and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.sub("", m[0])) <= 15]
    return out


FEATURES = 27


def _shape(token: str) -> list[float]:
    digits = _DIGIT.sub("", token)
    n, parts = len(digits), token.strip(".,;:()").split(".")
    letters = any(c.isalpha() for c in token)
    return [
        1, "@" in token, bool(_DOMAIN.match(token.rpartition("@")[2])) and "@" in token, token[:1] == "+", letters,
        n == 1, n == 2, n == 3, n == 4, 5 <= n <= 6, n == 7, 8 <= n <= 10, 11 <= n <= 15, 16 <= n <= 19, n > 19,
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts), len(parts) > 4,
        16 <= n <= 19 and luhn(digits), "(" in token or ")" in token, "-" in token, "/" in token or ":" in token,
    ]


_NUMBER = re.compile(r"[+(]*[0-9][0-9().+-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")


def keys_of(tokens: list[str], adjacent: list[bool]) -> list[list[str]]:
    """Per token, what it is similar by; tokens that share a key are joined by skip factors.

    An address goes by its local part, a dotted number by its parts. Adjacent number tokens are one number: if it has ten digits or
    more it goes by its first eight and by its last seven, each with the token's place from that end.
    """
    bare = [t.strip(".,;:!?()<>[]{}\"'") for t in tokens]
    keys: list[list[str]] = [[] for _ in tokens]
    i = 0
    while i < len(tokens):
        if "@" in tokens[i]:
            local, _, domain = bare[i].lower().rpartition("@")
            keys[i].append(f"@{local or domain}")
        elif _DOTTED.fullmatch(bare[i]):
            keys[i].append(f".{bare[i]}")
        elif _NUMBER.fullmatch(bare[i]):
            j = i + 1
            while j < len(tokens) and adjacent[j] and _NUMBER.fullmatch(bare[j]) and not _DOTTED.fullmatch(bare[j]):
                j += 1
            digits = _DIGIT.sub("", "".join(bare[i:j]))
            if len(digits) >= 10:
                for k in range(i, j):
                    keys[k] += [f"^{digits[:8]}:{k - i}", f"#{digits[-7:]}:{j - k}"]
            i = j
            continue
        i += 1
    return keys


@dataclass
class Tokens:
    """Candidate tokens of one text."""

    start: list[int]
    end: list[int]
    label: list[int]  # from the patterns
    features: np.ndarray
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int]]


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    found = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text) if _has_candidate(m[0])]
    adjacent = [i > 0 and text[found[i - 1][1] : s].isspace() for i, (s, _, _) in enumerate(found)]
    label = [NONE] * len(found)
    spans = sorted((s, e, k) for k, s, e in base)
    at = 0
    for i, (s, e, _) in enumerate(found):
        while at < len(spans) and spans[at][1] <= s:
            at += 1
        for j in range(at, len(spans)):
            a, b, k = spans[j]
            if a >= e:
                break
            if b > s:
                label[i] = k
                break
    shapes = [_shape(t) for _, _, t in found]
    rows = []
    for i, own in enumerate(shapes):
        before = shapes[i - 1] if adjacent[i] else None
        after = shapes[i + 1] if i + 1 < len(found) and adjacent[i + 1] else None
        rows.append([*own, before is not None, bool(before and before[3]), bool(before and before[18]), after is not None, bool(after and after[18]), bool(after and after[19])])
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skips: set[tuple[int, int]] = set()
    for i, keys in enumerate(keys_of([t for _, _, t in found], adjacent)):
        for key in keys:
            if key in last:
                skips |= {(last[key], i), (first[key], i)}
            first.setdefault(key, i)
            last[key] = i
    features = np.array(rows, np.float64).reshape(len(found), FEATURES)
    return Tokens([f[0] for f in found], [f[1] for f in found], label, features, [(i - 1, i) for i in range(1, len(found)) if adjacent[i]], sorted(skips))


_CANDIDATE = re.compile(r"[0-9@]")


def _has_candidate(token: str) -> bool:
    return _CANDIDATE.search(token) is not None


@dataclass(frozen=True)
class Field:
    """Log potentials: shape (features x labels), adjacent and skip (labels x labels)."""

    shape: np.ndarray
    adjacent: np.ndarray
    skip: np.ndarray


def empty_field() -> Field:
    shape = np.zeros((FEATURES, LABELS))
    shape[0, NONE] = 10.0
    return Field(shape, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))


def train(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 300) -> Field:
    """Piecewise training from (features, labels, chain pairs, skip pairs) of each document."""
    if not sum(len(d[1]) for d in docs):
        return empty_field()
    x = np.concatenate([d[0] for d in docs])
    y = np.concatenate([d[1] for d in docs])
    onehot = np.eye(LABELS)[y]
    w, speed = np.zeros((x.shape[1], LABELS)), np.zeros((x.shape[1], LABELS))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed + x.T @ (onehot - p) / len(x) - 1e-4 * w
        w += speed

    def together(pick: int) -> np.ndarray:
        counts = np.ones((LABELS, LABELS)) * 0.5
        for d in docs:
            np.add.at(counts, (d[1][d[pick][:, 0]], d[1][d[pick][:, 1]]), 1)
        joint = counts / counts.sum()
        return np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))

    skip = np.clip(np.diag(together(3)), 0, SKIP_MOST)
    return Field(w, np.clip(together(2), -4, 4), np.diag(np.maximum(skip, 1.0)))


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product: `unary` n x labels, `edges` m x 2, `pair` m x labels x labels, all as logarithms.

    Messages go on until none changes, or for `rounds`. A chain is passed from end to end before steps shrink.
    """
    if not len(edges):
        b = unary - unary.max(1, keepdims=True)
        p = np.exp(b)
        return p / p.sum(1, keepdims=True)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.zeros((2 * m, unary.shape[1]))
    # steps shrink only when a message could have gone along the longest run of adjacent tokens
    near = np.unique(edges[edges[:, 1] == edges[:, 0] + 1, 0])
    breaks = np.flatnonzero(np.diff(near) > 1)
    longest = int(np.diff(np.concatenate([[-1], breaks, [len(near) - 1]])).max(initial=0))
    step, calm = 1 - DAMPING, max(CALM, longest)
    for turn in itertools.count():
        if turn == rounds:
            break
        if turn >= calm:
            step *= SHRINK
        belief = unary.copy()
        np.add.at(belief, dst, messages)
        cavity = belief[src] - messages[back]
        cavity -= cavity.max(1, keepdims=True)
        new = np.log(np.einsum("ea,eab->eb", np.exp(cavity), table) + 1e-300)
        new -= new.max(1, keepdims=True)
        if step * np.abs(new - messages).max() < STILL:
            break
        messages = (1 - step) * messages + step * new
    belief = unary.copy()
    np.add.at(belief, dst, messages)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field adds to the base spans of each text; all texts are one graph of separate parts."""
    docs = [tokens_of(t, b) for t, b in zip(texts, bases)]
    firsts = np.cumsum([0, *(len(d.label) for d in docs)])
    if not firsts[-1]:
        return [[] for _ in texts]
    unary = np.concatenate([d.features for d in docs]) @ field.shape
    label = np.concatenate([np.array(d.label, np.int64) for d in docs])
    unary[label != NONE] = -30.0
    unary[label != NONE, label[label != NONE]] = 0.0
    chain = [(a + f, b + f) for d, f in zip(docs, firsts) for a, b in d.chain]
    skips = [(a + f, b + f) for d, f in zip(docs, firsts) for a, b in d.skips]
    edges = np.array(chain + skips, np.int64).reshape(-1, 2)
    pair = np.concatenate([np.repeat(field.adjacent[None], len(chain), 0), np.repeat(field.skip[None], len(skips), 0)])
    p = marginals(unary, edges, pair)
    best, sure = p.argmax(1), p.max(1) >= SURE
    out: list[list[tuple[int, int, int]]] = []
    for d, f, text, base in zip(docs, firsts, texts, bases):
        joined = {b for _, b in d.chain}
        taken = sorted((s, e) for _, s, e in base)
        spans: list[tuple[int, int, int]] = []
        open_kind = NONE
        for i in range(len(d.label)):
            kind = int(best[f + i]) if sure[f + i] and d.label[i] == NONE else NONE
            if kind == NONE:
                open_kind = NONE
                continue
            s, e = _trimmed(text, d.start[i], d.end[i])
            if kind == open_kind and i in joined and kind in (2, 3):
                spans[-1] = (kind, spans[-1][1], e)
            elif s < e:
                spans.append((kind, s, e))
            open_kind = kind
        out.append(_clear_of(taken, spans))
    return out


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and not (text[s].isalnum() or text[s] == "+"):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    return s, e


def _clear_of(taken: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of `spans` by start, those that overlap none of `taken` (sorted); one sweep over both."""
    out, at, reach = [], 0, 0
    for kind, s, e in spans:
        while at < len(taken) and taken[at][0] <= s:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s and (at == len(taken) or taken[at][0] >= e):
            out.append((kind, s, e))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from the base labels of at most `sample` documents that have candidate tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in texts_of(batch, "text"):
                t = tokens_of(text, base_spans(text))
                flat = lambda pairs: [x for p in pairs for x in p]
                rows.append((len(t.label), t.features.astype("<f4").tobytes(), t.label, flat(t.chain), flat(t.skips)))
            cols = list(zip(*rows)) if rows else [()] * 5
            ints = pa.list_(pa.int32())
            types = (pa.int64(), pa.binary(), ints, ints, ints)
            yield pa.RecordBatch.from_arrays([column(batch, "_o"), *(pa.array(c, t) for c, t in zip(cols, types))], ["_o", "n", "x", "y", "chain", "skips"])

    some = docs.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("_o"), "text")
    order = some.select("_o").distinct().orderBy("_o").limit(sample).agg(F.max("_o")).first()[0]
    if order is None:
        return empty_field()
    rows = small_batches(some.filter(F.col("_o") <= order)).mapInArrow(run, "_o long, n long, x binary, y array<int>, chain array<int>, skips array<int>")
    # of equal texts one; whole documents, up to the bound on all their tokens
    one = rows.groupBy("_o").agg(F.min(F.struct("n", "x", "y", "chain", "skips")).alias("d")).select("_o", "d.*").filter(F.col("n") <= SAMPLE_TOKENS)
    one = written(one, "pii-sample")
    taken, last = 0, None
    for r in one.select("_o", "n").orderBy("_o").collect():  # `sample` rows at most
        taken += r["n"]
        if taken > SAMPLE_TOKENS:
            break
        last = r["_o"]
    if last is None:
        return empty_field()
    got = one.filter(F.col("_o") <= last).orderBy("_o").toArrow().to_pylist()
    pairs = lambda v: np.array(v, np.int64).reshape(-1, 2)
    return train([(np.frombuffer(g["x"], "<f4").reshape(-1, FEATURES).astype(np.float64), np.array(g["y"], np.int64), pairs(g["chain"]), pairs(g["skips"])) for g in got])


SPANS = "array<struct<kind:int,start:int,stop:int,base:boolean>>"


def with_spans(docs: DataFrame, field: Field, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` without the text, with `out`: all spans by kind, then start; `base` tells those of the patterns."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = texts_of(batch, text)
            some = [i for i, t in enumerate(texts) if _CANDIDATE.search(t)]
            bases = [base_spans(texts[i]) for i in some]
            more = added_spans([texts[i] for i in some], bases, field)
            found: list[list[dict]] = [[] for _ in texts]
            for i, b, m in zip(some, bases, more):
                spans = [(*x, True) for x in b] + [(*x, False) for x in m]
                found[i] = [dict(zip(("kind", "start", "stop", "base"), x)) for x in sorted(spans)]
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), pa.array(found, kind)], [*(f.name for f in keep), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` {SPANS}"])
    return small_batches(docs).mapInArrow(run, schema)


def joined(spans):
    """kind:start:end of each span, joined by commas, as a column."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
