"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction with a cap around it: a vector falls into it if their inner product is `alpha` or more. The
directions are all concatenations of a structured random code: the dimensions are cut into blocks, each block has
a short list of random unit vectors, and a direction takes one of each. So a vector is decoded to the list of
all filters it falls into without visiting every direction: choices are dropped as soon as the best that the blocks
left can add isn't enough. Vectors that share a filter are compared: in single precision first, and in double precision
where that is too near the bound to tell.

Equal vectors are folded first and count as often as they occur. A pair that shares several filters counts in the least
of them only, so links are summed per vector without a list of pairs; links for the components are reduced to a spanning
forest in each comparison. A filter with many vectors is cut into blocks, and each pair of blocks is a comparison
of its own. Cap and code follow from the number of vectors: about `LOAD` vectors fall into a filter, and
vectors at the similarity asked for share about `SHARED` filters in each of `TABLES` tables, so links are found with high probability, none
is invented, and a rerun finds the same.

Each vector is decoded and written once, beside the list of its filters. It then goes to each bundle of filters that has some of its own,
with the list of these and all smaller ones. Bundles are taken in rounds, each a range of their numbers, so that what one round sends stays
below `ROUND_X` times the vectors, however many filters a vector has. The shuffled rows of a round go before the next begins.

Vectors that are null, zero, or hold null, NaN or infinite components link with nothing; so do vectors of different
length, and rows without a vec_id, whose component is null. Repeated rows are rows of their own and link with each other.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import column, components, counted, forest, freed_shuffles, scratch, small_batches, written

COSINE = 0.9
#: Vectors that fall into one filter, and filters of one table that a pair at the threshold shares, on average.
LOAD, SHARED = 1024.0, 1.5
#: Tables, each with a rotation of its own.
TABLES = 8
#: Most choices of one block of dimensions, and vectors of one block of a filter.
CHOICES, BLOCK = 512, 8192
#: What a round sends: so many bytes for each byte of the vectors, or so many in all if that is more.
ROUND_X, ROUND_BYTES = 1.5, 256_000_000
#: Vectors of all filters of a bundle together, beyond which its filters are taken one by one.
BUNDLE = 700_000
#: Vectors whose filters are counted to find the crowded ones, at most about twice as many.
COUNTED = 1 << 20
#: Rows of a comparison from which on, and pairs of rows down to which, it is cut by filters that many have.
DENSE, LEAST = 1536, 1 << 14
#: Rows and cells of a table of inner products, pairs held before they are counted, and pairs that double precision settles at once.
STRIP, CELLS, HELD, PAIRS = 128, 1 << 19, 1 << 18, 1 << 16
SEED = 17


@dataclass(frozen=True)
class Code:
    """Directions of one number of dimensions: block j covers dims cuts[j]:cuts[j+1] and has `choices` unit vectors.

    Each table turns the vectors by a rotation of its own first, as a vector that is uneven over the blocks of one table
    falls into too few of its filters.
    """

    dims: int
    blocks: int
    choices: int
    alpha: float
    tables: int

    def vectors(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Rotation and code of each table."""
        rng = np.random.default_rng([SEED, self.dims, self.blocks, self.choices])
        out = []
        for _ in range(self.tables):
            turn = np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0]
            lists = []
            for width in np.diff(self.cuts()):
                v = rng.standard_normal((self.choices, width))
                lists.append(v / np.linalg.norm(v, axis=1, keepdims=True) / sqrt(self.blocks))
            out.append((turn, lists))
        return out

    def cuts(self) -> np.ndarray:
        return np.linspace(0, self.dims, self.blocks + 1).astype(int)

    def size(self) -> int:
        """Filters of all tables."""
        return self.choices**self.blocks * self.tables

    def wide(self) -> int:
        """Filters of a bundle: those with the same choices of all blocks but the last, which a vector often falls into together."""
        return self.choices if self.blocks > 1 else 1

    def kind(self) -> str:
        """How a filter's number is stored."""
        return "<i4" if self.size() < 2**31 else "<i8"


def _over(dims: int, steps: int = 20001) -> tuple[np.ndarray, np.ndarray]:
    """t and P(one coordinate of a random unit vector > t)."""
    t = np.linspace(-1, 1, steps)
    w = np.maximum(1 - t * t, 0) ** ((dims - 3) / 2) if dims > 2 else 1 / np.sqrt(np.maximum(1 - t * t, 1e-6))
    tail = w[::-1].cumsum()[::-1]
    return t, tail / tail[0]


def code_for(n: int, dims: int, cosine: float = COSINE) -> Code:
    """The code for n vectors of `dims` dimensions."""
    if dims < 8:  # so few dimensions have no room for thin caps: one wide table for each sign is enough
        return Code(dims, 1, 8 * dims, 0.5, TABLES)
    p = min(0.05, LOAD / max(n, 1))
    t, tail = _over(dims)
    alpha = float(t[np.argmax(tail <= p)])
    # P(the mate is in the cap | the vector is)
    a = np.linspace(alpha, min(1.0, alpha + 0.4), 400)
    weight = np.maximum(1 - a * a, 0) ** ((dims - 3) / 2)
    need = (alpha - cosine * a) / (sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(1 - a * a, 1e-9)))
    t2, tail2 = _over(dims - 1)
    both = float((weight * np.interp(need, t2, tail2)).sum() / weight.sum())
    filters = SHARED / (p * both)
    blocks = max(1, min(dims // 4, ceil(log(filters) / log(CHOICES))))
    filters *= max(1.0, (blocks / 2) ** 2)  # scores over more blocks vary more between vectors
    return Code(dims, blocks, max(2, ceil(filters ** (1 / blocks))), alpha, TABLES)


def _decoded(x: np.ndarray, code: Code, tables: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, number) of all filters that unit vectors fall into, by row and number."""
    cuts, size = code.cuts(), code.choices**code.blocks
    rows, names = [], []
    for number, (turn, lists) in enumerate(tables):
        turned = x @ turn
        scores = [turned[:, cuts[j] : cuts[j + 1]] @ v.T for j, v in enumerate(lists)]
        best = np.stack([s.max(1) for s in scores])
        rest = best[::-1].cumsum(0)[::-1]  # what blocks j and later can add
        row = np.flatnonzero(rest[0] >= code.alpha)
        total, name = np.zeros(len(row)), np.zeros(len(row), np.int64)
        for j, s in enumerate(scores):
            least = code.alpha - (rest[j + 1] if j + 1 < len(scores) else np.zeros(len(x)))
            top = np.full(len(x), -np.inf)
            np.maximum.at(top, row, total)
            own, pick = np.nonzero(s >= (least - top)[:, None])
            score, first = s[own, pick], np.searchsorted(own, np.arange(len(x) + 1))
            n = np.diff(first)[row]
            at = np.repeat(np.arange(len(row)), n)
            to = np.arange(len(at)) + np.repeat(first[row] - (np.cumsum(n) - n), n)
            sums = total[at] + score[to]
            keep = sums >= least[row[at]]
            at, to = at[keep], to[keep]
            row, total, name = row[at], sums[keep], name[at] * code.choices + pick[to]
        rows.append(row)
        names.append(name + number * size)
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return row[order], name[order]


def decoded(x: np.ndarray, code: Code, tables: list[tuple[np.ndarray, list[np.ndarray]]]) -> list[np.ndarray]:
    """For each unit vector (row of x), the sorted numbers of all filters it falls into."""
    row, name = _decoded(x, code, tables)
    return np.split(name, np.searchsorted(row, np.arange(1, len(x))))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The next counts[i] values as bytes, for each i."""
    ends = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _values(data: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The opposite: where each row's values begin and the last ones end, and all values."""
    data = data.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    size = np.dtype(kind).itemsize
    if ends[0] == ends[-1]:
        return np.zeros(len(ends), np.int64), np.zeros(0, kind)
    values = np.frombuffer(data.buffers()[2], kind, (int(ends[-1]) - int(ends[0])) // size, int(ends[0]))
    return (ends.astype(np.int64) - int(ends[0])) // size, values


def _matrix(data: pa.Array, width: int) -> np.ndarray:
    return _values(data, "<f8" if width == 8 else "<f4")[1].reshape(len(data), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _valid(batch: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray, pa.Array]:
    """The rows whose vectors can link, their dimensions and components."""
    there = pc.and_(pc.is_valid(column(batch, "vec_id")), pc.fill_null(pc.greater(pc.list_value_length(column(batch, "embedding")), 0), False))
    batch = batch.filter(there)

    def values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = column(batch, "embedding")
        v = pc.cast(x.flatten(), pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # a null is NaN
        return pc.list_value_length(x).to_numpy().astype(np.int64), v

    dims, v = values(batch)
    row = np.repeat(np.arange(len(dims)), dims)
    good = (np.bincount(row, ~np.isfinite(v), len(dims)) == 0) & (np.bincount(row, v != 0, len(dims)) > 0)
    if not good.all():
        batch = batch.filter(pa.array(good))
        dims, v = values(batch)
    return batch, dims, _binary((v + 0.0).astype("<f8" if width == 8 else "<f4"), dims)


def _keys(numbered: DataFrame, width: int) -> DataFrame:
    """(_row, vec_id, dims, digest) of the vectors that can link; equal vectors have equal digests."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch, dims, data = _valid(batch, width)
            ends, raw = _values(data, "u1")
            raw, ends = raw.tobytes(), ends.tolist()
            digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "_row"), column(batch, "vec_id"), pa.array(dims, pa.int32()), pa.array(digest, pa.binary())], ["_row", "vec_id", "dims", "digest"]
            )

    return small_batches(numbered, 2048).mapInArrow(run, "_row long, vec_id long, dims int, digest binary")


def _with_filters(distinct: DataFrame, codes: dict[int, Code], width: int) -> DataFrame:
    """(dims, rep, copies, data, own, bundles): each distinct vector, its filters and how many bundles they are in, of rows (_row, vec_id, copies, embedding)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {d: c.vectors() for d, c in codes.items()}
        for batch in it:
            batch, dims, data = _valid(batch, width)
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                part, own_data = batch.take(at), data.take(at)
                row, name = _decoded(_unit(_matrix(own_data, width)), codes[d], ready[d])
                own, bundle = _binary(name.astype(codes[d].kind()), np.bincount(row, minlength=len(at))), name // codes[d].wide()
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])])[: len(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dims[dims == d], pa.int32()), column(part, "_row"), column(part, "copies"), own_data, own, pa.array(np.bincount(row[new], minlength=len(at)), pa.int32())],
                    ["dims", "rep", "copies", "data", "own", "bundles"],
                )

    return small_batches(distinct, 2048).mapInArrow(run, "dims int, rep long, copies long, data binary, own binary, bundles int")


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = column(batch, "dims").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch if (dims == d).all() else batch.filter(pa.array(dims == d))


@dataclass(frozen=True)
class Crowded:
    """Filters of over `BLOCK` vectors, sorted, and the blocks that each is cut into; bundles whose filters are taken one by one, sorted."""

    names: np.ndarray
    blocks: np.ndarray
    loose: np.ndarray


def _among(x: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are among the sorted names, and at which place."""
    if not len(names):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    place = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return names[place] == x, place


def _crowded(members: DataFrame, codes: dict[int, Code], n: int) -> dict[int, Crowded]:
    """What is crowded, by dims. Of very many vectors some are counted and stand for the rest: how a filter is cut changes no result."""
    each = max(1, n // COUNTED)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for d, part in _by_dims(batch):
                names, count = np.unique(_values(column(part, "own"), codes[d].kind())[1], return_counts=True)
                cols = [np.full(len(names), d, np.int32), names.astype(np.int64) // codes[d].wide(), names.astype(np.int64), count]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dims", "bundle", "filter", "n"])

    some = members.filter(F.pmod(F.xxhash64("rep"), F.lit(each)) == 0).select("dims", "own")
    counts = small_batches(some, 2048).mapInArrow(run, "dims int, bundle long, filter long, n long")
    counts = written(counts.groupBy("dims", "bundle", "filter").agg((F.sum("n") * each).alias("n")), "counts")
    # as many rows as all filters of all vectors divided by BLOCK or BUNDLE, at most
    full = counts.filter(F.col("n") > BLOCK).select("dims", "filter", F.ceil(F.col("n") / BLOCK).alias("nb")).orderBy("dims", "filter").toArrow()
    loose = counts.groupBy("dims", "bundle").agg(F.sum("n").alias("n")).filter(F.col("n") > BUNDLE).orderBy("dims", "bundle").toArrow()
    dims, names, blocks = (full.column(c).to_numpy().astype(np.int64) for c in ("dims", "filter", "nb"))
    of, bundles = (loose.column(c).to_numpy().astype(np.int64) for c in ("dims", "bundle"))
    return {d: Crowded(names[dims == d], blocks[dims == d], bundles[of == d]) for d in codes}


def _sent(members: DataFrame, codes: dict[int, Code], crowded: dict[int, Crowded], turn: int, rounds: int) -> DataFrame:
    """(unit, dims, i, j, b, rep, copies, data, own) of one round.

    Unit -1 - k is bundle k, and `own` a vector's filters up to its last one there. Unit k is filter k alone, and `own` the smaller ones; a
    vector of block b then goes to all pairs of blocks i <= j that hold b.
    """
    names = ["unit", "dims", "i", "j", "b", "rep", "copies", "data", "own"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for d, part in _by_dims(batch):
                code, full = codes[d], crowded[d]
                first, own = _values(column(part, "own"), code.kind())
                low, high = (code.size() // code.wide() * k // rounds * code.wide() for k in (turn, turn + 1))
                at = np.flatnonzero((own >= low) & (own < high))
                row = np.searchsorted(first, at, "right") - 1
                bundle = own[at].astype(np.int64) // code.wide()
                alone, place = _among(own[at], full.names)
                nb = np.where(alone, full.blocks[place] if len(full.blocks) else 1, 1)
                alone |= _among(bundle, full.loose)[0] | (code.wide() == 1)
                together = np.flatnonzero(~alone)
                last = np.ones(len(together), bool)
                last[:-1] = (row[together[1:]] != row[together[:-1]]) | (bundle[together[1:]] != bundle[together[:-1]])
                use = np.sort(np.concatenate([np.flatnonzero(alone), together[last]]))
                at, row, bundle, alone, nb = (v[use] for v in (at, row, bundle, alone, nb))
                mixed = column(part, "rep").to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                b = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % nb
                unit, end = np.where(alone, own[at], -1 - bundle), np.where(alone, at, at + 1)
                every = np.repeat(np.arange(len(at)), nb)
                other = np.arange(len(every)) - np.repeat(np.cumsum(nb) - nb, nb)
                for s in range(0, len(every), 8192):
                    to, o = every[s : s + 8192], other[s : s + 8192]
                    begin = first[row[to]]
                    n = end[to] - begin
                    lists = own[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]
                    take = part.take(pa.array(row[to]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(unit[to], pa.int64()), column(take, "dims"), pa.array(np.minimum(b[to], o), pa.int32()), pa.array(np.maximum(b[to], o), pa.int32()),
                        pa.array(b[to], pa.int32()), column(take, "rep"), column(take, "copies"), column(take, "data").cast(pa.binary()), _binary(lists, n),
                    ], names)

    sending = members.select("dims", "rep", "copies", "data", "own")
    return small_batches(sending, 2048).mapInArrow(run, "unit long, dims int, i int, j int, b int, rep long, copies long, data binary, own binary")


def _apart(p: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of the pairs of rows p, q, the places of those that have none of their filters own[begin:end] in common.

    Rows are marked with bits for filters that several hold, the most frequent first; they settle nearly all pairs.
    """
    mark = np.zeros(len(begin), bool)
    mark[p] = mark[q] = True
    rows = np.flatnonzero(mark)
    local = np.cumsum(mark) - 1
    n = (end - begin)[rows]
    row = np.repeat(np.arange(len(rows)), n)
    names, at, count = np.unique(own[np.arange(n.sum()) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)], return_inverse=True, return_counts=True)
    often = np.argsort(-count, kind="stable")[: int((count > 1).sum())]
    place = np.full(len(names), len(often))
    place[often] = np.arange(len(often))
    at = place[at]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    left, p, q = np.arange(len(p)), local[p], local[q]
    for w in range(0, len(often), 52):
        a, b = np.searchsorted(at, [w, min(w + 52, len(often))])
        bits = np.bincount(row[a:b], 2.0 ** (at[a:b] - w), len(rows)).astype(np.int64)  # sums of different powers below 2^52 are exact
        keep = (bits[p] & bits[q]) == 0
        if not keep.all():
            left, p, q = left[keep], p[keep], q[keep]
        if not len(left):
            break
    return left


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row that each row is linked with, after the links p-q."""
    rows = np.arange(len(root))
    left, right = rows.copy(), rows.copy()
    left[q[::-1]] = p[::-1]  # one link for each q and each p first: of many pairs, few others are left then
    right[p[::-1]] = q[::-1]
    for a, b in ((rows, left), (rows, right), (p, q)):
        u, v = root[a], root[b]
        if len(at := np.flatnonzero(u != v)):
            low, up = forest(u[at], v[at])
            to = rows.copy()
            to[low] = up
            root = to[root]
    return root


def _uncommon(n: int, cut: int, begin: np.ndarray, end: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and rows whose pairs are to be compared, both the same array where these meet each other; each pair at most once.

    Left out are only pairs with a filter own[begin:end] in common. In a large group of near copies that is nearly all of them:
    those that hold its most frequent filter needn't meet, and so on with the next one for the others.
    """
    rows = np.arange(n)
    todo = [(rows[:cut], rows[cut:], 0) if cut else (rows, rows, 0)]
    bits, often = np.zeros(n, np.int64), 0
    if n >= DENSE:
        size = end - begin
        names, at, count = np.unique(own[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)], return_inverse=True, return_counts=True)
        most = np.argsort(-count, kind="stable")[:52]
        most = most[count[most] > n // 16]
        often, place = len(most), np.full(len(names), -1)
        place[most] = np.arange(often)
        at, row = place[at], np.repeat(rows, size)
        bits = np.bincount(row[at >= 0], 2.0 ** at[at >= 0], n).astype(np.int64)
    while todo:
        x, y, k = todo.pop()
        if not len(x) or not len(y):
            continue
        while k < often and len(x) * len(y) > LEAST:
            a = (bits[x] >> k & 1) == 1
            b = a if x is y else (bits[y] >> k & 1) == 1
            k += 1
            if 8 * int(a.sum()) * int(b.sum()) > len(x) * len(y):
                rest = x[~a]
                todo += [(x[a], rest, k), (rest, rest, k)] if x is y else [(x[a], y[~b], k), (rest, y[b], k), (rest, y[~b], k)]
                break
        else:
            yield x, y


def _compared(
    raw: np.ndarray, use: np.ndarray, single: np.ndarray, copies: np.ndarray, cut: int, begin: np.ndarray, end: np.ndarray, own: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """For each vector raw[use] the links counted here, and the least row it is linked with.

    `single` has them at length 1. Rows before `cut` meet the others, all rows each other if it is 0.
    """
    slack = 1e-6 + 2.0**-23 * single.shape[1]  # over the error of single precision
    n, root = np.zeros(len(single)), np.arange(len(single))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        nonlocal n, root
        p, q = (np.concatenate(v) for v in zip(*held))
        held.clear()
        left = _apart(p, q, begin, end, own)
        p, q = p[left], q[left]
        n += np.bincount(p, copies[q], len(n)) + np.bincount(q, copies[p], len(n))
        root = _joined(root, p, q)

    for x, y in _uncommon(len(n), cut, begin, end, own):
        left, right = single[x], single[y]  # copies: a product of a table with itself takes a slower path
        step = max(1, min(STRIP, CELLS // len(y)))
        for s in range(0, len(x), step):
            first = s if x is y else 0
            g = (left[s : s + step] @ right[first:].T).ravel()
            at = np.flatnonzero(g >= cosine - slack)
            p, q = np.divmod(at, len(y) - first)
            keep = (p < q) if x is y else np.ones(len(at), bool)
            p, q, near = x[p + s], y[q + first], g[at] >= cosine + slack
            if len(unsure := np.flatnonzero(keep & ~near)):
                for k in np.array_split(unsure, 1 + len(unsure) // PAIRS):
                    near[k] = np.einsum("ij,ij->i", _unit(raw[use[p[k]]]), _unit(raw[use[q[k]]])) >= cosine
            keep &= near
            if keep.any():
                held.append((p[keep], q[keep]))
                if sum(len(v[0]) for v in held) >= HELD:
                    settle()
    if held:
        settle()
    return n, root


def linked(members: DataFrame, codes: dict[int, Code], crowded: dict[int, Crowded], rounds: int, width: int, cosine: float) -> DataFrame:
    """(rep, n, other): for each distinct vector, links that one comparison counts for it, and a spanning link or -1.

    `members` has dims, rep, copies, data, own.
    """

    def compare(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The comparisons of a bundle's filters, or of a filter's pair of blocks or one block with itself."""
        unit, d, i, j = (column(rows, c)[0].as_py() for c in ("unit", "dims", "i", "j"))
        rep, copies = column(rows, "rep").to_numpy(), column(rows, "copies").to_numpy()
        first, own = _values(column(rows, "own"), codes[d].kind())
        raw = _matrix(column(rows, "data"), width)
        single = np.empty(raw.shape, np.float32)
        for s in range(0, len(raw), 4096):
            single[s : s + 4096] = _unit(raw[s : s + 4096])
        if unit >= 0:
            cut = 0 if i == j else int((column(rows, "b").to_numpy() == i).sum())
            each = [(np.arange(len(rep)), first[1:], cut)] if i == j or 0 < cut < len(rep) else []
        else:
            at = np.flatnonzero(own >= (-1 - unit) * codes[d].wide())
            at = at[~_among(own[at], crowded[d].names)[0]]
            at = at[np.argsort(own[at], kind="stable")]
            cuts = [0, *(np.flatnonzero(own[at[1:]] != own[at[:-1]]) + 1).tolist(), len(at)]
            each = ((np.searchsorted(first, at[a:b], "right") - 1, at[a:b], 0) for a, b in zip(cuts, cuts[1:]) if b > a + 1)
        for use, end, cut in each:
            n, root = _compared(raw, use, single[use], copies[use], cut, first[use], end, own, cosine)
            hit = np.flatnonzero(n)
            if len(hit):
                yield rep[use[hit]], n[hit].astype(np.int64), np.where(root[hit] == hit, -1, rep[use[root[hit]]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in zip(*out)], ["rep", "n", "other"])
                out.clear()

        def done() -> None:
            if sum(len(x) for x in held) > 1:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held.clear()
                out.extend(compare(rows))
            held.clear()

        now, held = None, []
        for batch in it:
            key = np.stack([column(batch, c).to_numpy().astype(np.int64) for c in group])
            begins = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()] if len(batch) else []
            for a, b in zip(begins, [*begins[1:], len(batch)]):
                if (k := tuple(key[:, a].tolist())) != now:
                    done()
                    now = k
                    yield from ready(4096)
                held.append(batch.slice(a, b - a))
        done()
        yield from ready(1)

    group = ["unit", "dims", "i", "j"]
    found = []
    for turn in range(rounds):
        sent = _sent(members, codes, crowded, turn, rounds).repartition(*group).sortWithinPartitions(*group, "b")
        found.append(written(small_batches(sent, 2048).mapInArrow(run, "rep long, n long, other long").hint("rebalance"), "cap-links"))
    return reduce(DataFrame.unionByName, found)


def _rounds(seen: dict[str, int], codes: dict[int, Code], crowded: dict[int, Crowded]) -> int:
    """So many rounds that none sends much more than it may; `seen` has the vectors, the bytes of them and of their filters, and their bundles."""
    row = seen["data"] / seen["n"] + seen["own"] / seen["n"] / 2 + 48
    sent = seen["bundles"] + sum(int((x.blocks**2).sum()) * BLOCK for x in crowded.values())
    most = min(c.size() // c.wide() for c in codes.values())
    return max(1, min(ceil(sent * row / max(ROUND_BYTES, ROUND_X * seen["data"])), most))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    `vectors` is a table that is read alike each time: its rows are numbered.
    """
    spark = vectors.sparkSession
    width = 4 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else 8
    numbered = vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("_row"))
    with freed_shuffles(spark), scratch(spark):
        with scratch(spark):
            keys = written(_keys(numbered, width), "keys")
            groups = keys.groupBy("dims", "digest").agg(F.min("_row").alias("rep"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
            groups = written(groups, "distinct", keep=True)
            # rows of vectors that occur more than once: whose copies they are
            repeated = groups.filter("copies > 1").select("dims", "digest", "rep", "copies")
            copies, seen = counted(keys.join(repeated, ["dims", "digest"]).select("_row", "rep", "copies"), "copies", keep=True, n=F.count("*"))
        codes = {r["dims"]: code_for(r["n"], r["dims"], cosine) for r in groups.groupBy("dims").agg(F.count("*").alias("n")).collect()}
        with scratch(spark):
            distinct = numbered.withColumn("copies", F.lit(1).cast("long"))
            if seen["n"]:
                distinct = numbered.join(copies, "_row", "left").filter("rep is null or rep = _row").withColumn("copies", F.coalesce("copies", F.lit(1)))
            members, sizes = counted(
                _with_filters(distinct.select("_row", "vec_id", "copies", "embedding"), codes, width), "caps",
                n=F.count("*"), data=F.sum(F.octet_length("data")), own=F.sum(F.octet_length("own")), bundles=F.sum("bundles"),
            )
            crowded = _crowded(members, codes, sizes["n"])
            found = linked(members, codes, crowded, _rounds(sizes, codes, crowded), width, cosine) if sizes["n"] else spark.createDataFrame([], "rep long, n long, other long")
            degree = written(found.groupBy("rep").agg(F.sum("n").alias("n")), "degree", keep=True)
            links = written(found.filter("other >= 0").select("rep", "other").distinct(), "links", keep=True)
        roots = components(links, "rep", "other")
        placed = groups.select("rep", "first", "copies").join(roots, groups["rep"] == roots["node"], "left").join(degree, "rep", "left")
        # those left out are alone
        placed = placed.filter("n is not null or copies > 1").withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
        placed = placed.select("rep", "first", "copies", F.coalesce("root", "rep").alias("root"), "n_links")
        placed = written(placed, "placed")
        named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = written(placed.join(named, "root").select("rep", "copies", "n_links", "component_id"), "classes")
        # a class's copies join to its one row
        rows = copies.select("_row", "rep").join(classes, "rep").select("_row", "n_links", "component_id")
        rows = rows.unionByName(classes.filter("copies = 1").select(F.col("rep").alias("_row"), "n_links", "component_id"))
        rows = written(rows, "members", keep=True)
    out = numbered.select("_row", "vec_id").join(rows, "_row", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
