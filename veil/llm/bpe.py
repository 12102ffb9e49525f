"""Byte-level BPE: encoding by overlapping chunks, decoding by joining bytes.

A long text is cut into windows that overlap. The windows are dealt over the tasks and each is split into
pre-tokens from its own start, which may lie inside a pre-token. Two neighbours agree from the first position
on that both hold to be a boundary: what follows depends on the text to the right only. The text is cut there,
and the pieces are encoded by themselves. Where neighbours never agree inside their overlap (one run of letters
that is longer, say), their windows become one piece. A text of one window is its own piece and is not moved.

A null text counts as empty and has no ids. Rows are independent of each other, so repeated rows give repeated
results; an empty table gives an empty result. All columns but the text are kept; one that has the name of the new
column is replaced.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import batches, column, small_batches, texts_of, written

#: Code points of a window without its overlap, and of the overlap.
WINDOW, OVERLAP = 32_768, 512
#: A boundary so near the end of a window may depend on what follows it.
MARGIN = 3
#: Pieces whose ids a worker remembers.
REMEMBERED = 300_000
#: Bytes of a short pre-token; so many of one length are merged together; code points of the texts whose pre-tokens are held at once.
SHORT, TOGETHER, HELD = 48, 8, 500_000
#: The rank of a pair that makes no token.
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of least rank, the leftmost first, is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= SHORT:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank, none = ranks.get, math.inf
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]
    # long runs: the same merges from a heap, over a linked list of spans
    end = list(range(1, len(piece) + 1))
    before = list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < len(piece):
            stop = end[end[i]]
            rank = ranks.get(piece[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop))

    for i in range(len(piece) - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= len(piece) or end[mid] != stop or mid >= stop:
            continue
        end[i], end[mid] = stop, -1
        if stop < len(piece):
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that make a token, as sorted integers (left id in the upper half), and the token's id."""
    found = [
        (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
        for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
    ]
    keys, ids = np.array(found, np.int64).reshape(-1, 2).T
    order = np.argsort(keys)
    return keys[order], ids[order]


def merged_together(given: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The merges of `merged` for many pre-tokens of one length, of which `given` holds the bytes' ids, a row for each.

    Yields (rows, their ids). Each step merges once in each row that isn't done, so rows in work stay equally long.
    """

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ids[at], NONE)

    rows, tokens = np.arange(len(given)), given
    if not len(keys) or given.shape[1] < 2:
        yield rows, tokens
        return
    pairs = rank(tokens[:, :-1], tokens[:, 1:])
    while pairs.shape[1]:
        at = pairs.argmin(1)  # the leftmost of the least
        best = pairs[np.arange(len(rows)), at]
        go = best < NONE
        if not go.all():
            yield rows[~go], tokens[~go]
            rows, tokens, pairs, at, best = rows[go], tokens[go], pairs[go], at[go], best[go]
            if not len(rows):
                return
        every = np.arange(len(rows))
        stay = np.arange(tokens.shape[1]) != at[:, None] + 1
        tokens[every, at] = best
        tokens = tokens[stay].reshape(len(rows), -1)
        pairs = pairs[np.arange(pairs.shape[1]) != at[:, None]].reshape(len(rows), -1)
        before, after = every[at > 0], every[at < pairs.shape[1]]
        pairs[before, at[before] - 1] = rank(tokens[before, at[before] - 1], tokens[before, at[before]])
        pairs[after, at[after]] = rank(tokens[after, at[after]], tokens[after, at[after] + 1])
    yield rows, tokens


class _Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merged(piece.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def learn(self, pieces: set[str], keys: np.ndarray, ids: np.ndarray) -> None:
        """Remember the ids of short pre-tokens, merged by length."""
        if len(self) >= REMEMBERED:
            self.clear()
        single = np.array([self.ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
        lengths: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces.difference(self):
            raw = piece.encode("utf-8", "surrogatepass")
            if raw not in self.ranks and len(raw) <= SHORT:
                lengths.setdefault(len(raw), []).append((piece, raw))
        for n, found in lengths.items():
            if len(found) < TOGETHER:
                continue
            given = single[np.frombuffer(b"".join(raw for _, raw in found), np.uint8).reshape(-1, n)]
            if given.min() < 0:
                continue
            for rows, tokens in merged_together(given, keys, ids):
                size, raw = 4 * tokens.shape[1], tokens.astype("<u4").tobytes()
                self.update((found[r][0], raw[k * size : (k + 1) * size]) for k, r in enumerate(rows.tolist()))


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], bytes]:
    split, pieces = regex.compile(pattern).findall, _Pieces(ranks)
    return lambda text: b"".join(map(pieces.__getitem__, split(text)))


def _ends(text: str, pattern: str) -> np.ndarray:
    return np.fromiter(accumulate(map(len, regex.compile(pattern).findall(text))), np.int64)


def _apply(df: DataFrame, ranks_file, pattern: str, text: str, out: str) -> DataFrame:
    """Encode `text` of every row; the other columns pass through."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, *table = ranks_file.value
        split, pieces = regex.compile(pattern).findall, _Pieces(ranks)
        for batch in it:
            out_ids, texts = [], texts_of(batch, text)
            ends = np.fromiter(accumulate(map(len, texts)), np.int64, len(texts)) // HELD
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                found = [split(texts[k]) for k in some]
                pieces.learn(set().union(*found), *table)
                out_ids += [b"".join(map(pieces.__getitem__, x)) for x in found]
            ids = pa.array(out_ids, pa.binary())
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), ids], [*(f.name for f in keep), out])

    return small_batches(df).mapInArrow(run, _schema(keep, f"`{out}` binary"))


def _schema(fields, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + list(more))


WINDOWS = "row long, part int, start long, core long, last boolean, text string"


def windows(texts: DataFrame, window: int, overlap: int) -> DataFrame:
    """Overlapping windows of `texts` (row, text), dealt over all tasks; `core` is the length without the overlap."""
    names = ["row", "part", "start", "core", "last", "text"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in it:
                for row, text in zip(column(batch, "row").to_pylist(), texts_of(batch, "text")):
                    parts = max(1, -(-len(text) // window))
                    for part in range(parts):
                        at = part * window
                        yield row, part, at, min(window, len(text) - at), part + 1 == parts, text[at : at + window + overlap]

        yield from batches(each(), names, types, 64)

    return small_batches(texts).mapInArrow(cut, WINDOWS).repartition("row", "part")


def stitched(dealt: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """(row, piece, text): the windows cut anew where neighbours resynchronise.

    The first window is right from its start, and so is each that agrees with a right one before it. Windows
    that don't agree with the one before are joined to it, and the scan is made again; mostly there are none.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, white = pa.list_(pa.int64()), regex.compile(r"\s").match
        for batch in it:
            head, tail = [], []
            for start, core, last, text in zip(*(column(batch, c).to_pylist() for c in ("start", "core", "last", "text"))):
                ends = _ends(text, pattern)
                if not last:
                    ends = ends[ends <= len(text) - MARGIN]
                head.append([start, *(ends[ends <= overlap] + start).tolist()])
                # a piece that ended in white space would be split as if nothing followed
                cuts = [] if last else ends[ends >= core].tolist()
                tail.append([start + x for x in cuts if not white(text[x - 1])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(head, lists), pa.array(tail, lists)], [*batch.schema.names, "head", "tail"]
            )

    order = Window.partitionBy("row").orderBy("part")
    later = Window.partitionBy("row").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    while True:
        marks = written(small_batches(dealt).mapInArrow(scan, WINDOWS + ", head array<long>, tail array<long>"), "windows")
        agreed = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
        at = marks.select("row", "part", F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(agreed).alias("at"))
        at = written(at.withColumn("piece", F.count("at").over(order)).withColumn("to", F.first("at", ignorenulls=True).over(later)), "cuts")
        both = marks.drop("head", "tail").join(at, ["row", "part"])
        if at.filter("at is null").isEmpty():
            size = F.coalesce(F.col("to") - F.col("at"), F.char_length("text")).cast("int")
            return both.select("row", "piece", F.substring("text", (F.col("at") - F.col("start")).cast("int") + 1, size).alias("text"))
        groups = both.groupBy("row", "piece").agg(
            F.min("part").alias("part"), F.min("start").alias("start"), F.sum("core").alias("core"), F.max("last").alias("last"),
            F.array_sort(F.collect_list(F.struct("part", "core", "text"))).alias("w"),
        )
        own = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x: F.substring(x["text"], F.lit(1), x["core"].cast("int")))
        text = F.concat(F.array_join(own, ""), F.element_at("w", -1)["text"])
        dealt = groups.select("row", "part", "start", "core", "last", text.alias("text"))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids",
    window: int = WINDOW, overlap: int = OVERLAP,
) -> DataFrame:
    """`docs` without the text, with `out`: its ids as little-endian unsigned 32-bit integers, in one binary value.

    `docs` is a table that is read alike each time: its long texts are picked out by row number.
    """
    sent = docs.sparkSession.sparkContext.broadcast((ranks, *merges(ranks)))  # the vocabulary: one entry per token or pair, whatever the data
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    long = F.coalesce(F.char_length(text) > window, F.lit(False))
    short = _apply(rows.filter(~long), sent, pattern, text, out).drop("__row")
    cut = windows(rows.filter(long).select(F.col("__row").alias("row"), F.col(text).alias("text")), window, overlap)
    pieces = _apply(stitched(cut, pattern, overlap), sent, pattern, "text", "ids")
    joined = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    joined = joined.select(F.col("row").alias("__row"), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias(out))
    rest = rows.filter(long).drop(text, out).join(joined, "__row").drop("__row")
    return short.unionByName(rest.select(*short.columns))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """`df` with `out`: the bytes of all ids, joined. A null has no bytes; an id without a token is an error."""
    keep = [f for f in df.schema.fields if f.name != out]
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: piece for piece, rank in sent.value.items()}.__getitem__
        for batch in it:
            raw = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), pa.array(raw, pa.binary())], [*(f.name for f in keep), out])

    return small_batches(df).mapInArrow(run, _schema(keep, f"`{out}` binary"))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of an installed public tokenizer."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
