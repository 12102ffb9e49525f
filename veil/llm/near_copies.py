"""Near copies: SimHash groups first, then every other pair of similar texts by a prefix filter; exact in the end.

Two texts are near if their sets of five-word shingles have a Jaccard similarity of at least 4/5. Shingles are integers of 64 bits
(from hashes of their words); similarity is that of the sets of integers. Equal sets are folded first. Then the
vantage-point tree of `simhash` groups fingerprints that differ in two bits or fewer, and each text of a group is compared
with the group's first one. No radius bounds the similarity, so more candidates come from a prefix filter, which misses
none: with all shingles in one order, two sets that similar share a shingle among the first n // 5 + 1 of each (n: shingles of
the set). The order puts rare shingles first, so a passage that many texts share is seldom in a prefix. It is drawn from a
fixed share of the documents; it changes what is compared, never what is found.

Candidates are compared in rounds. In each, every group of texts that are linked so far sends one member to one member of another
group, the one that shares most of its prefix; so copies by the thousand become a star, not pairs. When rounds link little more, all
pairs of texts that share a prefix shingle and lie in different groups are open, but for those that sizes and places rule out: at
places i and j of sets of n and m shingles, the first shared one, no more than min(n - i, m - j) can be shared. Sketches of a bit or
two per shingle rule nearly all others out: they differ in no more bits than the sets in shingles, and sets of n and m shingles are near
if they differ in (n + m) / 9 of them at most. A shingle of few rows has its pairs written; of one that many rows have, its rows
are sent by blocks with their sketches and compared there, so only what sketches leave open becomes a row. Texts decide in the end.

Words are lowered (A-Z) and split at ASCII white space. A text of fewer than five words is one shingle; texts without words
are equal to each other. Nulls count as empty. Repeated rows, also of one doc_id, are rows of their own. An empty table gives
an empty result. Tables that are written on the way are deleted again when the answer is written.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm import simhash
from veil.llm.common import column, components, counted, few_parts, popcount, scratch, small_batches, texts_of, written

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, LEAST, OF = 5, 4, 5
#: One in so many documents is drawn for the order, and a shingle that so many of those have is frequent; most frequent ones told apart.
SHARE, OFTEN, FREQUENT = 8, 3, 1 << 20
#: Row numbers that are sent to all tasks at most; more are joined by a shuffle.
SENT = 1_000_000
#: Pairs that are sent to all tasks at most; of more, only the row numbers.
FEW_SENT = 50_000
#: Texts that are compared with one text in one go.
BLOCK = 256
#: Narrow rows that a compared text counts as where small tables get few parts.
TEXTS = 64
#: Rounds go on while at least one of so many pairs links.
WORTH = 8
#: Shingles of so many rows have all their pairs written; rows of the others that one task compares with as many.
FEW, CROWD = 16, 2048
#: Four times the shingles of a set that sketches tell apart, at least and at most.
SKETCH = (512, 65_536)
#: Words whose hashes a worker remembers.
REMEMBERED = 1_000_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingler():
    """A function from a text to its shingles as sorted distinct integers; it remembers words."""
    known = _Words()
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    start = odd[:1].repeat(SHINGLE + 1).cumsum(dtype=np.uint64)  # another one for each width

    def shingles(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(words))
        if not width:
            return h
        n = len(words) - width + 1
        x = h[:n] + start[width]
        for k in range(1, width):
            x = x * odd[1] + h[k : k + n]
        x ^= x >> np.uint64(29)
        x *= odd[2]
        x ^= x >> np.uint64(32)
        return np.unique(x)

    return shingles


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
    """Whether two sets are near, and their Jaccard distance."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return OF * both >= LEAST * every, 1 - both / every if every else 0.0


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles: those not in `frequent` (sorted), then the frequent ones by rank."""
    if not len(shingles):
        return shingles
    n = len(shingles) - -(-LEAST * len(shingles) // OF) + 1
    if not len(frequent):
        return shingles[:n]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[at] == shingles
    rare = shingles[~often][:n]
    return np.concatenate([rare, shingles[often][np.argsort(rank[at[often]])][: n - len(rare)]])


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of the distinct shingles; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        ones += np.unpackbits(shingles[at : at + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little", signed=True)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def frequent_shingles(docs: DataFrame, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the documents drawn have, sorted, and their ranks by frequency."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()
        for batch in it:
            for text in texts_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["h"])

    some = _numbered(docs).filter(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("text")
    counts = small_batches(some).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= OFTEN)
    got = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    found, c = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int32)
    rank[np.lexsort((found, c))] = np.arange(len(found))
    return found[order], rank[order]


def marked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, fp, key, prefix) per row; rows with equal sets have equal keys."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))  # FREQUENT shingles at most

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()
        frequent, rank = sent.value
        for batch in it:
            sets = [shingles(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "row"), column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([prefix(s, frequent, rank).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n", "fp", "key", "prefix"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(_numbered(docs)).mapInArrow(run, f"row long, doc_id {doc_id}, n int, fp long, key binary, prefix array<long>")


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """`pairs` (a, b: row numbers) with `near` and their distance `d`. Each text is sent to the text that it is compared with, whose set is made once."""
    with scratch(docs.sparkSession):
        pairs, seen = counted(pairs, "pairs", n=F.count("*"))
        crowded = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).filter("parts > 1")  # one in BLOCK pairs at most
        dealt = pairs.join(F.broadcast(crowded) if seen["n"] <= SENT * BLOCK else crowded, "b", "left")
        dealt = dealt.select("b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), "a")
        centres = dealt.select("b", "part").distinct().select("b", "part", F.lit(None).cast("long").alias("a"), F.col("b").alias("row"))
        asked = dealt.select("b", "part", "a", F.col("a").alias("row")).unionByName(centres)
        if seen["n"] <= FEW_SENT:
            texts, asked = _numbered(docs), F.broadcast(asked)
        else:
            needed = written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "needed")
            side = F.broadcast(needed) if needed.count() <= SENT else needed
            texts = written(_numbered(docs).join(side, "row", "left_semi").select("row", "text"), "texts")
        both = texts.join(asked, "row").select("b", "part", "a", "text")
        both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, centre = shingler(), np.zeros(0, np.uint64)
            for batch in it:
                out = []
                for b, a, text in zip(column(batch, "b").to_pylist(), column(batch, "a").to_pylist(), texts_of(batch, "text")):
                    own = shingles(text)
                    if a is None:
                        centre = own
                    else:
                        out.append((a, b, *similarity(centre, own)))
                cols = list(zip(*out)) if out else [(), (), (), ()]
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["a", "b", "near", "d"])

        found = small_batches(both).mapInArrow(run, "a long, b long, near boolean, d double")
        return written(few_parts(found, seen["n"] * TEXTS), "compared", keep=True)


def _may_be_near(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles can be near if the first shared one is at places i and j (from 0)."""
    shared = F.least(n - i, m - j)
    return (F.least(n, m) * OF >= F.greatest(n, m) * LEAST) & (shared * (LEAST + OF) >= (n + m) * LEAST)


def _placed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """`entries` with their group's root."""
    return entries.join(roots, entries["row"] == roots["node"], "left").select("h", "row", "n", "i", F.coalesce("root", "row").alias("root"))


def _open(entries: DataFrame, roots: DataFrame, n: int) -> tuple[DataFrame, int]:
    """`_placed` rows of the shingles that several groups have; `c` rows have the shingle. And the rows of those that more than FEW rows have.

    `n`: the number of entries or more, as below.
    """
    placed = written(few_parts(_placed(entries, roots), n), "placed")
    several = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c"))
    several = several.filter("low < high").select("h", "c")
    found, seen = counted(few_parts(placed.join(written(few_parts(several, n), "several"), "h"), n), "open", crowded=F.count(F.when(F.col("c") > FEW, 1)))
    return found, seen["crowded"]


def _next_pairs(placed: DataFrame, tested: DataFrame, turn: int, n: int) -> DataFrame:
    """(a, b): for each group, a member and a member of another group that share most shingles and weren't compared.

    The other group is the largest with that shingle and about that size. Who stands for a group changes from turn to turn by a hash.
    """
    one = F.struct("row", "n", "i")
    size = F.floor(F.ln(F.col("x.n").cast("double")) / F.lit(float(np.log(OF / LEAST)))).cast("int")
    some = F.min_by(one, F.xxhash64("row", F.lit(turn))).alias("x")
    groups = placed.groupBy("h", "root").agg(some, F.count("*").alias("c")).withColumn("size", size)
    groups = written(few_parts(groups, n), "groups")
    firsts = groups.groupBy("h", "size").agg(F.max_by(F.struct("root", "x"), F.struct("c", F.xxhash64("root", F.lit(turn)))).alias("y"))
    met = groups.join(written(few_parts(firsts, n), "firsts"), ["h", "size"]).filter(
        (F.col("root") != F.col("y.root")) & _may_be_near(F.col("x.n"), F.col("x.i"), F.col("y.x.n"), F.col("y.x.i"))
    )
    met = met.select("root", F.greatest("x.row", "y.x.row").alias("a"), F.least("x.row", "y.x.row").alias("b"))
    counted = met.groupBy("root", "a", "b").agg(F.count("*").alias("c")).join(tested, ["a", "b"], "left_anti")
    best = counted.groupBy("root").agg(F.max_by(F.struct("a", "b"), F.struct("c", -F.col("b"), -F.col("a"))).alias("p"))
    return few_parts(best.select("p.a", "p.b").distinct(), n)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of n shingles: the power of two from 4 n on, within bounds."""
    return (1 << np.ceil(np.log2(np.clip(4 * np.asarray(n), *SKETCH))).astype(np.int64)).astype(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit is 1 if an odd number of the shingles have its number as their last bits.

    Two sketches differ in no more bits than the sets in shingles, and in few less; halves that are combined by xor give
    the sketch of half as many bits.
    """
    bits = int(sketch_bits(len(shingles)))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketched(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, sketch) of the texts with these row numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()
        for batch in it:
            marks = [sketch(shingles(t)) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(marks, pa.binary())], ["row", "sketch"])

    rows, seen = counted(rows.distinct(), "needed", n=F.count("*"))
    side = F.broadcast(rows) if seen["n"] <= SENT else rows
    texts = _numbered(docs).join(side, "row", "left_semi").select("row", "text")
    return written(small_batches(texts).mapInArrow(run, "row long, sketch binary"), "sketches")


def folded(marks: list[bytes], bits: int) -> np.ndarray:
    """Sketches of `bits` or twice as many bits as rows of 64-bit words, those with more bits folded."""
    out = np.empty((len(marks), bits // 64), np.uint64)
    for k, mark in enumerate(marks):
        words = np.frombuffer(mark, "<u8")
        out[k] = words if len(words) == bits // 64 else words[: bits // 64] ^ words[bits // 64 :]
    return out


def crowd_pairs(part: np.ndarray, row: np.ndarray, n: np.ndarray, i: np.ndarray, root: np.ndarray, marks: list[bytes], every: bool) -> set[tuple[int, int]]:
    """(a, b), a > b: rows of different groups that sizes, places and sketches leave open; for each row the nearest one, or all.

    Where there are two parts, rows of one part meet those of the other only.
    """
    found: set[tuple[int, int]] = set()
    bits, across = sketch_bits(n), part.min() != part.max()
    for width in np.unique(bits).tolist():
        x, y = np.flatnonzero(bits == width), np.flatnonzero((bits == width) | (bits == 2 * width))  # near sets have sizes of 4 : 5 at most
        words = folded([marks[k] for k in y], width)
        py, ny, iy, ry = part[y], n[y], i[y], root[y]
        for a, own in zip(x, words[np.searchsorted(y, x)]):
            both = ny + n[a]
            able = (ry != root[a]) & (np.minimum(ny - iy, n[a] - i[a]) * (LEAST + OF) >= both * LEAST)
            able &= np.minimum(ny, n[a]) * OF >= np.maximum(ny, n[a]) * LEAST
            if across:
                able &= py != part[a]
            if every:
                able &= (y > a) | (bits[y] > width)
            at = np.flatnonzero(able)
            d = popcount(words[at] ^ own).sum(1, dtype=np.int64)
            near = d * (LEAST + OF) <= both[at] * (OF - LEAST)
            at, d = at[near], d[near]
            if len(at) and not every:
                at = at[[int(d.argmin())]]
            found.update((max(int(row[a]), b), min(int(row[a]), b)) for b in row[y[at]].tolist())
    return found


def _crowded_pairs(open_rows: DataFrame, sketches: DataFrame, every: bool) -> DataFrame:
    """(a, b): `crowd_pairs` of the shingles that more than FEW rows have. Their rows are dealt over blocks and each pair of blocks is one group."""

    def compare(table: pa.Table) -> pa.Table:
        part, row, n, i, root = (table[c].to_numpy().astype(np.int64) for c in ("part", "row", "n", "i", "root"))
        pairs = sorted(crowd_pairs(part, row, n, i, root, table["sketch"].to_pylist(), every))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    parts = F.ceil(F.col("c") / CROWD).cast("int")
    dealt = open_rows.filter(F.col("c") > FEW).withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("h", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "row", "n", "i", "root")
    return dealt.join(sketches, "row").groupBy("h", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def _few_pairs(open_rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs of rows of different groups that share a shingle of at most FEW rows, as sizes, places and sketches leave open."""
    few = open_rows.filter(F.col("c") <= FEW)
    x, y = (few.select("h", *[F.col(c).alias(side + c) for c in ("row", "n", "i", "root")]) for side in "xy")
    able = (F.col("xrow") > F.col("yrow")) & (F.col("xroot") != F.col("yroot"))
    able &= _may_be_near(F.col("xn"), F.col("xi"), F.col("yn"), F.col("yi"))
    pairs = x.join(y, (x["h"] == y["h"]) & able).select(F.col("xrow").alias("a"), F.col("yrow").alias("b"), "xn", "yn").distinct()
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("row").alias(side), F.col("sketch").alias(f"s{side}")), side)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, m = (column(batch, c).to_numpy().astype(np.int64) for c in ("xn", "yn"))
            able = []
            for bits, both, *marks in zip(np.minimum(sketch_bits(n), sketch_bits(m)).tolist(), n + m, column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist()):
                x, y = folded(marks, bits)
                able.append(int(popcount(x ^ y).sum(dtype=np.int64)) * (LEAST + OF) <= both * (OF - LEAST))
            yield batch.select(["a", "b"]).filter(pa.array(able, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def near_groups(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) for every row in a group of near texts; `sets` has one row (row, n, fp, prefix) per set."""
    sizes = sets.agg(F.count("*").alias("n"), F.sum(F.size("prefix")).alias("entries")).first()
    n, many = sizes["n"], sizes["entries"] or 0
    # the tree's groups: each text against the group's first one
    fps = simhash.placed(sets.select("fp", "row").filter("n > 0"), F.col("row"), simhash.RADIUS)
    first = fps.groupBy("root").agg(F.min("first").alias("b"))
    stars = sets.filter("n > 0").select("row", "fp").join(fps.select("fp", "root"), "fp").join(written(few_parts(first, n), "first"), "root")
    tested = compared(few_parts(stars.filter("row > b").select(F.col("row").alias("a"), "b"), n), docs)
    links = tested.filter("near").select("a", "b")
    entries = sets.select("row", "n", F.posexplode("prefix").alias("i", "h"))
    shared = written(entries.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "shared")
    entries = written(few_parts(entries.join(shared, "h"), many), "entries")
    roots = components(links, "a", "b", n)
    for turn in itertools.count():
        now = compared(_next_pairs(_placed(entries, roots), tested.select("a", "b"), turn, many), docs)
        asked, linked = now.agg(F.count("*"), F.count_if("near")).first()
        tested = tested.unionByName(now)
        if linked:
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(now.filter("near").select("a", "b"))
            roots = components(links, "a", "b", n + linked)
        if linked * WORTH < asked or not asked:
            break
    # what rounds have left: rare shingles' pairs at once, those of crowded ones from the nearest, until few link; then all that are open
    left, _ = _open(entries, roots, many)
    sketches = sketched(left.select("row"), docs)
    pairs, every = _few_pairs(left, sketches).unionByName(_crowded_pairs(left, sketches, False)).distinct(), False
    while True:
        now = compared(pairs, docs)
        asked, linked = now.agg(F.count("*"), F.count_if("near")).first()
        if linked:
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(now.filter("near").select("a", "b"))
            roots = components(links, "a", "b", n + linked)
        if every:
            return roots
        every = linked * WORTH < asked or not asked
        left, crowded = _open(left.filter(F.col("c") > FEW).select("h", "row", "n", "i"), roots, many)
        if not crowded:
            return roots
        pairs = _crowded_pairs(left, sketches, every)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one per group of near texts, with the smallest doc_id (null last, then by row).

    `docs` is a table that is read alike each time: its rows are numbered.
    """
    with scratch(docs.sparkSession):
        sets = written(marked(docs), "sets")
        best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        firsts = written(sets.groupBy("key").agg(F.min(best).alias("best")).select("best", F.col("best.row").alias("row")), "firsts")
        roots = near_groups(written(sets.join(firsts.select("row"), "row", "left_semi").drop("doc_id", "key"), "distinct"), docs)
        placed = firsts.join(roots, firsts["row"] == roots["node"], "left").select("best", F.coalesce("root", "row").alias("root"))
        kept = placed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
        gone = sets.select("row").join(written(kept, "kept"), "row", "left_anti").select(F.col("row").alias("__row"))
        gone = written(gone, "gone", keep=True)
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(gone, "__row", "left_anti").drop("__row")
