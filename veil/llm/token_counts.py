"""Token counts of a SentencePiece BPE model, by overlap resynchronisation.

A short text is encoded whole. A huge one is cut into chunks that overlap; the chunks are dealt over all tasks, each is
encoded with offsets, and neighbours are spliced behind a token that both hold at the same place.

Why such a place is proven stable: byte-pair merging that never crosses a position does on each side what it would do
there alone, and whether two encodings stay as they are when put together depends only on the last token of one and the
first of the other. Let the left chunk's tokens be ... A B ... and the right chunk's ... B C ..., with B the same piece at
the same offsets. Then the left tokens through B and the right ones from C on are encodings of their own, and B C stand side
by side in the right chunk's encoding, so they stay apart in the joined one. By induction over the chunks this holds for
the whole text, whatever the chunks' edges did to the tokens outside.

Where neighbours share no token inside their overlap (a long run of one letter, say) that text is cut again with
twice the overlap, and with longer chunks once the overlap would fill them, until every edge aligns or one chunk holds all.
Such a run, and no other text, is held by one task. Counts are summed per edge and per chunk; no task sees all of a text.

A null text counts as empty: no bytes, no tokens. Repeated rows get equal counts; an empty table gives an empty result.
Extra columns pass through, but for those that have the name of a result. Control strings such as `<s>` are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.bpe import windows
from veil.llm.common import column, small_batches, texts_of, written

#: Code points of a chunk without its overlap, and of the first overlap.
CHUNK, OVERLAP = 32_768, 512

SPAN = "array<struct<stop:long,start:long,id:int>>"
MARKS = f"row long, part int, last boolean, n long, head {SPAN}, tail {SPAN}, skipped long"


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The file of an installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


class Model:
    """A loaded model and the code points that each of its pieces covers."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(self.processor.get_piece_size())
        self.is_byte = np.array([self.processor.is_byte(i) for i in ids])
        # the bytes of one character are tokens of their own: the first of them covers it
        first = lambda piece: int(piece[3:5], 16) & 0xC0 != 0x80
        pieces = map(self.processor.id_to_piece, ids)
        self.length = np.array([int(first(p)) if b else len(p) for p, b in zip(pieces, self.is_byte)], np.int64)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.processor.encode(texts, num_threads=1)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where each ends in code points of `text`; the word mark put before the text lies at -1."""
        ids = np.array(self.processor.encode(text), np.int64)
        stop = np.cumsum(self.length[ids]) - 1
        if len(ids) and stop[-1] != len(text):
            raise ValueError("the model changes texts before it cuts them, so its tokens have no offsets")
        return ids, stop


def _spans(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[dict[str, int]]:
    return [{"stop": b, "start": a, "id": i} for i, a, b in zip(ids.tolist(), start.tolist(), stop.tolist())]


def chunk_marks(chunks: DataFrame, sent, overlap: int) -> DataFrame:
    """Per chunk: tokens, and the tokens inside the overlap with the chunk before (`head`) and after (`tail`)."""
    struct = pa.struct([("stop", pa.int64()), ("start", pa.int64()), ("id", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in it:
            model = model or Model(sent.value)
            total, head, tail, skipped = [], [], [], []
            for at, core, text in zip(column(batch, "start").to_pylist(), column(batch, "core").to_pylist(), texts_of(batch, "text")):
                ids, stop = model.spans(text)
                start = np.concatenate([[-1], stop[:-1]])
                first = int(np.searchsorted(stop, overlap, "right"))
                later = int(np.searchsorted(start, core - 1, "left"))
                total.append(len(ids))
                skipped.append(later)
                head.append(_spans(ids[:first], start[:first] + at, stop[:first] + at))
                tail.append(_spans(ids[later:], start[later:] + at, stop[later:] + at))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "row"), column(batch, "part"), column(batch, "last"), pa.array(total, pa.int64()),
                    pa.array(head, pa.list_(struct)), pa.array(tail, pa.list_(struct)), pa.array(skipped, pa.int64()),
                ],
                ["row", "part", "last", "n", "head", "tail", "skipped"],
            )

    return small_batches(chunks, 64).mapInArrow(run, MARKS)


def spliced(marks: DataFrame, byte_ids: int) -> DataFrame:
    """(row, n, failed): tokens of each text, and the edges at which its chunks share no token."""
    left = marks.filter("not last").select("row", "part", "n", "tail", "skipped")
    right = marks.filter("part > 0").select("row", (F.col("part") - 1).alias("part"), "head")
    # a token of one byte may end inside a character, so it proves nothing
    pieces = F.filter(F.array_intersect("tail", "head"), lambda x: x["id"] >= byte_ids)
    edges = left.join(right, ["row", "part"]).withColumn("same", F.array_min(pieces))
    dropped = F.col("n") - F.col("skipped") - F.array_position("tail", F.col("same")) + F.array_position("head", F.col("same"))
    lost = edges.select("row", (-dropped).alias("n"), F.col("same").isNull().cast("int").alias("failed"))
    every = marks.select("row", "n", F.lit(0).alias("failed")).unionByName(lost)
    return every.groupBy("row").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def _short(docs: DataFrame, sent, text: str, out: str) -> DataFrame:
    keep = [f for f in docs.schema.fields if f.name != text]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in it:
            model = model or Model(sent.value)
            n = pa.array(model.count(texts_of(batch, text)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in keep), n], [*(f.name for f in keep), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` long"])
    return small_batches(docs).mapInArrow(run, schema)


def long_counts(texts: DataFrame, sent, byte_ids: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, n) of `texts` (row, text); texts whose chunks don't align are cut again with a wider overlap."""
    done, todo = None, texts
    while True:
        marks = written(chunk_marks(windows(todo, chunk, overlap), sent, overlap), "token-marks")
        found = written(spliced(marks, byte_ids), "token-counts")
        settled = found.filter("failed = 0").select("row", "n")
        done = settled if done is None else done.unionByName(settled)
        again = found.filter("failed > 0").select("row")
        if again.isEmpty():
            return done
        overlap *= 2
        chunk = max(chunk, 2 * overlap)
        todo = texts.join(again, "row", "left_semi")


def counted(
    docs: DataFrame, model: bytes, limit: int, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """`docs` without the text, with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    `docs` is a table that is read alike each time: its long texts are picked out by row number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary, whatever the data
    processor = Model(model)
    byte_ids = int(np.flatnonzero(processor.is_byte).max(initial=-1)) + 1
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(
        *keep, text, F.monotonically_increasing_id().alias("__row"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"),
    )
    long = F.coalesce(F.char_length(text) > chunk, F.lit(False))
    short = _short(rows.filter(~long), sent, text, "__n")
    texts = rows.filter(long).select(F.col("__row").alias("row"), F.col(text).alias("text"))
    sums = long_counts(texts, sent, byte_ids, chunk, overlap).select(F.col("row").alias("__row"), F.col("n").alias("__n"))
    rest = rows.filter(long).drop(text).join(sums, "__row")
    both = short.unionByName(rest.select(*short.columns))
    return both.select(
        *keep, F.col("__bytes").alias("n_bytes"), F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit")
    )
