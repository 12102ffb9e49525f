"""Chat formatting whose rendering reads back to its source.

A turn is rendered between marks of its role:

    system     <<SYS>>text<</SYS>>
    user       [INST] text [/INST]
    assistant  <s>text</s>
    others     <<TURN name>>text<</TURN>>

Each turn is first rendered as it is and read by a parser of that grammar. Where the reader doesn't recover the turn,
the control strings in its text are escaped: a backslash goes in after the first character of each, and in
front of the backslashes that such a string has there already, so that unescaping (one backslash less) is
exact. The escaped turn is read again, and only a turn that reads back to its source leaves. The text under the loss mask is what assistants say, without the marks.

Turns are rows and are rendered and checked one by one, so a conversation may be of any length. `read_back` parses the
rendered rows of a conversation as one stream, in order, with state for one turn only.

Null texts, roles and turn numbers: a null text is empty; a null role is the role with an empty name; null turns come
first. Rows of one conversation are ordered by turn, then role, then text, so repeated turns keep their copies. A null
conv_id is a conversation of its own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import batches, column, small_batches

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER_END = "<</TURN>>"

#: Strings that an escape may have to hide: all marks, with backslashes after the first character.
_BODY = r"(?:/?s>|<SYS>>|</SYS>>|<TURN |</TURN>>)"
_CONTROL = re.compile(rf"(<)(\\*)({_BODY})|(\[)(\\*)(/?INST\])")
_ESCAPED = re.compile(rf"(<)\\(\\*)({_BODY})|(\[)\\(\\*)(/?INST\])")
_OPEN = re.compile(r"<<SYS>>|\[INST\] |<s>|<<TURN ((?:\\.|[^\\>])*)>>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def _named(role: str) -> str:
    return re.sub(r"([\\>])", r"\\\1", role)


def _bare(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name, flags=re.S)


def render(role: str, text: str, escaped: bool) -> tuple[str, str, str]:
    """Open mark, body and end mark of one turn."""
    begin, end = MARKS.get(role) or (f"<<TURN {_named(role)}>>", OTHER_END)
    return begin, escape(text) if escaped else text, end


def parse(stream: str, at: int = 0) -> tuple[str, str, int] | None:
    """Role, text and end position of the turn that begins at `at`; None where no whole turn does."""
    m = _OPEN.match(stream, at)
    if not m:
        return None
    role = next((r for r, (b, _) in MARKS.items() if b == m[0]), None)
    if role is None:
        role = _bare(m[1])
    end = MARKS[role][1] if m[1] is None else OTHER_END
    stop = stream.find(end, m.end())
    return None if stop < 0 else (role, unescape(stream[m.end() : stop]), stop + len(end))


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Marks and body such that the reader finds exactly (role, text): plain where that works, escaped where not."""
    for escaped in (False, True):
        parts = render(role, text, escaped)
        whole = "".join(parts)
        # what follows is another turn's first character, or nothing
        if all(parse(whole + more) == (role, text, len(whole)) for more in ("", "<", "[")):
            return parts
    raise ValueError("no reversible rendering")  # not reached: the escape leaves no mark in a body


def formatted(turns: DataFrame) -> DataFrame:
    """Rendered rows (conv_id, turn, role, text, formatted, loss_from, loss_to): the mask as code points of `formatted`, end exclusive."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, start, stop = [], [], []
            for role, text in zip(column(batch, "role").to_pylist(), column(batch, "text").to_pylist()):
                begin, body, end = format_turn(role, text)
                out.append(begin + body + end)
                start.append(len(begin) if role == "assistant" else None)
                stop.append(len(begin) + len(body) if role == "assistant" else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
                [*batch.schema.names, "formatted", "loss_from", "loss_to"],
            )

    kind = lambda c: turns.schema[c].dataType.simpleString()
    schema = f"conv_id {kind('conv_id')}, turn {kind('turn')}, role string, text string, formatted string, loss_from long, loss_to long"
    return small_batches(rows).mapInArrow(run, schema)


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the rendered rows.

    The rows of a conversation come to one task in order and are read as a stream: turns found in it go into
    running digests, and only an unfinished turn is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            none = object()
            now, held, n, loss, size = none, "", 0, 0, 0
            turns, masked = hashlib.sha256(), hashlib.sha256()

            def end() -> tuple:
                if held:
                    raise ValueError("text after the last turn")
                return now, n, turns.hexdigest(), loss, masked.hexdigest(), size

            for batch in it:
                for conv, text in zip(column(batch, "conv_id").to_pylist(), column(batch, "formatted").to_pylist()):
                    if now is none or conv != now:
                        if now is not none:
                            yield end()
                        now, held, n, loss, size = conv, "", 0, 0, 0
                        turns, masked = hashlib.sha256(), hashlib.sha256()
                    held, size = held + text, size + len(text)
                    at = 0
                    while found := parse(held, at):
                        role, said, at = found
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                        if role == "assistant":
                            loss += len(said)
                            masked.update(said.encode("utf-8", "surrogatepass"))
                    held = held[at:]
            if now is not none:
                yield end()

        yield from batches(each(), names, types)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rendered.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted")
    return small_batches(dealt).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
