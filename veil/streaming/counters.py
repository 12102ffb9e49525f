"""Structured Streaming forms of the monitors: running totals, rate checks, progress and round state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veil.functions.numbers import exact_mean
from veil.sources.results import score_lines


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Score lines of log files as they land."""
    return score_lines(spark.readStream.text(path))


def timed(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Running calls and tokens per (model, role); emit in update or complete mode."""
    return usage.groupBy("model_id", "role").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok")
    )


def late(stream: DataFrame, lateness: str | None) -> DataFrame:
    """With a watermark only if the caller says how late a row may be: it bounds the state and drops what comes later.

    Without one all rows count, in whatever order their files come.
    """
    return timed(stream).withWatermark("ts", lateness) if lateness else timed(stream)


def rate_windows(calls: DataFrame, key: str, length: str, slide: str, limit: int, lateness: str | None = None) -> DataFrame:
    """Calls per sliding window and whether they exceed the limit."""
    return (
        late(calls, lateness)
        .groupBy(F.window("ts", length, slide), key)
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("window.start").alias("start"), key, "calls", (F.col("calls") > limit).alias("over_limit"))
    )


def progress_windows(rounds: DataFrame, length: str, lateness: str | None = None) -> DataFrame:
    """Rounds done and mean scores per tumbling window and config."""
    return (
        late(rounds, lateness)
        .groupBy(F.window("ts", length), "config")
        .agg(
            F.count(F.lit(1)).alias("rounds"), exact_mean("privacy_score").alias("privacy"), exact_mean("utility_score").alias("utility")
        )
        .select(F.col("window.start").alias("start"), "config", "rounds", "privacy", "utility")
    )


def new_versions(evals: DataFrame, keys: list[str], lateness: str | None = None) -> DataFrame:
    """Each (profile, version, ...) once, however often its file is rewritten; with a lateness, within that time."""
    return late(evals, lateness).dropDuplicatesWithinWatermark(keys) if lateness else evals.dropDuplicates(keys)


# ---- round state ------------------------------------------------------------------------------

ROUND_STATE = T.StructType(
    [
        T.StructField("recent", T.ArrayType(T.DoubleType())), T.StructField("stopped", T.BooleanType()),
        T.StructField("due", T.IntegerType()), T.StructField("waiting", T.ArrayType(T.DoubleType())),
    ]
)
ROUND_OUT = T.StructType(
    [
        T.StructField("profile_id", T.LongType()), T.StructField("config", T.StringType()), T.StructField("round", T.IntegerType()),
        T.StructField("stopped", T.BooleanType()),
    ]
)


def _advance(held: tuple, rows: Iterable[tuple]) -> tuple[tuple, list[tuple[int, bool]]]:
    """State after some rows (round, privacy, utility), and the rounds decided by them."""
    recent, stopped, due, flat = held
    recent, flat = list(recent), list(flat)
    waiting = {int(flat[i]): (flat[i + 1], flat[i + 2]) for i in range(0, len(flat), 3)}
    for number, privacy, utility in rows:
        if not stopped and int(number) >= due:
            waiting[int(number)] = (float(privacy), float(utility))
    out = []
    while not stopped and due in waiting:
        privacy, utility = waiting.pop(due)
        recent = [*recent, privacy][-3:]
        strong = privacy >= 0.9 and utility >= 0.7
        stopped = bool(due >= 2 and (strong or min(recent) >= 0.8 or utility < 0.3))
        out.append((due, stopped))
        due += 1
    left = [] if stopped else [x for n, (p, u) in sorted(waiting.items()) for x in (float(n), p, u)]
    return (recent, stopped, due, left), out


def _listed(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for rows in batches:
        yield from zip(*(rows[c].tolist() for c in columns))


_FRESH = ([], False, 1, [])


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rounds are decided in order of their number from 1; those that arrive early wait in the state for the ones before."""
    rows = _listed(batches, "round", "privacy_score", "utility_score")
    held, out = _advance(tuple(state.get) if state.exists else _FRESH, rows)
    state.update(held)
    yield pd.DataFrame([(*key, *row) for row in out], columns=["profile_id", "config", "round", "stopped"])


def stop_decisions(rounds: DataFrame) -> DataFrame:
    """Early stopping per (profile, config), whatever order the rounds arrive in; a run holds a few numbers of state."""
    return rounds.groupBy("profile_id", "config").applyInPandasWithState(
        _decide, ROUND_OUT, ROUND_STATE, "append", GroupStateTimeout.NoTimeout
    )


#: Groups that runs are dealt over; a call of Python serves all runs of a group.
RUN_GROUPS = 1 << 10
# a run: its key, its round state, its latest event time, and the time at which it is over
RUN = T.StructType(
    [
        T.StructField("profile_id", T.StringType()), T.StructField("config", T.StringType()), *ROUND_STATE.fields,
        T.StructField("last", T.LongType()), T.StructField("until", T.LongType()),
    ]
)
TIMED_STATE = T.StructType([T.StructField("runs", T.ArrayType(RUN))])
TIMED_OUT = T.StructType([*ROUND_OUT.fields, T.StructField("missing", T.BooleanType()), T.StructField("held", T.IntegerType())])


def timed_stop_decisions(rounds: DataFrame, lateness: str, patience_seconds: int) -> DataFrame:
    """`stop_decisions` whose state goes: a run is over when the watermark has passed its last round by `patience_seconds`.

    If rounds then still wait for one before them, that one is reported: a row with its number, missing = true, and `held`, the
    number of rounds that waited; they stay undecided. Stopped and finished runs leave in silence. So state holds runs of the last
    patience + lateness only. Rows later than `lateness` are dropped, and rows of a run that is over open a new one.
    Runs are dealt over RUN_GROUPS groups by a hash: a call of Python takes all new rows of a group, and its timer is the earliest of its runs.
    """

    wait = patience_seconds * 1000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = {tuple(r[:2]): tuple(r[2:]) for r in state.get[0]} if state.exists else {}
        clock, out, fresh = state.getCurrentWatermarkMs(), [], {}
        if not state.hasTimedOut:
            for *run, number, privacy, utility, ms in _listed(batches, "_id", "config", "round", "privacy_score", "utility_score", "_ms"):
                rows = fresh.setdefault(tuple(run), ([], []))
                rows[0].append((number, privacy, utility))
                rows[1].append(0 if ms != ms else int(ms))
        for run, (rows, times) in fresh.items():
            *held, last, _ = runs.get(run, (*_FRESH, 0, 0))
            held, decided = _advance(tuple(held), rows)
            last = max(last, *times)
            runs[run] = (*held, last, max(last + wait, clock + 1))
            out += [(*run, *row, False, 0) for row in decided]
        for run, (*_, due, flat, _, until) in [*runs.items()]:
            if run not in fresh and until < clock:
                del runs[run]
                if flat:
                    out.append((*run, due, False, True, len(flat) // 3))
        if runs:
            state.update(([(*run, *rest) for run, rest in runs.items()],))
            state.setTimeoutTimestamp(max(clock, min(rest[-1] for rest in runs.values())))
        elif state.exists:
            state.remove()
        if out:
            made = pd.DataFrame(out, columns=TIMED_OUT.names)
            yield made.assign(profile_id=[None if i is None else int(i) for i in made["profile_id"]])

    group = F.pmod(F.xxhash64("profile_id", "config"), F.lit(RUN_GROUPS))
    stream = late(rounds, lateness).withColumn("_ms", F.unix_millis("ts")).withColumn("_id", F.col("profile_id").cast("string"))
    return stream.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        decide, TIMED_OUT, TIMED_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
