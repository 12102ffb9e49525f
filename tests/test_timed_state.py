"""Stop decisions whose state expires: gaps are reported, state goes."""

import datetime

from veil.session import scratch_path
from veil.streaming import counters as C

START = datetime.datetime(2024, 1, 1)
KIND = "profile_id long, config string, round int, privacy_score double, utility_score double, ts timestamp"


def run_batches(spark, tmp_path, batches, lateness="1 minute", patience=600):
    """Each list of rows is a file and a micro-batch; (rows out, state rows after the last batch)."""
    path = str(tmp_path / "in")
    for n, rows in enumerate(batches):
        made = [(p, "c", r, priv, 0.5, START + datetime.timedelta(seconds=s)) for p, r, priv, s in rows]
        spark.createDataFrame(made, KIND).coalesce(1).write.mode("append").parquet(path + f"/{n}")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)
    out = scratch_path(spark, "timed")
    query = (
        C.timed_stop_decisions(stream, lateness, patience).writeStream.option("checkpointLocation", scratch_path(spark, "timed-state"))
        .outputMode("append").format("parquet").option("path", out).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    rows = spark.read.schema(C.TIMED_OUT).parquet(out).collect()
    return sorted((r["profile_id"], r["round"], r["stopped"], r["missing"], r["held"]) for r in rows), left


def test_a_gap_is_reported_and_freed(spark, tmp_path):
    batches = [
        [(1, 1, 0.1, 0), (1, 3, 0.2, 5), (1, 4, 0.2, 6), (2, 1, 0.9, 0), (2, 2, 0.9, 4), (3, 1, 0.3, 1), (4, 2, 0.3, 2)],
        [(1, 5, 0.2, 60), (9, 1, 0.1, 100)],
        [(9, 2, 0.1, 5000)],
        [(9, 3, 0.1, 90000)],
    ]
    found, left = run_batches(spark, tmp_path, batches)
    wanted = [(1, 1, False, False, 0), (1, 2, False, True, 3), (2, 1, False, False, 0), (2, 2, True, False, 0), (3, 1, False, False, 0), (4, 1, False, True, 1)]
    # profile 9 moves the clock: each of its rounds comes before the watermark has passed the one before by the patience
    assert found == wanted + [(9, 1, False, False, 0), (9, 2, False, False, 0), (9, 3, False, False, 0)]
    assert left == 1


def test_rounds_of_a_run_that_is_over_open_a_new_one(spark, tmp_path):
    batches = [[(1, 1, 0.1, 0)], [(9, 1, 0.1, 5000)], [(9, 2, 0.1, 5001)], [(1, 2, 0.1, 5100)], [(9, 3, 0.1, 90_000)]]
    found, left = run_batches(spark, tmp_path, batches)
    assert [r for r in found if r[0] == 1] == [(1, 1, False, False, 0), (1, 1, False, True, 1)] and left == 1


def test_a_late_round_within_patience_closes_the_gap(spark, tmp_path):
    batches = [[(1, 1, 0.1, 0), (1, 3, 0.9, 5)], [(1, 2, 0.85, 500)], [(8, 1, 0.1, 20_000)]]
    found, left = run_batches(spark, tmp_path, batches)
    assert [r for r in found if r[0] == 1] == [(1, 1, False, False, 0), (1, 2, False, False, 0), (1, 3, False, False, 0)] and left == 1


def test_no_rounds(spark, tmp_path):
    found, left = run_batches(spark, tmp_path, [[(1, 1, 0.1, 0)]], patience=10)
    assert found == [(1, 1, False, False, 0)] and left == 1
