"""Merging N runs and resuming an unfinished one, against hand-worked rows."""

import json

import pytest

from veil.sources import runs as R
from veil.sources.profiles import VERSION

RUN = f"position long, username string, versions array<{VERSION}>, reviews map<string, string>"


def version(text, predictions=None, utility=None):
    return ([(text, "s", "u", 1.0)], predictions, utility)


def plain_merge(runs):
    """Version by version, one run after the other: what is missing is added."""
    out = {}
    for position in sorted({p for run in runs for p in run}):
        there = [run[position] for run in runs if position in run]
        if len({name for name, _ in there}) > 1:
            continue
        merged = []
        for _, versions in there:
            for k, (comments, predictions, utility) in enumerate(versions):
                if k == len(merged):
                    merged.append([comments, dict(predictions or {}), dict(utility or {})])
                else:
                    for own, new in ((merged[k][1], predictions), (merged[k][2], utility)):
                        for key, value in (new or {}).items():
                            own.setdefault(key, value)
        out[position] = (there[0][0], merged)
    return out


def test_three_runs_of_unequal_length(spark):
    runs = [
        {0: ("a", [version("a0", {"m": {"age": "1"}})]), 1: ("b", [version("b0"), version("b1", None, {"j": "1"})]), 2: ("c", []), 3: ("d", [version("d0")])},
        {0: ("a", [version("A0", {"m": {"age": "2"}, "n": {"sex": "f"}}), version("A1", {"n": {"x": "y"}})]), 1: ("b", [version("B0", {"m": {}})]), 2: ("c", [version("C0")]), 3: ("D", [version("D0")])},
        {0: ("a", [version("x0", None, {"j": "7"}), version("x1", {"n": {"x": "z"}, "o": {}}), version("x2")]), 1: ("b", [version("y0"), version("y1", {"m": {"age": "3"}}, {"j": "2"})]), 4: ("e", [version("e0")])},
    ]
    frames = [spark.createDataFrame([(p, name, v, {"r": f"{i}"}) for p, (name, v) in run.items()], RUN) for i, run in enumerate(runs)]
    merged = {r["position"]: r for r in R.merge_runs_by_position(frames).collect()}
    expected = plain_merge(runs)
    assert set(merged) == set(expected) == {0, 1, 2, 4}
    for p, (name, versions) in expected.items():
        got = merged[p]
        assert got["username"] == name and len(got["versions"]) == len(versions)
        for v, (comments, predictions, utility) in zip(got["versions"], versions):
            assert [tuple(c) for c in v["comments"]] == comments and (v["predictions"] or {}) == predictions and (v["utility"] or {}) == utility
    assert merged[0]["reviews"] == {"r": "0"} and merged[4]["reviews"] == {"r": "2"}
    odd = {(r["position"], r["problem"], tuple(r["usernames"]), r["runs"]) for r in R.merge_exceptions(frames).collect()}
    assert odd == {(2, "missing", ("c",), 2), (3, "different users", ("D", "d"), 2), (4, "missing", ("e",), 1)}


def test_merge_odd_rows(spark):
    empty = spark.createDataFrame([], RUN)
    one = spark.createDataFrame([(0, None, [version("x")], None), (1, "a", None, None), (2, "b", [version(None)], None), (2, "b", [version("again")], None)], RUN)
    assert R.merge_runs_by_position([empty, empty]).count() == 0 and R.merge_exceptions([empty]).count() == 0
    merged = {r["position"]: r["versions"] for r in R.merge_runs_by_position([one, empty]).collect()}
    assert set(merged) == {1, 2} and merged[1] == [] and len(merged[2]) == 1
    assert {(r["position"], r["problem"]) for r in R.merge_exceptions([one]).collect()} == {(2, "repeated")}
    many = spark.range(3000).selectExpr("id AS position", "concat('u', id) AS username", f"CAST(array() AS array<{VERSION}>) AS versions", "CAST(NULL AS map<string, string>) AS reviews")
    assert R.merge_runs_by_position([many, many, many]).count() == 3000


def record(name, note=""):
    return json.dumps({"username": name, "comments": [], "note": note})


def frames(spark, stage_lines, source_lines):
    return (
        spark.createDataFrame(stage_lines, "stage string, value string"), spark.createDataFrame([(x,) for x in source_lines], "value string")
    )


def test_half_written_stages_resume_without_loss_or_repeat(spark):
    names = [f"u{i}" for i in range(8)]
    source = [record(n) for n in names]
    stages = [("inference_0", record(n, "i0")) for n in names[:7]] + [("anonymized_1", record(n, "a1")) for n in names[:5]]
    stages += [("utility_1", record(n, "done")) for n in names[:2]] + [("utility_1", record("u2", "cut")[:-4]), ("inference_10", record("u0", "ten")), ("inference_9", record("u0", "nine"))]
    stages += [("utility_1", record("u1", "done")), ("utility_1", record("stranger")), ("utility_x", record("u5")), ("final_3", record("u6")), ("utility_1", ""), ("utility_1", None)]
    written, start = frames(spark, stages, source)
    resumed = R.resume(written, start)
    rows = {r["username"]: (r["stage"], json.loads(r["value"]).get("note")) for r in resumed.collect()}
    assert rows == {
        "u0": ("inference_10", "ten"), "u1": ("utility_1", "done"), "u2": ("anonymized_1", "a1"), "u3": ("anonymized_1", "a1"), "u4": ("anonymized_1", "a1"),
        "u5": ("inference_0", "i0"), "u6": ("inference_0", "i0"), "u7": (None, ""),
    }
    report = R.resume_report(resumed, written, start, "anonymized", 1).first().asDict()
    assert report == {"target": 8, "profiles": 8, "finished": 5, "unfinished": 3, "broken": 3, "repeats": 1, "strangers": 1, "complete": False}
    assert R.require_complete(resumed, 8).count() == 8
    with pytest.raises(ValueError, match="3 of 8 profiles"):
        R.require_complete(resumed, 8, "anonymized", 1)
    with pytest.raises(ValueError, match="8 profiles instead of 9"):
        R.require_complete(resumed, 9)
    # the run goes on: what was missing is written, and the gate opens
    rest = [("anonymized_1", record(n, "late")) for n in ("u5", "u6", "u7")]
    later, _ = frames(spark, stages + rest, source)
    again = R.resume(later, start)
    assert R.require_complete(again, 8, "anonymized", 1).count() == 8
    assert R.resume_report(again, later, start, "anonymized", 1, target=8).first()["complete"]


def test_resume_with_nothing(spark):
    written, start = frames(spark, [], [record("a"), record("a"), "{broken", None])
    assert [(r["username"], r["stage"], r["number"]) for r in R.resume(written, start).collect()] == [("a", None, None)]
    report = R.resume_report(R.resume(written, start), written, start, "inference", 0).first()
    assert (report["target"], report["finished"], report["broken"], report["repeats"], report["complete"]) == (1, 0, 0, 0, False)
    none, empty = frames(spark, [], [])
    assert R.resume(none, empty).count() == 0


def test_many_lines_of_one_profile(spark):
    """A profile that half of all lines name is one row before the shuffle."""
    stages = [("inference_0", record("hot", str(i))) for i in range(4000)] + [("inference_0", record(f"u{i}")) for i in range(50)]
    written, start = frames(spark, stages, [record("hot"), *[record(f"u{i}") for i in range(60)]])
    resumed = R.resume(written.repartition(6), start)
    found = {r["username"]: r["stage"] for r in resumed.collect()}
    assert len(found) == 61 and found["hot"] == "inference_0" and found["u55"] is None
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
