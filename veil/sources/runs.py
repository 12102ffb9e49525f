"""Runs that are merged or taken up again: N result sets of the same profiles, and stage files of an unfinished run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.sources.profiles import merge_annotations

STAGES = ("inference", "anonymized", "utility")


# ---- merging ------------------------------------------------------------------------------------


def _numbered(runs: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    parts = [run.select(F.lit(i).alias("run"), *columns) for i, run in enumerate(runs)]
    return reduce(DataFrame.unionByName, parts)


def _first_wins(maps: Column, kind: str) -> Column:
    """Union of an array of maps; of equal keys the first one's value."""
    return F.aggregate(maps, F.lit(None).cast(kind), lambda acc, m: merge_annotations(m, acc))


def _ordered(by: str) -> Column:
    """The group's structs (by, v) in order; maps inside have no order of their own."""
    return F.array_sort(F.collect_list(F.struct(by, "v")), lambda a, b: (a[by] - b[by]).cast("int"))


def merge_runs_by_position(runs: Sequence[DataFrame]) -> DataFrame:
    """(position, username, versions, reviews): the same profiles of N runs as one.

    Each run has (position, username, versions, reviews), as `decode_profiles` gives them; earlier runs come first in
    everything. A version's comments are those of the first run that has it, so a longer run adds its extra versions; its
    predictions and utility are the union over all runs, and of equal keys the first run's value stays. Positions at which
    runs name different users are left out (see `merge_exceptions`); a run that lacks a position adds nothing to it.
    """
    kinds = runs[0].schema["versions"].dataType.elementType
    rows = _numbered(runs, ["position", "username", "versions", "reviews"]).repartition("position")
    first = rows.groupBy("position").agg(
        F.min_by("username", "run").alias("username"), F.min_by("reviews", "run").alias("reviews"),
        F.min("username").alias("least"), F.max("username").alias("most"), F.count_if(F.col("username").isNull()).alias("unnamed"),
    )
    agreed = first.filter("least = most AND unnamed = 0").drop("least", "most", "unnamed")
    # one row of each run per (position, version)
    each = rows.select("position", "run", F.posexplode("versions").alias("version", "v"))
    merged = each.groupBy("position", "version").agg(_ordered("run").alias("vs"))
    own = lambda name: F.transform("vs", lambda x: x["v"][name])
    version = F.struct(
        F.element_at("vs", 1)["v"]["comments"].alias("comments"),
        _first_wins(own("predictions"), kinds["predictions"].dataType.simpleString()).alias("predictions"),
        _first_wins(own("utility"), kinds["utility"].dataType.simpleString()).alias("utility"),
    )
    whole = merged.select("position", "version", version.alias("v")).groupBy("position").agg(
        F.transform(_ordered("version"), lambda x: x["v"]).alias("versions")
    )
    none = F.array().cast(runs[0].schema["versions"].dataType)
    return agreed.join(whole, "position", "left").select("position", "username", F.coalesce("versions", none).alias("versions"), "reviews")


def merge_exceptions(runs: Sequence[DataFrame]) -> DataFrame:
    """(position, problem, usernames, runs): positions at which users differ, repeat inside a run, or that a run lacks."""
    names = F.array_sort(F.collect_set(F.coalesce("username", F.lit(""))))  # one per run, but for repeats
    found = _numbered(runs, ["position", "username"]).groupBy("position").agg(
        names.alias("usernames"), F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("rows")
    )
    problem = (
        F.when(F.size("usernames") > 1, "different users").when(F.col("rows") > F.col("runs"), "repeated")
        .when(F.col("runs") < len(runs), "missing")
    )
    return found.select("position", problem.alias("problem"), "usernames", "runs").filter("problem IS NOT NULL")


# ---- resuming -----------------------------------------------------------------------------------


def _whole(lines: DataFrame) -> DataFrame:
    """Lines that are complete JSON records of a named profile; a half-written one is none."""
    named = lines.withColumn("username", F.get_json_object("value", "$.username"))
    return named.filter(F.try_parse_json("value").isNotNull() & F.col("username").isNotNull())


def _rank(stage: Column, stages: Sequence[str]) -> tuple[Column, Column]:
    """(number, place of the stage) of a stage name such as 'anonymized_2'; null for other names."""
    pattern = f"^({'|'.join(stages)})_([0-9]+)$"
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.regexp_extract(stage, pattern, 1)).cast("int")
    return F.regexp_extract(stage, pattern, 2).try_cast("int"), F.nullif(place, F.lit(0))


def resume(written: DataFrame, source: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """(username, stage, number, place, value): each source profile as far as the run has come.

    `written` has the lines of all stage files (stage, value), `source` those the run began with (value). Of a profile's complete
    lines the furthest stage counts, by number, then by place of the stage; of several in one stage the greatest text. A
    profile that no stage file has whole falls back to its source line, with a null stage. Lines of other profiles, of unknown
    stages, and broken ones are ignored. Repeated source lines of one user are one profile.
    """
    number, place = _rank(F.col("stage"), stages)
    lines = _whole(written).select("username", "value", "stage", number.alias("number"), place.alias("place"))
    lines = lines.filter("place IS NOT NULL AND number IS NOT NULL")
    start = _whole(source).select(
        "username", "value", F.lit(None).cast("string").alias("stage"), F.lit(-1).alias("number"), F.lit(0).alias("place")
    )
    both = start.withColumn("own", F.lit(1)).unionByName(lines.withColumn("own", F.lit(0)))
    # combined before the shuffle: of any number of lines one is left for each profile
    best = F.max(F.struct("number", "place", "value", "stage"))
    return both.groupBy("username").agg(best.alias("b"), F.max("own").alias("own")).filter("own = 1").select(
        "username", "b.stage", F.nullif("b.number", F.lit(-1)).alias("number"), F.nullif("b.place", F.lit(0)).alias("place"), "b.value"
    )


def resume_report(
    resumed: DataFrame, written: DataFrame, source: DataFrame, stage: str, number: int, target: int | None = None, stages: Sequence[str] = STAGES
) -> DataFrame:
    """One row: whether all profiles have come as far as `stage`_`number`, and what the stage files hold besides.

    target (given, or the distinct users of the source), profiles, finished, unfinished, broken lines, repeats (lines of one user in one
    stage beyond the first), strangers (users that the source lacks), complete.
    """
    want = F.struct(F.lit(number), F.lit(list(stages).index(stage) + 1))
    reached = F.coalesce(F.struct(F.col("number"), F.col("place")) >= want, F.lit(False)) & F.col("number").isNotNull()
    states = resumed.agg(F.count(F.lit(1)).alias("profiles"), F.count_if(reached).alias("finished"))
    users = _whole(source).select("username").distinct()
    whole = _whole(written)
    per = whole.groupBy("username", "stage").agg(F.count(F.lit(1)).alias("n"))
    repeats = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"), F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    strangers = whole.select("username").distinct().join(users, "username", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    total = written.agg(F.count(F.lit(1)).alias("lines"))
    aim = users.agg((F.lit(target) if target is not None else F.count(F.lit(1))).cast("long").alias("target"))
    # one row each
    row = states.join(aim).join(repeats).join(strangers).join(total)
    return row.select(
        "target", "profiles", "finished", (F.col("profiles") - F.col("finished")).alias("unfinished"),
        (F.col("lines") - F.col("whole")).alias("broken"), "repeats", "strangers",
        ((F.col("profiles") == F.col("target")) & (F.col("finished") == F.col("target"))).alias("complete"),
    )


def require_complete(resumed: DataFrame, target: int, stage: str | None = None, number: int = 0, stages: Sequence[str] = STAGES) -> DataFrame:
    """`resumed`, if it has `target` profiles and, where a stage is named, all have come as far; else ValueError, so the next stage can't run."""
    far = F.lit(True)
    if stage is not None:
        want = F.struct(F.lit(number), F.lit(list(stages).index(stage) + 1))
        far = F.coalesce((F.struct("number", "place") >= want) & F.col("number").isNotNull(), F.lit(False))
    found, finished = resumed.agg(F.count(F.lit(1)), F.count_if(far)).first()
    if found != target:
        raise ValueError(f"{found} profiles instead of {target}")
    if finished != target:
        raise ValueError(f"{target - finished} of {target} profiles haven't come to {stage}_{number}")
    return resumed
