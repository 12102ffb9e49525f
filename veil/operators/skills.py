"""Skill repository analytics: versions, dependencies, executions, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.operators.ordering import top_k
from veil.session import cut_lineage

# Keywords of the functional domains, and of the capabilities every repository should have.
DOMAINS = {
    "data_processing": ["process", "transform", "parse", "format"],
    "analysis": ["analyze", "calculate", "compute", "evaluate"],
    "storage": ["save", "load", "store", "read", "write"],
    "communication": ["send", "request", "fetch", "api"],
    "validation": ["validate", "check", "verify"],
    "visualization": ["plot", "chart", "graph", "visualize"],
}
EXPECTED = {
    "error_handling": ["try", "except", "error", "handle"],
    "logging": ["log", "record", "track"],
    "caching": ["cache", "memoize"],
    "batch": ["batch", "bulk", "parallel"],
    "validation": ["validate", "verify", "check"],
}
# Error classes by the exception name in a message.
ERROR_CLASSES = {
    "FileNotFoundError": "file_not_found", "KeyError": "key_error", "ValueError": "value_error", "TypeError": "type_error",
}


def orphans(skills: DataFrame, references: DataFrame) -> DataFrame:
    """Atomic skills that no dependency or parent list names."""
    atomic = skills.filter("category = 'atomic'")
    return atomic.join(references.select(F.col("dep_id").alias("skill_id")).distinct(), "skill_id", "left_anti")


def dependency_counts(skills: DataFrame, references: DataFrame) -> DataFrame:
    """How often each atomic skill is depended on; 0 marks an unused one."""
    counts = references.groupBy(F.col("dep_id").alias("skill_id")).agg(F.count(F.lit(1)).alias("uses"))
    return skills.filter("category = 'atomic'").select("skill_id").join(counts, "skill_id", "left").fillna({"uses": 0})


def dependents(references: DataFrame, dep_id: int) -> DataFrame:
    """Skills that depend on one skill, over dependency arrays or rows alike."""
    return references.filter(F.col("dep_id") == dep_id).select("skill_id").distinct()


def _dependency_sets(references: DataFrame) -> DataFrame:
    """(deps, members, rep): distinct sets of at least two members, how many skills have them and the least of these."""
    return (
        references.groupBy("skill_id").agg(F.array_sort(F.collect_set("dep_id")).alias("deps"))
        .filter(F.size("deps") > 1)
        .groupBy("deps").agg(F.count(F.lit(1)).alias("members"), F.min("skill_id").alias("rep"))
    )


def _marks(members: str) -> Column:
    """64 bits, of which each member sets one."""
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(d), F.lit(64)).cast("int"))
    return F.aggregate(members, F.lit(0).cast("long"), lambda acc, d: acc.bitwiseOR(bit(d)))


def coupled_sets(references: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of dependency sets with Jaccard above the threshold, and the number of skill pairs behind each.

    Skills with equal sets are folded first, so copies are counted, never paired. Two sets above the
    threshold must share one of their rarest members: each set is looked up only by its rarest
    |x| - floor(threshold * |x|) members, which is exact and keeps frequent members out of the join.
    A looked-up pair is let go at once if too little can be shared: by the places of the member, if it is the first shared one,
    and by 64-bit marks of the members, since each bit that only one set has is a member that the other lacks.
    """
    sets = cut_lineage(_dependency_sets(references), "dependency-sets")
    tokens = sets.select("rep", F.explode("deps").alias("dep"), F.size("deps").alias("n"), _marks("deps").alias("marks"))
    rarity = tokens.groupBy("dep").agg(F.count(F.lit(1)).alias("freq"))
    ranked = tokens.join(rarity, "dep").withColumn(
        "pos", F.row_number().over(Window.partitionBy("rep").orderBy("freq", "dep"))
    )
    prefix = ranked.filter(F.col("pos") <= F.col("n") - F.floor(F.col("n") * threshold)).select("rep", "dep", "n", "pos", "marks")
    a, b = prefix.alias("a"), prefix.alias("b")
    only = lambda x, y: F.bit_count(F.col(f"{x}.marks").bitwiseAND(F.bitwise_not(F.col(f"{y}.marks"))))
    shared = F.least(
        F.col("a.n") - only("a", "b"), F.col("b.n") - only("b", "a"), F.col("a.n") - F.col("a.pos") + 1, F.col("b.n") - F.col("b.pos") + 1
    )
    close = (F.col("a.n") > F.col("b.n") * threshold) & (F.col("b.n") > F.col("a.n") * threshold)
    close = close & (shared * (1 + threshold) > (F.col("a.n") + F.col("b.n")) * threshold - 1e-9)
    candidates = (
        a.join(b, (F.col("a.dep") == F.col("b.dep")) & (F.col("a.rep") < F.col("b.rep")) & close)
        .select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))
        .distinct()
    )
    side = lambda s: sets.select(F.col("rep").alias(f"rep_{s}"), F.col("deps").alias(f"d{s}"), F.col("members").alias(f"m{s}"))
    overlap = F.size(F.array_intersect("da", "db")) / F.size(F.array_union("da", "db"))
    different = (
        candidates.join(side("a"), "rep_a").join(side("b"), "rep_b")
        .withColumn("jaccard", overlap)
        .filter(F.col("jaccard") > threshold)
        .select("rep_a", "rep_b", "jaccard", (F.col("ma") * F.col("mb")).alias("pairs"))
    )
    same = sets.filter("members > 1").select(
        F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("jaccard"),
        (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("pairs"),
    )
    return different.unionByName(same)


def statistics(skills: DataFrame, references: DataFrame) -> DataFrame:
    """Counts by category, status and method, mean quality and orphans, of skills still in use."""
    live = skills.filter("status <> 'deprecated'")
    groups = (
        live.groupingSets(
            [[], [F.col("category")], [F.col("status")], [F.col("method")]], F.col("category"), F.col("status"), F.col("method")
        )
        .agg(F.count(F.lit(1)).alias("skills"), F.round(F.avg("quality"), 6).alias("avg_quality"))
    )
    lonely = orphans(skills, references).agg(F.count(F.lit(1))).scalar()
    whole = F.col("category").isNull() & F.col("status").isNull() & F.col("method").isNull()
    return groups.withColumn("orphans", F.when(whole, lonely))


def execution_quality(executions: DataFrame) -> DataFrame:
    """Success, speed and timeout shares folded into one score; a skill never run has none here and counts 0.5."""
    agg = executions.groupBy("skill_id").agg(
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("execution_time").alias("avg_time"),
        F.avg(F.col("timeout_exceeded").cast("double")).alias("timeout_rate"),
        F.count(F.lit(1)).alias("executions"),
    )
    efficiency = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("avg_time") / 5.0)
    upkeep = F.lit(1.0) - F.col("timeout_rate") * 0.5
    score = F.col("success_rate") * 0.3 + efficiency * 0.2 + F.col("success_rate") * 0.3 + upkeep * 0.2
    return agg.withColumn("score", score)


def with_quality(skills: DataFrame, executions: DataFrame) -> DataFrame:
    return skills.join(execution_quality(executions).select("skill_id", "score"), "skill_id", "left").fillna({"score": 0.5})


def error_class(message: Column, timeout: Column) -> Column:
    kind = F.when(message.isNotNull() & (message != ""), "runtime_error")
    for name, label in reversed(ERROR_CLASSES.items()):
        kind = F.when(message.contains(name), label).otherwise(kind)
    return F.when(timeout, "timeout").otherwise(kind)


def error_types(executions: DataFrame) -> DataFrame:
    kind = error_class(F.col("error_message"), F.col("timeout_exceeded"))
    return (
        executions.filter(~F.col("success")).groupBy("skill_id", kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
        .filter("error_type IS NOT NULL")
    )


def common_errors(executions: DataFrame, k: int = 3) -> DataFrame:
    """First k distinct messages per skill, cut to their first line and 100 characters.

    Messages are reduced to their first appearance before they are ranked.
    """
    short = F.substring(F.split_part("error_message", F.lit("\n"), F.lit(1)), 1, 100)
    seen = (
        executions.filter(~F.col("success") & (F.coalesce("error_message", F.lit("")) != ""))
        .groupBy("skill_id", short.alias("message")).agg(F.min("record_id").alias("first_seen"))
    )
    return top_k(seen, ["skill_id"], [F.col("first_seen")], k).select("skill_id", "rank", "message")


def severity(executions: DataFrame) -> DataFrame:
    rate = executions.groupBy("skill_id").agg(F.avg((~F.col("success")).cast("double")).alias("failure_rate"))
    r = F.col("failure_rate")
    return rate.withColumn(
        "severity", F.when(r > 0.8, "critical").when(r > 0.5, "high").when(r > 0.2, "medium").otherwise("low")
    )


def _any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def domain_coverage(skills: DataFrame, domains: dict[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """Which domains some skill covers; one flag per domain in a single aggregate."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    flags = [F.bool_or(_any_of(text, words)).alias(d) for d, words in domains.items()]
    one = skills.agg(*flags)
    names = list(domains)
    covered = sum((F.col(d).cast("int") for d in names), F.lit(0))
    return one.select(*names, (covered / len(names)).alias("coverage"))


def gaps(skills: DataFrame, expected: dict[str, Sequence[str]] = EXPECTED) -> DataFrame:
    """Missing capabilities and a shortage of composite skills."""
    name, about = F.lower("name"), F.lower("description")
    flags = [F.coalesce(F.bool_or(_any_of(name, w) | _any_of(about, w)), F.lit(False)).alias(g) for g, w in expected.items()]
    one = skills.agg(
        F.count_if(F.col("category") == "atomic").alias("atomic"), F.count_if(F.col("category") == "functional").alias("functional"), *flags
    )
    found = [
        F.when(F.col("functional") < F.col("atomic") * 0.5, F.struct(F.lit("functional_shortage").alias("gap"), F.lit("high").alias("priority")))
    ]
    found += [F.when(~F.col(g), F.struct(F.lit(f"missing_{g}").alias("gap"), F.lit("medium").alias("priority"))) for g in expected]
    return one.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("g")).select("g.*")


def feedback(executions: DataFrame, recent: int = 10, k: int = 3) -> DataFrame:
    """First k error messages among the first `recent` records of each skill's history, newest record first."""
    rows = executions.select("skill_id", "record_id", "ts", "success", "error_message")
    history = top_k(rows, ["skill_id"], [F.desc("ts"), F.desc("record_id")], recent)
    errors = F.array_sort(F.collect_list(F.when(~F.col("success") & F.col("error_message").isNotNull(), F.struct("rank", "error_message"))))
    listed = history.groupBy("skill_id").agg(F.transform(errors, lambda e: e["error_message"]).alias("all"))
    return listed.filter(F.size("all") > 0).select(
        "skill_id", F.array_join(F.slice("all", 1, k), "; ").alias("common_errors"), F.array_join(F.slice("all", 1, 2), ", ").alias("improve")
    )


def for_review(skills: DataFrame, threshold: float) -> DataFrame:
    return skills.filter(F.col("needs_review") | (F.col("quality") >= threshold) | (F.col("method") == "ai_generated"))


def search(skills: DataFrame, query: str, fields: Sequence[str] = ("name", "description")) -> DataFrame:
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(f).contains(query.lower())
    return skills.filter(hit)


def final_statistics(skills: DataFrame, target: float) -> DataFrame:
    return skills.agg(F.avg("quality").alias("q"), F.avg("success_rate").alias("s")).select(
        F.round("q", 6).alias("avg_quality"), F.round("s", 6).alias("avg_success_rate"), (F.col("q") >= target).alias("target_reached")
    )


def phases_until_stall(phases: DataFrame, back: int = 3) -> DataFrame:
    """Phases of a cycle up to the first after which none of the last `back` brought anything new."""
    order = Window.partitionBy("cycle").orderBy("phase")
    stall = F.sum("new_skills").over(order.rowsBetween(-(back - 1), 0)) == 0
    return (
        phases.withColumn("stalled", stall)
        .withColumn("_before", F.max(F.col("stalled").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.coalesce("_before", F.lit(0)) == 0)
        .drop("_before")
    )


# ---- versions ---------------------------------------------------------------------------------


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("skill_id").agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))


def as_of(versions: DataFrame, n: int) -> DataFrame:
    """State of every skill at version n."""
    return latest_versions(versions.filter(F.col("version") <= n))


def restored(versions: DataFrame, n: int) -> DataFrame:
    """Version table with version n of every skill that has it saved again as its newest version."""
    newest = versions.groupBy("skill_id").agg((F.max("version") + 1).alias("next"))
    again = versions.filter(F.col("version") == n).join(newest, "skill_id").select("skill_id", F.col("next").alias("version"), "payload")
    return versions.select("skill_id", "version", "payload").unionByName(again)


# ---- parameter checks ---------------------------------------------------------------------------

TYPE_PATTERNS = {"int": r"^-?[0-9]+$", "float": r"^-?[0-9]+(\.[0-9]+)?([eE]-?[0-9]+)?$", "bool": "^(true|false)$"}


def parameter_errors(records: DataFrame, key: str, params: str, specs: dict[str, dict]) -> DataFrame:
    """(key, error) for every broken rule of a map column of text values; no shuffle."""
    errors: list[Column] = []
    for name, spec in specs.items():
        v = F.try_element_at(F.col(params), F.lit(name))
        n = v.try_cast("double")

        def bad(test: Column, text: str) -> Column:
            return F.when(test, F.lit(f"{name}: {text}"))

        if spec.get("required"):
            errors.append(bad(v.isNull(), "missing"))
        if spec.get("type") in TYPE_PATTERNS:
            errors.append(bad(~v.rlike(TYPE_PATTERNS[spec["type"]]), f"not {spec['type']}"))
        if "min" in spec:
            errors.append(bad(n < spec["min"], f"below {spec['min']}"))
        if "max" in spec:
            errors.append(bad(n > spec["max"], f"above {spec['max']}"))
        if "options" in spec:
            errors.append(bad(~v.isin(spec["options"]), "not an option"))
        if "min_length" in spec:
            errors.append(bad(F.length(v) < spec["min_length"], f"shorter than {spec['min_length']}"))
        if "max_length" in spec:
            errors.append(bad(F.length(v) > spec["max_length"], f"longer than {spec['max_length']}"))
        if "pattern" in spec:
            errors.append(bad(~v.rlike(f"^(?:{spec['pattern']})"), "no match"))
    return records.select(key, F.explode_outer(F.filter(F.array(*errors), lambda e: e.isNotNull())).alias("error")).filter("error IS NOT NULL")
