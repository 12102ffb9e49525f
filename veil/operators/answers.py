"""Line-oriented answers to tables: typed blocks, change lists, reasoning steps, aligned comments.

Lines are exploded and windows run per answer, so the largest group is one answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.answers import strip
from veil.functions.similarity import first_best, jaro_winkler_each, jaro_winkler_to

FIELDS = ["inference", "guess", "certainty"]


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, and one without a line for a null text."""
    return df.select(key, F.posexplode_outer(F.split(text, "\n")).alias("pos", "line"))


def parse_blocks(answers: DataFrame, key: str, text: str, attributes: Sequence[str]) -> DataFrame:
    """(key, pii_type, inference, guesses, certainty) for every expected attribute of every answer.

    'Type: x' or a line keyed by an attribute name opens a block; Inference, Guess and Certainty lines
    set a field of the block, a later one of the same field starting it anew; a line without a colon
    extends the field last seen. Keys may be misspelt. Missing attributes get MISSING and no guesses.
    """
    names = F.array(*[F.lit(a) for a in attributes])
    parts = F.split("line", ":")
    full = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    # every answer keeps its rows down to the last grouping, so the input is read once and none gets lost
    lines = (
        _lines(answers, key, text)
        .withColumn("used", F.coalesce(F.trim("line") != "", F.lit(False)))
        .withColumn("parts", full)
        .withColumn("keyed", F.col("used") & (F.size("parts") > 1))
        .withColumn("_k", F.lower(F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit(""))))
        .withColumn("val", F.when(F.col("keyed"), F.array_join(F.slice("parts", F.lit(2), F.size("parts")), ":")))
    )
    to_known, to_names = jaro_winkler_to(["type", *FIELDS, *attributes]), jaro_winkler_to(attributes)
    lines = lines.withColumn("_s", to_known(F.when(F.col("keyed"), F.col("_k")))).withColumn(
        "_v", to_names(F.when(F.col("keyed") & (F.col("_s")[0] > 0.75), F.lower(F.trim("val"))))
    )
    by_name = F.slice("_s", len(FIELDS) + 2, len(attributes))
    is_type = F.col("keyed") & (F.col("_s")[0] > 0.75)
    is_name = F.col("keyed") & ~is_type & F.exists(by_name, lambda x: x > 0.75)
    field = F.lit(None).cast("string")
    for i in reversed(range(len(FIELDS))):
        field = F.when(F.col("_s")[i + 1] > 0.75, FIELDS[i]).otherwise(field)
    field = F.when(F.col("keyed") & ~is_type & ~is_name, field)
    typed = F.when(F.array_max("_v") >= 0.4, first_best(names, F.col("_v"))).otherwise("temp")
    header = F.when(is_type, typed).when(is_name, first_best(names, by_name))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        lines.withColumn("header", header)
        .withColumn("field", field)
        .withColumn("pii_type", F.last("header", ignorenulls=True).over(so_far))
        .withColumn("sub", F.last("field", ignorenulls=True).over(so_far))
        .withColumn("used", F.col("used") & F.col("header").isNull() & (F.col("field").isNotNull() | ~F.col("keyed")))
        .withColumn("used", F.col("used") & F.col("pii_type").isNotNull() & F.col("sub").isNotNull())
        .withColumn("pii_type", F.when(F.col("used"), F.col("pii_type")))
        .withColumn("sub", F.when(F.col("used"), F.col("sub")))
        .withColumn("body", F.when(F.col("field").isNotNull(), F.trim("val")).otherwise(F.get("parts", F.lit(0))))
    )
    pieces = placed.groupBy(key, "pii_type", "sub").agg(
        F.max(F.when(F.col("field").isNotNull(), F.col("pos"))).alias("start"),
        F.array_sort(F.collect_list(F.struct("pos", "body", F.col("field").isNotNull().alias("set")))).alias("ls"),
    )
    live = F.filter("ls", lambda x: x["pos"] >= F.coalesce(F.col("start"), F.lit(0)))
    joined = F.array_join(F.transform(live, lambda x: x["body"]), "\n")
    listed = F.flatten(
        F.transform(
            live,
            lambda x: F.when(x["set"], F.transform(F.split(x["body"], ";"), lambda g: F.trim(g))).otherwise(F.array(x["body"])),
        )
    )
    fields = pieces.groupBy(key, "pii_type").agg(
        F.max(F.when(F.col("sub") == "inference", joined)).alias("inference"),
        F.max(F.when(F.col("sub") == "guess", listed)).alias("guesses"),
        F.max(F.when(F.col("sub") == "certainty", joined)).alias("certainty"),
    )
    found = F.collect_list(F.when(F.col("pii_type").isNotNull(), F.struct("pii_type", F.struct("inference", "guesses", "certainty").alias("f"))))
    per_answer = fields.groupBy(key).agg(F.map_from_entries(found).alias("m"))
    expected = per_answer.select(key, "m", F.explode(names).alias("pii_type")).withColumn("f", F.try_element_at("m", F.col("pii_type")))
    none = F.array().cast("array<string>")
    return expected.select(
        key, "pii_type",
        F.when(F.col("f").isNull(), "MISSING").otherwise(F.col("f.inference")).alias("inference"),
        F.filter(F.coalesce("f.guesses", none), lambda g: g != "").alias("guesses"),
        F.col("f.certainty").alias("certainty"),
    )


def _runs(lines: DataFrame, key: str, header: Column) -> DataFrame:
    """Number the header lines of each text; lines before the first get 0."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("run", F.sum(header.cast("int")).over(so_far))


_QUOTED = r"""^[0-9]+[.)]?\s+Replace\s+['"](.+?)['"]\s+with\s+['"](.+?)['"]"""
_ARROW = r"^(.+?)\s*->\s*(.+)$"


def change_list(df: DataFrame, key: str, reasoning: str) -> DataFrame:
    """'N. Replace 'a' with 'b'' and 'a -> b' lines, with the lines that follow as the reason."""
    lines = _lines(df, key, reasoning).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    quoted, arrow = F.col("line").rlike(_QUOTED), F.col("line").rlike(_ARROW)
    lines = _runs(lines.withColumn("head", quoted | arrow), key, F.col("head")).filter("run > 0")
    side = lambda i: F.when(quoted, F.regexp_extract("line", _QUOTED, i)).otherwise(F.trim(F.regexp_extract("line", _ARROW, i)))
    return (
        lines.groupBy(key, "run")
        .agg(
            F.max(F.when(F.col("head"), side(1))).alias("original"),
            F.max(F.when(F.col("head"), side(2))).alias("anonymized"),
            F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("why"),
        )
        .select(
            key, F.col("run").alias("change"), "original", "anonymized",
            F.array_join(F.transform("why", lambda w: w["line"]), " ").alias("reason"),
        )
    )


def reasoning_steps(df: DataFrame, key: str, reasoning: str) -> DataFrame:
    """Steps opened by numbered or 'Step N:' lines; a text without any is a single step."""
    head = F.coalesce(F.col("line").rlike(r"(?i)^([0-9]+[.)]?\s*|Step\s*([0-9]+):)"), F.lit(False))
    lines = _runs(_lines(df, key, reasoning), key, head).withColumn("head", head)
    lines = lines.withColumn("runs", F.max("run").over(Window.partitionBy(key)))
    body = F.when(~F.col("head") & F.col("line").isNotNull(), F.struct("pos", "line"))
    steps = lines.groupBy(key, "run").agg(
        F.array_sort(F.collect_list(body)).alias("body"), F.max("runs").alias("runs"), F.bool_and(F.col("line").isNull()).alias("none")
    )
    single = F.col("runs") == 0
    low = lambda x: F.lower(x["line"])
    risks = F.transform(
        F.filter("body", lambda x: low(x).contains("risk") | low(x).contains("leak")), lambda x: strip(x["line"])
    )
    halves = F.filter(
        F.transform("body", lambda x: F.split(x["line"], "→|->")), lambda h: F.size(h) == 2
    )
    proposed = F.transform(halves, lambda h: F.struct(strip(h[0]).alias("original"), strip(h[1]).alias("anonymized")))
    text = F.array_join(F.transform("body", lambda x: x["line"]), "\n")
    ended = F.concat(text, F.when(F.size("body") > 0, "\n").otherwise(""))
    no_risks, no_changes = F.array().cast("array<string>"), F.array().cast("array<struct<original:string,anonymized:string>>")
    return steps.filter(single | (F.col("run") > 0)).select(
        key, F.when(single, 1).otherwise(F.col("run")).cast("long").alias("step"),
        F.when(single, F.when(~F.col("none"), text)).otherwise(ended).alias("analysis"),
        F.when(single, no_risks).otherwise(risks).alias("risks"),
        F.when(single, no_changes).otherwise(proposed).alias("proposed"),
    )


def answer_lines(answer: Column) -> Column:
    """Lines after the newline-hash mark, blank ones dropped."""
    parts = F.split(answer, "\n#")
    body = (
        F.when(F.size(parts) == 1, strip(answer))
        .when(F.size(parts) == 2, strip(parts[1]))
        .otherwise(F.array_join(parts, "\n"))
    )
    return F.filter(F.split(body, "\n"), lambda x: x != "")


def align_comments(df: DataFrame, key: str, originals: str, answer: str, min_sim: float = 0.5) -> DataFrame:
    """(key, ord, text): one adapted line per original comment.

    With as many lines as comments the order decides. Otherwise each comment takes its most similar
    line if that is similar enough and no earlier comment took it, else keeps its own text. A leading
    date is cut.
    """
    paired = F.transform(
        originals,
        lambda o, i: F.struct(o.alias("own"), F.when(F.col("same"), F.try_element_at("lines", i + 1)).alias("mate")),
    )
    # the lines travel with a comment only where they have to be searched; Python sees nulls elsewhere
    rows = (
        df.withColumn("lines", answer_lines(F.col(answer)))
        .withColumn("same", F.size("lines") == F.size(originals))
        .select(key, F.when(~F.col("same"), F.col("lines")).alias("pool"), F.posexplode(paired).alias("ord", "p"))
        .select(key, "pool", "ord", "p.own", "p.mate")
    )
    rows = rows.withColumn("sims", jaro_winkler_each(F.when(F.col("pool").isNotNull(), F.col("own")), F.col("pool")))
    rows = rows.withColumn("best", F.array_max("sims"))
    rows = rows.withColumn(
        "pick", F.when(F.col("best") > min_sim, F.array_position("sims", F.col("best")).cast("int"))
    )
    first = Window.partitionBy(key, "pick").orderBy("ord")
    chosen = (
        F.when(F.col("pool").isNull(), F.col("mate"))
        .when(F.col("pick").isNotNull() & (F.col("turn") == 1), F.element_at("pool", F.col("pick")))
        .otherwise(F.col("own"))
    )
    dated = F.substring("text", 1, 11).rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}:")
    return (
        rows.withColumn("turn", F.row_number().over(first))
        .select(key, "ord", chosen.alias("text"))
        .withColumn("text", F.when(dated, strip(F.expr("substring(text, 12)"))).otherwise(F.col("text")))
    )


def generated_records(answers: DataFrame, key: str, text: str, existing: DataFrame) -> DataFrame:
    """Records of a JSON object or array; known names are dropped, parents resolved by name."""
    js = F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1)
    listed = F.when(js.startswith("["), js).otherwise(F.concat(F.lit("["), js, F.lit("]")))
    record = "ARRAY<STRUCT<name: STRING, description: STRING, parent_skills: ARRAY<STRING>>>"
    rows = (
        answers.select(key, F.posexplode(F.from_json(listed, record)).alias("item", "r"))
        .select(key, "item", "r.*")
        .filter("name IS NOT NULL")
    )
    names = existing.groupBy(F.lower("name").alias("lname")).agg(F.min("skill_id").alias("found_id"))
    fresh = rows.withColumn("lname", F.lower("name")).join(names, "lname", "left_anti")
    parent = names.select(F.col("lname").alias("pname"), "found_id")
    one_each = fresh.select(key, "item", "name", "description", F.explode_outer("parent_skills").alias("p")).withColumn("pname", F.lower("p"))
    found = one_each.join(parent, "pname", "left").groupBy(key, "item", "name", "description").agg(
        F.array_sort(F.collect_set("found_id")).alias("parents")
    )
    return found.select(
        key, "item", "name", "description", "parents",
        F.when(F.size("parents") > 0, "functional").otherwise("atomic").alias("category"),
    )
