"""Normalising evaluation rows and the privacy/utility reports over them.

(setting, id, attribute, level) identifies an evaluation row, so anything grouped by
(setting, id, attribute) holds one row per anonymisation level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.numbers import exact_mean
from veil.operators.ordering import lookup

# Display codes of the attributes.
ATTRIBUTE_CODES = {
    "gender": "SEX", "age": "AGE", "location": "LOC", "occupation": "OCCP",
    "married": "REL", "income": "INC", "education": "EDU", "pobp": "POBP",
}

# Display names of the anonymisation settings.
SETTING_NAMES = {
    "azure_full": "Azure", "azure": "Azure", "azure_entity": "Azure-Entity", "presidio": "Presidio",
    "gpt4_turbo_full": "GPT-4-AA", "gpt35_full": "GPT-3.5-AA", "yi_full": "Yi-34B-AA",
    "span_gpt4_turbo_full": "GPT-4-Span", "span_gpt4_turbo_full_old": "GPT-4-Span",
    "span_yao_full": "Dou-SD", "mixtral": "Mixtral", "gpt4_turbo_base": "GPT-4-Base",
    "gpt35_turbo_base": "GPT-3.5-Base", "yi_full_base": "Yi-34B-Base",
    "gpt4_turbo_p1": "GPT-4-AA-Prompt-1", "gpt4_turbo_p2": "GPT-4-AA-Prompt-2",
    "llama31-8b": "Llama3.1-8B-AA", "llama31-70b": "Llama3.1-70B-AA",
    "mistral-7B": "Mistral-7B-AA", "mistral-7b": "Mistral-7B-AA",
    "mixtral-8x7B": "Mixtral-8x7B-AA", "mixtral-8x22B": "Mixtral-8x22B-AA",
    "qwen15-4B": "Qwen1.5-4B-AA", "qwen15-14B": "Qwen1.5-14B-AA", "qwen15-32B": "Qwen1.5-32B-AA",
    "qwen15-72B": "Qwen1.5-72B-AA", "qwen2-72B": "Qwen2-72B-AA", "gemma2-27B": "Gemma2-27B-AA",
    "dipper": "Dipper", "inference_ablation_claude_opus": "Claude-3-Opus",
    "inference_ablation_llama31-70b": "Llama3.1-70B", "inference_ablation_llama31-8b": "Llama3.1-8B",
    "inference_ablation_gpt35_full": "GPT-3.5",
}

# Attributes of the "fair" selection, columns of the small result table.
FAIR_ATTRIBUTES = ["LOC", "AGE", "OCCP", "POBP"]
TABLE_ATTRIBUTES = ["SEX", "OCCP", "REL", "LOC", "AGE", "POBP", "EDU", "INC"]

UTILITY_COLUMNS = [
    "utility_bleu", "utility_rouge", "utility_readability", "utility_meaning", "utility_comb", "utility_model",
]


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


def correctness_vector(text: Column) -> Column:
    """'[1, 0]' -> [1, 0, 0]; anything empty or unreadable -> zeros."""
    parsed = F.coalesce(F.from_json(text, "array<int>"), F.array().cast("array<int>"))
    return F.concat(parsed, F.array_repeat(F.lit(0), F.greatest(F.lit(3) - F.size(parsed), F.lit(0))))


def setting_label(method: Column, level: Column) -> Column:
    """Setting code and level -> display name, e.g. gpt4_turbo_full and 2 -> 'GPT-4-AA 2'."""
    real = method.contains("real")
    stem = F.when(real, F.regexp_replace(method, "_[^_]*$", "")).otherwise(method)
    return F.concat(
        F.coalesce(lookup(SETTING_NAMES, stem), stem),
        F.when(real, F.lit("-Real")).otherwise(F.lit("")),
        F.lit(" "),
        level.cast("string"),
    )


def label_of_code(code: Column) -> Column:
    """Same for a joined code such as 'mistral-7b-3': the part after the last dash is the level."""
    return setting_label(F.regexp_extract(code, "^(.*)-([^-]*)$", 1), F.regexp_extract(code, "^(.*)-([^-]*)$", 2))


def family(setting: Column) -> Column:
    return F.substring_index(setting, " ", 1)


def with_utilities(df: DataFrame) -> DataFrame:
    r, m = clip(F.col("utility_readability"), 0, 10) / 10, clip(F.col("utility_meaning"), 0, 10) / 10
    return (
        df.withColumn("utility_bleu", clip(F.col("utility_bleu"), 0, 1))
        .withColumn("utility_rouge", clip(F.col("utility_rouge"), 0, 1))
        .withColumn("utility_comb", (r + m + F.col("utility_rouge")) / 3)
        .withColumn("utility_model", (r + m) / 2)
    )


def base_setting(df: DataFrame) -> DataFrame:
    """One row: the level-0 setting with most first guesses right; the lowest name wins a tie."""
    return (
        df.filter(F.col("anon_level") == 0)
        .groupBy("full_anon_setting")
        .agg(F.sum(F.col("correct")[0]).alias("hits"))
        .orderBy(F.desc("hits"), "full_anon_setting")
        .limit(1)
    )


def normalise(df: DataFrame) -> DataFrame:
    """Labels, utilities, correctness vector, a single Base setting and attribute codes."""
    labelled = with_utilities(
        df.withColumn("correct", correctness_vector(F.col("is_correct")))
        .withColumn("pii_res", F.concat_ws("-", "pii_type", F.col("res_level").cast("string")))
        .withColumn("full_anon_setting", setting_label(F.col("anon_setting"), F.col("anon_level")))
    )
    base = base_setting(labelled).select("full_anon_setting").scalar()
    is_base = F.col("full_anon_setting") == base
    return (
        labelled.withColumn("_base", is_base)
        .filter(F.col("_base") | (F.col("anon_level") != 0))
        .withColumn(
            "full_anon_setting",
            F.when(F.col("_base"), F.lit("Base")).otherwise(
                F.regexp_replace("full_anon_setting", "^Yao-SD( [123])?$", "Dou-SD$1")
            ),
        )
        .withColumn("pii_type", lookup(ATTRIBUTE_CODES, F.col("pii_type")))
        .drop("_base")
    )


def mark_first_correct(df: DataFrame) -> DataFrame:
    """First guess right or not; certainty counts only where it is right."""
    hit = F.col("correct")[0] == 1
    return df.withColumn("first_correct", hit).withColumn(
        "certainty", F.when(hit, F.col("certainty").cast("double")).otherwise(F.lit(0.0))
    )


def backfill_utility(df: DataFrame, donor: str = "gpt4_turbo_full") -> DataFrame:
    """Rows without BLEU take the utilities of the donor setting at the same (id, attribute, level)."""
    keys = ["id", "pii_type", "anon_level"]
    source = (
        df.filter(F.col("anon_setting") == donor)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("donors"), F.min(F.struct(*UTILITY_COLUMNS)).alias("donor"))
    )
    empty = df.filter(F.col("utility_bleu") == 0.0).join(source, keys, "left")
    one = F.coalesce(F.col("donors"), F.lit(0)) == 1
    filled = empty.select(
        *[c for c in df.columns if c not in UTILITY_COLUMNS],
        *[F.when(one, F.col("donor")[c]).otherwise(F.col(c)).alias(c) for c in UTILITY_COLUMNS],
        F.when(one, "filled").otherwise("unresolved").alias("utility_source"),
    )
    kept = df.filter(F.coalesce(F.col("utility_bleu") != 0.0, F.lit(True))).withColumn(
        "utility_source", F.lit("own")
    )
    return kept.unionByName(filled)


# Settings left out or kept by the named selections.
NO_BASE = [
    "Yi-34B-Base", "GPT-4-Base", "GPT-3.5-Base", "Yi-34B-Base-Real", "GPT-4-Base-Real", "GPT-3.5-Base-Real",
]
MAIN_BASE_ABLATION = ["GPT-4-AA", "GPT-4-Base"]
SPAN_SETTINGS = ["Dou-SD", "GPT-4-Span", "Dou-SD-Real", "GPT-4-Span-Real"]


def select_settings(df: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Named selections compose; with none of them the list names full settings."""
    fam, found, out = family(F.col("full_anon_setting")), False, df
    if "no-base" in settings:
        out, found = out.filter(~fam.isin(NO_BASE)), True
    if "main_base_ablation" in settings:
        out, found = out.filter(fam.isin(MAIN_BASE_ABLATION)), True
    if "base_ablation" in settings:
        out, found = out.filter(~fam.isin(SPAN_SETTINGS)), True
    if "all" in settings:
        found = True
    caps = [int(s.split("=")[1]) for s in settings if s.startswith("iter=")]
    if caps:
        out, found = out.filter(F.col("anon_level") <= max(caps)), True
    return out if found else out.filter(F.col("full_anon_setting").isin(list(settings)))


def select_attributes(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    wanted = list(attributes)
    if wanted == ["all"]:
        return df
    return df.filter(F.col("pii_type").isin(FAIR_ATTRIBUTES if wanted == ["fair"] else wanted))


def privacy_utility(df: DataFrame, utility: str = "utility_comb") -> DataFrame:
    """Mean utility, accuracy and certainty per setting in one pass over the rows."""
    per_setting = df.groupBy("full_anon_setting").agg(
        exact_mean(utility).alias("utility"),
        F.sum(F.col("first_correct").cast("long")).alias("correct_sum"),
        F.count(F.lit(1)).alias("rows"),
        F.avg("certainty").alias("certainty"),
    )
    # one row per setting by now, so the whole-table window is tiny
    whole = Window.partitionBy(F.lit(0))
    num_pred = F.sum("rows").over(whole) / F.count(F.lit(1)).over(whole)
    return per_setting.select(
        "full_anon_setting",
        family(F.col("full_anon_setting")).alias("model_family"),
        "utility",
        F.round(F.col("correct_sum") / num_pred, 6).alias("correctness"),
        F.round("certainty", 6).alias("certainty"),
        "rows",
    )


def correct_counts(df: DataFrame) -> DataFrame:
    """Right first guesses along every reported axis in one pass."""
    a, f, p, l = "full_anon_setting", "model_family", "pii_type", "anon_level"
    sets = [[f, l], [f, l, p], [p, f, l], [p, a], [p], [a]]
    unique = [s for i, s in enumerate(sets) if sorted(s) not in [sorted(x) for x in sets[:i]]]
    return (
        df.withColumn(f, family(F.col(a)))
        .groupingSets([[F.col(c) for c in s] for s in unique], F.col(a), F.col(f), F.col(p), F.col(l))
        .agg(F.sum(F.col("first_correct").cast("long")).alias("correct"))
        .filter(F.col("correct") > 0)
    )


def location_resolution(df: DataFrame, families: Sequence[str] = ("GPT-4-AA", "Azure")) -> DataFrame:
    """Right location guesses per resolution level, relative to the number of Base rows of that level; one pass."""
    level = F.when(F.col("res_level") == 1, 2).otherwise(F.col("res_level")) - 1
    per = (
        df.filter(F.col("pii_type") == "LOC").withColumn("res_level", level)
        .groupBy("full_anon_setting", "res_level")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("first_correct").cast("long")).alias("correct"))
    )
    # one row per setting and level by now
    is_base = F.col("full_anon_setting") == "Base"
    of_level = Window.partitionBy("res_level")
    fam = family(F.col("full_anon_setting"))
    step = F.when(is_base, 0).otherwise(F.substring_index("full_anon_setting", " ", -1).try_cast("int"))
    return (
        per.withColumn("total", F.sum(F.when(is_base, F.col("rows"))).over(of_level))
        .withColumn("base_hits", F.sum(F.when(is_base, F.col("correct"))).over(of_level))
        .filter((F.col("base_hits") > 0) & (F.col("correct") > 0) & fam.isin(list(families)) & (step <= 3))
        .select(
            "full_anon_setting",
            fam.alias("model_family"),
            (F.lit(3) - F.col("res_level")).alias("res_level"),
            "correct",
            "total",
            F.round(F.col("correct") / F.col("total"), 6).alias("normalised"),
        )
    )


def accuracy_and_certainty(df: DataFrame, families: Sequence[str] = ("GPT-4-AA", "Azure")) -> DataFrame:
    """Long rows (setting, metric, value); a missing certainty counts as the mean of the present ones; one pass."""
    c = F.col("certainty")
    per = df.groupBy("full_anon_setting").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("first_correct").cast("long")).alias("n"),
        F.sum(F.when(c != 0, c)).alias("given"), F.count_if(c != 0).alias("with_c"), F.count_if(c == 0).alias("without_c"),
    )
    # one row per setting by now
    whole = Window.partitionBy(F.lit(0))
    chosen = family(F.col("full_anon_setting")).isin(list(families))
    only = lambda x: F.sum(F.when(chosen, x)).over(whole)
    mean = only(F.col("given")) / F.nullif(only(F.col("with_c")), F.lit(0))
    filled = F.coalesce("given", F.lit(0.0)) + F.when(F.col("without_c") > 0, F.col("without_c") * F.col("mean")).otherwise(0.0)
    wide = (
        per.withColumn("mean", mean)
        .withColumn("num_pred", F.sum("rows").over(whole) / F.count(F.lit(1)).over(whole))
        .filter(chosen)
        .select(
            "full_anon_setting",
            F.round(F.col("n") / F.col("num_pred"), 6).alias("accuracy"),
            F.round((filled / F.nullif(F.col("with_c") + F.col("without_c"), F.lit(0)) - 1) * 0.25, 6).alias("certainty"),
        )
    )
    return wide.unpivot("full_anon_setting", ["accuracy", "certainty"], "metric", "value")


def guess_paths(df: DataFrame) -> DataFrame:
    """(anon_setting, id, pii_type, path, tick, prev): the levels of each in one small sorted array.

    `tick` is the first level guessed right after a wrong guess at an earlier level other than the first, `prev` the
    level before it; both are null where that never happens.
    """
    point = F.struct(
        F.col("anon_level").alias("level"),
        F.col("first_correct").alias("hit"),
        (F.aggregate("correct", F.lit(0), lambda a, x: a + x) > 0).alias("any_hit"),
        F.col("certainty").alias("certainty"),
    )
    gathered = (
        df.filter(~F.col("anon_setting").contains("real"))
        .groupBy("anon_setting", "id", "pii_type")
        .agg(F.array_sort(F.collect_list(point)).alias("path"))
    )
    later = F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))
    wrong = F.array_min(F.transform(F.filter("later", lambda p: ~p.hit), lambda p: p.level))
    return (
        gathered.withColumn("later", later)
        .withColumn("wrong", wrong)
        .withColumn("tick", F.try_element_at(F.filter("later", lambda p: p.hit & (p.level > F.col("wrong"))), F.lit(1)))
        .withColumn("prev", F.try_element_at(F.filter("path", lambda p: p.level < F.col("tick.level")), F.lit(-1)))
        .drop("later", "wrong")
    )


def reidentified(df: DataFrame) -> DataFrame:
    """First level guessed right after a wrong guess at an earlier level other than the first."""
    return guess_paths(df).filter("tick IS NOT NULL").select(
        "anon_setting", "id", "pii_type",
        F.col("tick.level").alias("anon_level"),
        F.col("tick.certainty").alias("certainty"),
        F.col("prev.any_hit").alias("prev_any_correct"),
    )


def switch_statistics(df: DataFrame) -> DataFrame:
    """Per (attribute, level): right guesses, certainties and re-identifications, all from one gathering of the rows."""
    keys = ["pii_type", "anon_level"]
    own = F.struct(F.col("p.level").alias("level"), F.col("p.hit").alias("hit"), F.col("p.certainty").alias("certainty"), F.lit(False).alias("tick"), F.lit(False).alias("prev"))
    back = F.struct(F.col("tick.level").alias("level"), F.lit(False).alias("hit"), F.col("tick.certainty").alias("certainty"), F.lit(True).alias("tick"), F.col("prev.any_hit").alias("prev"))
    points = (
        guess_paths(df).select("pii_type", "tick", "prev", F.posexplode("path").alias("at", "p"))
        .select("pii_type", F.explode(F.when((F.col("at") == 0) & F.col("tick").isNotNull(), F.array(own, back)).otherwise(F.array(own))).alias("x"))
        .select("pii_type", F.col("x.level").alias("anon_level"), "x.hit", "x.certainty", "x.tick", "x.prev")
    )
    plain = lambda c: F.when(~F.col("tick"), c)
    ticks = lambda c: F.when(F.col("tick"), c)
    return points.groupBy(*keys).agg(
        F.sum(plain(F.col("hit").cast("long"))).alias("num_correct"),
        F.round(F.avg(plain(F.col("certainty"))), 6).alias("certainty_avg"),
        F.round(F.avg(plain(F.when(F.col("hit"), F.col("certainty")))), 6).alias("certainty_correct"),
        F.count_if("tick").alias("num_correct_not_prev"),
        F.round(F.coalesce(F.avg(ticks(F.col("certainty"))), F.lit(0.0)), 6).alias("certainty_correct_not_prev"),
        F.coalesce(F.sum(ticks(F.col("prev").cast("long"))), F.lit(0)).alias("prev_has_any_correct"),
    )


def first_wrong_level(df: DataFrame) -> DataFrame:
    """Lowest level guessed wrong per (setting, id, attribute); 1 if none; settings with > 2 levels only; one pass."""
    per_type = df.groupBy("anon_setting", "id", "pii_type").agg(
        F.coalesce(F.min(F.when(F.col("correct")[0] != 1, F.col("anon_level"))), F.lit(1)).alias("first_wrong"),
        F.collect_set("anon_level").alias("levels"),  # a handful of levels
    )
    # a profile has a handful of attributes
    seen = F.size(F.array_distinct(F.flatten(F.collect_list("levels").over(Window.partitionBy("anon_setting", "id")))))
    return per_type.withColumn("seen", seen).filter("seen > 2").drop("levels", "seen")


def attribute_counts(df: DataFrame) -> DataFrame:
    """Mean number of rows per setting for each attribute; one pass."""
    per = df.groupBy("pii_type", "full_anon_setting").agg(F.count("id").alias("n"))
    # one row per attribute and setting by now
    settings = F.size(F.collect_set("full_anon_setting").over(Window.partitionBy(F.lit(0))))
    return (
        per.withColumn("settings", settings)
        .groupBy("pii_type")
        .agg(F.round(F.sum("n") / F.max("settings"), 6).alias("count"))
        .orderBy(F.desc("count"), "pii_type")
    )


def setting_attribute_table(df: DataFrame) -> DataFrame:
    return df.groupBy("full_anon_setting", "pii_type").agg(
        exact_mean("utility_comb").alias("utility"),
        F.round(F.avg(F.col("first_correct").cast("double")), 6).alias("correctness"),
        F.count(F.lit(1)).alias("rows"),
    )


def utility_grid(df: DataFrame) -> DataFrame:
    """Settings by attributes, mean combined utility; the pivot values are fixed so no extra pass is needed."""
    wide = df.groupBy("full_anon_setting").pivot("pii_type", TABLE_ATTRIBUTES).agg(exact_mean("utility_comb"))
    return wide.select("full_anon_setting", *TABLE_ATTRIBUTES)


def markdown_table(df: DataFrame) -> DataFrame:
    """Each row of a small table as a Markdown line."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def frontier_steps(points: DataFrame) -> DataFrame:
    """Move of each family from one level to the next in the (correctness, utility) plane."""
    w = Window.partitionBy("model_family").orderBy("step")
    return (
        points.filter(F.col("full_anon_setting") != "Base")
        .withColumn("step", F.substring_index("full_anon_setting", " ", -1).cast("int"))
        .withColumn("dx", F.round(F.lead("correctness").over(w) - F.col("correctness"), 6))
        .withColumn("dy", F.round(F.lead("utility").over(w) - F.col("utility"), 6))
        .filter(F.col("dx").isNotNull())
        .select("model_family", "step", "dx", "dy")
    )


def level_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean utilities and accuracy over any keys."""
    return df.groupBy(*keys).agg(
        *[exact_mean(c).alias(c) for c in ("utility_bleu", "utility_rouge", "utility_comb", "utility_model")],
        F.sum(F.col("first_correct").cast("long")).alias("correct"),
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.col("first_correct").cast("double")), 6).alias("accuracy"),
    )


def round_summary(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """Round 0 from raw inferences (truth inside the first guess, utility 1), later rounds from scored rows."""
    hit = F.lower(F.element_at(F.split("guess", ";"), 1)).contains(F.lower("estimate"))
    start = raw.agg(
        F.lit(0).alias("round"),
        F.round(F.avg(hit.cast("double")), 6).alias("accuracy"),
        F.lit(1.0).alias("bleu"),
        F.lit(1.0).alias("rouge"),
        F.count(F.lit(1)).alias("rows"),
    )
    later = (
        scored.filter(F.col("anon_level") > 0)
        .groupBy(F.col("anon_level").alias("round"))
        .agg(
            F.round(F.avg(F.col("first_correct").cast("double")), 6).alias("accuracy"),
            exact_mean("utility_bleu").alias("bleu"),
            exact_mean("utility_rouge").alias("rouge"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    return start.unionByName(later)


def best_rounds(summary: DataFrame) -> DataFrame:
    """Rounds of least accuracy, most BLEU and best product; ties go to the earliest round."""
    product = F.col("bleu") * (F.lit(1.0) - F.col("accuracy"))
    early = -F.col("round")
    return summary.agg(
        F.min_by("round", F.struct("accuracy", "round")).alias("least_accuracy"),
        F.max_by("round", F.struct(F.col("bleu"), early)).alias("most_bleu"),
        F.max_by("round", F.struct(product, early)).alias("best_trade"),
    )
