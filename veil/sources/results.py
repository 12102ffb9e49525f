"""Result files: CSV sets, JSON documents, checkpoints and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.operators.ordering import earliest
from veil.session import cut_lineage

EVAL_CSV = (
    "anon_setting STRING, id STRING, pii_type STRING, anon_level INT, res_level INT, gt STRING, gt_hardness INT, "
    "gt_certainty INT, pred_1 STRING, pred_2 STRING, pred_3 STRING, certainty INT, self_is_correct INT, is_correct STRING, "
    "utility_readability DOUBLE, utility_meaning DOUBLE, utility_hallucinations DOUBLE, utility_bleu DOUBLE, "
    "utility_rouge DOUBLE"
)

CHECKPOINT = (
    "timestamp STRING, elapsed_time DOUBLE, results STRUCT<config: STRING, samples: ARRAY<STRUCT<username: STRING, "
    "config_name: STRING, final_privacy: DOUBLE, final_utility: DOUBLE, total_rounds: INT, "
    "rounds: ARRAY<STRUCT<round: INT, privacy_score: DOUBLE, utility_score: DOUBLE>>>>>"
)


def read_eval_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Any number of result CSVs as one scan with a declared schema and the file kept as lineage."""
    wanted = paths if isinstance(paths, str) else list(paths)
    return (
        spark.read.schema(EVAL_CSV).csv(wanted, header=True, escape='"').withColumn("file", F.col("_metadata.file_path"))
    )


def write_eval_csv(df: DataFrame, path: str) -> None:
    names = [f.split(" ")[0] for f in EVAL_CSV.split(", ")]
    df.select(*names).write.csv(path, header=True, escape='"')


def file_set(judges: Mapping[str, str], folder: str = "anonymized_results") -> list[str]:
    """Paths of a collection of settings: `judges` names the judge whose scores are wanted for each setting."""
    return [f"{folder}/{setting}/eval_{judge}_out.csv" for setting, judge in judges.items()]


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold a JSON array or JSON lines; unreadable records and missing paths give no rows.

    Lines are read once to tell the two apart: a file whose first character is '[' is one document.
    """
    try:
        lines = spark.read.text(path, recursiveFileLookup=True).select(
            F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
        )
    except Exception as err:  # the path check happens while the plan is resolved
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schema)
    opening = lines.filter((F.col("at") == 0) & F.trim("value").startswith("[")).select("file").distinct()
    # one name per array file: no longer than the file listing the driver already holds
    arrays = [r["file"] for r in opening.collect()]
    bad = "_bad STRING"
    single = spark.read.schema(f"{schema}, {bad}").json(
        path, recursiveFileLookup=True, columnNameOfCorruptRecord="_bad"
    )
    flat = single.filter("_bad IS NULL").drop("_bad")
    if arrays:
        marked = single.select("*", F.col("_metadata.file_path").alias("_file")).filter("_bad IS NULL").drop("_bad")
        flat = marked.join(opening.withColumnRenamed("file", "_file"), "_file", "left_anti").drop("_file")
    if not arrays:
        return flat
    whole = spark.read.schema(f"{schema}, {bad}").json(arrays, multiLine=True, columnNameOfCorruptRecord="_bad")
    return flat.unionByName(whole.filter("_bad IS NULL").drop("_bad"))


def discover(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """Every matching file below a folder; rows without a username are skipped, the first file wins per username."""
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .withColumn("username", F.get_json_object("value", "$.username"))
        .filter("username IS NOT NULL")
    )
    return earliest(lines, ["username"], [F.col("file"), F.col("value")])


def tolerant_json(spark: SparkSession, path: str, schema: str, max_samples: int | None = None) -> DataFrame:
    """Readable records only; if asked, the first `max_samples` of them by file and place in it."""
    read = spark.read.schema(f"{schema}, _bad STRING").json(path, columnNameOfCorruptRecord="_bad")
    placed = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"))
    good = placed.filter("_bad IS NULL").drop("_bad")
    if max_samples:
        good = good.orderBy("_file", "_at", "_seq").limit(max_samples)
    return good.drop("_file", "_at", "_seq")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Samples of run-checkpoint documents."""
    return (
        spark.read.schema(CHECKPOINT).json(path, multiLine=True, recursiveFileLookup=True)
        .select("elapsed_time", "results.config", F.explode("results.samples").alias("s"), F.col("_metadata.file_path").alias("file"))
        .select("file", "elapsed_time", "config", "s.*")
    )


def latest_checkpoint(files: DataFrame, column: str = "file") -> DataFrame:
    """The file whose `checkpoint_N` has the greatest N."""
    n = F.regexp_extract(column, "checkpoint_([0-9]+)", 1).try_cast("int")
    return files.withColumn("n", n).filter("n IS NOT NULL").agg(F.max_by(column, "n").alias(column), F.max("n").alias("n"))


# ---- logs --------------------------------------------------------------------------------------

# Labels of the evaluation log.
PRIVACY, UTILITY, SUCCESS, USER = "隐私:", "效用:", "成功:", "评估用户:"
ATTACK_LABELS = ["攻击者推理:", "attack_result:"]
NUMBER = r"\s*([0-9.]+)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with a total order inside each file: (file, block, seq)."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def score_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Privacy, utility and success of lines that carry both labels; utility must be positive."""
    v = F.col(value)
    return (
        lines.filter(v.contains(PRIVACY) & v.contains(UTILITY))
        .withColumn("privacy", F.regexp_extract(value, PRIVACY + NUMBER, 1).try_cast("double"))
        .withColumn("utility", F.regexp_extract(value, UTILITY + NUMBER, 1).try_cast("double"))
        .withColumn("success", F.regexp_extract(value, SUCCESS + r"\s*(\w+)", 1) == "True")
        .filter("privacy IS NOT NULL AND utility > 0")
    )


def _braces(text: Column) -> Column:
    """(total, low): braces opened less braces closed in a text, and the least of that after any brace; null low without braces."""
    steps = F.transform(
        F.split(F.regexp_replace(text, "[^{}]", ""), ""),
        lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0),
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("low"))
    count = F.aggregate(
        steps, start,
        lambda a, x: F.struct((a["total"] + x).alias("total"), F.least(a["low"], a["total"] + x).alias("low")),
    )
    return F.when(text.rlike("[{}]"), count).otherwise(start)


def _until_closed(text: Column, depth: Column) -> Column:
    """The text up to the brace at which `depth` open braces and its own are closed."""
    pieces = F.split(text, r"(?<=[{}])")
    start = F.struct(depth.cast("long").alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        now = a["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        done = a["done"] | (piece.endswith("}") & (now <= 0))
        return F.struct(
            now.alias("depth"),
            F.when(a["done"], a["length"]).otherwise(a["length"] + F.char_length(piece)).alias("length"),
            done.alias("done"),
        )

    return F.substring(text, F.lit(1), F.aggregate(pieces, start, step)["length"])


def _placed_lines(lines: DataFrame) -> DataFrame:
    """Each line with its record, its segment, and how far the JSON text that the segment opens is open before and after it.

    A header line opens a record; a header, or an attack line with a brace, opens a segment. Counts run inside a split; one
    row per split carries records, segments and open braces on to the next split of its file, so no task sees more of
    a file than one split, and a JSON text may span splits.
    """
    value = F.col("value")
    head = value.contains(USER)
    score = ~head & value.contains(PRIVACY) & value.contains(UTILITY)
    attack = F.lit(False)
    for label in ATTACK_LABELS:
        attack = attack | value.contains(label)
    opens = ~head & ~score & attack & value.contains("{")
    text = F.when(opens, F.expr("substring(value, instr(value, '{'))")).when(~head & ~score, value)
    marked = (
        lines.select("file", "block", "seq", "value").withColumn("head", head).withColumn("score", score).withColumn("opens", opens)
        .withColumn("marker", head | opens).withColumn("braces", F.coalesce(_braces(text), _braces(F.lit(""))))
    )
    split = Window.partitionBy("file", "block").orderBy("seq")
    through, before = split.rowsBetween(Window.unboundedPreceding, 0), split.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        marked.withColumn("h", F.sum(F.col("head").cast("int")).over(through))
        .withColumn("m", F.sum(F.col("marker").cast("int")).over(through))
        .withColumn("open", F.coalesce(F.sum("braces.total").over(before), F.lit(0)))
        .withColumn("low", F.col("open") + F.col("braces.low"))
        .withColumn("start", F.when(F.col("marker"), F.struct("opens", "open")))
    )
    # the least of the segment so far is that of the greatest segment number, so one sort serves all windows
    least = F.min(F.when(F.col("low").isNotNull(), F.struct((-F.col("m")).alias("m"), "low"))).over(before)
    marked = marked.withColumn("least", least).withColumn("start", F.last("start", ignorenulls=True).over(through)).select(
        "file", "block", "seq", "value", "head", "score", "opens", "h", "m", "open", "low", "start", F.col("braces.total").alias("total"),
        F.when(F.col("least.m") == -F.col("m"), F.col("least.low")).alias("lowest"),
    )
    marked = cut_lineage(marked, "log-lines")  # sorted once; what follows reads it without a sort
    splits = (
        marked.groupBy("file", "block", "m")
        .agg(F.sum(F.col("head").cast("int")).alias("h"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("start").alias("start"))
        .groupBy("file", "block")
        .agg(F.sum("h").alias("h"), F.max("m").alias("m"), F.sum("total").alias("total"), F.max_by("low", "m").alias("low"), F.max_by("start", "m").alias("start"))
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("h", "m", "total")]
    splits = splits.select("*", *sums).withColumn("end", F.col("m0") + F.col("m"))
    # lines of a split before its first marker belong to the segment that the splits before it left open
    same = Window.partitionBy("file", "end").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    shifted = F.struct(F.col("start.opens").alias("opens"), (F.col("start.open") + F.col("total0")).alias("open"))
    splits = splits.withColumn("reached", F.min(F.col("low") + F.col("total0")).over(same)).select(
        "file", "block", "h0", "m0", "total0",
        F.lag("reached").over(Window.partitionBy("file").orderBy("block")).alias("low0"),
        F.last(F.when(F.col("m") > 0, shifted), ignorenulls=True).over(earlier).alias("start0"),
    )
    text = F.when(F.col("opens"), F.expr("substring(value, instr(value, '{'))")).when(~F.col("head") & ~F.col("score"), value)
    placed = marked.withColumn("text", text).join(splits, ["file", "block"])
    first = F.col("m") == 0
    base = F.when(first, F.col("start0.open")).otherwise(F.col("start.open") + F.col("total0"))
    lowest = F.least(F.when(first, F.col("low0")), F.col("lowest") + F.col("total0"))
    return placed.select(
        "file", "value", "head", "score", "text", F.struct("block", "seq").alias("at"),
        (F.col("h") + F.col("h0")).alias("record"), (F.col("m") + F.col("m0")).alias("segment"),
        F.coalesce(F.when(first, F.col("start0.opens")).otherwise(F.col("start.opens")), F.lit(False)).alias("json"),
        (F.col("open") + F.col("total0") - base).alias("depth"),
        F.coalesce(lowest <= base, F.lit(False)).alias("closed"),
        F.coalesce(F.col("low") + F.col("total0") <= base, F.lit(False)).alias("closes"),
    )


def log_records(lines: DataFrame) -> DataFrame:
    """A header line opens a record, later lines of the file fill it; the last of each kind counts.

    `lines` has (file, block, seq, value), as `read_log` gives them: files may be cut into splits anywhere. A JSON text begins at
    the first brace of an attack line and ends where its braces balance, on that line or a later one; score lines in between
    aren't part of it. One that another attack line or a header interrupts, or that isn't JSON, is ignored.
    Lines before the first header belong to no record. A null line is an empty one.
    """
    placed = _placed_lines(lines.withColumn("value", F.coalesce("value", F.lit("")))).filter("record > 0")
    texts = placed.filter("json AND NOT closed AND text IS NOT NULL").select(
        "file", "record", "segment", "at", "closes",
        F.when(F.col("closes"), _until_closed(F.col("text"), F.col("depth"))).otherwise(F.col("text")).alias("text"),
    )
    # only texts that close are put together
    whole = texts.join(texts.filter("closes").select("file", "segment"), ["file", "segment"], "left_semi")
    json = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    attacks = (
        whole.groupBy("file", "record", "segment").agg(json.alias("json"))
        .withColumn("attack", F.from_json("json", "MAP<STRING, STRUCT<guess: ARRAY<STRING>, certainty: INT>>"))
        .filter("attack IS NOT NULL")
        .groupBy("file", "record").agg(F.max_by("attack", "segment").alias("attack"))
    )
    # each record has its header; other lines have nothing for it
    number = lambda label: F.when(F.col("score"), F.regexp_extract("value", label + NUMBER, 1).try_cast("double"))
    told = placed.filter("head OR score").select(
        "file", "record", "at", F.when(F.col("head"), F.regexp_extract("value", USER + r"\s*(\w+)", 1)).alias("username"),
        number(PRIVACY).alias("privacy"), number(UTILITY).alias("utility"),
    )
    records = told.groupBy("file", "record").agg(
        F.max("username").alias("username"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("privacy", "utility")],
    )
    return records.join(attacks, ["file", "record"], "left").select(
        "file", "record",
        F.when(F.col("username") == "", "unknown").otherwise(F.col("username")).alias("username"),
        F.coalesce("privacy", F.lit(0.0)).alias("privacy"),
        F.coalesce("utility", F.lit(0.8)).alias("utility"),
        "attack",
    )


def recent_statistics(scores: DataFrame, order: str, n: int = 10) -> DataFrame:
    """Means and pass rates of the last n score lines."""
    recent = scores.orderBy(F.desc(order)).limit(n)
    return recent.agg(
        F.count(F.lit(1)).alias("lines"),
        F.round(F.avg("privacy"), 6).alias("avg_privacy"),
        F.round(F.avg("utility"), 6).alias("avg_utility"),
        F.round(F.avg((F.col("privacy") >= 0.8).cast("double")) * 100, 6).alias("privacy_success_rate"),
        F.round(F.avg((F.col("utility") >= 0.6).cast("double")) * 100, 6).alias("utility_success_rate"),
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(pii_type, raw, canonical) of mapping documents {attribute: {raw: canonical}}; unreadable ones give no rows."""
    doc = F.from_json("value", "MAP<STRING, MAP<STRING, STRING>>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(doc).alias("pii_type", "m"))
        .select("pii_type", F.explode("m").alias("raw", "canonical"))
    )


def write_statistics(df: DataFrame, path: str) -> None:
    """A one-row frame as a JSON document."""
    df.coalesce(1).write.json(path)
