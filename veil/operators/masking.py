"""Entity detection, masking and splicing over tables of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import entities as N
from veil.functions.scan import all_spans, disjoint_spans, pieces
from veil.operators.ordering import top_k

# Categories of a recogniser's entities that are removed; quantities only of these kinds.
REMOVED_CATEGORIES = [
    "Person", "PersonType", "Location", "Organization", "Event", "Address", "PhoneNumber", "Email", "URL", "IP",
    "DateTime",
]
REMOVED_QUANTITIES = ["Age", "Currency", "Number"]


def with_spans(df: DataFrame, text: str, out: str = "spans", keep_overlaps: bool = False) -> DataFrame:
    """Add the entity spans of a text column, by start; each text is scanned once. A null text has null spans."""
    return df.withColumn(out, (all_spans if keep_overlaps else disjoint_spans)(F.col(text)))


def span_rows(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per span. The outer form plus a filter keeps the optimizer from inferring `size(spans) > 0`
    and evaluating the whole detection a second time below the projection."""
    return df.select(*keys, F.explode_outer(spans).alias("s")).filter(F.col("s").isNotNull()).select(*keys, "s.*")


def anonymise(df: DataFrame, text: str, mode: str = "*", out: str = "masked") -> DataFrame:
    """Mask ('*', 'entity') or generalise ('model', 'generalize') every detected span."""
    label = N.general_label if mode in ("model", "generalize") else N.mask_label(mode)
    scanned = df.withColumn("_scan", pieces(F.col(text)))
    return scanned.withColumn(out, N.joined(F.col("_scan.pieces"), F.col("_scan.tail"), label)).drop("_scan")


def as_new_version(comments: DataFrame, mode: str = "*") -> DataFrame:
    """Comments with one more version: the original (version 0) text, masked."""
    last = comments.groupBy("username").agg((F.max("version") + 1).alias("_next"))
    fresh = anonymise(comments.filter("version = 0"), "text", mode)
    fresh = fresh.join(last, "username").select(
        *[
            F.col("masked").alias("text") if c == "text" else F.col("_next").alias("version") if c == "version" else F.col(c)
            for c in comments.columns
        ]
    )
    return comments.unionByName(fresh)


def removable(entities: DataFrame, threshold: float) -> DataFrame:
    """Entities of a removed category at or above the confidence threshold."""
    listed = F.col("category").isin(REMOVED_CATEGORIES) | (
        (F.col("category") == "Quantity") & F.col("subcategory").isin(REMOVED_QUANTITIES)
    )
    return entities.filter(listed & (F.col("confidence") >= threshold))


def entity_replacement(use_labels: bool) -> Column:
    """`<SUBCATEGORY>` or `<CATEGORY>`, else one asterisk per character."""
    if use_labels:
        name = F.when(F.coalesce("subcategory", F.lit("")) != "", F.col("subcategory")).otherwise(F.col("category"))
        return F.concat(F.lit("<"), F.upper(name), F.lit(">"))
    return F.repeat(F.lit("*"), F.col("end") - F.col("start"))


def splice(texts: DataFrame, entities: DataFrame, key: str, text: str, out: str = "spliced") -> DataFrame:
    """Replace (start, end, replacement) rows in their texts; spans of one text must not overlap."""
    point = F.struct("start", "end", "replacement")
    spans = entities.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("_spans"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    return (
        texts.join(spans, key, "left")
        .withColumn("_spans", F.coalesce("_spans", none))
        .withColumn(out, N.rebuild(F.col(text), F.col("_spans"), lambda s: s["replacement"]))
        .drop("_spans")
    )


def top_entities(entities: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k most frequent entity strings per key joined with ';'; counted before they are ranked."""
    counts = entities.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(counts, keys, [F.desc("n"), F.asc("text")], k)
    return best.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text), ";").alias("answer")
    )
