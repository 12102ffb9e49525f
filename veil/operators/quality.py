"""BLEU and ROUGE of text pairs.

A pair is one row, so its n-grams are counted where the row is: no shuffle. A pair with a null text has no score and no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.overlap import ngram_matches, spaced, subsequence_counts, summary_lcs, words
from veil.functions.quality import brevity_penalty, set_bleu_of, set_rouge_of, tokens
from veil.session import small_batches

MAX_N = 4


def _whole_pairs(pairs: DataFrame, original: Column, adapted: Column) -> DataFrame:
    """Pairs with both texts; Python sees them in small batches."""
    return small_batches(pairs).filter(original.isNotNull() & adapted.isNotNull())


def ngram_overlap(pairs: DataFrame, key: str, original: Column, adapted: Column, split, max_n: int = MAX_N) -> DataFrame:
    """(key, m1 .. m<max_n>, ref, hyp): clipped matches per order, and the tokens of both texts."""
    # texts are tested, not the counts: a filter on these would have Python count twice
    counted = _whole_pairs(pairs, original, adapted).select(key, ngram_matches(original, adapted, split, max_n).alias("_c"))
    names = [*(f"m{n}" for n in range(1, max_n + 1)), "ref", "hyp"]
    return counted.select(key, *[F.col("_c")[i].cast("long").alias(name) for i, name in enumerate(names)])


def bleu_of(matches: Sequence[Column], ref: Column, hyp: Column) -> Column:
    """BLEU from the clipped matches of orders 1, 2 ... and both lengths.

    Orders without a match are smoothed by 1 / (2^k * 5 / ln(hypothesis length)), k counting such
    orders; nothing in common at order 1 gives 0, and so does a hypothesis of one token with a gap.
    """
    log_sum, zeros = F.lit(0.0), F.lit(0)
    for n, hit in enumerate(matches, 1):
        total = F.greatest(hyp - n + 1, F.lit(1))
        zeros = zeros + F.when(hit == 0, 1).otherwise(0)
        smooth = F.ln(F.ln(hyp) / (F.pow(F.lit(2.0), zeros) * 5.0)) - F.ln(total)
        log_sum = log_sum + F.when(hit > 0, F.ln(hit / total)).otherwise(smooth)
    value = brevity_penalty(ref, hyp) * F.exp(log_sum / len(matches))
    return F.when((matches[0] == 0) | ((matches[-1] == 0) & (hyp <= 1)), 0.0).otherwise(value)


def sentence_bleu(pairs: DataFrame, key: str, original: str, adapted: str) -> DataFrame:
    """BLEU-4 per pair on single-space tokens."""
    wide = ngram_overlap(pairs, key, F.col(original), F.col(adapted), spaced)
    matches = [F.col(f"m{n}") for n in range(1, MAX_N + 1)]
    return wide.select(
        key, bleu_of(matches, F.col("ref"), F.col("hyp")).alias("bleu"), F.col("ref").alias("ref_len"), F.col("hyp").alias("hyp_len")
    )


def _rates(matched: Column, ref: Column, hyp: Column, name: str) -> list[Column]:
    p = F.coalesce(matched / F.nullif(hyp, F.lit(0)), F.lit(0.0))
    r = F.coalesce(matched / F.nullif(ref, F.lit(0)), F.lit(0.0))
    return [
        p.alias(f"{name}_p"),
        r.alias(f"{name}_r"),
        F.coalesce(F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias(f"{name}_f"),
    ]


def rouge_tokens(text: Column) -> Column:
    """Lower-case ASCII letters and digits; everything else separates. Words are not stemmed."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def rouge_1(pairs: DataFrame, key: str, original: str, adapted: str) -> DataFrame:
    """Common words; pairs of texts without words have no row."""
    overlap = ngram_overlap(pairs, key, F.lower(original), F.lower(adapted), words, 1).filter("ref + hyp > 0")
    return overlap.select(key, *_rates(F.col("m1"), F.col("ref"), F.col("hyp"), "rouge1"))


def rouge_l(pairs: DataFrame, key: str, original: str, adapted: str) -> DataFrame:
    """Longest common subsequence of the tokens; no shuffle at all."""
    a, b = F.lower(original), F.lower(adapted)
    counted = _whole_pairs(pairs, a, b).select(key, subsequence_counts(a, b).alias("_c"))
    lcs, n, m = (F.col("_c")[i] for i in range(3))
    return counted.select(key, lcs.alias("lcs"), *_rates(lcs, n, m, "rougeL"))


def rouge_lsum(pairs: DataFrame, key: str, original: str, adapted: str) -> DataFrame:
    """Summary-level LCS: lines are sentences, and each line of the original is matched with all lines of the adapted text."""
    a, b = F.lower(original), F.lower(adapted)
    counted = _whole_pairs(pairs, a, b).select(key, summary_lcs(a, b).alias("_c"))
    hits, n, m = (F.col("_c")[i] for i in range(3))
    return counted.select(key, hits.alias("hits"), *_rates(hits, n, m, "rougeLsum"))


def text_scores(pairs: DataFrame, key: str, original: str, adapted: str) -> DataFrame:
    """BLEU-4 and the F measures of ROUGE-1, ROUGE-L and ROUGE-Lsum of each pair, in one map stage; null texts give nulls."""
    a, b = F.lower(original), F.lower(adapted)
    counted = small_batches(pairs).select(
        key, ngram_matches(F.col(original), F.col(adapted), spaced, MAX_N).alias("_bleu"), ngram_matches(a, b, words, 1).alias("_one"),
        summary_lcs(a, b).alias("_sum"), subsequence_counts(a, b)[0].alias("_lcs"),
    )
    grams, one, union = F.col("_bleu"), F.col("_one"), F.col("_sum")
    f = lambda hits, n, m, name: _rates(hits, n, m, name)[2].alias(name)
    return counted.select(
        key, bleu_of([grams[n] for n in range(MAX_N)], grams[MAX_N], grams[MAX_N + 1]).alias("bleu"),
        f(one[0], one[1], one[2], "rouge1"), f(F.col("_lcs"), one[1], one[2], "rougeL"), f(union[0], union[1], union[2], "rougeLsum"),
    )


def set_scores(pairs: DataFrame, key: str, original: str, adapted: str) -> DataFrame:
    """Set BLEU and set ROUGE-1 of each pair; words are split once."""
    split = pairs.select(key, tokens(F.col(original)).alias("_a"), tokens(F.col(adapted)).alias("_b"))
    distinct = split.select(
        key, F.size("_a").alias("_n"), F.size("_b").alias("_m"),
        F.array_distinct("_a").alias("_a"), F.array_distinct("_b").alias("_b"),
    )
    counts = distinct.select(
        key, "_n", "_m", F.size("_a").alias("_p"), F.size("_b").alias("_q"), F.size(F.array_intersect("_a", "_b")).alias("_c")
    )
    n, m, p, q, c = (F.col(x) for x in ("_n", "_m", "_p", "_q", "_c"))
    return counts.select(key, set_bleu_of(c, n, m, q).alias("bleu"), set_rouge_of(c, p, q).alias("rouge1"))


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    letters = F.aggregate(F.col("_w"), F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return (
        df.withColumn("_w", words)
        .withColumn("chars", F.length(text))
        .withColumn("words", F.size("_w"))
        .withColumn("lines", F.size(F.split(text, "\n")))
        .withColumn("mean_word", F.coalesce(letters / F.nullif(F.size("_w"), F.lit(0)), F.lit(0.0)))
        .drop("_w")
    )
