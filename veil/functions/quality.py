"""Row-level text quality formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def brevity_penalty(ref_len: Column, hyp_len: Column) -> Column:
    return F.when(hyp_len > ref_len, 1.0).otherwise(F.exp(F.lit(1.0) - ref_len / F.nullif(hyp_len, F.lit(0))))


def set_bleu_of(common: Column, ref_len: Column, hyp_len: Column, hyp_words: Column) -> Column:
    """Share of the distinct words that are common times brevity penalty; 0 when a side is empty."""
    value = common / F.nullif(hyp_words, F.lit(0)) * brevity_penalty(ref_len, hyp_len)
    return F.when((ref_len == 0) | (hyp_len == 0), 0.0).otherwise(value)


def set_rouge_of(common: Column, ref_words: Column, hyp_words: Column) -> Column:
    """F1 of the distinct words; the simplified ROUGE-L is the same number."""
    return F.coalesce(F.lit(2.0) * common / F.nullif(F.when(common > 0, ref_words + hyp_words), F.lit(0)), F.lit(0.0))


def set_bleu(original: Column, adapted: Column) -> Column:
    """Distinct-word precision times brevity penalty; 0 when a side is empty."""
    a, b = tokens(original), tokens(adapted)
    return set_bleu_of(F.size(F.array_intersect(a, b)), F.size(a), F.size(b), F.size(F.array_distinct(b)))


def set_rouge(original: Column, adapted: Column) -> Column:
    a, b = F.array_distinct(tokens(original)), F.array_distinct(tokens(adapted))
    return set_rouge_of(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def quality_utility(readability: Column, meaning: Column, hallucination: Column, bleu: Column) -> Column:
    return (readability / 10 * 0.3 + meaning / 10 * 0.4 + hallucination * 0.3 + bleu) / 2


def trainer_utility(readability: Column, meaning: Column, hallucination: Column) -> Column:
    return readability / 10 * 0.3 + meaning / 10 * 0.5 + hallucination * 0.2


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("double")


def anonymisation_coverage(changes: Column, bleu: Column, detected: Column) -> Column:
    """Percent: a log curve of the number of changes averaged with how far BLEU fell."""
    by_changes = F.when(changes > 0, F.least(F.lit(95.0), F.lit(30.0) + F.log2(changes + 1) * 15)).otherwise(0.0)
    both = F.when(bleu.isNull(), by_changes).otherwise((by_changes + (F.lit(1.0) - bleu) * 100) / 2)
    return F.when(detected == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), both)))


def inference_resistance(coverage: Column, meaning: Column, hallucination: Column, detected: Column) -> Column:
    """0-10; without detected attributes only a clean hallucination score counts."""
    mix = hallucination * 10 * 0.3 + coverage / 10 * 0.4 + meaning * 0.3
    return F.when(detected == 0, F.when(hallucination == 1, 10.0).otherwise(0.0)).otherwise(
        F.least(F.lit(10.0), half_up(mix))
    )


def text_total(readability: Column, meaning: Column, hallucination: Column) -> Column:
    return half_up((readability + meaning + hallucination * 10) / 3)


def privacy_total(coverage: Column, meaning: Column, resistance: Column) -> Column:
    """On the 0-10 scale."""
    return half_up((half_up(coverage) / 10 + half_up(meaning) + resistance) / 3)


def advice_privacy_total(coverage: Column, meaning: Column, resistance: Column) -> Column:
    """The variant behind the advice band, in which coverage stays a percentage."""
    return half_up((half_up(coverage) + half_up(meaning) + resistance) / 3)


def advice_band(text_score: Column, privacy_score: Column) -> Column:
    return (
        F.when((text_score >= 8) & (privacy_score >= 8), "excellent balance")
        .when((text_score >= 7) & (privacy_score >= 7), "good balance")
        .when(text_score >= 6, "leans to utility")
        .when(privacy_score >= 6, "leans to privacy")
        .otherwise("needs work")
    )
