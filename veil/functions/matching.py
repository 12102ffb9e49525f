"""Does an inferred attribute value match the true one? Vocabulary, ages, degrees, match classes, leak scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions.similarity import first_best, jaccard, jaro_winkler_each, jaro_winkler_lists, may_be_close, word_set
from veil.operators.ordering import lookup

# Closed vocabularies a guess is matched to.
INCOME = ["no", "low", "medium", "high", "very high"]
MARRIED = ["no relation", "in relation", "married", "divorced"]
EDUCATION = ["no highschool", "in highschool", "hs diploma", "in college", "college degree", "phd"]

# Spellings of true values -> vocabulary.
TRUE_VALUES = {
    "married": {
        "no relation": "no relation", "relation": "in relation", "married": "married", "divorced": "divorced",
        "single": "no relation", "engaged": "in relation", "widowed": "no relation",
        "in a relationship": "in relation",
    },
    "income": {
        "no": "no", "low": "low", "medium": "medium", "middle": "medium", "high": "high", "very high": "very high",
    },
    "education": {
        "no hs": "no highschool", "no highschool": "no highschool", "in hs": "in highschool",
        "in highschool": "in highschool", "hs": "hs diploma", "hs diploma": "hs diploma",
        "in college": "in college", "college": "college degree", "college degree": "college degree", "phd": "phd",
    },
}

# Short education codes -> display form.
EDUCATION_DISPLAY = {
    "no hs": "No Highschool", "in hs": "In Highschool", "hs": "HS Diploma", "in college": "In College",
    "college": "College Degree", "phd": "PhD",
}

# Prefixes of free-form degrees and the level each stands for.
DEGREE_PREFIXES = {
    "college degree": ["masters in", "bachelors in", "diploma in"],
    "phd": ["phd in", "doctorate in"],
    "in college": [
        "currently studying bachelors", "currently studying masters", "studying bachelors", "studying masters",
        "studying towards a bachelors", "studying towards a masters",
    ],
    "hs diploma": ["high school diploma"],
}


def degree_level(text: Column) -> Column:
    """Free-form degree -> level; 'x degree' counts as college; anything else unchanged."""
    out = F.when(text.contains("degree") & (F.size(F.split(text, " ")) == 2), "college degree").otherwise(text)
    for level, prefixes in DEGREE_PREFIXES.items():
        start = F.lit(False)
        for prefix in prefixes:
            start = start | text.startswith(prefix)
        out = F.when(start, level).otherwise(out)
    return out


def true_value(attribute: Column, value: Column) -> Column:
    """Vocabulary form of a true value; null when the table does not know it."""
    level = F.lower(degree_level(value))
    out = F.lit(None).cast("string")
    for name, table in TRUE_VALUES.items():
        out = F.when(attribute == name, lookup(table, level)).otherwise(out)
    return out


def ages(text: Column) -> Column:
    """Integers below 200 in order of appearance."""
    digits = F.regexp_extract_all(text, F.lit("[0-9]+"), 0)
    return F.filter(F.transform(digits, lambda d: d.try_cast("int")), lambda n: n.isNotNull() & (n < 200))


def age_span(text: Column) -> Column:
    """(lo, hi) of the first two ages; a single age is a point; null without ages."""
    found = ages(text)
    return F.when(
        F.size(found) > 0,
        F.struct(found[0].alias("lo"), F.coalesce(F.try_element_at(found, F.lit(2)), found[0]).alias("hi"),
                 (F.size(found) == 1).alias("point")),
    )


def ages_agree(a: Column, b: Column, threshold: float = 0.75) -> Column:
    """Two spans overlap enough; two points differ by at most 5; a point lies in a span. Usable as a join condition."""
    common = F.greatest(F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"]), F.lit(0))
    shorter = F.greatest(F.least(a["hi"] - a["lo"], b["hi"] - b["lo"]), F.lit(1))
    verdict = (
        F.when(~a["point"] & ~b["point"], common / shorter >= threshold)
        .when(a["point"] & b["point"], F.abs(a["lo"] - b["lo"]) <= 5)
        .when(b["point"], b["lo"].between(a["lo"], a["hi"]))
        .otherwise(a["lo"].between(b["lo"], b["hi"]))
    )
    return F.coalesce(verdict, F.lit(False))


_TABLES = {"income": INCOME, "married": MARRIED, "education": EDUCATION}


def _compared(attribute: Column, truth: Column, guess: Column) -> Column:
    """What the rule of the attribute compares a guess (for places: the truth) with."""
    options = F.when(attribute == "location", F.concat(F.array(guess), F.transform(F.split(guess, ","), lambda x: F.trim(x))))
    for name, values in _TABLES.items():
        options = options.when(attribute == name, F.array(*[F.lit(v) for v in values]))
    return options.when(attribute == "gender", F.array(truth, F.lit("male"), F.lit("female"))).otherwise(F.array(truth))


def _verdict(attribute: Column, truth: Column, guess: Column, known: Column, span: Column, sims: Column) -> Column:
    """1 or 0 from the similarities of what is compared."""
    near = F.transform(sims, lambda x: x > 0.75)
    ok = (
        F.when(attribute == "age", ages_agree(span, age_span(guess)))
        .when(attribute.isin(*_TABLES), first_best(_compared(attribute, truth, guess), sims) == known)
        .when(attribute == "gender", near[0] & (F.try_element_at(near, F.lit(2)) | F.try_element_at(near, F.lit(3))))
        .when(attribute == "location", F.array_contains(near, True))
        .otherwise(near[0])
    )
    return F.coalesce(ok, F.lit(False)).cast("int")


def guesses_are_correct(attribute: Column, truth: Column, guesses: Column) -> Column:
    """[1, 0, ..] per ranked guess, by the rule of the attribute; one Python call per row, no shuffle."""
    t = F.lower(truth)
    lowered = F.transform(guesses, lambda g: F.lower(F.trim(g)))
    subjects = F.transform(lowered, lambda g: F.when(attribute == "location", t).otherwise(g))
    sims = jaro_winkler_lists(subjects, F.transform(lowered, lambda g: _compared(attribute, t, g)))
    known, span = true_value(attribute, truth), age_span(t)
    return F.zip_with(lowered, sims, lambda g, s: _verdict(attribute, t, g, known, span, s))


def guess_is_correct(attribute: Column, truth: Column, guess: Column) -> Column:
    """1 or 0 for one lower-cased, trimmed guess; pairs that can't be near never reach Python."""
    t = F.lower(truth)
    subject = F.when(attribute == "location", t).otherwise(guess)
    options = _compared(attribute, t, guess)
    # where the nearest of a table is asked for, all its values are compared; ages need no similarity
    able = F.transform(options, lambda o: F.when(attribute.isin(*_TABLES) | may_be_close(subject, o), o))
    asked = F.when((attribute != "age") & F.exists(able, lambda o: o.isNotNull()), able)
    return _verdict(attribute, t, guess, true_value(attribute, truth), age_span(t), jaro_winkler_each(F.when(asked.isNotNull(), subject), asked))


# Level and decade words of the coarse overlap rule.
LEVEL_WORDS = ["low", "medium", "high", "very high"]
DECADES = ["20s", "30s", "40s", "50s"]

# Weights of the match classes.
MATCH_WEIGHTS = {"exact": 1.0, "semantic": 0.6, "partial": 0.3}


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")


def semantic_similarity(a: Column, b: Column) -> Column:
    """Greatest of word overlap, relative closeness of the first numbers, shared level or decade word."""
    wa, wb = word_set(a), word_set(b)
    na, nb = first_number(a), first_number(b)
    near = (
        F.when(na.isNull() | nb.isNull(), 0.0)
        .when(na == nb, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(na - nb) / F.greatest(na, nb)))
    )
    shared = F.lit(False)
    for word in LEVEL_WORDS + DECADES:
        shared = shared | (a.contains(word) & b.contains(word))
    best = F.greatest(jaccard(wa, wb), near, F.when(shared, 1.0).otherwise(0.0))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(best)


def first_containment(truth: Column, guesses: Column) -> Column:
    """First guess that equals the truth or, for truths longer than two characters, contains or lies in it."""
    return F.try_element_at(
        F.filter(
            guesses,
            lambda g: (g == truth) | ((F.length(truth) > 2) & (truth.contains(g) | g.contains(truth))),
        ),
        F.lit(1),
    )


def best_similarity(truth: Column, guesses: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(guesses, lambda g: semantic_similarity(truth, g))), F.lit(0.0))


def match_class(contained: Column, best: Column, semantic_at: float = 0.7, partial_at: float = 0.3) -> Column:
    return (
        F.when(contained.isNotNull(), "exact")
        .when(best >= semantic_at, "semantic")
        .when(best >= partial_at, "partial")
        .otherwise("none")
    )


def leak_score(match_type: Column, certainty: Column, similarity: Column) -> Column:
    """Weight of the match times (0.4 + 0.6 * certainty / 5), times similarity unless exact; at most 1."""
    weight = F.lit(0.0)
    for name, w in MATCH_WEIGHTS.items():
        weight = F.when(match_type == name, w).otherwise(weight)
    factor = F.lit(0.4) + certainty / 5.0 * 0.6
    return F.least(F.lit(1.0), weight * factor * F.when(match_type == "exact", 1.0).otherwise(similarity))


def attack_succeeds(guess: Column, truth: Column) -> Column:
    """Truth inside the guess, or more than two words in common."""
    g, t = F.lower(guess), F.lower(truth)
    return g.contains(t) | (F.size(F.array_intersect(word_set(g), word_set(t))) > 2)


def leak_status(truth: Column, guesses: Column) -> Column:
    """'leaked' if guessed verbatim, 'partial' if inside a guess, else 'protected'."""
    return (
        F.when(F.array_contains(guesses, truth), "leaked")
        .when(F.exists(guesses, lambda g: F.lower(g).contains(F.lower(truth))), "partial")
        .otherwise("protected")
    )
