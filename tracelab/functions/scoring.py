"""Answer scorers over (prediction, gold) text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelab.functions.text import group, strip, sub, to_number

# Units stripped before comparing, and word lists.
UNITS = r"(?i)\s*(?:billion|million|thousand|trillion|percent|k|K|M|B|T|tons?|t|kg|lbs?|GiB|MB|GB)\b"
YES_TOKENS = ["y", "yes", "true", "1", "ye"]
NO_TOKENS = ["n", "no", "false", "0"]
NOT_NUMERIC = ["yes", "no", "true", "false", "n/a", "none", ""]


def hit(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def same_text(p: Column, g: Column) -> Column:
    return hit((p == g) | (F.lower(strip(p)) == F.lower(strip(g))))


def within(p: Column, g: Column, share: float = 0.05) -> Column:
    return hit(F.try_divide(F.abs(p - g), F.abs(g)) <= share)


def bare(s: Column) -> Column:
    """Text without thousands commas, percent and currency signs."""
    return F.translate(strip(s), ",%$", "")


def texts_and_numbers(pred: Column, gold: Column, clean) -> Column:
    """One entry with both texts cleaned and the numbers they stand for: each is worked out once, not at every use."""
    texts = F.array(F.struct(clean(pred).alias("pt"), clean(gold).alias("gt")))
    return F.transform(texts, lambda t: F.struct(t["pt"].alias("pt"), t["gt"].alias("gt"), to_number(strip(t["pt"])).alias("p"), to_number(strip(t["gt"])).alias("g")))


def scored_once(pred: Column, gold: Column, clean, score) -> Column:
    """``score`` of the cleaned texts and their numbers."""
    return F.transform(texts_and_numbers(pred, gold, clean), lambda c: score(c["pt"], c["gt"], c["p"], c["g"]))[0]


def relaxed_correctness(pred: Column, gold: Column, share: float = 0.05) -> Column:
    """Percent signs divide by 100; both numeric and gold not 0 compare within 5%, else as text."""

    def number(s: Column) -> Column:
        t = strip(s)
        return F.when(t.endswith("%"), to_number(F.rtrim(t, F.lit("%"))) / 100.0).otherwise(to_number(t))

    p, g = number(pred), number(gold)
    return F.when(p.isNotNull() & g.isNotNull() & (g != 0), within(p, g, share)).otherwise(same_text(pred, gold))


def relaxed_accuracy(pred: Column, gold: Column) -> Column:
    """Units and signs stripped, 5% tolerance, near-zero rule for gold 0."""

    def clean(s: Column) -> Column:
        return F.rtrim(F.translate(strip(sub(strip(s), UNITS)), ",%$", ""), F.lit("."))

    def score(pt: Column, gt: Column, p: Column, g: Column) -> Column:
        numeric = F.when(g == 0, hit(F.abs(p) < 0.01)).otherwise(within(p, g))
        return F.when(p.isNotNull() & g.isNotNull(), numeric).otherwise(same_text(pt, gt))

    return scored_once(pred, gold, clean, score)


def closeness(pred: Column, gold: Column) -> Column:
    """Continuous score 1 / (1 + relative error), else text equality."""

    def score(pt: Column, gt: Column, p: Column, g: Column) -> Column:
        numeric = F.when(g == 0, hit(F.abs(p) < 0.01)).otherwise(1.0 / (1.0 + F.try_divide(F.abs(p - g), F.abs(g))))
        return F.when(p.isNotNull() & g.isNotNull(), numeric).otherwise(hit(F.lower(pt) == F.lower(gt)))

    return scored_once(pred, gold, bare, score)


def closeness_strict(pred: Column, gold: Column) -> Column:
    """As ``closeness`` with an empty answer at 0 and exact comparison for gold 0."""
    clean = lambda s: to_number(strip(F.rtrim(F.replace(s, F.lit(","), F.lit("")), F.lit("%"))))
    p, g = clean(pred), clean(gold)
    numeric = F.when(g == 0, hit(p == 0)).otherwise(1.0 / (1.0 + F.try_divide(F.abs(p - g), F.abs(g))))
    return (
        F.when(strip(pred) == "", 0.0)
        .when(p.isNotNull() & g.isNotNull(), numeric)
        .otherwise(same_text(pred, gold))
    )


def text_match(pred: Column, gold: Column) -> Column:
    """Equality, short gold contained in the answer, or the same yes/no first word."""

    def polarity(s: Column) -> Column:
        word = group(s, r"^(\S+)")
        return F.when(word.isin("yes", "true"), "yes").when(word.isin("no", "false"), "no")

    def score(p: Column, g: Column) -> Column:
        return (
            F.when((p == "") | (g == ""), 0.0)
            .when(p == g, 1.0)
            .when((F.length(g) < 50) & p.contains(g), 1.0)
            .otherwise(hit(F.coalesce(polarity(p) == polarity(g), F.lit(False))))
        )

    texts = F.struct(F.lower(strip(pred)).alias("p"), F.lower(strip(gold)).alias("g"))
    return F.transform(F.array(texts), lambda t: score(t["p"], t["g"]))[0]


def is_numeric(gold: Column) -> Column:
    """Is the gold answer a number once signs and unit words are gone?"""
    s = F.lower(strip(gold))
    t = strip(sub(strip(sub(s, r"[,%$]")), r"(?i)\s*(?:billion|million|thousand|trillion|percent|k|M|B|T)$"))
    return ~s.isin(NOT_NUMERIC) & to_number(t).isNotNull()


def multichoice_match(pred: Column, gold: Column, multichoice: Column) -> Column:
    """Letter choices, yes/no tokens, numbers within 5% of max(1, gold), containment either way."""

    def norm(s: Column) -> Column:
        return F.btrim(sub(F.lower(s), r"\s+", " "), F.lit(" .!?,;:"))

    p, g = norm(pred), norm(gold)
    number = lambda s: to_number(strip(sub(s, r"[,%$]")))
    pn, gn = number(p), number(g)
    letter = r"^[a-e]$"
    lettered = F.when(p.rlike(letter), p == g).otherwise(group(p, r"\b([a-e])\b") == g)
    numeric = F.when(F.abs(gn) < 1e-9, F.abs(pn) < 1e-6).otherwise(
        F.abs(pn - gn) / F.greatest(F.lit(1.0), F.abs(gn)) <= 0.05
    )
    inside = (p == g) | ((g != "") & (p.contains(g) | g.contains(p)))
    return hit(
        F.when((pred == "") | (gold == "") | pred.isNull() | gold.isNull(), F.lit(False))
        .when(multichoice & g.rlike(letter), lettered)
        .when(g.isin(YES_TOKENS) & p.isin(YES_TOKENS), F.lit(True))
        .when(g.isin(NO_TOKENS) & p.isin(NO_TOKENS), F.lit(True))
        .when(pn.isNotNull() & gn.isNotNull(), numeric)
        .otherwise(inside)
    )


def relaxed_match(pred: Column, gold: Column) -> Column:
    """Earlier scorer: signs stripped, 5%, near-zero rule, text equality."""

    def score(pt: Column, gt: Column, p: Column, g: Column) -> Column:
        numeric = F.when(g == 0, hit(F.abs(p) < 0.01)).otherwise(within(p, g))
        return F.when(p.isNotNull() & g.isNotNull(), numeric).otherwise(hit((pt == gt) | (F.lower(pt) == F.lower(gt))))

    return scored_once(pred, gold, bare, score)


def equal_first(pred: Column, gold: Column) -> Column:
    """Text equality first, then 5%; gold 0 only matches 0."""
    p, g = F.lower(strip(pred)), F.lower(strip(gold))
    pn, gn = to_number(strip(sub(p, r"[,%$]"))), to_number(strip(sub(g, r"[,%$]")))
    numeric = F.when(gn == 0, hit(pn == 0)).otherwise(within(pn, gn))
    return F.when(p == g, 1.0).when(pn.isNotNull() & gn.isNotNull(), numeric).otherwise(0.0)


def gold_type(gold: Column) -> Column:
    g = strip(F.coalesce(gold, F.lit("")))
    number = r"^-?\d+\.?\d*\s*(?:%?|[MmBbKk])$"
    return (
        F.when(F.lower(g).isin("true", "false", "yes", "no"), "bool").when(g.rlike(number), "numeric").otherwise("open")
    )


def by_gold_type(pred: Column, gold: Column, verdict: Column) -> Column:
    """Equality for yes/no golds, relaxed for numbers, the judge's verdict for the rest."""
    kind = gold_type(gold)
    return (
        F.when(strip(pred) == "", 0.0)
        .when(kind == "bool", same_text(pred, gold))
        .when(kind == "numeric", relaxed_correctness(pred, gold))
        .otherwise(F.coalesce(verdict.cast("double"), F.lit(0.0)))
    )


SCORERS = {
    "relaxed_correctness": relaxed_correctness,
    "relaxed_accuracy": relaxed_accuracy,
    "cerm": closeness,
    "cerm_strict": closeness_strict,
    "text_match": text_match,
    "relaxed_match_legacy": relaxed_match,
    "equal_first": equal_first,
}
