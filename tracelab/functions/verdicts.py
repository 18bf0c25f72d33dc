"""Verdict dialects of judge output texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelab.functions.text import every, group, last_of, strip, sub

# Label letters of the two failure taxonomies.
ROOT_CAUSES = {
    "A": "Q_TARGET_MISREAD",
    "B": "SUBSET_FILTER_MISSED",
    "C": "CHART_VALUE_MISREAD",
    "D": "WRONG_GROUP_ANCHORED",
    "E": "REASONING_GAP",
    "F": "ARITHMETIC",
    "G": "PREMATURE_CONCLUSION",
    "H": "TRUNCATED",
    "I": "FORMAT_MISMATCH",
    "J": "OTHER",
}
FLAW_KINDS = {
    "A": "TRUNCATION",
    "B": "FORMAT_MISMATCH",
    "C": "Q_INTENT",
    "D": "CATEGORY_SELECT",
    "E": "ARITHMETIC",
    "F": "OTHER",
}
AXES = {"Q1": "VALUE", "Q2": "LABEL", "Q3": "COUNT", "Q4": "STRUCTURE"}


def verdict_word(raw: Column) -> Column:
    """``Verdict: <word>``: right when the word starts with "correct"; no verdict is null."""
    word = group(raw, r"(?i)Verdict:\s*(\w+)")
    return F.when(word != "", F.lower(word).startswith("correct").cast("int"))


def yes_no(raw: Column) -> Column:
    """Yes before no, at the start or within the first twenty characters."""
    head = F.left(F.lower(strip(raw)), F.lit(20))
    return F.when(head.contains("yes"), 1).when(head.contains("no"), 0).cast("int")


def yes_word(raw: Column) -> Column:
    """1 when the text has the word yes or starts with it, 0 otherwise and for errors."""
    low = F.lower(strip(raw))
    yes = low.startswith("yes") | low.rlike(r"(^|\s)yes(\s|$)")
    return (yes & ~raw.startswith("ERROR")).cast("int")


def remote(raw: Column, dialect: str = "fixed") -> Column:
    """Text after the last "verdict", else a yes/no prefix. The legacy dialect reads
    "incorrect" as correct and is kept for comparison only."""
    low = F.lower(strip(raw))
    tail = F.substring_index(low, "verdict", -1)
    if dialect == "legacy":
        judged = F.when(tail.contains("correct"), 1).otherwise(0)
    else:
        judged = F.when(tail.contains("incorrect"), 0).when(tail.contains("correct"), 1)
    return (
        F.when(low.contains("verdict"), judged).when(low.startswith("yes"), 1).when(low.startswith("no"), 0).cast("int")
    )


def correctness(raw: Column) -> Column:
    """Yes or no after ``Correctness:``."""
    tail = F.lower(strip(group(raw, r"(?si)Correctness:\s*(.*)")))
    return F.when(tail.contains("yes"), 1).when(tail.contains("no"), 0).cast("int")


def json_score(raw: Column) -> Column:
    """Score of a JSON verdict, read from the whole text or its outermost braces; 0 when unreadable."""
    inner = group(raw, r"(?s)\{.*\}", 0)
    text = F.coalesce(F.get_json_object(raw, "$.score"), F.get_json_object(inner, "$.score"))
    value = F.when(text == "true", 1).otherwise(text.try_cast("double").cast("int"))
    return F.when(raw.startswith("ERROR"), 0).otherwise(F.coalesce(value, F.lit(0))).cast("int")


def axis_verdict(raw: Column, question: str) -> Column:
    """Verdict of one axis line; the last matching line counts, NA is null."""
    hit = F.upper(last_of(every(raw, rf"(?im)^[ \t]*{question}[ \t]*[:\-][ \t]*(YES|NO|NA|N/A)\b", 1)))
    return F.when(hit == "YES", 1).when(hit == "NO", 0).cast("int")


def axis_verdicts(raw: Column) -> Column:
    pairs = []
    for question, axis in AXES.items():
        pairs += [F.lit(axis), axis_verdict(raw, question)]
    return F.create_map(*pairs)


def label(raw: Column, names: dict[str, str]) -> Column:
    """Taxonomy label behind ``LABEL:``; anything else is PARSE_FAIL."""
    letter = F.upper(group(raw, rf"(?i)LABEL:\s*([A-{max(names)}])"))
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, letter), F.lit("PARSE_FAIL"))


def labelled_field(raw: Column, name: str, cap: int | None = None) -> Column:
    """Text behind ``<name>:`` up to the next labelled line, whole or its first ``cap`` characters."""
    tail = group(raw, rf"(?si){name}:\s*(.+)")
    text = strip(sub(tail, r"(?s)\n[A-Za-z]+:.*$"))
    return text if cap is None else F.left(text, F.lit(cap))


def not_found(raw: Column) -> Column:
    up = F.upper(F.coalesce(raw, F.lit("")))
    return up.contains("NOT_FOUND") | up.contains("NOT FOUND")


def first_number(raw: Column) -> Column:
    hit = group(raw, r"-?\d+(?:\.\d+)?", 0)
    return F.when(hit != "", hit.try_cast("double"))


CLAIM_SCHEMA = "array<string>"


def claim_items(raw: Column, greedy: bool = True) -> Column:
    """JSON objects of the claim list in a text, as an array of object texts."""
    span = group(raw, r"(?s)\[.*\]" if greedy else r"(?s)\[.*?\]", 0)
    items = F.from_json(F.when(span != "", span), CLAIM_SCHEMA)
    return F.filter(items, lambda x: x.startswith("{"))


# Dialect name -> column builder of an integer verdict.
DIALECTS = {
    "charxiv": verdict_word,
    "yes_no": yes_no,
    "remote": remote,
    "reachqa": correctness,
    "json_loose": json_score,
}
