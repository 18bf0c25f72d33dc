"""String and number helpers as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \n\t\r\x0b\x0c"

# Number patterns of the jobs. "compat" splits bare numbers of four and more
# digits into groups of three (kept because results must agree); "wide" reads them whole.
NUMBER_PATTERNS = {
    "compat": r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?",
    "wide": r"[-+]?\d+(?:,?\d{3})*(?:\.\d+)?",
}
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
YEAR_MIN, YEAR_MAX = 1900, 2030


def calc_pattern(kind: str = "compat") -> str:
    """``a op b = c`` with four groups."""
    n = NUMBER_PATTERNS[kind]
    return rf"({n})\s*([+\-*/×÷])\s*({n})\s*[=≈]\s*({n})"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def or_empty(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def sub(s: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(s, pattern, to)


def group(s: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract(s, pattern, idx)


def every(s: Column, pattern: str, idx: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(idx))


def first_of(hits: Column) -> Column:
    return F.try_element_at(hits, F.lit(1))


def last_of(hits: Column) -> Column:
    return F.try_element_at(hits, F.lit(-1))


def last_line(s: Column) -> Column:
    """Last line that is not blank."""
    return strip(F.substring_index(strip(s), "\n", -1))


def first_line(s: Column) -> Column:
    return strip(F.substring_index(strip(s), "\n", 1))


def lines_of(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "\n"), strip), lambda x: x != "")


def to_number(s: Column) -> Column:
    """Number a text stands for, null when it is none."""
    return F.when(s.rlike(FLOAT_PATTERN), s.try_cast("double"))


def plain_number(s: Column) -> Column:
    """Number in a text already known to be digits with thousands commas."""
    return F.replace(s, F.lit(","), F.lit("")).try_cast("double")


def is_year(n: Column) -> Column:
    return n.between(YEAR_MIN, YEAR_MAX) & (n == F.floor(n))


def words(s: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(s, F.lit(r"\S+"))


def _opened(response: Column) -> Column:
    """What follows the first ``<think>``."""
    return F.substring(response, F.instr(response, "<think>") + F.lit(len("<think>")), F.length(response))


def has_think_body(response: Column) -> Column:
    return F.contains(response, F.lit("<think>")) & F.contains(_opened(response), F.lit("</think>"))


def think_body(response: Column) -> Column:
    """Text from the first ``<think>`` to the next ``</think>``, where there are both."""
    return F.substring_index(_opened(response), "</think>", 1)


def reasoning_span(response: Column, cut_answer: bool = True) -> Column:
    """Reasoning part of a response: think body, else what stands before ``</think>``, else
    (with ``cut_answer``) before ``<answer>``, else all."""
    rest = F.substring_index(response, "<answer>", 1) if cut_answer else response
    return (
        F.when(has_think_body(response), think_body(response))
        .when(F.contains(response, F.lit("</think>")), F.substring_index(response, "</think>", 1))
        .otherwise(rest)
    )


def think_words(response: Column) -> Column:
    """Words of the think part, 0 where a response has no closed think part."""
    closed = F.contains(response, F.lit("</think>"))
    return F.when(closed, words(reasoning_span(response))).otherwise(0)


def rejoin(content: Column, reasoning: Column) -> Column:
    """Response as one text from its served channels; left unclosed when content is blank."""
    said, thought = strip(or_empty(content)), strip(or_empty(reasoning))
    opened = F.concat(F.lit("<think>\n"), thought)
    return (
        F.when(thought == "", said).when(said == "", opened).otherwise(F.concat(opened, F.lit("\n</think>\n"), said))
    )


def explode_items(df: DataFrame, keep: list, items: Column, pos: str, name: str) -> DataFrame:
    """One row per array item with its position.

    The outer form keeps the optimizer from adding a ``size(items) > 0`` filter below the
    explode, which would work out the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).where(F.col(pos).isNotNull())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
