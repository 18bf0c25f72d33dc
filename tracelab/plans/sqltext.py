"""Check-side SQL snippets for text work."""

from __future__ import annotations

from tracelab.functions.text import FLOAT_PATTERN


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def st(x: str) -> str:
    return f"trim({x}, E' \\n\\t\\r')"


def rx(x: str, p: str, i: int = 1) -> str:
    return f"regexp_extract({x}, {q(p)}, {i})"


def rm(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def ra(x: str, p: str, i: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(p)}, {i})"


def sub(x: str, p: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"


def at(x: str, i: int) -> str:
    return f"list_extract({x}, {i})"


def part(x: str, sep: str, i: int) -> str:
    return f"list_extract(string_split({x}, {q(sep)}), {i})"


def line(x: str, i: int) -> str:
    return st(f"list_extract(string_split({st(x)}, chr(10)), {i})")


def num(x: str) -> str:
    return f"CASE WHEN {rm(x, FLOAT_PATTERN)} THEN TRY_CAST({x} AS DOUBLE) END"


def nest(source: str, stages: list[tuple[str, str]]) -> str:
    """Nested selects, one per stage, so that each stage can use the ones before."""
    out = source
    for name, expr in stages:
        out = f"(SELECT *, {expr} AS {name} FROM {out})"
    return out
