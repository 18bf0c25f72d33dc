"""Registry of the queries and, where SQL can say the same, of their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelab.sources.fixtures import view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] | str = (), sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` is the check, ``views`` the input views it reads.

    ``sql`` is either a ``SELECT`` or starts with a comma and goes on with the list of
    common table expressions, which may be ``recursive``.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            wanted = (views,) if isinstance(views, str) else tuple(views)
            body = sql.strip()
            head = view_sql(*wanted)
            if not head and body.startswith(","):
                head, body = "WITH", body[1:]
            whole = f"{head}\n{body}" if head else body
            ORACLES[name] = whole.replace("WITH", "WITH RECURSIVE", 1) if recursive else whole
        return fn

    return add


def r6(expr: str) -> str:
    """Check-side rounding to six places without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def mean9(expr: str) -> str:
    """Check-side mean in fixed point with nine places; see ``scale.exact_mean``."""
    return f"CAST(sum(CAST(round(({expr}) * 1e9) AS HUGEINT)) AS DOUBLE) / 1e9 / nullif(count({expr}), 0)"


def corr_sql(x: str, y: str, min_n: int = 3) -> str:
    """Check-side Pearson correlation, null below ``min_n`` pairs or for a constant side."""
    both = f"FILTER (WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} >= {min_n} AND stddev_pop({x}) {both} * stddev_pop({y}) {both} > 1e-12 "
        f"THEN round(corr({x}, {y}), 6) + 0.0 END"
    )
