"""Registered queries, one module per family."""

from tracelab.plans.registry import ORACLES, QUERIES
from tracelab.plans import answers, cells, claims, corpus, failures, helpers, inputdep, mc, process, qagen, streams, traces  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
