"""Reward composition over rollout tables: outcome terms, process terms, reward columns, telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions import extract, scoring
from tracelab.functions.text import think_words
from tracelab.operators import process as P

RIGHT = 0.95
BONUS = 0.3


def outcome_terms(responses: DataFrame) -> DataFrame:
    """Training-rule answer with its continuous and text scores."""
    rows = extract.train(responses)
    pred, gold = F.col("pred"), F.col("gold")
    return rows.withColumns(
        {
            "cerm": scoring.closeness(pred, gold),
            "text": scoring.text_match(pred, gold),
            "numeric": scoring.is_numeric(gold),
            "words": think_words(F.col("response")),
        }
    )


def with_process(
    rows: DataFrame, cells: DataFrame, keys: list[str], chart: str, needed: Column, terms=P.process_terms, **options
) -> DataFrame:
    """Attach process terms to the rows that need them, in place: no row moves for it; the others have nulls."""
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    asked = rows.withColumn("joined", F.when(needed & known, F.lit(True))).withColumn("_said", F.when(F.col("joined"), F.col("response")))
    part = terms(asked, cells, keys, chart, response="_said", **options)
    new = [c for c in part.columns if c not in asked.columns]
    return part.select(*rows.columns, *[F.when(F.col("joined"), F.col(c)).alias(c) for c in new], "joined")


def wrong_numeric() -> Column:
    return F.col("numeric") & (F.col("cerm") < RIGHT)


def text_aware() -> Column:
    return F.when(F.col("numeric"), F.col("cerm")).otherwise(F.col("text"))


def conditional(process: Column) -> Column:
    """Right answers earn 1, wrong ones their closeness plus a share of the process term."""
    return F.when(F.col("cerm") >= RIGHT, 1.0).otherwise(F.least(F.lit(1.0), F.col("cerm") + BONUS * process))


def branch(reward: Column) -> Column:
    """Text answers and rows without a table fall back to the text match."""
    return F.when(~F.col("numeric") | ~F.col("has_csv"), F.col("text")).otherwise(reward)


def multiplicative(process: Column) -> Column:
    """A wrong answer never reaches 1."""
    acc = F.col("cerm")
    return F.when(acc >= RIGHT, 1.0).otherwise(acc + BONUS * (1.0 - acc) * process)


def additive(process: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * F.col("cerm") + 0.3 * process + 0.2)


def small_process(process: Column, multi_step: Column) -> Column:
    """Right 1; wrong earns a twentieth of the process term, only on multi-step questions with a table."""
    right = F.when(F.col("cerm") >= RIGHT, 1.0)
    return (
        F.when(~F.col("numeric"), F.col("text"))
        .when(~F.col("has_csv") | ~multi_step, right.otherwise(0.0))
        .otherwise(right.otherwise(0.05 * process))
    )


def length_penalty(words: Column, version: int) -> Column:
    if version == 2:
        return 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (words - 300) / 300.0))
    return F.when(words <= 250, 0.0).otherwise(0.3 * F.least((words - 250) / 250.0, F.lit(1.0)))


def telemetry(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Batch metrics of a reward: (reward, acc, proc, kind, words) summarised per group."""
    kind = F.col("kind")
    share = lambda k: F.round(F.avg((kind == k).cast("double")), 6).alias(f"frac_{k}")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_completions"),
        F.round(F.avg("reward"), 6).alias("reward_mean"),
        F.round(F.stddev_pop("reward"), 6).alias("reward_std"),
        F.round(F.avg("acc"), 6).alias("acc_mean"),
        F.round(F.avg("proc"), 6).alias("proc_mean"),
        share("correct"),
        share("augmented"),
        share("text"),
        share("outcome_only"),
        F.round(F.avg("words"), 6).alias("avg_think_words"),
    )
