"""Perception against outcome: four cells, alignment statistics and go/no-go decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.scale import ranked_histogram

CELLS = ["grounded_correct", "shortcut", "careful_flawed", "hallucinated", "unknown"]


def cell_of(outcome: Column, perception: Column, threshold: float | Column = 0.5) -> Column:
    """Cell of one sample; a missing outcome or perception is ``unknown``."""
    high = perception >= threshold
    return (
        F.when(outcome.isNull() | perception.isNull(), "unknown")
        .when((outcome == 1) & high, "grounded_correct")
        .when(outcome == 1, "shortcut")
        .when(high, "careful_flawed")
        .otherwise("hallucinated")
    )


def share(condition: Column) -> Column:
    """Percentage of rows where the condition holds (null counts as no)."""
    return F.round(F.avg(F.when(condition, 100.0).otherwise(0.0)), 6)


def cell_distribution(
    rows: DataFrame, keys: list[str], variant: str = "unknown_cell", threshold: float | Column = 0.5
) -> DataFrame:
    """Cell percentages per group.

    ``variant="unknown_cell"`` keeps rows without outcome in the unknown cell,
    ``"exclude_missing"`` leaves them out of the denominator.
    """
    if variant == "exclude_missing":
        rows = rows.where(F.col("outcome").isNotNull())
    cells = rows.withColumn("cell", cell_of(F.col("outcome"), F.col("perception"), threshold))
    correct = F.count_if(F.col("cell").isin("grounded_correct", "shortcut"))
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("cell") != "unknown").alias("n_valid"),
        *[share(F.col("cell") == c).alias(c) for c in CELLS],
        share(F.col("outcome") == 1).alias("outcome_pct"),
        F.round(100.0 * F.count_if(F.col("cell") == "shortcut") / F.greatest(correct, F.lit(1)), 6).alias(
            "drift_within_correct"
        ),
    )


def auc_by_group(rows: DataFrame, keys: list[str], score: str, label: str, low=None, high=None, weight: str | None = None) -> DataFrame:
    """Tie-averaged rank-sum ROC AUC per group; null for one class or a constant score.

    Works on the histogram of distinct scores, so a group is never ranked in one task. ``weight`` is the number of rows that a row stands for.
    """
    valid = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    each = F.lit(1) if weight is None else F.col(weight)
    ranked = ranked_histogram(
        valid,
        keys,
        score,
        {"n": F.sum(each.cast("bigint")), "pos": F.sum(F.col(label).cast("bigint") * each)},
        low=low,
        high=high,
    )
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("below_n") - F.col("below_pos")
    grouped = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + neg * 0.5)).alias("_wins"),
        F.max("total_pos").alias("_p"),
        F.max("total_n").alias("_n"),
        F.count(F.lit(1)).alias("_distinct"),
    )
    pairs = F.col("_p") * (F.col("_n") - F.col("_p"))
    auc = F.when((F.col("_distinct") >= 2) & (pairs > 0), F.round(F.try_divide("_wins", pairs), 6))
    return grouped.select(*keys, F.col("_n").alias("n"), auc.alias("auc"))


def spearman_by_group(rows: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Pearson correlation of average ranks, from two distinct-value histograms."""
    valid = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).count()
    ranked = valid
    for column in (x, y):
        ranks = ranked_histogram(valid, keys, column, {"n": F.sum("count")}).select(
            *keys, column, (F.col("below_n") + (F.col("n") + 1) / 2).alias(f"_r_{column}")
        )
        ranked = ranked.join(ranks, [*keys, column])
    rx, ry, w = F.col(f"_r_{x}"), F.col(f"_r_{y}"), F.col("count")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("_n"),
        F.sum(w * rx).alias("_sx"),
        F.sum(w * ry).alias("_sy"),
        F.sum(w * rx * rx).alias("_sxx"),
        F.sum(w * ry * ry).alias("_syy"),
        F.sum(w * rx * ry).alias("_sxy"),
    )
    n = F.col("_n")
    cov = F.col("_sxy") - F.col("_sx") * F.col("_sy") / n
    vx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    vy = F.col("_syy") - F.col("_sy") * F.col("_sy") / n
    value = F.when((n >= min_n) & (vx > 0) & (vy > 0), F.round(cov / F.sqrt(vx * vy), 6))
    return sums.select(*keys, value.alias(f"spearman_{x}_{y}"))


def pearson(x: str, y: str, min_n: int = 3) -> Column:
    """Pearson correlation over pair-valid rows, null below ``min_n`` or for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xv, yv = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(xv) * F.stddev_pop(yv)
    value = F.try_divide(F.covar_pop(xv, yv), F.when(spread > 1e-12, spread))
    return F.when(F.count_if(both) >= min_n, F.round(value, 6))


def drift_pattern(distributions: DataFrame, name: str, base_model: str, tuned_model: str) -> DataFrame:
    """Decision over a handful of per-model distributions."""
    grounded = lambda m: F.max(F.when(F.col(name) == m, F.col("grounded_correct")))
    agg = distributions.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.bool_and(F.col("shortcut") >= 15).alias("universal_shortcut"),
        F.round(F.max("grounded_correct") - F.min("grounded_correct"), 6).alias("grounded_spread"),
        F.round(grounded(tuned_model) - grounded(base_model), 6).alias("tuned_gain"),
    )
    universal, spread = F.col("universal_shortcut"), F.col("grounded_spread")
    return agg.withColumn(
        "pattern",
        F.when(F.col("n_models") < 2, "INSUFFICIENT_DATA")
        .when(F.col("tuned_gain") >= 10, "C")
        .when(universal & (spread < 10), "A")
        .when(universal, "A-strong")
        .when(spread < 10, "B")
        .otherwise("AMBIGUOUS"),
    )
