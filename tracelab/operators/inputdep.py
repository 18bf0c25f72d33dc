"""How much a step depends on the input: step values with and without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.mc import or_zero, pstd

# Half-open histogram bins of the paired difference (fixed values).
VD_BINS = [
    (-1.0, -0.3, "strongly_neg"),
    (-0.3, -0.1, "mildly_neg"),
    (-0.1, 0.1, "zero"),
    (0.1, 0.3, "mildly_pos"),
    (0.3, 0.6, "strongly_pos"),
    (0.6, 1.01, "very_strong_pos"),
]


def case_of(w: Column, vd: Column) -> Column:
    high, dep = w >= 0.7, vd >= 0.2
    return (
        F.when(w.isNull() | vd.isNull(), "missing")
        .when(high & ~dep, "case1_self_sufficient")
        .when(high & dep, "case2_input_critical")
        .when(~dep, "case3_bad_prefix")
        .otherwise("case4_perception_fail")
    )


def bonus_reward(w: Column, wo: Column, penalise: bool = False) -> Column:
    """Step reward with an input-dependence bonus; ``penalise`` marks misleading input first."""
    vd = w - wo
    start = F.when(w.isNull() | wo.isNull(), 0.0)
    if penalise:
        start = start.when(vd <= -0.3, -0.2)
    return (
        start.when(w >= 0.7, w * (1 + 0.3 * (1 - vd)))
        .when(w == 0, F.when(vd < 0.2, 0.0).otherwise(0.1))
        .otherwise(w)
    )


def pattern_of(w: Column, wo: Column) -> Column:
    vd = w - wo
    return (
        F.when(w.isNull() | wo.isNull(), "_invalid")
        .when((w == 0) & (wo == 0), "A")
        .when((wo >= 0.5) & (vd < 0), "B")
        .when((w >= 0.5) & (vd > 0.3), "C")
        .when((w > 0) & (w < 0.3) & (wo <= 0.1), "D")
        .otherwise("E")
    )


def pattern_strict(w: Column, wo: Column) -> Column:
    """As ``pattern_of`` with leakage (B) held to clear cases."""
    vd = w - wo
    return (
        F.when(w.isNull() | wo.isNull(), "_invalid")
        .when((w == 0) & (wo == 0), "A")
        .when((wo >= 0.7) & (w <= 0.3) & (vd <= -0.4), "B")
        .when((w >= 0.5) & (vd > 0.3), "C")
        .when((w > 0) & (w < 0.3) & (wo <= 0.1), "D")
        .otherwise("E")
    )


def sample_filter(steps: DataFrame, keys: list[str], w: str, wo: str) -> DataFrame:
    """Keep or drop verdict per sample; missing step values count as 0."""
    per = steps.groupBy(*keys).agg(
        F.max(or_zero(F.col(w))).alias("w_max"),
        F.min(or_zero(F.col(w))).alias("w_min"),
        F.max(or_zero(F.col(wo))).alias("wo_max"),
        F.count(F.lit(1)).alias("n_steps"),
        F.count(w).alias("n_values"),
    )
    return per.withColumn(
        "verdict",
        F.when((F.col("w_max") == 0) & (F.col("wo_max") == 0), "drop_hard_impossible")
        .when((F.col("wo_max") >= 0.5) & (F.col("w_max") < F.col("wo_max") + 0.1), "drop_leakage")
        .when((F.col("w_max") == 1) & (F.col("w_min") >= 0.8), "drop_trivial")
        .otherwise("keep"),
    )


def percent(condition: Column, of: Column | None = None) -> Column:
    """Percentage of the rows in ``of`` (default all) that meet the condition; 0 without rows."""
    base = F.count(F.lit(1)) if of is None else F.count_if(of)
    return F.round(100.0 * F.count_if(condition) / F.greatest(base, F.lit(1)), 6)


def advantage(w: Column, vd: Column, weight: float = 1.0, baseline: float = 0.5) -> dict[str, Column]:
    """Positive advantages are scaled by the input dependence, negative ones stay."""
    base = w - baseline
    modulation = F.when(base > 0, F.greatest(F.lit(0.2), 1.0 + weight * vd)).otherwise(1.0)
    return {"base_adv": base, "modulation": modulation, "final_adv": base * modulation}


def vd_statistics(vd: Column) -> list[Column]:
    known = vd.isNotNull()
    return [
        F.count(vd).alias("n_vd"),
        F.round(F.coalesce(F.avg(vd), F.lit(0.0)), 6).alias("vd_mean"),
        F.round(pstd(vd), 6).alias("vd_std"),
        percent(F.abs(vd) > 0.3, known).alias("vd_informative_pct"),
        percent(vd < -0.1, known).alias("vd_negative_pct"),
        percent(vd > 0.1, known).alias("vd_positive_pct"),
    ]
