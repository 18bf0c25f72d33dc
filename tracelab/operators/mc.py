"""Monte-Carlo step values, step reward designs and rollout-group signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.scale import exact_mean

EPS = 1e-9
GROUP_EPS = 1e-6


def pstd(value: Column) -> Column:
    """Population standard deviation; fewer than two values give 0."""
    return F.coalesce(F.when(F.count(value) >= 2, F.stddev_pop(value)), F.lit(0.0))


def or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def step_values(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Early form (a failed continuation scores 0, true variance) next to the later one
    (failed continuations dropped, population std)."""
    early = or_zero(F.col(score))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_continuations"),
        F.count(score).alias("n_valid"),
        F.round(F.avg(early), 6).alias("mean_early"),
        F.round(F.var_pop(early), 6).alias("var_early"),
        F.round(F.avg(score), 6).alias("mc_value"),
        F.round(pstd(F.col(score).cast("double")), 6).alias("mc_std"),
    )


def validate_trajectories(steps: DataFrame, keys: list[str], sample: str, step: str, score: str) -> DataFrame:
    """Do step values separate right from wrong trajectories? Five checks, three to pass."""
    s = or_zero(F.col(score))
    spread = F.stddev_pop(s)
    fit = F.try_divide(F.covar_pop(F.col(step).cast("double"), s), F.stddev_pop(F.col(step).cast("double")) * F.when(spread > EPS, spread))
    per = steps.groupBy(*keys, sample).agg(
        F.max_by(s, F.col(step)).alias("_last"),
        exact_mean(s).alias("_mean"),
        F.count(F.lit(1)).alias("_n"),
        F.when(F.count(F.lit(1)) >= 3, F.coalesce(fit, F.lit(0.0))).alias("_slope"),
        F.count_if(s == 0.0).alias("_zero"),
        F.count_if(s == 1.0).alias("_one"),
    )
    right = F.col("_last") >= 0.5
    mean = lambda cond, c: exact_mean(F.when(cond, F.col(c)))
    total = F.sum("_n")
    report = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(mean(right, "_mean"), 6).alias("correct_avg"),
        F.round(mean(~right, "_mean"), 6).alias("wrong_avg"),
        F.round(F.coalesce(mean(right, "_slope"), F.lit(0.0)), 6).alias("correct_slope"),
        F.round(F.coalesce(mean(~right, "_slope"), F.lit(0.0)), 6).alias("wrong_slope"),
        F.round((F.sum("_zero") + F.sum("_one")) / total, 6).alias("bimodal_rate"),
        F.round(1 - (F.sum("_zero") + F.sum("_one")) / total, 6).alias("mid_rate"),
    )
    checks = [
        (or_zero(F.col("correct_avg")) - or_zero(F.col("wrong_avg"))) >= 0.20,
        F.col("correct_slope") > 0,
        F.col("wrong_slope") <= 0.05,
        F.col("bimodal_rate") >= 0.30,
        F.col("mid_rate") >= 0.15,
    ]
    passed = sum(c.cast("int") for c in checks)
    return report.withColumn("passed", passed).withColumn(
        "verdict", F.when(F.col("passed") >= 3, "PASS").otherwise("FAIL")
    )


def zone(std: Column, mean: Column, perception: Column) -> Column:
    """Where does a step carry signal: step value, perception, both or neither."""
    mc_live = F.coalesce(std > 0.1, F.lit(False))
    perc_live = F.coalesce((perception > 0.05) & (perception < 0.95), F.lit(False))
    mc_dead = std.isNull() | (std < EPS)
    return (
        F.when(mc_live & perc_live, "both_informative")
        .when(mc_dead & perc_live & (mean == 1), "mc_ceiling_perc_var")
        .when(mc_dead & perc_live, "mc_dead_perc_var")
        .when(mc_live & ~perc_live, "mc_var_perc_sat")
        .otherwise("both_silent")
    )


def step_designs(std: Column, mean: Column, perception: Column, outcome: Column) -> dict[str, Column]:
    """Step reward under each design."""
    half = 0.5 * or_zero(outcome) + 0.5 * or_zero(perception)
    return {
        "R_out": or_zero(outcome),
        "R_add": half,
        "R_A": F.when(std > 0.1, mean)
        .when(mean == 0, 0.3 * or_zero(perception))
        .when(mean == 1, F.lit(1.0))
        .otherwise(F.lit(0.0)),
        "R_B": half,
        "R_C": F.when(perception >= 0.7, perception).otherwise(or_zero(mean)),
        "R_D": F.when(std > 0, mean).when(outcome == 1, F.lit(1.0)).otherwise(or_zero(perception)),
    }


def as_designs(rows: DataFrame, designs: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per design: (kept columns, design, reward)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("design"), c.cast("double").alias("reward")) for n, c in designs.items()])
    return rows.select(*keep, F.explode(pairs).alias("_d")).select(*keep, "_d.design", "_d.reward")


def design_variance(designs: DataFrame, sample_keys: list[str], group: str) -> DataFrame:
    """Share of samples whose step rewards differ at all, per design and group."""
    per = designs.groupBy(*sample_keys, group, "design").agg(pstd(F.col("reward")).alias("std"))
    return per.groupBy("design", group).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("std") > EPS).alias("n_varied"),
        F.round(F.avg((F.col("std") > EPS).cast("double")), 6).alias("share_varied"),
        F.round(F.avg("std"), 6).alias("mean_std"),
    )


def axis_map(names: list[str], values: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(v) for v in values]))


def axis_mean(axes: Column) -> Column:
    """Mean of the non-null verdicts of an axis map, null when there is none."""
    known = F.filter(F.map_values(axes), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0), lambda acc, v: acc + v)
    return F.try_divide(total.cast("double"), F.size(known))


def any_no(axes: Column) -> Column:
    return F.exists(F.map_values(axes), lambda v: F.coalesce(v == 0, F.lit(False)))


def no_gate(mean: Column, axes: Column) -> Column:
    return or_zero(mean) * F.when(any_no(axes), 0.3).otherwise(1.0)


def gated_sample_reward(steps: DataFrame, keys: list[str], step: str, perception: str, mean: str) -> DataFrame:
    """Perception gates the step value; the first two steps weigh 1.5."""
    p = F.col(perception)
    reward = p * F.when(p < 0.5, 0.0).otherwise(F.col(mean))
    weight = F.when(reward.isNotNull(), F.when(F.col(step) < 2, 1.5).otherwise(1.0))
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count(reward).alias("n_rewarded"),
        F.round(F.try_divide(F.sum(weight * reward), F.sum(weight)), 6).alias("sample_reward"),
    )


def group_std(rollouts: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of each reward over a prompt's rollouts; prompts lacking either signal are dropped."""
    o, p = F.col("outcome").cast("double"), F.col("perception")
    mix = lambda a: pstd(a * p + (1 - a) * o)
    return (
        rollouts.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_rollouts"),
            pstd(o).alias("std_out"),
            pstd(p).alias("std_per"),
            pstd(p * o).alias("std_mult"),
            mix(0.3).alias("std_add30"),
            mix(0.5).alias("std_add50"),
            mix(0.7).alias("std_add70"),
            F.avg(o).alias("out_mean"),
            F.count(o).alias("_o"),
            F.count(p).alias("_p"),
            F.sum(F.when(F.col("step_std") > 0, F.col("step_std"))).alias("step_std_sum"),
            F.count_if(F.col("step_std") > 0).alias("step_std_n"),
        )
        .where("_o > 0 AND _p > 0")
        .drop("_o", "_p")
    )


SIGNALS = ["std_out", "std_per", "std_mult", "std_add30", "std_add50", "std_add70"]


def zero_signal(groups: DataFrame, bench: str) -> DataFrame:
    """Share of prompts without any spread, per bench and over all."""
    dead = [
        F.round(F.avg((F.col(c) < GROUP_EPS).cast("double")), 6).alias(c.replace("std_", "fzs_")) for c in SIGNALS
    ]
    return (
        groups.rollup(bench)
        .agg(
            F.count(F.lit(1)).alias("n_prompts"),
            *dead,
            F.round(F.avg("out_mean"), 6).alias("mean_outcome"),
            F.round(F.coalesce(F.try_divide(F.sum("step_std_sum"), F.sum("step_std_n")), F.lit(0.0)), 6).alias(
                "mean_step_std"
            ),
        )
        .withColumn(bench, F.coalesce(F.col(bench), F.lit("ALL")))
    )
