"""Queries on step values and rollout-group signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import mc as M
from tracelab.operators.scale import exact_mean, exact_quantiles
from tracelab.plans.registry import mean9, query, r6
from tracelab.sources.fixtures import table, view

CATEGORY = (
    "CASE WHEN group_id % 5 = 0 THEN 'correct_consistent' WHEN group_id % 5 = 1 THEN 'wrong_consistent' ELSE 'mixed' END"
)
MC_STD = "CASE WHEN mc_with IS NOT NULL THEN sqrt(mc_with * (1 - mc_with)) END"


def std0(expr: str) -> str:
    return f"coalesce(CASE WHEN count({expr}) >= 2 THEN stddev_pop({expr}) END, 0.0)"


STEP_ROWS_SQL = f""", st AS (SELECT r.group_id, r.k, r.bench, r.model, {CATEGORY.replace('group_id', 'r.group_id')} AS category,
 mc_with AS mc_value, {MC_STD} AS mc_std, perception, outcome
 FROM rollouts r JOIN steps s ON r.group_id = s.sample_id AND r.k = s.k)"""


def step_rows(spark, sf):
    """Step value, its spread, perception and outcome per step: step table joined to rollout table."""
    rolls = view(spark, sf, "rollouts")
    steps = view(spark, sf, "steps").selectExpr(
        "sample_id AS group_id", "k", "mc_with AS mc_value", f"{MC_STD} AS mc_std"
    )
    return rolls.join(steps, ["group_id", "k"]).withColumn("category", F.expr(CATEGORY))


@query(
    "mc_step_value",
    "rollouts",
    f"""SELECT group_id, count(*) AS n_continuations, count(outcome) AS n_valid, {r6('avg(coalesce(outcome, 0))')} AS mean_early,
 {r6('var_pop(coalesce(outcome, 0))')} AS var_early, {r6('avg(outcome)')} AS mc_value, {r6(std0('outcome'))} AS mc_std
 FROM rollouts GROUP BY group_id""",
)
def mc_step_value(spark, sf):
    return M.step_values(view(spark, sf, "rollouts"), ["group_id"], "outcome")


@query(
    "mc_validate",
    "steps",
    f""", s AS (SELECT bench, model, sample_id, k, coalesce(mc_with, 0) AS s FROM steps),
per AS (SELECT bench, model, sample_id, max_by(s, k) AS last, {mean9('s')} AS mean, count(*) AS n,
 CASE WHEN count(*) >= 3 THEN CASE WHEN stddev_pop(s) > 1e-9 THEN corr(k, s) ELSE 0 END END AS slope,
 count(*) FILTER (WHERE s = 0) AS z, count(*) FILTER (WHERE s = 1) AS o FROM s GROUP BY bench, model, sample_id),
rep AS (SELECT bench, model, count(*) AS n_samples, {r6(mean9('CASE WHEN last >= 0.5 THEN mean END'))} AS correct_avg,
 {r6(mean9('CASE WHEN last < 0.5 THEN mean END'))} AS wrong_avg, {r6(f"coalesce({mean9('CASE WHEN last >= 0.5 THEN slope END')}, 0)")} AS correct_slope,
 {r6(f"coalesce({mean9('CASE WHEN last < 0.5 THEN slope END')}, 0)")} AS wrong_slope, {r6('(sum(z) + sum(o)) / sum(n)')} AS bimodal_rate,
 {r6('1 - (sum(z) + sum(o)) / sum(n)')} AS mid_rate FROM per GROUP BY bench, model),
p AS (SELECT *, CAST(coalesce(correct_avg, 0) - coalesce(wrong_avg, 0) >= 0.2 AS INT) + CAST(correct_slope > 0 AS INT)
 + CAST(wrong_slope <= 0.05 AS INT) + CAST(bimodal_rate >= 0.3 AS INT) + CAST(mid_rate >= 0.15 AS INT) AS passed FROM rep)
SELECT *, CASE WHEN passed >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p""",
)
def mc_validate(spark, sf):
    return M.validate_trajectories(view(spark, sf, "steps"), ["bench", "model"], "sample_id", "k", "mc_with")


ZONE_SQL = """CASE WHEN coalesce(mc_std > 0.1, FALSE) AND coalesce(perception > 0.05 AND perception < 0.95, FALSE) THEN 'both_informative'
 WHEN (mc_std IS NULL OR mc_std < 1e-9) AND coalesce(perception > 0.05 AND perception < 0.95, FALSE)
 THEN CASE WHEN mc_value = 1 THEN 'mc_ceiling_perc_var' ELSE 'mc_dead_perc_var' END
 WHEN coalesce(mc_std > 0.1, FALSE) THEN 'mc_var_perc_sat' ELSE 'both_silent' END"""


def zoned(spark, sf):
    rows = step_rows(spark, sf)
    return rows.withColumn("zone", M.zone(F.col("mc_std"), F.col("mc_value"), F.col("perception")))


@query(
    "mc_zone",
    ("rollouts", "steps"),
    STEP_ROWS_SQL + f" SELECT bench, model, {ZONE_SQL} AS zone, count(*) AS n FROM st GROUP BY ALL",
)
def mc_zone(spark, sf):
    return zoned(spark, sf).groupBy("bench", "model", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mc_zone_by_category",
    ("rollouts", "steps"),
    STEP_ROWS_SQL
    + f""", z AS (SELECT *, {ZONE_SQL} AS zone FROM st)
SELECT coalesce(zone, 'ALL') AS zone, coalesce(category, 'ALL') AS category, count(*) AS n,
 {r6('avg(CASE WHEN mc_std > 1e-9 THEN 1.0 ELSE 0.0 END)')} AS share_varied,
 {r6('avg(CASE WHEN mc_value = 0 OR mc_value IS NULL THEN 1.0 ELSE 0.0 END)')} AS share_dead,
 {r6('min(CASE WHEN mc_value = 0 OR mc_value IS NULL THEN perception END)')} AS dead_perc_min,
 {r6('median(CASE WHEN mc_value = 0 OR mc_value IS NULL THEN perception END)')} AS dead_perc_median,
 {r6('max(CASE WHEN mc_value = 0 OR mc_value IS NULL THEN perception END)')} AS dead_perc_max
FROM z GROUP BY CUBE (zone, category)""",
)
def mc_zone_by_category(spark, sf):
    dead = (F.col("mc_value") == 0) | F.col("mc_value").isNull()
    perc = F.when(dead, F.col("perception"))
    # reduce to distinct step states first: the cube then expands a small table
    states = zoned(spark, sf).groupBy("zone", "category", "mc_value", "mc_std", "perception").agg(
        F.count(F.lit(1)).alias("w")
    )
    w = F.col("w")
    part = lambda cond: F.round(F.sum(F.when(cond, w).otherwise(0)) / F.sum(w), 6)
    named = {"zone": F.coalesce("zone", F.lit("ALL")), "category": F.coalesce("category", F.lit("ALL"))}
    rows = (
        states.cube("zone", "category")
        .agg(
            F.sum(w).alias("n"),
            part(F.col("mc_std") > M.EPS).alias("share_varied"),
            part(dead).alias("share_dead"),
            F.round(F.min(perc), 6).alias("dead_perc_min"),
            F.round(F.max(perc), 6).alias("dead_perc_max"),
        )
        .withColumns(named)
    )
    # the medians of the same groups by histogram, so that no group's values are held
    whole = lambda c: F.array(F.col(c), F.lit("ALL"))
    levels = states.where(dead).withColumn("zone", F.explode(whole("zone"))).withColumn("category", F.explode(whole("category")))
    medians = exact_quantiles(levels, ["zone", "category"], "perception", {"dead_perc_median": 0.5}, weight="w", low=0.0, high=1.0)
    medians = medians.withColumn("dead_perc_median", F.round("dead_perc_median", 6))
    return rows.join(medians, ["zone", "category"], "left")


HALF_SQL = "(0.5 * coalesce(outcome, 0) + 0.5 * coalesce(perception, 0))"
DESIGN_SQL = {
    "R_out": "coalesce(outcome, 0)",
    "R_add": HALF_SQL,
    "R_A": "CASE WHEN mc_std > 0.1 THEN mc_value WHEN mc_value = 0 THEN 0.3 * coalesce(perception, 0) WHEN mc_value = 1 THEN 1 ELSE 0 END",
    "R_B": HALF_SQL,
    "R_C": "CASE WHEN perception >= 0.7 THEN perception ELSE coalesce(mc_value, 0) END",
    "R_D": "CASE WHEN mc_std > 0 THEN mc_value WHEN outcome = 1 THEN 1 ELSE coalesce(perception, 0) END",
}


def designs_sql(designs: dict[str, str], source: str, keep: str) -> str:
    parts = [f"SELECT {keep}, '{n}' AS design, CAST({e} AS DOUBLE) AS reward FROM {source}" for n, e in designs.items()]
    return " UNION ALL ".join(parts)


def mc_designs(spark, sf):
    cols = [F.col(c) for c in ("mc_std", "mc_value", "perception", "outcome")]
    return M.as_designs(step_rows(spark, sf), M.step_designs(*cols), ["group_id", "k", "category"])


@query(
    "mc_step_designs",
    ("rollouts", "steps"),
    STEP_ROWS_SQL
    + f""", d AS ({designs_sql(DESIGN_SQL, 'st', 'group_id, k, category')})
SELECT design, category, count(*) AS n, {r6('avg(reward)')} AS mean_reward, count(*) FILTER (WHERE reward > 0) AS n_positive,
 {r6('max(reward)')} AS max_reward FROM d GROUP BY design, category""",
)
def mc_step_designs(spark, sf):
    return (
        mc_designs(spark, sf)
        .groupBy("design", "category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("reward"), 6).alias("mean_reward"),
            F.count_if(F.col("reward") > 0).alias("n_positive"),
            F.round(F.max("reward"), 6).alias("max_reward"),
        )
    )


AXES = ["ax_value", "ax_label", "ax_count", "ax_structure"]
AXIS_NAMES = ["VALUE", "LABEL", "COUNT", "STRUCTURE"]
NO_SQL = "(" + " OR ".join(f"coalesce({a} = 0, FALSE)" for a in AXES) + ")"
AXIS_MEAN_SQL = (
    "(CAST(" + " + ".join(f"coalesce({a}, 0)" for a in AXES) + " AS DOUBLE) / nullif("
    + " + ".join(f"CAST({a} IS NOT NULL AS INT)" for a in AXES) + ", 0))"
)
AXIS_STEP_SQL = f""", ax AS (SELECT a.*, {AXIS_MEAN_SQL} AS step_perception, mc_with AS mc_value, {MC_STD} AS mc_std,
 {CATEGORY} AS category FROM axes a JOIN steps s ON a.group_id = s.sample_id AND a.k = s.k)"""


def axis_steps(spark, sf):
    axes = view(spark, sf, "axes").withColumn("axes", M.axis_map(AXIS_NAMES, AXES))
    steps = view(spark, sf, "steps").selectExpr(
        "sample_id AS group_id", "k", "mc_with AS mc_value", f"{MC_STD} AS mc_std"
    )
    return (
        axes.join(steps, ["group_id", "k"])
        .withColumn("step_perception", M.axis_mean(F.col("axes")))
        .withColumn("category", F.expr(CATEGORY))
    )


@query(
    "mc_no_gate",
    ("axes", "steps"),
    AXIS_STEP_SQL
    + f""" SELECT bench, category, count(*) AS n, count(*) FILTER (WHERE {NO_SQL}) AS n_gated,
 {r6('avg(coalesce(mc_value, 0))')} AS mean_value, {r6(f'avg(coalesce(mc_value, 0) * CASE WHEN {NO_SQL} THEN 0.3 ELSE 1.0 END)')} AS mean_gated
 FROM ax GROUP BY bench, category""",
)
def mc_no_gate(spark, sf):
    return (
        axis_steps(spark, sf)
        .groupBy("bench", "category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(M.any_no(F.col("axes"))).alias("n_gated"),
            F.round(F.avg(M.or_zero(F.col("mc_value"))), 6).alias("mean_value"),
            F.round(F.avg(M.no_gate(F.col("mc_value"), F.col("axes"))), 6).alias("mean_gated"),
        )
    )


@query(
    "mc_design_variance",
    ("rollouts", "steps"),
    STEP_ROWS_SQL
    + f""", d AS ({designs_sql(DESIGN_SQL, 'st', 'group_id, k, category')}),
per AS (SELECT group_id, category, design, {std0('reward')} AS std FROM d GROUP BY ALL)
SELECT design, category, count(*) AS n_samples, count(*) FILTER (WHERE std > 1e-9) AS n_varied,
 {r6('avg(CASE WHEN std > 1e-9 THEN 1.0 ELSE 0.0 END)')} AS share_varied, {r6('avg(std)')} AS mean_std FROM per GROUP BY design, category""",
)
def mc_design_variance(spark, sf):
    return M.design_variance(mc_designs(spark, sf), ["group_id"], "category")


@query(
    "mc_gated_step_reward",
    ("axes", "steps"),
    AXIS_STEP_SQL
    + f""", r AS (SELECT group_id, k, step_perception * CASE WHEN step_perception < 0.5 THEN 0 ELSE mc_value END AS r FROM ax),
w AS (SELECT *, CASE WHEN r IS NOT NULL THEN CASE WHEN k < 2 THEN 1.5 ELSE 1.0 END END AS w FROM r)
SELECT group_id, count(*) AS n_steps, count(r) AS n_rewarded, {r6('sum(w * r) / sum(w)')} AS sample_reward FROM w GROUP BY group_id""",
)
def mc_gated_step_reward(spark, sf):
    return M.gated_sample_reward(axis_steps(spark, sf), ["group_id"], "k", "step_perception", "mc_value")


# Prompts are customers, their orders the rollouts and the order lines the steps of a rollout.
PROMPT_BENCH = "CASE prompt_id % 3 WHEN 0 THEN 'bench_a' WHEN 1 THEN 'bench_b' ELSE 'bench_c' END"
SIGNAL_SQL = f""", ax AS (SELECT *, {AXIS_MEAN_SQL} AS step_perception FROM axes),
pr AS (SELECT group_id, {mean9('step_perception')} AS perception, count(*) AS n_steps, {std0('step_perception')} AS step_std FROM ax GROUP BY group_id),
ro AS (SELECT o_custkey AS prompt_id, pr.group_id, pr.perception, outcome, n_steps, step_std, pr.perception * outcome AS combined
 FROM pr JOIN orders ON o_orderkey = pr.group_id JOIN rollouts r ON r.group_id = pr.group_id AND r.k = 0),
g AS (SELECT prompt_id, {PROMPT_BENCH} AS bench, count(*) AS n_rollouts, {std0('outcome')} AS std_out, {std0('perception')} AS std_per,
 {std0('perception * outcome')} AS std_mult, {std0('0.3 * perception + 0.7 * outcome')} AS std_add30,
 {std0('0.5 * perception + 0.5 * outcome')} AS std_add50, {std0('0.7 * perception + 0.3 * outcome')} AS std_add70,
 avg(outcome) AS out_mean, sum(step_std) FILTER (WHERE step_std > 0) AS step_std_sum, count(*) FILTER (WHERE step_std > 0) AS step_std_n
 FROM ro GROUP BY prompt_id HAVING count(outcome) > 0 AND count(perception) > 0)"""


def rollout_perception(spark, sf):
    """Perception per rollout (mean of its step means), joined to its prompt and outcome."""
    per = (
        view(spark, sf, "axes")
        .select("group_id", M.axis_mean(M.axis_map(AXIS_NAMES, AXES)).alias("p"))
        .groupBy("group_id")
        .agg(exact_mean(F.col("p")).alias("perception"), F.count(F.lit(1)).alias("n_steps"), M.pstd(F.col("p")).alias("step_std"))
    )
    prompts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("prompt_id"))
    outcome = view(spark, sf, "rollouts").where("k = 0").select("group_id", "outcome")
    return (
        per.join(prompts, "group_id")
        .join(outcome, "group_id")
        .withColumn("combined", F.col("perception") * F.col("outcome"))
    )


def signal_groups(spark, sf):
    rolls = rollout_perception(spark, sf).withColumn("bench", F.expr(PROMPT_BENCH))
    return M.group_std(rolls, ["prompt_id", "bench"])


@query(
    "sg_rollout_perception",
    ("axes", "rollouts"),
    SIGNAL_SQL
    + f" SELECT prompt_id, group_id, {r6('perception')} AS perception, outcome, {r6('combined')} AS combined, n_steps, {r6('step_std')} AS step_std FROM ro",
)
def sg_rollout_perception(spark, sf):
    return rollout_perception(spark, sf).select(
        "prompt_id",
        "group_id",
        F.round("perception", 6).alias("perception"),
        "outcome",
        F.round("combined", 6).alias("combined"),
        "n_steps",
        F.round("step_std", 6).alias("step_std"),
    )


@query(
    "sg_group_std",
    ("axes", "rollouts"),
    SIGNAL_SQL
    + " SELECT prompt_id, bench, n_rollouts, "
    + ", ".join(f"{r6(c)} AS {c}" for c in [*M.SIGNALS, "out_mean"])
    + " FROM g",
)
def sg_group_std(spark, sf):
    return signal_groups(spark, sf).select(
        "prompt_id", "bench", "n_rollouts", *[F.round(c, 6).alias(c) for c in [*M.SIGNALS, "out_mean"]]
    )


@query(
    "sg_zero_signal",
    ("axes", "rollouts"),
    SIGNAL_SQL
    + " SELECT coalesce(bench, 'ALL') AS bench, count(*) AS n_prompts, "
    + ", ".join(f"{r6(f'avg(CASE WHEN {c} < 1e-6 THEN 1.0 ELSE 0.0 END)')} AS {c.replace('std_', 'fzs_')}" for c in M.SIGNALS)
    + f", {r6('avg(out_mean)')} AS mean_outcome, {r6('coalesce(sum(step_std_sum) / sum(step_std_n), 0)')} AS mean_step_std FROM g GROUP BY ROLLUP (bench)",
)
def sg_zero_signal(spark, sf):
    return M.zero_signal(signal_groups(spark, sf), "bench")


@query(
    "sg_rescues_and_dead",
    ("axes", "rollouts"),
    SIGNAL_SQL
    + f""" SELECT * FROM (SELECT 'rescued' AS kind, prompt_id, {r6('std_add50')} AS std_add50 FROM g
 WHERE std_out < 1e-6 AND std_add50 >= 0.05)
UNION ALL SELECT * FROM (SELECT 'dead' AS kind, prompt_id, {r6('std_add50')} AS std_add50 FROM g
 WHERE std_out < 1e-6 AND std_per < 1e-6 AND std_add50 < 1e-6)""",
)
def sg_rescues_and_dead(spark, sf):
    groups = signal_groups(spark, sf)
    low = lambda c: F.col(c) < M.GROUP_EPS
    show = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "prompt_id", F.round("std_add50", 6).alias("std_add50"))
    rescued = groups.where(low("std_out") & (F.col("std_add50") >= 0.05))
    dead = groups.where(low("std_out") & low("std_per") & low("std_add50"))
    return show("rescued", rescued).unionByName(show("dead", dead))
