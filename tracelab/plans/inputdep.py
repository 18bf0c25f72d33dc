"""Queries on input dependence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import inputdep as D
from tracelab.operators import mc as M
from tracelab.operators.scale import exact_quantiles
from tracelab.plans.mc import CATEGORY, designs_sql, std0
from tracelab.plans.registry import query, r6
from tracelab.sources.fixtures import view

CAT = CATEGORY.replace("group_id", "sample_id")
RTYPE = (
    "CASE WHEN sample_id % 7 < 3 THEN 'visual' WHEN sample_id % 7 < 5 THEN 'text' ELSE 'unknown' END"
)


def cols():
    return F.col("mc_with"), F.col("mc_without"), F.col("vd")


def paired(spark, sf):
    w, wo, vd = cols()
    return view(spark, sf, "steps").withColumn("vd", w - wo)


VD_SQL = ", vd AS (SELECT *, mc_with - mc_without AS vd FROM steps)"

# Continuations of a step, one per order line: supplier and line number name the step, the part the arm, the quantity the outcome
# (null where the discount says that the continuation failed).
ARMS = [
    "l_suppkey AS sample_id", "l_linenumber AS k", "CASE WHEN l_partkey % 2 = 0 THEN 'with' ELSE 'without' END AS arm",
    "CASE WHEN disc = 10 THEN NULL WHEN qty <= 25 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ok",
]
ARMS_SQL = f", arms AS (SELECT {', '.join(ARMS)} FROM lines)"


@query(
    "vd_paired_value",
    "lines",
    ARMS_SQL
    + f""" SELECT sample_id, k, {r6("avg(ok) FILTER (WHERE arm = 'with')")} AS mc_value, {r6("avg(ok) FILTER (WHERE arm = 'without')")} AS mc_without_value,
 {r6(std0("CASE WHEN arm = 'with' THEN ok END"))} AS mc_std, {r6(std0("CASE WHEN arm = 'without' THEN ok END"))} AS mc_without_std,
 {r6("avg(ok) FILTER (WHERE arm = 'with') - avg(ok) FILTER (WHERE arm = 'without')")} AS vd FROM arms GROUP BY sample_id, k""",
)
def vd_paired_value(spark, sf):
    arms = view(spark, sf, "lines").selectExpr(*ARMS)
    ok = lambda arm: F.when(F.col("arm") == arm, F.col("ok"))
    mean_w, mean_wo = F.avg(ok("with")), F.avg(ok("without"))
    return arms.groupBy("sample_id", "k").agg(
        F.round(mean_w, 6).alias("mc_value"),
        F.round(mean_wo, 6).alias("mc_without_value"),
        F.round(M.pstd(ok("with")), 6).alias("mc_std"),
        F.round(M.pstd(ok("without")), 6).alias("mc_without_std"),
        F.round(mean_w - mean_wo, 6).alias("vd"),
    )


def pct(cond: str, base: str = "count(*)") -> str:
    return r6(f"100.0 * count(*) FILTER (WHERE {cond}) / greatest({base}, 1)")


CASES = ["case1_self_sufficient", "case2_input_critical", "case3_bad_prefix", "case4_perception_fail"]
CASE_SQL = """CASE WHEN mc_with IS NULL OR vd IS NULL THEN 'missing' WHEN mc_with >= 0.7 AND vd < 0.2 THEN 'case1_self_sufficient'
 WHEN mc_with >= 0.7 THEN 'case2_input_critical' WHEN vd < 0.2 THEN 'case3_bad_prefix' ELSE 'case4_perception_fail' END"""


@query(
    "vd_case",
    "steps",
    VD_SQL
    + f""", c AS (SELECT *, {CASE_SQL} AS cs FROM vd),
a AS (SELECT bench, model, count(*) AS n_steps, {r6(std0('vd'))} AS vd_std, {", ".join(f"{pct(f'cs = {c!r}')} AS {c}" for c in CASES)},
 {", ".join(f"count(*) FILTER (WHERE vd >= {lo} AND vd < {hi}) AS bin_{n}" for lo, hi, n in D.VD_BINS)},
 count(*) FILTER (WHERE mc_with = 0) AS n_dead, count(*) FILTER (WHERE mc_with = 0 AND vd > 0.2) AS n_dead_recoverable,
 count(*) FILTER (WHERE mc_with = 0 AND vd < -0.1) AS n_dead_misled FROM c GROUP BY bench, model)
SELECT *, vd_std >= 0.15 AS spread_ok, {" AND ".join(f"{c} >= 10" for c in CASES)} AS cells_ok, n_dead_recoverable >= 10 AS recovery_ok FROM a""",
)
def vd_case(spark, sf):
    w, wo, vd = cols()
    rows = paired(spark, sf).withColumn("cs", D.case_of(w, vd))
    dead = w == 0
    report = rows.groupBy("bench", "model").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.round(M.pstd(vd), 6).alias("vd_std"),
        *[D.percent(F.col("cs") == c).alias(c) for c in CASES],
        *[F.count_if((vd >= lo) & (vd < hi)).alias(f"bin_{name}") for lo, hi, name in D.VD_BINS],
        F.count_if(dead).alias("n_dead"),
        F.count_if(dead & (vd > 0.2)).alias("n_dead_recoverable"),
        F.count_if(dead & (vd < -0.1)).alias("n_dead_misled"),
    )
    cells_ok = F.lit(True)
    for c in CASES:
        cells_ok = cells_ok & (F.col(c) >= 10)
    return report.withColumns(
        {
            "spread_ok": F.col("vd_std") >= 0.15,
            "cells_ok": cells_ok,
            "recovery_ok": F.col("n_dead_recoverable") >= 10,
        }
    )


BONUS = """WHEN mc_with >= 0.7 THEN mc_with * (1 + 0.3 * (1 - vd)) WHEN mc_with = 0 THEN CASE WHEN vd < 0.2 THEN 0.0 ELSE 0.1 END ELSE mc_with END"""
REWARD_SQL = {
    "R_out": "CASE WHEN category = 'wrong_consistent' THEN 0 ELSE 1 END",
    "R_MC": "mc_with",
    "R_bonus": "CASE WHEN mc_with IS NULL OR mc_without IS NULL THEN 0.0 " + BONUS,
    "R_bonus_plus": "CASE WHEN mc_with IS NULL OR mc_without IS NULL THEN 0.0 WHEN vd <= -0.3 THEN -0.2 " + BONUS,
}


@query(
    "vd_reward",
    "steps",
    VD_SQL
    + f""", c AS (SELECT *, {CAT} AS category FROM vd WHERE mc_with IS NOT NULL AND mc_without IS NOT NULL),
d AS ({designs_sql(REWARD_SQL, 'c', 'sample_id, category')}),
per AS (SELECT sample_id, category, design, {std0('reward')} AS std FROM d GROUP BY ALL)
SELECT design, category, count(*) AS n_samples, count(*) FILTER (WHERE std > 1e-9) AS n_varied,
 {r6('avg(CASE WHEN std > 1e-9 THEN 1.0 ELSE 0.0 END)')} AS share_varied, {r6('avg(std)')} AS mean_std FROM per GROUP BY design, category""",
)
def vd_reward(spark, sf):
    w, wo, vd = cols()
    rows = paired(spark, sf).where(w.isNotNull() & wo.isNotNull()).withColumn("category", F.expr(CAT))
    designs = {
        "R_out": F.when(F.col("category") == "wrong_consistent", 0).otherwise(1),
        "R_MC": w,
        "R_bonus": D.bonus_reward(w, wo),
        "R_bonus_plus": D.bonus_reward(w, wo, penalise=True),
    }
    return M.design_variance(M.as_designs(rows, designs, ["sample_id", "category"]), ["sample_id"], "category")


PATTERN_SQL = """CASE WHEN mc_with IS NULL OR mc_without IS NULL THEN '_invalid' WHEN mc_with = 0 AND mc_without = 0 THEN 'A'
 WHEN {b} THEN 'B' WHEN mc_with >= 0.5 AND vd > 0.3 THEN 'C' WHEN mc_with > 0 AND mc_with < 0.3 AND mc_without <= 0.1 THEN 'D' ELSE 'E' END"""
PATTERN_V1 = PATTERN_SQL.format(b="mc_without >= 0.5 AND vd < 0")
PATTERN_V2 = PATTERN_SQL.format(b="mc_without >= 0.7 AND mc_with <= 0.3 AND vd <= -0.4")


@query(
    "vd_pattern",
    "steps",
    VD_SQL + f" SELECT bench, model, {PATTERN_V1} AS pattern, count(*) AS n FROM vd GROUP BY ALL",
)
def vd_pattern(spark, sf):
    w, wo, vd = cols()
    rows = paired(spark, sf).withColumn("pattern", D.pattern_of(w, wo))
    return rows.groupBy("bench", "model", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vd_pattern_v2",
    "steps",
    VD_SQL
    + f""", l AS (SELECT *, max(k) OVER (PARTITION BY sample_id) AS last_k FROM vd),
c AS (SELECT *, {PATTERN_V1} AS p1, {PATTERN_V2} AS p2, k = last_k AS terminal FROM l WHERE mc_with IS NOT NULL AND mc_without IS NOT NULL),
a AS (SELECT bench, model, count(*) AS n_old, count(*) FILTER (WHERE NOT terminal) AS n_new, count(*) FILTER (WHERE terminal) AS n_terminal_skipped,
 {pct("p1 IN ('B', 'C', 'D')")} AS informative_old, {pct("NOT terminal AND p2 IN ('B', 'C', 'D')", "count(*) FILTER (WHERE NOT terminal)")} AS informative_new,
 {", ".join(f"{pct(f'p1 = {p!r}')} AS old_{p.lower()}, {pct(f'NOT terminal AND p2 = {p!r}', 'count(*) FILTER (WHERE NOT terminal)')} AS new_{p.lower()}" for p in "ABCDE")}
 FROM c GROUP BY bench, model) SELECT *, {r6('new_c - old_c')} AS delta_c FROM a""",
)
def vd_pattern_v2(spark, sf):
    w, wo, vd = cols()
    rows = paired(spark, sf)
    last = rows.groupBy("sample_id").agg(F.max("k").alias("last_k"))
    both = rows.where(w.isNotNull() & wo.isNotNull()).join(last, "sample_id")
    inner = F.col("k") < F.col("last_k")
    both = both.withColumns({"p1": D.pattern_of(w, wo), "p2": F.when(inner, D.pattern_strict(w, wo))})
    kept = F.col("p2").isNotNull()
    report = both.groupBy("bench", "model").agg(
        F.count(F.lit(1)).alias("n_old"),
        F.count("p2").alias("n_new"),
        F.count_if(~inner).alias("n_terminal_skipped"),
        D.percent(F.col("p1").isin("B", "C", "D")).alias("informative_old"),
        D.percent(F.col("p2").isin("B", "C", "D"), kept).alias("informative_new"),
        *[D.percent(F.col("p1") == p).alias(f"old_{p.lower()}") for p in "ABCDE"],
        *[D.percent(F.col("p2") == p, kept).alias(f"new_{p.lower()}") for p in "ABCDE"],
    )
    return report.withColumn("delta_c", F.round(F.col("new_c") - F.col("old_c"), 6))


FILTER_SQL = f""", f AS (SELECT sample_id, bench, model, {RTYPE} AS reasoning_type, max(coalesce(mc_with, 0)) AS w_max, min(coalesce(mc_with, 0)) AS w_min,
 max(coalesce(mc_without, 0)) AS wo_max, count(*) AS n_steps, count(mc_with) AS n_values FROM steps GROUP BY sample_id, bench, model),
fv AS (SELECT *, CASE WHEN w_max = 0 AND wo_max = 0 THEN 'drop_hard_impossible' WHEN wo_max >= 0.5 AND w_max < wo_max + 0.1 THEN 'drop_leakage'
 WHEN w_max = 1 AND w_min >= 0.8 THEN 'drop_trivial' ELSE 'keep' END AS verdict FROM f)"""


def filtered(spark, sf):
    return D.sample_filter(view(spark, sf, "steps"), ["sample_id", "bench", "model"], "mc_with", "mc_without")


@query("vd_sample_filter", "steps", FILTER_SQL + " SELECT sample_id, n_steps, verdict FROM fv")
def vd_sample_filter(spark, sf):
    return filtered(spark, sf).select("sample_id", "n_steps", "verdict")


VERDICTS = ["keep", "drop_hard_impossible", "drop_leakage", "drop_trivial"]


@query(
    "vd_filter_report",
    "steps",
    FILTER_SQL
    + f""" SELECT bench, model, reasoning_type, count(*) AS n_samples, {", ".join(f"{pct(f'verdict = {v!r}')} AS {v}_pct" for v in VERDICTS)}
 FROM fv GROUP BY GROUPING SETS ((bench, model), (bench, model, reasoning_type), ())""",
)
def vd_filter_report(spark, sf):
    rows = filtered(spark, sf).withColumn("reasoning_type", F.expr(RTYPE))
    b, m, t = F.col("bench"), F.col("model"), F.col("reasoning_type")
    return rows.groupingSets([[b, m], [b, m, t], []], b, m, t).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[D.percent(F.col("verdict") == v).alias(f"{v}_pct") for v in VERDICTS],
    )


@query(
    "vd_combo_report",
    "steps",
    VD_SQL
    + FILTER_SQL
    + f""", ok AS (SELECT * FROM fv WHERE n_values > 0),
s AS (SELECT bench, model, count(*) AS n_attempted, count(*) FILTER (WHERE n_values > 0) AS n_valid, count(*) FILTER (WHERE n_values = 0) AS n_err,
 count(*) FILTER (WHERE n_values = 0 AND n_steps = 1) AS n_err_one_step, count(*) FILTER (WHERE n_values = 0 AND n_steps > 1) AS n_err_no_value,
 {pct("n_values > 0 AND verdict = 'keep'", "count(*) FILTER (WHERE n_values > 0)")} AS kept_pct FROM fv GROUP BY bench, model),
c AS (SELECT vd.*, {PATTERN_V1.replace('mc_with', 'vd.mc_with')} AS pattern FROM vd SEMI JOIN ok ON vd.sample_id = ok.sample_id),
a AS (SELECT bench, model, count(*) AS n_steps_total, count(vd) AS n_vd, {r6('coalesce(avg(vd), 0)')} AS vd_mean, {r6(std0('vd'))} AS vd_std,
 {pct('abs(vd) > 0.3', 'count(vd)')} AS vd_informative_pct, {pct('vd < -0.1', 'count(vd)')} AS vd_negative_pct, {pct('vd > 0.1', 'count(vd)')} AS vd_positive_pct,
 {r6('avg(mc_with)')} AS mc_with_mean, {r6('avg(mc_without)')} AS mc_without_mean,
 {", ".join(f"{pct(f'pattern = {p!r}')} AS pct_{p.lower().strip('_')}" for p in ['A', 'B', 'C', 'D', 'E', '_invalid'])} FROM c GROUP BY bench, model)
SELECT s.*, a.* EXCLUDE (bench, model), {r6('n_steps_total / greatest(n_valid, 1)')} AS avg_steps, vd_std >= 0.15 AND vd_informative_pct >= 20 AS h1,
 pct_a < 50 AND pct_c >= 15 AS h2, kept_pct >= 50 AS h4 FROM s JOIN a USING (bench, model)""",
)
def vd_combo_report(spark, sf):
    w, wo, vd = cols()
    keys = ["bench", "model"]
    verdicts = filtered(spark, sf)
    valid = F.col("n_values") > 0
    samples = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_attempted"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_err"),
        F.count_if(~valid & (F.col("n_steps") == 1)).alias("n_err_one_step"),
        F.count_if(~valid & (F.col("n_steps") > 1)).alias("n_err_no_value"),
        D.percent(valid & (F.col("verdict") == "keep"), valid).alias("kept_pct"),
    )
    used = paired(spark, sf).join(verdicts.where(valid).select("sample_id"), "sample_id", "left_semi")
    used = used.withColumn("pattern", D.pattern_of(w, wo))
    steps = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps_total"),
        *D.vd_statistics(vd),
        F.round(F.avg(w), 6).alias("mc_with_mean"),
        F.round(F.avg(wo), 6).alias("mc_without_mean"),
        *[D.percent(F.col("pattern") == p).alias(f"pct_{p.lower().strip('_')}") for p in [*"ABCDE", "_invalid"]],
    )
    return samples.join(steps, keys).withColumns(
        {
            "avg_steps": F.round(F.col("n_steps_total") / F.greatest("n_valid", F.lit(1)), 6),
            "h1": (F.col("vd_std") >= 0.15) & (F.col("vd_informative_pct") >= 20),
            "h2": (F.col("pct_a") < 50) & (F.col("pct_c") >= 15),
            "h4": F.col("kept_pct") >= 50,
        }
    )


ADV_SQL = VD_SQL + f""", adv AS (SELECT sample_id, k, vd, {PATTERN_V1} AS pattern, mc_with - 0.5 AS base_adv,
 CASE WHEN mc_with - 0.5 > 0 THEN greatest(0.2, 1.0 + vd) ELSE 1.0 END AS modulation FROM vd WHERE mc_with IS NOT NULL AND mc_without IS NOT NULL),
fin AS (SELECT *, base_adv * modulation AS final_adv FROM adv)"""


def advantages(spark, sf):
    w, wo, vd = cols()
    rows = paired(spark, sf).where(vd.isNotNull()).withColumn("pattern", D.pattern_of(w, wo))
    return rows.withColumns(D.advantage(w, vd))


@query(
    "vd_advantage",
    "steps",
    ADV_SQL + f" SELECT sample_id, k, {r6('base_adv')} AS base_adv, {r6('modulation')} AS modulation, {r6('final_adv')} AS final_adv FROM fin",
)
def vd_advantage(spark, sf):
    return advantages(spark, sf).select(
        "sample_id", "k", *[F.round(c, 6).alias(c) for c in ("base_adv", "modulation", "final_adv")]
    )


@query(
    "vd_advantage_report",
    "steps",
    ADV_SQL
    + f""", a AS (SELECT pattern, count(*) AS n, {r6('avg(modulation)')} AS mean_modulation, {r6('median(modulation)')} AS median_modulation,
 {r6('avg(vd)')} AS mean_vd, {r6('avg(final_adv)')} AS mean_final_adv FROM fin GROUP BY pattern)
SELECT *, CASE pattern WHEN 'C' THEN mean_modulation >= 1.3 WHEN 'B' THEN mean_modulation <= 0.8 WHEN 'A' THEN mean_final_adv >= -0.6
 WHEN 'D' THEN mean_modulation BETWEEN 1.0 AND 1.2 END AS h3_pass FROM a""",
)
def vd_advantage_report(spark, sf):
    rows = advantages(spark, sf)
    median = exact_quantiles(rows, ["pattern"], "modulation", {"median_modulation": 0.5})
    report = (
        rows.groupBy("pattern")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("modulation"), 6).alias("mean_modulation"),
            F.round(F.avg("vd"), 6).alias("mean_vd"),
            F.round(F.avg("final_adv"), 6).alias("mean_final_adv"),
        )
    )
    report = report.join(median.withColumn("median_modulation", F.round("median_modulation", 6)), "pattern", "left")
    mod = F.col("mean_modulation")
    verdict = (
        F.when(F.col("pattern") == "C", mod >= 1.3)
        .when(F.col("pattern") == "B", mod <= 0.8)
        .when(F.col("pattern") == "A", F.col("mean_final_adv") >= -0.6)
        .when(F.col("pattern") == "D", mod.between(1.0, 1.2))
    )
    return report.withColumn("h3_pass", verdict)
