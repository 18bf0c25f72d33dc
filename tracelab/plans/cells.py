"""Queries on perception against outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import cells as C
from tracelab.operators import logistic as L
from tracelab.operators.scale import exact_mean
from tracelab.plans.registry import corr_sql, mean9, query, r6
from tracelab.plans.sqltext import nest
from tracelab.session import checkpoint
from tracelab.sources.fixtures import view

CELL_SQL = """CASE WHEN outcome IS NULL OR perception IS NULL THEN 'unknown'
 WHEN outcome = 1 AND perception >= {t} THEN 'grounded_correct' WHEN outcome = 1 THEN 'shortcut'
 WHEN perception >= {t} THEN 'careful_flawed' ELSE 'hallucinated' END"""


def pct(cond: str) -> str:
    return r6(f"avg(CASE WHEN {cond} THEN 100.0 ELSE 0.0 END)")


DIST_COLS = (
    "count(*) AS n_samples, count(*) FILTER (WHERE cell <> 'unknown') AS n_valid, "
    + ", ".join(f"{pct(f'cell = {c!r}')} AS {c}" for c in C.CELLS)
    + f", {pct('outcome = 1')} AS outcome_pct, "
    + r6(
        "100.0 * count(*) FILTER (WHERE cell = 'shortcut') / greatest(count(*) FILTER "
        "(WHERE cell IN ('grounded_correct', 'shortcut')), 1)"
    )
    + " AS drift_within_correct"
)


def dist_sql(keys: str, where: str = "TRUE", t: str = "0.5", source: str = "rollouts") -> str:
    return (
        f"SELECT {keys}, {DIST_COLS} FROM (SELECT *, {CELL_SQL.format(t=t)} AS cell FROM {source} WHERE {where}) "
        f"GROUP BY {keys}"
    )


def sample_level(spark, sf):
    """One row per prompt: mean perception over its rows (exact, as a cell is decided on it), outcome and step value of its first row."""
    rolls = view(spark, sf, "rollouts")
    first = lambda c: F.max(F.when(F.col("k") == 0, F.col(c)))
    return rolls.groupBy("group_id", "bench", "model").agg(
        exact_mean(F.col("perception")).alias("perception"), first("outcome").alias("outcome")
    )


SAMPLE_SQL = f""", samples AS (SELECT group_id, bench, model, {mean9('perception')} AS perception,
 max(CASE WHEN k = 0 THEN outcome END) AS outcome FROM rollouts GROUP BY ALL)"""


@query(
    "fc_assign",
    "rollouts",
    SAMPLE_SQL
    + f" SELECT group_id, outcome, {r6('perception')} AS perception_agg, {CELL_SQL.format(t='0.5')} AS cell FROM samples",
)
def fc_assign(spark, sf):
    samples = sample_level(spark, sf)
    return samples.select(
        "group_id",
        "outcome",
        F.round("perception", 6).alias("perception_agg"),
        C.cell_of(F.col("outcome"), F.col("perception")).alias("cell"),
    )


AUC_SQL = """, ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {s})
 + (count(*) OVER (PARTITION BY {keys}, {s}) - 1) / 2.0 AS rk
 FROM {src} WHERE {s} IS NOT NULL AND outcome IS NOT NULL),
auc AS (SELECT {keys}, count(*) AS n, CASE WHEN count(DISTINCT {s}) >= 2 AND sum(outcome) > 0 AND sum(outcome) < count(*)
 THEN round((sum(CASE WHEN outcome = 1 THEN rk ELSE 0 END) - sum(outcome) * (sum(outcome) + 1) / 2.0)
 / (sum(outcome) * (count(*) - sum(outcome))), 6) END AS auc FROM ranked GROUP BY {keys})"""


@query(
    "fc_distribution",
    "rollouts",
    AUC_SQL.format(keys="bench, model", s="perception", src="rollouts")
    + f""", d AS ({dist_sql('bench, model')}),
c AS (SELECT bench, model, {corr_sql('perception', 'outcome')} AS pearson_p_o FROM rollouts GROUP BY bench, model)
SELECT d.*, auc.auc, c.pearson_p_o FROM d LEFT JOIN auc USING (bench, model) LEFT JOIN c USING (bench, model)""",
)
def fc_distribution(spark, sf):
    rows = view(spark, sf, "rollouts")
    keys = ["bench", "model"]
    dist = C.cell_distribution(rows, keys)
    auc = C.auc_by_group(rows, keys, "perception", "outcome", low=0.0, high=1.0).drop("n")
    corr = rows.groupBy(*keys).agg(C.pearson("perception", "outcome").alias("pearson_p_o"))
    return dist.join(auc, keys, "left").join(corr, keys, "left")


@query("fc_by_source", "rollouts", dist_sql("model, bench", "outcome IS NOT NULL"))
def fc_by_source(spark, sf):
    return C.cell_distribution(view(spark, sf, "rollouts"), ["model", "bench"], variant="exclude_missing")


@query(
    "fc_pattern",
    "rollouts",
    f""", d AS ({dist_sql('model')}),
a AS (SELECT count(*) AS n_models, bool_and(shortcut >= 15) AS universal_shortcut,
 {r6('max(grounded_correct) - min(grounded_correct)')} AS grounded_spread,
 {r6("max(CASE WHEN model = 'm1' THEN grounded_correct END) - max(CASE WHEN model = 'm0' THEN grounded_correct END)")} AS tuned_gain FROM d)
SELECT *, CASE WHEN n_models < 2 THEN 'INSUFFICIENT_DATA' WHEN tuned_gain >= 10 THEN 'C'
 WHEN universal_shortcut AND grounded_spread < 10 THEN 'A' WHEN universal_shortcut THEN 'A-strong'
 WHEN grounded_spread < 10 THEN 'B' ELSE 'AMBIGUOUS' END AS pattern FROM a""",
)
def fc_pattern(spark, sf):
    dist = C.cell_distribution(view(spark, sf, "rollouts"), ["model"])
    return C.drift_pattern(dist, "model", "m0", "m1")


ALIGN_SQL = f""", p AS (SELECT group_id, bench, model, {mean9('perception')} AS p FROM rollouts WHERE perception IS NOT NULL GROUP BY ALL),
m AS (SELECT sample_id, {mean9('mc_with')} AS m, max_by(mc_with, k) AS last_mc FROM steps WHERE mc_with IS NOT NULL GROUP BY 1),
o AS (SELECT group_id, outcome FROM rollouts WHERE k = 0),
al AS (SELECT p.group_id, bench, model, p, m, outcome FROM p JOIN m ON p.group_id = m.sample_id JOIN o ON p.group_id = o.group_id WHERE outcome IS NOT NULL)"""


def alignment_inputs(spark, sf):
    """Mean perception, mean step value and outcome per sample; samples lacking any are dropped."""
    rolls, steps = view(spark, sf, "rollouts"), view(spark, sf, "steps")
    p = (
        rolls.where(F.col("perception").isNotNull())
        .groupBy("group_id", "bench", "model")
        .agg(exact_mean(F.col("perception")).alias("p"))
    )
    m = (
        steps.where(F.col("mc_with").isNotNull())
        .groupBy(F.col("sample_id").alias("group_id"))
        .agg(exact_mean(F.col("mc_with")).alias("m"))
    )
    o = rolls.where("k = 0 AND outcome IS NOT NULL").select("group_id", "outcome")
    return p.join(m, "group_id").join(o, "group_id")


@query(
    "al_inputs",
    ("rollouts", "steps"),
    ALIGN_SQL + f" SELECT group_id, bench, model, {r6('p')} AS p, {r6('m')} AS m, outcome FROM al",
)
def al_inputs(spark, sf):
    return alignment_inputs(spark, sf).select(
        "group_id", "bench", "model", F.round("p", 6).alias("p"), F.round("m", 6).alias("m"), "outcome"
    )


@query(
    "al_correlations",
    ("rollouts", "steps"),
    ALIGN_SQL
    + f"""
SELECT bench, model, count(*) AS n, {corr_sql('p', 'outcome')} AS pearson_p_o, {corr_sql('m', 'outcome')} AS pearson_m_o,
 {corr_sql('p', 'm')} AS pearson_p_m, {corr_sql('rp', 'ro')} AS spearman_p_outcome FROM
 (SELECT bench, model, round(p, 9) AS p, m, outcome, rank() OVER (PARTITION BY bench, model ORDER BY round(p, 9))
 + (count(*) OVER (PARTITION BY bench, model, round(p, 9)) - 1) / 2.0 AS rp,
 rank() OVER (PARTITION BY bench, model ORDER BY outcome) + (count(*) OVER (PARTITION BY bench, model, outcome) - 1) / 2.0 AS ro FROM al)
GROUP BY bench, model""",
)
def al_correlations(spark, sf):
    # nine places: sums in another order must not break ties between equal means
    rows = alignment_inputs(spark, sf).withColumn("p", F.round("p", 9))
    keys = ["bench", "model"]
    pears = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        C.pearson("p", "outcome").alias("pearson_p_o"),
        C.pearson("m", "outcome").alias("pearson_m_o"),
        C.pearson("p", "m").alias("pearson_p_m"),
    )
    return pears.join(C.spearman_by_group(rows, keys, "p", "outcome"), keys, "left")


@query("al_auc", "rollouts", AUC_SQL.format(keys="bench, model", s="perception", src="rollouts") + " SELECT * FROM auc")
def al_auc(spark, sf):
    return C.auc_by_group(view(spark, sf, "rollouts"), ["bench", "model"], "perception", "outcome", 0.0, 1.0)


MODELS = {"mc": ["m"], "both": ["m", "p"]}
_COEFFICIENTS = [L.coefficient(m, j) for m, x in MODELS.items() for j in range(len(x) + 1)]


def _newton_sql() -> str:
    """One Newton step over the rows of ``fit``, as a recursive term."""
    sums, stages = [], []
    for m, x in MODELS.items():
        t = L.terms(x)
        q = f"(1 / (1 + exp(-({L.score(m, x)}))))"
        sums += [f"sum(w * (outcome - {q}) * {a}) AS {m}_g{i}" for i, a in enumerate(t)]
        sums += [f"sum(w * {q} * (1 - {q}) * {t[i]} * {t[j]}) AS {m}_h{i}{j}" for i in range(len(t)) for j in range(i + 1)]
        stages += L.solved(m, len(t))
    keys = "bench, model, step, " + ", ".join(_COEFFICIENTS)
    source = f"(SELECT {keys}, {', '.join(sums)} FROM fit JOIN points USING (bench, model) WHERE step < {L.STEPS} GROUP BY {keys})".replace("1.0D", "1.0")
    return f"SELECT bench, model, step + 1, {', '.join(f'{c} + ' + c.replace('_', '_s') for c in _COEFFICIENTS)} FROM {nest(source, stages)}"


LIFT_SQL = f""", points AS (SELECT bench, model, round(m, 9) AS m, round(p, 9) AS p, outcome, CAST(count(*) AS DOUBLE) AS w FROM al GROUP BY ALL),
fit AS (SELECT bench, model, 0 AS step, {', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in _COEFFICIENTS)} FROM al GROUP BY bench, model HAVING sum(outcome) > 0 AND sum(outcome) < count(*)
 UNION ALL {_newton_sql()}),
scored AS (SELECT bench, model, al.outcome, round({L.score('mc', MODELS['mc'])}, 9) AS s_mc, round({L.score('both', MODELS['both'])}, 9) AS s_both
 FROM (SELECT bench, model, round(m, 9) AS m, round(p, 9) AS p, outcome FROM al) al JOIN fit USING (bench, model) WHERE step = {L.STEPS})""".replace("1.0D", "1.0")
for _m in MODELS:
    LIFT_SQL += AUC_SQL.format(keys="bench, model", s=f"s_{_m}", src="scored").replace("ranked", f"ranked_{_m}").replace("auc AS (", f"auc_{_m} AS (")
LIFT_SQL += """, lift AS (SELECT bench, model, auc_mc.n, coalesce(auc_mc.auc, 0.5) AS mc_only_auc, coalesce(auc_both.auc, 0.5) AS both_auc,
 round(coalesce(auc_both.auc, 0.5) - coalesce(auc_mc.auc, 0.5), 6) + 0.0 AS auc_lift FROM auc_mc JOIN auc_both USING (bench, model))"""


def auc_lift(rows, keys):
    """AUC in sample of a logistic model of the outcome on the step value, on the step value and perception, and what the second gains.

    All groups are fitted together; a group with one outcome only has no row, a model with one score for all rows has 0.5.
    """
    points = rows.groupBy(*keys, "m", "p", "outcome").agg(F.count(F.lit(1)).cast("double").alias("w"))
    points = checkpoint(points)
    fitted = points.join(L.fit_groups(points, keys, MODELS, "outcome"), keys)
    for name, features in MODELS.items():
        fitted = fitted.withColumn(f"s_{name}", F.round(F.expr(L.score(name, features)), 9))
    fitted = checkpoint(fitted.select(*keys, "outcome", "w", *[f"s_{name}" for name in MODELS]))
    auc = {m: C.auc_by_group(fitted, keys, f"s_{m}", "outcome", weight="w").withColumn("auc", F.coalesce("auc", F.lit(0.5))) for m in MODELS}
    return auc["mc"].withColumnRenamed("auc", "mc_only_auc").join(auc["both"].select(*keys, F.col("auc").alias("both_auc")), keys).select(
        *keys, F.col("n").cast("bigint").alias("n"), "mc_only_auc", "both_auc", F.round(F.col("both_auc") - F.col("mc_only_auc"), 6).alias("auc_lift")
    )


def rounded_alignment(spark, sf):
    return alignment_inputs(spark, sf).withColumns({"p": F.round("p", 9), "m": F.round("m", 9)})


@query("al_auc_lift", ("rollouts", "steps"), ALIGN_SQL + LIFT_SQL + " SELECT * FROM lift", recursive=True)
def al_auc_lift(spark, sf):
    return auc_lift(rounded_alignment(spark, sf), ["bench", "model"])


GATES = {
    "perception_ok": "perception_auc >= 0.65", "mc_ok": "mc_auc >= 0.70", "complementary_ok": "r_pm BETWEEN 0.3 AND 0.7", "lift_ok": "auc_lift >= 0.02",
}


@query(
    "al_gates",
    ("rollouts", "steps"),
    ALIGN_SQL
    + ", al9 AS (SELECT bench, model, round(p, 9) AS p, round(m, 9) AS m, outcome FROM al)"
    + AUC_SQL.format(keys="bench, model", s="p", src="al9").replace("ranked", "rank_p").replace("auc AS (", "auc_p AS (")
    + AUC_SQL.format(keys="bench, model", s="m", src="al9").replace("ranked", "rank_m").replace("auc AS (", "auc_m AS (")
    + LIFT_SQL
    + f""", c AS (SELECT bench, model, {corr_sql('p', 'm')} AS r_pm FROM al9 GROUP BY bench, model),
v AS (SELECT c.bench, c.model, auc_p.auc AS perception_auc, auc_m.auc AS mc_auc, r_pm, auc_lift
 FROM c LEFT JOIN auc_p USING (bench, model) LEFT JOIN auc_m USING (bench, model) LEFT JOIN lift USING (bench, model)),
g AS (SELECT *, {', '.join(f'coalesce({test}, FALSE) AS {name}' for name, test in GATES.items())} FROM v)
SELECT *, {' + '.join(f'CAST({name} AS INT)' for name in GATES)} AS n_passed FROM g""",
    recursive=True,
)
def al_gates(spark, sf):
    """Four gates per bench and model: perception and step value tell the outcome, they complement each other, and both tell it better."""
    keys = ["bench", "model"]
    rows = rounded_alignment(spark, sf)
    p = C.auc_by_group(rows, keys, "p", "outcome", 0.0, 1.0).select(*keys, F.col("auc").alias("perception_auc"))
    m = C.auc_by_group(rows, keys, "m", "outcome", 0.0, 1.0).select(*keys, F.col("auc").alias("mc_auc"))
    r = rows.groupBy(*keys).agg(C.pearson("p", "m").alias("r_pm"))
    lift = auc_lift(rows, keys).select(*keys, "auc_lift")
    out = r.join(p, keys, "left").join(m, keys, "left").join(lift, keys, "left")
    out = out.select(*keys, "perception_auc", "mc_auc", "r_pm", "auc_lift")
    out = out.withColumns({name: F.coalesce(F.expr(test), F.lit(False)) for name, test in GATES.items()})
    return out.withColumn("n_passed", sum(F.col(name).cast("int") for name in GATES))


@query(
    "rp_bench_rollup",
    "rollouts",
    AUC_SQL.format(keys="bench, model", s="perception", src="rollouts")
    + f""", d AS ({dist_sql('bench, model')}),
c AS (SELECT bench, model, {corr_sql('perception', 'outcome')} AS r FROM rollouts GROUP BY bench, model)
SELECT bench, count(*) AS n_models, {r6('median(grounded_correct)')} AS median_grounded, {r6('median(careful_flawed)')} AS median_careful,
 {r6('median(auc)')} AS median_auc, {r6('median(r)')} AS median_r FROM d LEFT JOIN auc USING (bench, model) LEFT JOIN c USING (bench, model)
WHERE n_valid > 0 GROUP BY bench""",
)
def rp_bench_rollup(spark, sf):
    # one row per model and bench: the median runs over that bounded table
    per_combo = fc_distribution(spark, sf).where("n_valid > 0")
    return per_combo.groupBy("bench").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.round(F.median("grounded_correct"), 6).alias("median_grounded"),
        F.round(F.median("careful_flawed"), 6).alias("median_careful"),
        F.round(F.median("auc"), 6).alias("median_auc"),
        F.round(F.median("pearson_p_o"), 6).alias("median_r"),
    )


# The re-judged outcome of a row: present for half the rows, flipped for a fifth of those.
REJUDGED = (
    "CASE WHEN k % 2 = 0 THEN CASE WHEN (group_id + k) % 5 = 0 THEN 1 - outcome ELSE outcome END END"
)


@query(
    "rp_rejudge_delta",
    "rollouts",
    f""", rj AS (SELECT * REPLACE (coalesce({REJUDGED}, outcome) AS outcome) FROM rollouts),
a AS ({dist_sql('bench, model')}), b AS ({dist_sql('bench, model', source='rj')})
SELECT bench, model, {r6('b.grounded_correct - a.grounded_correct')} AS d_grounded, {r6('b.shortcut - a.shortcut')} AS d_shortcut,
 {r6('b.careful_flawed - a.careful_flawed')} AS d_careful, {r6('b.hallucinated - a.hallucinated')} AS d_hallucinated,
 {r6('b.outcome_pct - a.outcome_pct')} AS d_outcome FROM a JOIN b USING (bench, model)""",
)
def rp_rejudge_delta(spark, sf):
    rows = view(spark, sf, "rollouts")
    keys = ["bench", "model"]
    old = C.cell_distribution(rows, keys).alias("a")
    again = rows.withColumn("outcome", F.coalesce(F.expr(REJUDGED), F.col("outcome")))
    new = C.cell_distribution(again, keys).alias("b")
    delta = lambda c, name: F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), 6).alias(name)
    return old.join(new, keys).select(
        *keys,
        delta("grounded_correct", "d_grounded"),
        delta("shortcut", "d_shortcut"),
        delta("careful_flawed", "d_careful"),
        delta("hallucinated", "d_hallucinated"),
        delta("outcome_pct", "d_outcome"),
    )


MODEL_NAMES = {"m0": "zero_shot", "m1": "tuned", "m2": "reasoner"}


@query(
    "rp_phase_compare",
    "rollouts",
    f""", names AS (SELECT * FROM (VALUES ('m0', 'zero_shot'), ('m1', 'tuned'), ('m2', 'reasoner')) t(model, model_name)),
pilot AS ({dist_sql('model', "bench = 'bench_a'")}), hard AS ({dist_sql('model', "bench <> 'bench_a'")})
SELECT model_name, pilot.n_samples AS pilot_n, hard.n_samples AS hard_n, pilot.grounded_correct AS pilot_grounded,
 hard.grounded_correct AS hard_grounded, pilot.shortcut AS pilot_shortcut, hard.shortcut AS hard_shortcut
FROM names JOIN pilot USING (model) JOIN hard USING (model)""",
)
def rp_phase_compare(spark, sf):
    rows = view(spark, sf, "rollouts")
    names = spark.createDataFrame(list(MODEL_NAMES.items()), "model string, model_name string")
    pilot = C.cell_distribution(rows.where("bench = 'bench_a'"), ["model"]).alias("p")
    hard = C.cell_distribution(rows.where("bench <> 'bench_a'"), ["model"]).alias("h")
    # the name table is fixed and tiny
    return (
        pilot.join(hard, "model")
        .join(F.broadcast(names), "model")
        .select(
            "model_name",
            F.col("p.n_samples").alias("pilot_n"),
            F.col("h.n_samples").alias("hard_n"),
            F.col("p.grounded_correct").alias("pilot_grounded"),
            F.col("h.grounded_correct").alias("hard_grounded"),
            F.col("p.shortcut").alias("pilot_shortcut"),
            F.col("h.shortcut").alias("hard_shortcut"),
        )
    )


THRESHOLDS = [0.3, 0.5, 0.7, 0.9]


@query(
    "rp_threshold_sweep",
    "rollouts",
    """, t AS (SELECT CAST(unnest([0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS threshold),
x AS (SELECT threshold, bench, outcome, perception FROM rollouts, t)
"""
    + dist_sql("threshold, bench", t="threshold", source="x"),
)
def rp_threshold_sweep(spark, sf):
    # reduce to distinct (outcome, perception) with counts before the sweep multiplies rows
    rows = view(spark, sf, "rollouts").groupBy("bench", "outcome", "perception").agg(F.count(F.lit(1)).alias("w"))
    sweep = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    cells = sweep.withColumn("cell", C.cell_of(F.col("outcome"), F.col("perception"), F.col("threshold")))
    total = F.sum("w")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0))
    correct = part(F.col("cell").isin("grounded_correct", "shortcut"))
    return cells.groupBy("threshold", "bench").agg(
        total.alias("n_samples"),
        part(F.col("cell") != "unknown").alias("n_valid"),
        *[F.round(100.0 * part(F.col("cell") == c) / total, 6).alias(c) for c in C.CELLS],
        F.round(100.0 * part(F.col("outcome") == 1) / total, 6).alias("outcome_pct"),
        F.round(100.0 * part(F.col("cell") == "shortcut") / F.greatest(correct, F.lit(1)), 6).alias("drift_within_correct"),
    )
