"""Queries on claims and perception verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import verdicts as V
from tracelab.operators import claims as L
from tracelab.operators import mc as M
from tracelab.plans.mc import AXES, AXIS_MEAN_SQL, AXIS_NAMES, std0
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import ra, rm, rx, sub
from tracelab.sources.fixtures import table, view

KEYS = ["group_id", "k"]


def hits_sql(pattern: str, e: int, v: int, base: int) -> str:
    unit = f"unnest({ra('text', pattern, 3)})" if base == 1000 * L.WITH_UNIT else "CAST(NULL AS VARCHAR)"
    return f"SELECT group_id, k, bench, 'value' AS type, unnest({ra('text', pattern, e)}) AS entity, unnest({ra('text', pattern, v)}) AS v, {unit} AS unit, {base} + unnest(range(len({ra('text', pattern, e)}))) AS hit_at FROM step_texts"


@query(
    "cl_regex_claims",
    "step_texts",
    ", h AS ("
    + " UNION ALL ".join(hits_sql(p, e, v, 1000 * i) for i, (p, e, v) in enumerate(L.VALUE_PATTERNS))
    + f""" ), c AS (SELECT DISTINCT ON (group_id, k, lower(trim(entity)), v) bench, type, trim(entity) AS entity, v, nullif(unit, '') AS unit FROM (SELECT * REPLACE (CAST(v AS DOUBLE) AS v) FROM h)
 ORDER BY group_id, k, lower(trim(entity)), v, hit_at),
s AS (SELECT DISTINCT group_id, k, bench, lower(trim(e)) AS e, lower(c) AS c FROM (SELECT group_id, k, bench, unnest({ra('text', L.SUPERLATIVE, 2)}) AS e, unnest({ra('text', L.SUPERLATIVE, 1)}) AS c FROM step_texts))
SELECT bench, type, lower(entity) AS entity, v AS value, unit, CAST(NULL AS VARCHAR) AS comparator, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT bench, 'categorical', e, NULL, NULL, c, count(*) FROM s GROUP BY ALL""",
)
def cl_regex_claims(spark, sf):
    claims = L.regex_claims(view(spark, sf, "step_texts"), [*KEYS, "bench"], "text")
    return claims.groupBy("bench", "type", F.lower("entity").alias("entity"), "value", "unit", "comparator").agg(
        F.count(F.lit(1)).alias("n")
    )


def axis_sql(axis: str, patterns: list[str]) -> str:
    hits = " ".join(f"WHEN {rm('text', p)} THEN trim({rx('text', p)})" for p in patterns)
    return f"SELECT bench, '{axis}' AS axis, CASE {hits} END AS claim FROM step_texts"


@query(
    "cl_axis_claims",
    "step_texts",
    ", c AS ("
    + " UNION ALL ".join(axis_sql(a, p) for a, p in L.AXIS_PATTERNS.items())
    + """ ) SELECT bench, axis, count(*) AS n, min(claim) AS first_claim, max(claim) AS last_claim FROM c WHERE claim <> '' GROUP BY bench, axis""",
)
def cl_axis_claims(spark, sf):
    steps = view(spark, sf, "step_texts").withColumns(L.axis_claims(F.col("text")))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("claim")) for a in L.AXIS_PATTERNS])).alias("c")
    rows = steps.select("bench", pairs).where(F.col("c.claim") != "")
    return rows.groupBy("bench", "c.axis").agg(
        F.count(F.lit(1)).alias("n"), F.min("c.claim").alias("first_claim"), F.max("c.claim").alias("last_claim")
    )


ANY_CLAIM = "(" + " OR ".join(rm("text", p) for p in [L.SUPERLATIVE, *[p for p, _, _ in L.VALUE_PATTERNS]]) + ")"


@query(
    "cl_fallback_queue",
    "step_texts",
    f"SELECT group_id, k, text FROM step_texts WHERE regexp_matches(text, '[0-9]') AND NOT {ANY_CLAIM}",
)
def cl_fallback_queue(spark, sf):
    # steps are numbered by the view, so a step is one row and nothing has to be joined; rows without a key are never answered for
    keyed = F.col("group_id").isNotNull() & F.col("k").isNotNull()
    steps = view(spark, sf, "step_texts").where(F.col("text").rlike("[0-9]") & ~(keyed & L.has_claim(F.col("text"))))
    return steps.select(*KEYS, "text")


JSON_SQL = """, jt AS (SELECT group_id, k, bench, regexp_extract(raw, '(?s)\\[.*\\]', 0) AS span FROM claim_texts),
ji AS (SELECT group_id, k, bench, unnest(from_json(span, '["JSON"]')) AS item FROM jt WHERE span <> '' AND json_valid(span)),
jc AS (SELECT group_id, k, bench, trim(json_extract_string(item, '$.entity')) AS entity, TRY_CAST(json_extract_string(item, '$.value') AS DOUBLE) AS value, json_extract_string(item, '$.type') AS t FROM ji WHERE json_type(item) = 'OBJECT'),
cj AS (SELECT group_id, k, bench, entity, value, CASE WHEN coalesce(t, 'value') IN ('value', 'categorical') THEN coalesce(t, 'value') WHEN value IS NOT NULL THEN 'value' ELSE 'categorical' END AS type FROM jc WHERE coalesce(entity, '') <> '')"""


def json_claims(spark, sf):
    return L.json_claims(view(spark, sf, "claim_texts"), ["group_id", "k", "bench"], "raw")


@query("claims_json", "claim_texts", JSON_SQL + " SELECT bench, type, entity, value, count(*) AS n FROM cj GROUP BY ALL")
def claims_json(spark, sf):
    return json_claims(spark, sf).groupBy("bench", "type", "entity", "value").agg(F.count(F.lit(1)).alias("n"))


# The early form takes the first closing bracket and calls every odd type a value; a quarter of the texts go on with a second list.
NESTED = "CASE WHEN (group_id + k) % 4 = 3 THEN concat('[{\"entity\": \"bar ', CAST(k AS STRING), '\", \"value\": \"x\", \"type\": \"odd\"}] and [', raw, ']') ELSE raw END"
LAZY_SQL = f""", lz AS (SELECT group_id, k, bench, {NESTED} AS raw FROM claim_texts)""" + JSON_SQL.replace("\\[.*\\]", "\\[.*?\\]").replace("FROM claim_texts", "FROM lz").replace("WHEN value IS NOT NULL THEN 'value' ELSE 'categorical' END", "ELSE 'value' END")


@query("claims_json_lazy", "claim_texts", LAZY_SQL + " SELECT bench, type, entity, value, count(*) AS n FROM cj GROUP BY ALL")
def claims_json_lazy(spark, sf):
    texts = view(spark, sf, "claim_texts").withColumn("raw", F.expr(NESTED))
    claims = L.json_claims(texts, ["group_id", "k", "bench"], "raw", greedy=False)
    return claims.groupBy("bench", "type", "entity", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cl_coverage",
    "claim_texts",
    JSON_SQL
    + f""", n AS (SELECT group_id, k, count(*) AS c FROM cj GROUP BY group_id, k),
s AS (SELECT t.bench, coalesce(c, 0) AS c FROM claim_texts t LEFT JOIN n USING (group_id, k))
SELECT bench, count(*) AS n_steps, CAST(sum(c) AS BIGINT) AS n_claims, {r6('avg(c)')} AS claims_per_step, count(*) FILTER (WHERE c > 0) AS steps_with_claim, {r6('avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END)')} AS empty_rate FROM s GROUP BY bench""",
)
def cl_coverage(spark, sf):
    steps = view(spark, sf, "claim_texts").select("group_id", "k", "bench")
    counts = json_claims(spark, sf).groupBy("group_id", "k").agg(F.count(F.lit(1)).alias("c"))
    rows = steps.join(counts, ["group_id", "k"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return rows.groupBy("bench").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum("c").alias("n_claims"),
        F.round(F.avg("c"), 6).alias("claims_per_step"),
        F.count_if(F.col("c") > 0).alias("steps_with_claim"),
        F.round(F.avg((F.col("c") == 0).cast("double")), 6).alias("empty_rate"),
    )


# A second extractor's claims: other spelling, some values off, some claims missing.
SECOND_A = "concat('ITEM-', CAST(l_partkey AS STRING)) AS entity, CAST(qty + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value"
SECOND_B = "concat('Group ', CAST(disc AS STRING)) AS entity, CAST(NULL AS DOUBLE) AS value"


@query(
    "cl_jaccard",
    ("claim_texts", "lines"),
    JSON_SQL
    + f""", b0 AS (SELECT group_id, k, {SECOND_A} FROM lines WHERE qty % 10 <> 0 UNION ALL SELECT group_id, k, {SECOND_B} FROM lines WHERE disc % 3 <> 0),
a AS (SELECT DISTINCT group_id, k, regexp_replace(lower(entity), '[^a-z0-9]', '', 'g') AS e, coalesce(round(value, 2), -1e9) AS v FROM cj),
b AS (SELECT DISTINCT group_id, k, regexp_replace(lower(entity), '[^a-z0-9]', '', 'g') AS e, coalesce(round(value, 2), -1e9) AS v FROM b0),
f AS (SELECT coalesce(a.group_id, b.group_id) AS group_id, coalesce(a.k, b.k) AS k, a.e IS NOT NULL AND b.e IS NOT NULL AS shared FROM a FULL JOIN b ON a.group_id = b.group_id AND a.k = b.k AND a.e = b.e AND a.v = b.v),
j AS (SELECT group_id, k, count(*) AS u, count(*) FILTER (WHERE shared) AS i FROM f GROUP BY group_id, k),
r AS (SELECT t.bench, CASE WHEN u IS NULL THEN 1.0 ELSE i / u END AS jaccard FROM claim_texts t LEFT JOIN j USING (group_id, k))
SELECT bench, count(*) AS n, {r6('avg(jaccard)')} AS mean_jaccard, {r6('avg(CASE WHEN jaccard >= 0.5 THEN 1.0 ELSE 0.0 END)')} AS share_half,
 CASE WHEN avg(jaccard) >= 0.85 THEN 'PASS' WHEN avg(jaccard) >= 0.7 THEN 'CONDITIONAL' ELSE 'FAIL' END AS decision FROM r GROUP BY bench""",
)
def cl_jaccard(spark, sf):
    lines = view(spark, sf, "lines")
    pick = lambda text: [c.strip() for c in text.replace("AS entity, ", "AS entity;").split(";")]
    second = (
        lines.where("qty % 10 <> 0").selectExpr("group_id", "k", *pick(SECOND_A))
        .unionByName(lines.where("disc % 3 <> 0").selectExpr("group_id", "k", *pick(SECOND_B)))
    )
    steps = view(spark, sf, "claim_texts").select("group_id", "k", "bench")
    rows = L.jaccard(steps, json_claims(spark, sf), second, ["group_id", "k"])
    mean = F.avg("jaccard")
    return rows.groupBy("bench").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(mean, 6).alias("mean_jaccard"),
        F.round(F.avg((F.col("jaccard") >= 0.5).cast("double")), 6).alias("share_half"),
        F.when(mean >= 0.85, "PASS").when(mean >= 0.7, "CONDITIONAL").otherwise("FAIL").alias("decision"),
    )


GOT = "TRY_CAST(nullif(regexp_extract(response, '-?[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE)"
NF = "(contains(upper(response), 'NOT_FOUND') OR contains(upper(response), 'NOT FOUND'))"


def value_sql(full: float, absolute: float, half: float) -> str:
    gap = f"abs({GOT} - claim_value)"
    rel = f"{gap} / greatest(abs(claim_value), 1e-10)"
    return f"CASE WHEN {rel} <= {full} OR {gap} <= {absolute} THEN 1.0 WHEN {rel} <= {half} THEN 0.5 ELSE 0.0 END"


V2_SQL = f"CASE WHEN NOT {NF} AND {GOT} IS NOT NULL THEN {value_sql(0.1, 1.0, 0.25)} END"
V1_SQL = f"CASE WHEN {GOT} IS NULL THEN 0.5 ELSE {value_sql(0.05, 0.5, 0.15)} END"
NORM = lambda x: sub(f"lower({x})", "[^a-z0-9]")
CAT_SQL = f"CASE WHEN NOT {NF} AND {NORM('response')} <> '' THEN CASE WHEN contains({NORM('response')}, {NORM('entity')}) OR contains({NORM('entity')}, {NORM('response')}) THEN 1.0 ELSE 0.0 END END"
CAT1_SQL = f"CASE WHEN contains({NORM('response')}, {NORM('entity')}) OR contains({NORM('entity')}, {NORM('response')}) THEN 1.0 ELSE 0.0 END"


def claims_with_answers(spark, sf):
    """Claims joined to the verifier's answers by step and claim."""
    rows = view(spark, sf, "claim_checks")
    return rows.drop("response").join(rows.select("group_id", "k", "response"), ["group_id", "k"])


def check_report(rows, keys):
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("late").alias("n_valid"),
        F.count_if(F.col("late") == 1).alias("n_full"),
        F.count_if(F.col("late") == 0.5).alias("n_half"),
        mean("late", "mean_late"),
        mean("early", "mean_early"),
    )


CHECK_SQL = f"count(*) AS n, count(late) AS n_valid, count(*) FILTER (WHERE late = 1) AS n_full, count(*) FILTER (WHERE late = 0.5) AS n_half, {r6('avg(late)')} AS mean_late, {r6('avg(early)')} AS mean_early"


@query(
    "cl_verify_value",
    "claim_checks",
    f"SELECT bench, response LIKE 'approx%' AS approx, {CHECK_SQL} FROM (SELECT bench, response, {V2_SQL} AS late, {V1_SQL} AS early FROM claim_checks WHERE type = 'value') GROUP BY ALL",
)
def cl_verify_value(spark, sf):
    rows = claims_with_answers(spark, sf).where("type = 'value'")
    claim, said = F.col("claim_value"), F.col("response")
    rows = rows.withColumns(
        {"late": L.score_value(claim, said), "early": L.score_value(claim, said, 1), "approx": said.like("approx%")}
    )
    return check_report(rows, ["bench", "approx"])


@query(
    "cl_verify_categorical",
    "claim_checks",
    f"SELECT bench, {CHECK_SQL} FROM (SELECT bench, {CAT_SQL} AS late, {CAT1_SQL} AS early FROM claim_checks WHERE type = 'categorical') GROUP BY bench",
)
def cl_verify_categorical(spark, sf):
    rows = claims_with_answers(spark, sf).where("type = 'categorical'")
    rows = rows.withColumns(
        {"late": L.score_category(F.col("entity"), F.col("response")), "early": L.score_category(F.col("entity"), F.col("response"), 1)}
    )
    return check_report(rows, ["bench"])


# Steps are orders (some without claims), their claims the order lines.
PERC_SQL = f""", ck AS (SELECT group_id, CASE WHEN type = 'value' THEN {V2_SQL} ELSE {CAT_SQL} END AS score, {NF} AS missing FROM claim_checks),
pg AS (SELECT group_id, {r6('avg(score)')} AS mean_score, count(*) AS n_total, count(*) FILTER (WHERE missing) AS n_not_found, {r6('avg(CASE WHEN missing THEN 1.0 ELSE 0.0 END)')} AS not_found_rate FROM ck GROUP BY group_id),
sp AS (SELECT o_orderkey AS group_id, o_orderpriority AS source, pg.* EXCLUDE (group_id) FROM orders LEFT JOIN pg ON o_orderkey = pg.group_id)"""


def perceived(spark, sf):
    rows = claims_with_answers(spark, sf)
    said = F.col("response")
    score = F.when(F.col("type") == "value", L.score_value(F.col("claim_value"), said)).otherwise(
        L.score_category(F.col("entity"), said)
    )
    checked = rows.select("group_id", score.alias("score"), V.not_found(said).alias("missing"))
    steps = table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("source"))
    return L.step_perception(steps, checked, ["group_id"])


@query("cl_step_perception", "claim_checks", PERC_SQL + " SELECT * FROM sp")
def cl_step_perception(spark, sf):
    return perceived(spark, sf)


@query(
    "cl_perception_distribution",
    "claim_checks",
    PERC_SQL
    + f""" SELECT source, count(*) AS n_steps, {r6('avg(mean_score)')} AS mean_perception, {", ".join(f"{r6(f'avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)')} AS {n}" for c, n in (("mean_score = 0", "share_zero"), ("mean_score = 0.5", "share_half"), ("mean_score = 1", "share_one"), ("mean_score > 0 AND mean_score < 1 AND mean_score <> 0.5", "share_between")))},
 {r6('avg(not_found_rate)')} AS mean_not_found, {r6('median(mean_score)')} AS median_perception FROM sp WHERE mean_score IS NOT NULL GROUP BY source""",
)
def cl_perception_distribution(spark, sf):
    return L.perception_distribution(perceived(spark, sf), ["source"])


@query(
    "cl_verifier_reliability",
    ("claim_checks", "chart_cells"),
    f""", j AS (SELECT bench, response, value AS truth FROM claim_checks c JOIN chart_cells t ON t.chart_id = c.group_id AND t.row_idx = c.k AND t.col = 'quantity'),
s AS (SELECT bench, truth, {GOT} AS got, CASE WHEN starts_with(response, 'ERROR') THEN 'error' WHEN {NF} THEN 'not_found' WHEN {GOT} IS NULL THEN 'parse_fail' ELSE 'ok' END AS status FROM j),
a AS (SELECT bench, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in ("ok", "not_found", "parse_fail", "error"))},
 {r6("100.0 * count(*) FILTER (WHERE status = 'ok') / count(*)")} AS coverage_pct,
 {r6("coalesce(100.0 * count(*) FILTER (WHERE status = 'ok' AND (abs(got - truth) / greatest(abs(truth), 1e-10) <= 0.1 OR abs(got - truth) <= 1.0)) / nullif(count(*) FILTER (WHERE status = 'ok'), 0), 0)")} AS agreement_pct FROM s GROUP BY bench)
SELECT *, coverage_pct >= 80 AND agreement_pct >= 85 AS reliable FROM a""",
)
def cl_verifier_reliability(spark, sf):
    truth = view(spark, sf, "chart_cells").where("col = 'quantity'").select(
        F.col("chart_id").alias("group_id"), F.col("row_idx").alias("k"), F.col("value").alias("truth")
    )
    answers = view(spark, sf, "claim_checks").select("group_id", "k", "bench", "response").join(truth, ["group_id", "k"])
    return L.verifier_reliability(answers, ["bench"])


STRICT = ["ax_value_strict", *AXES[1:]]
STRICT_MEAN_SQL = AXIS_MEAN_SQL.replace("ax_value", "ax_value_strict")


def axis_stats_sql(kind: str, axes: list[str], mean: str) -> str:
    yes = " + ".join(f"CAST(coalesce({a} = 1, FALSE) AS INT)" for a in axes)
    no = " + ".join(f"CAST(coalesce({a} = 0, FALSE) AS INT)" for a in axes)
    return f"SELECT '{kind}' AS verdicts, bench, count(*) AS n_steps, count({mean}) AS n_with_perception, {r6(f'avg({mean})')} AS mean_perception, CAST(sum({yes}) AS BIGINT) AS n_yes, CAST(sum({no}) AS BIGINT) AS n_no, CAST(sum(4 - ({yes}) - ({no})) AS BIGINT) AS n_na FROM ax GROUP BY bench"


def salvage_sql(kind: str, mean: str) -> str:
    dead = f"CASE WHEN mc_with = 0 THEN {mean} END"
    return f"SELECT '{kind}' AS verdicts, bench, count(*) AS n_samples, count(*) FILTER (WHERE sd > 1e-9) AS n_salvage, CAST(sum(nd) AS BIGINT) AS n_dead FROM (SELECT bench, group_id, {std0(dead)} AS sd, count(*) FILTER (WHERE mc_with = 0) AS nd FROM ax GROUP BY bench, group_id) GROUP BY bench"


@query(
    "cl_strict_vs_original",
    ("axes", "steps"),
    f""", ax AS (SELECT a.*, mc_with FROM axes a JOIN steps s ON a.group_id = s.sample_id AND a.k = s.k),
o AS ({axis_stats_sql('original', AXES, AXIS_MEAN_SQL)} UNION ALL {axis_stats_sql('strict', STRICT, STRICT_MEAN_SQL)}),
v AS ({salvage_sql('original', AXIS_MEAN_SQL)} UNION ALL {salvage_sql('strict', STRICT_MEAN_SQL)})
SELECT o.*, n_samples, n_salvage, n_dead FROM o JOIN v USING (verdicts, bench)""",
)
def cl_strict_vs_original(spark, sf):
    steps = view(spark, sf, "steps").select(F.col("sample_id").alias("group_id"), "k", "mc_with")
    rows = view(spark, sf, "axes").join(steps, ["group_id", "k"])
    sets = F.array(
        *[F.struct(F.lit(n).alias("verdicts"), M.axis_map(AXIS_NAMES, c).alias("axes")) for n, c in (("original", AXES), ("strict", STRICT))]
    )
    rows = rows.select("group_id", "bench", "mc_with", F.explode(sets).alias("s")).select("group_id", "bench", "mc_with", "s.*")
    marks = F.map_values("axes")
    known = lambda value: F.size(F.filter(marks, lambda v: F.coalesce(v == value, F.lit(False))))
    rows = rows.withColumns({"p": M.axis_mean(F.col("axes")), "yes": known(1), "no": known(0), "all": F.size(marks)})
    dead = F.col("mc_with") == 0
    per = rows.groupBy("verdicts", "bench", "group_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("p").alias("np"),
        F.sum("p").alias("sp"),
        *[F.sum(c).alias(c) for c in ("yes", "no", "all")],
        M.pstd(F.when(dead, F.col("p"))).alias("sd"),
        F.count_if(dead).alias("nd"),
    )
    return per.groupBy("verdicts", "bench").agg(
        F.sum("n").alias("n_steps"),
        F.sum("np").alias("n_with_perception"),
        F.round(F.sum("sp") / F.sum("np"), 6).alias("mean_perception"),
        F.sum("yes").alias("n_yes"),
        F.sum("no").alias("n_no"),
        F.sum(F.col("all") - F.col("yes") - F.col("no")).alias("n_na"),
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("sd") > M.EPS).alias("n_salvage"),
        F.sum("nd").alias("n_dead"),
    )
