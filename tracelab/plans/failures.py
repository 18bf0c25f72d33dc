"""Queries on failure taxonomy and artifact audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import scoring as S
from tracelab.functions import verdicts as V
from tracelab.functions.text import every, or_empty, plain_number, strip
from tracelab.operators import traces as G
from tracelab.operators.inputdep import percent
from tracelab.operators.scale import first_rows
from tracelab.plans.answers import CONTENT, REASON, VERDICT_SQL, label_sql
from tracelab.plans.claims import NF
from tracelab.plans.inputdep import pct
from tracelab.operators.inputdep import pattern_of
from tracelab.plans.corpus import DIST_SQL, distilled
from tracelab.plans.inputdep import PATTERN_V1, VD_SQL
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import ra, rm, st
from tracelab.plans.traces import THINK_SQL
from tracelab.sources.fixtures import view

KEYS = ["group_id", "k"]


def failed(spark, sf, flawed: bool = False):
    """Wrong rollouts, or only those that were grounded in the chart."""
    rows = view(spark, sf, "rollouts").where("outcome = 0")
    return rows.where("perception >= 0.5") if flawed else rows


@query(
    "ft_wrong_samples",
    ("rollouts", "responses"),
    "SELECT r.group_id, r.k, r.bench, r.model, s.gold, s.response AS trace FROM rollouts r JOIN responses s USING (group_id, k) WHERE outcome = 0",
)
def ft_wrong_samples(spark, sf):
    texts = view(spark, sf, "responses").select(*KEYS, "gold", "response")
    return failed(spark, sf).join(texts, KEYS).select(
        *KEYS, "bench", "model", "gold", F.col("response").alias("trace")
    )


@query(
    "ft_careful_flawed",
    ("rollouts", "responses"),
    f"SELECT r.group_id, r.k, r.bench, r.model, {r6('perception')} AS perception, s.response AS trace FROM rollouts r JOIN responses s USING (group_id, k) WHERE outcome = 0 AND perception >= 0.5",
)
def ft_careful_flawed(spark, sf):
    texts = view(spark, sf, "responses").select(*KEYS, "response")
    return failed(spark, sf, True).join(texts, KEYS).select(
        *KEYS, "bench", "model", F.round("perception", 6).alias("perception"), F.col("response").alias("trace")
    )


@query(
    "ft_label_counts",
    "taxonomy",
    f""", l AS (SELECT bench, model, {label_sql(V.ROOT_CAUSES)} AS label FROM taxonomy),
c AS (SELECT bench, model, label, count(*) AS n, grouping(bench, model) AS g FROM l GROUP BY GROUPING SETS ((bench, model, label), (label)))
SELECT coalesce(bench, 'ALL') AS bench, coalesce(model, 'ALL') AS model, label, n, {r6('100.0 * n / sum(n) OVER (PARTITION BY bench, model, g)')} AS pct FROM c""",
)
def ft_label_counts(spark, sf):
    rows = view(spark, sf, "taxonomy").select("bench", "model", V.label(F.col("raw"), V.ROOT_CAUSES).alias("label"))
    counts = rows.groupBy("bench", "model", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("label").agg(F.sum("n").alias("n"))
    both = counts.unionByName(whole.select(F.lit("ALL").alias("bench"), F.lit("ALL").alias("model"), "label", "n"))
    totals = both.groupBy("bench", "model").agg(F.sum("n").alias("_all"))
    return both.join(totals, ["bench", "model"]).select(
        "bench", "model", "label", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("pct")
    )


@query(
    "ft_artifact_vs_real",
    "taxonomy",
    f""", l AS (SELECT bench, {label_sql(V.FLAW_KINDS)} AS label FROM taxonomy)
SELECT bench, count(*) AS n, {pct("label IN ('TRUNCATION', 'FORMAT_MISMATCH')")} AS artifact_pct, {pct("label IN ('Q_INTENT', 'CATEGORY_SELECT', 'ARITHMETIC')")} AS real_pct, {pct("label = 'PARSE_FAIL'")} AS unparsed_pct FROM l GROUP BY bench""",
)
def ft_artifact_vs_real(spark, sf):
    rows = view(spark, sf, "taxonomy").select("bench", V.label(F.col("raw"), V.FLAW_KINDS).alias("label"))
    label = F.col("label")
    return rows.groupBy("bench").agg(
        F.count(F.lit(1)).alias("n"),
        percent(label.isin("TRUNCATION", "FORMAT_MISMATCH")).alias("artifact_pct"),
        percent(label.isin("Q_INTENT", "CATEGORY_SELECT", "ARITHMETIC")).alias("real_pct"),
        percent(label == "PARSE_FAIL").alias("unparsed_pct"),
    )


@query(
    "ft_no_answer_tag",
    ("rollouts", "responses"),
    f"""SELECT r.bench, r.model, count(*) AS n, count(*) FILTER (WHERE contains(response, '<answer>')) AS n_tagged, count(*) FILTER (WHERE NOT contains(response, '<answer>')) AS n_untagged, {pct("NOT contains(response, '<answer>')")} AS untagged_pct
 FROM rollouts r JOIN responses s USING (group_id, k) WHERE outcome = 0 AND perception >= 0.5 GROUP BY r.bench, r.model""",
)
def ft_no_answer_tag(spark, sf):
    texts = view(spark, sf, "responses").select(*KEYS, F.contains("response", F.lit("<answer>")).alias("tagged"))
    rows = failed(spark, sf, True).join(texts, KEYS)
    return rows.groupBy("bench", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("tagged").alias("n_tagged"),
        F.count_if(~F.col("tagged")).alias("n_untagged"),
        percent(~F.col("tagged")).alias("untagged_pct"),
    )


@query(
    "ft_artifact_audit",
    ("served", "claim_checks", "judge_outputs"),
    f""", i AS (SELECT bench, count(*) AS n, count(*) FILTER (WHERE starts_with({CONTENT}, 'ERROR')) AS inference_errors, count(*) FILTER (WHERE {st(CONTENT)} = '' AND {st(REASON)} = '') AS empty_traces,
 count(*) FILTER (WHERE {st(CONTENT)} = '') AS no_final_text, count(*) FILTER (WHERE {THINK_SQL} = '') AS segmentation_empty FROM served GROUP BY bench),
nf AS (SELECT bench, avg(CASE WHEN {NF} THEN 1.0 ELSE 0.0 END) AS rate FROM claim_checks GROUP BY bench, group_id),
p AS (SELECT bench, {r6('100 * avg(rate)')} AS not_found_pct FROM nf GROUP BY bench),
j AS (SELECT id, bench, raw, {VERDICT_SQL['remote']} AS v FROM judge_outputs),
o AS (SELECT bench, count(*) FILTER (WHERE v = 1) AS judge_pass, count(*) FILTER (WHERE v = 0) AS judge_fail, count(*) FILTER (WHERE v IS NULL) AS judge_null FROM j GROUP BY bench),
s AS (SELECT bench, string_agg(raw, ' | ' ORDER BY id) AS raw_sample FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY bench ORDER BY id) <= 5) GROUP BY bench)
SELECT * FROM i JOIN p USING (bench) JOIN o USING (bench) JOIN s USING (bench)""",
)
def ft_artifact_audit(spark, sf):
    content, reasoning = strip(or_empty(F.col("content"))), strip(or_empty(F.col("reasoning_content")))
    served = view(spark, sf, "served").withColumn("t", G.thinking_text(F.col("content"), F.col("reasoning_content")))
    inference = G.segment_steps(served, "t", "steps").groupBy("bench").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(content.startswith("ERROR")).alias("inference_errors"),
        F.count_if((content == "") & (reasoning == "")).alias("empty_traces"),
        F.count_if(content == "").alias("no_final_text"),
        F.count_if(F.size("steps") == 0).alias("segmentation_empty"),
    )
    per_sample = view(spark, sf, "claim_checks").groupBy("bench", "group_id").agg(
        F.avg(V.not_found(F.col("response")).cast("double")).alias("rate")
    )
    perception = per_sample.groupBy("bench").agg(F.round(100 * F.avg("rate"), 6).alias("not_found_pct"))
    judged = view(spark, sf, "judge_outputs").withColumn("v", V.remote(F.col("raw")))
    outcome = judged.groupBy("bench").agg(
        F.count_if(F.col("v") == 1).alias("judge_pass"),
        F.count_if(F.col("v") == 0).alias("judge_fail"),
        F.count_if(F.col("v").isNull()).alias("judge_null"),
    )
    first = first_rows(judged, ["bench"], ["id"], 5)
    shown = first.groupBy("bench").agg(F.array_sort(F.collect_list(F.struct("rn", F.col("raw").alias("t")))).alias("s"))
    sample = shown.select("bench", F.array_join(F.col("s.t"), " | ").alias("raw_sample"))
    return inference.join(perception, "bench").join(outcome, "bench").join(sample, "bench")


NUMS = r"-?\d+(?:\.\d+)?"


@query(
    "ft_suspicious_false_negative",
    "answer_pairs",
    f""", p AS (SELECT group_id, k, form, unnest({ra('pred', NUMS)})::DOUBLE AS p FROM answer_pairs), g AS (SELECT group_id, k, unnest({ra('gold', NUMS)})::DOUBLE AS g FROM answer_pairs),
m AS (SELECT DISTINCT group_id, k FROM p JOIN g USING (group_id, k) WHERE abs(p - g) / greatest(abs(g), 1e-10) <= 0.05)
SELECT bench, form, count(*) AS n_failed, count(m.group_id) AS n_suspicious FROM answer_pairs a LEFT JOIN m USING (group_id, k) WHERE lower({st('pred')}) <> lower({st('gold')}) GROUP BY bench, form""",
)
def ft_suspicious_false_negative(spark, sf):
    # the strictest scorer (equal text) failed these answers
    rows = view(spark, sf, "answer_pairs").where(S.same_text(F.col("pred"), F.col("gold")) == 0)
    numbers = lambda c: F.transform(every(F.col(c), NUMS), plain_number)
    near = F.exists(
        numbers("pred"),
        lambda p: F.exists(numbers("gold"), lambda g: F.abs(p - g) / F.greatest(F.abs(g), F.lit(1e-10)) <= 0.05),
    )
    return rows.groupBy("bench", "form").agg(
        F.count(F.lit(1)).alias("n_failed"), F.count_if(near).alias("n_suspicious")
    )


@query(
    "ft_top_examples",
    "rollouts",
    f"""SELECT bench, model, group_id, k, {r6('perception')} AS perception, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY bench, model ORDER BY group_id, k) AS rn
 FROM rollouts WHERE outcome = 0 AND perception >= 0.7) WHERE rn <= 3""",
)
def ft_top_examples(spark, sf):
    rows = failed(spark, sf).where("perception >= 0.7")
    return first_rows(rows, ["bench", "model"], ["group_id", "k"], 3).select(
        "bench", "model", "group_id", "k", F.round("perception", 6).alias("perception"), "rn"
    )


@query(
    "ft_examples_by_rule",
    "documents",
    DIST_SQL
    + """ SELECT rule, doc_id, family, CAST(rn AS INT) AS rn, n AS n_of_rule FROM (SELECT rule, doc_id, family, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS rn,
 count(*) OVER (PARTITION BY rule) AS n FROM dr WHERE rule <> 'kept') WHERE rn <= 3""",
)
def ft_examples_by_rule(spark, sf):
    """The first three documents that each quality rule drops, and how many it drops in all."""
    rows = distilled(spark, sf).where("rule <> 'kept'").select("rule", "doc_id", "family")
    counts = rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n_of_rule"))
    return first_rows(rows, ["rule"], ["doc_id"], 3).join(counts, "rule").select("rule", "doc_id", "family", "rn", "n_of_rule")


@query(
    "ft_examples_by_pattern",
    "steps",
    VD_SQL
    + f""", p AS (SELECT sample_id, k, {PATTERN_V1} AS pattern FROM vd),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY md5(concat_ws('|', CAST(sample_id AS VARCHAR), CAST(k AS VARCHAR))), sample_id, k) AS rn, count(*) OVER (PARTITION BY pattern) AS n FROM p)
SELECT pattern, sample_id, k, CAST(rn AS INT) AS rn, n AS n_of_pattern FROM r WHERE rn <= 5""",
)
def ft_examples_by_pattern(spark, sf):
    """Five random steps of each pattern, the same in every run, and how many there are."""
    rows = view(spark, sf, "steps").select("sample_id", "k", pattern_of(F.col("mc_with"), F.col("mc_without")).alias("pattern"))
    counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_of_pattern"))
    ordered = rows.withColumn("_o", F.md5(F.concat_ws("|", F.col("sample_id").cast("string"), F.col("k").cast("string"))))
    return first_rows(ordered, ["pattern"], ["_o", "sample_id", "k"], 5).join(counts, "pattern").select("pattern", "sample_id", "k", "rn", "n_of_pattern")
