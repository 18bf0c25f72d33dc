"""Queries over the shared text helpers, run as grouped jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import extract as X
from tracelab.functions import scoring as S
from tracelab.functions import text as T
from tracelab.functions import verdicts as V
from tracelab.plans.answers import normalize_sql, rejoined_sql
from tracelab.plans.claims import GOT, NF
from tracelab.plans.process import NUMERIC_SQL, WORDS, span_sql
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import nest, st
from tracelab.sources.fixtures import view

# Answer texts with lead-ins, quotes, ranges, units and yes/no forms around the pair's answer.
WRAPPED = """CASE form WHEN 0 THEN concat('The answer is **', pred, '**.') WHEN 1 THEN concat('"', pred, '"') WHEN 2 THEN concat(pred, ', because the bar is higher') WHEN 3 THEN concat('Answer: ', pred)
 WHEN 4 THEN concat('2010 to 20', CAST(10 + k AS STRING)) WHEN 5 THEN concat('It is about ', pred, ' in the end of all') WHEN 6 THEN 'Norway' WHEN 7 THEN concat('Thus, ', pred, ' billion') WHEN 8 THEN concat(gold, 'k')
 WHEN 9 THEN concat('There are ', pred, ' bars and ', gold, ' lines') ELSE pred END"""


@query(
    "normalize_answer",
    "answer_pairs",
    "SELECT form, pred AS answer, count(*) AS n FROM "
    + nest(f"(SELECT form, {st(WRAPPED)} AS raw FROM answer_pairs)", normalize_sql("raw"))
    + " GROUP BY form, pred",
)
def normalize_answer(spark, sf):
    rows = view(spark, sf, "answer_pairs").select("form", T.strip(F.expr(WRAPPED)).alias("raw"))
    rows = X.run_stages(rows, X.normalize_stages("raw", "answer"))
    return rows.groupBy("form", "answer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reconstruct_response",
    "served",
    f"SELECT bench, v, count(*) AS n, CAST(sum(length(response)) AS BIGINT) AS chars, count(*) FILTER (WHERE response LIKE '<think>%' AND response NOT LIKE '%</think>%') AS n_open, md5(max(response)) AS top FROM {rejoined_sql('served')} GROUP BY bench, v",
)
def reconstruct_response(spark, sf):
    rows = view(spark, sf, "served").select("bench", "v", T.rejoin(F.col("content"), F.col("reasoning_content")).alias("r"))
    opened = F.col("r").startswith("<think>") & ~F.col("r").contains("</think>")
    return rows.groupBy("bench", "v").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("r")).cast("bigint").alias("chars"),
        F.count_if(opened).alias("n_open"),
        F.md5(F.max("r")).alias("top"),
    )


@query(
    "reasoning_span",
    "responses",
    f"SELECT bench, v, count(*) AS n, CAST(sum({WORDS('span')}) AS BIGINT) AS span_words, md5(max(span)) AS top, CAST(sum(CASE WHEN contains(response, '</think>') THEN {WORDS('span')} ELSE 0 END) AS BIGINT) AS think_words FROM (SELECT *, {span_sql()} AS span FROM responses) GROUP BY bench, v",
)
def reasoning_span(spark, sf):
    span = T.reasoning_span(F.col("response"))
    rows = view(spark, sf, "responses").select("bench", "v", "response", span.alias("span"))
    return rows.groupBy("bench", "v").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(T.words(F.col("span"))).cast("bigint").alias("span_words"),
        F.md5(F.max("span")).alias("top"),
        F.sum(T.think_words(F.col("response"))).cast("bigint").alias("think_words"),
    )


@query(
    "is_numeric_gold",
    "answer_pairs",
    f"SELECT form, {NUMERIC_SQL} AS numeric, count(*) AS n, min(gold) AS first_gold, max(gold) AS last_gold FROM answer_pairs GROUP BY ALL",
)
def is_numeric_gold(spark, sf):
    rows = view(spark, sf, "answer_pairs").select("form", "gold", S.is_numeric(F.col("gold")).alias("numeric"))
    return rows.groupBy("form", "numeric").agg(
        F.count(F.lit(1)).alias("n"), F.min("gold").alias("first_gold"), F.max("gold").alias("last_gold")
    )


@query(
    "not_found_flag",
    "claim_checks",
    f"SELECT bench, type, count(*) AS n, count(*) FILTER (WHERE {NF}) AS n_not_found, count({GOT}) AS n_numbers, {r6(f'sum({GOT})')} AS total FROM claim_checks GROUP BY bench, type",
)
def not_found_flag(spark, sf):
    said = F.col("response")
    rows = view(spark, sf, "claim_checks").select("bench", "type", V.not_found(said).alias("nf"), V.first_number(said).alias("got"))
    return rows.groupBy("bench", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("nf").alias("n_not_found"),
        F.count("got").alias("n_numbers"),
        F.round(F.sum("got"), 6).alias("total"),
    )
