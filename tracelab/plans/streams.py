"""Queries that run a stream over the given tables and return what it wrote."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tracelab.functions import verdicts as V
from tracelab.plans.answers import VERDICT_SQL
from tracelab.plans.registry import query, r6
from tracelab.session import fresh_folder
from tracelab.sources.fixtures import JUDGE_OUTPUTS
from tracelab.streaming import jobs


def written(spark, rows, run=jobs.run_available):
    base = fresh_folder(spark)
    run(rows, out=f"{base}/out", checkpoint=f"{base}/state")
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def event_stream(spark, sf):
    # event time must be a timestamp with zone; the files hold it without
    return jobs.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "st_incremental_scoring",
    "judge_outputs",
    f"SELECT bench, model, count(*) AS n, count(v) AS n_scored, CAST(sum(v) AS BIGINT) AS n_pass FROM (SELECT *, {VERDICT_SQL['remote']} AS v FROM judge_outputs) GROUP BY bench, model",
)
def st_incremental_scoring(spark, sf):
    texts = jobs.stream_table(spark, sf, "orders").selectExpr(*JUDGE_OUTPUTS)
    scored = texts.select("id", "bench", "model", V.remote(F.col("raw")).alias("v"))
    return written(spark, scored).groupBy("bench", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_scored"), F.sum("v").cast("bigint").alias("n_pass")
    )


@query(
    "st_resume_dedupe",
    "events",
    f"SELECT event_type, count(*) AS n, {r6('sum(value)')} AS total FROM (SELECT DISTINCT ON (event_id) * FROM events ORDER BY event_id) GROUP BY event_type",
)
def st_resume_dedupe(spark, sf):
    events = event_stream(spark, sf).select("event_id", "ts", "event_type", "value")
    rows = written(spark, events.unionByName(events), partial(jobs.dedupe_available, key="event_id"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


@query(
    "st_reward_telemetry",
    "events",
    f"""SELECT strftime(d, '%Y-%m-%d') AS window_day, event_type, count(*) AS n, {r6('avg(value)')} AS reward_mean, {r6('stddev_pop(value)')} AS reward_std, {r6('avg(CASE WHEN value >= 0.95 THEN 1.0 ELSE 0.0 END)')} AS frac_correct
 FROM (SELECT *, date_trunc('day', ts) AS d FROM events) GROUP BY d, event_type""",
)
def st_reward_telemetry(spark, sf):
    events = event_stream(spark, sf).select("ts", "event_type", "value")
    keys = ["window_start", "event_type"]
    moments = written(spark, jobs.reward_windows(events, "ts", "event_type", "value"), partial(jobs.totals_available, keys=keys))
    day = F.date_format("window_start", "yyyy-MM-dd").alias("window_day")
    return jobs.telemetry(moments, *keys).select(day, "event_type", "n", *[F.round(c, 6).alias(c) for c in ("reward_mean", "reward_std", "frac_correct")])


@query(
    "st_reward_totals",
    "events",
    f"""SELECT event_type, count(value) AS n, {r6('avg(value)')} AS reward_mean, {r6('stddev_pop(value)')} AS reward_std, {r6('avg(CASE WHEN value >= 0.95 THEN 1.0 ELSE 0.0 END)')} AS frac_correct FROM events GROUP BY event_type""",
)
def st_reward_totals(spark, sf):
    """Totals over all days, merged from the windows' moments."""
    events = event_stream(spark, sf).select("ts", "event_type", "value")
    moments = written(spark, jobs.reward_windows(events, "ts", "event_type", "value"), partial(jobs.totals_available, keys=["window_start", "event_type"]))
    rows = jobs.telemetry(jobs.merged_moments(moments, ["event_type"]), "event_type")
    return rows.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("reward_mean", "reward_std", "frac_correct")])
