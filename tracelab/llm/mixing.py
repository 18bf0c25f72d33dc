"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import staged

#: Shares asked for by name; all other sources share the rest in proportion to their size.
TARGETS = {"src0": 0.25, "src1": 0.10, "src2": 0.08}
SEED = "mix-1"
BROADCAST_ROWS = 100_000


def _uniform(key: Column) -> Column:
    """A number inside (0, 1) from the md5 of a key: 52 bits, the middle of the cell."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def rates(docs: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = 1.0) -> DataFrame:
    """Mean number of copies per document of every source: ``source, n, rate``.

    A named source gets its share of ``epochs`` times all documents; the others divide what is left in proportion to
    their size (nothing if no share is left). A null source is a source of its own. Documents are counted before the
    shuffle, so a source with a third of all rows is one small row per task.
    """
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares must be non-negative and add up to 1 at most")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(None).cast("double")
    for name, weight in targets.items():
        share = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(share)
    named = sizes.withColumn("share", share)
    total = named.agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("share").isNull(), F.col("n"))).alias("others"), F.sum("share").alias("taken")
    ).first()
    left = max(0.0, 1.0 - (total["taken"] or 0.0))
    other = epochs * (total["all"] or 0) * left / (total["others"] or 1)
    return named.select("source", "n", F.coalesce(epochs * (total["all"] or 0) * F.col("share") / F.col("n"), F.lit(other)).alias("rate"))


def poisson_count(u: Column, rate: Column) -> Column:
    """Inverse of the Poisson distribution: how many cumulative probabilities lie at or below ``u``.

    Terms are exp(k ln r - r - ln k!) up to r + 12 sqrt(r) + 30, beyond which less than 2**-53 is left.
    """
    last = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("log_factorial"), F.lit(0).alias("n"))

    def step(s, k):
        log_factorial = s["log_factorial"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
        total = s["sum"] + F.exp(k * F.log(rate) - rate - log_factorial)
        return F.struct(total.alias("sum"), log_factorial.alias("log_factorial"), (s["n"] + (total <= u).cast("int")).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step)["n"]).otherwise(0)


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every document as often as its own Poisson draw says, in random order: columns of ``docs`` plus ``_copy, _place``.

    The draw depends on seed and ``doc_id`` alone, so a lost executor repeats it and repeated rows share it; a null
    ``doc_id`` draws as the text 'null'. Copies are numbered from 0. ``_place`` is the md5 of seed, id and copy: rows are
    dealt over partitions by it and sorted by it inside each, which is a uniform shuffle of the whole, and reading
    the partitions of a written result one after another reads in random order. The rates are counted before
    they join by source: broadcast up to ``BROADCAST_ROWS`` sources, else left to adaptive execution with its skew split.
    """
    known = rates(docs, targets, epochs).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    known = staged(known, "rates")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = docs.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_n", poisson_count(_uniform(key), F.col("_rate")))
    copies = drawn.where("_n > 0").withColumn("_copy", F.explode(F.expr("sequence(0, _n - 1)")))
    place = F.md5(F.concat_ws("|", key, F.col("_copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("_place", place).drop("_source", "_rate", "_n")
    return dealt.repartition("_place").sortWithinPartitions("_place")


def report(docs: DataFrame) -> DataFrame:
    """Per copy: ``doc_id, source, copy, place``."""
    return mix(docs.select("doc_id", "source")).select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_place").alias("place"))


_NAMED = " ".join(f"WHEN '{name}' THEN {weight!r}" for name, weight in TARGETS.items())
_STEPS = max(200, math.ceil(1 / min(TARGETS.values())))
SQL = f"""
WITH s AS (SELECT source, count(*) AS n, CAST(CASE source {_NAMED} END AS DOUBLE) AS share FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, sum(n) FILTER (WHERE share IS NULL) AS others, sum(share) AS taken FROM s),
r AS (SELECT source, coalesce(total * share / n, total * (1 - coalesce(taken, 0)) / others) AS rate FROM s, t),
k AS (SELECT unnest(range(0, {_STEPS})) AS k),
f AS (SELECT k, sum(CASE WHEN k > 0 THEN ln(CAST(k AS DOUBLE)) ELSE 0 END) OVER (ORDER BY k) AS lf FROM k),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, f),
d AS (SELECT doc_id, source, (CAST('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.source, count(*) AS n FROM d JOIN c ON d.source = c.source AND c.cdf <= d.u GROUP BY ALL),
x AS (SELECT doc_id, source, CAST(unnest(range(0, n)) AS INT) AS copy FROM n)
SELECT doc_id, source, copy, md5('{SEED}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS place FROM x
"""
