"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it to the shared folder as
Parquet and reads it again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import decontaminate, minhash, mixing, quality, sharding
from tracelab.llm.common import staged, table

#: The learned rules and the similarity search have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id stays of every near-duplicate class, and one row of those that repeat an id and text.

    Rows of a null ``doc_id`` are linked with nothing and stay. An id names one document: if a row of it goes, all do.
    """
    classes = minhash.near_duplicates(docs).where("doc_id is not null")
    marks = classes.groupBy("doc_id").agg(F.max(~F.col("kept")).alias("gone"), F.count(F.lit(1)).alias("rows")).where("gone or rows > 1")
    marks = staged(marks, "near-marks")
    ids = lambda condition: marks.where(condition).select("doc_id")
    kept = docs.join(ids("gone"), "doc_id", "left_anti")
    if ids("not gone").isEmpty():
        return kept
    # only rows of repeated ids are compared; of equal ones the first by all columns stays
    repeated = kept.join(ids("not gone"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return kept.join(ids("not gone"), "doc_id", "left_anti").unionByName(repeated.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, by a Poisson draw at their source's rate, in random order."""
    return mixing.mix(docs).drop("_copy", "_place")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of ``documents`` plus ``size, shard, slot``; columns of these names that the input has give way."""
    names = {"_size": "size", "_shard": "shard", "_slot": "slot"}
    return sharding.shard(docs.drop(*names.values())).withColumnsRenamed(names)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
