"""Registered queries of the training-data operators, and their check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelab.llm import bytecnn, chat, decontaminate, editlines, exactindex, merkle, minhash, mixing, pivotal, quality, secretscan, sharding, urls
from tracelab.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_minhash_bayes", minhash.SQL)
def op5(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_wu_manber", decontaminate.SQL)
def op10(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_decision_list")
def op9(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_poisson_mix", mixing.SQL)
def op8(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op2_minimax_shards")
def op2(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


@query("op1_budgeted_windows")
def op1(spark, sf_dir):
    return chat.report(chat.with_probe(table(spark, sf_dir, "conversations")))


@query("op3_byte_cnn")
def op3(spark, sf_dir):
    return bytecnn.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_template_tree", urls.SQL)
def op6(spark, sf_dir):
    return urls.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op7_secret_cnn")
def op7(spark, sf_dir):
    return secretscan.report(table(spark, sf_dir, "documents"))


@query("op4_edit_lines", editlines.SQL)
def op4(spark, sf_dir):
    return editlines.report(table(spark, sf_dir, "documents"))


@query("op11_extendible_hash", exactindex.SQL)
def op11(spark, sf_dir):
    return exactindex.report(table(spark, sf_dir, "documents"))


@query("op12_pivotal_grams", pivotal.SQL)
def op12(spark, sf_dir):
    return pivotal.variants(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", merkle.SQL)
def op13(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))
