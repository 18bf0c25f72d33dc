"""Input tables of the jobs, as views over the given Parquet tables.

Each view is a list of SQL expressions that Spark and the checking engine share, so both
sides see the same rows. ``view()`` builds the Spark DataFrame, ``view_sql()`` the text of
the same view for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]

BENCH = "CASE group_id % 3 WHEN 0 THEN 'bench_a' WHEN 1 THEN 'bench_b' ELSE 'bench_c' END"
MODEL = "concat('m', CAST(group_id % 4 AS STRING))"

LINES = [
    "l_orderkey AS group_id", "k", "l_partkey", "l_suppkey", "l_linenumber",
    "CAST(l_quantity AS INT) AS qty", "CAST(round(l_discount*100) AS INT) AS disc",
]

ROLLOUTS = [
    "group_id", "k", f"{BENCH} AS bench", f"{MODEL} AS model",
    "CASE WHEN group_id % 5 = 0 THEN 1 WHEN group_id % 5 = 1 THEN 0 WHEN l_linenumber = 7 THEN NULL"
    " WHEN qty <= 25 THEN 1 ELSE 0 END AS outcome",
    "CASE WHEN qty < 4 THEN NULL WHEN group_id % 7 = 0 THEN CAST(1 AS DOUBLE)"
    " ELSE CAST(disc AS DOUBLE) / 10 END AS perception",
]

STEPS = [
    "group_id AS sample_id", "k", f"{BENCH} AS bench", f"{MODEL} AS model",
    "CASE WHEN l_linenumber = 7 THEN NULL WHEN group_id % 4 = 0 THEN CAST(0 AS DOUBLE)"
    " WHEN group_id % 11 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(l_partkey % 7 AS DOUBLE) / 6 END AS mc_with",
    "CASE WHEN group_id % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(l_suppkey % 7 AS DOUBLE) / 6 END AS mc_without",
]

# Axis verdicts of a step (1 yes, 0 no, null no claim) and a stricter second verdict of the value axis.
AXES = [
    "group_id", "k", f"{BENCH} AS bench", f"{MODEL} AS model",
    "CASE qty % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS ax_value",
    "CASE disc % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS ax_label",
    "CASE l_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS ax_count",
    "CASE l_suppkey % 3 WHEN 0 THEN NULL ELSE 1 END AS ax_structure",
    "CASE qty % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE 1 END AS ax_value_strict",
]

CELLS_QUANTITY = [
    "group_id AS chart_id", "k AS row_idx", "concat('item ', CAST(l_partkey AS STRING)) AS label",
    "'quantity' AS col", "CAST(qty AS DOUBLE) AS value",
]
CELLS_DISCOUNT = CELLS_QUANTITY[:3] + ["'discount_pct' AS col", "CAST(disc AS DOUBLE) AS value"]

RESPONSE_BASE = [
    "group_id", "k", "l_partkey", "l_suppkey", "qty", "disc", "qty + disc AS gold_n",
    "CASE WHEN l_suppkey % 3 = 0 THEN qty + disc + 17 ELSE qty + disc END AS ans",
    "(group_id + k) % 8 AS v",
]
RESPONSE_BODY = [
    "*",
    "concat('First, item ', CAST(l_partkey % 900 AS STRING), ' shows quantity ', CAST(qty AS STRING),"
    " '.~~Next, ', CAST(qty AS STRING), ' + ', CAST(disc AS STRING), ' = ', CAST(ans AS STRING), '.',"
    # every third prompt has a long trace
    " CASE WHEN group_id % 3 = 0 THEN '~~After that we look once more at every bar of the figure, compare it with its neighbours on both sides,"
    " ask whether the legend and the caption say the same, and keep the sum because nothing speaks against it.' ELSE '' END) AS body",
    "CAST(ans AS STRING) AS a",
]
RESPONSES = [
    "group_id", "k", "v", f"{BENCH} AS bench", f"{MODEL} AS model",
    "CASE WHEN v = 6 THEN 'Yes' ELSE CAST(gold_n AS STRING) END AS gold",
    "replace(replace(CASE v WHEN 0 THEN concat('<think>~', body, '~</think>~<answer>', a, '</answer>')"
    " WHEN 1 THEN concat('<think>~', body, '~</think>~So ^boxed{', a, '}')"
    " WHEN 2 THEN concat('<think>~', body)"
    " WHEN 3 THEN concat(body, '~The answer is ', a, '.')"
    " WHEN 4 THEN concat(body, '~<answer>', a)"
    " WHEN 5 THEN concat('<think>~Format is <answer>42</answer>~', body, '~</think>~<answer>', a, '</answer>')"
    " WHEN 6 THEN concat('<think>~', body, '~</think>~<answer>', CASE WHEN l_suppkey % 3 = 0"
    " THEN 'No, it is lower than the other item' ELSE 'Yes' END, '</answer>')"
    " ELSE concat('<think>~', body, '~</think>~<answer>', a, ' million</answer>') END,"
    " '~', chr(10)), '^', chr(92)) AS response",
]
# The served form of a response: reasoning channel and content channel apart.
SERVED = [
    "group_id", "k", "v", "bench", "model", "gold",
    "CASE WHEN response LIKE '%</think>%' THEN replace(split_part(response, '</think>', 1), '<think>', '')"
    " WHEN response LIKE '<think>%' THEN replace(response, '<think>', '') ELSE NULL END AS reasoning_content",
    "CASE WHEN response LIKE '%</think>%' THEN split_part(response, '</think>', 2)"
    " WHEN response LIKE '<think>%' THEN '' ELSE response END AS content",
]

# Answer texts in twelve forms against gold answers, right and wrong ones in each form.
ANSWER_PAIRS = [
    "group_id", "k", f"{BENCH} AS bench", f"{MODEL} AS model", "(group_id + k) % 12 AS form",
    "CASE (group_id + k) % 12 WHEN 0 THEN concat(CAST(qty AS STRING), '%') WHEN 1 THEN concat('$', CAST(qty AS STRING), ',500')"
    " WHEN 2 THEN CASE WHEN disc % 2 = 0 THEN 'Yes' ELSE 'no.' END WHEN 3 THEN concat(CAST(qty AS STRING), ' million')"
    " WHEN 4 THEN CASE WHEN disc % 3 = 0 THEN '0' ELSE concat('0.00', CAST(disc AS STRING)) END WHEN 5 THEN concat(CAST(qty AS STRING), 'e1')"
    " WHEN 6 THEN concat('Option ', chr(65 + disc % 5)) WHEN 7 THEN concat('  Item ', CAST(qty AS STRING), '. ')"
    " WHEN 8 THEN '' WHEN 9 THEN concat(CAST(qty AS STRING), '.', CAST(disc AS STRING)) WHEN 10 THEN 'true story, it is'"
    " ELSE concat('-', CAST(qty AS STRING)) END AS pred",
    "CASE (group_id + k) % 12 WHEN 0 THEN concat(CAST(qty + disc % 3 AS STRING), '%') WHEN 1 THEN CAST(qty * 1000 + 300 + disc * 50 AS STRING)"
    " WHEN 2 THEN CASE WHEN qty % 2 = 0 THEN 'yes' ELSE 'No' END WHEN 3 THEN CAST(qty + disc % 4 AS STRING) WHEN 4 THEN '0'"
    " WHEN 5 THEN CAST(qty * 10 + disc AS STRING) WHEN 6 THEN chr(65 + qty % 5) WHEN 7 THEN concat('item ', CAST(qty - disc % 2 AS STRING))"
    " WHEN 8 THEN 'No' WHEN 9 THEN CAST(qty AS STRING) WHEN 10 THEN CASE WHEN disc % 2 = 0 THEN 'TRUE' ELSE 'Nowhere' END"
    " ELSE concat('-', CAST(qty + disc % 3 AS STRING), ' k') END AS gold",
]

JUDGE_OUTPUTS = [
    "o_orderkey AS id",
    f"{BENCH.replace('group_id', 'o_orderkey')} AS bench",
    f"{MODEL.replace('group_id', 'o_orderkey')} AS model",
    "replace(CASE o_orderkey % 9 WHEN 0 THEN 'Reasoning. Verdict: Correct' WHEN 1 THEN 'Verdict: Incorrect'"
    " WHEN 2 THEN 'Yes' WHEN 3 THEN 'No.' WHEN 4 THEN 'Analysis: close.~Correctness: Yes'"
    " WHEN 5 THEN 'sure {\"extracted_answer\": \"7\", \"score\": 1} ok' WHEN 6 THEN 'Q1: YES~Q2: NO~Q3: NA~Q4: yes'"
    " WHEN 7 THEN 'LABEL: D~QUOTE: the blue bar~is the taller one~REASON: wrong series' ELSE 'ERROR: TimeoutError: 120s' END, '~', chr(10)) AS raw",
]

# Claim lists as JSON in surrounding talk, some broken.
CLAIM_TEXTS = [
    "group_id", "k", f"{BENCH} AS bench",
    "CASE (group_id + k) % 9 WHEN 0 THEN 'no list here' WHEN 1 THEN '[{broken' ELSE concat('Here: [{\"entity\": \"item ', CAST(l_partkey AS STRING),"
    " '\", \"value\": ', CAST(qty AS STRING), ', \"type\": \"value\"}, {\"entity\": \"', CASE WHEN disc % 4 = 0 THEN ' ' ELSE concat('group ', CAST(disc AS STRING)) END,"
    " '\", \"value\": null, \"type\": \"odd\"}, 5] done') END AS raw",
]
# Step texts with claims of every kind, one without and one with loose digits only.
STEP_TEXTS = [
    "group_id", "k", f"{BENCH} AS bench",
    "CASE (group_id + k) % 6 WHEN 0 THEN concat('The value of Item ', CAST(l_partkey AS STRING), ' is ', CAST(qty AS STRING), '.')"
    " WHEN 1 THEN concat('Quantity: ', CAST(qty AS STRING), '% while Region (', CAST(disc AS STRING), ')') WHEN 2 THEN concat('The highest value is Region ', CAST(disc AS STRING))"
    " WHEN 3 THEN concat('There are ', CAST(disc AS STRING), ' bars, the x-axis shows Item Group North, legend is Series ', CAST(disc AS STRING))"
    " WHEN 4 THEN concat(CAST(qty AS STRING), ' or ', CAST(disc AS STRING), ' units') ELSE 'let me look again' END AS text",
]
# One claim per line with the verifier's text answer.
CLAIM_CHECKS = [
    "group_id", "k", f"{BENCH} AS bench", "concat('Item ', CAST(l_partkey AS STRING)) AS entity", "CAST(qty AS DOUBLE) AS claim_value",
    "CASE WHEN l_partkey % 3 = 0 THEN 'categorical' ELSE 'value' END AS type",
    "CASE l_suppkey % 7 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN concat('The value is ', CAST(qty AS STRING), '.') WHEN 2 THEN concat('approx ', CAST(qty + disc AS STRING))"
    " WHEN 3 THEN 'cannot tell' WHEN 4 THEN concat('It is item-', CAST(l_partkey AS STRING)) WHEN 5 THEN 'ERROR: timeout' ELSE concat(CAST(qty * 2 AS STRING), ' units') END AS response",
]
# Taxonomy labels given to samples.
TAXONOMY = [
    "o_orderkey AS id", f"{BENCH.replace('group_id', 'o_orderkey')} AS bench", f"{MODEL.replace('group_id', 'o_orderkey')} AS model",
    "concat('LABEL: ', chr(65 + CAST(o_custkey % 7 AS INT)), chr(10), 'REASON: case ', CAST(o_custkey % 5 AS STRING)) AS raw",
]

CORPUS_LITE = [
    "doc_id", "source", "lang", "text AS question", "md5(text) AS question_md5",
    "CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('src/', source, '/', CAST(doc_id AS STRING), '.png') END AS image_path",
    "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars END AS answer",
]
CORPUS_DISTILLED = [
    "doc_id", "md5(text) AS question_md5",
    "concat('src/', source, '/', CAST(doc_id AS STRING), '.png') AS image_path",
    "n_chars AS teacher_reasoning_len", "lang AS format_family", "CAST(n_chars AS STRING) AS teacher_pred", "quality = 1 AS teacher_match",
    "CASE WHEN toxic = 1 THEN 'length' ELSE 'stop' END AS teacher_finish_reason",
]


LINE_VIEWS = {
    "rollouts": ROLLOUTS, "steps": STEPS, "axes": AXES, "answer_pairs": ANSWER_PAIRS,
    "claim_texts": CLAIM_TEXTS, "step_texts": STEP_TEXTS, "claim_checks": CLAIM_CHECKS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, tasks: int | None = None) -> DataFrame:
    """One derived input view as a DataFrame; ``lines`` of orders with a key can be dealt by order to a number of ``tasks``."""
    if name == "lines":
        needed = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
        needed = needed if tasks is None else needed.where("l_orderkey IS NOT NULL").repartition(tasks, "l_orderkey")
        # line numbers run from 1 to 7, so an order is a bounded group; the numbering costs nothing where ``k`` is not used
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
        return needed.withColumn("k", place).selectExpr(*LINES)
    if name in LINE_VIEWS:
        return view(spark, sf_dir, "lines").selectExpr(*LINE_VIEWS[name])
    if name == "chart_cells":
        lines = view(spark, sf_dir, "lines")
        return lines.select(
            F.col("group_id").alias("chart_id"),
            F.col("k").alias("row_idx"),
            F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("label"),
            F.expr("stack(2, 'quantity', CAST(qty AS DOUBLE), 'discount_pct', CAST(disc AS DOUBLE)) AS (col, value)"),
        )
    if name == "responses":
        base = view(spark, sf_dir, "lines").selectExpr(*RESPONSE_BASE)
        return base.selectExpr(*RESPONSE_BODY).selectExpr(*RESPONSES)
    if name == "served":
        return view(spark, sf_dir, "responses").selectExpr(*SERVED)
    if name == "judge_outputs":
        return table(spark, sf_dir, "orders").selectExpr(*JUDGE_OUTPUTS)
    if name == "taxonomy":
        return table(spark, sf_dir, "orders").selectExpr(*TAXONOMY)
    if name == "corpus_lite":
        return table(spark, sf_dir, "documents").selectExpr(*CORPUS_LITE)
    if name == "corpus_distilled":
        # the teacher answered the labelled documents
        labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        return table(spark, sf_dir, "documents").join(labels, "doc_id").selectExpr(*CORPUS_DISTILLED)
    return table(spark, sf_dir, name)


def _select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


_NUMBERED = (
    "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY "
    + ", ".join(LINE_ORDER)
    + ") - 1 AS INT) AS k FROM lineitem)"
)

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), _select(LINES, _NUMBERED)),
    **{name: (("lines",), _select(columns, "lines")) for name, columns in LINE_VIEWS.items()},
    "chart_cells": (
        ("lines",),
        _select(CELLS_QUANTITY, "lines") + " UNION ALL " + _select(CELLS_DISCOUNT, "lines"),
    ),
    "responses": (
        ("lines",),
        _select(RESPONSES, f"({_select(RESPONSE_BODY, f'({_select(RESPONSE_BASE, 'lines')})')})"),
    ),
    "served": (("responses",), _select(SERVED, "responses")),
    "judge_outputs": ((), _select(JUDGE_OUTPUTS, "orders")),
    "taxonomy": ((), _select(TAXONOMY, "orders")),
    "corpus_lite": ((), _select(CORPUS_LITE, "documents")),
    "corpus_distilled": ((), _select(
        CORPUS_DISTILLED, "documents JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)"
    )),
}


def view_sql(*names: str) -> str:
    """``WITH`` list that defines the named views and all they rest on."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in VIEW_SQL:  # a given table
            return
        needs, sql = VIEW_SQL[name]
        for need in needs:
            add(need)
        done.setdefault(name, f"{name} AS MATERIALIZED ({sql})")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(done.values()) if done else ""
