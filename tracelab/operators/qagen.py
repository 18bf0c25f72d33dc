"""Rule-based questions from chart tables in long form.

Every generator reduces a chart to one row of facts by grouped aggregates (which combine before
the shuffle, so a hot chart is no problem) and then writes its questions from templates.
A template is (name, answer type, condition, number, text); the last three are SQL expressions
over the facts. Random picks follow an md5 order and so are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.operators.scale import exact_quantiles, first_rows
from tracelab.operators.wording import record

Template = tuple[str, str, str, str | None, str | None]

# Fixed value: words that mark a column as no value column.
NOT_VALUE = r"(?i)year|date|time|index"
#: Invented entity names, for questions that no chart can answer.
FICTIONAL = ["Brindlemoor", "Quenlith", "Ostravane", "Pellucidar Bay", "Tharnholm", "Vexley Sound"]
UNANSWERABLE = "Cannot be determined"


def wording(name: str) -> list[Column]:
    """Question text, reasoning steps and difficulty of a template."""
    difficulty, question, steps = record(name)
    return [
        F.expr(question).alias("question"), F.array(*[F.expr(step) for step in steps]).alias("reasoning_steps"), F.expr(difficulty).alias("difficulty"),
    ]


def write_questions(facts: DataFrame, keys: list[str], templates: list[Template], worded: bool = True) -> DataFrame:
    """One row per question whose condition holds: the answer and, where ``worded``, question, reasoning steps and difficulty."""
    made = []
    for name, kind, condition, number, text in templates:
        value = F.round(F.round(F.expr(number), 6), 2).cast("double") if number else F.lit(None).cast("double")
        words = F.expr(text).cast("string") if text else F.lit(None).cast("string")
        made.append(
            F.when(
                F.expr(condition),
                F.struct(
                    F.lit(name).alias("template"),
                    F.lit(kind).alias("answer_type"),
                    value.alias("answer_num"),
                    words.alias("answer_text"),
                    *(wording(name) if worded else []),
                ),
            )
        )
    rows = facts.select(*keys, F.explode(F.filter(F.array(*made), lambda q: q.isNotNull())).alias("q"))
    return rows.select(*keys, "q.*")


def pick_key(*parts) -> Column:
    """Order key of a random pick."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def numeric_columns(cells: DataFrame, most: int | None = None) -> DataFrame:
    """Value columns per chart in order: numeric, not year-like unless nothing else is left; all, or the first ``most``."""
    columns = cells.groupBy("chart_id", "col", "col_idx").agg(F.count("value").alias("n"))
    columns = columns.where("n >= 2").withColumn("yearish", F.col("col").rlike(NOT_VALUE))
    plain = columns.groupBy("chart_id").agg(F.count_if(~F.col("yearish")).alias("n_plain"))
    eligible = columns.join(plain, "chart_id").where(~F.col("yearish") | (F.col("n_plain") == 0))
    # one row per column of a chart: a small group
    ranked = eligible.withColumn("rank", F.row_number().over(Window.partitionBy("chart_id").orderBy("col_idx")))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select("chart_id", "col", "n", "rank")


QUARTERS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


SMALL = 64  # cells of a chart column up to which its facts come from one array


def first_facts() -> list[Column]:
    """Extremes and picks of a chart column."""
    entry = F.struct("label", "value")
    order = pick_key(F.col("chart_id").cast("string"), F.col("col"), F.col("row_idx").cast("string"))
    return [
        F.count(F.lit(1)).alias("n"),
        F.max("value").alias("max_v"),
        F.min("value").alias("min_v"),
        F.avg("value").alias("mean_v"),
        F.sum("value").alias("sum_v"),
        F.max_by("label", F.struct(F.col("value"), -F.col("row_idx"))).alias("max_e"),
        F.min_by("label", F.struct(F.col("value"), F.col("row_idx"))).alias("min_e"),
        F.min_by(entry, order).alias("a"),
        F.max_by(entry, order).alias("b"),
    ]


def named_facts() -> list:
    return [
        "n", "max_v", "min_v", "mean_v", "sum_v", "max_e", "min_e",
        F.col("a.label").alias("e1"), F.col("a.value").alias("v1"),
        F.col("b.label").alias("e2"), F.col("b.value").alias("v2"),
        F.col("q50").alias("median_v"),
        F.try_element_at(F.array("q25", "q50", "q75"), (F.col("chart_id") % 3 + 1).cast("int")).alias("cut_v"),
    ]


def column_facts(cells: DataFrame) -> DataFrame:
    """Facts per chart column: extremes and picks, quantiles, halves and counts.

    A column of few cells is read from one array, so that its cells move once at most; longer ones take ``long_column_facts``.
    """
    keys = ["chart_id", "col"]
    cells = cells.where(F.col("value").isNotNull() & F.col("chart_id").isNotNull() & F.col("col").isNotNull())
    facts = first_rows(cells, keys, ["row_idx"], SMALL + 1, "_r").groupBy(*keys).agg(
        *first_facts(), F.max("_r").alias("_r"), F.array_sort(F.collect_list("value")).alias("_v"), F.collect_list(F.struct("row_idx", "value")).alias("_rows")
    )

    def quantile(q: float) -> Column:
        at = F.lit(q) * (F.col("n") - 1)
        low, high = F.get("_v", F.floor(at).cast("int")), F.get("_v", F.ceil(at).cast("int"))
        return (low + (high - low) * (at - F.floor(at))).cast("double")

    def mean(rows: Column) -> Column:
        return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda total, x: total + x["value"]), F.size(rows))

    count = lambda test: F.size(F.filter("_v", test)).cast("bigint")
    half = F.floor(F.col("n") / 2)
    few = facts.where(F.col("_r") <= SMALL).withColumns({name: quantile(q) for name, q in QUARTERS.items()})
    few = few.select(*keys, *named_facts(), "_v", "_rows").select(
        *keys, *FIRST_FACTS,
        mean(F.filter("_rows", lambda x: x["row_idx"] < half)).alias("head_mean"),
        mean(F.filter("_rows", lambda x: x["row_idx"] >= half)).alias("tail_mean"),
        count(lambda v: v > F.col("median_v")).alias("n_above_median"),
        count(lambda v: v > F.col("cut_v")).alias("n_above"),
        count(lambda v: v < F.col("cut_v")).alias("n_below"),
    )
    long = facts.where(F.col("_r") > SMALL).select(*keys)
    # by chart first: the cells of a chart lie together where the chart's rows were numbered
    rest = cells.join(long.select("chart_id").distinct(), "chart_id", "left_semi").join(long, keys, "left_semi")
    return few.unionByName(long_column_facts(rest))


FIRST_FACTS = ["n", "max_v", "min_v", "mean_v", "sum_v", "max_e", "min_e", "e1", "v1", "e2", "v2", "median_v", "cut_v"]


def long_column_facts(cells: DataFrame) -> DataFrame:
    """``column_facts`` in two passes, for columns of any length: extremes and picks, then halves and counts."""
    keys = ["chart_id", "col"]
    first = cells.where(F.col("value").isNotNull()).groupBy(*keys).agg(*first_facts())
    cuts = exact_quantiles(cells.where(F.col("value").isNotNull()), keys, "value", QUARTERS)
    first = first.join(cuts, keys).select(*keys, *named_facts())
    head = F.col("row_idx") < F.floor(F.col("n") / 2)
    v = F.col("value")
    second = (
        cells.where(v.isNotNull())
        .join(first.select(*keys, "n", "median_v", "cut_v"), keys)
        .groupBy(*keys)
        .agg(
            F.avg(F.when(head, v)).alias("head_mean"),
            F.avg(F.when(~head, v)).alias("tail_mean"),
            F.count_if(v > F.col("median_v")).alias("n_above_median"),
            F.count_if(v > F.col("cut_v")).alias("n_above"),
            F.count_if(v < F.col("cut_v")).alias("n_below"),
        )
    )
    return first.join(second, keys)


CORE: list[Template] = [
    ("max_value", "numeric", "n >= 2", "max_v", None),
    ("diff_max_min", "numeric", "n >= 2 AND max_v <> min_v", "max_v - min_v", None),
    ("average", "numeric", "n >= 2", "mean_v", None),
    ("sum", "numeric", "n >= 2 AND n <= 10", "sum_v", None),
    ("ratio", "numeric", "n >= 2 AND max_v <> 0 AND min_v <> 0 AND max_v <> min_v", "max_v / nullif(min_v, 0)", None),
    ("which_highest", "text", "n >= 3", None, "max_e"),
    ("which_lowest", "text", "n >= 3 AND min_e <> max_e", None, "min_e"),
    ("percentage", "numeric", "n >= 3 AND sum_v <> 0", "v1 / nullif(sum_v, 0) * 100", None),
    ("diff_entities", "numeric", "n >= 3", "abs(v1 - v2)", None),
]

BLOCK_A: list[Template] = [
    ("value_reading", "numeric", "n >= 3", "v1", None),
    ("diff_entities", "numeric", "n >= 3", "abs(v1 - v2)", None),
    ("average", "numeric", "n >= 2", "mean_v", None),
    ("which_entity_highest", "text", "n >= 3", None, "max_e"),
    ("which_entity_lowest", "text", "n >= 3 AND min_e <> max_e", None, "min_e"),
    ("title_reading", "text", "n >= 2", None, "concat('Order ', CAST(chart_id AS STRING))"),
    ("label_reading", "text", "n >= 2", None, "col"),
    ("yes_no_comparison", "yesno", "n >= 3", None, "CASE WHEN v1 > v2 THEN 'Yes' ELSE 'No' END"),
    ("trend_direction", "text", "n >= 4", None, "CASE WHEN tail_mean > head_mean THEN 'Increasing' ELSE 'Decreasing' END"),
    ("count_above", "numeric", "n >= 3", "n_above_median", None),
]

BLOCK_B: list[Template] = [
    ("how_many_above", "numeric", "n >= 4", "CASE WHEN chart_id % 2 = 0 THEN n_above ELSE n_below END", None),
    ("which_highest_lowest", "text", "n >= 3", None, "CASE WHEN chart_id % 2 = 0 THEN max_e ELSE min_e END"),
    ("difference_between", "numeric", "n >= 3", "abs(v1 - v2)", None),
    ("average_simple", "numeric", "n >= 2", "mean_v", None),
]
BLOCK_B_WEIGHTS = {
    "value_of": 0.40, "difference_between": 0.20, "which_highest_lowest": 0.15, "how_many_above": 0.15, "average_simple": 0.10,
}


def question_order() -> Column:
    return pick_key(F.col("chart_id").cast("string"), F.col("col"), F.col("template"), F.coalesce("answer_text", F.lit("")))


def type_quota(questions: DataFrame, cap: int = 8) -> DataFrame:
    """Half numeric, 30% text, the rest yes/no per chart; free places go to any type.

    The groups are the questions of one chart, bounded by templates times two columns.
    """
    numeric, text = int(cap * 0.5), int(cap * 0.3)
    quota = {"numeric": numeric, "text": text, "yesno": cap - numeric - text}
    # dealt by chart once, for both rankings
    ranked = questions.repartition("chart_id").withColumn("_o", question_order())
    limit = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    ranked = first_rows(ranked, ["chart_id", "answer_type"], ["_o"], 100, "_r")
    ranked = ranked.withColumn("_late", (F.col("_r") > F.try_element_at(limit, F.col("answer_type"))).cast("int"))
    return first_rows(ranked, ["chart_id"], ["_late", "_o"], cap, "slot").drop("_o", "_r", "_late")


def block_b(cells: DataFrame, facts: DataFrame, cap: int) -> DataFrame:
    """Value readings of up to four entities per column, plus the other templates, by weight and cap."""
    keys = ["chart_id", "col"]
    asked = cells.where(F.col("value").isNotNull() & F.col("chart_id").isNotNull() & F.col("col").isNotNull())
    first = first_rows(asked, keys, [pick_key(F.col("chart_id").cast("string"), F.col("col"), F.col("row_idx").cast("string"))], 4, "_p")
    # a column has three cells if one comes third; no join with the facts
    readings = first.withColumn("_n", F.max("_p").over(Window.partitionBy(*keys))).where("_n >= 3").select(
        "chart_id", "col", F.lit("value_of").alias("template"), F.lit("numeric").alias("answer_type"),
        F.col("value").alias("answer_num"), F.col("label").alias("answer_text"), *wording("value_of"),
    )
    rows = readings.unionByName(write_questions(facts, keys, BLOCK_B)).repartition("chart_id").withColumn("_o", question_order())
    limit = F.create_map(
        *[F.lit(x) for name, w in BLOCK_B_WEIGHTS.items() for x in (name, max(1, round(cap * w)))]
    )
    ranked = first_rows(rows, ["chart_id", "template"], ["_o", "answer_num"], cap, "_r")
    kept = ranked.where(F.col("_r") <= F.try_element_at(limit, F.col("template")))
    return first_rows(kept, ["chart_id"], ["_o", "answer_num"], cap, "slot").drop("_o", "_r")


def block_f(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge cases: hypothetical change, unanswerable entity, multiple choice, two turns.

    The question of a multiple choice names its four options, the answer is a letter. An unanswerable question asks for an invented ``entity``
    that the chart does not name; its answer is that it cannot be determined.
    """
    chart = F.col("chart_id").cast("string")
    pick = lambda salt, n: F.conv(F.substring(pick_key(chart, F.col("col"), salt), 1, 6), 16, 10).cast("bigint") % n
    first_column = facts.where("n >= 3").groupBy("chart_id").agg(F.min("col").alias("col"))
    base = facts.join(first_column, ["chart_id", "col"]).withColumn(
        "raised", F.try_element_at(F.array(*[F.lit(p) for p in (10, 15, 20, 25, 30, 50)]), (pick("pct", 6) + 1).cast("int"))
    )
    two = lambda c: F.round(F.round(c, 6), 2)
    place = pick("place", 4)
    options = []
    for j in range(4):
        offset = (0.1 + 0.2 * (pick(f"off{j}", 1000) / 1000.0)) * F.abs("v1")
        sign = F.when(pick(f"sign{j}", 2) == 0, -1).otherwise(1)
        options.append(F.when(place == j, F.col("v1")).otherwise(two(F.col("v1") + sign * offset)))
    base = base.withColumns({f"o{j}": option for j, option in enumerate(options)})
    options = [F.col(f"o{j}") for j in range(4)]
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    none = F.lit(None).cast("double")
    no_text, no_options = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    make = lambda name, kind, num, text, extra: F.struct(
        F.lit(name).alias("template"), F.lit(kind).alias("answer_type"), num.alias("answer_num"),
        text.alias("answer_text"), no_text.alias("entity"), extra.alias("options"), *wording(name),
    )
    made = F.array(
        F.when(F.col("v1") != 0, make("hypothetical", "numeric", two(F.col("v1") * (1 + F.col("raised") / 100.0)), no_text, no_options)),
        F.when(
            F.col("v1") != 0,
            make("multi_choice", "multichoice", F.col("v1"), F.try_element_at(letters, (place + 1).cast("int")), F.array(*options)),
        ),
        F.when(
            (F.col("n") >= 4) & (F.col("e2") != F.col("max_e")),
            make("conversational", "conversational", F.col("v2"), F.concat(F.col("max_e"), F.lit("; "), F.col("v2").cast("string")), no_options),
        ),
    )
    rows = base.select("chart_id", "col", F.explode(F.filter(made, lambda q: q.isNotNull())).alias("q")).select(
        "chart_id", "col", "q.*"
    )
    # an invented entity counts as unanswerable only where the chart does not name it
    fakes = base.select("chart_id", "col", F.explode(F.array(*[F.lit(f) for f in FICTIONAL])).alias("label"))
    absent = fakes.join(labels.select("chart_id", "label").distinct(), ["chart_id", "label"], "left_anti")
    chosen = absent.groupBy("chart_id", "col").agg(F.min_by("label", pick_key(chart, F.col("label"))).alias("entity"))
    unanswerable = chosen.select(
        "chart_id", "col", F.lit("unanswerable").alias("template"), F.lit("unanswerable").alias("answer_type"),
        none.alias("answer_num"), F.lit(UNANSWERABLE).alias("answer_text"), "entity", no_options.alias("options"), *wording("unanswerable"),
    )
    return rows.unionByName(unanswerable)


def line_fit(x: Column, y: Column) -> tuple[Column, Column]:
    """Least-squares slope and r squared as aggregates, null where undefined."""
    cov, vx, vy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    slope = F.try_divide(cov, F.when(vx > 0, vx))
    r2 = F.try_divide(cov * cov, F.when((vx > 0) & (vy > 0), vx * vy))
    return F.round(slope, 9), F.round(r2, 9)


def xy_facts(points: DataFrame) -> DataFrame:
    """Facts of a chart with columns x, y, y2 in row order: fit, ends, extremes, middle row, steps."""
    x, y = F.col("row_idx").cast("double"), F.col("y")
    slope, r2 = line_fit(x, y)
    row = F.col("row_idx")
    base = points.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("n"),
        slope.alias("slope"),
        r2.alias("r2"),
        F.min_by("y", row).alias("y_first"),
        F.max_by("y", row).alias("y_last"),
        F.max("y").alias("y_max"),
        F.min("y").alias("y_min"),
        F.max_by(row, F.struct(y, -row)).alias("peak_x"),
        F.avg("y").alias("y_mean"),
        F.avg("y2").alias("y2_mean"),
        F.max_by("label", F.struct(y, -row)).alias("best"),
        F.min_by("label", F.struct(y, row)).alias("worst"),
        F.min_by("label", F.struct(F.col("y2"), row)).alias("low_y2"),
        F.min_by("y", pick_key(F.col("chart_id").cast("string"), row.cast("string"))).alias("pick_y"),
    )
    middle = (
        points.join(base.select("chart_id", "n"), "chart_id")
        .where(row == F.floor(F.col("n") / 2))
        .select("chart_id", F.col("y").alias("mid_y"), F.col("y2").alias("mid_y2"), F.col("row_idx").alias("mid_x"))
    )
    # neighbours meet by an equi-join on (chart, row): no window over a whole chart
    after = points.select("chart_id", (row - 1).alias("row_idx"), F.col("y").alias("y_next"))
    steps = (
        points.join(after, ["chart_id", "row_idx"])
        .groupBy("chart_id")
        .agg(F.bool_and(F.col("y_next") >= y).alias("rising"), F.bool_and(F.col("y_next") <= y).alias("falling"))
    )
    return base.join(middle, "chart_id").join(steps, "chart_id", "left")


BAND = "CASE WHEN r2 >= 0.9 THEN 'excellent' WHEN r2 >= 0.7 THEN 'good' WHEN r2 >= 0.4 THEN 'moderate' ELSE 'poor' END"
GROWTH = (
    "CASE WHEN y_last / nullif(y_first, 0) > 100 THEN 'exponential growth' WHEN y_last / nullif(y_first, 0) > 10 THEN 'rapid growth'"
    " WHEN y_last / nullif(y_first, 0) > 2 THEN 'moderate growth' WHEN y_last / nullif(y_first, 0) > 0.5 THEN 'stable' ELSE 'rapid decay' END"
)
RISES = "CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END"
SCATTER: list[Template] = [
    ("sci_scatter_trend", "text", "n >= 3 AND slope IS NOT NULL", None, RISES),
    ("sci_scatter_fit_quality", "text", "n >= 3 AND r2 IS NOT NULL", None, BAND),
    ("sci_scatter_lookup", "numeric", "n >= 3", "mid_y", None),
    ("sci_residual", "numeric", "n >= 3", "mid_y - mid_y2", None),
    ("sci_r2", "numeric", "n >= 3 AND r2 IS NOT NULL", "r2", None),
]
ERRORBAR: list[Template] = [
    ("sci_eb_best", "text", "n >= 2", None, "best"),
    ("sci_eb_worst", "text", "n >= 2", None, "worst"),
    ("sci_eb_low_std", "text", "n >= 2", None, "low_y2"),
    ("sci_eb_diff", "numeric", "n >= 2", "y_max - y_min", None),
    ("sci_eb_lookup", "numeric", "n >= 2", "pick_y", None),
]
LOGSCALE: list[Template] = [
    ("sci_log_trend", "text", "n >= 3 AND slope IS NOT NULL", None, RISES),
    ("sci_log_pattern", "text", "n >= 3 AND y_first > 0 AND y_last > 0", None, GROWTH),
    ("sci_log_lookup", "numeric", "n >= 3", "mid_y", None),
    ("sci_log_oom", "numeric", "n >= 3 AND y_first > 0 AND y_last > 0", "CASE WHEN y_first > 0 AND y_last > 0 THEN log10(y_last / y_first) END", None),
]
DUAL: list[Template] = [
    ("sci_dual_ratio", "numeric", "n >= 3 AND mid_y2 <> 0", "mid_y / nullif(mid_y2, 0)", None),
    ("sci_dual_which", "text", "n >= 3", None, "CASE WHEN mid_y > mid_y2 THEN 'y' ELSE 'y2' END"),
    ("sci_dual_peak", "numeric", "n >= 3", "peak_x", None),
    ("sci_dual_dominant", "text", "n >= 3", None, "CASE WHEN y_mean > y2_mean THEN 'y' ELSE 'y2' END"),
]
SIMPLE: list[Template] = [
    ("v2_trend", "text", "n >= 3 AND slope IS NOT NULL", None, "CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'flat' END"),
    ("v2_monotonic", "text", "n >= 3", None, "CASE WHEN rising THEN 'monotonically increasing' WHEN falling THEN 'monotonically decreasing' ELSE 'non-monotonic' END"),
    ("v2_peak_x", "numeric", "n >= 3", "peak_x", None),
    ("v2_max_y", "numeric", "n >= 3", "y_max", None),
    ("v2_mean", "numeric", "n >= 3", "y_mean", None),
]


def panel_facts(points: DataFrame) -> DataFrame:
    """Charts of several panels (chart_id, panel, epoch, value): ranking, peaks, final values, stability."""
    v, e = F.col("value"), F.col("epoch")
    per = points.groupBy("chart_id", "panel").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("value").alias("top"),
        F.max_by("epoch", F.struct(v, -e)).alias("peak_epoch"),
        F.max_by("value", e).alias("final"),
    )
    late = (
        points.join(per.select("chart_id", "panel", "n"), ["chart_id", "panel"])
        .where((F.col("n") >= 4) & (e >= F.floor(F.col("n") / 2)))
        .groupBy("chart_id", "panel")
        .agg(F.round(F.stddev_samp("value"), 9).alias("late_std"))
    )
    rows = per.join(late, ["chart_id", "panel"], "left")
    panel = F.col("panel")
    picked = pick_key(F.col("chart_id").cast("string"), panel.cast("string"))
    solid = F.when(F.col("n") >= 2, picked)
    return rows.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("n_panels"),
        F.max_by("panel", F.struct(F.col("top"), -panel)).alias("best_panel"),
        F.min_by(F.struct("peak_epoch", "top", "final"), solid).alias("p"),
        F.min_by("panel", F.when(F.col("late_std").isNotNull(), F.struct(F.col("late_std"), panel))).alias("stable_panel"),
    ).select("chart_id", "n_panels", "best_panel", "p.*", "stable_panel")


PANEL: list[Template] = [
    ("sci_panel_ranking", "text", "n_panels >= 2", None, "best_panel"),
    ("sci_panel_peak_epoch", "numeric", "n_panels >= 2 AND peak_epoch IS NOT NULL", "peak_epoch", None),
    ("sci_panel_max", "numeric", "n_panels >= 2 AND top IS NOT NULL", "top", None),
    ("sci_panel_final", "numeric", "n_panels >= 2 AND final IS NOT NULL", "final", None),
    ("sci_panel_convergence", "text", "n_panels >= 2 AND stable_panel IS NOT NULL", None, "stable_panel"),
]


def matrix_facts(cells: DataFrame) -> DataFrame:
    """Correlation matrices in long form (chart_id, i, j with i < j, r)."""
    i, j, r = F.col("i"), F.col("j"), F.col("r")
    target = F.col("chart_id") % 7 + 1
    partner = F.when(i == target, j).when(j == target, i)
    pair = F.concat_ws(" and ", i.cast("string"), j.cast("string"))
    first = F.struct(r, -i, -j)
    return cells.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.max_by(pair, first).alias("strongest"),
        F.min("r").alias("weakest_r"),
        F.max_by(partner, F.when(partner.isNotNull(), F.struct(r, -partner))).alias("partner"),
        F.max(F.when((i == 1) & (j == 2), r)).alias("cell"),
    )


MATRIX: list[Template] = [
    ("sci_corr_strongest", "text", "n_pairs >= 3", None, "strongest"),
    ("sci_corr_target", "text", "n_pairs >= 3 AND partner IS NOT NULL", None, "partner"),
    ("sci_corr_cell", "numeric", "n_pairs >= 3 AND cell IS NOT NULL", "cell", None),
    ("sci_corr_sign", "text", "n_pairs >= 3 AND cell IS NOT NULL", None, "CASE WHEN cell > 0 THEN 'positively correlated' ELSE 'negatively correlated' END"),
    ("sci_corr_min", "numeric", "n_pairs >= 3", "weakest_r", None),
]


METHOD = ["chart_id", "method"]


def method_shape(bands: bool) -> dict[str, Column]:
    """Size, extremes and spread of a method; with ``bands`` its means too."""
    shape = {"n": F.count(F.lit(1)), "max_y": F.max("y"), "min_y": F.min("y"), "std_y": F.round(F.stddev_samp("y"), 9)}
    return shape | ({"mean_width": F.avg(F.col("y_upper") - F.col("y_lower")), "mean_y": F.avg("y")} if bands else {})


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def method_facts(points: DataFrame, bands: bool = True, tasks: int | None = None) -> DataFrame:
    """Charts with several methods (chart_id, method, row, y, y_lower, y_upper).

    Without ``bands`` only facts of the values y are made: then rows need no number and no bounds, and each method counts once.
    ``tasks`` is the number of partitions of points that lie by method already, so that they are not moved again.

    A method of few rows is read from one array of its rows, so that they move once at most and are not ranked; longer ones take
    ``long_methods``. A count, run at once, tells whether there are any, so that their route is not planned where there are none.
    """
    known = F.col("chart_id").isNotNull() & F.col("method").isNotNull()
    shape = method_shape(bands)
    long = points.where(known).groupBy("method").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).select(F.col("method").alias("_long"))
    any_long = long.count() > 0
    long = long if tasks is None else long.repartition(tasks, "_long")
    # a method without a key has no middle and no quantiles: none of its rows are gathered
    gathered = {"_v": F.array_sort(F.collect_list(F.when(known, F.col("y"))))}
    if bands:
        gathered["_rows"] = F.collect_list(F.when(known, F.struct("row", "y", (F.col("y_upper") - F.col("y_lower")).alias("w"))))
    short = points.join(long, (F.col("method") == F.col("_long")) & F.col("chart_id").isNotNull(), "left_anti") if any_long else points
    facts = short.groupBy(*METHOD).agg(*named(shape | gathered))

    def quantile(q: float) -> Column:
        at = F.lit(q) * (F.size("_v") - 1)
        low, high = F.get("_v", F.floor(at).cast("int")), F.get("_v", F.ceil(at).cast("int"))
        return (low + (high - low) * (at - F.floor(at))).cast("double")

    few = facts.withColumns({name: quantile(q) for name, q in QUARTERS.items()})
    middle = ["mid_width", "mid_y"] if bands else []
    if bands:
        # rows that repeat their number count each by itself
        few = few.withColumn("_m", F.explode_outer(F.filter("_rows", lambda x: x["row"] == F.floor(F.col("n") / 2))))
        few = few.withColumns({"mid_width": F.col("_m.w"), "mid_y": F.col("_m.y")})
    rows = few.select(*METHOD, *shape, *middle, *QUARTERS)
    if any_long:
        rows = rows.unionByName(long_methods(points.where(known).join(long, F.col("method") == F.col("_long"), "left_semi"), bands))
    rows = rows.withColumns({"med": F.col("q50"), "iqr": F.col("q75") - F.col("q25")})
    m = F.col("method")
    key = F.when(F.col("n") >= 2, pick_key(F.col("chart_id").cast("string"), m.cast("string")))
    top = lambda c: F.max_by("method", F.when(F.col(c).isNotNull(), F.struct(F.round(c, 9).alias("v"), -m)))
    picked = [*middle, *(["mean_width"] if bands else []), "max_y", "min_y", "med", "iqr"]
    first = {"widest": top("mean_width"), "best": top("mean_y")} if bands else {}
    first |= {"top_median": top("med"), "top_spread": top("std_y")}
    return rows.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("n_methods"), F.sum("n").alias("n_rows"), F.min_by(F.struct(*picked), key).alias("p"), *named(first)
    ).select("chart_id", "n_methods", "n_rows", "p.*", *first)


def long_methods(points: DataFrame, bands: bool = True) -> DataFrame:
    """Facts of methods of any size: no method is gathered."""
    shape = method_shape(bands)
    per = points.groupBy(*METHOD).agg(*named(shape))
    quarters = exact_quantiles(points.where(F.col("y").isNotNull()), METHOD, "y", QUARTERS)
    if not bands:
        return per.join(quarters, METHOD, "left").select(*METHOD, *shape, *QUARTERS)
    middle = (
        points.join(per.select(*METHOD, "n"), METHOD)
        .where(F.col("row") == F.floor(F.col("n") / 2))
        .select(*METHOD, (F.col("y_upper") - F.col("y_lower")).alias("mid_width"), F.col("y").alias("mid_y"))
    )
    return per.join(middle, METHOD, "left").join(quarters, METHOD, "left").select(*METHOD, *shape, "mid_width", "mid_y", *QUARTERS)


BAND_Q: list[Template] = [
    ("sci_cb_width", "numeric", "mid_width IS NOT NULL", "mid_width", None),
    ("sci_cb_lookup", "numeric", "mid_y IS NOT NULL", "mid_y", None),
    ("sci_cb_mean_width", "numeric", "mid_y IS NOT NULL", "mean_width", None),
    ("sci_cb_max_y", "numeric", "mid_y IS NOT NULL", "max_y", None),
    ("sci_cb_widest", "text", "mid_y IS NOT NULL AND n_methods >= 2", None, "widest"),
    ("sci_cb_best", "text", "mid_y IS NOT NULL AND n_methods >= 2", None, "best"),
]
VIOLIN: list[Template] = [
    ("sci_violin_median", "numeric", "n_rows >= 5 AND n_methods >= 2 AND med IS NOT NULL", "med", None),
    ("sci_violin_range", "numeric", "n_rows >= 5 AND n_methods >= 2 AND med IS NOT NULL", "max_y - min_y", None),
    ("sci_violin_highest_median", "text", "n_rows >= 5 AND n_methods >= 2 AND med IS NOT NULL", None, "top_median"),
    ("sci_violin_widest", "text", "n_rows >= 5 AND n_methods >= 2 AND med IS NOT NULL AND top_spread IS NOT NULL", None, "top_spread"),
    ("sci_violin_iqr", "numeric", "n_rows >= 5 AND n_methods >= 2 AND med IS NOT NULL", "iqr", None),
]


def rule_cot(steps: Column, answer: Column) -> Column:
    """Steps as numbered lines that end in the answer."""
    numbered = F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s))
    close = F.concat(F.lit("The answer is "), answer, F.lit("."))
    empty = F.concat(F.lit("Let me analyze the chart.\n"), close)
    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, empty).otherwise(
        F.concat(F.array_join(numbered, "\n"), F.lit("\n"), close)
    )


def trim_tables(rows: DataFrame, years: int = 20, entities: int = 10, cap: int = 200) -> DataFrame:
    """Recent years, the entities with most rows, the first rows of each table."""
    last = rows.groupBy("chart_id").agg(F.max("year").alias("_last"))
    recent = rows.join(last, "chart_id").where(F.col("year") >= F.col("_last") - years).drop("_last")
    sizes = recent.groupBy("chart_id", "entity").agg(F.count(F.lit(1)).alias("_n"))
    top = first_rows(sizes, ["chart_id"], [F.desc("_n"), "entity"], entities, "_r").select("chart_id", "entity")
    kept = recent.join(top, ["chart_id", "entity"], "left_semi")
    return first_rows(kept, ["chart_id"], ["row_idx"], cap)


def prepare_tables(rows: DataFrame, value: str) -> DataFrame:
    """Entity and year limits, the last twenty rows, values scaled to thousands or millions."""
    pick = lambda salt, n: F.conv(F.substring(pick_key(F.col("chart_id").cast("string"), salt), 1, 6), 16, 10).cast("bigint") % n
    sizes = rows.groupBy("chart_id", "entity").agg(F.count(F.lit(1)).alias("_n"))
    count = sizes.groupBy("chart_id").agg(F.count(F.lit(1)).alias("_entities"))
    top = first_rows(sizes, ["chart_id"], [F.desc("_n"), "entity"], 8, "_r").join(count, "chart_id")
    top = top.where((F.col("_entities") <= 8) | (F.col("_r") <= 5 + pick("entities", 4))).select("chart_id", "entity")
    kept = rows.join(top, ["chart_id", "entity"], "left_semi")
    span = kept.groupBy("chart_id").agg(F.max("year").alias("_hi"), F.min("year").alias("_lo"))
    kept = kept.join(span, "chart_id").where(
        (F.col("_hi") - F.col("_lo") <= 15) | (F.col("year") >= F.col("_hi") - (10 + pick("years", 6)))
    )
    tail = first_rows(kept, ["chart_id"], [F.desc("row_idx")], 20, "_t")
    top_value = tail.groupBy("chart_id").agg(F.max(F.abs(value)).alias("_max"))
    scale = F.when(F.col("_max") > 1_000_000, 1_000_000.0).when(F.col("_max") > 10_000, 1_000.0).otherwise(1.0)
    suffix = F.when(F.col("_max") > 1_000_000, "(millions)").when(F.col("_max") > 10_000, "(thousands)").otherwise("")
    out = tail.join(top_value, "chart_id").where(F.col(value).isNotNull())
    return out.select(
        "chart_id", "row_idx", "entity", "year",
        F.round(F.round(F.col(value) / scale, 6), 2).alias(value), suffix.alias("scale"),
    )
