"""Queries on rule-based question generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import qagen as Q
from tracelab.operators.wording import record
from tracelab.operators.scale import over_all, tasks_for
from tracelab.plans.registry import query, r6
from tracelab.sources.fixtures import table, view


def r2(x: str) -> str:
    return f"(CAST(round(CAST(round(CAST({x} AS DOUBLE), 6) AS DECIMAL(24, 6)), 2) AS DOUBLE) + 0.0)"


def number_text(x: str) -> str:
    return f"CAST(CAST(round(CAST(round(CAST({x} AS DOUBLE), 6) AS DECIMAL(24, 6)), 2) AS DECIMAL(24, 2)) AS VARCHAR)"


def wording_sql(name: str) -> str:
    difficulty, question, steps = record(name, number_text)
    return f"{question} AS question, {' || chr(10) || '.join(steps)} AS reasoning, {difficulty} AS difficulty"


def records(rows):
    """Question records with their steps as lines of one text."""
    whole = F.when(~F.exists("reasoning_steps", lambda s: s.isNull()), F.array_join("reasoning_steps", "\n"))
    return rows.withColumn("reasoning", whole).drop("reasoning_steps")


def questions_sql(facts: str, keys: str, templates) -> str:
    parts = []
    for name, kind, cond, number, text in templates:
        num = r2(number) if number else "CAST(NULL AS DOUBLE)"
        txt = f"CAST({text} AS VARCHAR)" if text else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT {keys}, '{name}' AS template, '{kind}' AS answer_type, {num} AS answer_num, {txt} AS answer_text, {wording_sql(name)} FROM {facts} WHERE {cond}"
        )
    return " UNION ALL ".join(parts)


PICK = "md5(concat_ws('|', CAST(chart_id AS VARCHAR), col, CAST(row_idx AS VARCHAR)))"
FACTS_SQL = f""", f1 AS (SELECT chart_id, col, count(*) AS n, max(value) AS max_v, min(value) AS min_v, avg(value) AS mean_v, sum(value) AS sum_v,
 arg_max(label, value * 1000 - row_idx) AS max_e, arg_min(label, value * 1000 + row_idx) AS min_e, arg_min(label, {PICK}) AS e1, arg_min(value, {PICK}) AS v1,
 arg_max(label, {PICK}) AS e2, arg_max(value, {PICK}) AS v2, quantile_cont(value, 0.5) AS median_v,
 CASE chart_id % 3 WHEN 0 THEN quantile_cont(value, 0.25) WHEN 1 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.75) END AS cut_v
 FROM chart_cells WHERE value IS NOT NULL GROUP BY chart_id, col),
f2 AS (SELECT c.chart_id, c.col, avg(CASE WHEN row_idx < n // 2 THEN value END) AS head_mean, avg(CASE WHEN row_idx >= n // 2 THEN value END) AS tail_mean,
 count(*) FILTER (WHERE value > median_v) AS n_above_median, count(*) FILTER (WHERE value > cut_v) AS n_above, count(*) FILTER (WHERE value < cut_v) AS n_below
 FROM chart_cells c JOIN f1 USING (chart_id, col) GROUP BY c.chart_id, c.col),
facts AS (SELECT f1.*, head_mean, tail_mean, n_above_median, n_above, n_below FROM f1 JOIN f2 USING (chart_id, col))"""


def facts(spark, sf):
    return Q.column_facts(view(spark, sf, "chart_cells"))


def with_years(spark, sf):
    """Chart cells with a year column in front of the value columns of every chart."""
    cells = view(spark, sf, "chart_cells")
    lines = view(spark, sf, "lines")
    years = lines.selectExpr(
        "group_id AS chart_id", "k AS row_idx", "'' AS label", "'year' AS col", "CAST(1990 + k AS DOUBLE) AS value", "0 AS col_idx"
    )
    order = F.when(F.col("col") == "quantity", 1).otherwise(2)
    return cells.withColumn("col_idx", order).unionByName(years)


ELIGIBLE_SQL = """, y AS (SELECT chart_id, row_idx, label, col, value, CASE col WHEN 'quantity' THEN 1 ELSE 2 END AS col_idx FROM chart_cells
 UNION ALL SELECT group_id, k, '', 'year', 1990 + k, 0 FROM lines),
c AS (SELECT chart_id, col, col_idx, count(value) AS n FROM y GROUP BY ALL HAVING count(value) >= 2),
p AS (SELECT *, regexp_matches(col, '(?i)year|date|time|index') AS yearish, count(*) FILTER (WHERE NOT regexp_matches(col, '(?i)year|date|time|index')) OVER (PARTITION BY chart_id) AS n_plain FROM c),
r AS (SELECT chart_id, col, n, CAST(row_number() OVER (PARTITION BY chart_id ORDER BY col_idx) AS INT) AS "rank" FROM p WHERE NOT yearish OR n_plain = 0)"""


@query("qa_eligible_columns", ("lines", "chart_cells"), ELIGIBLE_SQL + " SELECT * FROM r")
def qa_eligible_columns(spark, sf):
    return Q.numeric_columns(with_years(spark, sf))


VALUE_COLUMNS = 2


@query(
    "qa_core_eligible",
    ("lines", "chart_cells"),
    ELIGIBLE_SQL
    + f""", ec AS (SELECT y.* FROM y SEMI JOIN (SELECT chart_id, col FROM r WHERE "rank" <= {VALUE_COLUMNS}) e ON e.chart_id = y.chart_id AND e.col = y.col)"""
    + FACTS_SQL.replace("chart_cells", "ec")
    + " "
    + questions_sql("facts", "chart_id, col", Q.CORE),
)
def qa_core_eligible(spark, sf):
    """Core questions over the first value columns of charts that also have a year column."""
    cells = with_years(spark, sf)
    chosen = Q.numeric_columns(cells, VALUE_COLUMNS).select("chart_id", "col")
    cells = cells.join(chosen, ["chart_id", "col"], "left_semi")
    return records(Q.write_questions(Q.column_facts(cells), ["chart_id", "col"], Q.CORE))


KEYS = ["chart_id", "col"]


@query("qa_core", "chart_cells", FACTS_SQL + " " + questions_sql("facts", "chart_id, col", Q.CORE))
def qa_core(spark, sf):
    return records(Q.write_questions(facts(spark, sf), KEYS, Q.CORE))


@query("qa_block_a", "chart_cells", FACTS_SQL + " " + questions_sql("facts", "chart_id, col", Q.BLOCK_A))
def qa_block_a(spark, sf):
    return records(Q.write_questions(facts(spark, sf), KEYS, Q.BLOCK_A))


ORDER = "md5(concat_ws('|', CAST(chart_id AS VARCHAR), col, template, coalesce(answer_text, '')))"
SLOT = 'SELECT chart_id, col, template, answer_type, answer_num, answer_text, question, reasoning, difficulty, CAST(slot AS INT) AS slot'


@query(
    "qa_type_quota",
    "chart_cells",
    FACTS_SQL
    + f""", qs AS ({questions_sql('facts', 'chart_id, col', Q.BLOCK_A)}),
t AS (SELECT *, {ORDER} AS o, row_number() OVER (PARTITION BY chart_id, answer_type ORDER BY {ORDER}) AS r FROM qs),
l AS (SELECT *, CASE WHEN r > CASE answer_type WHEN 'numeric' THEN 4 WHEN 'text' THEN 2 ELSE 2 END THEN 1 ELSE 0 END AS late FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY late, o) AS slot FROM l)
{SLOT} FROM s WHERE slot <= 8""",
)
def qa_type_quota(spark, sf):
    return Q.type_quota(qa_block_a(spark, sf))


@query(
    "qa_block_b",
    "chart_cells",
    FACTS_SQL
    + f""", rd AS (SELECT c.chart_id, c.col, label, value, row_number() OVER (PARTITION BY c.chart_id, c.col ORDER BY {PICK.replace('chart_id', 'c.chart_id').replace(' col', ' c.col')}) AS p
 FROM chart_cells c JOIN facts f ON c.chart_id = f.chart_id AND c.col = f.col WHERE f.n >= 3),
qs AS (SELECT chart_id, col, 'value_of' AS template, 'numeric' AS answer_type, value AS answer_num, label AS answer_text, {wording_sql('value_of')} FROM rd WHERE p <= 4
 UNION ALL {questions_sql('facts', 'chart_id, col', Q.BLOCK_B)}),
t AS (SELECT *, {ORDER} AS o, row_number() OVER (PARTITION BY chart_id, template ORDER BY {ORDER}, answer_num) AS r FROM qs),
s AS (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY o, answer_num) AS slot FROM t WHERE r <= CASE template WHEN 'value_of' THEN 2 ELSE 1 END)
{SLOT} FROM s WHERE slot <= 4""",
)
def qa_block_b(spark, sf):
    cells = view(spark, sf, "chart_cells")
    return records(Q.block_b(cells, Q.column_facts(cells), cap=4))


def pick_sql(salt: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', CAST(chart_id AS VARCHAR), col, '{salt}')), 1, 6) AS BIGINT) % {n})"


def option_sql(j: int) -> str:
    other = f"v1 + (CASE WHEN {pick_sql(f'sign{j}', 2)} = 0 THEN -1 ELSE 1 END) * ((0.1 + 0.2 * ({pick_sql(f'off{j}', 1000)} / 1000.0)) * abs(v1))"
    return f"CASE WHEN place = {j} THEN v1 ELSE {r2(other)} END"


def block_f_sql() -> str:
    def part(name, kind, num, text, options, source, cond, entity="CAST(NULL AS VARCHAR)"):
        return f"SELECT chart_id, col, '{name}' AS template, '{kind}' AS answer_type, {num} AS answer_num, {text} AS answer_text, {entity} AS entity, {options} AS options, {wording_sql(name)} FROM {source} WHERE {cond}"

    none = "CAST(NULL AS VARCHAR)"
    options = "CAST(to_json([o0, o1, o2, o3]) AS VARCHAR)"
    fakes = ", ".join(f"'{x}'" for x in Q.FICTIONAL)
    return f""", bp AS (SELECT f.*, list_extract([10, 15, 20, 25, 30, 50], CAST({pick_sql('pct', 6)} + 1 AS INT)) AS raised, {pick_sql('place', 4)} AS place FROM facts f SEMI JOIN
 (SELECT chart_id, min(col) AS col FROM facts WHERE n >= 3 GROUP BY chart_id) USING (chart_id, col)),
bf AS (SELECT *, {', '.join(f'{option_sql(j)} AS o{j}' for j in range(4))} FROM bp),
fa AS (SELECT chart_id, col, unnest([{fakes}]) AS label FROM bf), fk AS (SELECT fa.* FROM fa ANTI JOIN (SELECT DISTINCT chart_id, label FROM chart_cells) USING (chart_id, label)),
fu AS (SELECT chart_id, col, arg_min(label, md5(concat_ws('|', CAST(chart_id AS VARCHAR), label))) AS entity FROM fk GROUP BY chart_id, col)
{part('hypothetical', 'numeric', r2('v1 * (1 + raised / 100.0)'), none, none, 'bf', 'v1 <> 0')}
UNION ALL {part('multi_choice', 'multichoice', 'v1', "substr('ABCD', CAST(place + 1 AS INT), 1)", options, 'bf', 'v1 <> 0')}
UNION ALL {part('conversational', 'conversational', 'v2', "max_e || '; ' || CAST(v2 AS VARCHAR)", none, 'bf', 'n >= 4 AND e2 <> max_e')}
UNION ALL {part('unanswerable', 'unanswerable', 'CAST(NULL AS DOUBLE)', "'Cannot be determined'", none, 'fu', 'TRUE', 'entity')}"""


@query("qa_block_f", "chart_cells", FACTS_SQL + block_f_sql())
def qa_block_f(spark, sf):
    cells = view(spark, sf, "chart_cells")
    return records(Q.block_f(Q.column_facts(cells), cells)).withColumn("options", F.to_json("options"))


POINTS = ["group_id AS chart_id", "k AS row_idx", "concat('item ', CAST(l_partkey AS STRING)) AS label", "CAST(qty AS DOUBLE) AS y", "CAST(disc * 5 AS DOUBLE) AS y2"]
XY_SQL = f""", pt AS (SELECT {', '.join(POINTS)} FROM lines),
b AS (SELECT chart_id, count(*) AS n, round(covar_pop(row_idx, y) / nullif(var_pop(row_idx), 0), 9) AS slope,
 round(covar_pop(row_idx, y) * covar_pop(row_idx, y) / nullif(var_pop(row_idx) * var_pop(y), 0), 9) AS r2, arg_min(y, row_idx) AS y_first, arg_max(y, row_idx) AS y_last,
 max(y) AS y_max, min(y) AS y_min, arg_max(row_idx, y * 1000 - row_idx) AS peak_x, avg(y) AS y_mean, avg(y2) AS y2_mean, arg_max(label, y * 1000 - row_idx) AS best,
 arg_min(label, y * 1000 + row_idx) AS worst, arg_min(label, y2 * 1000 + row_idx) AS low_y2, arg_min(y, md5(concat_ws('|', CAST(chart_id AS VARCHAR), CAST(row_idx AS VARCHAR)))) AS pick_y FROM pt GROUP BY chart_id),
m AS (SELECT pt.chart_id, y AS mid_y, y2 AS mid_y2, row_idx AS mid_x FROM pt JOIN b ON pt.chart_id = b.chart_id WHERE row_idx = n // 2),
d AS (SELECT chart_id, lead(y) OVER (PARTITION BY chart_id ORDER BY row_idx) - y AS step FROM pt),
s AS (SELECT chart_id, bool_and(step >= 0) AS rising, bool_and(step <= 0) AS falling FROM d WHERE step IS NOT NULL GROUP BY chart_id),
xy AS (SELECT b.*, mid_y, mid_y2, mid_x, rising, falling FROM b JOIN m USING (chart_id) LEFT JOIN s USING (chart_id))"""

XY_SETS = {
    "qa_sci_scatter": Q.SCATTER,
    "qa_sci_errorbar": Q.ERRORBAR,
    "qa_sci_logscale": Q.LOGSCALE,
    "qa_sci_dual": Q.DUAL,
    "qa_simple_xy": Q.SIMPLE,
}


def xy(spark, sf):
    return Q.xy_facts(view(spark, sf, "lines").selectExpr(*POINTS))


def _register_xy(name: str) -> None:
    @query(name, "lines", XY_SQL + " " + questions_sql("xy", "chart_id", XY_SETS[name]))
    def run(spark, sf):
        return records(Q.write_questions(xy(spark, sf), ["chart_id"], XY_SETS[name]))


for _name in XY_SETS:
    _register_xy(_name)


PANEL_SQL = """, pt AS (SELECT o_custkey AS chart_id, group_id AS panel, k AS epoch, CAST(qty AS DOUBLE) AS value FROM lines JOIN orders ON o_orderkey = group_id),
p AS (SELECT chart_id, panel, count(*) AS n, max(value) AS top, arg_max(epoch, value * 1000 - epoch) AS peak_epoch, arg_max(value, epoch) AS final FROM pt GROUP BY chart_id, panel),
l AS (SELECT pt.chart_id, pt.panel, round(stddev_samp(value), 9) AS late_std FROM pt JOIN p USING (chart_id, panel) WHERE n >= 4 AND epoch >= n // 2 GROUP BY pt.chart_id, pt.panel),
j AS (SELECT p.*, late_std, CASE WHEN n >= 2 THEN md5(concat_ws('|', CAST(chart_id AS VARCHAR), CAST(panel AS VARCHAR))) END AS o FROM p LEFT JOIN l USING (chart_id, panel)),
c AS (SELECT chart_id, count(*) AS n_panels FROM j GROUP BY chart_id),
bp AS (SELECT chart_id, panel AS best_panel FROM j QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY top DESC, panel) = 1),
pk AS (SELECT chart_id, peak_epoch, top, final FROM j WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY o) = 1),
sp AS (SELECT chart_id, panel AS stable_panel FROM j WHERE late_std IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY late_std, panel) = 1),
pf AS (SELECT c.*, best_panel, peak_epoch, top, final, stable_panel FROM c LEFT JOIN bp USING (chart_id) LEFT JOIN pk USING (chart_id) LEFT JOIN sp USING (chart_id))"""


def panels(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("chart_id"))
    points = view(spark, sf, "lines").join(orders, "group_id")
    points = points.selectExpr("chart_id", "group_id AS panel", "k AS epoch", "CAST(qty AS DOUBLE) AS value")
    return Q.panel_facts(points)


@query("qa_sci_panel", "lines", PANEL_SQL + " " + questions_sql("pf", "chart_id", Q.PANEL))
def qa_sci_panel(spark, sf):
    return records(Q.write_questions(panels(spark, sf), ["chart_id"], Q.PANEL))


MATRIX_CELLS = "l_suppkey AS chart_id, least(l_linenumber, CAST(l_partkey % 7 + 1 AS INT)) AS i, greatest(l_linenumber, CAST(l_partkey % 7 + 1 AS INT)) AS j, CAST(disc AS DOUBLE) / 5 - 1 AS one"


MATRIX_SQL = f""", mc AS (SELECT chart_id, i, j, round(avg(one), 9) AS r FROM (SELECT {MATRIX_CELLS} FROM lines) WHERE i < j GROUP BY chart_id, i, j),
t AS (SELECT *, CASE WHEN i = chart_id % 7 + 1 THEN j WHEN j = chart_id % 7 + 1 THEN i END AS pt FROM mc),
c AS (SELECT chart_id, count(*) AS n_pairs, min(r) AS weakest_r, max(CASE WHEN i = 1 AND j = 2 THEN r END) AS cell FROM mc GROUP BY chart_id),
sg AS (SELECT chart_id, concat(i, ' and ', j) AS strongest FROM mc QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY r DESC, i, j) = 1),
pa AS (SELECT chart_id, pt AS partner FROM t WHERE pt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY r DESC, pt) = 1),
mf AS (SELECT c.*, strongest, partner FROM c LEFT JOIN sg USING (chart_id) LEFT JOIN pa USING (chart_id))"""


def matrices(spark, sf):
    cells = view(spark, sf, "lines").selectExpr(
        "l_suppkey AS chart_id",
        "least(l_linenumber, CAST(l_partkey % 7 + 1 AS INT)) AS i",
        "greatest(l_linenumber, CAST(l_partkey % 7 + 1 AS INT)) AS j",
        "CAST(disc AS DOUBLE) / 5 - 1 AS one",
    )
    matrix = cells.where("i < j").groupBy("chart_id", "i", "j").agg(F.round(F.avg("one"), 9).alias("r"))
    return Q.matrix_facts(matrix)


@query("qa_sci_corr", "lines", MATRIX_SQL + " " + questions_sql("mf", "chart_id", Q.MATRIX))
def qa_sci_corr(spark, sf):
    return records(Q.write_questions(matrices(spark, sf), ["chart_id"], Q.MATRIX))


METHOD_SQL = """, mp AS (SELECT o_custkey AS chart_id, group_id AS method, k AS row, CAST(qty AS DOUBLE) AS y, CAST(qty - disc AS DOUBLE) AS y_lower, CAST(qty + disc AS DOUBLE) + l_linenumber AS y_upper
 FROM lines JOIN orders ON o_orderkey = group_id),
pm AS (SELECT chart_id, method, count(*) AS n, avg(y_upper - y_lower) AS mean_width, max(y) AS max_y, min(y) AS min_y, avg(y) AS mean_y, round(stddev_samp(y), 9) AS std_y,
 quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM mp GROUP BY chart_id, method),
mm AS (SELECT mp.chart_id, mp.method, y_upper - y_lower AS mid_width, y AS mid_y FROM mp JOIN pm USING (chart_id, method) WHERE row = n // 2),
mj AS (SELECT pm.*, mid_width, mid_y, CASE WHEN n >= 2 THEN md5(concat_ws('|', CAST(chart_id AS VARCHAR), CAST(method AS VARCHAR))) END AS o FROM pm LEFT JOIN mm USING (chart_id, method)),
c AS (SELECT chart_id, count(*) AS n_methods, sum(n) AS n_rows FROM mj GROUP BY chart_id),
pk AS (SELECT chart_id, mid_width, mid_y, mean_width, max_y, min_y, med, iqr FROM mj WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY o) = 1),
tw AS (SELECT chart_id, method AS widest FROM mj QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY round(mean_width, 9) DESC, method) = 1),
tb AS (SELECT chart_id, method AS best FROM mj QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY round(mean_y, 9) DESC, method) = 1),
tm AS (SELECT chart_id, method AS top_median FROM mj QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY round(med, 9) DESC, method) = 1),
ts AS (SELECT chart_id, method AS top_spread FROM mj WHERE std_y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY std_y DESC, method) = 1),
mt AS (SELECT c.*, mid_width, mid_y, mean_width, max_y, min_y, med, iqr, widest, best, top_median, top_spread FROM c LEFT JOIN pk USING (chart_id) LEFT JOIN tw USING (chart_id) LEFT JOIN tb USING (chart_id)
 LEFT JOIN tm USING (chart_id) LEFT JOIN ts USING (chart_id))"""


def methods(spark, sf, bands=True):
    # lines and orders lie by order once, in tasks of as many rows at every size; the numbers of the rows are made for the bands only
    tasks = tasks_for(table(spark, sf, "lineitem"))
    orders = table(spark, sf, "orders").where("o_orderkey IS NOT NULL").repartition(tasks, "o_orderkey")
    rows = view(spark, sf, "lines", tasks).join(orders, F.col("group_id") == F.col("o_orderkey"))
    points = ["o_custkey AS chart_id", "group_id AS method", "CAST(qty AS DOUBLE) AS y"]
    edges = ["k AS row", "CAST(qty - disc AS DOUBLE) AS y_lower", "CAST(qty + disc AS DOUBLE) + l_linenumber AS y_upper"]
    return Q.method_facts(rows.selectExpr(*points, *(edges if bands else [])), bands, tasks)


@query("qa_sci_band", "lines", METHOD_SQL + " " + questions_sql("mt", "chart_id", Q.BAND_Q))
def qa_sci_band(spark, sf):
    return records(Q.write_questions(methods(spark, sf), ["chart_id"], Q.BAND_Q))


@query("qa_sci_violin", "lines", METHOD_SQL + " " + questions_sql("mt", "chart_id", Q.VIOLIN))
def qa_sci_violin(spark, sf):
    return records(Q.write_questions(methods(spark, sf, bands=False), ["chart_id"], Q.VIOLIN))


# Chart type of a chart and the template set each type asks for; the last four come in tables of their own.
OWN_TABLES = {
    "panels": (PANEL_SQL, "pf", Q.PANEL), "heatmap": (MATRIX_SQL, "mf", Q.MATRIX), "band": (METHOD_SQL, "mt", Q.BAND_Q), "violin": (METHOD_SQL, "mt", Q.VIOLIN),
}
CHART_TYPES = ["scatter_regression", "errorbar_comparison", "logscale_plot", "dual_axis", "simple_xy"]
TYPE_OF = "CASE chart_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(CHART_TYPES)) + " ELSE 'other' END"


@query(
    "qa_dispatch",
    ("lines", "chart_cells"),
    XY_SQL
    + FACTS_SQL
    + f""", tx AS (SELECT *, {TYPE_OF} AS chart_type FROM xy), tf AS (SELECT *, {TYPE_OF} AS chart_type FROM facts),
u AS ({" UNION ALL ".join(questions_sql(f"(SELECT * FROM tx WHERE chart_type = '{t}')", "chart_type", ts) for t, ts in zip(CHART_TYPES, XY_SETS.values()))}
 UNION ALL {questions_sql("(SELECT * FROM tf WHERE chart_type = 'other')", "chart_type", Q.CORE + Q.BLOCK_A)}
 {" ".join(f"UNION ALL SELECT * FROM (WITH {sql.strip()[1:]} {questions_sql(f, f"'{t}' AS chart_type", ts)})" for t, (sql, f, ts) in OWN_TABLES.items())})
SELECT chart_type, template, answer_type, count(*) AS n, {r6('avg(answer_num)')} AS mean_answer FROM u GROUP BY ALL""",
)
def qa_dispatch(spark, sf):
    # one pass for the charts that share their facts; a template counts for the charts of its type
    of_type = lambda sets: [(n, kind, f"chart_type = '{t}' AND ({when})", num, text) for t, ts in sets for n, kind, when, num, text in ts]
    write = lambda rows, templates: Q.write_questions(rows, ["chart_type"], templates, worded=False)
    typed_xy = xy(spark, sf).withColumn("chart_type", F.expr(TYPE_OF)).where("chart_type <> 'other'")
    typed_facts = facts(spark, sf).withColumn("chart_type", F.expr(TYPE_OF)).where("chart_type = 'other'")
    parts = [write(typed_xy, of_type(zip(CHART_TYPES, XY_SETS.values()))), write(typed_facts, Q.CORE + Q.BLOCK_A)]
    both = methods(spark, sf).withColumn("chart_type", F.explode(F.array(F.lit("band"), F.lit("violin"))))
    parts.append(write(both, of_type([("band", Q.BAND_Q), ("violin", Q.VIOLIN)])))
    own = {"panels": (panels(spark, sf), Q.PANEL), "heatmap": (matrices(spark, sf), Q.MATRIX)}
    parts += [write(rows.withColumn("chart_type", F.lit(t)), ts) for t, (rows, ts) in own.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("chart_type", "template", "answer_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("answer_num"), 6).alias("mean_answer")
    )


@query(
    "qa_stats",
    "chart_cells",
    FACTS_SQL
    + f""", qs AS ({questions_sql('facts', 'chart_id', Q.CORE)} UNION ALL {questions_sql('facts', 'chart_id', Q.BLOCK_A)}),
t AS (SELECT count(*) AS total, {r6("avg(CASE WHEN answer_num IS NULL THEN 100.0 ELSE 0.0 END)")} AS text_share FROM qs)
SELECT template, count(*) AS n, {r6('100.0 * count(*) / any_value(total)')} AS share, any_value(text_share) AS text_share FROM qs, t GROUP BY template""",
)
def qa_stats(spark, sf):
    base = facts(spark, sf)
    rows = Q.write_questions(base, KEYS, Q.CORE + Q.BLOCK_A, worded=False)
    counts = rows.groupBy("template").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer_num").isNull()).alias("_text")
    )
    return counts.select(
        "template",
        "n",
        F.round(100.0 * F.col("n") / over_all("n"), 6).alias("share"),
        F.round(100.0 * over_all("_text") / over_all("n"), 6).alias("text_share"),
    )


def cot_sql() -> str:
    parts = []
    for name, _, cond, number, text in Q.CORE:
        _, _, steps = record(name, number_text)
        answer = number_text(number) if number else f"CAST({text} AS VARCHAR)"
        lines = [f"'Step {i}: ' || {s}" for i, s in enumerate(steps, 1)] + [f"'The answer is ' || {answer} || '.'"]
        parts.append(f"SELECT chart_id, col, '{name}' AS template, {' || chr(10) || '.join(lines)} AS cot FROM facts WHERE {cond}")
    return " UNION ALL ".join(parts)


@query("qa_rule_cot", "chart_cells", FACTS_SQL + " " + cot_sql())
def qa_rule_cot(spark, sf):
    rows = Q.write_questions(facts(spark, sf), KEYS, Q.CORE)
    answer = F.coalesce("answer_text", F.col("answer_num").cast("decimal(24,2)").cast("string"))
    return rows.select(*KEYS, "template", Q.rule_cot(F.col("reasoning_steps"), answer).alias("cot"))


# Tables of a supplier: entity, year and value per row, in the order of their order lines.
TABLE_ROWS = [
    "l_suppkey AS chart_id", "group_id * 16 + k AS row_idx", "concat('entity ', CAST(l_partkey % 25 AS STRING)) AS entity",
    "CAST(1980 + l_partkey % 41 AS INT) AS year", "CAST(qty AS DOUBLE) * CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100000 END AS value",
]


def table_rows(spark, sf):
    return view(spark, sf, "lines").selectExpr(*TABLE_ROWS)


@query(
    "tab_trim",
    "lines",
    f""", t AS (SELECT {', '.join(TABLE_ROWS)} FROM lines),
y AS (SELECT * FROM (SELECT *, max(year) OVER (PARTITION BY chart_id) AS hi FROM t) WHERE year >= hi - 20),
e AS (SELECT chart_id, entity, row_number() OVER (PARTITION BY chart_id ORDER BY count(*) DESC, entity) AS r FROM y GROUP BY chart_id, entity),
k AS (SELECT y.chart_id, row_idx, y.entity, year, value, CAST(row_number() OVER (PARTITION BY y.chart_id ORDER BY row_idx) AS INT) AS rn FROM y JOIN e ON y.chart_id = e.chart_id AND y.entity = e.entity AND e.r <= 10)
SELECT * FROM k WHERE rn <= 200""",
)
def tab_trim(spark, sf):
    return Q.trim_tables(table_rows(spark, sf)).select("chart_id", "row_idx", "entity", "year", "value", "rn")


def draw(salt: str, n: int) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws('|', CAST(chart_id AS VARCHAR), '{salt}')), 1, 6)) AS BIGINT) % {n})"


@query(
    "tab_prepare",
    "lines",
    f""", t AS (SELECT {', '.join(TABLE_ROWS)} FROM lines),
e AS (SELECT chart_id, entity, row_number() OVER (PARTITION BY chart_id ORDER BY count(*) DESC, entity) AS r, count(*) OVER (PARTITION BY chart_id) AS ne FROM t GROUP BY chart_id, entity),
k AS (SELECT t.* FROM t JOIN e ON t.chart_id = e.chart_id AND t.entity = e.entity WHERE ne <= 8 OR r <= 5 + {draw('entities', 4).replace('chart_id', 't.chart_id')}),
s AS (SELECT *, max(year) OVER (PARTITION BY chart_id) AS hi, min(year) OVER (PARTITION BY chart_id) AS lo FROM k),
y AS (SELECT * FROM s WHERE hi - lo <= 15 OR year >= hi - (10 + {draw('years', 6)})),
l AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY row_idx DESC) <= 20),
m AS (SELECT *, max(abs(value)) OVER (PARTITION BY chart_id) AS mx FROM l)
SELECT chart_id, row_idx, entity, year, {r2('value / CASE WHEN mx > 1000000 THEN 1000000.0 WHEN mx > 10000 THEN 1000.0 ELSE 1.0 END')} AS value,
 CASE WHEN mx > 1000000 THEN '(millions)' WHEN mx > 10000 THEN '(thousands)' ELSE '' END AS scale FROM m""",
)
def tab_prepare(spark, sf):
    return Q.prepare_tables(table_rows(spark, sf), "value")
