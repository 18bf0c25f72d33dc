"""Queries on process terms and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import scoring as S
from tracelab.functions.text import NUMBER_PATTERNS, calc_pattern, every, is_year, plain_number, reasoning_span
from tracelab.operators import mc as M
from tracelab.operators import process as P
from tracelab.operators import rewards as R
from tracelab.operators.scale import over_all, where_late
from tracelab.plans.answers import SCORE_SQL, format_rewards, train_sql
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import num, q, ra, rm, rx, st, sub
from tracelab.sources.fixtures import view

KEYS = ["group_id", "k"]
NUM = NUMBER_PATTERNS["compat"]
PAIRED = r"(?s)<think>(.*?)</think>"


def span_sql(cut: bool = True) -> str:
    rest = "split_part(response, '<answer>', 1)" if cut else "response"
    return f"CASE WHEN {rm('response', PAIRED)} THEN {rx('response', PAIRED)} WHEN contains(response, '</think>') THEN split_part(response, '</think>', 1) ELSE {rest} END"


def to_n(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"


NOT_YEAR = "NOT (n = floor(n) AND n BETWEEN 1900 AND 2030)"
WORDS = lambda x: f"len({ra(st(x), r'\S+')})"


def calc_sql(source: str, text: str, keep: str, kind: str = "compat") -> str:
    c = calc_pattern(kind)
    raw = f"SELECT {keep}, unnest({ra(text, c, 1)}) AS sa, unnest({ra(text, c, 2)}) AS op, unnest({ra(text, c, 3)}) AS sb, unnest({ra(text, c, 4)}) AS sc, unnest(range(len({ra(text, c, 1)}))) AS cpos FROM {source}"
    return (
        f"SELECT *, CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN '×' THEN a * b ELSE a / nullif(b, 0) END AS e "
        f"FROM (SELECT *, {to_n('sa')} AS a, {to_n('sb')} AS b, {to_n('sc')} AS c FROM ({raw}))"
    )


RIGHT5 = "CASE WHEN e IS NULL THEN NULL WHEN e = 0 THEN abs(c) < 0.01 ELSE abs(c - e) / abs(e) < 0.05 END"


def terms_sql(source: str = "responses", cut: bool = True, p: str = "") -> str:
    return f""", {p}sp AS (SELECT group_id, k, bench, v, {span_sql(cut)} AS span FROM {source}),
{p}mt AS (SELECT group_id, k, unnest({ra('span', NUM)}) AS t, unnest(range(len({ra('span', NUM)}))) AS pos FROM {p}sp),
{p}mn AS (SELECT group_id, k, pos, n FROM (SELECT *, {to_n('t')} AS n FROM {p}mt) WHERE {NOT_YEAR}),
{p}best AS (SELECT d.group_id, d.n, max(1.0 / (1.0 + abs(d.n - c.value) / greatest(abs(c.value), 1e-10))) AS best
 FROM (SELECT DISTINCT group_id, n FROM {p}mn WHERE abs(n) >= 1e-10) d JOIN chart_cells c ON c.chart_id = d.group_id GROUP BY d.group_id, d.n),
{p}cnt AS (SELECT m.group_id, m.k, count(*) AS n_numbers, count(*) FILTER (WHERE abs(m.n) >= 1e-10) AS n_nonzero,
 count(*) FILTER (WHERE best > 0.8) AS n_match_loose, count(*) FILTER (WHERE best > 0.9) AS n_match_tight
 FROM {p}mn m LEFT JOIN {p}best b ON m.group_id = b.group_id AND m.n = b.n GROUP BY m.group_id, m.k),
{p}cc AS (SELECT group_id, k, count(*) AS n_calcs, count(e) AS n_checkable, count(*) FILTER (WHERE {RIGHT5}) AS n_right
 FROM ({calc_sql(p + 'sp', 'span', 'group_id, k')}) GROUP BY group_id, k),
{p}tb AS (SELECT DISTINCT chart_id FROM chart_cells WHERE value IS NOT NULL),
{p}terms AS (SELECT sp.group_id, sp.k, sp.bench, sp.v, coalesce(n_numbers, 0) AS n_numbers, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(n_match_loose, 0) AS n_match_loose,
 coalesce(n_match_tight, 0) AS n_match_tight, coalesce(n_calcs, 0) AS n_calcs, coalesce(n_checkable, 0) AS n_checkable, coalesce(n_right, 0) AS n_right,
 tb.chart_id IS NOT NULL AS has_table, {st('span')} = '' AS blank, {WORDS('span')} AS span_words
 FROM {p}sp sp LEFT JOIN {p}cnt USING (group_id, k) LEFT JOIN {p}cc USING (group_id, k) LEFT JOIN {p}tb tb ON tb.chart_id = sp.group_id)"""


LOOSE = "coalesce(n_match_loose / nullif(n_nonzero, 0), 0)"
LENIENT = "CASE WHEN n_calcs = 0 THEN 0.5 ELSE (n_right + n_calcs - n_checkable) / n_calcs END"
STRICT = "coalesce(n_right / nullif(n_checkable, 0), 0)"
GROUNDING = f"CASE WHEN NOT has_table THEN 0.5 WHEN blank THEN 0 ELSE {LOOSE} END"
ARITHMETIC = f"CASE WHEN NOT has_table THEN 0.5 WHEN blank THEN 0 ELSE {LENIENT} END"
V1 = f"CASE WHEN NOT has_table THEN 0.5 WHEN blank OR n_numbers = 0 THEN 0 ELSE 0.6 * coalesce(n_match_loose / nullif(n_numbers, 0), 0) + 0.4 * ({LENIENT}) END"
V2 = f"CASE WHEN NOT has_table OR blank OR n_numbers = 0 THEN 0 ELSE 0.6 * coalesce(n_match_tight / nullif(n_nonzero, 0), 0) + 0.4 * {STRICT} END"


def terms(spark, sf, **options):
    return P.process_terms(view(spark, sf, "responses"), view(spark, sf, "chart_cells"), KEYS, "group_id", **options)


@query(
    "pr_number_mentions",
    ("responses", "chart_cells"),
    terms_sql() + " SELECT bench, v, n, count(*) AS n_mentions, CAST(sum(pos) AS BIGINT) AS sum_pos FROM mn JOIN sp USING (group_id, k) GROUP BY bench, v, n",
)
def pr_number_mentions(spark, sf):
    rows = view(spark, sf, "responses").withColumn("span", reasoning_span(F.col("response")))
    mentions = P.number_mentions(rows, ["bench", "v"], "span")
    return mentions.groupBy("bench", "v", "n").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.sum("pos").cast("bigint").alias("sum_pos")
    )


@query(
    "pr_value_grounding",
    ("responses", "chart_cells"),
    terms_sql()
    + f" SELECT group_id, k, n_numbers, n_nonzero, n_match_loose, n_match_tight, {r6(LOOSE)} AS grounding, {r6('coalesce(n_match_loose / nullif(n_numbers, 0), 0)')} AS grounding_all, {r6('coalesce(n_match_tight / nullif(n_nonzero, 0), 0)')} AS grounding_tight FROM cnt",
)
def pr_value_grounding(spark, sf):
    rows = view(spark, sf, "responses").select(*KEYS, reasoning_span(F.col("response")).alias("span"))
    counts = P.grounding_counts(rows, view(spark, sf, "chart_cells"), KEYS, "group_id", "span")
    return counts.withColumns(
        {
            "grounding": F.round(P.ratio("n_match_loose", "n_nonzero"), 6),
            "grounding_all": F.round(P.ratio("n_match_loose", "n_numbers"), 6),
            "grounding_tight": F.round(P.ratio("n_match_tight", "n_nonzero"), 6),
        }
    )


# Calculations in many forms: all operators, wrong results, division by zero, long operands.
CALC_TEXT = """concat('So ', CAST(qty AS STRING), CASE l_partkey % 6 WHEN 0 THEN ' + ' WHEN 1 THEN ' - ' WHEN 2 THEN ' * ' WHEN 3 THEN ' / ' WHEN 4 THEN ' × ' ELSE ' ÷ ' END,
 CAST(disc AS STRING), ' = ', CAST(CASE l_partkey % 6 WHEN 0 THEN qty + disc WHEN 1 THEN qty - disc WHEN 2 THEN qty * disc WHEN 3 THEN qty WHEN 4 THEN qty * disc + l_suppkey % 2 ELSE disc END AS STRING),
 '. Also 2500 + 1500 = 4000 and 1,000 - ', CAST(qty AS STRING), ' ≈ ', CAST(1000 - qty + l_suppkey % 3 * 40 AS STRING), ' in 2015.')"""


@query(
    "pr_arithmetic_check",
    "lines",
    f""", t AS (SELECT group_id, k, l_partkey % 6 AS form, {CALC_TEXT} AS txt FROM lines),
c AS (SELECT group_id, k, count(*) AS n_calcs, count(e) AS n_checkable, count(*) FILTER (WHERE {RIGHT5}) AS n_right FROM ({calc_sql('t', 'txt', 'group_id, k')}) GROUP BY group_id, k),
j AS (SELECT form, coalesce(n_calcs, 0) AS n_calcs, coalesce(n_checkable, 0) AS n_checkable, coalesce(n_right, 0) AS n_right FROM t LEFT JOIN c USING (group_id, k))
SELECT form, count(*) AS n, CAST(sum(n_calcs) AS BIGINT) AS n_calcs, CAST(sum(n_checkable) AS BIGINT) AS n_checkable, CAST(sum(n_right) AS BIGINT) AS n_right, {r6(f'avg({LENIENT})')} AS lenient, {r6(f'avg({STRICT})')} AS strict FROM j GROUP BY form""",
)
def pr_arithmetic_check(spark, sf):
    rows = view(spark, sf, "lines").selectExpr("l_partkey % 6 AS form", f"{CALC_TEXT} AS txt")
    rows = rows.withColumns(P.arithmetic_terms(F.col("txt")))
    rows = rows.withColumns({"lenient": P.arithmetic_lenient(), "strict": P.arithmetic_strict()})
    return rows.groupBy("form").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("n_calcs", "n_checkable", "n_right")],
        F.round(F.avg("lenient"), 6).alias("lenient"),
        F.round(F.avg("strict"), 6).alias("strict"),
    )


@query(
    "pr_components",
    ("responses", "chart_cells"),
    terms_sql() + f" SELECT group_id, k, {r6(GROUNDING)} AS grounding, {r6(ARITHMETIC)} AS arithmetic FROM terms",
)
def pr_components(spark, sf):
    parts = P.components()
    return terms(spark, sf).select(*KEYS, *[F.round(c, 6).alias(n) for n, c in parts.items()])


@query("pr_reward_v1", ("responses", "chart_cells"), terms_sql() + f" SELECT group_id, k, {r6(V1)} AS reward FROM terms")
def pr_reward_v1(spark, sf):
    return terms(spark, sf).select(*KEYS, F.round(P.reward_v1(), 6).alias("reward"))


@query("pr_reward_v2", ("responses", "chart_cells"), terms_sql() + f" SELECT group_id, k, {r6(V2)} AS reward FROM terms")
def pr_reward_v2(spark, sf):
    return terms(spark, sf).select(*KEYS, F.round(P.reward_v2(), 6).alias("reward"))


ENTITY_SQL = """, nm AS (SELECT DISTINCT chart_id, col AS name FROM chart_cells UNION SELECT DISTINCT chart_id, label FROM chart_cells),
ent AS (SELECT DISTINCT chart_id, token FROM (SELECT chart_id, unnest(regexp_split_to_array(lower(trim(name)), '[\\s_/\\-]+')) AS token FROM nm)
 WHERE length(token) > 1 AND NOT regexp_matches(token, '^[0-9]+$'))"""


@query("pr_table_entities", "chart_cells", ENTITY_SQL + " SELECT chart_id, token FROM ent")
def pr_table_entities(spark, sf):
    return P.table_entities(view(spark, sf, "chart_cells"))


ANCHOR_SQL = (
    terms_sql()
    + ENTITY_SQL
    + f""", tk AS (SELECT group_id, k, unnest({ra('span', P.TOKEN)}) AS tok, unnest(range(len({ra('span', P.TOKEN)}))) AS pos FROM sp),
tw AS (SELECT group_id, k, pos, lower(tok) AS tok, max(CASE WHEN e.token IS NOT NULL THEN 1 END) OVER (PARTITION BY group_id, k ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS anch
 FROM tk LEFT JOIN ent e ON e.chart_id = tk.group_id AND e.token = lower(tok)),
an AS (SELECT group_id, k, n, anch FROM (SELECT *, CASE WHEN regexp_matches(tok, '^[-+]?[0-9]') THEN {to_n('tok')} END AS n FROM tw) WHERE n IS NOT NULL AND abs(n) >= 1e-10 AND {NOT_YEAR}),
ac AS (SELECT an.group_id, an.k, count(*) AS n_mentions, count(*) FILTER (WHERE best > 0.9 AND (anch IS NOT NULL OR an.group_id NOT IN (SELECT chart_id FROM ent))) AS n_anchored
 FROM an LEFT JOIN best b ON an.group_id = b.group_id AND an.n = b.n GROUP BY an.group_id, an.k),
anc AS (SELECT t.*, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_anchored, 0) AS n_anchored,
 CASE WHEN has_table AND coalesce(n_mentions, 0) > 0 THEN n_anchored / n_mentions ELSE 0 END AS ag,
 CASE WHEN has_table AND coalesce(n_mentions, 0) > 0 THEN {STRICT} ELSE 0 END AS aa FROM terms t LEFT JOIN ac USING (group_id, k))"""
)
VAPV = "((0.6 * ag + 0.4 * aa) * greatest(0.0, 1.0 - least(1.0, span_words / 4096.0) * least(1.0, span_words / 4096.0)))"
LENGTH_LIMIT = 4096


@query(
    "pr_anchored_grounding",
    ("responses", "chart_cells"),
    ANCHOR_SQL + f" SELECT group_id, k, n_mentions, n_anchored, {r6('ag')} AS grounding, {r6('aa')} AS arithmetic FROM anc",
)
def pr_anchored_grounding(spark, sf):
    rows = P.anchored_terms(view(spark, sf, "responses"), view(spark, sf, "chart_cells"), KEYS, "group_id")
    return rows.select(
        *KEYS,
        F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"),
        F.coalesce("n_anchored", F.lit(0)).alias("n_anchored"),
        F.round("grounding", 6).alias("grounding"),
        F.round("arithmetic", 6).alias("arithmetic"),
    )


@query("pr_reward_vapv", ("responses", "chart_cells"), ANCHOR_SQL + f" SELECT group_id, k, {r6(VAPV)} AS reward FROM anc")
def pr_reward_vapv(spark, sf):
    rows = P.anchored_terms(view(spark, sf, "responses"), view(spark, sf, "chart_cells"), KEYS, "group_id")
    return rows.select(*KEYS, F.round(P.length_weighted(LENGTH_LIMIT), 6).alias("reward"))


# The chain over a trace's sentences as a recursion; every number meets every cell of its chart.
TAINT_SQL = f""", tl AS (SELECT group_id, k, list_filter(list_transform(string_split({rx('response', PAIRED)}, chr(10)), lambda x: {st('x')}), lambda x: length(x) > 5) AS s FROM responses),
ts AS (SELECT group_id, k, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM tl),
tn AS (SELECT group_id, k, i, {to_n('t')} AS n, pos FROM (SELECT group_id, k, i, unnest({ra('sentence', NUM)}) AS t, unnest(range(len({ra('sentence', NUM)}))) AS pos FROM ts)),
tq AS (SELECT d.group_id, d.n, max(CASE WHEN value = 0 THEN CASE WHEN abs(n) < 0.01 THEN 1.0 ELSE 0.0 END ELSE exp(-0.5 * pow(abs(n - value) / (abs(value) * 0.1), 2)) END) AS q
 FROM (SELECT DISTINCT group_id, n FROM tn) d JOIN chart_cells c ON c.chart_id = d.group_id AND value IS NOT NULL GROUP BY ALL),
tc AS (SELECT group_id, k, i, CASE WHEN abs(c - e) / greatest(abs(e), 1e-10) >= 0.05 THEN 0.0 ELSE 1.0 END AS logic FROM ({calc_sql('ts', 'sentence', 'group_id, k, i')}) WHERE cpos = 0),
tg AS (SELECT tn.group_id, tn.k, tn.i, list(struct_pack(n := tn.n, q := coalesce(q, 0)) ORDER BY pos) AS nums FROM tn LEFT JOIN tq ON tq.group_id = tn.group_id AND tq.n = tn.n GROUP BY ALL),
tp AS (SELECT tg.*, coalesce(logic, 1.0) AS logic, row_number() OVER (PARTITION BY group_id, k ORDER BY i) AS seq FROM tg LEFT JOIN tc USING (group_id, k, i)),
tr AS (SELECT * FROM (WITH RECURSIVE f AS (
 SELECT DISTINCT group_id, k, CAST(0 AS BIGINT) AS seq, CAST([] AS DOUBLE[]) AS bad, CAST(0 AS DOUBLE) AS total FROM tp
 UNION ALL SELECT group_id, k, seq, CASE WHEN reward < 0.5 AND NOT list_bool_or(hits) THEN list_concat(bad, list_transform(nums, lambda x: x.n)) ELSE bad END, total + reward
 FROM (SELECT *, logic * list_min(list_transform(nums, lambda x, j: CASE WHEN hits[j] THEN 0.3 ELSE x.q END)) AS reward
 FROM (SELECT f.group_id, f.k, tp.seq, f.bad, f.total, tp.nums, tp.logic,
 list_transform(tp.nums, lambda x: coalesce(list_bool_or(list_transform(f.bad, lambda t: abs(x.n - t) / greatest(abs(t), 1e-10) < 0.05)), FALSE)) AS hits
 FROM f JOIN tp ON tp.group_id = f.group_id AND tp.k = f.k AND tp.seq = f.seq + 1))) SELECT * FROM f)),
te AS (SELECT group_id, k, max_by(total, seq) / max(seq) AS taint FROM tr WHERE seq > 0 GROUP BY group_id, k),
tv AS (SELECT r.group_id, r.k, CASE WHEN r.group_id IN (SELECT chart_id FROM chart_cells WHERE value IS NOT NULL) THEN coalesce(taint, 0) ELSE 0 END AS taint FROM responses r LEFT JOIN te USING (group_id, k))"""


@query("pr_taint_chain", ("responses", "chart_cells"), TAINT_SQL + f" SELECT group_id, k, {r6('taint')} AS taint FROM tv")
def pr_taint_chain(spark, sf):
    rows = view(spark, sf, "responses").select(*KEYS, "response")
    scored = P.taint_chain(rows, view(spark, sf, "chart_cells"), KEYS, "group_id")
    return scored.select(*KEYS, F.round("taint", 6).alias("taint"))


# Question steps in seven forms and the answer of each question (its last stated value).
QA_TEXT = """CASE group_id % 7 WHEN 0 THEN concat(CAST(qty AS STRING), ' + ', CAST(disc AS STRING), ' = ', CAST(qty + disc AS STRING))
 WHEN 1 THEN concat(CAST(qty AS STRING), ' + ', CAST(disc AS STRING), ' = ', CAST(qty + disc + k % 2 * 17 AS STRING)) WHEN 2 THEN 'no computation here'
 WHEN 3 THEN concat(CAST(qty AS STRING), ' / 0 = ', CAST(qty AS STRING), ' but ', CAST(qty AS STRING), ' ÷ 1 = ', CAST(qty AS STRING))
 WHEN 4 THEN concat(CAST(qty * 100 AS STRING), ' - ', CAST(qty AS STRING), ' ≈ ', CAST(qty * 99 AS STRING))
 WHEN 5 THEN concat(CAST(qty AS STRING), ' × ', CAST(disc AS STRING), ' = ', CAST(qty * disc AS STRING)) ELSE '1,500 + 1 = 1,501' END"""
QA_ANSWER = """CASE WHEN group_id % 11 = 0 THEN 'n/a' WHEN group_id % 13 = 0 THEN '0' ELSE CASE group_id % 7 WHEN 0 THEN CAST(qty + disc AS STRING)
 WHEN 1 THEN CAST(qty + disc + k % 2 * 17 AS STRING) WHEN 2 THEN '5' WHEN 3 THEN concat(CAST(qty AS STRING), '%') WHEN 4 THEN CAST(qty * 99 + 1 AS STRING)
 WHEN 5 THEN CAST(qty * disc AS STRING) ELSE '1,501' END END"""
QA_SQL = f""", qs AS (SELECT group_id AS qa_id, k AS step_idx, {QA_TEXT} AS text, {QA_ANSWER} AS ans FROM lines),
qa AS (SELECT qa_id, count(*) AS n_steps, max_by(ans, step_idx) AS answer FROM qs GROUP BY qa_id),
ca AS ({calc_sql('qs', 'text', 'qa_id, step_idx', 'wide')}),
cq AS (SELECT qa_id, count(*) AS n_calcs, bool_and(CASE WHEN e = 0 THEN abs(c) < 0.01 ELSE abs(c - e) / abs(e) <= 0.05 END) AS all_right,
 max_by(c, step_idx * 1000 + cpos) AS last_stated FROM ca WHERE e IS NOT NULL GROUP BY qa_id),
qv AS (SELECT qa.qa_id, n_calcs, all_right, last_stated, n_steps, {num(st(sub('answer', '[,%]')))} AS a FROM qa LEFT JOIN cq USING (qa_id)),
ag AS (SELECT *, CASE WHEN last_stated IS NULL THEN TRUE WHEN a = 0 THEN abs(last_stated) < 0.01 ELSE abs(last_stated - a) / greatest(abs(a), 1e-10) <= 0.05 END AS agrees FROM qv)"""


def qa_checked(spark, sf):
    steps = view(spark, sf, "lines").selectExpr(
        "group_id AS qa_id", "k AS step_idx", f"{QA_TEXT} AS text", f"{QA_ANSWER} AS ans"
    )
    answers = steps.groupBy("qa_id").agg(F.max_by("ans", "step_idx").alias("answer"))
    from tracelab.functions.text import strip, to_number
    from tracelab.functions.text import sub as cut

    value = to_number(strip(cut(F.col("answer"), "[,%]")))
    return P.qa_checks(steps, ["qa_id"]).join(answers, "qa_id").withColumn("a", value)


@query(
    "pr_qa_arithmetic_verify",
    "lines",
    QA_SQL
    + " SELECT qa_id, coalesce(abs(a) <= 10000 AND abs(a) >= 0.001 AND agrees AND all_right AND n_calcs > 0, FALSE) AS verified FROM ag",
)
def pr_qa_arithmetic_verify(spark, sf):
    return qa_checked(spark, sf).select("qa_id", P.qa_verified(F.col("a")).alias("verified"))


@query(
    "pr_qa_verify_reasons",
    ("lines", "chart_cells"),
    QA_SQL
    + f""", rs AS (SELECT qa_id, CASE WHEN t.chart_id IS NULL THEN 'no_csv' WHEN coalesce(n_steps, 0) = 0 THEN 'no_steps' WHEN a IS NULL THEN 'non_numeric_answer'
 WHEN NOT agrees THEN 'final_answer_vs_computation_mismatch' WHEN n_calcs IS NULL THEN 'no_computations_in_steps' WHEN all_right THEN 'computations_verified' ELSE 'computation_mismatch' END AS reason
 FROM ag LEFT JOIN (SELECT DISTINCT chart_id FROM chart_cells) t ON t.chart_id = ag.qa_id)
SELECT reason, count(*) AS n, {r6('100.0 * count(*) / (SELECT count(*) FROM rs)')} AS share FROM rs GROUP BY reason""",
)
def pr_qa_verify_reasons(spark, sf):
    tables = view(spark, sf, "chart_cells").select(F.col("chart_id").alias("qa_id")).distinct().withColumn("t", F.lit(True))
    rows = qa_checked(spark, sf).join(tables, "qa_id", "left")
    rows = rows.withColumn("reason", P.qa_reason(F.col("a"), F.coalesce("t", F.lit(False))))
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / over_all("n"), 6))


# ---- rewards --------------------------------------------------------------------------

NUMERIC_SQL = f"(lower({st('gold')}) NOT IN ('yes', 'no', 'true', 'false', 'n/a', 'none', '') AND ({num(st(sub(st(sub(f'lower({st("gold")})', '[,%$]')), r'(?i)\s*(?:billion|million|thousand|trillion|percent|k|M|B|T)$')))}) IS NOT NULL)"
BASE_SQL = f""", pr AS (SELECT group_id, k, bench, v, gold, response, pred FROM {train_sql('responses')}),
ot AS (SELECT group_id, k, bench, v, CAST({SCORE_SQL['cerm']} AS DOUBLE) AS cerm, CAST({SCORE_SQL['text_match']} AS DOUBLE) AS txt, {NUMERIC_SQL} AS numeric,
 CASE WHEN contains(response, '</think>') THEN {WORDS(span_sql())} ELSE 0 END AS words, response, gold, pred FROM pr)"""


def tele_sql(source: str, keys: str = "bench, v") -> str:
    shares = ", ".join(f"{r6(f'''avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END)''')} AS frac_{k}" for k in ("correct", "augmented", "text", "outcome_only"))
    return (
        f"SELECT {keys}, count(*) AS n_completions, {r6('avg(reward)')} AS reward_mean, {r6('stddev_pop(reward)')} AS reward_std, {r6('avg(acc)')} AS acc_mean,"
        f" {r6('avg(proc)')} AS proc_mean, {shares}, {r6('avg(words)')} AS avg_think_words FROM {source} GROUP BY {keys}"
    )


def rewarded_sql(reward: str, acc: str, proc: str, kind: str, process: bool = True, extra: str = "", cut: bool = True) -> str:
    head = BASE_SQL + (terms_sql(cut=cut) if process else "") + extra
    source = "ot JOIN terms USING (group_id, k)" if process else "ot"
    if "anc" in extra:
        source = "ot JOIN anc USING (group_id, k)"
    return head + f", rw AS (SELECT ot.group_id, ot.k, ot.bench, ot.v, words, CAST({reward} AS DOUBLE) AS reward, CAST({acc} AS DOUBLE) AS acc, CAST({proc} AS DOUBLE) AS proc, {kind} AS kind FROM {source})"


TEXT_KIND = "CASE WHEN NOT numeric THEN 'text' WHEN cerm >= 0.95 THEN 'correct' ELSE 'augmented' END"
BRANCH_ACC = "CASE WHEN NOT numeric THEN txt ELSE cerm END"


def branch_sql(wrong: str) -> str:
    return f"CASE WHEN NOT numeric THEN txt WHEN cerm >= 0.95 THEN 1.0 ELSE {wrong} END"


def branch_proc(proc: str) -> str:
    return f"CASE WHEN NOT numeric THEN 0.0 WHEN cerm >= 0.95 THEN 1.0 ELSE {proc} END"


# a question on a chart of one row asks for one fact and has one step
SINGLE = "ot.group_id NOT IN (SELECT chart_id FROM chart_cells GROUP BY chart_id HAVING count(DISTINCT row_idx) >= 2)"
REWARDS: dict[str, dict] = {
    "rw_outcome": dict(reward="cerm", acc="cerm", proc="NULL", kind="CASE WHEN cerm >= 0.95 THEN 'correct' ELSE 'wrong' END", process=False),
    "rw_outcome_text_aware": dict(reward=BRANCH_ACC, acc=BRANCH_ACC, proc="NULL", kind=f"CASE WHEN {BRANCH_ACC} >= 0.95 THEN 'correct' ELSE 'wrong' END", process=False),
    "rw_conditional": dict(
        reward=f"CASE WHEN cerm >= 0.95 THEN 1.0 ELSE least(1.0, cerm + 0.3 * ({V1})) END", acc="cerm",
        proc=f"CASE WHEN cerm >= 0.95 THEN 1.0 ELSE {V1} END", kind="CASE WHEN cerm >= 0.95 THEN 'correct' ELSE 'augmented' END",
    ),
    "rw_conditional_v2": dict(reward=branch_sql(f"least(1.0, cerm + 0.3 * ({V1}))"), acc=BRANCH_ACC, proc=branch_proc(V1), kind=TEXT_KIND),
    "rw_value_only": dict(reward=branch_sql(f"least(1.0, cerm + 0.3 * ({GROUNDING}))"), acc=BRANCH_ACC, proc=branch_proc(GROUNDING), kind=TEXT_KIND),
    "rw_arith_only": dict(reward=branch_sql(f"least(1.0, cerm + 0.3 * ({ARITHMETIC}))"), acc=BRANCH_ACC, proc=branch_proc(ARITHMETIC), kind=TEXT_KIND),
    "rw_multiplicative": dict(reward=branch_sql(f"cerm + 0.3 * (1.0 - cerm) * ({V2})"), acc=BRANCH_ACC, proc=branch_proc(V2), kind=TEXT_KIND),
    "rw_grounding_only": dict(
        reward=branch_sql("least(1.0, cerm + 0.3 * CASE WHEN has_table THEN coalesce(n_match_loose / nullif(n_numbers, 0), 0) ELSE 0.5 END)"), acc=BRANCH_ACC,
        proc=branch_proc("CASE WHEN has_table THEN coalesce(n_match_loose / nullif(n_numbers, 0), 0) ELSE 0.5 END"), kind=TEXT_KIND, cut=False,
    ),
    "rw_additive": dict(
        reward=f"CASE WHEN NOT numeric THEN txt ELSE least(1.0, 0.5 * cerm + 0.3 * ({V1}) + 0.2) END", acc=BRANCH_ACC,
        proc=f"CASE WHEN NOT numeric THEN 0.0 ELSE {V1} END", kind=TEXT_KIND,
    ),
    "rw_vapv": dict(
        reward=f"CASE WHEN NOT numeric THEN txt WHEN {SINGLE} THEN CASE WHEN cerm >= 0.95 THEN 1.0 ELSE 0.0 END WHEN cerm >= 0.95 THEN 1.0 ELSE 0.05 * {VAPV} END",
        acc=BRANCH_ACC, proc=f"CASE WHEN NOT numeric OR {SINGLE} THEN 0.0 WHEN cerm >= 0.95 THEN 1.0 ELSE {VAPV} END",
        kind=f"CASE WHEN NOT numeric THEN 'text' WHEN {SINGLE} THEN 'outcome_only' WHEN cerm >= 0.95 THEN 'correct' ELSE 'augmented' END", process=False,
        extra=ANCHOR_SQL,
    ),
}


def outcomes(spark, sf):
    rows = R.outcome_terms(view(spark, sf, "responses"))
    return rows.withColumn("has_csv", F.col("group_id").isNotNull())


def reward_rows(spark, sf, name):
    """Responses with reward, acc, proc and kind of one reward function."""
    rows, cells = outcomes(spark, sf), view(spark, sf, "chart_cells")
    cerm, right = F.col("cerm"), F.col("cerm") >= R.RIGHT
    attach = lambda needed, **o: R.with_process(rows, cells, KEYS, "group_id", needed, **o)
    acc = R.text_aware()
    kind = F.when(~F.col("numeric"), "text").when(right, "correct").otherwise("augmented")
    proc_of = lambda p: F.when(~F.col("numeric"), 0.0).when(right, 1.0).otherwise(p)
    nothing = F.lit(None).cast("double")
    if name == "rw_outcome":
        return rows.withColumns({"reward": cerm, "acc": cerm, "proc": nothing, "kind": F.when(right, "correct").otherwise("wrong")})
    if name == "rw_outcome_text_aware":
        return rows.withColumns(
            {"reward": acc, "acc": acc, "proc": nothing, "kind": F.when(acc >= R.RIGHT, "correct").otherwise("wrong")}
        )
    if name == "rw_conditional":
        p = P.reward_v1()
        return attach(~right).withColumns(
            {"reward": R.conditional(p), "acc": cerm, "proc": F.when(right, 1.0).otherwise(p), "kind": F.when(right, "correct").otherwise("augmented")}
        )
    if name == "rw_vapv":
        steps = cells.groupBy(F.col("chart_id").alias("group_id")).agg((F.max("row_idx") > F.min("row_idx")).alias("several"))
        rows = rows.join(steps, "group_id", "left")
        multi = F.coalesce("several", F.lit(False))
        p = P.length_weighted(LENGTH_LIMIT)
        joined = attach(R.wrong_numeric() & multi, terms=P.anchored_terms)
        return joined.withColumns(
            {
                "reward": R.small_process(p, multi),
                "acc": acc,
                "proc": F.when(~F.col("numeric") | ~multi, 0.0).when(right, 1.0).otherwise(p),
                "kind": F.when(~F.col("numeric"), "text").when(~multi, "outcome_only").when(right, "correct").otherwise("augmented"),
            }
        )
    if name == "rw_additive":
        p = P.reward_v1()
        return attach(F.col("numeric")).withColumns(
            {"reward": R.branch(R.additive(p)), "acc": acc, "proc": F.when(~F.col("numeric"), 0.0).otherwise(p), "kind": kind}
        )
    parts = P.components()
    all_mentions = F.when(F.col("has_table"), P.ratio("n_match_loose", "n_numbers")).otherwise(0.5)
    p = {
        "rw_conditional_v2": P.reward_v1(),
        "rw_value_only": parts["grounding"],
        "rw_arith_only": parts["arithmetic"],
        "rw_multiplicative": P.reward_v2(),
        "rw_grounding_only": all_mentions,
    }[name]
    reward = R.multiplicative(p) if name == "rw_multiplicative" else R.conditional(p)
    joined = attach(R.wrong_numeric(), cut_answer=name != "rw_grounding_only")
    return joined.withColumns({"reward": R.branch(reward), "acc": acc, "proc": proc_of(p), "kind": kind})


def _register_reward(name: str) -> None:
    @query(name, ("responses", "chart_cells"), rewarded_sql(**REWARDS[name]) + " " + tele_sql("rw"))
    def run(spark, sf):
        return R.telemetry(reward_rows(spark, sf, name), ["bench", "v"])


for _name in REWARDS:
    _register_reward(_name)


@query(
    "rw_telemetry",
    ("responses", "chart_cells"),
    rewarded_sql(**REWARDS["rw_multiplicative"])
    + ", bt AS (SELECT *, floor(group_id / 64) AS batch FROM rw) "
    + tele_sql("(SELECT * REPLACE (CAST(batch AS BIGINT) AS batch) FROM bt)", "batch"),
)
def rw_telemetry(spark, sf):
    rows = reward_rows(spark, sf, "rw_multiplicative")
    return R.telemetry(rows.withColumn("batch", F.floor(F.col("group_id") / 64).cast("bigint")), ["batch"])


@query(
    "rw_inflation_audit",
    ("responses", "chart_cells"),
    rewarded_sql(**REWARDS["rw_conditional_v2"])
    + f", r3 AS (SELECT group_id, k, CAST({REWARDS['rw_multiplicative']['reward']} AS DOUBLE) AS mult FROM ot JOIN terms USING (group_id, k))"
    + f""" SELECT bench, count(*) AS n_wrong, count(*) FILTER (WHERE reward >= 1) AS n_inflated, {r6('avg(CASE WHEN reward >= 1 THEN 1.0 ELSE 0.0 END)')} AS share_inflated,
 count(*) FILTER (WHERE mult >= 1) AS n_inflated_multiplicative, {r6('max(reward)')} AS max_reward, {r6('max(mult)')} AS max_multiplicative
 FROM rw JOIN r3 USING (group_id, k) WHERE kind = 'augmented' GROUP BY bench""",
)
def rw_inflation_audit(spark, sf):
    rows = reward_rows(spark, sf, "rw_conditional_v2").withColumn("mult", R.multiplicative(P.reward_v2()))
    rows = where_late(rows, F.col("kind") == "augmented")
    full = lambda c: F.col(c) >= 1
    return rows.groupBy("bench").agg(
        F.count(F.lit(1)).alias("n_wrong"),
        F.count_if(full("reward")).alias("n_inflated"),
        F.round(F.avg(full("reward").cast("double")), 6).alias("share_inflated"),
        F.count_if(full("mult")).alias("n_inflated_multiplicative"),
        F.round(F.max("reward"), 6).alias("max_reward"),
        F.round(F.max("mult"), 6).alias("max_multiplicative"),
    )


ACC_SQL = SCORE_SQL["relaxed_match_legacy"]
FORMAT_SQL = """(CASE WHEN contains(response, '<think>') AND contains(response, '</think>') THEN 0.5 ELSE 0 END + CASE WHEN contains(response, '<answer>') THEN 0.5 ELSE 0 END)"""


@query(
    "rw_legacy_outcome",
    "responses",
    f""", pr AS (SELECT bench, v, gold, response, pred FROM {train_sql('responses')}),
s AS (SELECT bench, v, CAST({ACC_SQL} AS DOUBLE) AS acc, CAST({FORMAT_SQL} AS DOUBLE) AS fmt FROM pr)
SELECT bench, v, count(*) AS n, {r6('avg(acc)')} AS acc_mean, {r6('avg(fmt)')} AS format_mean, {r6('avg(acc + fmt)')} AS reward_mean FROM s GROUP BY bench, v""",
)
def rw_legacy_outcome(spark, sf):
    rows = outcomes(spark, sf)
    rows = rows.withColumns(
        {"acc": S.relaxed_match(F.col("pred"), F.col("gold")), "fmt": format_rewards(F.col("response"))["halves"]}
    )
    return rows.groupBy("bench", "v").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("acc"), 6).alias("acc_mean"),
        F.round(F.avg("fmt"), 6).alias("format_mean"),
        F.round(F.avg(F.col("acc") + F.col("fmt")), 6).alias("reward_mean"),
    )


def legacy_mix(spark, sf):
    rows = outcomes(spark, sf).withColumns(
        {"acc": S.relaxed_match(F.col("pred"), F.col("gold")), "fmt": format_rewards(F.col("response"))["quarters"]}
    )
    rows = P.taint_chain(rows, view(spark, sf, "chart_cells"), KEYS, "group_id")
    return rows.withColumn("reward", 0.5 * F.col("acc") + 0.3 * F.col("taint") + 0.2 * F.col("fmt"))


FMT = f"""CASE WHEN contains(response, '<think>') AND contains(response, '</think>') THEN 0.25 + CASE WHEN len(list_filter(string_split(split_part(split_part(response, '<think>', 2), '</think>', 1), chr(10)), lambda x: {st('x')} <> '')) >= 3
 THEN 0.5 ELSE 0 END ELSE 0 END + CASE WHEN contains(response, '<answer>') THEN 0.25 ELSE 0 END"""


@query(
    "rw_legacy_mix",
    ("responses", "chart_cells"),
    TAINT_SQL
    + f""", lp AS (SELECT group_id, k, bench, v, CAST({SCORE_SQL['relaxed_match_legacy']} AS DOUBLE) AS acc, CAST({FMT} AS DOUBLE) AS fmt FROM (SELECT * FROM {train_sql('responses')})),
lm AS (SELECT bench, v, acc, taint, fmt, 0.5 * acc + 0.3 * taint + 0.2 * fmt AS reward FROM lp JOIN tv USING (group_id, k))
SELECT bench, v, count(*) AS n, {', '.join(f"{r6(f'avg({c})')} AS {c}_mean" for c in ('acc', 'taint', 'fmt', 'reward'))} FROM lm GROUP BY bench, v""",
)
def rw_legacy_mix(spark, sf):
    return (
        legacy_mix(spark, sf)
        .groupBy("bench", "v")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("acc", "taint", "fmt", "reward")],
        )
    )


@query(
    "rw_length_penalty",
    ("documents", "labels"),
    f"""SELECT lang, source, count(*) AS n, {r6('avg(p2)')} AS penalty_v2, {r6('avg(p3)')} AS penalty_v3, {r6('avg(greatest(0, reward - p2))')} AS floored_v2, {r6('avg(greatest(0, reward - p3))')} AS floored_v3
 FROM (SELECT *, 0.2 * greatest(0, least(1, (w - 300) / 300.0)) AS p2, CASE WHEN w <= 250 THEN 0 ELSE 0.3 * least((w - 250) / 250.0, 1) END AS p3
 FROM (SELECT lang, source, {WORDS('text')} AS w, CAST(quality AS DOUBLE) AS reward FROM documents JOIN labels USING (doc_id))) GROUP BY lang, source""",
)
def rw_length_penalty(spark, sf):
    from tracelab.functions.text import words
    from tracelab.sources.fixtures import table

    # real prose, so that lengths fall on both sides of the limits; the label is the reward
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.select("lang", "source", words(F.col("text")).alias("w"), F.col("quality").cast("double").alias("reward"))
    rows = rows.withColumns({"p2": R.length_penalty(F.col("w"), 2), "p3": R.length_penalty(F.col("w"), 3)})
    floor = lambda c: F.greatest(F.lit(0.0), F.col("reward") - F.col(c))
    return rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("p2"), 6).alias("penalty_v2"),
        F.round(F.avg("p3"), 6).alias("penalty_v3"),
        F.round(F.avg(floor("p2")), 6).alias("floored_v2"),
        F.round(F.avg(floor("p3")), 6).alias("floored_v3"),
    )


QUARTERS_SQL = f"""(CASE WHEN contains(response, '<think>') AND contains(response, '</think>') THEN 0.25 ELSE 0 END + CASE WHEN contains(response, '<answer>') THEN 0.25 ELSE 0 END
 + CASE WHEN contains(response, '<think>') AND contains(response, '</think>') AND len(list_filter(string_split(split_part(split_part(response, '<think>', 2), '</think>', 1), chr(10)), lambda x: {st('x')} <> '')) >= 3 THEN 0.5 ELSE 0 END)"""


@query(
    "rw_components_report",
    ("responses", "chart_cells"),
    BASE_SQL
    + terms_sql()
    + f""", s AS (SELECT ot.bench, CAST({ACC_SQL} AS DOUBLE) AS acc, {V1} AS proc, {QUARTERS_SQL} AS fmt, n_numbers, n_calcs, n_right, n_checkable FROM ot JOIN terms USING (group_id, k))
SELECT bench, count(*) AS n, {r6('avg(acc)')} AS acc_mean, {r6('avg(proc)')} AS proc_mean, {r6('avg(fmt)')} AS format_mean, {r6('avg(0.5 * acc + 0.3 * proc + 0.2 * fmt)')} AS total_mean,
 {r6('avg(CASE WHEN n_numbers = 0 AND n_calcs = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_claim_ratio, CAST(sum(n_right) AS BIGINT) AS calcs_right, CAST(sum(n_checkable - n_right) AS BIGINT) AS calcs_wrong,
 CAST(sum(n_calcs - n_checkable) AS BIGINT) AS calcs_unchecked FROM s GROUP BY bench""",
)
def rw_components_report(spark, sf):
    rows = R.with_process(outcomes(spark, sf), view(spark, sf, "chart_cells"), KEYS, "group_id", F.lit(True))
    rows = rows.withColumns(
        {
            "acc": S.relaxed_match(F.col("pred"), F.col("gold")),
            "proc": P.reward_v1(),
            "fmt": format_rewards(F.col("response"))["quarters"],
        }
    )
    none = (F.col("n_numbers") == 0) & (F.col("n_calcs") == 0)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return rows.groupBy("bench").agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("acc"), "acc_mean"),
        mean(F.col("proc"), "proc_mean"),
        mean(F.col("fmt"), "format_mean"),
        mean(0.5 * F.col("acc") + 0.3 * F.col("proc") + 0.2 * F.col("fmt"), "total_mean"),
        mean(none.cast("double"), "zero_claim_ratio"),
        total(F.col("n_right"), "calcs_right"),
        total(F.col("n_checkable") - F.col("n_right"), "calcs_wrong"),
        total(F.col("n_calcs") - F.col("n_checkable"), "calcs_unchecked"),
    )


STD0 = lambda e: f"coalesce(CASE WHEN count({e}) >= 2 THEN stddev_pop({e}) END, 0.0)"


@query(
    "sg_conditional_variance",
    ("responses", "chart_cells"),
    BASE_SQL
    + terms_sql()
    + f""", s AS (SELECT ot.bench, ot.group_id, cerm, CASE WHEN cerm >= 0.95 THEN 1.0 ELSE {V1} END AS cond FROM ot JOIN terms USING (group_id, k)),
g AS (SELECT bench, group_id, round({STD0('cond')}, 9) AS sc, round({STD0('cerm')}, 9) AS so FROM s GROUP BY bench, group_id)
SELECT bench, count(*) AS n_groups, {r6('avg(sc)')} AS cond_mean, {r6('median(sc)')} AS cond_median, {r6('avg(so)')} AS outcome_mean, {r6('median(so)')} AS outcome_median,
 count(*) FILTER (WHERE sc > 0.1) AS n_cond_live, count(*) FILTER (WHERE sc < 0.01) AS n_cond_dead FROM g GROUP BY bench""",
)
def sg_conditional_variance(spark, sf):
    from tracelab.operators.scale import exact_quantiles

    right = F.col("cerm") >= R.RIGHT
    rows = R.with_process(outcomes(spark, sf), view(spark, sf, "chart_cells"), KEYS, "group_id", ~right)
    rows = rows.withColumn("cond", F.when(right, 1.0).otherwise(P.reward_v1()))
    groups = rows.groupBy("bench", "group_id").agg(
        F.round(M.pstd(F.col("cond")), 9).alias("cond"), F.round(M.pstd(F.col("cerm")), 9).alias("outcome")
    )
    # all figures come from one histogram of both spreads, so that no row is scored twice
    spread = groups.select("bench", F.expr("stack(2, 'cond', cond, 'outcome', outcome) AS (what, s)"))
    counts = where_late(spread.groupBy("bench", "what", "s").agg(F.count(F.lit(1)).alias("rows")), F.col("rows") > 0)
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    also = {"n": F.sum("n"), "mean": F.sum(F.col("s") * F.col("n")) / F.sum("n"), "live": count(F.col("s") > 0.1), "dead": count(F.col("s") < 0.01)}
    found = exact_quantiles(counts, ["bench", "what"], "s", {"median": 0.5}, weight="rows", also=also, low=0.0, high=0.5)
    pick = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    whole = lambda c: F.coalesce(pick("cond", c), F.lit(0)).cast("bigint")
    rounded = lambda c: [F.round(pick(what, c), 6).alias(f"{what}_{c}") for what in ("cond", "outcome")]
    return found.groupBy("bench").agg(
        whole("n").alias("n_groups"), *rounded("mean"), whole("live").alias("n_cond_live"), whole("dead").alias("n_cond_dead"), *rounded("median")
    )
