"""Queries on answer extraction, verdict parsing and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import extract as X
from tracelab.functions import scoring as S
from tracelab.functions import text as T
from tracelab.functions import verdicts as V
from tracelab.functions.text import or_empty, strip
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import at, line, nest, num, part, q, ra, rm, rx, st, sub
from tracelab.sources.fixtures import view

# ---- extraction -----------------------------------------------------------------------

LEAD = X.LEAD_INS
UNIT = X.UNIT_WORDS


def normalize_sql(raw: str) -> list[tuple[str, str]]:
    return [
        ("n1", st(f"replace({raw}, '**', '')")),
        (
            "n2",
            f"""CASE WHEN (starts_with(n1, '"') AND ends_with(n1, '"')) OR (starts_with(n1, '''') AND ends_with(n1, ''''))
 THEN {st('substr(n1, 2, greatest(length(n1) - 2, 0))')} ELSE n1 END""",
        ),
        ("n3", f"CASE WHEN length(n2) < 80 AND ends_with(n2, '.') THEN {st('substr(n2, 1, length(n2) - 1)')} ELSE n2 END"),
        ("n4", st(sub("n3", LEAD))),
        ("n4f", st(part("n4", ",", 1))),
        ("n6", st(sub(st(sub("n4", UNIT)), r"\s*[kKMBT]$"))),
        (
            "pred",
            f"""CASE WHEN {rm('n4', r'^(\d{4})\s+to\s+(\d{4})$')} THEN {rx('n4', r'^(\d{4})\s+to\s+(\d{4})$', 2)}
 WHEN length(n4) > 20 AND contains(n4, ',') AND lower(n4f) IN ('yes', 'no') THEN n4f
 WHEN starts_with(lower(n4), 'no') OR list_contains(list_slice(regexp_split_to_array(lower(n4), '\\s+'), 1, 3), 'no') THEN 'No'
 WHEN starts_with(lower(n4), 'yes') OR list_contains(list_slice(regexp_split_to_array(lower(n4), '\\s+'), 1, 3), 'yes') THEN 'Yes'
 WHEN length(n6) > 15 THEN coalesce(replace({at(ra('n6', X.NUMBER_PERCENT), -1)}, ',', ''), n6) ELSE n6 END""",
        ),
    ]


def v5_sql(source: str, response: str = "response") -> str:
    return nest(
        source,
        [
            (
                "scope",
                f"CASE WHEN contains({response}, '</think>') THEN {st(part(response, '</think>', -1))} WHEN contains({response}, '<think>') THEN '' ELSE {response} END",
            ),
            (
                "route",
                f"""CASE WHEN {response} = '' THEN 'empty' WHEN scope = '' AND contains({response}, '</think>') THEN 'nothing_after_think'
 WHEN scope = '' THEN 'unclosed_think' WHEN {rm('scope', X.BOXED)} THEN 'boxed' WHEN {rm('scope', X.TAG_ANY_CASE)} THEN 'tag'
 WHEN {st(rx('scope', '(?si)<answer>(.*)$'))} <> '' THEN 'open_tag' ELSE 'last_line' END""",
            ),
            (
                "raw_pred",
                f"""CASE route WHEN 'boxed' THEN {st(rx('scope', X.BOXED))} WHEN 'tag' THEN {st(rx('scope', X.TAG_ANY_CASE))}
 WHEN 'open_tag' THEN {st(rx('scope', '(?si)<answer>(.*)$'))} WHEN 'last_line' THEN {line('scope', -1)} ELSE '' END""",
            ),
            *normalize_sql("raw_pred"),
        ],
    )


def truth_sql(x: str) -> str:
    return f"CASE lower({st(x)}) WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' ELSE {x} END"


def train_sql(source: str) -> str:
    tagged = st(rx("response", X.TAG))
    tagged = st(sub(tagged, r"(?i)(?:million|billion|thousand|percent|%|dollars|\$|USD)"))
    tagged = st(sub(tagged, X.HEDGES))
    nums = lambda x: ra(x, X.NUMBER_SIMPLE)
    return nest(
        source,
        [
            ("tagged", f"CASE WHEN {rm('response', X.TAG)} THEN {tagged} END"),
            ("aft", f"CASE WHEN contains(response, '</think>') THEN {st(part('response', '</think>', -1))} ELSE '' END"),
            (
                "route",
                f"""CASE WHEN tagged IS NOT NULL THEN 'tag' WHEN aft <> '' AND len({nums('aft')}) > 0 THEN 'after_number'
 WHEN aft <> '' THEN 'after_line' WHEN len({nums('response')}) > 0 THEN 'last_number' ELSE 'last_line' END""",
            ),
            ("tshort", f"CASE WHEN length(tagged) > 50 THEN coalesce({at(nums('tagged'), 1)}, tagged) ELSE tagged END"),
            (
                "pred",
                f"""CASE route WHEN 'tag' THEN {truth_sql('tshort')} WHEN 'after_number' THEN {at(nums('aft'), -1)}
 WHEN 'after_line' THEN {truth_sql(line('aft', -1))} WHEN 'last_number' THEN {at(nums('response'), -1)} ELSE {truth_sql(line('response', -1))} END""",
            ),
        ],
    )


CONTENT = "coalesce(content, '')"
REASON = "coalesce(reasoning_content, '')"


def post_think_sql(source: str) -> str:
    tail = f"CASE WHEN contains({REASON}, '</think>') THEN {line(part(REASON, '</think>', -1), -1)} ELSE '' END"
    return nest(
        source,
        [
            ("c1", line(CONTENT, -1)),
            ("c2", tail),
            ("c3", line(REASON, -1)),
            ("route", "CASE WHEN c1 <> '' THEN 'content' WHEN c2 <> '' THEN 'after_think' WHEN c3 <> '' THEN 'reasoning' ELSE 'empty' END"),
            ("pred", "CASE WHEN c1 <> '' THEN c1 WHEN c2 <> '' THEN c2 ELSE c3 END"),
        ],
    )


def last_tag_sql(source: str) -> str:
    return nest(
        source,
        [
            (
                "txt",
                f"CASE WHEN {st(CONTENT)} <> '' THEN content WHEN contains({REASON}, '</think>') THEN {part(REASON, '</think>', -1)} ELSE {REASON} END",
            ),
            ("h", st(at(ra("concat(txt, '</answer>')", X.TAG, 1), -1))),
            ("route", "CASE WHEN coalesce(h, '') <> '' THEN 'tag' ELSE 'last_line' END"),
            ("pred", f"CASE WHEN route = 'tag' THEN h ELSE {line('txt', -1)} END"),
        ],
    )


def extended_sql(source: str) -> str:
    hits = [(f"h_{n}", at(ra("txt", p, 1), -1)) for n, p in X.EXTENDED_PATTERNS]
    route = " ".join(f"WHEN h_{n} IS NOT NULL THEN '{n}'" for n, _ in X.EXTENDED_PATTERNS)
    return nest(
        source,
        [
            ("txt", f"CASE WHEN {REASON} <> '' THEN {st(f'concat({REASON}, chr(10), {CONTENT})')} ELSE {st(CONTENT)} END"),
            *hits,
            ("ls", f"list_filter(list_transform(string_split(txt, chr(10)), lambda x: {st('x')}), lambda x: x <> '')"),
            ("tail", "list_filter(list_reverse(ls[-3:]), lambda x: length(x) <= 200)"),
            ("route", f"CASE WHEN txt = '' THEN 'empty' {route} ELSE 'last_line' END"),
            (
                "pred",
                f"coalesce({st('coalesce(' + ', '.join(n for n, _ in hits) + ')')}, tail[1], substr(ls[-1], 1, 200), '')",
            ),
        ],
    )


def by_bench_sql(source: str) -> str:
    return nest(
        source,
        [
            ("txt", f"CASE WHEN {st(CONTENT)} <> '' THEN {st(CONTENT)} ELSE {st(REASON)} END"),
            ("route", f"CASE WHEN bench = 'bench_c' THEN CASE WHEN {rm('txt', X.SPACED_TAG)} THEN 'tag' ELSE 'last_line' END ELSE 'first_line' END"),
            ("pred", f"CASE route WHEN 'tag' THEN {st(rx('txt', X.SPACED_TAG))} WHEN 'last_line' THEN {line('txt', -1)} ELSE {line('txt', 1)} END"),
        ],
    )


def legacy_sql(source: str) -> str:
    t = st(rx(CONTENT, X.TAG_ANY_CASE))
    t = st(sub(t, r"(?i)\b(?:million|billion|trillion|thousand)\b"))
    t = st(sub(t, r"(?i)\b(?:percent|percentage)\b", "%"))
    t = st(sub(t, r"(?i)\b(?:dollars|USD|EUR|GBP)\b"))
    t = st(sub(st(sub(t, X.HEDGES)), r"\s+", " "))
    number = lambda x, i: f"replace({at(ra(x, X.NUMBER_GROUPED), i)}, ',', '')"
    return nest(
        source,
        [
            ("whole", f"CASE WHEN {REASON} <> '' THEN concat('<think>', {REASON}, '</think>', chr(10), {CONTENT}) ELSE {CONTENT} END"),
            ("cl", f"CASE WHEN {rm(CONTENT, X.TAG_ANY_CASE)} THEN {t} END"),
            ("aft", f"CASE WHEN contains(whole, '</think>') THEN {line(part('whole', '</think>', -1), 1)} ELSE '' END"),
            ("tn", number("right(whole, 500)", -1)),
            (
                "route",
                f"""CASE WHEN cl IS NOT NULL THEN 'tag' WHEN {rm('whole', X.TAG_ANY_CASE)} THEN 'tag_anywhere' WHEN aft <> '' AND length(aft) < 80 THEN 'after_line'
 WHEN aft <> '' AND {rm('aft', X.NUMBER_GROUPED)} THEN 'after_number' WHEN tn IS NOT NULL THEN 'tail_number' ELSE 'last_line' END""",
            ),
            (
                "pred",
                f"""CASE route WHEN 'tag' THEN CASE WHEN length(cl) > 50 OR starts_with(cl, '*') OR starts_with(cl, '-') THEN coalesce({number('cl', 1)}, cl) ELSE cl END
 WHEN 'tag_anywhere' THEN {st(rx('whole', X.TAG_ANY_CASE))} WHEN 'after_line' THEN aft WHEN 'after_number' THEN {number('aft', 1)}
 WHEN 'tail_number' THEN tn ELSE {line('whole', -1)} END""",
            ),
        ],
    )


def last_answer_sql(source: str) -> str:
    return nest(
        source,
        [
            ("h", st(at(ra("response", X.TAG_ANY_CASE, 1), -1))),
            ("route", "CASE WHEN h IS NOT NULL THEN 'tag' ELSE 'last_line' END"),
            ("pred", f"coalesce(h, {line('response', -1)})"),
        ],
    )


PRED_CHARS = 200  # part of the rule: a sub-rollout's answer is its first 200 characters


def mc_prediction_sql(source: str) -> str:
    return nest(
        source,
        [
            ("h", rx("response", X.TAG_ANY_CASE)),
            ("route", f"CASE WHEN {rm('response', X.TAG_ANY_CASE)} THEN 'tag' WHEN {line('response', -1)} <> '' THEN 'last_line' ELSE 'whole' END"),
            ("pred", f"left(CASE route WHEN 'tag' THEN {st('h')} WHEN 'last_line' THEN {line('response', -1)} ELSE response END, {PRED_CHARS})"),
        ],
    )


def continuation_sql(source: str) -> str:
    tail = st(rx("response", X.AFTER_THINK))
    renamed = f"(SELECT * EXCLUDE (response), response AS whole, CASE WHEN {rm('response', X.AFTER_THINK)} THEN {tail} ELSE response END AS response FROM {source})"
    answered = f"(SELECT * RENAME (pred AS said, route AS found) FROM {v5_sql(renamed)})"
    return nest(
        answered,
        [
            ("route", f"CASE WHEN coalesce(said, '') <> '' THEN 'answer' WHEN {rm('whole', X.AFTER_THINK)} THEN 'tail' ELSE 'none' END"),
            ("pred", "CASE route WHEN 'answer' THEN said WHEN 'tail' THEN response ELSE '' END"),
        ],
    )


# the bracket form of the same responses
BRACKETED = "replace(replace(response, '<answer>', '[answer]'), '</answer>', '[/answer]')"


def bracket_sql(source: str) -> str:
    renamed = f"(SELECT * REPLACE ({BRACKETED} AS response) FROM {source})"
    return nest(
        renamed,
        [("route", f"CASE WHEN {rm('response', X.BRACKET_TAG)} THEN 'tag' ELSE 'none' END"), ("pred", st(rx("response", X.BRACKET_TAG)))],
    )


def teacher_sql(source: str) -> str:
    c = st(CONTENT)
    return nest(
        source,
        [
            ("route", f"CASE WHEN {c} = '' THEN 'empty' WHEN bench = 'bench_c' AND {rm(c, X.SPACED_TAG)} THEN 'tag' ELSE 'last_line' END"),
            ("pred", f"CASE route WHEN 'tag' THEN {st(rx(c, X.SPACED_TAG))} ELSE {line(CONTENT, -1)} END"),
        ],
    )


RULE_SQL = {
    "v5": ("responses", v5_sql, "extract_answer_v5"),
    "train": ("responses", train_sql, "extract_answer_train"),
    "post_think": ("served", post_think_sql, "extract_post_think"),
    "last_tag": ("served", last_tag_sql, "extract_last_tag"),
    "extended_candidate": ("served", extended_sql, "extract_extended_candidate"),
    "by_bench": ("served", by_bench_sql, "extract_by_bench"),
    "rescore_legacy": ("served", legacy_sql, "extract_rescore_legacy"),
    "last_answer_simple": ("responses", last_answer_sql, "extract_last_answer_simple"),
    "teacher_answer": ("served", teacher_sql, "extract_teacher_answer"),
    "mc_prediction": ("responses", mc_prediction_sql, "extract_mc_prediction"),
    "continuation": ("responses", continuation_sql, "extract_continuation"),
    "bracket": ("responses", bracket_sql, "extract_bracket"),
}


def _register_rule(rule: str) -> None:
    source, sql, name = RULE_SQL[rule]
    keys = ["bench", "model", "v"]

    @query(name, source, f"SELECT bench, model, v, route, pred, count(*) AS n FROM {sql(source)} GROUP BY ALL")
    def run(spark, sf):
        rows = view(spark, sf, source)
        if rule == "bracket":
            rows = rows.withColumn("response", F.expr(BRACKETED))
        return X.answer_histogram(X.RULES[rule](rows), keys)


for _rule in RULE_SQL:
    _register_rule(_rule)

MATRIX_RULES = ["v5", "train", "last_answer_simple"]


@query(
    "extract_rule_agreement",
    "responses",
    ", m AS (SELECT a.bench, a.pred AS p1, b.pred AS p2, c.pred AS p3 FROM "
    + f"(SELECT group_id, k, bench, pred FROM {v5_sql('responses')}) a JOIN (SELECT group_id, k, pred FROM {train_sql('responses')}) b USING (group_id, k)"
    + f" JOIN (SELECT group_id, k, pred FROM {last_answer_sql('responses')}) c USING (group_id, k)), r AS (SELECT 1) "
    + " UNION ALL ".join(
        f"SELECT bench, count(*) AS n, '{MATRIX_RULES[i]}' AS rule_a, '{MATRIX_RULES[j]}' AS rule_b, count(*) FILTER (WHERE "
        + (f"p{i + 1} = ''" if i == j else f"p{i + 1} <> p{j + 1}")
        + ") AS n_differ FROM m GROUP BY bench"
        for i in range(3)
        for j in range(i, 3)
    ),
)
def extract_rule_agreement(spark, sf):
    rows = X.extract_answers(view(spark, sf, "responses"), MATRIX_RULES)
    return X.rule_agreement(rows, MATRIX_RULES, ["bench"])


# ---- verdicts -------------------------------------------------------------------------

LOW = f"lower({st('raw')})"
LAST_VERDICT = part(LOW, "verdict", -1)
CORRECTNESS = f"lower({st(rx('raw', '(?si)Correctness:\\s*(.*)'))})"
VERDICT_SQL = {
    "charxiv": f"CASE WHEN {rx('raw', '(?i)Verdict:\\s*(\\w+)')} <> '' THEN CAST(starts_with(lower({rx('raw', '(?i)Verdict:\\s*(\\w+)')}), 'correct') AS INT) END",
    "yes_no": f"CASE WHEN contains(left({LOW}, 20), 'yes') THEN 1 WHEN contains(left({LOW}, 20), 'no') THEN 0 END",
    "remote": f"CASE WHEN contains({LOW}, 'verdict') THEN CASE WHEN contains({LAST_VERDICT}, 'incorrect') THEN 0 WHEN contains({LAST_VERDICT}, 'correct') THEN 1 END WHEN starts_with({LOW}, 'yes') THEN 1 WHEN starts_with({LOW}, 'no') THEN 0 END",
    "reachqa": f"CASE WHEN contains({CORRECTNESS}, 'yes') THEN 1 WHEN contains({CORRECTNESS}, 'no') THEN 0 END",
    "json_loose": f"CASE WHEN starts_with(raw, 'ERROR') THEN 0 ELSE coalesce(TRY_CAST({rx('raw', '\"score\":\\s*([0-9]+)')} AS INT), 0) END",
}

VERDICT_JOIN = """, o AS (SELECT group_id, outcome FROM rollouts WHERE k = 0),
j AS (SELECT j.*, o.outcome FROM judge_outputs j LEFT JOIN o ON j.id = o.group_id)"""


def judged(spark, sf):
    """Judge texts with the known outcome of their sample."""
    known = view(spark, sf, "rollouts").where("k = 0").select(F.col("group_id").alias("id"), "outcome")
    return view(spark, sf, "judge_outputs").join(known, "id", "left")


def verdict_report(rows, keys):
    """Pass, fail and null counts per group, and agreement with the known outcome."""
    v = F.col("verdict")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v == 1).alias("n_pass"),
        F.count_if(v == 0).alias("n_fail"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(v == F.col("outcome")).alias("n_agree"),
    )


REPORT_SQL = "count(*) AS n, count(*) FILTER (WHERE verdict = 1) AS n_pass, count(*) FILTER (WHERE verdict = 0) AS n_fail, count(*) FILTER (WHERE verdict IS NULL) AS n_null, count(*) FILTER (WHERE verdict = outcome) AS n_agree"


def _register_verdict(dialect: str) -> None:
    @query(
        f"verdict_{dialect}",
        ("judge_outputs", "rollouts"),
        VERDICT_JOIN
        + f" SELECT bench, model, form, {REPORT_SQL} FROM (SELECT *, id % 9 AS form, {VERDICT_SQL[dialect]} AS verdict FROM j) GROUP BY bench, model, form",
    )
    def run(spark, sf):
        rows = judged(spark, sf).withColumn("verdict", V.DIALECTS[dialect](F.col("raw")))
        return verdict_report(rows.withColumn("form", F.col("id") % 9), ["bench", "model", "form"])


for _dialect in VERDICT_SQL:
    _register_verdict(_dialect)


def axis_sql(question: str) -> str:
    hit = f"upper({at(ra('raw', f'(?im)^[ \\t]*{question}[ \\t]*[:\\-][ \\t]*(YES|NO|NA|N/A)\\b', 1), -1)})"
    return f"CASE {hit} WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 END"


@query(
    "axis_verdicts",
    "judge_outputs",
    ", a AS (SELECT bench, model, "
    + ", ".join(f"{axis_sql(k)} AS {a.lower()}" for k, a in V.AXES.items())
    + f""" FROM judge_outputs), m AS (SELECT *, (coalesce(value, 0) + coalesce(label, 0) + coalesce("count", 0) + coalesce(structure, 0)) * 1.0 /
 nullif(CAST(value IS NOT NULL AS INT) + CAST(label IS NOT NULL AS INT) + CAST("count" IS NOT NULL AS INT) + CAST(structure IS NOT NULL AS INT), 0) AS p FROM a)
SELECT bench, model, count(*) AS n, count(p) AS n_valid, CAST(sum(value) AS BIGINT) AS yes_value, CAST(sum(label) AS BIGINT) AS yes_label,
 CAST(sum("count") AS BIGINT) AS yes_count, CAST(sum(structure) AS BIGINT) AS yes_structure, {r6('avg(p)')} AS mean_perception FROM m GROUP BY bench, model""",
)
def axis_verdicts(spark, sf):
    from tracelab.operators.mc import axis_mean

    rows = view(spark, sf, "judge_outputs").withColumn("axes", V.axis_verdicts(F.col("raw")))
    rows = rows.withColumn("p", axis_mean(F.col("axes")))
    return rows.groupBy("bench", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("p").alias("n_valid"),
        *[F.sum(F.col("axes")[a]).cast("bigint").alias(f"yes_{a.lower()}") for a in V.AXES.values()],
        F.round(F.avg("p"), 6).alias("mean_perception"),
    )


def label_sql(names: dict[str, str]) -> str:
    letter = f"upper({rx('raw', f'(?i)LABEL:\\s*([A-{max(names)}])')})"
    return f"CASE {letter} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " ELSE 'PARSE_FAIL' END"


def field_sql(name: str) -> str:
    return st(sub(rx("raw", f"(?si){name}:\\s*(.+)"), "(?s)\\n[A-Za-z]+:.*$"))


@query(
    "label_reason",
    "judge_outputs",
    f""", l AS (SELECT bench, model, {label_sql(V.ROOT_CAUSES)} AS root_cause, {label_sql(V.FLAW_KINDS)} AS flaw_kind,
 {field_sql('QUOTE')} AS quote, {field_sql('REASON')} AS reason FROM judge_outputs)
SELECT bench, model, root_cause, flaw_kind, quote, reason, count(*) AS n FROM l GROUP BY ALL""",
)
def label_reason(spark, sf):
    raw = F.col("raw")
    rows = view(spark, sf, "judge_outputs").select(
        "bench",
        "model",
        V.label(raw, V.ROOT_CAUSES).alias("root_cause"),
        V.label(raw, V.FLAW_KINDS).alias("flaw_kind"),
        V.labelled_field(raw, "QUOTE").alias("quote"),
        V.labelled_field(raw, "REASON").alias("reason"),
    )
    return rows.groupBy("bench", "model", "root_cause", "flaw_kind", "quote", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- scoring --------------------------------------------------------------------------


def bare_sql(x: str) -> str:
    return sub(st(x), r"[,%$]")


def hit(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


def two(pn: str, gn: str, numeric: str, text: str) -> str:
    """Score over numbers p, g when both parse, else over texts."""
    return f"(SELECT CASE WHEN p IS NOT NULL AND g IS NOT NULL THEN {numeric} ELSE {text} END FROM (SELECT {pn} AS p, {gn} AS g))"


def rc_number(x: str) -> str:
    t = st(x)
    return f"CASE WHEN ends_with({t}, '%') THEN {num(f'rtrim({t}, chr(37))')} / 100.0 ELSE {num(t)} END"


def ra_clean(x: str) -> str:
    return f"rtrim({sub(st(sub(st(x), S.UNITS)), '[,%$]')}, '.')"


SAME = hit(f"lower({st('pred')}) = lower({st('gold')})")
NEAR0 = f"CASE WHEN g = 0 THEN {hit('abs(p) < 0.01')} ELSE {{rest}} END"
WITHIN = hit("abs(p - g) / abs(g) <= 0.05")
RC_SQL = two(rc_number("pred"), rc_number("gold"), f"CASE WHEN g = 0 THEN {SAME} ELSE {WITHIN} END", SAME)
SCORE_SQL = {
    "relaxed_correctness": RC_SQL,
    "relaxed_accuracy": two(
        num(st(ra_clean("pred"))), num(st(ra_clean("gold"))), NEAR0.format(rest=WITHIN),
        hit(f"lower({st(ra_clean('pred'))}) = lower({st(ra_clean('gold'))})"),
    ),
    "cerm": two(
        num(st(bare_sql("pred"))), num(st(bare_sql("gold"))), NEAR0.format(rest="1.0 / (1.0 + abs(p - g) / abs(g))"),
        hit(f"lower({bare_sql('pred')}) = lower({bare_sql('gold')})"),
    ),
    "text_match": f"""CASE WHEN lower({st('pred')}) = '' OR lower({st('gold')}) = '' THEN 0.0 WHEN lower({st('pred')}) = lower({st('gold')}) THEN 1.0
 WHEN length({st('gold')}) < 50 AND contains(lower({st('pred')}), lower({st('gold')})) THEN 1.0
 WHEN (CASE WHEN {rx(f"lower({st('pred')})", '^(\\S+)')} IN ('yes', 'true') THEN 1 WHEN {rx(f"lower({st('pred')})", '^(\\S+)')} IN ('no', 'false') THEN 0 END) =
 (CASE WHEN {rx(f"lower({st('gold')})", '^(\\S+)')} IN ('yes', 'true') THEN 1 WHEN {rx(f"lower({st('gold')})", '^(\\S+)')} IN ('no', 'false') THEN 0 END) THEN 1.0 ELSE 0.0 END""",
    "relaxed_match_legacy": two(
        num(st(bare_sql("pred"))), num(st(bare_sql("gold"))), NEAR0.format(rest=WITHIN),
        hit(f"lower({bare_sql('pred')}) = lower({bare_sql('gold')})"),
    ),
    "cerm_strict": "CASE WHEN " + st("pred") + " = '' THEN 0.0 ELSE "
    + two(
        num(st("rtrim(replace(pred, ',', ''), '%')")), num(st("rtrim(replace(gold, ',', ''), '%')")),
        f"CASE WHEN g = 0 THEN {hit('p = 0')} ELSE 1.0 / (1.0 + abs(p - g) / abs(g)) END", SAME,
    ) + " END",
    "equal_first": f"CASE WHEN lower({st('pred')}) = lower({st('gold')}) THEN 1.0 ELSE "
    + two(
        num(st(sub(f"lower({st('pred')})", "[,%$]"))), num(st(sub(f"lower({st('gold')})", "[,%$]"))),
        f"CASE WHEN g = 0 THEN {hit('p = 0')} ELSE {WITHIN} END", "0.0",
    ) + " END",
}

SCORE_REPORT = f"count(*) AS n, count(*) FILTER (WHERE score >= 1) AS n_full, count(*) FILTER (WHERE score > 0 AND score < 1) AS n_part, {r6('avg(score)')} AS mean_score"


def score_report(rows, keys):
    """Mean score per group over all rows."""
    s = F.col("score")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s >= 1).alias("n_full"),
        F.count_if((s > 0) & (s < 1)).alias("n_part"),
        F.round(F.avg(s), 6).alias("mean_score"),
    )


def _register_scorer(name: str) -> None:
    @query(
        f"score_{name}",
        "answer_pairs",
        f"SELECT bench, model, form, {SCORE_REPORT} FROM (SELECT bench, model, form, CAST({SCORE_SQL[name]} AS DOUBLE) AS score FROM answer_pairs) GROUP BY bench, model, form",
    )
    def run(spark, sf):
        rows = view(spark, sf, "answer_pairs")
        scored = rows.withColumn("score", S.SCORERS[name](F.col("pred"), F.col("gold")))
        return score_report(scored, ["bench", "model", "form"])


for _name in ("relaxed_correctness", "relaxed_accuracy", "cerm", "cerm_strict", "text_match", "relaxed_match_legacy"):
    _register_scorer(_name)


def norm_sql(x: str) -> str:
    return f"trim({sub(f'lower({x})', r'\s+', ' ')}, ' .!?,;:')"


MC_SQL = f"""CASE WHEN pred = '' OR gold = '' THEN FALSE WHEN bench = 'bench_a' AND {rm('g', '^[a-e]$')} THEN CASE WHEN {rm('p', '^[a-e]$')} THEN p = g ELSE {rx('p', '\\b([a-e])\\b')} = g END
 WHEN g IN ('y', 'yes', 'true', '1', 'ye') AND p IN ('y', 'yes', 'true', '1', 'ye') THEN TRUE
 WHEN g IN ('n', 'no', 'false', '0') AND p IN ('n', 'no', 'false', '0') THEN TRUE
 WHEN pn IS NOT NULL AND gn IS NOT NULL THEN CASE WHEN abs(gn) < 1e-9 THEN abs(pn) < 1e-6 ELSE abs(pn - gn) / greatest(1.0, abs(gn)) <= 0.05 END
 ELSE p = g OR (g <> '' AND (contains(p, g) OR contains(g, p))) END"""


@query(
    "score_multichoice_match",
    "answer_pairs",
    f"SELECT bench, model, form, {SCORE_REPORT} FROM (SELECT *, CASE WHEN {MC_SQL} THEN 1.0 ELSE 0.0 END AS score FROM "
    + nest(
        "answer_pairs",
        [("p", norm_sql("pred")), ("g", norm_sql("gold")), ("pn", num(st(sub("p", "[,%$]")))), ("gn", num(st(sub("g", "[,%$]"))))],
    )
    + ") GROUP BY bench, model, form",
)
def score_multichoice_match(spark, sf):
    rows = view(spark, sf, "answer_pairs")
    score = S.multichoice_match(F.col("pred"), F.col("gold"), F.col("bench") == "bench_a")
    return score_report(rows.withColumn("score", score), ["bench", "model", "form"])


GOLD_TYPE = f"CASE WHEN lower({st('gold')}) IN ('true', 'false', 'yes', 'no') THEN 'bool' WHEN {rm(st('gold'), r'^-?\d+\.?\d*\s*(?:%?|[MmBbKk])$')} THEN 'numeric' ELSE 'open' END"


@query(
    "score_by_gold_type",
    ("answer_pairs", "judge_outputs"),
    f""", v AS (SELECT id, {VERDICT_SQL['remote']} AS verdict FROM judge_outputs),
t AS (SELECT a.*, verdict, {GOLD_TYPE} AS kind FROM answer_pairs a LEFT JOIN v ON a.group_id = v.id),
s AS (SELECT bench, kind, CASE WHEN {st('pred')} = '' THEN 0.0 WHEN kind = 'bool' THEN {SAME} WHEN kind = 'numeric' THEN {RC_SQL} ELSE coalesce(verdict, 0) END AS score FROM t)
SELECT bench, kind, {SCORE_REPORT} FROM s GROUP BY bench, kind""",
)
def score_by_gold_type(spark, sf):
    verdicts = view(spark, sf, "judge_outputs").select(F.col("id").alias("group_id"), V.remote(F.col("raw")).alias("verdict"))
    rows = view(spark, sf, "answer_pairs").join(verdicts, "group_id", "left")
    pred, gold = F.col("pred"), F.col("gold")
    rows = rows.select(
        "bench", S.gold_type(gold).alias("kind"), S.by_gold_type(pred, gold, F.col("verdict")).alias("score")
    )
    return score_report(rows, ["bench", "kind"])


PROTOCOL = "CASE WHEN model = 'm3' THEN 'unknown_protocol' WHEN bench = 'bench_a' THEN 'relaxed_correctness' WHEN bench = 'bench_b' THEN 'charxiv_judge' ELSE 'chartmuseum_judge' END"
YES_WORD = f"CASE WHEN NOT starts_with(raw, 'ERROR') AND (starts_with({LOW}, 'yes') OR list_contains(regexp_split_to_array({LOW}, '\\s+'), 'yes')) THEN 1 ELSE 0 END"
PROTOCOL_SQL = (
    f""", p AS (SELECT group_id, k, bench, model, gold, reasoning_content, content, {PROTOCOL} AS scoring FROM served),
x AS (SELECT *, pred AS post_pred FROM {post_think_sql('p')}),
y AS (SELECT x.*, raw FROM (SELECT group_id, k, bench, model, gold, scoring, post_pred AS pred FROM x) x LEFT JOIN judge_outputs j ON x.group_id = j.id),
sc AS (SELECT *, CASE scoring WHEN 'relaxed_correctness' THEN {RC_SQL} WHEN 'charxiv_judge' THEN coalesce({VERDICT_SQL['json_loose']}, 0)
 WHEN 'chartmuseum_judge' THEN {YES_WORD} END AS score FROM y)"""
)


def scored_by_protocol(spark, sf):
    """Served responses scored the way their benchmark asks for; unknown protocols stay null."""
    rows = view(spark, sf, "served").withColumn("scoring", F.expr(PROTOCOL))
    rows = X.post_think(rows)
    texts = view(spark, sf, "judge_outputs").select(F.col("id").alias("group_id"), "raw")
    raw, way = F.col("raw"), F.col("scoring")
    score = (
        F.when(way == "relaxed_correctness", S.relaxed_correctness(F.col("pred"), F.col("gold")))
        .when(way == "charxiv_judge", V.json_score(raw).cast("double"))
        .when(way == "chartmuseum_judge", V.yes_word(raw).cast("double"))
    )
    return rows.join(texts, "group_id", "left").withColumn("score", score)


@query(
    "score_by_protocol",
    ("served", "judge_outputs"),
    PROTOCOL_SQL
    + f" SELECT bench, model, scoring, count(*) AS n, count(score) AS n_scored, {r6('sum(score)')} AS total FROM sc GROUP BY ALL",
)
def score_by_protocol(spark, sf):
    return (
        scored_by_protocol(spark, sf)
        .groupBy("bench", "model", "scoring")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("score").alias("n_scored"),
            F.round(F.sum("score"), 6).alias("total"),
        )
    )


@query(
    "eval_accuracy",
    ("served", "judge_outputs"),
    PROTOCOL_SQL + f" SELECT bench, count(*) AS n, {r6('coalesce(sum(score), 0) / count(*)')} AS accuracy FROM sc GROUP BY bench",
)
def eval_accuracy(spark, sf):
    # rows without a score stay in the denominator
    return (
        scored_by_protocol(spark, sf)
        .groupBy("bench")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.coalesce(F.sum("score"), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("accuracy"),
        )
    )


@query(
    "eval_dedup_accuracy",
    "answer_pairs",
    f""", f AS (SELECT * FROM answer_pairs QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY k) = 1),
s AS (SELECT bench, model, CASE WHEN group_id % 17 = 0 THEN NULL ELSE CAST({SCORE_SQL['equal_first']} AS DOUBLE) END AS score FROM f)
SELECT bench, model, count(*) AS n_unique, count(score) AS n_total, {r6('coalesce(sum(score), 0)')} AS n_correct, {r6('coalesce(avg(score), 0)')} AS accuracy FROM s GROUP BY bench, model""",
)
def eval_dedup_accuracy(spark, sf):
    # the first record per sample; a partial aggregate keeps one row per sample and task
    pairs = view(spark, sf, "answer_pairs")
    first = (
        pairs.groupBy("group_id", "bench", "model")
        .agg(F.min_by(F.struct("pred", "gold"), F.col("k")).alias("r"))
        .select("bench", "model", "r.*", (F.col("group_id") % 17 == 0).alias("failed"))
    )
    score = F.when(~F.col("failed"), S.equal_first(F.col("pred"), F.col("gold")))
    return (
        first.withColumn("score", score)
        .groupBy("bench", "model")
        .agg(
            F.count(F.lit(1)).alias("n_unique"),
            F.count("score").alias("n_total"),
            F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("n_correct"),
            F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("accuracy"),
        )
    )


def rejoined_sql(source: str) -> str:
    c, r = st(CONTENT), st(REASON)
    whole = f"CASE WHEN {r} = '' THEN {c} WHEN {c} = '' THEN concat('<think>', chr(10), {r}) ELSE concat('<think>', chr(10), {r}, chr(10), '</think>', chr(10), {c}) END"
    return f"(SELECT *, {whole} AS response FROM {source})"


def rescored_sql() -> str:
    """Old score (last answer, relaxed) next to the new one (v5 rule on the rejoined text)."""
    return f""", rj AS (SELECT group_id, k, v, bench, model, gold, response FROM {rejoined_sql('served')}),
new AS (SELECT group_id, k, v, bench, model, gold, pred FROM {v5_sql('rj')}),
old AS (SELECT group_id, k, gold, pred FROM {last_answer_sql('rj')}),
os AS (SELECT group_id, k, CAST({SCORE_SQL['relaxed_match_legacy']} AS DOUBLE) AS old_score FROM old),
rs AS (SELECT new.*, old_score, CASE WHEN pred = '' THEN 0.0 ELSE CAST({SCORE_SQL['relaxed_accuracy']} AS DOUBLE) END AS new_score FROM new JOIN os USING (group_id, k))"""


def rescored(spark, sf):
    rows = view(spark, sf, "served")
    rows = rows.withColumn("response", T.rejoin(F.col("content"), F.col("reasoning_content")))
    rows = X.last_answer(rows).withColumnsRenamed({"pred": "old_pred"}).drop("route")
    # the old answer is scored before the new one is looked for, so that the generated code comes in pieces small enough to be compiled
    rows = rows.withColumn("old_score", S.relaxed_match(F.col("old_pred"), F.col("gold")))
    rows = X.v5(rows)
    return rows.withColumn("new_score", F.when(F.col("pred") == "", 0.0).otherwise(S.relaxed_accuracy(F.col("pred"), F.col("gold"))))


FLIP_SQL = "count(*) FILTER (WHERE old_score = 1 AND new_score <> 1) AS flips_lost, count(*) FILTER (WHERE old_score <> 1 AND new_score = 1) AS flips_gained, count(*) FILTER (WHERE pred = '') AS empty_pred"
# where the answer came from in the early rescoring: the reasoning channel, or nothing to read at all
CHANNEL_SQL = f"count(*) FILTER (WHERE {st(CONTENT)} = '' AND {st(REASON)} <> '') AS from_reasoning, count(*) FILTER (WHERE {st(CONTENT)} = '' AND {st(REASON)} = '') AS needs_rerun"


@query(
    "eval_rescore_diff",
    "served",
    rescored_sql()
    + f""", b AS (SELECT bench, count(*) AS n, avg(CAST(old_score = 1 AS DOUBLE)) AS old_acc, avg(CAST(new_score = 1 AS DOUBLE)) AS new_acc, {FLIP_SQL} FROM rs GROUP BY bench),
h AS (SELECT bench, {CHANNEL_SQL} FROM served GROUP BY bench)
SELECT bench, n, {r6('old_acc')} AS old_acc, {r6('new_acc')} AS new_acc, flips_lost, flips_gained, empty_pred, from_reasoning, needs_rerun FROM b JOIN h USING (bench)
UNION ALL SELECT 'AVG', CAST(sum(n) AS BIGINT), {r6('avg(old_acc)')}, {r6('avg(new_acc)')}, CAST(sum(flips_lost) AS BIGINT), CAST(sum(flips_gained) AS BIGINT), CAST(sum(empty_pred) AS BIGINT), CAST(sum(from_reasoning) AS BIGINT), CAST(sum(needs_rerun) AS BIGINT) FROM b JOIN h USING (bench)""",
)
def eval_rescore_diff(spark, sf):
    old, new = F.col("old_score") == 1, F.col("new_score") == 1
    said, thought = strip(or_empty(F.col("content"))), strip(or_empty(F.col("reasoning_content")))
    per = (
        rescored(spark, sf)
        .groupBy("bench")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(old.cast("double")).alias("old_acc"),
            F.avg(new.cast("double")).alias("new_acc"),
            F.count_if(old & ~new).alias("flips_lost"),
            F.count_if(~old & new).alias("flips_gained"),
            F.count_if(F.col("pred") == "").alias("empty_pred"),
            F.count_if((said == "") & (thought != "")).alias("from_reasoning"),
            F.count_if((said == "") & (thought == "")).alias("needs_rerun"),
        )
    )
    # the macro average runs over the few benchmark rows: one rollup carries both levels
    counters = ["flips_lost", "flips_gained", "empty_pred", "from_reasoning", "needs_rerun"]
    rolled = per.rollup("bench").agg(
        *[F.sum(c).alias(c) for c in ("n", *counters)],
        *[F.round(F.avg(c), 6).alias(c) for c in ("old_acc", "new_acc")],
    )
    return rolled.select(
        F.coalesce("bench", F.lit("AVG")).alias("bench"), "n", "old_acc", "new_acc", *counters
    )


BENCHES = ["bench_a", "bench_b", "bench_c"]


@query(
    "eval_fair_table",
    "served",
    rescored_sql()
    + " SELECT model, "
    + ", ".join(
        f"{r6(f'''100 * avg(CASE WHEN bench = '{b}' THEN {w}_score END)''')} AS {w}_{b}" for b in BENCHES for w in ("old", "new")
    )
    + f", {r6('100 * avg(new_score - old_score)')} AS delta FROM rs GROUP BY model",
)
def eval_fair_table(spark, sf):
    rows = rescored(spark, sf)
    mean = lambda c, b: F.round(100 * F.avg(F.when(F.col("bench") == b, F.col(c))), 6)
    return rows.groupBy("model").agg(
        *[mean(f"{w}_score", b).alias(f"{w}_{b}") for b in BENCHES for w in ("old", "new")],
        F.round(100 * F.avg(F.col("new_score") - F.col("old_score")), 6).alias("delta"),
    )


@query(
    "eval_per_source_rescore",
    ("answer_pairs", "judge_outputs"),
    f""", v AS (SELECT id, CASE WHEN id % 9 < 5 THEN {VERDICT_SQL['reachqa']} END AS verdict FROM judge_outputs),
t AS (SELECT concat(CASE WHEN group_id % 2 = 0 THEN 'chartqa_' ELSE 'reachqa_' END, CAST(group_id AS VARCHAR)) AS id, pred, gold, verdict FROM answer_pairs a LEFT JOIN v ON a.group_id = v.id),
s AS (SELECT split_part(id, '_', 1) AS source, CAST({SCORE_SQL['relaxed_accuracy']} AS INT) AS o, CASE WHEN starts_with(id, 'chartqa_') THEN CAST({RC_SQL} AS INT) ELSE verdict END AS nw FROM t)
SELECT source, count(*) AS n, count(nw) AS n_valid, {r6('100 * avg(o)')} AS old_pct, {r6('100 * avg(nw)')} AS new_pct, CAST(sum(nw - o) AS BIGINT) AS net FROM s GROUP BY source""",
)
def eval_per_source_rescore(spark, sf):
    judged_text = F.when(F.col("id") % 9 < 5, V.correctness(F.col("raw")))
    verdicts = view(spark, sf, "judge_outputs").select(F.col("id").alias("group_id"), judged_text.alias("verdict"))
    rows = view(spark, sf, "answer_pairs").join(verdicts, "group_id", "left")
    prefix = F.when(F.col("group_id") % 2 == 0, "chartqa_").otherwise("reachqa_")
    rows = rows.withColumn("id", F.concat(prefix, F.col("group_id").cast("string")))
    pred, gold = F.col("pred"), F.col("gold")
    rows = rows.select(
        F.substring_index("id", "_", 1).alias("source"),
        S.relaxed_accuracy(pred, gold).cast("int").alias("old"),
        F.when(F.col("id").startswith("chartqa_"), S.relaxed_correctness(pred, gold).cast("int"))
        .otherwise(F.col("verdict"))
        .alias("new"),
    )
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("new").alias("n_valid"),
        F.round(100 * F.avg("old"), 6).alias("old_pct"),
        F.round(100 * F.avg("new"), 6).alias("new_pct"),
        F.sum(F.col("new") - F.col("old")).cast("bigint").alias("net"),
    )


@query(
    "eval_rejudge_override",
    ("rollouts", "judge_outputs"),
    f""", v AS (SELECT id, {VERDICT_SQL['charxiv']} AS verdict FROM judge_outputs),
t AS (SELECT bench, model, outcome, coalesce(verdict, outcome) AS final FROM rollouts r LEFT JOIN v ON r.group_id = v.id)
SELECT bench, model, count(*) AS n, count(*) FILTER (WHERE outcome = 1) AS old_pass, count(*) FILTER (WHERE final = 1) AS new_pass,
 count(*) FILTER (WHERE outcome IS NULL) AS old_null, count(*) FILTER (WHERE final IS NULL) AS new_null FROM t GROUP BY bench, model""",
)
def eval_rejudge_override(spark, sf):
    verdicts = view(spark, sf, "judge_outputs").select(F.col("id").alias("group_id"), V.verdict_word(F.col("raw")).alias("verdict"))
    rows = view(spark, sf, "rollouts").join(verdicts, "group_id", "left")
    rows = rows.withColumn("final", F.coalesce("verdict", "outcome"))
    return rows.groupBy("bench", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("outcome") == 1).alias("old_pass"),
        F.count_if(F.col("final") == 1).alias("new_pass"),
        F.count_if(F.col("outcome").isNull()).alias("old_null"),
        F.count_if(F.col("final").isNull()).alias("new_null"),
    )


def format_rewards(response):
    """Tag presence (two halves), quarters plus half for three reasoning lines, and full match."""
    paired = response.contains("<think>") & response.contains("</think>")
    tagged = response.contains("<answer>")
    body = F.substring_index(F.regexp_extract(response, r"(?s)<think>(.*)$", 1), "</think>", 1)
    reasoned = paired & (F.size(T.lines_of(body)) >= 3)
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    full = T.strip(response).rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$")
    return {
        "halves": part(paired, 0.5) + part(tagged, 0.5),
        "quarters": part(paired, 0.25) + part(tagged, 0.25) + part(reasoned, 0.5),
        "full_match": part(full, 1.0),
    }


@query(
    "eval_format_reward",
    "responses",
    f""", f AS (SELECT bench, v, contains(response, '<think>') AND contains(response, '</think>') AS paired, contains(response, '<answer>') AS tagged,
 len(list_filter(string_split(split_part(split_part(response, '<think>', 2), '</think>', 1), chr(10)), lambda x: {st('x')} <> '')) AS n_lines,
 {rm(st('response'), r'(?s)^<think>.*?</think>\s*<answer>.*?</answer>$')} AS full_match FROM responses)
SELECT bench, v, count(*) AS n, {r6('avg(CASE WHEN paired THEN 0.5 ELSE 0 END + CASE WHEN tagged THEN 0.5 ELSE 0 END)')} AS halves,
 {r6('avg(CASE WHEN paired THEN 0.25 ELSE 0 END + CASE WHEN tagged THEN 0.25 ELSE 0 END + CASE WHEN paired AND n_lines >= 3 THEN 0.5 ELSE 0 END)')} AS quarters,
 {r6('avg(CASE WHEN full_match THEN 1 ELSE 0 END)')} AS full_match FROM f GROUP BY bench, v""",
)
def eval_format_reward(spark, sf):
    rows = view(spark, sf, "responses").withColumns(format_rewards(F.col("response")))
    return rows.groupBy("bench", "v").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("halves", "quarters", "full_match")]
    )
