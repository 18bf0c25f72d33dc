"""Queries on trace segmentation and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions.text import explode_items
from tracelab.operators import traces as G
from tracelab.plans.answers import CONTENT, REASON
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import ra, rm, rx, st, sub
from tracelab.sources.fixtures import table, view

BODY = r"(?s)<think>(.*?)</think>"
THINK_SQL = f"CASE WHEN {REASON} <> '' AND NOT starts_with({REASON}, 'ERROR') THEN {st('reasoning_content')} WHEN {rm(CONTENT, BODY)} THEN {st(rx(CONTENT, BODY))} ELSE {st(CONTENT)} END"
WORDS = lambda x: f"len({ra(st(x), r'\S+')})"


@query(
    "tr_thinking_text",
    "served",
    f", t AS (SELECT bench, v, {THINK_SQL} AS t FROM served) SELECT bench, v, count(*) AS n, count(*) FILTER (WHERE t = '') AS n_empty, CAST(sum(length(t)) AS BIGINT) AS chars, md5(max(t)) AS top, md5(min(t)) AS low FROM t GROUP BY bench, v",
)
def tr_thinking_text(spark, sf):
    t = G.thinking_text(F.col("content"), F.col("reasoning_content"))
    rows = view(spark, sf, "served").select("bench", "v", t.alias("t"))
    return rows.groupBy("bench", "v").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("t") == "").alias("n_empty"),
        F.sum(F.length("t")).cast("bigint").alias("chars"),
        F.md5(F.max("t")).alias("top"),
        F.md5(F.min("t")).alias("low"),
    )


def doc_segments(spark, sf):
    """Documents cut into steps (one line is one block)."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return G.segment_steps(docs, "text", "steps", separator="\n").drop("text")


def packed_sql(source: str, keys: str, fits: str) -> str:
    """Chunk number of every piece (i from 1, w words): a piece stays in the open chunk while ``fits`` holds."""
    on = " AND ".join(f"f.{k} = p.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""SELECT * FROM (WITH RECURSIVE f AS (SELECT {keys}, i, w AS size, 1 AS chunk FROM {source} WHERE i = 1
 UNION ALL SELECT {own}, p.i, CASE WHEN {fits} THEN f.size + p.w ELSE p.w END, CASE WHEN {fits} THEN f.chunk ELSE f.chunk + 1 END FROM f JOIN {source} p ON {on} AND p.i = f.i + 1) SELECT * FROM f)"""


def segment_sql(source: str, keys: str, pieces: str, joiner: str, low: int, high: int = 560) -> str:
    """Rows (keys, step, len, text_md5) of a source whose blocks are the list ``pieces``."""
    return f""", sl AS (SELECT {keys}, list_filter(list_transform({pieces}, lambda x: {st('x')}), lambda x: x <> '') AS b FROM {source}),
sb AS (SELECT *, {WORDS('t')} AS w FROM (SELECT {keys}, unnest(b) AS t, unnest(range(1, len(b) + 1)) AS i FROM sl)),
sm AS ({packed_sql('sb', keys, f'f.size + p.w < {low}')}),
sc AS (SELECT {keys}, chunk AS part, string_agg(t, {joiner} ORDER BY i) AS t, CAST(sum(w) AS INT) AS w FROM sb JOIN sm USING ({keys}, i) GROUP BY ALL),
sp AS (SELECT {keys}, part, string_split(regexp_replace(t, '([.!?])\\s+([A-Z])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)) AS b FROM sc WHERE w > {high}),
sq AS (SELECT *, {WORDS('t')} AS w FROM (SELECT {keys}, part, unnest(b) AS t, unnest(range(1, len(b) + 1)) AS i FROM sp)),
sr AS ({packed_sql('sq', keys + ', part', f'f.size + p.w <= {high}')}),
se AS (SELECT {keys}, part, 0 AS sub, t, w FROM sc WHERE w <= {high}
 UNION ALL SELECT {keys}, part, chunk, string_agg(t, ' ' ORDER BY i), CAST(sum(w) AS INT) FROM sq JOIN sr USING ({keys}, part, i) GROUP BY {keys}, part, chunk)
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY part, sub) - 1 AS INT) AS step, w AS len, md5(t) AS text_md5 FROM se"""


def step_rows(rows, keys):
    return explode_items(rows, keys, F.col("steps"), "step", "s").select(*keys, "step", F.col("s.len").alias("len"), F.md5("s.text").alias("text_md5"))


HARD_SQL = f""", hb AS (SELECT group_id, k, {st(sub(THINK_SQL, '(?is)\\b(?:final answer|the answer is).*$'))} AS text FROM served)""" + segment_sql(
    "hb", "group_id, k", "string_split_regex(text, '\\n\\s*\\n')", "chr(10) || chr(10)", 60
)


@query("tr_segment_hard", "served", HARD_SQL)
def tr_segment_hard(spark, sf):
    """The hard-bench form: cut before the final answer, blank lines with white space, 60 words at least."""
    text = G.before_answer(G.thinking_text(F.col("content"), F.col("reasoning_content")))
    rows = view(spark, sf, "served").select("group_id", "k", text.alias("text"))
    return step_rows(G.segment_steps(rows, "text", "steps", low=60, split_at=G.BLANK_LINE).drop("text"), ["group_id", "k"])


@query("tr_segment_turns", "conversations", """, ct AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')""" + segment_sql("ct", "conv_id, turn", "string_split(text, chr(10))", "chr(10)", 80))
def tr_segment_turns(spark, sf):
    """Answers of the conversations cut into steps."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return step_rows(G.segment_steps(rows, "text", "steps", separator="\n").drop("text"), ["conv_id", "turn"])


@query("tr_segment_steps", "documents", segment_sql("documents", "doc_id", "string_split(text, chr(10))", "chr(10)", 80))
def tr_segment_steps(spark, sf):
    return step_rows(doc_segments(spark, sf), ["doc_id"])


MARKED = "(?i)\\n(" + "|".join(m.replace("\\b", "") for m in G.STEP_MARKERS) + ")"
_MARK = "regexp_replace({x}, '" + MARKED.replace("'", "''") + "', chr(10) || chr(1) || '\\1', 'g')"
# a marker may end with the line feed before the next one, so lines are marked twice; packing counts one character more for the first sentence
MARKER_SQL = f""", mt AS (SELECT group_id, k, replace({THINK_SQL}, chr(10) || chr(10), chr(10)) AS t FROM served),
mc AS (SELECT group_id, k, t, string_split({_MARK.replace('{x}', _MARK.replace('{x}', 't'))}, chr(10) || chr(1)) AS c FROM mt),
ml AS (SELECT group_id, k, string_split(regexp_replace(t, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS b FROM mc WHERE len(c) < 2),
ms AS (SELECT *, length(t) + CASE WHEN i = 1 THEN 1 ELSE 0 END AS w FROM (SELECT group_id, k, unnest(b) AS t, unnest(range(1, len(b) + 1)) AS i FROM ml)),
mk AS ({packed_sql('ms', 'group_id, k', 'f.size + p.w <= 200').replace('THEN f.size + p.w ELSE', 'THEN f.size + p.w + 1 ELSE')}),
mp AS (SELECT group_id, k, unnest(c) AS p, unnest(range(1, len(c) + 1)) AS i FROM mc WHERE len(c) >= 2
 UNION ALL SELECT group_id, k, string_agg(t, ' ' ORDER BY i), chunk FROM ms JOIN mk USING (group_id, k, i) GROUP BY group_id, k, chunk)
SELECT group_id, k, CAST(row_number() OVER (PARTITION BY group_id, k ORDER BY i) - 1 AS INT) AS step, {st('p')} AS text FROM mp WHERE length({st('p')}) > 15"""


@query("tr_split_markers", "served", MARKER_SQL)
def tr_split_markers(spark, sf):
    text = G.thinking_text(F.col("content"), F.col("reasoning_content"))
    rows = view(spark, sf, "served").select("group_id", "k", text.alias("t"))
    rows = G.split_by_markers(rows, "t", "p")
    return explode_items(rows, ["group_id", "k"], F.col("p"), "step", "text")


@query(
    "tr_cum_prefix",
    "lines",
    """, s AS (SELECT group_id, k, concat('step ', CAST(k AS VARCHAR), ': item ', CAST(l_partkey AS VARCHAR)) AS text FROM lines)
SELECT group_id, k, length(p) - length(text) AS start, length(p) AS prefix_chars FROM (SELECT group_id, k, text, string_agg(text, chr(10)) OVER (PARTITION BY group_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM s)""",
)
def tr_cum_prefix(spark, sf):
    text = F.concat(F.lit("step "), F.col("k").cast("string"), F.lit(": item "), F.col("l_partkey").cast("string"))
    steps = view(spark, sf, "lines").select("group_id", "k", text.alias("text"))
    return G.cumulative_prefix(steps, ["group_id"], "k", "text").select("group_id", "k", "start", "prefix_chars")


LINES_SQL = f""", ln AS (SELECT doc_id, source, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {st('x')}), lambda x: x <> '')) AS step_text FROM documents),
sp AS (SELECT doc_id, source, {WORDS('step_text')} AS len, regexp_matches(step_text, '[.!?]$') AS terminal FROM ln),
tr AS (SELECT d.doc_id, d.source, count(s.len) AS n_steps FROM documents d LEFT JOIN sp s ON d.doc_id = s.doc_id GROUP BY d.doc_id, d.source)"""


def summary_sql(source: str, col: str, name: str, where: str = "TRUE") -> str:
    cuts = ", ".join(f"{r6(f'quantile_cont({col}, {q})')} AS {name}_{p}" for p, q in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9)))
    return f"SELECT source, count(*) AS {name}_n, min({col}) AS {name}_min, max({col}) AS {name}_max, {cuts} FROM {source} WHERE {where} GROUP BY source"


def doc_steps(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    steps = G.trace_lines(docs, ["doc_id", "source"], "text")
    counts = docs.select("doc_id", "source", F.size(G.lines_of(F.col("text"))).cast("bigint").alias("n_steps"))
    return counts, steps.withColumn("len", F.col("len").cast("bigint"))


@query(
    "tr_step_stats",
    "documents",
    LINES_SQL
    + f", a AS ({summary_sql('sp', 'len', 'len')}), b AS ({summary_sql('tr', 'n_steps', 'steps', 'n_steps > 0')}) SELECT * FROM a JOIN b USING (source)",
)
def tr_step_stats(spark, sf):
    traces, steps = doc_steps(spark, sf)
    a = G.length_summary(steps, ["source"], "len", "len")
    return a.join(G.length_summary(traces.where("n_steps > 0"), ["source"], "n_steps", "steps"), "source")


@query(
    "tr_quality_gates",
    "documents",
    LINES_SQL
    + f""", a AS ({summary_sql('sp', 'len', 'len')}), b AS ({summary_sql('tr', 'n_steps', 'steps', 'n_steps > 0')}),
c AS (SELECT source, {r6('avg(CASE WHEN terminal THEN 1.0 ELSE 0.0 END)')} AS terminal_rate, {r6('avg(CASE WHEN len < 30 THEN 1.0 ELSE 0.0 END)')} AS tiny_rate FROM sp GROUP BY source),
d AS (SELECT source, {r6('avg(CASE WHEN n_steps <= 1 THEN 1.0 ELSE 0.0 END)')} AS single_rate FROM tr GROUP BY source),
g AS (SELECT source, len_p50, len_p90, steps_p50, terminal_rate, tiny_rate, single_rate, CAST(len_p50 BETWEEN 150 AND 500 AS INT) + CAST(len_p90 <= 700 AS INT) + CAST(steps_p50 BETWEEN 3 AND 12 AS INT)
 + CAST(terminal_rate >= 0.75 AS INT) + CAST(tiny_rate <= 0.1 AS INT) + CAST(single_rate <= 0.15 AS INT) AS passed FROM a JOIN b USING (source) JOIN c USING (source) JOIN d USING (source))
SELECT *, CASE WHEN passed = 6 THEN 'PASS' WHEN passed >= 4 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict FROM g""",
)
def tr_quality_gates(spark, sf):
    traces, steps = doc_steps(spark, sf)
    return G.quality_gates(traces, steps, ["source"])


@query(
    "tr_outliers",
    "documents",
    LINES_SQL + " SELECT doc_id, source, n_steps FROM tr WHERE n_steps > 50",
)
def tr_outliers(spark, sf):
    traces, _ = doc_steps(spark, sf)
    return traces.where("n_steps > 50")


PILOT = 400


@query(
    "tr_pilot_select",
    "documents",
    LINES_SQL
    + f""", p AS (SELECT *, row_number() OVER (ORDER BY doc_id) <= {PILOT} AS picked FROM tr WHERE n_steps > 0)
SELECT source, count(*) FILTER (WHERE picked) AS n_picked, count(*) FILTER (WHERE NOT picked) AS n_left, CAST(coalesce(sum(n_steps) FILTER (WHERE picked), 0) AS BIGINT) AS n_steps,
 CAST(coalesce(sum(n_steps) FILTER (WHERE picked), 0) * 8 AS BIGINT) AS n_continuations FROM p GROUP BY source""",
)
def tr_pilot_select(spark, sf):
    traces, _ = doc_steps(spark, sf)
    return G.pilot(traces, "doc_id", ["source"], PILOT)


@query(
    "tr_align_ids",
    "documents",
    """SELECT source, count(*) AS n_wanted, count(l.doc_id) AS n_kept, count(*) - count(l.doc_id) AS n_missing, CAST(coalesce(sum(CASE WHEN l.doc_id IS NOT NULL THEN n_chars END), 0) AS BIGINT) AS kept_chars
 FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
)
def tr_align_ids(spark, sf):
    ids = table(spark, sf, "labels").select("doc_id").distinct().withColumn("kept", F.lit(True))
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(ids, "doc_id", "left")
    return docs.withColumn("kept", F.coalesce("kept", F.lit(False))).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_wanted"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(~F.col("kept")).alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n_chars"))), F.lit(0)).alias("kept_chars"),
    )


# The annotated step's type, by the language of its document.
STEP_TYPES = {"en": "perception", "fr": "arithmetic", "de": "comparison", "es": "conclusion"}
STEP_TYPE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in STEP_TYPES.items()) + " END"


@query(
    "tr_annotation_report",
    ("documents", "labels"),
    f""", a AS (SELECT source, lang, quality = 1 AS coherent, CASE WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END AS failure, {STEP_TYPE} AS step_type FROM labels JOIN documents USING (doc_id))
SELECT coalesce(source, 'ALL') AS source, count(*) AS n, count(*) FILTER (WHERE coherent) AS n_coherent, {r6('avg(CASE WHEN coherent THEN 1.0 ELSE 0.0 END)')} AS coherent_rate,
 {", ".join(f"count(*) FILTER (WHERE step_type = '{t}') AS n_{t}" for t in STEP_TYPES.values())},
 count(*) FILTER (WHERE failure = 'toxic') AS n_toxic, count(*) FILTER (WHERE failure = 'low_quality') AS n_low_quality,
 CASE WHEN avg(CASE WHEN coherent THEN 1.0 ELSE 0.0 END) >= 0.85 THEN 'PASS' WHEN avg(CASE WHEN coherent THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'CONDITIONAL' ELSE 'FAIL' END AS decision
 FROM a GROUP BY ROLLUP (source)""",
)
def tr_annotation_report(spark, sf):
    notes = table(spark, sf, "labels").join(table(spark, sf, "documents").selectExpr("doc_id", "source", f"{STEP_TYPE} AS step_type"), "doc_id")
    good = F.col("quality") == 1
    rate = F.avg(good.cast("double"))
    return (
        notes.rollup("source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(good).alias("n_coherent"),
            F.round(rate, 6).alias("coherent_rate"),
            *[F.count_if(F.col("step_type") == t).alias(f"n_{t}") for t in STEP_TYPES.values()],
            F.count_if(~good & (F.col("toxic") == 1)).alias("n_toxic"),
            F.count_if(~good & (F.col("toxic") != 1)).alias("n_low_quality"),
            F.when(rate >= 0.85, "PASS").when(rate >= 0.75, "CONDITIONAL").otherwise("FAIL").alias("decision"),
        )
        .withColumn("source", F.coalesce("source", F.lit("ALL")))
    )
