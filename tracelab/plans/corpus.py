"""Queries on corpus preparation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import scoring as S
from tracelab.functions.text import FLOAT_PATTERN, strip, sub, think_words, to_number
from tracelab.functions.extract import train
from tracelab.operators import corpus as K
from tracelab.operators import qagen as Q
from tracelab.operators.scale import over_all, ranked_histogram
from tracelab.plans.answers import MC_SQL, SCORE_SQL, norm_sql, train_sql
from tracelab.plans.process import WORDS, span_sql
from tracelab.plans.registry import query, r6
from tracelab.plans.sqltext import nest, num, st
from tracelab.plans.sqltext import sub as sub_sql
from tracelab.sources.fixtures import table, view
from tracelab.session import checkpoint, fresh_folder
from tracelab.sources.readers import append_resume, listed_files, read_jsonl, write_by_status, write_report

PLANT = "CASE WHEN vec_id % 10 = 1 AND i < vec_id % 7 THEN 1 - bit ELSE bit END"


def fingerprints(spark, sf):
    """Train and test fingerprints from vector signs; the test side has planted near copies."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    train_side = vectors.where("vec_id % 5 <> 0").select("vec_id", *[c.alias(n) for n, c in K.sign_blocks(F.col("embedding")).items()])
    flip = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 10 == 1) & (i < F.col("vec_id") % 7), F.when(x > 0, -1.0).otherwise(1.0)).otherwise(x.cast("double")))
    test_side = vectors.where("vec_id % 5 = 0 OR vec_id % 10 = 1").withColumn("e", flip)
    test_side = test_side.select("vec_id", *[c.alias(n) for n, c in K.sign_blocks(F.col("e")).items()])
    return train_side, test_side


@query(
    "cp_contamination",
    (),
    f""", u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, i, CASE WHEN x > 0 THEN 1 ELSE 0 END AS bit FROM u),
tr AS (SELECT vec_id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY i) AS s FROM b WHERE vec_id % 5 <> 0 GROUP BY vec_id),
te AS (SELECT vec_id, string_agg(CAST({PLANT} AS VARCHAR), '' ORDER BY i) AS s FROM b WHERE vec_id % 5 = 0 OR vec_id % 10 = 1 GROUP BY vec_id),
d AS (SELECT tr.vec_id, hamming(tr.s, te.s) AS distance FROM tr, te WHERE hamming(tr.s, te.s) < 5),
m AS (SELECT vec_id, min(distance) AS distance, count(*) AS n_test FROM d GROUP BY vec_id)
SELECT tr.vec_id, m.vec_id IS NOT NULL AS contaminated, CAST(m.distance AS INT) AS distance, m.n_test FROM tr LEFT JOIN m USING (vec_id)""",
)
def cp_contamination(spark, sf):
    train_side, test_side = fingerprints(spark, sf)
    near = K.near_fingerprints(train_side, test_side)
    return train_side.join(near, K.NAMES, "left").select(
        "vec_id", F.col("distance").isNotNull().alias("contaminated"), F.col("distance").cast("int").alias("distance"), "n_test"
    )


PAIR_SQL = f""", u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, i, CASE WHEN x > 0 THEN 1 ELSE 0 END AS bit FROM u),
tr AS (SELECT vec_id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY i) AS s FROM b WHERE vec_id % 5 <> 0 GROUP BY vec_id),
te AS (SELECT vec_id, string_agg(CAST({PLANT} AS VARCHAR), '' ORDER BY i) AS s FROM b WHERE vec_id % 5 = 0 OR vec_id % 10 = 1 GROUP BY vec_id),
ca AS (SELECT s, min(vec_id) AS train_class, count(*) AS n_train FROM tr GROUP BY s), cb AS (SELECT s, min(vec_id) AS test_class, count(*) AS n_test FROM te GROUP BY s)"""


@query(
    "cp_contamination_pairs",
    (),
    PAIR_SQL + " SELECT train_class, test_class, CAST(hamming(ca.s, cb.s) AS INT) AS distance, n_train, n_test, n_train * n_test AS n_links FROM ca, cb WHERE hamming(ca.s, cb.s) < 5",
)
def cp_contamination_pairs(spark, sf):
    """Near pairs of classes of equal fingerprints with the number of item pairs each stands for; see cp_contamination_members."""
    train_side, test_side = fingerprints(spark, sf)
    pairs = K.near_pairs(K.fingerprint_classes(train_side, "vec_id", "train"), K.fingerprint_classes(test_side, "vec_id", "test"))
    return pairs.select("train_class", "test_class", F.col("distance").cast("int").alias("distance"), "n_train", "n_test", (F.col("n_train") * F.col("n_test")).alias("n_links"))


@query(
    "cp_contamination_members",
    (),
    PAIR_SQL + " SELECT 'train' AS side, vec_id, train_class AS class FROM tr JOIN ca USING (s) UNION ALL SELECT 'test', vec_id, test_class FROM te JOIN cb USING (s)",
)
def cp_contamination_members(spark, sf):
    """Class of every train and test item."""
    sides = [K.class_members(items, "vec_id", name).select(F.lit(name).alias("side"), "vec_id", F.col(f"{name}_class").alias("class")) for items, name in zip(fingerprints(spark, sf), ("train", "test"))]
    return sides[0].unionByName(sides[1])


def simhash_sql(source: str, key: str) -> str:
    """64-bit simhash as a bit string, from the first 64 bits of each word's md5."""
    bits = ", ".join(f"CASE WHEN sum(CASE WHEN (h{i // 32} >> {i % 32}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN '1' ELSE '0' END" for i in range(64))
    half = lambda i: f"CAST('0x' || substr(md5(w), {8 * i + 1}, 8) AS BIGINT) AS h{i}"
    words = f"SELECT {key}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}"
    return f"SELECT {key}, concat({bits}) AS s FROM (SELECT {key}, {half(0)}, {half(1)} FROM ({words}) WHERE w <> '') GROUP BY {key}"


@query(
    "cp_contamination_text",
    ("documents", "benchmark"),
    f""", tr AS ({simhash_sql('documents', 'doc_id')}), te AS ({simhash_sql('benchmark', 'item_id')}),
m AS (SELECT doc_id, min(hamming(tr.s, te.s)) AS distance, count(*) AS n_test FROM tr, te WHERE hamming(tr.s, te.s) < 5 GROUP BY doc_id)
SELECT d.doc_id, m.doc_id IS NOT NULL AS contaminated, CAST(m.distance AS INT) AS distance, m.n_test FROM documents d LEFT JOIN m USING (doc_id)""",
)
def cp_contamination_text(spark, sf):
    # six small numbers a document, asked for twice: written once, so that the words are counted once
    docs = checkpoint(K.simhash_bits(table(spark, sf, "documents"), "doc_id", "text"))
    items = K.simhash_bits(table(spark, sf, "benchmark"), "item_id", "text")
    near = K.near_fingerprints(docs, items)
    hits = docs.join(near, K.NAMES).select("doc_id", "distance", "n_test")
    # documents without a word have no fingerprint and stay clean
    return table(spark, sf, "documents").select("doc_id").join(hits, "doc_id", "left").select(
        "doc_id", F.col("distance").isNotNull().alias("contaminated"), F.col("distance").cast("int").alias("distance"), "n_test"
    )


@query(
    "cp_pool_filter",
    "documents",
    f"""SELECT source, count(*) AS n_all, count(*) FILTER (WHERE w >= 8) AS n_long, count(*) FILTER (WHERE lang = 'en') AS n_type, count(*) FILTER (WHERE w >= 8 AND lang = 'en') AS n_kept
 FROM (SELECT source, lang, {WORDS("text")} AS w FROM documents) GROUP BY source""",
)
def cp_pool_filter(spark, sf):
    from tracelab.functions.text import words

    rows = table(spark, sf, "documents").select("source", "lang", words(F.col("text")).alias("w"))
    long, kind = F.col("w") >= 8, F.col("lang") == "en"
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(long).alias("n_long"),
        F.count_if(kind).alias("n_type"),
        F.count_if(long & kind).alias("n_kept"),
    )


@query(
    "cp_stratified_sample",
    "documents",
    "SELECT source, doc_id, CAST(rn AS INT) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 20",
)
def cp_stratified_sample(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id")
    return K.stratified_sample(rows, "source", "doc_id", 20)


REASON_SQL = "CASE WHEN coalesce(image_path, '') = '' THEN 'missing_image' WHEN coalesce(question, '') = '' OR answer IS NULL THEN 'missing_qa' ELSE 'kept' END"


# The distilled records as JSON: reasoning is a list of lines, one text, null, or missing.
RECORD = """concat('{"source": "', source, '"', CASE doc_id % 4 WHEN 0 THEN concat(', "reasoning_steps": ', to_json(split(text, '\\n')))
 WHEN 1 THEN concat(', "reasoning_steps": ', substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)) WHEN 2 THEN ', "reasoning_steps": null' ELSE '' END, '}')"""
SOURCES = ["src0", "src1", "src2", "src3", "src4", "src5"]


@query(
    "cp_sft_filter",
    "documents",
    f""", l AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'x' END AS image_path, text AS question, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars END AS answer,
 CASE doc_id % 4 WHEN 0 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) WHEN 1 THEN text ELSE '' END AS reasoning FROM documents),
r AS (SELECT *, CASE WHEN source NOT IN ({', '.join(f"'{x}'" for x in SOURCES)}) OR source IS NULL THEN 'filtered_source' ELSE {REASON_SQL} END AS reason FROM l)
SELECT source, reason, count(*) AS n, count(*) FILTER (WHERE reasoning <> '') AS n_reasoned, {r6("avg(CASE WHEN reasoning <> '' THEN 1.0 ELSE 0.0 END)")} AS with_reasoning,
 CAST(sum(length(reasoning)) AS BIGINT) AS reasoning_chars, md5(max(reasoning)) AS top FROM r GROUP BY source, reason""",
)
def cp_sft_filter(spark, sf):
    records = table(spark, sf, "documents").select("doc_id", F.expr(RECORD).alias("record"))
    reasoning = K.reasoning_text(F.try_variant_get(F.try_parse_json("record"), "$.reasoning_steps", "variant"))
    records = records.select("doc_id", reasoning.alias("reasoning"))
    rows = view(spark, sf, "corpus_lite").join(records, "doc_id")
    reason = K.sft_reason(F.col("image_path"), F.col("question"), F.col("answer").cast("string"), F.col("source"), SOURCES)
    said = F.col("reasoning") != ""
    return rows.groupBy("source", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(said).alias("n_reasoned"),
        F.round(F.avg(said.cast("double")), 6).alias("with_reasoning"),
        F.sum(F.length("reasoning")).cast("bigint").alias("reasoning_chars"),
        F.md5(F.max("reasoning")).alias("top"),
    )


TEACHER_FIELDS = ["teacher_reasoning_len", "format_family", "teacher_pred", "teacher_match", "teacher_finish_reason"]


@query(
    "cp_distill_override",
    ("corpus_lite", "corpus_distilled"),
    """, l AS (SELECT * FROM corpus_distilled QUALIFY row_number() OVER (PARTITION BY image_path, question_md5 ORDER BY doc_id DESC) = 1)
SELECT c.doc_id, c.source, l.doc_id IS NOT NULL AS overridden, l.teacher_reasoning_len, l.format_family, l.teacher_pred, l.teacher_match, l.teacher_finish_reason
FROM corpus_lite c LEFT JOIN l ON c.image_path = l.image_path AND c.question_md5 = l.question_md5""",
)
def cp_distill_override(spark, sf):
    rows = K.override(
        view(spark, sf, "corpus_lite"), view(spark, sf, "corpus_distilled"), ["image_path", "question_md5"], "doc_id", TEACHER_FIELDS
    )
    return rows.select("doc_id", "source", "overridden", *TEACHER_FIELDS)


@query(
    "cp_override_counts",
    ("corpus_lite", "corpus_distilled"),
    """, l AS (SELECT * FROM corpus_distilled QUALIFY row_number() OVER (PARTITION BY image_path, question_md5 ORDER BY doc_id DESC) = 1)
SELECT c.source, count(*) AS n, count(l.doc_id) AS n_override, count(*) - count(l.doc_id) AS n_fallback, count(*) FILTER (WHERE teacher_match) AS n_match, count(*) FILTER (WHERE teacher_finish_reason = 'length') AS n_cut
FROM corpus_lite c LEFT JOIN l ON c.image_path = l.image_path AND c.question_md5 = l.question_md5 GROUP BY c.source""",
)
def cp_override_counts(spark, sf):
    """How many rows took the teacher's fields and how many fell back to their own."""
    return cp_distill_override(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("overridden").alias("n_override"),
        F.count_if(~F.col("overridden")).alias("n_fallback"),
        F.count_if("teacher_match").alias("n_match"),
        F.count_if(F.col("teacher_finish_reason") == "length").alias("n_cut"),
    )


@query(
    "cp_retry_join",
    ("documents", "labels"),
    """, f AS (SELECT doc_id * 2 AS source_index, quality, toxic FROM labels WHERE quality = 0)
SELECT source_index, coalesce(source, 'orphan') AS source, lang, n_chars, quality, toxic, d.doc_id IS NOT NULL AS matched FROM f LEFT JOIN documents d ON d.doc_id = f.source_index""",
)
def cp_retry_join(spark, sf):
    failed = table(spark, sf, "labels").where("quality = 0").selectExpr("doc_id * 2 AS source_index", "quality", "toxic")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_index"), "source", "lang", "n_chars", F.lit(True).alias("found"))
    return failed.join(docs, "source_index", "left").select(
        "source_index",
        F.coalesce("source", F.lit("orphan")).alias("source"),
        "lang", "n_chars", "quality", "toxic",
        F.col("found").isNotNull().alias("matched"),
    )


@query(
    "cp_teacher_match",
    "answer_pairs",
    f"SELECT bench, form, count(*) AS n, count(*) FILTER (WHERE {st('pred')} = '') AS n_dropped, count(*) FILTER (WHERE {st('pred')} <> '' AND {MC_SQL}) AS n_match FROM "
    + nest("answer_pairs", [("p", norm_sql("pred")), ("g", norm_sql("gold")), ("pn", num(st(sub_sql("p", "[,%$]")))), ("gn", num(st(sub_sql("g", "[,%$]"))))])
    + " GROUP BY bench, form",
)
def cp_teacher_match(spark, sf):
    rows = view(spark, sf, "answer_pairs")
    rows = rows.withColumn("score", S.multichoice_match(F.col("pred"), F.col("gold"), F.col("bench") == "bench_a"))
    empty = strip(F.col("pred")) == ""
    return rows.groupBy("bench", "form").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(empty).alias("n_dropped"),
        F.count_if(~empty & (F.col("score") == 1)).alias("n_match"),
    )


FAMILY = "CASE CAST(substring(source, 4) AS INT) % 3 WHEN 0 THEN 'chartqa' WHEN 1 THEN 'charxiv' ELSE 'chartmuseum' END"
KIND = "CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'numeric' ELSE 'multichoice' END"
DISTILLED = [
    "doc_id", "source", f"{FAMILY} AS family", f"{KIND} AS kind", "n_chars", "text AS answer", "doc_id % 3 <> 0 AS matched",
]
RULE_SQL = """CASE WHEN n_chars < 150 THEN 'R1_reasoning_too_short' WHEN family = 'chartmuseum' AND length(answer) > 200 THEN 'R2_answer_body_long'
 WHEN family = 'chartmuseum' AND contains(answer, chr(10)) THEN 'R3_answer_body_multiline' WHEN kind = 'numeric' AND NOT matched THEN 'R4a_numeric_mismatch'
 WHEN kind = 'multichoice' AND NOT matched THEN 'R4b_choice_mismatch' ELSE 'kept' END"""


def distilled(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(*DISTILLED)
    rule = K.quality_rule(*[F.col(c) for c in ("family", "n_chars", "answer", "kind", "matched")])
    return rows.withColumn("rule", rule)


DIST_SQL = f", ds AS (SELECT {', '.join(DISTILLED)} FROM documents), dr AS (SELECT *, {RULE_SQL} AS rule FROM ds)"


@query("cp_quality_rules", "documents", DIST_SQL + " SELECT family, rule, count(*) AS n FROM dr GROUP BY family, rule")
def cp_quality_rules(spark, sf):
    return distilled(spark, sf).groupBy("family", "rule").agg(F.count(F.lit(1)).alias("n"))


# Reasons to drop a row on the way to the lite corpus, and from the distilled one.
LITE_DROPS = ["missing_image", "missing_qa"]
RULE_DROPS = ["R1_reasoning_too_short", "R2_answer_body_long", "R3_answer_body_multiline", "R4a_numeric_mismatch", "R4b_choice_mismatch"]


@query(
    "cp_funnel",
    ("documents", "corpus_lite"),
    DIST_SQL
    + f""", a AS (SELECT family, count(*) AS n_raw FROM ds GROUP BY family), b AS (SELECT {FAMILY} AS family, count(*) AS n_lite FROM corpus_lite WHERE {REASON_SQL} = 'kept' GROUP BY 1),
c AS (SELECT family, count(*) AS n_kept FROM dr WHERE rule = 'kept' GROUP BY family),
e AS (SELECT {FAMILY} AS family, {", ".join(f"count(*) FILTER (WHERE {REASON_SQL} = '{x}') AS n_{x}" for x in LITE_DROPS)} FROM corpus_lite GROUP BY 1),
q AS (SELECT family, {", ".join(f"count(*) FILTER (WHERE rule = '{x}') AS n_{x.lower()}" for x in RULE_DROPS)} FROM dr GROUP BY family),
j AS (SELECT coalesce(a.family, b.family, c.family) AS family, coalesce(n_raw, 0) AS n_raw, coalesce(n_lite, 0) AS n_lite, coalesce(n_kept, 0) AS n_kept, {", ".join(f"coalesce(n_{x.lower()}, 0) AS n_{x.lower()}" for x in [*LITE_DROPS, *RULE_DROPS])}
 FROM a FULL JOIN b ON a.family = b.family FULL JOIN c ON a.family = c.family LEFT JOIN e ON e.family = coalesce(a.family, b.family, c.family) LEFT JOIN q ON q.family = coalesce(a.family, b.family, c.family))
SELECT *, {r6('100.0 * n_raw / sum(n_raw) OVER ()')} AS raw_pct, {r6('100.0 * n_kept / sum(n_kept) OVER ()')} AS kept_pct, {r6('100.0 * n_kept / sum(n_kept) OVER () - 100.0 * n_raw / sum(n_raw) OVER ()')} AS delta_pct FROM j""",
)
def cp_funnel(spark, sf):
    rows = distilled(spark, sf)
    lite = view(spark, sf, "corpus_lite").withColumn("family", F.expr(FAMILY))
    kept_lite = lite.where(K.sft_reason(F.col("image_path"), F.col("question"), F.col("answer").cast("string")) == "kept")
    count = lambda df, name: df.groupBy("family").agg(F.count(F.lit(1)).alias(name))
    stages = count(rows, "n_raw").join(count(kept_lite, "n_lite"), "family", "full").join(
        count(rows.where("rule = 'kept'"), "n_kept"), "family", "full"
    )
    reason = K.sft_reason(F.col("image_path"), F.col("question"), F.col("answer").cast("string"))
    dropped = lambda df, why, names: df.groupBy("family").agg(*[F.count_if(why == x).alias(f"n_{x.lower()}") for x in names])
    stages = stages.join(dropped(lite, reason, LITE_DROPS), "family", "left").join(dropped(rows, F.col("rule"), RULE_DROPS), "family", "left")
    stages = stages.na.fill(0)
    raw, kept = 100.0 * F.col("n_raw") / over_all("n_raw"), 100.0 * F.col("n_kept") / over_all("n_kept")
    return stages.select(
        "family", "n_raw", "n_lite", "n_kept", *[f"n_{x.lower()}" for x in [*LITE_DROPS, *RULE_DROPS]],
        F.round(raw, 6).alias("raw_pct"), F.round(kept, 6).alias("kept_pct"), F.round(kept - raw, 6).alias("delta_pct"),
    )


POINTS = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


@query(
    "cp_length_percentiles",
    "documents",
    """, s AS (SELECT n_chars // 4 AS len FROM documents),
r AS (SELECT len, row_number() OVER (ORDER BY len) AS rn, count(*) OVER () AS n FROM s)
SELECT max(n) AS n_docs, """
    + ", ".join(f"max(CASE WHEN rn = CAST(floor(n * {q}) AS BIGINT) + 1 THEN len END) AS {p}" for p, q in POINTS.items())
    + ", max(len) AS max_len FROM r",
)
def cp_length_percentiles(spark, sf):
    lengths = table(spark, sf, "documents").select(F.lit(1).alias("all"), F.floor(F.col("n_chars") / 4).cast("bigint").alias("len"))
    ranked = ranked_histogram(lengths, ["all"], "len", {"n": F.count(F.lit(1))})
    at = lambda q: F.floor(F.col("total_n") * q)
    holds = lambda q: (F.col("below_n") <= at(q)) & (at(q) < F.col("below_n") + F.col("n"))
    return ranked.agg(
        F.max("total_n").cast("bigint").alias("n_docs"), *[F.max(F.when(holds(q), F.col("len"))).alias(p) for p, q in POINTS.items()], F.max("len").alias("max_len")
    )


RENDER = [
    "doc_id", f"{FAMILY} AS family", f"{KIND} AS kind", "concat('Question ', CAST(doc_id AS STRING), '?') AS question",
    "CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN concat(CAST(n_chars AS STRING), '.25') ELSE 'a word' END AS answer",
    "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS reasoning",
]
HINT_SQL = "CASE WHEN regexp_matches(answer, '^-?[0-9]*\\.[0-9]+$') THEN concat('* Your final answer must be a number with ', CAST(length(split_part(answer, '.', 2)) AS VARCHAR), ' decimal places.') ELSE '* Your final answer must be a number.' END"
USER_SQL = f"""CASE WHEN family = 'chartqa' THEN concat(question, chr(10), 'Answer the question with a single word.')
 WHEN family = 'charxiv' AND (kind = 'numeric' OR regexp_matches(answer, '^-?[0-9,.\\s%]+$')) THEN concat(question, chr(10), {HINT_SQL})
 WHEN family = 'charxiv' THEN concat(question, chr(10), '* Answer in the words of the chart.')
 ELSE concat('Think first, then answer in tags.', chr(10), question, CASE WHEN kind = 'multichoice' THEN concat(chr(10), 'Answer with the value or name of the chosen option.') ELSE '' END) END"""
ASSIST_SQL = f"concat('<think>', chr(10), {st('reasoning')}, chr(10), '</think>', chr(10), CASE WHEN family = 'chartmuseum' THEN concat('<answer>', answer, '</answer>') ELSE answer END)"
RENDER_SQL = f", rd AS (SELECT {', '.join(RENDER)} FROM documents)"


def rendered(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(*RENDER)
    q, f, a, k = (F.col(c) for c in ("question", "family", "answer", "kind"))
    return rows.withColumns({"user_text": K.user_text(q, f, a, k), "assistant": K.assistant_text(F.col("reasoning"), f, a)})


@query("cp_family_prompt", "documents", RENDER_SQL + f" SELECT doc_id, family, {USER_SQL} AS user_text FROM rd")
def cp_family_prompt(spark, sf):
    return rendered(spark, sf).select("doc_id", "family", "user_text")


@query("cp_assistant_text", "documents", RENDER_SQL + f" SELECT doc_id, family, length({ASSIST_SQL}) AS chars, md5({ASSIST_SQL}) AS text_md5 FROM rd")
def cp_assistant_text(spark, sf):
    rows = rendered(spark, sf)
    return rows.select("doc_id", "family", F.length("assistant").cast("bigint").alias("chars"), F.md5("assistant").alias("text_md5"))


@query(
    "cp_messages",
    "documents",
    RENDER_SQL
    + f""", m AS (SELECT doc_id, unnest(['user', 'assistant']) AS role, unnest([{USER_SQL}, {ASSIST_SQL}]) AS content FROM rd WHERE reasoning <> '')
SELECT doc_id, role, md5(content) AS content_md5 FROM m""",
)
def cp_messages(spark, sf):
    # rows without reasoning are rejected
    rows = rendered(spark, sf).where("reasoning <> ''")
    rows = rows.select("doc_id", F.explode(K.messages(F.col("user_text"), F.col("assistant"))).alias("m"))
    return rows.select("doc_id", "m.role", F.md5("m.content").alias("content_md5"))


@query(
    "cp_difficulty_filter",
    "rollouts",
    f"""SELECT group_id, count(*) AS n_attempts, {r6('avg(coalesce(outcome, 0))')} AS accuracy FROM rollouts GROUP BY group_id
 HAVING round(avg(coalesce(outcome, 0)), 6) BETWEEN 0.3 AND 0.7""",
)
def cp_difficulty_filter(spark, sf):
    right = F.coalesce("outcome", F.lit(0))
    per = view(spark, sf, "rollouts").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.round(F.avg(right), 6).alias("accuracy")
    )
    return per.where(F.col("accuracy").between(0.3, 0.7))


SELECT_SQL = f""", pr AS (SELECT group_id, k, gold, response, pred FROM {train_sql('responses')}),
c AS (SELECT group_id, k, {SCORE_SQL['cerm']} >= 0.95 AND CASE WHEN contains(response, '</think>') THEN {WORDS(span_sql())} ELSE 0 END BETWEEN 30 AND 1500 AS good FROM pr),
sl AS (SELECT group_id, count(*) AS n_candidates, count(*) FILTER (WHERE good) AS n_good, min(CASE WHEN good THEN k END) AS chosen FROM c GROUP BY group_id)"""


def selected(spark, sf):
    rows = train(view(spark, sf, "responses"))
    length = think_words(F.col("response"))
    good = (S.closeness(F.col("pred"), F.col("gold")) >= 0.95) & length.between(30, 1500)
    rows = rows.select("group_id", "k", good.alias("good"))
    return rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("good").alias("n_good"),
        F.min(F.when(F.col("good"), F.col("k"))).alias("chosen"),
    )


@query("cp_rejection_select", "responses", SELECT_SQL + " SELECT * FROM sl WHERE chosen IS NOT NULL")
def cp_rejection_select(spark, sf):
    return selected(spark, sf).where(F.col("chosen").isNotNull())


@query(
    "sink_success_failure_split",
    "responses",
    SELECT_SQL
    + " SELECT CASE WHEN chosen IS NULL THEN 'failure' ELSE 'success' END AS status, count(*) AS n_keys, CAST(sum(n_candidates) AS BIGINT) AS n_candidates, CAST(sum(n_good) AS BIGINT) AS n_good FROM sl GROUP BY 1",
)
def sink_success_failure_split(spark, sf):
    path = fresh_folder(spark)
    write_by_status(selected(spark, sf).withColumn("status", F.when(F.col("chosen").isNull(), "failure").otherwise("success")), path)
    return spark.read.parquet(path).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_candidates").alias("n_candidates"), F.sum("n_good").alias("n_good")
    )


@query(
    "cp_eligible_export",
    "documents",
    "SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS slug, source, concat('csv/', CAST(doc_id AS VARCHAR), '.csv') AS csv_path, concat('src/', source, '/', CAST(doc_id AS VARCHAR), '.png') AS image_path FROM documents WHERE lang IN ('fr', 'de')",
)
def cp_eligible_export(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("lang").isin("fr", "de"))
    key = F.col("doc_id").cast("string")
    return docs.select(
        F.concat(F.lit("doc_"), key).alias("slug"),
        "source",
        F.concat(F.lit("csv/"), key, F.lit(".csv")).alias("csv_path"),
        F.concat(F.lit("src/"), F.col("source"), F.lit("/"), key, F.lit(".png")).alias("image_path"),
    )


# ---- sources and sinks ----------------------------------------------------------------

JSON_LINE = "CASE event_id % 50 WHEN 0 THEN '  ' WHEN 1 THEN concat('{broken', props) ELSE props END"


@query(
    "src_jsonl_scan",
    "events",
    f""", l AS (SELECT event_type, {JSON_LINE} AS line FROM events)
SELECT event_type, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE trim(line) <> '' AND NOT json_valid(line)) AS n_broken, count(*) FILTER (WHERE json_valid(line)) AS n_rows,
 CAST(sum(CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.k') AS INT) END) AS BIGINT) AS sum_k FROM l GROUP BY event_type""",
)
def src_jsonl_scan(spark, sf):
    path = fresh_folder(spark)
    table(spark, sf, "events").select("event_type", F.expr(JSON_LINE).alias("line")).write.partitionBy("event_type").text(path)
    rows = read_jsonl(spark, path, "k int, event_type string", broken="broken")
    ok = F.col("broken").isNull()
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~ok).alias("n_broken"),
        F.count_if(ok).alias("n_rows"),
        F.sum(F.when(ok, F.col("k"))).cast("bigint").alias("sum_k"),
    )


IMAGE = "concat('img/', CAST({k} AS STRING), '.png')"
LISTED = "SELECT DISTINCT concat('img/', CAST(page_id AS STRING), '.png') AS image_path FROM pages"
MANIFESTS = [
    ("documents", "doc_id", "text", "CAST(n_chars AS STRING)", "chart_a", "relaxed_correctness"),
    ("benchmark", "item_id", "text", "CAST(length(text) AS STRING)", "chart_b", "charxiv_judge"),
    ("conversations", "conv_id", "concat(role, ' ', CAST(turn AS STRING))", "role", "chart_c", "chartmuseum_judge"),
]


def manifest_columns(k, question, gold, bench, scoring):
    return [
        f"concat('{bench}_', CAST({k} AS STRING)) AS sample_id", f"'{bench}' AS bench", f"{IMAGE.format(k=k)} AS image_path",
        f"{question} AS question", f"{gold} AS gold_answer", f"'{scoring}' AS scoring",
    ]


@query(
    "src_bench_manifest",
    (),
    ", u AS ("
    + " UNION ALL ".join(f"SELECT {', '.join(manifest_columns(*m[1:]))} FROM {m[0]}" for m in MANIFESTS)
    + f"), i AS ({LISTED}) SELECT u.* FROM u SEMI JOIN i USING (image_path)",
)
def src_bench_manifest(spark, sf):
    parts = [table(spark, sf, m[0]).selectExpr(*manifest_columns(*m[1:])) for m in MANIFESTS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # the images that exist: one file per page in the shared folder, in a folder of its own
    folder = fresh_folder(spark)
    table(spark, sf, "pages").selectExpr("page_id AS image", "url").write.partitionBy("image").text(folder)
    names = listed_files(spark, folder).select(F.regexp_extract("path", "/image=([^/]+)/", 1).alias("name"))
    listing = names.select(F.concat(F.lit("img/"), F.col("name"), F.lit(".png")).alias("image_path")).distinct()
    # rows whose image is missing from the listing are dropped
    return rows.join(listing, "image_path", "left_semi").select("sample_id", "bench", "image_path", "question", "gold_answer", "scoring")


KEYED = """concat('{"', CAST(doc_id AS STRING), '": {"query": "q', CAST(n_chars AS STRING), '", "answer": ', CAST(n_chars AS STRING), ', "inst_category": ', CAST(doc_id % 6 AS STRING), '}}')"""


@query(
    "src_keyed_manifest",
    "documents",
    f""", m AS (SELECT {KEYED} AS js FROM documents), e AS (SELECT json_keys(js)[1] AS key, js FROM m),
x AS (SELECT concat('charxiv_', key) AS sample_id, json_extract_string(js, concat('$."', key, '".query')) AS question, json_extract_string(js, concat('$."', key, '".answer')) AS gold_answer,
 CAST(json_extract_string(js, concat('$."', key, '".inst_category')) AS INT) AS inst_category FROM e) SELECT * FROM x WHERE inst_category BETWEEN 1 AND 4""",
)
def src_keyed_manifest(spark, sf):
    text = table(spark, sf, "documents").select(F.expr(KEYED).alias("js"))
    kind = "map<string, struct<query: string, answer: string, inst_category: int>>"
    rows = text.select(F.explode(F.from_json("js", kind)).alias("key", "v"))
    return rows.select(
        F.concat(F.lit("charxiv_"), F.col("key")).alias("sample_id"),
        F.col("v.query").alias("question"),
        F.col("v.answer").alias("gold_answer"),
        F.col("v.inst_category").alias("inst_category"),
    ).where(F.col("inst_category").between(1, 4))


@query("src_parquet_filter", "documents", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def src_parquet_filter(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")


RAW_CELL = """CASE col WHEN 'quantity' THEN CASE row_idx % 4 WHEN 0 THEN concat(CAST(CAST(value AS INT) AS STRING), '%') WHEN 1 THEN concat('$1,', CAST(CAST(100 + value AS INT) AS STRING)) WHEN 2 THEN 'n/a' ELSE CAST(CAST(value AS INT) AS STRING) END
 ELSE CAST(CAST(value AS INT) AS STRING) END"""


@query(
    "src_chart_cells",
    "chart_cells",
    f""", r AS (SELECT chart_id, {RAW_CELL} AS raw FROM chart_cells),
n AS (SELECT chart_id, {num('raw')} AS s, {num(st(sub_sql('raw', '[%$,]')))} AS l FROM r)
SELECT chart_id, count(DISTINCT s) AS n_strict, count(DISTINCT l) AS n_loose, {r6('sum(l)')} AS sum_loose FROM n GROUP BY chart_id""",
)
def src_chart_cells(spark, sf):
    raw = view(spark, sf, "chart_cells").select("chart_id", F.expr(RAW_CELL).alias("raw"))
    cells = raw.select("chart_id", to_number(F.col("raw")).alias("s"), to_number(strip(sub(F.col("raw"), "[%$,]"))).alias("l"))
    # distinct values with their weight first, so that a popular chart stays small
    sets = cells.groupBy("chart_id", "s", "l").agg(F.count(F.lit(1)).alias("w"))
    return sets.groupBy("chart_id").agg(
        F.countDistinct("s").alias("n_strict"),
        F.countDistinct("l").alias("n_loose"),
        F.round(F.sum(F.col("l") * F.col("w")), 6).alias("sum_loose"),
    )


PICK_CELL = "md5(concat_ws('|', CAST(chart_id AS VARCHAR), entity))"


# Lines of chart tables: every fourth chart is long (label, value), the others wide; some labels, heads and numbers are blank.
LABEL = "CASE WHEN l_partkey % 10 = 0 THEN '' ELSE concat('item ', CAST(l_partkey AS STRING)) END"
QUANTITY = "CASE WHEN qty % 7 = 0 THEN 'n/a' WHEN qty % 3 = 0 THEN concat(CAST(qty AS STRING), '%') ELSE CAST(qty AS STRING) END"
SECOND = "CASE WHEN group_id % 9 = 1 THEN ' ' ELSE 'discount_pct' END"


@query(
    "src_entity_melt",
    "lines",
    f""", c AS (SELECT group_id AS chart_id, group_id % 4 = 0 AS long, {LABEL} AS label, 'quantity' AS head, {QUANTITY} AS raw FROM lines
 UNION ALL SELECT group_id, FALSE, {LABEL}, trim({SECOND}), CAST(disc AS VARCHAR) FROM lines WHERE group_id % 4 <> 0),
e AS (SELECT chart_id, CASE WHEN long OR head = '' THEN label WHEN label = '' THEN head ELSE concat(label, ' (', head, ')') END AS entity, {num(st(sub_sql('raw', '[%$,]')))} AS value FROM c)
SELECT chart_id, entity, value, {PICK_CELL} AS pick FROM e WHERE value IS NOT NULL AND entity <> ''""",
)
def src_entity_melt(spark, sf):
    lines = view(spark, sf, "lines")
    long = F.col("group_id") % 4 == 0
    pair = lambda a, b, c: F.when(long, F.array(a, b)).otherwise(F.array(a, b, c))
    body = lines.select(F.col("group_id").alias("chart_id"), (F.col("k") + 1).alias("line"), pair(F.expr(LABEL), F.expr(QUANTITY), F.col("disc").cast("string")).alias("fields"))
    head = lines.where("k = 0").select(F.col("group_id").alias("chart_id"), F.lit(0).alias("line"), pair(F.lit("label"), F.lit("quantity"), F.expr(SECOND)).alias("fields"))
    rows = K.entity_pairs(head.unionByName(body), "chart_id", "line", "fields", lambda raw: to_number(strip(sub(raw, "[%$,]"))))
    # ``pick`` orders the cells of a chart for whoever wants only some of them
    return rows.withColumn("pick", Q.pick_key(F.col("chart_id").cast("string"), F.col("entity"))).select("chart_id", "entity", "value", "pick")


@query(
    "src_numeric_cell_count",
    "chart_cells",
    f", r AS (SELECT chart_id, {RAW_CELL} AS raw FROM chart_cells) SELECT chart_id, count(*) AS n_cells, count({num('raw')}) AS n_numeric FROM r GROUP BY chart_id HAVING count({num('raw')}) >= 4",
)
def src_numeric_cell_count(spark, sf):
    raw = view(spark, sf, "chart_cells").select("chart_id", to_number(F.expr(RAW_CELL)).alias("v"))
    return raw.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count("v").alias("n_numeric")).where("n_numeric >= 4")


@query(
    "src_chart_text",
    "lines",
    """ SELECT group_id AS chart_id, k + 1 AS line_no, concat('item ', CAST(l_partkey AS VARCHAR), ',', CAST(qty AS VARCHAR), ',', CAST(disc AS VARCHAR)) AS line FROM lines
UNION ALL SELECT DISTINCT group_id, 0, 'label,quantity,discount_pct' FROM lines""",
)
def src_chart_text(spark, sf):
    # one row per line of a chart's text, so that no chart is gathered in one task
    whole = lambda c: F.col(c).cast("string")
    line = F.concat_ws(",", F.concat(F.lit("item "), whole("l_partkey")), whole("qty"), whole("disc"))
    lines = view(spark, sf, "lines")
    head = lines.select(F.col("group_id").alias("chart_id")).distinct().select("chart_id", F.lit(0).alias("line_no"), F.lit("label,quantity,discount_pct").alias("line"))
    return lines.select(F.col("group_id").alias("chart_id"), (F.col("k") + 1).alias("line_no"), line.alias("line")).unionByName(head)


CHART_ROWS = 50


@query(
    "src_chart_csv",
    "lines",
    f""", l AS (SELECT group_id AS chart_id, k, concat('item ', CAST(l_partkey AS VARCHAR), ',', CAST(qty AS VARCHAR), ',', CAST(disc AS VARCHAR)) AS line FROM lines WHERE k < {CHART_ROWS})
SELECT chart_id, concat('label,quantity,discount_pct', chr(10), string_agg(line, chr(10) ORDER BY k)) AS text FROM l GROUP BY chart_id""",
)
def src_chart_csv(spark, sf):
    """A chart's text as a prompt shows it: the header and the first CHART_ROWS rows (the row limit is part of the form)."""
    first = src_chart_text(spark, sf).where(F.col("line_no") <= CHART_ROWS)
    lines = first.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return lines.select("chart_id", F.array_join(F.col("l.line"), "\n").alias("text"))


@query(
    "sink_append_resume",
    ("rollouts", "judge_outputs"),
    """SELECT bench, count(*) AS n_rows, count(DISTINCT group_id) AS n_keys FROM rollouts r ANTI JOIN (SELECT id FROM judge_outputs WHERE NOT starts_with(raw, 'ERROR')) d ON r.group_id = d.id GROUP BY bench""",
)
def sink_append_resume(spark, sf):
    path = fresh_folder(spark)
    judged = view(spark, sf, "judge_outputs").selectExpr("id AS group_id", "CAST(NULL AS STRING) AS bench", "0L AS n", "raw")
    append_resume(judged, path, ["group_id"], "raw")
    todo = view(spark, sf, "rollouts").groupBy("bench", "group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("raw", F.lit("scored"))
    for _ in range(2):  # the second run finds nothing left to do
        done = append_resume(todo.select("group_id", "bench", "n", "raw"), path, ["group_id"], "raw")
    return done.where("raw = 'scored'").groupBy("bench").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


@query(
    "sink_report",
    "rollouts",
    """, g AS (SELECT bench, model, count(*) AS n, count(*) FILTER (WHERE outcome = 1) AS n_pass, count(*) FILTER (WHERE outcome IS NULL) AS n_null FROM rollouts GROUP BY ROLLUP (bench, model))
SELECT CASE WHEN bench IS NULL THEN 'global' WHEN model IS NULL THEN bench ELSE concat(model, '__', bench) END AS combo, concat('{"n":', n, ',"n_pass":', n_pass, ',"n_null":', n_null, '}') AS report FROM g""",
)
def sink_report(spark, sf):
    rows = view(spark, sf, "rollouts").rollup("bench", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("outcome") == 1).alias("n_pass"),
        F.count_if(F.col("outcome").isNull()).alias("n_null"),
    )
    combo = (
        F.when(F.col("bench").isNull(), "global").when(F.col("model").isNull(), F.col("bench")).otherwise(F.concat_ws("__", "model", "bench"))
    )
    path = fresh_folder(spark)
    write_report(rows.select(combo.alias("combo"), F.to_json(F.struct("n", "n_pass", "n_null")).alias("report")), path)
    return spark.read.schema("combo string, report string").json(path)
