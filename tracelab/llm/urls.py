"""URL filters: longest-rule verdicts, and a path-template tree per host for all other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import staged

#: Rules: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

DEPTH = 8  # levels of the check SQL; the tree goes as deep as the labelled paths
RARE = 20  # a segment seen in under 1/RARE of its parent's pages is variable, if it has fewer than ENOUGH labelled pages
ENOUGH = 10
SIMILAR = 3.84  # chi-square, one degree of freedom, 5 %: below it two branches count as one
WEIGHT = 4  # weight of the overall share of bad pages in a template's share
REJECT = 0.5
BROADCAST_ROWS = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _rule(rules: list[tuple[str, str]], host: Column, path: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        domain, _, rest = rule[0].partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule[at])).otherwise(out)
    return out


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Verdict on every page: ``page_id, host, path, rule, verdict, template``.

    ``labels`` has ``page_id, bad`` (1 bad, 0 good) for some pages. Digits inside a path segment become ``*``; then,
    level by level from the host down, a segment becomes ``*`` where its labelled pages do not differ from its siblings'
    (chi-square), so that alike branches share one template, or where it is rare among its parent's pages and has fewer than
    ENOUGH labelled ones. A level is built while some template has two different labelled paths, one of them deeper; below
    that nothing can differ and all segments are ``*``. A template is rejected if its share of bad labelled pages, drawn towards the overall share, is REJECT or more. All
    steps run on page counts per host and digit-free path, combined before the shuffle, so a host with a third of all
    pages is a few rows.

    Null urls and urls without ``://``: empty host and path, judged by the tree of the empty host. A null ``page_id`` has no label. A
    page labelled twice is bad if one label says so. Repeated rows are judged alike.
    """
    host, path = host_path(F.col("url").cast("string"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    segments = F.expr("filter(split(path, '/'), x -> x != '')")
    base = base.withColumn("_k", F.array_join(F.transform(segments, lambda x: F.regexp_replace(x, "[0-9]+", "*")), "/"))
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    shapes = base.join(known, "page_id", "left").groupBy("host", "_k").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad")
    )
    parts = F.when(F.col("_k") == "", F.array().cast("array<string>")).otherwise(F.split("_k", "/"))
    left = staged(shapes.select("*", parts.alias("_s"), F.lit("").alias("t")), "shapes")
    done, d = [], 0  # ``t`` is the template's first d segments, each behind a slash
    while True:
        deep = F.when(F.col("lab") > 0, F.size("_s"))
        groups = left.groupBy("host", "t").agg(((F.count(deep) > 1) & F.coalesce(F.max(deep) > d, F.lit(False))).alias("_open"))
        left = staged(left.join(groups, ["host", "t"]), f"groups-{d}")
        done.append(left.where("not _open").withColumn("t", F.concat("t", F.repeat(F.lit("/*"), F.size("_s") - d))))
        left = left.where("_open").drop("_open")
        if left.isEmpty():
            break
        d += 1
        left = left.withColumn("a", F.coalesce(F.try_element_at("_s", F.lit(d)), F.lit("")))
        child = left.groupBy("host", "t", "a").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
        whole = child.groupBy("host", "t").agg(*[F.sum(c).alias(f"{c}_p") for c in ("n", "lab", "bad")])
        rare = (RARE * F.col("n") < F.col("n_p")) & (F.col("lab") < ENOUGH)
        alike = (F.col("lab") == 0) | (F.col("lab") == F.col("lab_p")) | F.expr(_ALIKE)
        choice = child.join(whole, ["host", "t"]).select(
            "host", "t", "a", F.when(F.col("a") == "", "").when(rare | alike, "/*").otherwise(F.concat(F.lit("/"), "a")).alias("_t")
        )
        left = left.join(choice, ["host", "t", "a"]).withColumn("t", F.concat("t", "_t")).drop("a", "_t")
        left = staged(left, f"level-{d}")
        done.append(left.where(F.size("_s") < d))
        left = left.where(F.size("_s") >= d)
    name = F.when(F.col("t") == "", "/").otherwise(F.col("t")).alias("template")
    shapes = done[0].select("host", "_k", "lab", "bad", name)
    for part in done[1:]:
        shapes = shapes.unionByName(part.select("host", "_k", "lab", "bad", name))
    shapes = staged(shapes, "shapes-done")
    total = shapes.agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab")).first()
    prior = (total["bad"] or 0) / (total["lab"] or 1)
    share = (F.col("bad_t") + WEIGHT * prior) / (F.col("lab_t") + WEIGHT)
    templates = shapes.groupBy("host", "template").agg(F.sum("bad").alias("bad_t"), F.sum("lab").alias("lab_t")).withColumn("rejected", share >= REJECT)
    final = staged(shapes.join(templates, ["host", "template"]).select("host", "_k", "rejected", "template"), "templates")
    if final.count() <= BROADCAST_ROWS:
        final = F.broadcast(final)
    verdict = F.coalesce(_rule(rules, F.col("host"), F.col("path"), 1), F.when(F.col("rejected"), "block").otherwise("allow"))
    return base.join(final, ["host", "_k"]).select(
        "page_id", "host", "path", _rule(rules, F.col("host"), F.col("path"), 0).alias("rule"), verdict.alias("verdict"), "template"
    )


#: Squared difference of the shares against its variance under one common share.
_ALIKE = (
    "(bad * 1.0D / lab - (bad_p - bad) * 1.0D / (lab_p - lab)) * (bad * 1.0D / lab - (bad_p - bad) * 1.0D / (lab_p - lab)) "
    f"<= {SIMILAR}D * (bad_p * 1.0D / lab_p) * (1.0D - bad_p * 1.0D / lab_p) * (1.0D / lab + 1.0D / (lab_p - lab))"
)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages from labels of documents: the number in a url's last segment names the page's document; quality 0 is bad."""
    _, path = host_path(F.col("url").cast("string"))
    number = F.regexp_extract(path, r"/([0-9]+)[^/]*/?$", 1).try_cast("bigint")
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return pages.select("page_id", number.alias("doc_id")).join(known, "doc_id").select("page_id", (1 - F.col("quality")).alias("bad"))


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    return judged(pages, page_labels(pages, labels))


def _case(at: int) -> str:
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: len(r[0])):
        domain, _, rest = rule[0].partition("/")
        out = f"CASE WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}') THEN '{rule[at]}' ELSE {out} END"
    return out


_ALIKE_SQL = _ALIKE.replace(f"{SIMILAR}D", f"CAST({SIMILAR} AS DOUBLE)").replace("1.0D", "CAST(1 AS DOUBLE)")


def _levels() -> str:
    """The tree, level by level: open groups choose the next segment or ``*``, closed ones end in ``*``."""
    out = ""
    for d in range(1, DEPTH + 1):
        out += f""",
o{d} AS (SELECT host, t, count(*) FILTER (WHERE lab > 0) > 1 AND coalesce(max(len(s)) FILTER (WHERE lab > 0), 0) > {d - 1} AS is_open FROM left{d - 1} GROUP BY host, t),
q{d} AS (SELECT l.*, is_open, coalesce(s[{d}], '') AS a FROM left{d - 1} l JOIN o{d} USING (host, t)),
c{d} AS (SELECT host, t, a, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM q{d} WHERE is_open GROUP BY ALL),
w{d} AS (SELECT host, t, sum(n) AS n_p, sum(lab) AS lab_p, sum(bad) AS bad_p FROM c{d} GROUP BY ALL),
x{d} AS (SELECT host, t, a, CASE WHEN a = '' THEN '' WHEN ({RARE} * n < n_p AND lab < {ENOUGH}) OR lab = 0 OR lab = lab_p THEN '/*' WHEN {_ALIKE_SQL} THEN '/*' ELSE '/' || a END AS step FROM c{d} JOIN w{d} USING (host, t)),
m{d} AS (SELECT host, k, s, n, lab, bad, t || step AS t FROM q{d} JOIN x{d} USING (host, t, a) WHERE is_open),
left{d} AS (SELECT * FROM m{d} WHERE len(s) >= {d}),
done{d} AS (SELECT host, k, lab, bad, t || repeat('/*', len(s) - {d - 1}) AS t FROM q{d} WHERE NOT is_open UNION ALL SELECT host, k, lab, bad, t FROM m{d} WHERE len(s) < {d})"""
    return out


_DONE = " UNION ALL ".join([f"SELECT * FROM done{d}" for d in range(1, DEPTH + 1)] + [f"SELECT host, k, lab, bad, t || repeat('/*', len(s) - {DEPTH}) FROM left{DEPTH}"])
SQL = f"""
WITH r0 AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
r1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r0),
r2 AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') AS s FROM r1),
b AS (SELECT page_id, host, path, TRY_CAST(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT) AS doc_id, s, array_to_string(s, '/') AS k FROM r2),
l AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels GROUP BY doc_id),
left0 AS (SELECT host, k, s, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad, '' AS t FROM b LEFT JOIN l USING (doc_id) GROUP BY host, k, s){_levels()},
z AS ({_DONE}),
g AS (SELECT sum(bad) * CAST(1 AS DOUBLE) / greatest(sum(lab), 1) AS prior FROM z),
t AS (SELECT host, t, sum(bad) AS bad_t, sum(lab) AS lab_t FROM z GROUP BY ALL),
f AS (SELECT host, k, (bad_t + {WEIGHT} * prior) / (lab_t + {WEIGHT}) >= {REJECT} AS rejected, CASE WHEN t = '' THEN '/' ELSE t END AS template FROM z JOIN t USING (host, t), g)
SELECT page_id, host, path, {_case(0)} AS rule, coalesce({_case(1)}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template FROM b JOIN f USING (host, k)
"""
