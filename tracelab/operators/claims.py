"""Claims in reasoning steps, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions import verdicts as V
from tracelab.functions.text import every, explode_items, group, strip, sub
from tracelab.operators.scale import exact_quantiles

# Claim patterns (entity and value groups), superlatives and axis phrases.
VALUE_PATTERNS = [
    (r"(?i)([A-Z][\w\s\-]{1,30}?)\s*(?:[=:]|\bis\b|\bequals\b)\s*(-?\d+(?:\.\d+)?)\s*(%|million|billion|M|B|K)?", 1, 2),
    (r"(?i)(?:value\s+of\s+|for\s+)([\w\s\-]{1,30}?)\s+is\s+(-?\d+(?:\.\d+)?)", 1, 2),
    (r"([A-Z][\w\s\-]{1,30})\s*\((-?\d+(?:\.\d+)?)\)", 1, 2),
]
WITH_UNIT = 0  # the pattern whose third group is a unit
SUPERLATIVE = (
    r"(?i)(highest|lowest|maximum|minimum|largest|smallest)\s+(?:value|category|entity|region)?\s*(?:is|=)\s*([\w\s\-]{1,30})"
)
AXIS_PATTERNS = {
    "VALUE": [
        r"(?i)((?:value|approximately|about|around|roughly|approx\.?|≈|~)\s*[\w\s\-,]{0,30}?-?\d+\.?\d*\s*(?:%|m|gb|usd|million|billion|k\b|p\b)?)",
        r"(?i)(\d+\.?\d*\s*(?:%|usd|million|billion|m\s|k\s|p\b))",
    ],
    "LABEL": [
        r"(?i)((?:legend|series|category|method|model|line|bar|cluster)\s+(?:is|are|of|for|called|named|labeled)\s+[\"']?[\w\-/\s]+[\"']?)",
        r"\b([A-Z][\w\-/]{2,}(?:\s+[A-Z][\w\-/]{2,})+)\b",
    ],
    "COUNT": [
        r"(?i)((?:there\s+are|there\s+is|i\s+see|i\s+count|count\s+is|total\s+of|number\s+of)\s+\d+\s+[\w\-/\s]{1,40})",
        r"(?i)(\b\d+\s+(?:items?|bars?|categories|series|methods?|movies?|clusters?|points?|cells?|countries|people))",
    ],
    "STRUCTURE": [
        r"(?i)((?:x[-\s]?axis|y[-\s]?axis|z[-\s]?axis|horizontal\s+axis|vertical\s+axis|legend|color|shade|bar\s+(?:height|width|area)"
        r"|top[-\s]?(?:left|right)|bottom[-\s]?(?:left|right)|leftmost|rightmost)[\s\w,'\-]{0,60})"
    ],
}


# What a text must hold for a pattern to hit at all: a part of the pattern that is found in one pass, while the entity groups
# are tried from every letter on.
VALUE_PARTS = [
    r"(?i)(?:[=:]|\bis\b|\bequals\b)\s*-?\d",
    r"(?i)\sis\s+-?\d",
    r"\(-?\d",
]
SUPERLATIVE_PART = r"(?i)highest|lowest|maximum|minimum|largest|smallest"


def pattern_hits(text: Column, pattern: str, part: str) -> Column:
    """Hits of a pattern as an array, found in one search of the texts that hold ``part``; empty for the others."""
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(text.rlike(part), every(text, pattern)).otherwise(none)


def regex_claims(steps: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Claims found by the patterns, one per (entity, value) or (entity, comparator) of a step.

    A hit is found once and its groups are read from the hit: no pattern looks beyond its end.
    """
    t = F.col(text)
    found = []

    none = F.lit(None).cast("string")

    def value_claim(number: int, pattern: str, e: int, v: int):
        return lambda hit, at: F.struct(
            F.lit("value").alias("type"), strip(group(hit, pattern, e)).alias("entity"), group(hit, pattern, v).try_cast("double").alias("value"),
            (F.nullif(group(hit, pattern, 3), F.lit("")) if number == WITH_UNIT else none).alias("unit"), none.alias("comparator"),
            F.struct(F.lit(number).alias("pattern"), at.alias("hit")).alias("at"),
        )

    for i, (pattern, e, v) in enumerate(VALUE_PATTERNS):
        found.append(F.transform(pattern_hits(t, pattern, VALUE_PARTS[i]), value_claim(i, pattern, e, v)))
    found.append(
        F.transform(
            pattern_hits(t, SUPERLATIVE, SUPERLATIVE_PART),
            lambda hit, at: F.struct(
                F.lit("categorical").alias("type"), strip(group(hit, SUPERLATIVE, 2)).alias("entity"), F.lit(None).cast("double").alias("value"),
                none.alias("unit"), F.lower(group(hit, SUPERLATIVE, 1)).alias("comparator"),
                F.struct(F.lit(len(VALUE_PATTERNS)).alias("pattern"), at.alias("hit")).alias("at"),
            ),
        )
    )
    rows = explode_items(steps, keys, F.concat(*found), "_i", "c").select(*keys, "c.*")
    return (
        rows.groupBy(*keys, "type", F.lower("entity").alias("entity_key"), "value", "comparator")
        .agg(F.min_by("entity", "at").alias("entity"), F.min_by("unit", "at").alias("unit"), F.min("at").alias("at"))
        .drop("entity_key")
    )


def has_claim(text: Column) -> Column:
    found = text.rlike(SUPERLATIVE_PART) & text.rlike(SUPERLATIVE)
    for (pattern, _, _), part in zip(VALUE_PATTERNS, VALUE_PARTS):
        found = found | (text.rlike(part) & text.rlike(pattern))
    return found


def axis_claims(text: Column) -> dict[str, Column]:
    """At most one claim per axis: the first pattern that hits."""
    out = {}
    for axis, patterns in AXIS_PATTERNS.items():
        hits = [F.when(text.rlike(p), strip(group(text, p))) for p in patterns]
        out[axis] = F.coalesce(*hits, F.lit(""))
    return out


def json_claims(rows: DataFrame, keys: list[str], raw: str, greedy: bool = True) -> DataFrame:
    """Claims of a JSON list in a text; objects without entity are dropped, odd types repaired."""
    items = explode_items(rows, keys, V.claim_items(F.col(raw), greedy), "claim", "item")
    get = lambda name: F.get_json_object("item", f"$.{name}")
    kind, value = get("type"), get("value").try_cast("double")
    repaired = F.when(value.isNotNull(), "value").otherwise("categorical") if greedy else F.lit("value")
    return items.select(
        *keys, "claim",
        strip(get("entity")).alias("entity"),
        value.alias("value"),
        F.when(F.coalesce(kind, F.lit("value")).isin("value", "categorical"), F.coalesce(kind, F.lit("value"))).otherwise(repaired).alias("type"),
    ).where(F.coalesce("entity", F.lit("")) != "")


def normal(s: Column) -> Column:
    return sub(F.lower(s), r"[^a-z0-9]")


def jaccard(steps: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Jaccard overlap of two claim sets per step: both empty 1, one empty 0."""

    def keyed(claims: DataFrame, flag: str) -> DataFrame:
        name = normal(F.col("entity"))
        return (
            claims.select(*keys, name.alias("e"), F.round("value", 2).alias("v"))
            .where(F.col("e") != "")
            .groupBy(*keys, "e", "v")
            .agg(F.lit(1).alias(flag))
        )

    x, y = keyed(a, "in_a"), keyed(b, "in_b")
    both = x.withColumn("in_b", F.lit(0)).unionByName(y.withColumn("in_a", F.lit(0)))
    items = both.groupBy(*keys, "e", "v").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    sets = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("n_both")
    )
    joined = steps.join(sets, keys, "left")
    return joined.withColumn(
        "jaccard", F.when(F.col("n_union").isNull(), 1.0).otherwise(F.try_divide("n_both", "n_union"))
    )


def score_value(claim: Column, response: Column, version: int = 2) -> Column:
    """Full, half or no credit for a stated value; not found and unreadable are null (early form .5)."""
    full, full_abs, half = (0.10, 1.0, 0.25) if version == 2 else (0.05, 0.5, 0.15)
    got = V.first_number(response)
    gap = F.abs(got - claim)
    rel = gap / F.greatest(F.abs(claim), F.lit(1e-10))
    graded = F.when((rel <= full) | (gap <= full_abs), 1.0).when(rel <= half, 0.5).otherwise(0.0)
    readable = got.isNotNull() & claim.isNotNull()
    if version == 2:
        return F.when(~V.not_found(response) & readable, graded)
    return F.when(readable, graded).otherwise(0.5)


def score_category(entity: Column, response: Column, version: int = 2) -> Column:
    """Normalised containment either way."""
    want, got = normal(F.coalesce(entity, F.lit(""))), normal(F.coalesce(response, F.lit("")))
    hit = F.when(got.contains(want) | want.contains(got), 1.0).otherwise(0.0)
    if version == 2:
        return F.when(~V.not_found(response) & (want != "") & (got != ""), hit)
    return F.when(want == "", 0.5).otherwise(hit)


def step_perception(steps: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """Per step: mean of the valid scores, totals and not-found rate; steps without claims stay null."""
    per = checked.groupBy(*keys).agg(
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("missing").alias("n_not_found"),
        F.round(F.avg(F.col("missing").cast("double")), 6).alias("not_found_rate"),
    )
    return steps.join(per, keys, "left")


def perception_distribution(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Median, mean and shares of step scores at the marks 0, .5 and 1 and between them."""
    valid = steps.where(F.col("mean_score").isNotNull())
    m = F.col("mean_score")
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    shares = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.round(F.avg(m), 6).alias("mean_perception"),
        share(m == 0, "share_zero"),
        share(m == 0.5, "share_half"),
        share(m == 1, "share_one"),
        share((m > 0) & (m < 1) & (m != 0.5), "share_between"),
        F.round(F.avg("not_found_rate"), 6).alias("mean_not_found"),
    )
    median = exact_quantiles(valid, keys, "mean_score", {"median_perception": 0.5}, low=0.0, high=1.0)
    return shares.join(median.withColumn("median_perception", F.round("median_perception", 6)), keys)


def verifier_reliability(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and agreement of a verifier against table truth (truth, response)."""
    got = V.first_number(F.col("response"))
    status = (
        F.when(F.col("response").startswith("ERROR"), "error")
        .when(V.not_found(F.col("response")), "not_found")
        .when(got.isNull(), "parse_fail")
        .otherwise("ok")
    )
    rows = answers.withColumns({"status": status, "got": got})
    gap = F.abs(F.col("got") - F.col("truth"))
    agrees = (F.col("status") == "ok") & ((gap / F.greatest(F.abs("truth"), F.lit(1e-10)) <= 0.10) | (gap <= 1.0))
    ok = F.count_if(F.col("status") == "ok")
    report = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "not_found", "parse_fail", "error")],
        F.round(100.0 * ok / F.count(F.lit(1)), 6).alias("coverage_pct"),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if(agrees), ok), F.lit(0.0)), 6).alias("agreement_pct"),
    )
    return report.withColumn("reliable", (F.col("coverage_pct") >= 80) & (F.col("agreement_pct") >= 85))
