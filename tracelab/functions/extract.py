"""Answer extraction rule sets: each adds an answer column and the route that produced it.

The order of the branches is the meaning of a rule set. Long chains run as staged columns,
so that no regular expression is evaluated twice per stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.text import every, first_line, first_of, group, last_line, last_of, lines_of, or_empty, strip, sub

# Answer tags, lead-ins, units and hedges that are stripped.
TAG = r"(?s)<answer>(.*?)</answer>"
TAG_ANY_CASE = r"(?si)<answer>(.*?)</answer>"
BOXED = r"\\boxed\{(.*?)\}"
LEAD_INS = (
    r"(?i)^(?:Final answer:|The answer is|Answer:|Therefore,|So the answer is|Thus,|Hence,|In conclusion,"
    r"|There are|There is|The value is|The difference is|It is|The total is|The average is)"
)
UNIT_WORDS = r"(?i)\s*(?:billion|million|thousand|trillion|percent)\b"
HEDGES = r"(?i)^(?:approximately|about|around|roughly|~)\s*"
NUMBER_SIMPLE = r"[-+]?\d*\.?\d+"
NUMBER_GROUPED = r"[-+]?\d+(?:[,\.]\d+)*"
NUMBER_PERCENT = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?"
EXTENDED_PATTERNS = [
    ("tag", r"(?si)<answer>\s*(.*?)\s*</answer>"),
    (
        "phrase",
        r"(?si)(?:final answer|the answer is|answer:|so the answer is|therefore,?\s*the answer is)\s*[:\s]*([^\n.]+)",
    ),
    ("so_it_is", r"(?si)(?:so it is|so we get|hence,?\s*it is|thus,?\s*it is)\s*[:\s]*([^\n.]+)"),
    ("boxed", r"(?si)\\boxed\{([^}]+)\}"),
]

Stages = list[tuple[str, Callable[[], Column]]]


def run_stages(df: DataFrame, stages: Stages) -> DataFrame:
    """Add columns one after the other and drop the scratch ones (leading underscore)."""
    for name, build in stages:
        df = df.withColumn(name, build())
    return df.drop(*[name for name, _ in stages if name.startswith("_")])


def no_commas(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit(""))


def cut_ends(s: Column, front: int, back: int) -> Column:
    return F.substring(s, F.lit(front + 1), F.greatest(F.length(s) - front - back, F.lit(0)))


def normalize_stages(source: str, out: str) -> Stages:
    """Clean an answer: quotes, final dot, lead-ins, ranges, yes/no, units, long answers."""
    c = F.col
    starts_no = r"(?i)^(?:no|(?:\S+\s+){1,2}no(?:\s|$))"
    starts_yes = r"(?i)^(?:yes|(?:\S+\s+){1,2}yes(?:\s|$))"

    def unquoted() -> Column:
        s = c("_n1")
        quoted = F.lit(False)
        for q in ('"', "'"):
            quoted = quoted | (s.startswith(q) & s.endswith(q))
        return F.when(quoted, strip(cut_ends(s, 1, 1))).otherwise(s)

    def special() -> Column:
        s = c("_n4")
        first = strip(F.substring_index(s, ",", 1))
        years = r"^(\d{4})\s+to\s+(\d{4})$"
        return (
            F.when(s.rlike(years), group(s, years, 2))
            .when((F.length(s) > 20) & s.contains(",") & F.lower(first).isin("yes", "no"), first)
            .when(s.rlike(starts_no), "No")
            .when(s.rlike(starts_yes), "Yes")
        )

    def shortened() -> Column:
        s = c("_n6")
        number = no_commas(last_of(every(s, NUMBER_PERCENT)))
        return F.coalesce(c("_n5"), F.when(F.length(s) > 15, F.coalesce(number, s)).otherwise(s))

    return [
        ("_n1", lambda: strip(F.replace(c(source), F.lit("**"), F.lit("")))),
        ("_n2", unquoted),
        (
            "_n3",
            lambda: F.when(
                (F.length("_n2") < 80) & c("_n2").endswith("."), strip(cut_ends(c("_n2"), 0, 1))
            ).otherwise(c("_n2")),
        ),
        ("_n4", lambda: strip(sub(c("_n3"), LEAD_INS))),
        ("_n5", special),
        ("_n6", lambda: strip(sub(strip(sub(c("_n4"), UNIT_WORDS)), r"\s*[kKMBT]$"))),
        (out, shortened),
    ]


def v5(df: DataFrame, response: str = "response") -> DataFrame:
    """Search only after the last ``</think>``: boxed, tag, open tag, last line."""
    c = F.col
    open_tag = r"(?si)<answer>(.*)$"

    def scope() -> Column:
        r = or_empty(c(response))
        return (
            F.when(r.contains("</think>"), strip(F.substring_index(r, "</think>", -1)))
            .when(r.contains("<think>"), "")
            .otherwise(r)
        )

    def route() -> Column:
        s, r = c("_scope"), or_empty(c(response))
        return (
            F.when(r == "", "empty")
            .when((s == "") & r.contains("</think>"), "nothing_after_think")
            .when(s == "", "unclosed_think")
            .when(s.rlike(BOXED), "boxed")
            .when(s.rlike(TAG_ANY_CASE), "tag")
            .when(strip(group(s, open_tag)) != "", "open_tag")
            .otherwise("last_line")
        )

    def candidate() -> Column:
        s, way = c("_scope"), c("route")
        return (
            F.when(way == "boxed", strip(group(s, BOXED)))
            .when(way == "tag", strip(group(s, TAG_ANY_CASE)))
            .when(way == "open_tag", strip(group(s, open_tag)))
            .when(way == "last_line", last_line(s))
            .otherwise("")
        )

    return run_stages(
        df, [("_scope", scope), ("route", route), ("_raw", candidate), *normalize_stages("_raw", "pred")]
    )


def truth_words(s: Column) -> Column:
    # worked out once, and outside the generated code of the long chains that end here: Java compiles no method above 8,000 bytes
    texts = F.array(F.struct(s.alias("s"), F.lower(strip(s)).alias("low")))
    return F.transform(texts, lambda t: F.when(t["low"] == "true", "yes").when(t["low"] == "false", "no").otherwise(t["s"]))[0]


def train(df: DataFrame, response: str = "response") -> DataFrame:
    """Training-time rule: tag with units and hedges stripped, else text after think, else last number."""
    c = F.col
    units = r"(?i)(?:million|billion|thousand|percent|%|dollars|\$|USD)"

    def tagged() -> Column:
        return F.when(c(response).rlike(TAG), strip(sub(strip(sub(strip(group(c(response), TAG)), units)), HEDGES)))

    def after() -> Column:
        r = c(response)
        return F.when(r.contains("</think>"), strip(F.substring_index(r, "</think>", -1))).otherwise("")

    def route() -> Column:
        return (
            F.when(c("_tagged").isNotNull(), "tag")
            .when((c("_after") != "") & F.size("_after_nums").__gt__(0), "after_number")
            .when(c("_after") != "", "after_line")
            .when(F.size("_nums") > 0, "last_number")
            .otherwise("last_line")
        )

    def pred() -> Column:
        way, t = c("route"), c("_tagged")
        short = F.when(F.length(t) > 50, F.coalesce(first_of(every(t, NUMBER_SIMPLE)), t)).otherwise(t)
        return (
            F.when(way == "tag", truth_words(short))
            .when(way == "after_number", last_of(c("_after_nums")))
            .when(way == "after_line", truth_words(last_line(c("_after"))))
            .when(way == "last_number", last_of(c("_nums")))
            .otherwise(truth_words(F.substring_index(strip(c(response)), "\n", -1)))
        )

    return run_stages(
        df,
        [
            ("_tagged", tagged),
            ("_after", after),
            # numbers are looked for only where they decide
            ("_after_nums", lambda: F.when(c("_tagged").isNull(), every(c("_after"), NUMBER_SIMPLE))),
            ("_nums", lambda: F.when(c("_tagged").isNull() & (c("_after") == ""), every(c(response), NUMBER_SIMPLE))),
            ("route", route),
            ("pred", pred),
        ],
    )


def post_think(df: DataFrame) -> DataFrame:
    """Last line of the content, else of the reasoning after think, else of the reasoning."""
    content, reasoning = or_empty(F.col("content")), or_empty(F.col("reasoning_content"))
    tail = F.when(reasoning.contains("</think>"), last_line(F.substring_index(reasoning, "</think>", -1))).otherwise("")
    options = [("content", last_line(content)), ("after_think", tail), ("reasoning", last_line(reasoning))]
    route, pred = F.lit(None).cast("string"), F.lit("")
    for name, value in reversed(options):
        route = F.when(value != "", name).otherwise(route)
        pred = F.when(value != "", value).otherwise(pred)
    return df.withColumns({"route": F.coalesce(route, F.lit("empty")), "pred": pred})


def last_tag(df: DataFrame) -> DataFrame:
    """Last answer tag (closing tag optional) of the content, else its last line."""
    c = F.col

    def text() -> Column:
        reasoning = or_empty(c("reasoning_content"))
        return F.when(strip(or_empty(c("content"))) != "", c("content")).otherwise(
            F.when(reasoning.contains("</think>"), F.substring_index(reasoning, "</think>", -1)).otherwise(reasoning)
        )

    return run_stages(
        df,
        [
            ("_text", text),
            ("_hit", lambda: strip(last_of(every(F.concat(c("_text"), F.lit("</answer>")), TAG, 1)))),
            ("_has", lambda: F.coalesce(c("_hit") != "", F.lit(False))),
            ("route", lambda: F.when(c("_has"), "tag").otherwise("last_line")),
            ("pred", lambda: F.when(c("_has"), c("_hit")).otherwise(last_line(c("_text")))),
        ],
    )


def extended(df: DataFrame) -> DataFrame:
    """Four answer patterns over reasoning and content, the last hit of the first that hits; else
    the last of the closing three lines that is of sane length."""
    c = F.col

    def text() -> Column:
        reasoning, content = or_empty(c("reasoning_content")), or_empty(c("content"))
        return F.when(reasoning != "", strip(F.concat(reasoning, F.lit("\n"), content))).otherwise(strip(content))

    def tail_line() -> Column:
        tail = F.slice(F.reverse(lines_of(c("_text"))), 1, 3)
        sane = first_of(F.filter(tail, lambda x: F.length(x) <= 200))
        return F.coalesce(sane, F.left(last_line(c("_text")), F.lit(200)), F.lit(""))

    hits = [(f"_h_{name}", (lambda p: lambda: last_of(every(c("_text"), p, 1)))(p)) for name, p in EXTENDED_PATTERNS]

    def route() -> Column:
        out = F.lit(None).cast("string")
        for name, _ in reversed(EXTENDED_PATTERNS):
            out = F.when(c(f"_h_{name}").isNotNull(), name).otherwise(out)
        return F.when(c("_text") == "", "empty").otherwise(F.coalesce(out, F.lit("last_line")))

    def pred() -> Column:
        return F.coalesce(strip(F.coalesce(*[c(n) for n, _ in hits])), tail_line())

    return run_stages(df, [("_text", text), *hits, ("route", route), ("pred", pred)])


SPACED_TAG = r"(?si)<answer>\s*(.*?)\s*</answer>"


def by_bench(df: DataFrame, tag_bench: str = "bench_c") -> DataFrame:
    """One benchmark answers in a tag (else last line), the others on the first line."""
    c = F.col

    def text() -> Column:
        content = strip(or_empty(c("content")))
        return F.when(content != "", content).otherwise(strip(or_empty(c("reasoning_content"))))

    def route() -> Column:
        tagged = c("_text").rlike(SPACED_TAG)
        return (
            F.when((c("bench") == tag_bench) & tagged, "tag")
            .when(c("bench") == tag_bench, "last_line")
            .otherwise("first_line")
        )

    def pred() -> Column:
        return (
            F.when(c("route") == "tag", strip(group(c("_text"), SPACED_TAG)))
            .when(c("route") == "last_line", last_line(c("_text")))
            .otherwise(first_line(c("_text")))
        )

    return run_stages(df, [("_text", text), ("route", route), ("pred", pred)])


def rescore_legacy(df: DataFrame) -> DataFrame:
    """Earlier re-scoring rule with unit, currency and hedge stripping."""
    c = F.col

    def whole() -> Column:
        reasoning, content = or_empty(c("reasoning_content")), or_empty(c("content"))
        return F.when(
            reasoning != "", F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n"), content)
        ).otherwise(content)

    def cleaned() -> Column:
        content = or_empty(c("content"))
        t = strip(group(content, TAG_ANY_CASE))
        t = strip(sub(t, r"(?i)\b(?:million|billion|trillion|thousand)\b"))
        t = strip(sub(t, r"(?i)\b(?:percent|percentage)\b", "%"))
        t = strip(sub(t, r"(?i)\b(?:dollars|USD|EUR|GBP)\b"))
        t = strip(sub(strip(sub(t, HEDGES)), r"\s+", " "))
        return F.when(content.rlike(TAG_ANY_CASE), t)

    def after() -> Column:
        r = c("_whole")
        return F.when(r.contains("</think>"), first_line(F.substring_index(r, "</think>", -1))).otherwise("")

    def route() -> Column:
        return (
            F.when(c("_clean").isNotNull(), "tag")
            .when(c("_whole").rlike(TAG_ANY_CASE), "tag_anywhere")
            .when((c("_after") != "") & (F.length("_after") < 80), "after_line")
            .when((c("_after") != "") & c("_after").rlike(NUMBER_GROUPED), "after_number")
            .when(c("_tail_number").isNotNull(), "tail_number")
            .otherwise("last_line")
        )

    def pred() -> Column:
        way, t = c("route"), c("_clean")
        long = (F.length(t) > 50) | t.startswith("*") | t.startswith("-")
        number = lambda s: no_commas(first_of(every(s, NUMBER_GROUPED)))
        return (
            F.when(way == "tag", F.when(long, F.coalesce(number(t), t)).otherwise(t))
            .when(way == "tag_anywhere", strip(group(c("_whole"), TAG_ANY_CASE)))
            .when(way == "after_line", c("_after"))
            .when(way == "after_number", number(c("_after")))
            .when(way == "tail_number", c("_tail_number"))
            .otherwise(last_line(c("_whole")))
        )

    return run_stages(
        df,
        [
            ("_whole", whole),
            ("_clean", cleaned),
            ("_after", after),
            ("_tail_number", lambda: no_commas(last_of(every(F.right(c("_whole"), F.lit(500)), NUMBER_GROUPED)))),
            ("route", route),
            ("pred", pred),
        ],
    )


def last_answer(df: DataFrame, response: str = "response", pattern: str = TAG_ANY_CASE) -> DataFrame:
    """Last answer tag, else last line."""
    c = F.col
    return run_stages(
        df,
        [
            ("_hit", lambda: strip(last_of(every(c(response), pattern, 1)))),
            ("route", lambda: F.when(c("_hit").isNotNull(), "tag").otherwise("last_line")),
            ("pred", lambda: F.coalesce(c("_hit"), last_line(c(response)))),
        ],
    )


AFTER_THINK = r"(?s)</think>\s*(.+)"
BRACKET_TAG = r"(?s)\[answer\](.*?)\[/answer\]"


def mc_prediction(df: DataFrame, response: str = "response", most: int = 200) -> DataFrame:
    """A sub-rollout's answer: the first tag, else the last line, else the text; its first ``most`` characters, as the rule has it."""
    c = F.col
    return run_stages(
        df,
        [
            ("_line", lambda: last_line(c(response))),
            ("route", lambda: F.when(c(response).rlike(TAG_ANY_CASE), "tag").when(c("_line") != "", "last_line").otherwise("whole")),
            ("_said", lambda: F.when(c("route") == "tag", strip(group(c(response), TAG_ANY_CASE))).when(c("route") == "last_line", c("_line")).otherwise(c(response))),
            ("pred", lambda: F.left(c("_said"), F.lit(most))),
        ],
    )


def continuation(df: DataFrame, response: str = "response") -> DataFrame:
    """Answer of a continuation: the answer found behind ``</think>``, else all that stands there; without the tag the answer found anywhere."""
    c = F.col
    closed = c("_whole").rlike(AFTER_THINK)
    rows = df.withColumn("_whole", c(response)).withColumn(response, F.when(closed, strip(group(c("_whole"), AFTER_THINK))).otherwise(c("_whole")))
    rows = v5(rows).withColumnsRenamed({"pred": "_answer", "route": "_found"})
    found = F.coalesce(c("_answer"), F.lit("")) != ""
    rows = rows.withColumn("route", F.when(found, "answer").when(closed, "tail").otherwise("none"))
    rows = rows.withColumn("pred", F.when(found, c("_answer")).when(closed, c(response)).otherwise(""))
    return rows.withColumn(response, c("_whole")).drop("_whole", "_answer", "_found")


def bracket(df: DataFrame, response: str = "response") -> DataFrame:
    """The first ``[answer]`` in square brackets; empty without one."""
    c = F.col
    hit = c(response).rlike(BRACKET_TAG)
    return df.withColumns({"route": F.when(hit, "tag").otherwise("none"), "pred": F.when(hit, strip(group(c(response), BRACKET_TAG))).otherwise("")})


def teacher(df: DataFrame, tag_family: str = "bench_c") -> DataFrame:
    """Teacher output: a tag for one answer family, else the last line."""
    c = F.col
    content = lambda: strip(or_empty(c("content")))

    def route() -> Column:
        return (
            F.when(content() == "", "empty")
            .when((c("bench") == tag_family) & content().rlike(SPACED_TAG), "tag")
            .otherwise("last_line")
        )

    def pred() -> Column:
        return F.when(c("route") == "tag", strip(group(content(), SPACED_TAG))).otherwise(last_line(content()))

    return run_stages(df, [("route", route), ("pred", pred)])


# Rule sets over the served channels or the joined response text.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "v5": v5,
    "train": train,
    "post_think": post_think,
    "last_tag": last_tag,
    "extended_candidate": extended,
    "by_bench": by_bench,
    "rescore_legacy": rescore_legacy,
    "last_answer_simple": last_answer,
    "teacher_answer": teacher,
    "mc_prediction": mc_prediction,
    "continuation": continuation,
    "bracket": bracket,
}


def extract_answers(df: DataFrame, rules: list[str]) -> DataFrame:
    """One scan, one (pred, route) pair of columns per rule set."""
    for rule in rules:
        df = RULES[rule](df).withColumnsRenamed({"pred": f"pred_{rule}", "route": f"route_{rule}"})
    return df


def answer_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """How often each route and answer occurs per group."""
    return df.groupBy(*keys, "route", "pred").agg(F.count(F.lit(1)).alias("n"))


def rule_agreement(df: DataFrame, rules: list[str], keys: list[str]) -> DataFrame:
    """Pairwise disagreement counts and empty answers per rule, from one aggregation."""
    preds = {r: F.col(f"pred_{r}") for r in rules}
    pairs = [(a, b) for i, a in enumerate(rules) for b in rules[i:]]
    differs = lambda a, b: F.count_if(preds[a] == "") if a == b else F.count_if(preds[a] != preds[b])
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[differs(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = [
        F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.col(f"_{i}").alias("n_differ"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(*keys, "n", F.explode(F.array(*cells)).alias("_c")).select(*keys, "n", "_c.*")
