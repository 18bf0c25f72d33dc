"""Process terms: numbers of a reasoning span against the chart's table, and its arithmetic.

The table match is a nearest-value search. Mentions and cells are first reduced to distinct
values per chart; each mention then meets only its two neighbours among the cells of the same
sign, found by ordered windows over (chart, sign, value range) groups. No pair of mention and
cell is ever built, and a hot chart splits over its value ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.text import (
    NUMBER_PATTERNS, calc_pattern, every, explode_items, group, has_think_body, is_year, lines_of, plain_number, reasoning_span, strip,
    think_body, words,
)

ZERO = 1e-10


def number_mentions(responses: DataFrame, keys: list[str], span: str, kind: str = "compat") -> DataFrame:
    """One row per number in the span with its position; likely years are left out."""
    rows = explode_items(responses, keys, every(F.col(span), NUMBER_PATTERNS[kind]), "pos", "_t")
    return rows.select(*keys, "pos", plain_number(F.col("_t")).alias("n")).where(~is_year(F.col("n")))


BINS = 16  # value ranges of a power of two


def magnitude(n: Column) -> dict[str, Column]:
    power = F.floor(F.log2(F.abs(n)))
    return {
        "sign": F.signum(n).cast("int"),
        "size": F.abs(n),
        "mag": F.when(n == 0, -(2**30)).otherwise(BINS * power + F.floor((F.abs(n) / F.pow(F.lit(2.0), power) - 1) * BINS)).cast("int"),
    }


def nearest_cells(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Nearest cell below (or equal) and above each value in magnitude, same sign, per chart.

    ``values`` has distinct (chart_id, n), ``cells`` distinct (chart_id, value). Neighbours in
    other value ranges come from a short list per chart and sign: one entry per non-empty
    sixteenth of a power of two. Both window passes run up to the current row only, so the work is linear
    in values and cells, and one power of two of one chart splits over sixteen tasks.
    """
    table = cells.where(F.col("value").isNotNull()).withColumns(magnitude(F.col("value")))
    both = (
        values.select("chart_id", F.lit(1).alias("asked"), F.col("n").cast("double").alias("n"))
        .withColumns(magnitude(F.col("n")))
        .withColumn("cell", F.lit(None).cast("double"))
        .unionByName(
            table.select("chart_id", F.lit(0).alias("asked"), F.col("value").alias("n"), "sign", "size", "mag", F.col("value").alias("cell"))
        )
    )
    inside = Window.partitionBy("chart_id", "sign", "mag")
    up = inside.orderBy("size", "asked").rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.desc("size"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns(
        {
            "below": F.last("cell", ignorenulls=True).over(up),
            "above": F.last("cell", ignorenulls=True).over(down),
        }
    ).where("asked = 1")
    ladder = (
        table.groupBy("chart_id", "sign", "mag")
        .agg(F.min_by("value", "size").alias("first"), F.max_by("value", "size").alias("last"))
        .groupBy("chart_id", "sign")
        .agg(F.array_sort(F.collect_list(F.struct("mag", "first", "last"))).alias("ladder"))
    )
    lower = F.filter("ladder", lambda g: g["mag"] < F.col("mag"))
    upper = F.filter("ladder", lambda g: g["mag"] > F.col("mag"))
    return near.join(ladder, ["chart_id", "sign"], "left").select(
        "chart_id",
        "n",
        F.coalesce("below", F.try_element_at(lower, F.lit(-1))["last"]).alias("below"),
        F.coalesce("above", F.try_element_at(upper, F.lit(1))["first"]).alias("above"),
    )


def relative_gap(n: Column, cell: Column) -> Column:
    return F.abs(n - cell) / F.greatest(F.abs(cell), F.lit(ZERO))


def best_match(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Best score 1 / (1 + relative gap) of each (chart, value) over the chart's cells of the same sign.

    A cell of the other sign scores 0.5 at most, so the result is the overall best wherever that is above 0.5; the
    thresholds in use are 0.8 and 0.9.
    """
    near = nearest_cells(values, cells)
    gap = F.least(relative_gap(F.col("n"), F.col("below")), relative_gap(F.col("n"), F.col("above")))
    return near.select("chart_id", "n", F.coalesce(1.0 / (1.0 + gap), F.lit(0.0)).alias("best"), gap.alias("gap"))


def parse_calculation(hit: Column, kind: str = "compat") -> Column:
    """Text of one calculation as (stated, expected); expected is null for a division by zero."""
    pattern = calc_pattern(kind)
    number = lambda i: plain_number(group(hit, pattern, i))
    parts = F.struct(number(1).alias("a"), group(hit, pattern, 2).alias("op"), number(3).alias("b"), number(4).alias("stated"))

    def judged(c: Column) -> Column:
        a, b, op = c["a"], c["b"], c["op"]
        expected = (
            F.when(op == "+", a + b)
            .when(op == "-", a - b)
            .when(op.isin("*", "×"), a * b)
            .otherwise(F.try_divide(a, b))
        )
        return F.struct(c["stated"].alias("stated"), expected.alias("expected"))

    return F.transform(F.array(parts), judged)[0]


def calculations(text: Column, kind: str = "compat") -> Column:
    """Calculations in a text as an array of (stated, expected)."""
    return F.transform(every(text, calc_pattern(kind)), lambda hit: parse_calculation(hit, kind))


def calc_ok(c: Column, strict: bool = True) -> Column:
    """Is a calculation right within 5%? Null where it cannot be checked."""
    gap = F.abs(c["stated"] - c["expected"]) / F.abs(c["expected"])
    close = gap < 0.05 if strict else gap <= 0.05
    return F.when(c["expected"] == 0, F.abs(c["stated"]) < 0.01).when(c["expected"].isNotNull(), close)


def arithmetic_terms(span: Column) -> dict[str, Column]:
    """Counts of calculations found, checkable and right."""
    calcs = calculations(span)
    return {
        "n_calcs": F.size(calcs),
        "n_checkable": F.size(F.filter(calcs, lambda c: c["expected"].isNotNull())),
        "n_right": F.size(F.filter(calcs, lambda c: F.coalesce(calc_ok(c), F.lit(False)))),
    }


def with_arithmetic(rows: DataFrame, span: str) -> DataFrame:
    """Rows with ``arithmetic_terms``; the calculations are looked for once a row, as a column of their own."""
    found = rows.withColumn("_calcs", calculations(F.col(span)))
    ok = lambda c: F.coalesce(calc_ok(c), F.lit(False))
    return found.withColumns(
        {
            "n_calcs": F.size("_calcs"),
            "n_checkable": F.size(F.filter("_calcs", lambda c: c["expected"].isNotNull())),
            "n_right": F.size(F.filter("_calcs", ok)),
        }
    ).drop("_calcs")


COUNTS = ["n_numbers", "n_nonzero", "n_match_loose", "n_match_tight"]
SMALL = 64  # cells of a chart up to which its table goes to the responses as an array


def big_charts(cells: DataFrame, column: str = "value") -> DataFrame:
    """Charts (``_big``) with more than SMALL cells where ``column`` is not null, and the number of their values, by counts that combine before they move.

    They come in an exchange of their own: where there are none, the joins with them are dropped before they start.
    """
    counts = cells.groupBy(F.col("chart_id").alias("_big")).agg(F.count(column).alias("_n"), F.count("value").alias("_values"))
    return counts.where((F.col("_n") > SMALL) & F.col("_big").isNotNull()).select("_big", "_values").repartition("_big")


def small_tables(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per chart with numbers that is not marked as a big one: its distinct values."""
    few = cells.select(F.col("chart_id").alias("_chart"), "value").where(F.col("value").isNotNull() & F.col("_chart").isNotNull())
    return few.join(marks, F.col("_chart") == F.col("_big"), "left_anti").groupBy("_chart").agg(F.collect_set("value").alias("_cells"))


def by_size(responses: DataFrame, marks: DataFrame, tables: DataFrame, chart: str) -> tuple[DataFrame, DataFrame]:
    """Responses of small charts with the row of ``tables``, and those of big ones."""
    at = F.col(chart) == F.col("_big")
    small = responses.join(marks, at, "left_anti").join(tables, F.col(chart) == F.col("_chart"), "left").drop("_chart")
    return small, responses.join(marks, at, "left_semi")


def big_cells(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """Cells of the charts that the marks name."""
    return cells.join(marks, F.col("chart_id") == F.col("_big"), "left_semi")


def closest(n: Column, cells: Column) -> Column:
    """Best score of a number over an array of cells, 0 without cells."""
    gap = F.aggregate(cells, F.lit(float("inf")), lambda least, cell: F.least(least, relative_gap(n, cell)))
    equal = (F.abs(n) < float("inf")) & F.array_contains(cells, n)
    return F.when(equal, 1.0).otherwise(F.coalesce(1.0 / (1.0 + gap), F.lit(0.0)))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def sizes(parts: dict[str, Column]) -> Column:
    return F.struct(*[F.size(part).cast("bigint").alias(name) for name, part in parts.items()])


def row_counts(numbers: Column, cells: Column) -> Column:
    """The counts of ``grounding_counts`` for the numbers of one response and the few cells of its chart; null without a text."""

    def counted(found: Column) -> Column:
        live = F.filter(found, lambda n: ~(F.abs(n) < ZERO))
        over = lambda limit: lambda best: F.filter(best, lambda b: b > limit)
        match = lambda best: sizes({"n_numbers": found, "n_nonzero": best, "n_match_loose": over(0.8)(best), "n_match_tight": over(0.9)(best)})
        return F.when(found.isNotNull(), let(F.transform(live, lambda n: closest(n, cells)), match))

    return let(numbers, counted)


def mentioned(span: Column, kind: str = "compat") -> Column:
    """Numbers of a span as an array; likely years are left out."""
    return F.filter(F.transform(every(span, NUMBER_PATTERNS[kind]), plain_number), lambda n: ~is_year(n))


def grounding_counts(responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, span: str) -> DataFrame:
    """Number mentions per response: all, non-zero, and matched at the two thresholds.

    The values of a small chart go to its responses as an array, so that no mention moves; big charts take the nearest-cell join.
    """
    marks = big_charts(cells)
    rows, big = by_size(responses.select(*dict.fromkeys([*keys, chart, span])), marks, small_tables(cells, marks), chart)
    counts = rows.select(*keys, row_counts(mentioned(F.col(span)), F.col("_cells")).alias("c"))
    small = counts.groupBy(*keys).agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS]).where("n_numbers > 0")
    return small.unionByName(mention_counts(big, big_cells(cells, marks), keys, chart, span))


def mention_counts(responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, span: str) -> DataFrame:
    """``grounding_counts`` with one row per mention, for charts of any size."""
    mentions = number_mentions(responses, [*dict.fromkeys([*keys, chart])], span).withColumn("chart_id", F.col(chart))
    zero = F.abs(F.col("n")) < ZERO
    wanted = mentions.where(~zero).select("chart_id", "n").distinct()
    match = best_match(wanted, cells.select("chart_id", "value").distinct())
    return (
        mentions.join(match, ["chart_id", "n"], "left")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_numbers"),
            F.count_if(~zero).alias("n_nonzero"),
            F.count_if(~zero & (F.col("best") > 0.8)).alias("n_match_loose"),
            F.count_if(~zero & (F.col("best") > 0.9)).alias("n_match_tight"),
        )
    )


def process_terms(
    responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, response: str = "response", cut_answer: bool = True
) -> DataFrame:
    """Responses with every count the process rewards are made of.

    The values of a small chart go to its responses as an array, so that no mention moves; big charts take the nearest-cell join.
    """
    counted = [F.coalesce(f"_c.{c}", F.lit(0)).alias(c) for c in COUNTS]
    span = reasoning_span(F.col(response), cut_answer)
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, chart]])
    marks = big_charts(cells)
    small, big = by_size(responses, marks, small_tables(cells, marks), chart)
    small = small.withColumns({"span": span, "has_table": F.col("_cells").isNotNull()})
    small = small.withColumn("_c", F.when(known, row_counts(mentioned(F.col("span")), F.col("_cells")))).select(*responses.columns, "has_table", "span", *counted)
    big = big.withColumns({"span": span, "has_table": F.lit(True)})
    counts = mention_counts(big, big_cells(cells, marks), keys, chart, "span")
    big = big.join(counts.select(*keys, F.struct(*COUNTS).alias("_c")), keys, "left").select(*responses.columns, "has_table", "span", *counted)
    terms = small.unionByName(big).withColumns({"blank": strip(F.col("span")) == "", "span_words": words(F.col("span"))})
    return with_arithmetic(terms, "span").drop("span")


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def arithmetic_lenient() -> Column:
    """Uncheckable calculations count as right; none found is neutral."""
    right = F.col("n_right") + F.col("n_calcs") - F.col("n_checkable")
    return F.when(F.col("n_calcs") == 0, 0.5).otherwise(right / F.greatest("n_calcs", F.lit(1)))


def arithmetic_strict() -> Column:
    """Uncheckable calculations are skipped; none found earns nothing."""
    return ratio("n_right", "n_checkable")


def components() -> dict[str, Column]:
    """Grounding and arithmetic; neutral without a table, zero for empty reasoning."""
    pick = lambda value: F.when(~F.col("has_table"), 0.5).when(F.col("blank"), 0.0).otherwise(value)
    return {
        "grounding": pick(ratio("n_match_loose", "n_nonzero")),
        "arithmetic": pick(arithmetic_lenient()),
    }


def reward_v1() -> Column:
    """Zeros stay in the denominator of the grounding share."""
    value = 0.6 * ratio("n_match_loose", "n_numbers") + 0.4 * arithmetic_lenient()
    return F.when(~F.col("has_table"), 0.5).when(F.col("blank") | (F.col("n_numbers") == 0), 0.0).otherwise(value)


def reward_v2() -> Column:
    value = 0.6 * ratio("n_match_tight", "n_nonzero") + 0.4 * arithmetic_strict()
    none = ~F.col("has_table") | F.col("blank") | (F.col("n_numbers") == 0)
    return F.when(none, 0.0).otherwise(value)


def name_tokens(name: Column) -> Column:
    return F.split(F.lower(strip(name)), r"[\s_/\-]+")


def is_name(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.rlike(r"^\d+$")


def table_entities(cells: DataFrame) -> DataFrame:
    """Distinct name tokens of a chart: column headers and row labels."""
    names = cells.select("chart_id", F.explode(F.array_distinct(F.array("col", "label"))).alias("name"))
    tokens = names.select("chart_id", F.explode(name_tokens(F.col("name"))).alias("token"))
    return tokens.where(is_name(F.col("token"))).distinct()


def named_tables(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per chart that is not marked as a big one: its distinct values and name tokens, null where it has none."""
    few = cells.select(F.col("chart_id").alias("_chart"), "value", "col", "label").where(F.col("_chart").isNotNull())
    sets = few.join(marks, F.col("_chart") == F.col("_big"), "left_anti").groupBy("_chart").agg(*[F.collect_set(c).alias(f"_{c}") for c in ("value", "col", "label")])
    split = F.flatten(F.transform(F.array_union("_col", "_label"), name_tokens))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    return sets.withColumn("_tokens", F.array_distinct(F.filter(split, is_name))).select("_chart", filled("_value").alias("_cells"), filled("_tokens").alias("_names"))


TOKEN = r"[A-Za-z][A-Za-z0-9_'\-]*|" + NUMBER_PATTERNS["compat"]
REACH = 20


def counted_number(token: Column) -> Column:
    """Number of a token; null for words, zero and likely years."""
    number = F.when(token.rlike(r"^[-+]?\d"), plain_number(token))
    return F.when((F.abs(number) >= ZERO) & ~is_year(number), number)


def row_anchors(span: Column, cells: Column, names: Column) -> Column:
    """The counts of ``anchored_counts`` for one response and the few cells and name tokens of its chart; names are looked for about matched numbers only."""

    def count(tokens: Column) -> Column:
        def anchored(at: Column) -> Column:
            first = F.greatest(at - REACH, F.lit(0))
            near = F.slice(tokens, first + 1, at + REACH + 1 - first)
            return names.isNull() | F.exists(near, lambda t: F.coalesce(F.array_contains(names, F.lower(t)), F.lit(False)))

        # signs and digits come before all letters
        placed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"] < "A")
        numbers = F.filter(F.transform(placed, lambda x: F.struct(counted_number(x["t"]).alias("n"), x["i"].alias("i"))), lambda x: x["n"].isNotNull())
        hits = lambda found: F.filter(found, lambda x: (closest(x["n"], cells) > 0.9) & anchored(x["i"]))
        return let(numbers, lambda found: F.when(found.isNotNull(), sizes({"n_mentions": found, "n_anchored": hits(found)})))

    return let(every(span, TOKEN), count)


ANCHORS = ["n_mentions", "n_anchored"]


def anchored_counts(responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, span: str) -> DataFrame:
    """Number mentions per response, and those in the table with an entity token within reach, for charts of any size."""
    tokens = explode_items(responses, [*keys, F.col(chart).alias("chart_id")], every(F.col(span), TOKEN), "pos", "text")
    tokens = tokens.withColumn("token", F.lower("text"))
    entities = table_entities(cells)
    known = entities.withColumn("hit", F.lit(1))
    # only entity tokens and numbers go on: the reach counts positions, so the words between need not move again
    near = Window.partitionBy(*keys).orderBy("pos").rangeBetween(-REACH, REACH)
    mentions = (
        tokens.join(known, ["chart_id", "token"], "left")
        .select(*keys, "chart_id", "pos", counted_number(F.col("token")).alias("n"), "hit")
        .where("n IS NOT NULL OR hit IS NOT NULL")
        .select(*keys, "chart_id", "n", F.max("hit").over(near).alias("anchored"))
        .where("n IS NOT NULL")
    )
    match = best_match(
        mentions.select("chart_id", "n").distinct(), cells.select("chart_id", "value").distinct()
    ).where(F.col("best") > 0.9).select("chart_id", "n", F.lit(1).alias("in_table"))
    named = entities.select("chart_id").distinct().withColumn("named", F.lit(1))
    matched = F.col("in_table").isNotNull() & (F.col("anchored").isNotNull() | F.col("named").isNull())
    return (
        mentions.join(match, ["chart_id", "n"], "left")
        .join(named, "chart_id", "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if(matched).alias("n_anchored"))
    )


def anchored_terms(responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, response: str = "response") -> DataFrame:
    """Responses with anchored grounding, strict arithmetic and the length of the reasoning.

    Values and name tokens of a small chart go to its responses as arrays, so that no token moves; big charts take the joins.
    """
    span = reasoning_span(F.col(response))
    kept = [*responses.columns, "has_table", "span"]
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, chart]])
    # charts count as big by all their cells, so that the names of a small one are few
    marks = big_charts(cells, "chart_id")
    small, big = by_size(responses, marks, named_tables(cells, marks), chart)
    small = small.withColumns({"span": span, "has_table": F.when(F.col("_cells").isNotNull(), True)})
    small = small.withColumn("_c", F.when(known, row_anchors(F.col("span"), F.col("_cells"), F.col("_names"))))
    # a response without a number has no counts
    small = small.select(*kept, *[F.when(F.col("_c.n_mentions") > 0, F.col(f"_c.{c}")).alias(c) for c in ANCHORS])
    valued = marks.where("_values > 0").select("_big", F.lit(True).alias("has_table"))
    big = big.withColumn("span", span).join(valued, F.col(chart) == F.col("_big"), "left").drop("_big")
    counts = anchored_counts(big, big_cells(cells, marks), keys, chart, "span")
    big = big.join(counts, keys, "left").select(*kept, *ANCHORS)
    rows = with_arithmetic(small.unionByName(big).withColumn("span_words", words(F.col("span"))), "span")
    live = F.col("has_table").isNotNull() & (F.coalesce("n_mentions", F.lit(0)) > 0)
    return rows.withColumns(
        {
            "grounding": F.when(live, ratio("n_anchored", "n_mentions")).otherwise(0.0),
            "arithmetic": F.when(live, arithmetic_strict()).otherwise(0.0),
        }
    ).drop("span")


def length_factor(words_used: Column, limit: int = 4096) -> Column:
    used = F.least(F.lit(1.0), words_used / float(max(limit, 1)))
    return F.greatest(F.lit(0.0), 1.0 - used * used)


def length_weighted(limit: int = 4096) -> Column:
    raw = 0.6 * F.col("grounding") + 0.4 * F.col("arithmetic")
    return raw * length_factor(F.col("span_words"), limit)


TAINT_BUCKET = 0.02  # width of a bucket of magnitudes, in natural logarithms


def taint_bounds(numbers: Column) -> Column:
    """Smallest and largest of the numbers in each bucket of magnitudes: they taint just what all of them taint.

    Numbers of one bucket differ by 2 % at most, so what lies within 5 % of any of them is one range, from below the smallest to above the largest.
    Numbers about zero stay as they are.
    """
    size = F.abs
    place = lambda n: F.when(size(n) < 1e-9, n).otherwise(F.signum(n) * (F.floor(F.log(size(n)) / TAINT_BUCKET) + 1e6))
    placed = F.array_sort(F.transform(F.array_distinct(numbers), lambda n: F.struct(place(n).alias("b"), n.alias("n"))))

    def ends(rows: Column) -> Column:
        other = lambda x, i: F.coalesce(F.get(rows, i)["b"] != x["b"], F.lit(True))
        return F.filter(rows, lambda x, i: (i == 0) | other(x, i - 1) | other(x, i + 1))

    return F.transform(F.transform(F.array(placed), ends)[0], lambda x: x["n"])


FEW = 8  # numbers of a sentence up to which they taint as they are


def table_quality(n: Column, cells: Column, sigma: float) -> Column:
    """How near a number is to the nearest of an array of cells, 1 for equal ones; about zero only a cell of zero is near."""
    same = F.array_contains(cells, n)
    gap = F.aggregate(cells, F.lit(float("inf")), lambda least, c: F.least(least, F.when(c != 0, F.abs(n - c) / (F.abs(c) * sigma))))
    zero = F.when((F.abs(n) < 0.01) & F.array_contains(cells, 0.0), 1.0).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.greatest(F.exp(-0.5 * F.pow(gap, F.lit(2.0))), zero))


def sentence_logic(sentence: Column) -> Column:
    """0 where the first calculation of a sentence is off by 5 % or more, else 1."""

    def judged(c: Column) -> Column:
        wrong = F.abs(c["stated"] - c["expected"]) / F.greatest(F.abs(c["expected"]), F.lit(ZERO)) >= 0.05
        return F.when(wrong, 0.0).otherwise(1.0)

    hit = F.array(group(sentence, calc_pattern("compat"), 0))
    return F.when(sentence.contains("=") | sentence.contains("≈"), F.transform(F.transform(hit, lambda h: parse_calculation(h)), judged)[0]).otherwise(1.0)


def fold_taint(chain: Column, numbers, value, logic, quality, fresh) -> Column:
    """Mean reward over an array of sentences; numbers of a failed sentence taint later uses. 0 without a sentence.

    ``numbers`` and ``logic`` read a sentence, ``value`` and ``quality`` one of its numbers, ``fresh`` what the sentence taints.
    """

    def step(state: Column, sentence: Column) -> Column:
        hit = lambda x: F.exists(state["tainted"], lambda t: relative_gap(value(x), t) < 0.05)
        worst = F.array_min(F.transform(numbers(sentence), lambda x: F.when(hit(x), 0.3).otherwise(quality(x))))

        def next_state(reward: Column) -> Column:
            failed = (reward < 0.5) & ~F.exists(numbers(sentence), hit)
            kept = F.when(failed, F.concat(state["tainted"], fresh(sentence))).otherwise(state["tainted"])
            return F.struct(kept.alias("tainted"), (state["total"] + reward).alias("total"), (state["n"] + 1).alias("n"))

        # a sentence without numbers leaves no mark
        return F.when(F.size(numbers(sentence)) == 0, state).otherwise(F.transform(F.array(logic(sentence) * worst), next_state)[0])

    start = F.struct(F.array().cast("array<double>").alias("tainted"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(chain, start, step, lambda s: F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(0.0))


def traced(response: Column) -> Column:
    """Sentences of the think part, longer than five characters."""
    return F.filter(lines_of(F.when(has_think_body(response), think_body(response)).otherwise(F.when(response.isNotNull(), ""))), lambda s: F.length(s) > 5)


def row_taint(response: Column, cells: Column, sigma: float) -> Column:
    """``taint_chain`` of one response and the few cells of its chart."""
    chain = F.transform(traced(response), lambda s: F.struct(F.transform(every(s, NUMBER_PATTERNS["compat"]), plain_number).alias("nums"), s.alias("said")))
    return fold_taint(
        chain,
        lambda s: s["nums"],
        lambda n: n,
        lambda s: sentence_logic(s["said"]),
        lambda n: table_quality(n, cells, sigma),
        lambda s: F.when(F.size(s["nums"]) <= FEW, s["nums"]).otherwise(taint_bounds(s["nums"])),
    )


def taint_chain(responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, sigma: float = 0.1) -> DataFrame:
    """Mean sentence reward where numbers of a failed sentence taint later uses of them; 0 without a table.

    The values of a small chart go to its responses as an array and the chain is a fold inside the row, so that no sentence and no
    number moves; responses of big charts take ``big_taint``. A sentence taints only where it uses nothing tainted, so new values
    lie 5 % away from all older ones, and of its own values ``taint_bounds`` are enough: the set tested against each number is bounded
    by the range of the numbers, not their count.
    """
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, chart]])
    marks = big_charts(cells)
    rows, big = by_size(responses, marks, small_tables(cells, marks), chart)
    value = F.coalesce(F.when(F.col("_cells").isNotNull() & known, row_taint(F.col("response"), F.col("_cells"), sigma)), F.lit(0.0))
    small = rows.withColumn("taint", value).select(*responses.columns, "taint")
    scored = big.join(big_taint(big, big_cells(cells, marks), keys, chart, sigma), keys, "left").select(*responses.columns, "taint")
    return small.unionByName(scored.withColumn("taint", F.coalesce("taint", F.lit(0.0))))


def big_taint(responses: DataFrame, cells: DataFrame, keys: list[str], chart: str, sigma: float) -> DataFrame:
    """Taint per response on charts of any size: the table quality of every number comes from the nearest-cell join."""
    pattern = NUMBER_PATTERNS["compat"]
    said = explode_items(responses, [*keys, F.col(chart).alias("chart_id")], traced(F.col("response")), "at", "sentence")
    numbers = explode_items(said, [*keys, "chart_id", "at"], every(F.col("sentence"), pattern), "pos", "_t").select(*keys, "chart_id", "at", "pos", plain_number(F.col("_t")).alias("n"))
    near = nearest_cells(numbers.select("chart_id", "n").distinct(), cells.select("chart_id", "value").distinct())
    decay = lambda cell: F.when(cell == 0, F.when(F.abs("n") < 0.01, 1.0).otherwise(0.0)).otherwise(
        F.exp(-0.5 * F.pow(F.abs(F.col("n") - cell) / (F.abs(cell) * sigma), F.lit(2.0)))
    )
    zero_tables = cells.where("value = 0").select("chart_id").distinct().withColumn("zero", F.lit(1))
    none = F.lit(0.0)
    quality = F.greatest(
        F.coalesce(decay(F.col("below")), none),
        F.coalesce(decay(F.col("above")), none),
        F.when(F.col("zero").isNotNull() & (F.abs("n") < 0.01), 1.0).otherwise(0.0),
    )
    near = near.join(zero_tables, "chart_id", "left").select("chart_id", "n", quality.alias("q"))
    per_sentence = (
        numbers.join(near, ["chart_id", "n"], "left")
        .groupBy(*keys, "at")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "q"))).alias("nums"))
        .join(said.select(*keys, "at", sentence_logic(F.col("sentence")).alias("logic")), [*keys, "at"])
    )
    ordered = per_sentence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "nums", "logic"))).alias("chain"))
    taint = fold_taint(
        F.col("chain"), lambda s: s["nums"], lambda x: x["n"], lambda s: s["logic"], lambda x: F.coalesce(x["q"], F.lit(0.0)),
        lambda s: taint_bounds(F.transform(s["nums"], lambda x: x["n"])),
    )
    return ordered.select(*keys, taint.alias("taint"))


def qa_checks(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Calculations of the reasoning steps per question: how many, all right, last stated value."""
    calcs = explode_items(steps, [*keys, "step_idx"], calculations(F.col("text"), "wide"), "pos", "c")
    calcs = calcs.where(F.col("c.expected").isNotNull())
    found = calcs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calcs"),
        F.bool_and(calc_ok(F.col("c"), strict=False)).alias("all_right"),
        F.max_by(F.col("c.stated"), F.struct("step_idx", "pos")).alias("last_stated"),
    )
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps")).join(found, keys, "left")


def last_agrees(answer: Column) -> Column:
    """Does the last stated value agree with the answer? True when nothing was computed."""
    gap = F.abs(F.col("last_stated") - answer) / F.greatest(F.abs(answer), F.lit(ZERO))
    return F.when(F.col("last_stated").isNull(), True).when(answer == 0, F.abs("last_stated") < 0.01).otherwise(gap <= 0.05)


def qa_verified(answer: Column) -> Column:
    """Strict check: numeric answer in bounds, agreeing, with at least one calculation, all right."""
    in_bounds = (F.abs(answer) <= 10000) & (F.abs(answer) >= 0.001)
    ok = in_bounds & last_agrees(answer) & F.col("all_right") & (F.col("n_calcs") > 0)
    return F.coalesce(ok, F.lit(False))


def qa_reason(answer: Column, has_table: Column) -> Column:
    return (
        F.when(~has_table, "no_csv")
        .when(F.coalesce("n_steps", F.lit(0)) == 0, "no_steps")
        .when(answer.isNull(), "non_numeric_answer")
        .when(~last_agrees(answer), "final_answer_vs_computation_mismatch")
        .when(F.col("n_calcs").isNull(), "no_computations_in_steps")
        .when(F.col("all_right"), "computations_verified")
        .otherwise("computation_mismatch")
    )
