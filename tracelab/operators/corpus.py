"""Corpus preparation: contamination, sampling, overrides, quality rules, rendering."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.text import or_empty, strip
from tracelab.operators.scale import first_rows

# Six disjoint bit blocks of a 64-bit fingerprint. Two fingerprints at a distance of four or
# less agree on at least two blocks, so every close pair shares one of the fifteen block pairs.
BLOCKS = [11, 11, 11, 11, 10, 10]


def sign_blocks(vector: Column) -> dict[str, Column]:
    """Sign bits of a 64-component vector, packed into block integers."""
    out, start = {}, 1
    for b, size in enumerate(BLOCKS):
        part = F.slice(vector, start, size)
        out[f"b{b}"] = F.aggregate(part, F.lit(0), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))
        start += size
    return out


def bit_blocks(bits: list[Column]) -> dict[str, Column]:
    """As ``sign_blocks`` for 64 bit columns."""
    out, start = {}, 0
    for b, size in enumerate(BLOCKS):
        value = F.lit(0)
        for bit in bits[start : start + size]:
            value = value * 2 + bit
        out[f"b{b}"] = value
        start += size
    return out


NAMES = [f"b{b}" for b in range(len(BLOCKS))]


def fingerprint_classes(items: DataFrame, key: str, name: str) -> DataFrame:
    """Equal fingerprints as one class: the blocks, ``<name>_class`` (smallest key) and ``n_<name>``, the number of its items."""
    return items.groupBy(*NAMES).agg(F.min(key).alias(f"{name}_class"), F.count(F.lit(1)).alias(f"n_{name}"))


def class_members(items: DataFrame, key: str, name: str) -> DataFrame:
    """``<key>, <name>_class`` of every item."""
    return items.join(fingerprint_classes(items, key, name), NAMES).select(key, f"{name}_class")


def near_pairs(train: DataFrame, test: DataFrame, limit: int = 5) -> DataFrame:
    """Pairs of a train and a test class within Hamming distance ``limit`` - 1: blocks of the train side as ``a_b*``, the other columns, ``distance``.

    Both sides have one row per distinct fingerprint, so however many items share one it is compared once. With the members of each class
    the pairs give every pair of items; they are not written out.
    """
    a, b = train, test

    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        keys = [
            F.struct(F.lit(i).alias("pair"), F.col(NAMES[x]).alias("x"), F.col(NAMES[y]).alias("y"))
            for i, (x, y) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
        renamed = [F.col(n).alias(f"{prefix}{n}") for n in NAMES]
        rest = [F.col(c) for c in df.columns if c not in NAMES]
        return df.select(*renamed, *rest, F.explode(F.array(*keys)).alias("_k")).select("*", "_k.*").drop("_k")

    pairs = keyed(a, "a_").join(keyed(b, "t_"), ["pair", "x", "y"])
    same = [F.col(f"a_{n}") == F.col(f"t_{n}") for n in NAMES]
    # a pair that agrees on several block pairs counts at the first of them only
    first = F.lit(-1)
    for i, (x, y) in reversed(list(enumerate(combinations(range(len(BLOCKS)), 2)))):
        first = F.when(same[x] & same[y], i).otherwise(first)
    distance = sum(F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"t_{n}"))) for n in NAMES)
    return pairs.where((F.col("pair") == first) & (distance < limit)).withColumn("distance", distance)


def near_fingerprints(train: DataFrame, test: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct train fingerprints near a test fingerprint: their blocks, the smallest distance and the number of test items in reach."""
    close = near_pairs(train.select(*NAMES).distinct(), test.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n_test")), limit)
    return close.groupBy(*[F.col(f"a_{n}").alias(n) for n in NAMES]).agg(
        F.min("distance").alias("distance"), F.sum("n_test").alias("n_test")
    )


def simhash_bits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit simhash over the words (letters and digits of any script) of a text, as blocks; texts without a word are left out."""
    words = docs.select(key, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+")).alias("w")).where("w <> ''")
    half = lambda i: F.conv(F.substring(F.col("_md5"), 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i}")
    hashed = words.withColumn("_md5", F.md5("w")).select(key, half(0), half(1))
    # every word votes where it stands: its text's votes are summed before they move, so no word does. Two votes share one sum, one in each
    # half of a number; a text has fewer than 2**31 words
    bit = lambda h, i: F.shiftright(h, i).bitwiseAND(F.lit(1))
    summed = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(bit("h0", i) + F.shiftleft(bit("h1", i), 32)).alias(f"v{i}") for i in range(32)])
    votes = [F.col(f"v{i}").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(32)] + [F.shiftright(f"v{i}", 32) for i in range(32)]
    return summed.select(key, *[c.alias(n) for n, c in bit_blocks([(2 * v > F.col("n")).cast("int") for v in votes]).items()])


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The same ``n`` rows per stratum in every run: first in md5 order of the key."""
    keyed = rows.withColumn("_o", F.md5(F.col(key).cast("string")))
    return first_rows(keyed, [stratum], ["_o", key], n).drop("_o")


def sft_reason(image: Column, question: Column, answer: Column, source: Column | None = None, only: list[str] | None = None) -> Column:
    """First reason to drop a training row, or ``kept``; ``only`` names the sources to take."""
    other = F.lit(False) if only is None else ~F.coalesce(source.isin(only), F.lit(False))
    return (
        F.when(other, "filtered_source")
        .when(or_empty(image) == "", "missing_image")
        .when((or_empty(question) == "") | (strip(or_empty(answer)) == ""), "missing_qa")
        .otherwise("kept")
    )


def reasoning_text(value: Column) -> Column:
    """One text from a JSON value (a variant) that is a text in one row and a list in the next.

    Items of a list that are neither null nor empty stand one per line; null, a missing field and an empty list give the empty text, anything else
    its own text.
    """
    items = F.try_variant_get(value, "$", "array<string>")
    listed = F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), "\n")
    own = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    return F.when(F.coalesce(F.is_variant_null(value), F.lit(True)), "").when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(own)


def entity_pairs(lines: DataFrame, chart: str, line: str, fields: str, number) -> DataFrame:
    """(chart, entity, value) from the lines of chart tables, their first line the header; both shapes in one input.

    A header of two columns makes a long table: the row's label names the entity. A wider one makes a wide table: ``label (column)``, or
    whichever of the two is not blank. ``number`` reads a cell; cells without a number, behind the header's end or without a name are left out. A
    table is known by its header alone, which joins its rows, so no table is gathered.
    """
    header = lines.where(F.col(line) == 0).select(chart, F.col(fields).alias("_h"))
    body = lines.where(F.col(line) > 0).join(header, chart)
    cells = body.select(chart, "_h", strip(F.get(fields, F.lit(0))).alias("_row"), F.posexplode(fields).alias("_at", "_raw"))
    cells = cells.where((F.col("_at") > 0) & (F.col("_at") < F.size("_h"))).withColumn("value", number(F.col("_raw")))
    column = strip(F.get("_h", F.col("_at")))
    row = or_empty(F.col("_row"))
    wide = F.when((row != "") & (column != ""), F.concat(row, F.lit(" ("), column, F.lit(")"))).otherwise(F.concat(row, column))
    entity = F.when(F.size("_h") == 2, row).otherwise(wide)
    return cells.select(chart, entity.alias("entity"), "value").where("value IS NOT NULL AND entity <> ''")


def override(base: DataFrame, better: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Take ``fields`` from the last matching row of ``better``; rows without a match stay."""
    last = better.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), order).alias("_b"), F.count(F.lit(1)).alias("n_versions")
    )
    joined = base.join(last, keys, "left")
    return joined.select(
        *base.columns, F.col("_b").isNotNull().alias("overridden"), *[F.col(f"_b.{f}").alias(f) for f in fields]
    )


def quality_rule(family: Column, reasoning_len: Column, answer: Column, kind: Column, match: Column) -> Column:
    """First failing quality rule of a distilled row, or ``kept``."""
    museum = family == "chartmuseum"
    return (
        F.when(reasoning_len < 150, "R1_reasoning_too_short")
        .when(museum & (F.length(answer) > 200), "R2_answer_body_long")
        .when(museum & F.contains(answer, F.lit("\n")), "R3_answer_body_multiline")
        .when((kind == "numeric") & ~match, "R4a_numeric_mismatch")
        .when((kind == "multichoice") & ~match, "R4b_choice_mismatch")
        .otherwise("kept")
    )


# Prompt texts that training rows carry.
SINGLE_WORD = "\nAnswer the question with a single word."
CHOICE_HINT = "\nAnswer with the value or name of the chosen option."


def number_hint(answer: Column) -> Column:
    """Decimals a numeric answer asks for."""
    decimals = F.length(F.substring_index(answer, ".", -1)).cast("string")
    plain = F.lit("* Your final answer must be a number.")
    exact = F.concat(F.lit("* Your final answer must be a number with "), decimals, F.lit(" decimal places."))
    return F.when(answer.rlike(r"^-?\d*\.\d+$"), exact).otherwise(plain)


def user_text(question: Column, family: Column, answer: Column, kind: Column) -> Column:
    """Question as each answer family asks it."""
    numeric = (kind == "numeric") | answer.rlike(r"^-?[\d,.\s%]+$")
    choice = F.when(kind == "multichoice", F.concat(question, F.lit(CHOICE_HINT))).otherwise(question)
    return (
        F.when(family == "chartqa", F.concat(question, F.lit(SINGLE_WORD)))
        .when((family == "charxiv") & numeric, F.concat(question, F.lit("\n"), number_hint(answer)))
        .when(family == "charxiv", F.concat(question, F.lit("\n* Answer in the words of the chart.")))
        .when(family == "chartmuseum", F.concat(F.lit("Think first, then answer in tags.\n"), choice))
        .otherwise(F.raise_error(F.concat(F.lit("unknown answer family: "), F.coalesce(family, F.lit("null")))))
    )


def assistant_text(reasoning: Column, family: Column, answer: Column) -> Column:
    """Reasoning in think tags and the answer in the family's form."""
    thought = F.concat(F.lit("<think>\n"), strip(or_empty(reasoning)), F.lit("\n</think>\n"))
    tagged = F.concat(F.lit("<answer>"), answer, F.lit("</answer>"))
    return F.concat(thought, F.when(family == "chartmuseum", tagged).otherwise(answer))


def messages(user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", user), turn("assistant", assistant))
