"""Trace segmentation, step statistics and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.text import explode_items, group, lines_of, or_empty, strip, sub, words

# Discourse markers that open a step when they start a line.
STEP_MARKERS = [
    r"\bstep\s*\d+", r"\bfirst,", r"\bnext,", r"\bnow,", r"\bso,", r"\bfinally,", r"\bwait[,\s]", r"\bhmm[,\s]",
    r"\blet['s]me", r"\blet['s]",
]
MARKER_SPLIT = r"(?i)\n(?=" + "|".join(STEP_MARKERS) + ")"
SENTENCE_SPLIT = r"(?<=[.!?])\s+(?=[A-Z])"


def thinking_text(content: Column, reasoning: Column) -> Column:
    """Reasoning channel unless blank or an error, else the think body, else the content."""
    body = r"(?s)<think>(.*?)</think>"
    usable = (or_empty(reasoning) != "") & ~or_empty(reasoning).startswith("ERROR")
    said = or_empty(content)
    return F.when(usable, strip(reasoning)).when(said.rlike(body), strip(group(said, body))).otherwise(strip(said))


def pack(pieces: Column, joiner: str, fits, glue: int = 0) -> Column:
    """Greedy packing of pieces into chunks: a piece joins the open chunk while ``fits`` allows.

    ``pieces`` are structs of text and length; ``fits(open_length, piece_length)`` decides.
    """
    start = F.struct(
        F.array().cast("array<struct<text:string,len:int>>").alias("done"),
        F.lit(None).cast("string").alias("text"),
        F.lit(0).alias("len"),
    )

    def step(state: Column, piece: Column) -> Column:
        joins = state["text"].isNotNull() & fits(state["len"], piece["len"])
        opened = F.struct(state["text"].alias("text"), state["len"].alias("len"))
        done = F.when(joins | state["text"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(opened)))
        text = F.when(joins, F.concat(state["text"], F.lit(joiner), piece["text"])).otherwise(piece["text"])
        size = F.when(joins, state["len"] + piece["len"] + glue).otherwise(piece["len"])
        return F.struct(done.alias("done"), text.alias("text"), size.alias("len"))

    def finish(state: Column) -> Column:
        last = F.array(F.struct(state["text"].alias("text"), state["len"].alias("len")))
        return F.when(state["text"].isNull(), state["done"]).otherwise(F.concat(state["done"], last))

    return F.aggregate(pieces, start, step, finish)


def measured(texts: Column, length=words) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), length(t).cast("int").alias("len")))


def segment_steps(
    df: DataFrame, text: str, out: str, low: int = 80, high: int = 560, separator: str = "\n\n", length=words, split_at: str | None = None
) -> DataFrame:
    """Steps of a trace: blocks merged forward below ``low``, split at sentences above ``high``.

    Blocks are joined by ``separator`` and cut at it, or at the pattern ``split_at``. Both passes are folds over one trace's own blocks, so nothing is shuffled.
    """
    blocks = F.filter(F.transform(F.split(F.col(text), split_at or separator), strip), lambda b: b != "")
    df = df.withColumn("_blocks", measured(blocks, length))
    df = df.withColumn("_merged", pack(F.col("_blocks"), separator, lambda a, b: a + b < low))
    split = F.transform(
        "_merged",
        lambda m: F.when(m["len"] <= high, F.array(m)).otherwise(
            pack(measured(F.split(m["text"], SENTENCE_SPLIT), length), " ", lambda a, b: a + b <= high)
        ),
    )
    return df.withColumn(out, F.flatten(split)).drop("_blocks", "_merged")


BLANK_LINE = r"\n\s*\n"


def before_answer(text: Column) -> Column:
    """The trace without its final answer: from the first mention of one to the end."""
    return strip(sub(text, r"(?is)\b(?:final answer|the answer is).*$"))


def split_by_markers(df: DataFrame, text: str, out: str, most: int | None = None) -> DataFrame:
    """Split at marker lines, else pack sentences to about 200 characters; the long parts, or the first ``most`` of them."""
    # the very first piece counts one character more: packing starts from a blank
    sentences = F.transform(
        F.split("_flat", r"(?<=[.?!])\s+"),
        lambda t, i: F.struct(t.alias("text"), (F.length(t) + (i == 0).cast("int")).alias("len")),
    )
    packed = F.transform(pack(sentences, " ", lambda a, b: a + b <= 200, glue=1), lambda p: p["text"])
    df = df.withColumn("_flat", F.replace(F.col(text), F.lit("\n\n"), F.lit("\n")))
    df = df.withColumn("_marked", F.split("_flat", MARKER_SPLIT))
    df = df.withColumn("_parts", F.when(F.size("_marked") >= 2, F.col("_marked")).otherwise(packed))
    long = F.filter(F.transform("_parts", strip), lambda p: F.length(p) > 15)
    return df.withColumn(out, long if most is None else F.slice(long, 1, most)).drop("_flat", "_marked", "_parts")


def cumulative_prefix(steps: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Where each step begins and ends in its trace (steps joined by a line feed): ``start, prefix_chars``.

    The prefix up to a step is the trace's first ``prefix_chars`` characters. Writing all prefixes out would take the square of
    a trace's length, so only offsets are kept; a running sum holds one row at a time.
    """
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(text).cast("bigint")
    end = F.sum(size + 1).over(window) - 1
    return steps.withColumn("prefix_chars", end).withColumn("start", F.col("prefix_chars") - size)


def length_summary(rows: DataFrame, keys: list[str], length: str, name: str) -> DataFrame:
    """Percentiles of an integer length per group, from its histogram of distinct values."""
    hist = rows.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("w"))
    cuts = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    found = F.percentile(length, F.array(*[F.lit(q) for q in cuts.values()]), F.col("w"))
    out = hist.groupBy(*keys).agg(
        F.sum("w").alias(f"{name}_n"), F.min(length).alias(f"{name}_min"), F.max(length).alias(f"{name}_max"), found.alias("_q")
    )
    return out.select(
        *keys, f"{name}_n", f"{name}_min", f"{name}_max",
        *[F.round(F.col("_q")[i], 6).alias(f"{name}_{c}") for i, c in enumerate(cuts)],
    )


def quality_gates(traces: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Six checks on step lengths, counts and endings. ``traces`` has n_steps, ``steps`` len and terminal."""
    lengths = length_summary(steps, keys, "len", "len")
    counts = length_summary(traces.where("n_steps > 0"), keys, "n_steps", "steps")
    shares = steps.groupBy(*keys).agg(
        F.round(F.avg(F.col("terminal").cast("double")), 6).alias("terminal_rate"),
        F.round(F.avg((F.col("len") < 30).cast("double")), 6).alias("tiny_rate"),
    )
    single = traces.groupBy(*keys).agg(F.round(F.avg((F.col("n_steps") <= 1).cast("double")), 6).alias("single_rate"))
    joined = lengths.join(counts, keys).join(shares, keys).join(single, keys)
    checks = [
        F.col("len_p50").between(150, 500),
        F.col("len_p90") <= 700,
        F.col("steps_p50").between(3, 12),
        F.col("terminal_rate") >= 0.75,
        F.col("tiny_rate") <= 0.10,
        F.col("single_rate") <= 0.15,
    ]
    passed = sum(c.cast("int") for c in checks)
    return joined.select(
        *keys, "len_p50", "len_p90", "steps_p50", "terminal_rate", "tiny_rate", "single_rate", passed.alias("passed")
    ).withColumn("verdict", F.when(F.col("passed") == 6, "PASS").when(F.col("passed") >= 4, "CONDITIONAL").otherwise("FAIL"))


def trace_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines of a text as steps."""
    rows = explode_items(df, keys, lines_of(F.col(text)), "step", "step_text")
    return rows.withColumns({"len": words(F.col("step_text")), "terminal": F.col("step_text").rlike(r"[.!?]$")})


def pilot(traces: DataFrame, order: str, keys: list[str], n: int, continuations: int = 8) -> DataFrame:
    """The first ``n`` traces with steps, by ``order``: per group how many were picked and left, their steps and the continuations to score.

    The last picked place is found by a top-n, whose tasks keep ``n`` rows each; the rest is one grouped sum. ``order`` should be
    unique: all rows of the last place are picked.
    """
    valid = traces.where("n_steps > 0")
    last = valid.select(order).orderBy(order).limit(n).agg(F.max(order).alias("_last"), F.lit(1).alias("_one"))
    picked = F.coalesce(F.col(order) <= F.col("_last"), F.lit(False))
    steps = F.coalesce(F.sum(F.when(picked, F.col("n_steps"))), F.lit(0)).cast("bigint")
    # one row joins on a constant key
    rows = valid.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")
    return rows.groupBy(*keys).agg(
        F.count_if(picked).alias("n_picked"), F.count_if(~picked).alias("n_left"), steps.alias("n_steps"), (steps * continuations).alias("n_continuations")
    )
