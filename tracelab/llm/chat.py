"""Chat formatting in budgeted windows of whole turns, with a loss mask over each assistant text once."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import shipped, staged

shipped(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUDGET, HISTORY = 1024, 256  # tokens of a window, and of the turns that it repeats
FRAME = 4  # tokens that the template adds to a turn
BLOCK = 64  # turn numbers that are summed together before the sums are added up
#: The template: head of a turn, role, line feed, text, end of a turn.
HEAD, END = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    """Reversible: no text holds a raw ``#`` or ``<`` afterwards, so no text can open or close a turn."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    head, *rest = text.split("\\\\")
    plain = [p.replace("\\h", "#").replace("\\l", "<").replace("\\n", "\n") for p in [head, *rest]]
    return "\\".join(plain)


def tokenizer(path: str = VOCABULARY):
    """Column function: tokens of a text, by a public byte-level vocabulary that the driver reads and sends along."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    built: list = []
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def count(texts: pd.Series) -> pd.Series:
        if not built:
            import tiktoken

            built.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return pd.Series([len(built[0].encode_ordinary(t)) for t in texts], dtype="int64")

    return F.pandas_udf(count, "bigint").asNondeterministic()


def windows(conversations: DataFrame, count_tokens, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows: ``conv_id, window, formatted, turns, first_new, loss``.

    Prefix sums of turn tokens (template included) place every turn on the conversation's token line. The line is cut into strides of
    ``budget - history - system`` tokens (with a long system turn a quarter of the budget, or what the system turn leaves, at least 1);
    turns that lie in one stride form a window, and a turn that crosses into the next stride has a window of its own. So a window's new
    turns fit the stride without a scan over the conversation. Each later window repeats the system turn (a conversation's first turn,
    if its role is ``system``) and, before the new turns, the latest turns of at most ``history`` tokens and no more than system turn and
    new turns leave of the budget. Turns are never cut and the system turn always stays: a window is longer than the budget only if
    it holds one new turn that does not fit beside the system turn, and then it has no history. ``first_new`` is the index
    of the first new turn among ``turns``; ``loss`` lists the spans (code points of ``formatted``) of new assistant texts, so every
    assistant text is a target exactly once.

    Sums run per block of ``BLOCK`` turn numbers and then over the blocks, so a conversation with a third of all rows is
    split over many tasks; the join of later steps is by (conversation, window), a bounded group. Turns are in order of turn,
    role, text. Null texts and roles are empty; a null turn comes first; null ``conv_id`` rows are one conversation; repeated rows are turns of their own.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # a key that is never null, so that joins are plain
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("bigint"))
    rows = staged(rows.withColumn("tokens", count_tokens("text") + FRAME), "turns")
    inside = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("key").orderBy("block")
    blocks = rows.groupBy("key", "block").agg(
        F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("count"), F.min(F.struct("turn", "role", "text", "tokens")).alias("first")
    )
    blocks = blocks.select(
        "key",
        "block",
        F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_at"),
        F.first(F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0)).over(order).alias("system"),
    )
    line = (
        rows.withColumn("row", F.row_number().over(inside))
        .withColumn("sum", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .join(blocks, ["key", "block"])
        .withColumn("at", F.col("base_at") + F.col("row") - 1)
        .withColumn("start", F.col("base") + F.col("sum"))
        .withColumn("end", F.col("start") + F.col("tokens"))
        .withColumn("room", F.lit(budget) - F.col("system"))
        .withColumn("stride", F.greatest(F.col("room") - history, F.least(F.lit(budget // 4), F.col("room")), F.lit(1)))
        .withColumn("s", F.floor(F.col("start") / F.col("stride")))
        .withColumn("crosses", (F.floor((F.col("end") - 1) / F.col("stride")) > F.col("s")).cast("int"))
        .withColumn("window", 2 * F.col("s") + F.col("crosses"))
        .select("key", "conv_id", "role", "text", "at", "start", "end", "tokens", "window", "system")
    )
    line = staged(line, "line")
    starts = line.groupBy("key", "window").agg(
        F.min("start").alias("first_start"),
        F.min("at").alias("first_at"),
        F.least(F.lit(history), F.lit(budget) - F.max("system") - F.sum("tokens")).alias("allowed"),
    )
    # a turn can only be history of the windows in its own stride and the next one
    own = line.withColumn("new", F.lit(True))
    later = F.expr("filter(sequence(window + 1, 2 * int(window div 2) + 3), w -> w > window)")
    past = line.where((F.col("tokens") <= history) & ~((F.col("at") == 0) & (F.col("system") > 0)))
    past = past.withColumn("window", F.explode(later)).withColumn("new", F.lit(False))
    near = (F.col("end") <= F.col("first_start")) & (F.col("first_start") - F.col("start") <= F.col("allowed"))
    members = own.unionByName(past).join(starts, ["key", "window"]).where(F.col("new") | near)
    system = line.where("at = 0 and system > 0").select("key", "conv_id", "role", "text", "at", "start", "end", "tokens", "system")
    repeated = system.join(starts.where("first_at > 0"), "key").withColumn("new", F.lit(False))
    turn = F.struct(
        "at",
        "new",
        F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
        (F.col("new") & (F.col("role") == "assistant")).alias("target"),
    )
    grouped = members.unionByName(repeated.select(members.columns)).groupBy("key", "conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    width = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def add(s, t):
        low = s["at"] + F.length(t["head"])
        span = F.array(F.struct(low.alias("start"), (low + F.length(t["body"])).alias("end")))
        return F.struct((s["at"] + width(t)).alias("at"), F.when(t["target"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size("t").alias("turns"),
        F.size(F.filter("t", lambda t: ~t["new"])).alias("first_new"),
        F.aggregate("t", begin, add)["spans"].alias("loss"),
    )


def _read_back(batches):
    """Per window: the new turns as the digest takes them, the masked texts, and their counts, read from the formatted text."""
    for batch in batches:
        out = []
        for conv, window, formatted, first_new, spans in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            turns = []
            for part in formatted.split(END)[first_new:-1]:
                role, _, text = part[len(HEAD) :].partition("\n")
                turns.append(f"{unescaped(role)}\n{unescaped(text)}\n")
            masked = "".join(unescaped(formatted[s["start"] : s["end"]]) for s in spans)
            out.append([conv, window, len(turns), len(masked), len(formatted), "".join(turns), masked])
        yield _batch(out, _PARTS)


def _digests(batches):
    """Digests and sums over the windows of a conversation, which come sorted by conversation and window."""
    now, state = None, None

    def row():
        turns, loss, counts = state
        return [now[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]

    for batch in batches:
        out = []
        for conv, _, n_turns, n_loss, n_formatted, turns, masked in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            if now != (conv,):
                if now is not None:
                    out.append(row())
                now, state = (conv,), (hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
            state[0].update(turns.encode())
            state[1].update(masked.encode())
            for i, n in enumerate((n_turns, n_loss, n_formatted)):
                state[2][i] += n
        yield _batch(out, _REPORT)
    if now is not None:
        yield _batch([row()], _REPORT)


_PARTS = {"conv_id": "bigint", "window": "bigint", "n_turns": "bigint", "n_loss": "bigint", "n_formatted": "bigint", "turns": "string", "masked": "string"}
_REPORT = {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}


def _kind(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _batch(rows: list[list], columns: dict[str, str]) -> pa.RecordBatch:
    kinds = [pa.int64() if kind == "bigint" else pa.string() for kind in columns.values()]
    values = list(zip(*rows)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], list(columns))


def report(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per conversation, read back from its windows: turns, their digest, masked characters, their digest, formatted characters.

    Windows are read back wherever they are, also those of a conversation with a third of all rows. A digest runs over a conversation in order,
    so one task hashes what was read from its windows; it holds one batch at a time and does nothing else.
    """
    made = windows(conversations, tokenizer(vocabulary))
    parts = made.select("conv_id", F.col("window").cast("bigint"), "formatted", "first_new", "loss").mapInArrow(_read_back, _kind(_PARTS))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_digests, _kind(_REPORT))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose two texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
