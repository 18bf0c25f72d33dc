"""Quality rules: document statistics and a decision list learned from labelled statistics by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import plain_text, split_words, staged

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # hundredths of the words

#: Rates per word or character that a rule may test, and the cut points it may test them at.
RATES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1) / 20",
}
CUTS = [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def with_statistics(docs: DataFrame) -> DataFrame:
    """Counts over the whole text, per row and in the JVM; ``docs`` needs a column ``text``.

    Repeated three-word windows are found inside the row: every window's hash is packed with its position (as many low
    bits as the text needs), the numbers are sorted, and equal neighbours are compared word by word. Rows without
    two equal hashes skip that part.
    """
    text = plain_text()
    at = lambda i: f"_w[{i}], _w[{i} + 1], _w[{i} + 2]"
    same = lambda i, j: f"({i} >= 0 and {j} < size(_s) and struct({at(f'int(_s[{i}] & _mask)')}) = struct({at(f'int(_s[{j}] & _mask)')}))"
    return (
        docs.withColumn("_t", text)
        .withColumn("_w", split_words(F.col("_t")))
        .withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("_h", F.expr(f"if(n_words < 3, array(), transform(sequence(0, int(n_words) - 3), i -> xxhash64({at('i')})))"))
        .withColumn("_bits", F.expr("int(ceil(log2(n_words + 1)))"))
        .withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
        .withColumn("_twice", F.expr("size(array_distinct(_h)) < size(_h)"))
        .withColumn("_s", F.expr("if(_twice, sort_array(transform(_h, (h, i) -> (h & ~_mask) | i)), array())"))
        .withColumn(
            "_p",
            F.expr(f"sort_array(transform(filter(sequence(0, size(_s)), i -> i < size(_s) and ({same('i - 1', 'i')} or {same('i', 'i + 1')})), i -> _s[i] & _mask))"),
        )
        .withColumn(
            "n_repeat_words",
            F.expr("aggregate(_p, struct(0L as n, -3L as last), (s, p) -> struct(s.n + least(3L, p - s.last) as n, p as last)).n"),
        )
        .withColumn("word_chars", F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("bigint"))
        .withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint"))
        .withColumn("_lines", F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumn("n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_dup_lines", F.expr("bigint(size(_lines) - size(array_distinct(_lines)))"))
        .withColumn("n_distinct", F.size(F.array_distinct("_w")).cast("bigint"))
        .withColumn("n_upper", (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint"))
        .withColumn("n_marks", (F.length("_t") - F.length(F.translate("_t", "!?", ""))).cast("bigint"))
        .withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
        .drop("_t", "_w", "_h", "_bits", "_mask", "_twice", "_s", "_p", "_lines")
    )


@dataclass(frozen=True)
class Test:
    """One threshold of a rule: ``rate >= cut`` or ``rate < cut``."""

    rate: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({RATES[self.rate]}) {'>=' if self.above else '<'} {self.cut!r}"


def _counts(rows: DataFrame) -> dict[tuple[str, bool, float], tuple[int, int]]:
    """Good and bad rows on either side of every cut, from one grouped count over (rate, bin)."""
    bins = [F.struct(F.lit(r).alias("rate"), F.col(f"bin_{r}").alias("bin")) for r in RATES]
    got = rows.select("quality", F.explode(F.array(*bins)).alias("x")).groupBy("x.rate", "x.bin", "quality").count().collect()
    out = {}
    for rate in RATES:
        for above in (True, False):
            for k, cut in enumerate(CUTS):
                own = [r for r in got if r["rate"] == rate and (r["bin"] > k) == above]
                out[rate, above, cut] = tuple(sum(r["count"] for r in own if r["quality"] == q) for q in (1, 0))
    return out


def _pair(rows: DataFrame) -> tuple[int, int]:
    got = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    return got.get(1, 0), got.get(0, 0)


def _held(tests: list[Test]) -> Column:
    """The rule's condition over binned rates."""
    out = F.lit(True)
    for t in tests:
        side = F.col(f"bin_{t.rate}") > CUTS.index(t.cut)
        out = out & (side if t.above else ~side)
    return out


def smoothed(good: int, bad: int, prior: float) -> float:
    """Share of bad rows, drawn towards ``prior`` by one row's weight."""
    return (bad + prior) / (good + bad + 1)


def share(good: int, bad: int) -> float:
    return bad / max(1, good + bad)


def learn_rules(
    stats: DataFrame, labels: DataFrame, most_tests: int = 3, precision: float = 0.97, sure: float = 0.8, least_share: float = 0.002
) -> list[list[Test]]:
    """Ordered rules that reject documents, from all labelled rows.

    ``stats`` has ``doc_id`` and the counts of ``with_statistics``; ``labels`` has ``doc_id, quality`` (1 good, 0 bad, null
    ignored). Two thirds of the labelled rows (by a hash of the id) grow rules, one third prunes them. A rule grows by
    the threshold with the largest information gain of bad rows (FOIL), at most ``most_tests``; then tests are dropped from
    its end while the pruning rows' smoothed share of bad rows does not fall. It is kept if on both parts the share of bad rows
    is at least ``precision``, smoothed at least ``sure`` (so a few rows prove nothing), and it covers ``least_share`` of
    the growing rows; covered rows leave, and the next rule starts. A rule that misses is refused: its rows are set aside for growing, so that
    a purer kind of bad rows behind it still gets a rule. Ends when the bad growing rows left are too few for a rule, or none gains. Only
    grouped counts reach the driver: at most (rates x cuts x labels) rows a step.
    """
    binned = {f"bin_{r}": F.expr(" + ".join(f"int(({e}) >= {c!r})" for c in CUTS)) for r, e in RATES.items()}
    rows = stats.where("not base_failed").join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    grow = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(9)) < 6
    rows = staged(rows.select("quality", grow.alias("grow"), *[e.alias(n) for n, e in binned.items()]), "labelled")
    rules: list[list[Test]] = []
    refused: list[list[Test]] = []
    any_of = lambda some: reduce(lambda a, b: a | b, [_held(rule) for rule in some], F.lit(False))
    while True:
        left = rows.where(~any_of(rules))
        growing = left.where(F.col("grow") & ~any_of(refused))
        now = total = _pair(growing)
        if total[1] < max(3, precision * least_share * sum(total)):
            break
        prior, tests = total[1] / sum(total), []
        while len(tests) < most_tests and now[0]:
            sides = _counts(growing.where(_held(tests)))
            base = smoothed(*now, prior)
            gain = lambda c: (c[1] * math.log2(smoothed(*c, prior) / base) if c[1] else 0.0)
            key, value = max(sides.items(), key=lambda kv: (gain(kv[1]), kv[0][1], -CUTS.index(kv[0][2]), kv[0][0]))
            if gain(value) <= 0:
                break
            tests, now = [*tests, Test(*key)], value
        pruning = left.where("not grow")
        kept = [(_pair(pruning.where(_held(tests[:n]))), n) for n in range(1, len(tests) + 1)]
        if not kept:
            break
        best, n = max(kept, key=lambda x: (round(smoothed(*x[0], prior), 6), -x[1]))
        on_grow = _pair(growing.where(_held(tests[:n])))
        if min(share(*best), share(*on_grow)) < precision or min(smoothed(*best, prior), smoothed(*on_grow, prior)) < sure or sum(on_grow) < max(3, least_share * sum(total)):
            refused.append(tests[:n])
        else:
            rules.append(tests[:n])
    return rules


def rule_column(rules: list[list[Test]]) -> Column:
    """Number of the first rule that rejects, from 1; null where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        held = F.expr(" and ".join(t.sql() for t in rule))
        out = F.when(held, i) if out is None else out.when(held, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Test]]]:
    """All rows of ``docs`` (``doc_id, text``) with statistics, ``rule`` and ``kept``, and the learned rules.

    Null text: like an empty one, all counts 0, fails the base. Null ``doc_id``: judged, but no label teaches
    from it. Repeated ids: each row judged by itself. Without usable labels no rule is learned and the base decides alone.
    """
    stats = staged(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = learn_rules(stats, labels)
    out = stats.withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the base counts, ``base_failed``, the rejecting ``rule`` and ``kept``."""
    return judge(docs, labels)[0].select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    The rows are staged once beside their statistics, so texts are read once and never shuffled.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    stats = staged(with_statistics(whole).drop("text"), "statistics")
    rules = learn_rules(stats, labels)
    return stats.where(~F.col("base_failed") & rule_column(rules).isNull()).select("_row.*")
