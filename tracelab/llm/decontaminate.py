"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import shipped, small_batches, staged

shipped(__name__)

WINDOW = 10  # consecutive item words of a test string
SLOTS = 1 << 21  # slots of the shift table of one length, a byte each
MAP_BITS = 1 << 26  # bits of the map of test strings
ROWS = 4096  # rows that a task hands on at once
SALTS = 8  # parts of a test string's occurrences

#: A-Z become lower case, digits, a-z and bytes of other letters stay, everything else separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _block(words: list[bytes], at: int, length: int) -> int:
    """Hash of the block of two words (one in test strings of a word) that ends at ``at``."""
    return zlib.crc32(b" ".join(words[at - min(2, length) : at]))


def _frames(rows, columns: list[str]):
    """Data frames of ``ROWS`` rows."""
    rows = iter(rows)
    while part := list(islice(rows, ROWS)):
        yield pd.DataFrame(part, columns=columns)


def strings_of(benchmark: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Windows of the items: ``item, length, bucket, window, blocks``.

    ``window`` is the words with blanks between; ``blocks`` the slots of its blocks from first to last, ``bucket`` the last one.
    """

    def cut(frames):
        def rows():
            for frame in frames:
                for item, text in frame.itertuples(index=False):
                    words = words_of(text)
                    length = min(len(words), WINDOW)
                    first = min(2, length)
                    blocks = [_block(words, end, length) % slots for end in range(first, len(words) + 1)] if length else []
                    for i in range(len(words) - length + 1 if length else 0):
                        own = blocks[i : i + length - first + 1]
                        yield item, length, own[-1], b" ".join(words[i : i + length]).decode(), own

        return _frames(rows(), ["item", "length", "bucket", "window", "blocks"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items.mapInPandas(cut, "item string, length int, bucket int, window string, blocks array<int>")


class Tables:
    """Shift tables by length of the test strings, and a bit map of their hashes: of one size whatever the benchmark holds."""

    def __init__(self, strings: DataFrame, slots: int, bits: int):
        self.slots, self.bits = slots, bits
        far = F.col("length") - F.least(F.lit(2), F.col("length"))
        places = strings.select("length", far.alias("far"), F.posexplode("blocks").alias("place", "slot"))
        shifts = places.groupBy("length", "slot").agg(F.min(F.col("far") - F.col("place")).alias("shift")).toArrow()
        length, slot, shift = [shifts.column(i).to_numpy() for i in range(3)]
        self.shifts: dict[int, bytes] = {}
        for m in sorted(set(length.tolist())):
            of = np.full(slots, m - min(2, m) + 1, dtype=np.uint8)
            of[slot[length == m]] = shift[length == m]
            self.shifts[m] = of.tobytes()
        bit = F.pmod(F.crc32(F.col("window").cast("binary")), F.lit(bits))
        marks = strings.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mark")).toArrow()
        known = np.zeros(bits // 64, dtype="<i8")
        known[marks.column(0).to_numpy()] = marks.column(1).to_numpy()
        self.known = known.tobytes()

    def search(self, words: list[bytes]):
        """Places where a test string may lie: ``start, end, bucket, window``; true ones are never missed."""
        n, slots, bits, known = len(words), self.slots, self.bits, self.known
        for m, shift in self.shifts.items():
            at = m
            while at <= n:
                slot = _block(words, at, m) % slots
                step = shift[slot]
                if step:
                    at += step  # no test string can end before
                    continue
                window = b" ".join(words[at - m : at])
                bit = zlib.crc32(window) % bits
                if known[bit >> 3] >> (bit & 7) & 1:
                    yield at - m, at, slot, window.decode()
                at += 1


def _candidates(texts: DataFrame, tables: Tables) -> DataFrame:
    """``digest, start, end, bucket, window`` of possible occurrences in ``texts`` (``digest, text``)."""

    def look(frames):
        rows = ((digest, *place) for frame in frames for digest, text in frame.itertuples(index=False) for place in tables.search(words_of(text)))
        return _frames(rows, ["digest", "start", "end", "bucket", "window"])

    return texts.mapInPandas(look, "digest binary, start bigint, end bigint, bucket int, window string")


def covered(spans: Column) -> Column:
    """Words inside at least one of the spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"),
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256))


def _n_words() -> Column:
    count = F.pandas_udf(lambda texts: pd.Series([len(words_of(t)) for t in texts], dtype="int64"), "bigint")
    return count.asNondeterministic()(F.col("text").cast("string"))  # else the optimizer may repeat it


def _may_hold(tables: Tables) -> Column:
    """Whether a text has a candidate at all."""
    look = F.pandas_udf(lambda texts: pd.Series([any(True for _ in tables.search(words_of(t))) for t in texts], dtype="bool"), "boolean")
    return look.asNondeterministic()(F.col("text").cast("string"))


def prepared(benchmark: DataFrame, slots: int = SLOTS, bits: int = MAP_BITS) -> tuple[DataFrame, Tables]:
    """The benchmark's test strings, written to the shared folder, and the tables over them.

    Spark cuts the items and reduces them to shift tables of hashed blocks (``slots`` bytes for each of at most ten lengths) and a
    map of ``bits`` bits. Only these go to the tasks, so nothing that grows with the benchmark passes through the driver.
    """
    strings = staged(strings_of(benchmark, slots), "test-strings")
    return strings, Tables(strings, slots, bits)


def occurrences(docs: DataFrame, strings: DataFrame, tables: Tables) -> DataFrame:
    """Texts of ``docs`` that hold a test string: ``_digest`` (sha256 of the text), ``_n_hit``, ``_items``; one row for equal texts.

    One pass over the texts gives candidates. Fuller tables give more of them, never other results: a candidate
    meets the test strings of its suffix bucket in a join, which compares the words themselves. Occurrences of one
    test string are dealt over ``SALTS`` parts, and equal texts count once, so frequent passages are spread.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(_digest().alias("digest"), F.col("text").cast("string").alias("text")).where("text is not null")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).alias("salt")
    places = _candidates(texts, tables).distinct().select("*", salt)
    owners = strings.groupBy("bucket", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    hits = places.join(owners, ["salt", "bucket", "window"]).groupBy("digest")
    hits = hits.agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    found = hits.select(
        F.col("digest").alias("_digest"), covered(F.col("spans")).alias("_n_hit"), F.array_sort(F.array_distinct("items")).alias("_items")
    )
    return staged(found, "benchmark-hits")


def _free(docs: DataFrame, names: list[str]) -> list[str]:
    """The names with as many underscores before them as it takes to differ from every column."""
    lead = ""
    while any(c.lower().startswith(lead + "_") for c in docs.columns):
        lead += "_"
    return [lead + name for name in names]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, name: str = "found", slots: int = SLOTS, bits: int = MAP_BITS) -> DataFrame:
    """Add a struct column ``name``: ``n_words, n_hit, items`` (sorted distinct item ids as text).

    A document word inside any occurrence of a test string counts once. Null or empty texts have no
    words; null item texts no test strings; a null ``item_id`` counts for hits but is not listed; repeated items count once.
    All columns of ``docs`` stay; a column called ``name`` is replaced. Texts move only if the caller still asks for them.
    """
    found = occurrences(docs, *prepared(benchmark, slots, bits))
    digest, n_hit, items, n_words = _free(docs, [*found.columns, "_n_words"])
    joined = docs.withColumns({digest: _digest(), n_words: _n_words()}).join(found.toDF(digest, n_hit, items), digest, "left")
    result = F.struct(
        F.col(n_words).alias("n_words"),
        F.coalesce(n_hit, F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
    )
    return joined.withColumn(name, result).drop(digest, n_hit, items, n_words)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, slots: int = SLOTS, bits: int = MAP_BITS) -> DataFrame:
    """Documents without any benchmark window, with their own columns.

    Documents without a candidate stay where they are; only the others meet the list of hit texts.
    """
    strings, tables = prepared(benchmark, slots, bits)
    found = occurrences(docs, strings, tables)
    digest, flag = _free(docs, ["_digest", "_flag"])
    marked = docs.withColumn(flag, _may_hold(tables))
    doubtful = marked.where(F.col(flag)).withColumn(digest, _digest()).join(found.select(F.col("_digest").alias(digest)), digest, "left_anti")
    return marked.where(~F.col(flag)).drop(flag).union(doubtful.drop(digest, flag))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM bp),
ms AS (SELECT DISTINCT m FROM bw),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM dp),
h AS (SELECT DISTINCT doc_id, m, i, item_id FROM dw JOIN bw USING (m, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
