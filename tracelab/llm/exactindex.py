"""Exact deduplication on an extendible-hash index in shared files."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import lower_ascii_text, plain_text, staged
from tracelab.session import shared_folder

CAPACITY = 8 << 20  # bytes of different texts in a bucket before it splits
SPLITS = 4  # doublings beyond the first depth; a bucket still overfull then holds giant texts and overflows
HOT = 1000  # a hash with more than one row in HOT is merged before it moves; there are at most HOT of them
BROADCAST_SLOTS = 1 << 20
BITS = 64  # of the hash; tests lower it to force collisions


def hashed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, body, h`` and columns ``more``: the text in lower case (A-Z only; null as empty) and its hash."""
    body = docs.select("doc_id", lower_ascii_text(plain_text()).alias("body"), *more)
    return body.withColumn("h", F.shiftleft(F.xxhash64("body"), 64 - BITS) if BITS < 64 else F.xxhash64("body"))


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash as a number."""
    return F.shiftrightunsigned(F.col("h"), 64 - depth) if depth else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Index:
    """An index of different texts.

    ``directory`` (slot, bucket, local_depth) has 2**depth slots, of which those without a text have no row; a bucket of a lesser depth has several. ``entries`` has one row per
    text: ``bucket, h, chain, chained, body, keep_id, group_size, text_sha256``. Equal hashes of different texts are a
    chain, numbered from 0 by their bytes; ``chained`` is its length. Each owner task wrote one file, in key order.
    """

    depth: int
    directory: DataFrame
    entries: DataFrame


def split_buckets(keys: DataFrame, first: int, capacity: int) -> tuple[int, DataFrame]:
    """The directory for ``keys`` (h, bytes; one row per hash), and its depth.

    The directory starts with 2**first slots. Buckets above the capacity that hold more than one hash split at the next bit, which
    doubles the directory where they were as deep as it; only keys of split buckets are counted again. Ends when none is
    overfull, or after SPLITS rounds.
    """
    open_keys, depth, settled = keys, first, []
    while True:
        loads = staged(open_keys.groupBy(prefix(depth).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "bucket-loads")
        full = (F.col("bytes") > capacity) & (F.col("n") > 1) & F.lit(depth < first + SPLITS)
        settled.append((depth, loads.where(~full)))
        split = loads.where(full).select("bucket")
        if split.isEmpty():
            break
        open_keys = open_keys.withColumn("bucket", prefix(depth)).join(split, "bucket", "left_semi").drop("bucket")
        depth += 1
    parts = []
    for local, loads in settled:
        slots = F.expr(f"sequence(shiftleft(bucket, {depth - local}), shiftleft(bucket + 1, {depth - local}) - 1)")
        # a bucket is named by its first slot
        parts.append(loads.select(F.explode(slots).alias("slot"), F.shiftleft("bucket", depth - local).alias("bucket"), F.lit(local).alias("local_depth")))
    directory = parts[0]
    for part in parts[1:]:
        directory = directory.unionByName(part)
    return depth, staged(directory, "directory")


def build(docs: DataFrame, light: DataFrame, capacity: int = CAPACITY) -> Index:
    """Index of all texts of ``docs``; ``light`` is ``doc_id, h, bytes`` of the same rows, staged.

    Key ranges (equal first bits) belong to owner tasks. Every text moves once, to its owner, which chains the texts of one hash and
    compares their bytes. Rows of a hash with more than one row in HOT are grouped by hash and text before they move,
    so a group with a third of all rows is a row per task.
    """
    spark = docs.sparkSession
    keys = staged(light.groupBy("h").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "hash-keys")
    total = keys.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    first = max(1, math.ceil(math.log2(max(2.0, (total["bytes"] or 0) / capacity))))
    depth, directory = split_buckets(keys, first, capacity)
    hot = keys.where(F.col("rows") > max(1, (total["rows"] or 0) // HOT)).select("h")
    rows = hashed(docs)
    grouped = [F.max("top").alias("top"), F.sum("rows").alias("rows")]
    single = lambda df: df.select("h", "body", F.col("doc_id").alias("top"), F.lit(1).cast("bigint").alias("rows"))
    cold = single(rows.join(F.broadcast(hot), "h", "left_anti"))
    merged = single(rows.join(F.broadcast(hot), "h", "left_semi")).groupBy("h", "body").agg(*grouped)
    slots = directory.withColumnRenamed("slot", "_slot")
    if depth <= math.log2(BROADCAST_SLOTS):
        slots = F.broadcast(slots)
    placed = cold.unionByName(merged).withColumn("owner", prefix(first)).repartition(1 << first, "owner")
    one = placed.groupBy("owner", "h", "body").agg(*grouped)
    chain = Window.partitionBy("owner", "h")
    one = one.withColumn("chain", F.row_number().over(chain.orderBy("body")) - 1).withColumn("chained", F.count(F.lit(1)).over(chain))
    one = one.join(slots, prefix(depth) == F.col("_slot"))
    entries = one.select(
        "bucket", "h", "chain", "chained", "body", F.col("top").alias("keep_id"), F.col("rows").alias("group_size"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")
    )
    path = f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}"
    entries.write.parquet(path, compression="zstd")
    return Index(depth, directory, spark.read.schema(entries.schema).parquet(path))


def found(docs: DataFrame, light: DataFrame, index: Index) -> DataFrame:
    """Every row of ``light`` with its text's entry: ``doc_id, h, chain, keep_id, group_size, text_sha256``.

    A hash with one text in the index needs no text: all rows with it were compared there. Rows of chained hashes are
    compared with the chain's bytes.
    """
    columns = ["chain", "keep_id", "group_size", "text_sha256"]
    alone = index.entries.where("chained = 1").select("h", *columns)
    out = light.join(alone, "h").select("doc_id", "h", *columns)
    chained = index.entries.where("chained > 1").select("h", "body", *columns)
    if chained.isEmpty():
        return out
    again = hashed(docs).join(chained.select("h").distinct(), "h", "left_semi").join(chained, ["h", "body"])
    return out.unionByName(again.select("doc_id", "h", *columns))


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, h, chain, keep_id, group_size, kept, text_sha256``.

    ``kept`` marks the rows with the largest id of their text. Null text: as the empty one. A null ``doc_id`` counts in its group but stays
    only where no row of the group has an id (``keep_id`` null). Rows that repeat id and text are the same document: all are
    marked, ``deduplicated`` returns one. Further columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    light = staged(hashed(docs).select("doc_id", "h", F.octet_length("body").cast("bigint").alias("bytes")), "hashes")
    out = found(docs, light, build(docs, light, capacity))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``."""
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with their own columns; of rows that repeat id and text the first by all columns."""
    kept = groups(docs, capacity).where("kept").groupBy("doc_id", "h").agg((F.max("group_size") > 1).alias("more"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "more")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = hashed(docs.select("doc_id", "text", own.alias("_row")), "_row")
    rows = rows.join(kept, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = rows.where("more").groupBy("body", "doc_id").agg(F.min("_row").alias("_row"))
    once = once.groupBy("body").agg(F.max(F.struct("doc_id", "_row")).alias("s")).select("s._row")
    return rows.where("not more").select("_row").unionByName(once).select("_row.*")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size, sha256(body) AS text_sha256 FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (body)
"""
