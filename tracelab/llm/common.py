"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.session import shared_folder

#: Word patterns are written for white space only: blank and the five control characters below.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def shipped(name: str) -> None:
    """Send a module's task functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps reuse it and no lost executor recomputes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch of whole texts holds, so that a Python worker's memory does not grow with the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def split_words(text: Column) -> Column:
    """Words between white space; an empty array for a text without one."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii_text(column: Column) -> Column:
    """As ``lower_ascii``, by the quick way for texts of ASCII alone."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(lower_ascii(column))


#: DuckDB tables for an unsigned CRC-32: the 256 remainders by their rule, as one list ``tab``.
CRC_SQL = """
crc_step(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB expression of the CRC-32 of a text's UTF-8 bytes; ``crc.tab`` must be in scope."""
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda a, b: xor(a >> 8, crc.tab[(xor(a, b) & 255) + 1])), 4294967295)"
