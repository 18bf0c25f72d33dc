"""Structured Streaming forms of the append, resume and telemetry loops."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a file stream; new files with that name pattern are picked up."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run_available(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all available input to Parquet and stop; the checkpoint makes a restart go on where it ended."""
    query = (
        rows.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _run_batches(rows: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    query = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, on disk; the session's own setting comes back afterwards."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def dedupe_available(rows: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each key once, however late it comes; a null is a key like others.

    The keys seen are state, hashed over the shuffle partitions and kept on disk below the checkpoint, so a batch looks up its own keys and
    never reads the output. There is no watermark: no key is dropped as late. The file sink commits whole batches, so a repeated batch
    adds nothing.
    """
    with rocksdb_state(rows.sparkSession):
        return run_available(rows.dropDuplicates([key]), out, checkpoint)


def totals_available(moments: DataFrame, out: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Keep an aggregate in ``out``, one partition per group (``keys``, the window's start first).

    Each batch gets the new totals of the groups it touched (update mode) and replaces just their partitions, windows still open
    included. A partition is one group, whole in the batch, so a batch that is repeated after a failure writes the same again and
    a failure between batches leaves the table of the last one.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.repartition(*keys).write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").parquet(out)

    with rocksdb_state(moments.sparkSession):
        return _run_batches(moments, write, checkpoint, "update")


def reward_windows(events: DataFrame, time: str, kind: str, reward: str, window: str = "1 day") -> DataFrame:
    """Moments of the reward per time window and reward type: ``window_start, <kind>, n, reward_sum, reward_m2, n_correct``.

    The state is one row per window and type. ``reward_m2`` is the sum of squared distances from the window's mean.
    """
    value = F.col(reward)
    return (
        events
        .groupBy(F.window(time, window).alias("w"), kind)
        .agg(
            F.count(value).alias("n"),
            F.sum(value).alias("reward_sum"),
            (F.var_pop(value) * F.count(value)).alias("reward_m2"),
            F.count_if(value >= 0.95).alias("n_correct"),
        )
        .select(F.col("w.start").alias("window_start"), kind, "n", "reward_sum", "reward_m2", "n_correct")
    )


def merged_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of coarser groups from those of finer ones: longer windows, or all types together."""
    mean = F.try_divide("reward_sum", "n")
    # squared distances add up, plus those of the parts' means from the common mean
    between = F.sum(F.col("n") * mean * mean) - F.try_divide(F.sum("reward_sum") * F.sum("reward_sum"), F.sum("n"))
    return moments.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("reward_sum").alias("reward_sum"), F.greatest(F.sum("reward_m2") + between, F.lit(0.0)).alias("reward_m2"), F.sum("n_correct").alias("n_correct")
    )


def telemetry(moments: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, reward_mean, reward_std, frac_correct`` from moments."""
    per = lambda c: F.try_divide(c, "n")
    return moments.select(*keys, "n", per("reward_sum").alias("reward_mean"), F.sqrt(per("reward_m2")).alias("reward_std"), per("n_correct").alias("frac_correct"))
