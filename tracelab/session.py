"""Session settings shared by tests, bench and users."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "tracelab", **conf: str) -> SparkSession:
    """A session with adaptive execution on; every setting can be overridden by ``conf``.

    The number of shuffle partitions is left to the cluster: adaptive execution merges small ones but cannot add any.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/tracelab-{uuid.uuid4().hex}"


def checkpoint(df):
    """Cut lineage through the shared folder; see ``shared_folder``."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
