"""Session set-up, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Rows of one Arrow batch that holds whole texts: a worker's memory then doesn't grow with a partition.
TEXT_ROWS = 256


def build_session(app: str = "veil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; the caller's own settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # text rows are few bytes but much work: do not fold small shuffles into one task
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one that is named, else a part of the warehouse."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so reruns cannot mix."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the frame to the shared folder and read it back: survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """`df` as it is; Arrow batches of its session hold at most so many rows from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))
    return df
