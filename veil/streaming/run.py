"""Draining a stream into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from veil.session import scratch_path


def drain(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Process everything available and return what was emitted.

    Append output goes to parquet; update and complete output is written per micro-batch, of which the
    newest row per key is the caller's to take (`batch` column).
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        query = writer.outputMode(mode).foreachBatch(_keep(out)).start()
        schema = stream.schema.add("batch", "long")
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", mode != "append").parquet(out)


def _keep(path: str) -> Callable[[DataFrame, int], None]:
    from pyspark.sql import functions as F

    def write(batch: DataFrame, number: int) -> None:
        # one folder per batch number: a replayed batch replaces itself
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number}")

    return write
