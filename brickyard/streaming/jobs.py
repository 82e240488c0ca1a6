"""Incremental passes as Structured Streaming jobs.

Every job runs with ``availableNow``: it takes what has arrived since the last pass (the
checkpoint remembers), then stops, like a scheduled run. Give each job its own checkpoint
folder on shared storage. For large key sets use the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.operators.clean import canonicalize


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType,
                max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def run_append(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Append everything that has arrived to a parquet table, exactly once."""
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path).awaitTermination()


def ingest(raw: DataFrame, path: str, checkpoint: str) -> None:
    """Canonicalise new raw records and append them by source and market."""
    run_append(canonicalize(raw), path, checkpoint, ["source", "market"])


def admit_once(df: DataFrame, keys: list[str], event_time: str | None = None,
               horizon: str | None = None) -> DataFrame:
    """First occurrence of every key across passes.

    Without a horizon a key is remembered for ever; with one only for that long after its
    event time, which bounds the state.
    """
    if horizon is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def funnel(df: DataFrame, event_time: str, source: str, late: str = "1 day",
           every: str = "1 day") -> DataFrame:
    """Counts per source and tumbling window; windows older than the lateness are closed."""
    return (df.withWatermark(event_time, late)
            .groupBy(F.window(event_time, every).alias("w"), F.col(source).alias("source"))
            .agg(F.count("*").alias("found"))
            .select(F.col("w.start").alias("window_start"), "source", "found"))


def run_update(df: DataFrame, path: str, checkpoint: str) -> None:
    """Keep every changed aggregate row with the number of the batch that changed it.

    A batch that is repeated after a failure overwrites its own folder.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    (df.writeStream.outputMode("update").foreachBatch(save)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current aggregate rows written by :func:`run_update`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return (spark.read.parquet(path).withColumn("_rn", F.row_number().over(w))
            .filter("_rn <= 1").drop("_rn", "batch"))


def consolidate(raw: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every pass of new raw records to a merge function (batch job)."""
    (raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
