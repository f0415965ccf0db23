"""Streaming: incremental slices, graph upserts by micro-batch, debounced refreshes, event rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.browse import upsert


def unseen_slices(slices: DataFrame, delay: str | None = None, time: str = "ts") -> DataFrame:
    """O1: each slice id once; with a delay the state of ids older than the watermark is dropped."""
    if delay is None:
        return slices.dropDuplicates(["id"])
    return slices.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def ingest(slices: DataFrame, path: str, checkpoint: str):
    """O1: appends slices whose id is not in the output table yet; what is processed is known from the output, not from the stream's state."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["id"])
        try:
            done = spark.read.schema(df.schema).parquet(path).select("id")
            fresh = fresh.join(done, "id", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.select(*df.columns).write.mode("append").parquet(path)

    return slices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_graph(changes: DataFrame, path: str, checkpoint: str, keys: list[str], schema: str):
    """O2: each micro-batch is merged into the table by key; versions are written side by side and the last one counts."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        old = spark.read.schema(schema).parquet(f"{path}/v{epoch - 1}") if epoch else spark.createDataFrame([], schema)
        merged = upsert(old, df.dropDuplicates(keys).select(*old.columns), keys)
        merged.drop("_state").write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame) -> DataFrame:
    """Events whose ts can carry a watermark: a time without zone is read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, gap: str = "3 seconds", delay: str = "10 seconds", by: str = "event_type") -> DataFrame:
    """O3: one row for each burst: events of a key less than ``gap`` apart."""
    return timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "events")


def rollup(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and window."""
    return timed(events).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "events")


def streamed(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], where: str, files: int = 1) -> DataFrame:
    """Runs a transformation over the files of a folder as a stream until all are read, and returns what it wrote."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = transform(stream)
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")
