"""Streaming over the append-only event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import shared_dir, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``(window_start, event_type, n)``: counts per window, closed once the watermark has passed it."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote; the last state of each group counts."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    keys = [c for c in stream.columns if c != "n"]
    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows/*")
    return rows.groupBy(*keys).agg(F.max_by("n", "epoch").alias("n"))
