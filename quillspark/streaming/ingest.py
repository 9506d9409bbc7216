"""Submissions and events as they arrive: Structured Streaming over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.text import accession_number
from quillspark.operators.convert import convert


def new_submissions(arriving: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first arrival of every accession number; state is dropped once it is older than the delay."""
    keyed = arriving.withColumn("accession", accession_number(F.col("path"))).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["accession"])


def write_converted(arriving: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Converts every batch of new submissions and appends it as Parquet; the batch id in the path makes a rerun overwrite its own output."""

    def put(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return new_submissions(arriving).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events per user and session; sessions are final once the watermark has passed them."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return ts.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n_events")
