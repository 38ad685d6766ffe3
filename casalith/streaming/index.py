"""Incremental index maintenance: new observations become postings batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def postings(documents: DataFrame) -> DataFrame:
    """(token, subject_id, n): how often each token stands in each document's body."""
    each = documents.select("subject_id", F.explode(tokens(F.col("body"))).alias("token"))
    return each.groupBy("token", "subject_id").agg(F.count("*").alias("n"))


def maintain(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends the postings of each micro-batch under path, by batch_id; a batch that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_counts(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Runs by status and event-time window; rows later than the watermark don't count any more."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
