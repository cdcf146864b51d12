"""Streams over request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "1 hour"


def hourly_counts(logs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Entries per type and hour; an hour closes once the watermark has passed it."""
    return (
        logs.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), "log_type")
        .agg(F.count("*").alias("n"))
        .select("log_type", F.col("w.start").alias("hour"), "n")
    )


def log_stream(logs: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Store the changed counts of every batch; counts only grow, so the largest is current."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        hourly_counts(logs, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("log_type", "hour").agg(F.max("n").alias("n"))


def dedupe_stream(rows: DataFrame, key: str, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """First row of each key; copies must arrive within the lateness."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet in append mode."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def dropped_rows(done: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, by the progress of a finished run."""
    return sum(op["numRowsDroppedByWatermark"] for p in done.recentProgress for op in p["stateOperators"])


def state_rows(done: StreamingQuery) -> list[int]:
    """Rows held in state after each batch of a finished run."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in done.recentProgress if p["stateOperators"]]
