"""Request logs and progress lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(entries: DataFrame, path: str, ts: str = "ts") -> None:
    """Append entries to folders of their type and hour.

    Tasks take ranges of time, so an hour with very many entries is shared by
    several tasks and the others leave one file per folder.
    """
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hourly = entries.withColumn("hour", F.date_format(ts, "yyyyMMdd_HH")).repartitionByRange(tasks, ts)
    hourly.write.mode("append").partitionBy("log_type", "hour").json(path)


def progress_lines(steps: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return steps.select(F.to_json(F.struct("*")).alias("value"))


def write_progress(steps: DataFrame, path: str) -> None:
    progress_lines(steps).write.mode("overwrite").text(path)
