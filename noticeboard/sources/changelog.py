"""A document table as a compacted base plus a log of change batches.

``base-...`` folders hold whole tables, ``changes/batch_id=N`` the batches, and
``versions`` one small row per base: the last batch it contains and its folder. That
row is written after its base, so readers see the old base with all its batches
or the new one with those that came later, never a mixture. Batches that a base
contains are not read any more; they and the bases before are deleted one
compaction later, when nobody should be reading them.

One writer appends and compacts; any number of readers may read meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeboard.operators.common import first_per_key
from noticeboard.session import remove

#: Of a base that contains no batch.
NO_BATCH = -1
VERSION = T.StructType([T.StructField("upto", T.LongType()), T.StructField("base", T.StringType()), T.StructField("made", T.LongType())])


def fold_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after all changes: within a batch deletes come first, later batches win."""
    order = [F.col("batch_id").desc(), F.col("op").desc(), F.col("seq").desc()]
    last = first_per_key(changes, ["id"], order)
    kept = base.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.filter("op = 'upsert'").select(*base.columns))


def versions(spark: SparkSession, table: str) -> list:
    """All versions, newest first: one row per compaction that was not cleaned away."""
    try:
        rows = spark.read.schema(VERSION).json(f"{table}/versions").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r.upto, r.made), reverse=True)


def _publish(spark: SparkSession, table: str, upto: int, base: str, made: int) -> None:
    row = spark.createDataFrame([(upto, base, made)], VERSION)
    row.coalesce(1).write.mode("append").json(f"{table}/versions")


def create(rows: DataFrame, table: str) -> None:
    """Write the first base. Run again after a failure, it writes another one and points to that."""
    base = f"base-{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{base}")
    spark = rows.sparkSession
    _publish(spark, table, NO_BATCH, base, len(versions(spark, table)))


def base(spark: SparkSession, table: str) -> DataFrame:
    """The newest base, without the batches after it."""
    return spark.read.parquet(f"{table}/{versions(spark, table)[0].base}")


def append(changes: DataFrame, table: str, batch_id: int) -> None:
    """Store a batch; the same batch run again after a failure overwrites itself."""
    changes.write.mode("overwrite").parquet(f"{table}/changes/batch_id={batch_id}")


def later_changes(spark: SparkSession, table: str, schema: T.StructType, upto: int) -> DataFrame:
    """Batches after ``upto``; the folders of others are pruned."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(full).parquet(f"{table}/changes").filter(F.col("batch_id") > upto)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def current(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table now. ``schema`` is that of the changes: the columns of the base, ``op`` and ``seq``."""
    newest = versions(spark, table)[0]
    base = spark.read.parquet(f"{table}/{newest.base}")
    return fold_changes(base, later_changes(spark, table, schema, newest.upto))


def compact(spark: SparkSession, table: str, schema: T.StructType) -> int:
    """Write the table of now as the next base and point to it; returns the last batch in it."""
    known = versions(spark, table)
    later = later_changes(spark, table, schema, known[0].upto)
    upto = later.agg(F.max("batch_id")).first()[0]
    if upto is None:
        return known[0].upto
    base = f"base-{uuid.uuid4().hex}"
    old = spark.read.parquet(f"{table}/{known[0].base}")
    fold_changes(old, later.filter(F.col("batch_id") <= upto)).write.parquet(f"{table}/{base}")
    _publish(spark, table, upto, base, known[0].made + 1)
    _clean(spark, table, known)
    return upto


def _clean(spark: SparkSession, table: str, known: list) -> None:
    """Delete what only versions before the one just replaced need."""
    for version in known[1:]:
        remove(spark, f"{table}/{version.base}")
    if known[0].upto > NO_BATCH:
        ids = spark.read.schema(T.StructType([T.StructField("batch_id", T.LongType())])).parquet(f"{table}/changes")
        for row in ids.filter(F.col("batch_id") <= known[0].upto).distinct().collect():
            remove(spark, f"{table}/changes/batch_id={row.batch_id}")
