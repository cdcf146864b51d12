"""Document tables bucketed by id, maintained and looked up bucket by bucket.

The number of its bucket is also the partition (``slot``) of a row, so each slot
folder holds one sorted file of exactly one bucket. Joins on id need no shuffle of the table,
changes rewrite the slots they touch and no others, and a lookup of known ids opens
only their slots, where Parquet bloom filters and sorted ids skip what does not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.operators.common import first_per_key, small_side

KEY, SLOT = "id", "slot"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def slot_of(key: Column, buckets: int) -> Column:
    """The bucket in which Spark puts a row with this id."""
    return F.pmod(F.hash(key), F.lit(buckets))


def buckets_of(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)


def create(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write rows with distinct ids as a table at ``path``. Choose as many buckets as give files of some hundred MB."""
    spread = rows.withColumn(SLOT, slot_of(F.col(KEY), buckets)).repartition(buckets, KEY)
    writer = spread.write.partitionBy(SLOT).bucketBy(buckets, KEY).sortBy(KEY).option("path", path)
    writer.option(f"parquet.bloom.filter.enabled#{KEY}", "true").saveAsTable(name)


def rows_of(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(SLOT)


def changed_rows(spark: SparkSession, name: str, changes: DataFrame, order: str) -> tuple[DataFrame, list[int]]:
    """(all rows of the touched slots after the changes, the slots).

    changes: columns of the table, ``op`` (upsert or delete) and ``order``; of several changes of an
    id the last counts. There are at most as many slots as buckets, so their numbers may come to the driver.
    """
    table = spark.table(name)
    n = buckets_of(spark, name)
    last = first_per_key(changes, [KEY], [F.col(order).desc(), F.col("op").desc()])
    slots = sorted(r.slot for r in changes.select(slot_of(F.col(KEY), n).alias(SLOT)).distinct().collect())
    columns = [c for c in table.columns if c != SLOT]
    old, new = table.filter(F.col(SLOT).isin(slots)).alias("o"), last.alias("n")
    joined = old.join(new, F.col(f"o.{KEY}") == F.col(f"n.{KEY}"), "full_outer").filter("n.op IS NULL OR n.op <> 'delete'")
    taken = F.col("n.op").isNotNull()
    rows = joined.select(*[F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])
    return rows.withColumn(SLOT, slot_of(F.col(KEY), n)), slots


def apply_changes(spark: SparkSession, name: str, changes: DataFrame, order: str) -> list[int]:
    """Upsert and delete rows; returns the rewritten slots. The same changes applied again change nothing.

    Slots are replaced one by one when the job commits, so readers should not run
    meanwhile, and a run that failed is repeated with the same changes.
    """
    rows, slots = changed_rows(spark, name, changes, order)
    if not slots:
        return slots
    left = {r.slot for r in rows.select(SLOT).distinct().collect()}
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)
    for slot in slots:
        if slot not in left:  # all its rows were deleted, and an overwrite leaves a slot without new rows as it is
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({SLOT} = {slot})")
    return slots


def attach(spark: SparkSession, docs: str, vectors: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their vector, documents without one); both tables have the same number of buckets, so neither is shuffled."""
    joined = spark.table(docs).drop(SLOT).join(spark.table(vectors).drop(SLOT), KEY, "left")
    return joined.filter(F.col("vector").isNotNull()), joined.filter(F.col("vector").isNull()).drop("vector")


def lookup(spark: SparkSession, name: str, ids: DataFrame, most: int = 1000) -> DataFrame:
    """Rows of the table with the given ids.

    The slots of the ids are read and no others. Up to ``most`` ids also reach the scan as
    literals; of more, the ids are joined to the slots, broadcast if they are measured to be small.
    """
    n = buckets_of(spark, name)
    wanted = ids.select(KEY).distinct()
    slots = [r.slot for r in wanted.select(slot_of(F.col(KEY), n).alias(SLOT)).distinct().collect()]
    near = spark.table(name).filter(F.col(SLOT).isin(slots))
    few = [r[0] for r in wanted.limit(most + 1).collect()]
    if len(few) <= most:
        return near.filter(F.col(KEY).isin(few)).drop(SLOT)
    return near.join(small_side(wanted), KEY, "left_semi").drop(SLOT)
