"""Column expressions and table helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these; the class is the one of ``[^\x20\x09-\x0D]+``.
SPACES = r"[ \t-\r]+"
#: Bytes of a table that may be sent to every executor.
BROADCAST_BYTES = 8 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bucket(key: Column, n: int) -> Column:
    """The remainder of crc32 of a key as text; a null key counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), F.lit(n))


def spread_lookup(rows: DataFrame, lookup: DataFrame, on: str, lookup_bytes: int, spread: Column, salts: int = 32) -> DataFrame:
    """Left join to a table with one row per key; null keys match null.

    A lookup table of at most ``BROADCAST_BYTES`` (measured by the caller) goes
    to every executor. A larger one is repeated once per salt, so that rows that
    share a hot key are still joined by many tasks.
    """
    right = lookup.withColumnRenamed(on, "_on")
    if lookup_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(right), F.col(on).eqNullSafe(F.col("_on")), "left").drop("_on")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = F.col(on).eqNullSafe(F.col("_on")) & (F.col("_salt") == F.col("_slot"))
    return left.join(right, met, "left").drop("_on", "_slot", "_salt")
