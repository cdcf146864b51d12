"""Joins and rankings used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
BROADCAST_BYTES = 64 << 20


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    The literal bound lets Spark drop the other rows of a key before the
    shuffle, so a key with very many copies does not fill one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).drop("_rn")


def ranked(df: DataFrame, keys: list[str], order: list[Column], bound: int, rank: str = "rank") -> DataFrame:
    """Number rows 1, 2, ... per key and keep those up to a literal bound."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= bound)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often later steps and filters name them.

    Filters move in front of plain columns and carry their expressions along, which
    is then computed again for each use; they do not move in front of a generator.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.explode(F.array(made)).alias("_made"))
    return out.select(*[F.col(f"`{c}`") for c in out.columns[:-1]], *[F.col("_made")[name].alias(name) for name in columns])


def salted_lookup(df: DataFrame, lookup: DataFrame, on: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join to a table with one row per ``on``, spreading hot keys over tasks.

    The lookup side is repeated once per salt, so rows that share one key are
    still joined by many tasks. If the lookup side turns out small, adaptive
    execution turns the join into a broadcast join.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def unbounded(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Number rows 1, 2, ... per key; for groups that are small by construction."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def largest(df: DataFrame, column: str) -> int:
    """The largest value of a column of limits, as the literal bound of a cut; 0 without rows."""
    return int(df.agg(F.max(column)).first()[0] or 0)


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its rows as JSON texts are measured to be small, else leave it as it is."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
