"""Keyed table maintenance, snapshot differences and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.text import fingerprint
from noticeboard.operators.common import first_per_key, salted_lookup

SUCCESS = "SUCCESS"
BREAKER = "CIRCUIT_BREAKER_TRIGGERED"
NO_CHANGE = "NO_CHANGE"
EMPTY_INPUT = "EMPTY_INPUT"


# -- keyed maintenance ----------------------------------------------------
def last_per_id(df: DataFrame, order: str) -> DataFrame:
    return first_per_key(df, ["id"], [F.col(order).desc()])


def upsert(table: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of the batch replace rows of the table with the same id; of several for one id the last by ``order``."""
    batch = last_per_id(batch, order)
    kept = table.join(batch.select("id"), "id", "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def partial_update(table: DataFrame, patch: DataFrame, order: str) -> DataFrame:
    """Only the non-null fields of the patch change; unknown ids and new columns are added.

    Several rows for one id count as one: of each field the last non-null value by ``order``.
    """
    changed = [c for c in patch.columns if c not in ("id", order)]
    fields = [c for c in table.columns if c != "id"] + [c for c in changed if c not in table.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in changed]
    t, p = table.alias("t"), patch.groupBy("id").agg(F.count("*").alias("_rows"), *last).alias("p")

    def value(c: str) -> Column:
        if c not in changed:
            return F.col(f"t.{c}")
        return F.coalesce(F.col(f"p.{c}"), F.col(f"t.{c}")) if c in table.columns else F.col(f"p.{c}")

    joined = t.join(p, F.col("t.id") == F.col("p.id"), "full_outer")
    return joined.select(
        F.coalesce(F.col("t.id"), F.col("p.id")).alias("id"), *[value(c).alias(c) for c in fields]
    )


def delete_by_ids(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining rows, deleted ids, ids that were not there)."""
    ids = ids.select("id").distinct()
    remaining = table.join(ids, "id", "left_anti")
    deleted = table.join(ids, "id", "left_semi").select("id")
    missing = ids.join(table.select("id"), "id", "left_anti")
    return remaining, deleted, missing


def get_by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_semi")


def add_new_only(table: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of the batch with ids that the table does not hold, one per id."""
    fresh = last_per_id(batch, order).join(table.select("id"), "id", "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def auto_sync(table: DataFrame, removes: DataFrame, adds: DataFrame, order: str) -> DataFrame:
    return add_new_only(delete_by_ids(table, removes)[0], adds, order)


def sync_change_batch(table: DataFrame, upserts: DataFrame, deletes: DataFrame, order: str) -> DataFrame:
    """Deletes first, then upserts: an id in both ends up present, with its last row by ``order``."""
    upserts = last_per_id(upserts, order)
    gone = deletes.select("id").unionByName(upserts.select("id")).distinct()
    return table.join(gone, "id", "left_anti").unionByName(upserts, allowMissingColumns=True)


def reset(spark: SparkSession, path: str) -> None:
    """Empty a stored table; its schema stays."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def index_stats(table: DataFrame) -> DataFrame:
    """Document count per website, and in total under website NULL."""
    return table.groupingSets([["website"], []], "website").agg(F.count("*").alias("n_docs"))


def attach_vectors(docs: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their vector, documents without one)."""
    joined = docs.join(vectors, "id", "left")
    return joined.filter(F.col("vector").isNotNull()), joined.filter(F.col("vector").isNull()).drop("vector")


# -- snapshot differences -------------------------------------------------
def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("id", fingerprint(F.col("website"), F.col("main_title"), F.col("title"), F.col("content")))


def dedupe_exact(df: DataFrame, order: str = "seq") -> DataFrame:
    """One row per fingerprint; the last copy wins."""
    return last_per_id(with_fingerprint(df), order)


def added(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old.select("id"), "id", "left_anti")


def deleted(new: DataFrame, old: DataFrame) -> DataFrame:
    return old.join(new.select("id"), "id", "left_anti")


def change_flags(new: DataFrame, old: DataFrame) -> DataFrame:
    """One narrow row per id: website and whether it is in the new and old snapshot.

    A union with map-side aggregation does the work of both anti joins in a
    single shuffle of ids.
    """
    sides = new.select("id", "website", F.lit(1).alias("in_new"), F.lit(0).alias("in_old")).unionByName(
        old.select("id", "website", F.lit(0).alias("in_new"), F.lit(1).alias("in_old"))
    )
    return sides.groupBy("website", "id").agg(F.max("in_new").alias("in_new"), F.max("in_old").alias("in_old"))


def source_counts(new: DataFrame, old: DataFrame) -> DataFrame:
    flags = change_flags(new, old)
    return flags.groupBy("website").agg(
        F.sum("in_old").alias("n_old"),
        F.sum("in_new").alias("n_new"),
        F.sum(F.when(F.col("in_old") == 0, 1).otherwise(0)).alias("n_added"),
        F.sum(F.when(F.col("in_new") == 0, 1).otherwise(0)).alias("n_deleted"),
    )


def breaker_trips(n_old: Column, n_deleted: Column) -> Column:
    return (n_old > 0) & (n_deleted > C.BREAKER_MIN_DELETIONS) & (n_deleted * C.BREAKER_SHARE > n_old)


def diff_report(new: DataFrame, old: DataFrame) -> DataFrame:
    """Counts and a status per source; both sides already fingerprinted and deduplicated."""
    counts = source_counts(new, old)
    status = (
        F.when(F.col("n_new") == 0, EMPTY_INPUT)
        .when(breaker_trips(F.col("n_old"), F.col("n_deleted")), BREAKER)
        .when((F.col("n_added") == 0) & (F.col("n_deleted") == 0), NO_CHANGE)
        .otherwise(SUCCESS)
    )
    return counts.withColumn("status", status)


def circuit_breaker(new: DataFrame, old: DataFrame) -> DataFrame:
    """Every change (op, id, website) with a flag telling whether its source is blocked."""
    flags = change_flags(new, old).filter("in_new <> in_old")
    status = diff_report(new, old).select("website", "status")
    changes = flags.select("id", "website", F.when(F.col("in_new") == 1, "add").otherwise("delete").alias("op"))
    joined = salted_lookup(changes, status, "website", "id")
    return joined.select("id", "website", "op", (F.col("status") != SUCCESS).alias("blocked"))


def live_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Changes of sources that passed; a source without rows keeps its old ones."""
    return circuit_breaker(new, old).filter(~F.col("blocked")).drop("blocked")


def apply_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """The next snapshot: new rows of sources that passed, old rows of all others."""
    status = diff_report(new, old).select("website", (F.col("status") == SUCCESS).alias("_pass"))
    from_new = salted_lookup(new, status, "website", "id").filter(F.col("_pass")).drop("_pass")
    from_old = salted_lookup(old, status, "website", "id").filter(~F.col("_pass")).drop("_pass")
    return from_new.unionByName(from_old, allowMissingColumns=True)


def oversize_chunks(df: DataFrame, limit: int = C.OVERSIZE_TOKENS) -> DataFrame:
    return df.filter(F.col("token") > limit)


def run_summary(report: DataFrame, durations: DataFrame) -> DataFrame:
    """One message per source from the diff report and the seconds it took."""
    joined = report.join(durations, "website", "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    seconds = F.format_string("%.1f", F.col("seconds"))
    message = (
        F.when(F.col("status") == EMPTY_INPUT, F.format_string("[empty] %s: 0 rows (%ss), diff skipped", F.col("website"), seconds))
        .when(
            F.col("status") == BREAKER,
            F.format_string("[blocked] %s: tried to delete %d rows, update refused", F.col("website"), F.col("n_deleted")),
        )
        .when(F.col("status") == NO_CHANGE, F.format_string("[no change] %s (%ss)", F.col("website"), seconds))
        .otherwise(
            F.format_string(
                "[ok] %s: added %d, deleted %d (%ss)", F.col("website"), F.col("n_added"), F.col("n_deleted"), seconds
            )
        )
    )
    return joined.select("website", "status", "n_added", "n_deleted", message.alias("message"))
