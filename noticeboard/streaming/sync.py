"""Change files applied to a document table, each file once.

A batch of changes is stored as its own folder and folded in when the table is
read. A run of the same batch after a failure overwrites that folder, so every
file counts once, and no batch rewrites the whole table. :mod:`noticeboard.sources.changelog`
holds the table; compaction every few batches keeps what a reader has to fold small.

:func:`guarded_stream` judges every batch first, source by source, with the number of
rows and of refused batches that it keeps for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noticeboard.operators import sync
from noticeboard.operators.common import first_per_key, salted_lookup
from noticeboard.session import Scratch
from noticeboard.sources import changelog
from noticeboard.sources.changelog import fold_changes

STATE = "website string, n_rows long, refused long, n_old long, n_added long, n_deleted long, status string, batch_id long"
REFUSED = (sync.BREAKER, sync.EMPTY_INPUT)


def _start(changes: DataFrame, store, checkpoint: str) -> StreamingQuery:
    return (
        changes.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sync_stream(changes: DataFrame, table: str, checkpoint: str, compact_every: int = 0) -> StreamingQuery:
    """Start the job. ``changes`` is a stream of rows with ``op`` (upsert or delete) and ``seq``.

    With ``compact_every`` the table, made by :func:`changelog.create`, gets a new base after every so many batches.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        if compact_every and changelog.versions(spark, table)[0].upto >= batch_id:
            return  # this batch was compacted before its run failed
        changelog.append(batch, table, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            changelog.compact(spark, table, schema)

    return _start(changes, store, checkpoint)


def current_table(spark: SparkSession, base: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """A base kept elsewhere with all changes in the log."""
    return fold_changes(base, changelog.later_changes(spark, table, schema, changelog.NO_BATCH))


# -- breaker --------------------------------------------------------------
def source_states(spark: SparkSession, table: str) -> DataFrame:
    """Rows, refused batches and the last verdict of every source after each batch."""
    return spark.read.schema(STATE).parquet(f"{table}/sources")


def last_states(states: DataFrame) -> DataFrame:
    """The newest state; each batch stores all sources, so it is one folder."""
    newest = states.agg(F.max("batch_id")).first()[0]
    return states.filter(F.col("batch_id") == newest) if newest is not None else states


def start_guarded(rows: DataFrame, table: str) -> None:
    """Write the first base and the number of rows of its sources, counted in what was written."""
    changelog.create(rows, table)
    counts = changelog.base(rows.sparkSession, table).groupBy("website").agg(F.count("*").alias("n_rows"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("refused", "n_old", "n_added", "n_deleted")]
    first = counts.select("website", "n_rows", *zero, F.lit(sync.SUCCESS).alias("status"))
    first.write.mode("overwrite").parquet(f"{table}/sources/batch_id={changelog.NO_BATCH}")


def judge(batch: DataFrame, now: DataFrame, states: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, website, op, blocked of every id in the batch; the next state of all sources).

    ``now`` has id and website of the table before the batch; ``states`` the state before it. A deletion
    counts if its id is there, an addition if it is not; deletes may name the id alone. Ids and counts
    travel here, texts do not.
    """
    last = first_per_key(batch.select("id", "website", "op", "seq"), ["id"], [F.col("op").desc(), F.col("seq").desc()])
    known = now.select("id", F.col("website").alias("_site"))
    met = last.join(known, "id", "left").select(
        "id",
        F.coalesce("_site", "website").alias("website"),
        "op",
        (F.col("_site").isNull() & (F.col("op") == "upsert")).cast("long").alias("added"),
        (F.col("_site").isNotNull() & (F.col("op") == "delete")).cast("long").alias("deleted"),
    )
    met = scratch.keep(met, "flags")
    counts = met.groupBy("website").agg(F.sum("added").alias("n_added"), F.sum("deleted").alias("n_deleted"))
    before = states.select("website", F.col("n_rows").alias("n_old"), F.col("refused").alias("_refused"))
    zero = F.lit(0).cast("long")
    joined = before.join(counts, "website", "full_outer").select(
        "website", *[F.coalesce(c, zero).alias(c) for c in ("n_old", "_refused", "n_added", "n_deleted")], F.col("n_added").isNotNull().alias("_here")
    )
    left = F.col("n_old") + F.col("n_added") - F.col("n_deleted")
    status = (
        F.when((F.col("n_added") == 0) & (F.col("n_deleted") == 0), sync.NO_CHANGE)
        .when(left == 0, sync.EMPTY_INPUT)
        .when(sync.breaker_trips(F.col("n_old"), F.col("n_deleted")), sync.BREAKER)
        .otherwise(sync.SUCCESS)
    )
    joined = joined.withColumn("status", status)
    refused = F.col("status").isin(*REFUSED)
    state = joined.select(
        "website",
        F.when(refused, F.col("n_old")).otherwise(left).alias("n_rows"),
        (F.col("_refused") + refused.cast("long")).alias("refused"),
        "n_old", "n_added", "n_deleted", "status",
    )
    state = scratch.keep(state, "states")
    verdict = state.select("website", F.col("status").isin(*REFUSED).alias("blocked"))
    return salted_lookup(met.select("id", "website", "op"), verdict, "website", "id"), state


def guarded_stream(changes: DataFrame, table: str, checkpoint: str, compact_every: int = 0) -> StreamingQuery:
    """As :func:`sync_stream`, but a source that would lose too much keeps its rows.

    A batch must hold whole runs of the sources in it. Refused changes go to ``refused`` instead of the
    log. States and changes of a batch overwrite themselves when it is run again; a batch that was
    compacted is not judged again. The table is made by :func:`start_guarded`.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        newest = changelog.versions(spark, table)[0]
        if newest.upto >= batch_id:
            return
        base = spark.read.parquet(f"{table}/{newest.base}").select("id", "website")
        later = changelog.later_changes(spark, table, schema, newest.upto).filter(F.col("batch_id") < batch_id)
        now = fold_changes(base, later.select("id", "website", "op", "seq", "batch_id"))
        states = last_states(source_states(spark, table).filter(F.col("batch_id") < batch_id))
        with Scratch(spark) as scratch:
            verdicts, state = judge(batch, now, states, scratch)
            verdicts = scratch.keep(verdicts, "verdicts")
            passed = batch.join(verdicts.filter("NOT blocked").select("id"), "id", "left_semi").select(batch.columns)
            changelog.append(passed, table, batch_id)
            verdicts.filter("blocked").write.mode("overwrite").parquet(f"{table}/refused/batch_id={batch_id}")
            state.write.mode("overwrite").parquet(f"{table}/sources/batch_id={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            changelog.compact(spark, table, schema)

    return _start(changes, store, checkpoint)
