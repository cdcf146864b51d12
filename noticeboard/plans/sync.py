"""Snapshot to table: fingerprint, compare, guard, enrich and apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.text import clean_content, estimate_tokens, year_of
from noticeboard.operators import sync
from noticeboard.operators.embedding import Embedder, embed_with_retries
from noticeboard.operators.stats import articles_per_site, refresh_site_table
from noticeboard.session import materialise


def enrich(df: DataFrame, update_time: str) -> DataFrame:
    """Adds year, cleaned content, token count and the time of the run."""
    content: Column = F.coalesce("content", F.lit(""))
    return (
        df.withColumn("year", year_of(F.coalesce("year_month", F.lit(""))))
        .withColumn("cleaned_content", clean_content(content))
        .withColumn("token", estimate_tokens(content))
        .withColumn("update_time", F.lit(update_time))
    )


def changes_of(new: DataFrame, old: DataFrame, update_time: str, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(enriched rows to put in, ids to take out) of the sources that passed the breaker.

    The comparison works on ids alone, where copies do no harm. Its result is
    written, so its size is known when full rows are joined to it, and copies
    are dropped among the changed rows only: unchanged texts are not shuffled.
    """
    n, o = sync.with_fingerprint(new), sync.with_fingerprint(old)
    changes = materialise(sync.live_changes(n, o), "changes")
    fresh = n.join(changes.filter("op = 'add'").select("id"), "id", "left_semi")
    return enrich(sync.last_per_id(fresh, order), update_time), changes.filter("op = 'delete'").select("id")


def next_table(table: DataFrame, new: DataFrame, old: DataFrame, update_time: str, order: str = "seq") -> DataFrame:
    """The document table after one run: only rows that changed are cleaned and replaced."""
    upserts, gone = changes_of(new, old, update_time, order)
    return sync.sync_change_batch(table, upserts, gone, order)


@dataclass(frozen=True)
class Run:
    """What a whole run leaves: documents and vectors of the index, site statistics, tries and failures of embedding."""

    documents: DataFrame
    vectors: DataFrame
    sites: DataFrame
    attempts: DataFrame
    failed: DataFrame


def full_run(
    table: DataFrame, vectors: DataFrame, sites: DataFrame, new: DataFrame, old: DataFrame, embed: Embedder, update_time: str, order: str = "seq"
) -> Run:
    """From a new snapshot to the searchable tables: compare, guard, enrich, embed with retries, replace, count.

    vectors: id and vector. A document whose embedding failed for good does not enter the index and is
    reported; site statistics count the distinct links of all changed rows. ``update_time`` begins
    with the date of the run.
    """
    upserts, gone = changes_of(new, old, update_time, order)
    upserts, gone = materialise(upserts, "upserts"), materialise(gone, "gone")
    done = embed_with_retries(upserts, embed)
    ready = upserts.join(done.vectors.select("id"), "id", "left_semi")
    fresh = done.vectors.select("id", "vector", F.lit(0).alias("_order"))
    return Run(
        sync.sync_change_batch(table, ready, gone, order),
        sync.sync_change_batch(vectors.withColumn("_order", F.lit(0)), fresh, gone, "_order").drop("_order"),
        refresh_site_table(sites, articles_per_site(upserts), update_time[:10]),
        done.attempts,
        done.failed,
    )
