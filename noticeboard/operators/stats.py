"""Statistics over documents, logs, feedback and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.text import clip_with_dots

#: Binary logarithm of the registers of a sketch.
SKETCH_PRECISION = 14


def articles_per_site(docs: DataFrame) -> DataFrame:
    """Distinct links per website. The links are made distinct first, so the count
    per site is a plain sum that combines before its shuffle."""
    known = docs.filter((F.coalesce("website", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    return known.select("website", "link").distinct().groupBy("website").agg(F.count("*").alias("n_articles"))


def articles_per_site_approx(docs: DataFrame, error: float = 0.02) -> DataFrame:
    known = docs.filter((F.coalesce("website", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    return known.groupBy("website").agg(F.approx_count_distinct("link", error).alias("n_articles"))


def site_sketches(docs: DataFrame, period: Column | str, precision: int = SKETCH_PRECISION) -> DataFrame:
    """website, period, sketch: the distinct links of each site and period as a HyperLogLog sketch of a few KB.

    Sketches are stored once per period and merged for any span, so links are never counted
    again. With 2^14 registers estimates are off by about one percent.
    """
    known = docs.filter((F.coalesce("website", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    period = F.col(period) if isinstance(period, str) else period
    return known.groupBy("website", period.alias("period")).agg(F.hll_sketch_agg("link", F.lit(precision)).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Replace the periods present; a period that is counted again overwrites itself."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def merged_counts(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """About how many distinct links each site had from one period to another, both included; other periods are not read."""
    span = sketches.filter(F.col("period").between(first, last))
    return span.groupBy("website").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_articles"))


def refresh_site_table(sites: DataFrame, stats: DataFrame, as_of: str) -> DataFrame:
    """Date and count of the sites that had articles in the batch; other rows stay."""
    year, month, day = (int(p) for p in as_of.split("-"))
    fresh = stats.filter("n_articles > 0").select("website", F.col("n_articles").cast("string").alias("_n"))
    return sites.join(fresh, "website", "left").select(
        *[c for c in sites.columns if c not in ("update_date", "update_count")],
        F.when(F.col("_n").isNotNull(), F.lit(f"{year}-{month}-{day}")).otherwise(F.col("update_date")).alias("update_date"),
        F.coalesce("_n", "update_count").alias("update_count"),
    )


def distinct_months(docs: DataFrame) -> DataFrame:
    return docs.select("year_month").distinct().orderBy("year_month")


def chunk_token_stats(chunks: DataFrame, by: str, limit: int = C.OVERSIZE_TOKENS) -> DataFrame:
    return chunks.groupBy(by).agg(
        F.count("*").alias("n_chunks"),
        F.round(F.avg("token"), 6).alias("avg_token"),
        F.min("token").alias("min_token"),
        F.max("token").alias("max_token"),
        F.sum((F.col("token") > limit).cast("int")).alias("n_over"),
    )


def embedding_failures(docs: DataFrame, error: str = "vector is missing") -> DataFrame:
    """Documents without a vector, with a short error and a short piece of text."""
    one_line = F.translate("cleaned_content", "\n", " ")
    return docs.filter(F.col("vector").isNull()).select(
        "id", clip_with_dots(F.lit(error), 27).alias("error"), clip_with_dots(one_line, 47).alias("snippet")
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    valid = feedback.filter(F.col("feedback_type").isin("positive", "negative"))
    return valid.groupBy("query", "feedback_type").agg(F.count("*").alias("n"))


def log_volume(logs: DataFrame, ts: str = "ts") -> DataFrame:
    return logs.groupBy("log_type", F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))


def request_stats(results: DataFrame) -> DataFrame:
    """Results, rounds, chunks and tokens per request."""
    return results.groupBy("request_id").agg(
        F.count("*").alias("n_results"),
        F.max("round").alias("rounds"),
        F.sum(F.size("all_ids")).alias("n_chunks"),
        F.sum("token").alias("total_tokens"),
    )
