"""Rules that turn a table of requests into search candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.scoring import effective_limit, pre_search_limit
from noticeboard.functions.text import blank_to_null, strip

NO_STRINGS = "array<string>"


def extract_urls(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(r"https?://\S+"), F.lit(0))


def remove_noise_terms(query: Column, noise: list[str] = C.NOISE_TERMS) -> Column:
    terms = F.filter(F.split(query, r"\s+"), lambda t: (t != "") & ~F.lower(t).isin(noise))
    return F.array_join(terms, " ")


def is_valid_must_have(keyword: Column) -> Column:
    """At most three words, or six characters when CJK, and not a general term."""
    text = strip(F.lower(keyword))
    cjk = F.rlike(text, F.lit(C.CJK_RANGE))
    fits = F.when(cjk, F.length(text) <= 6).otherwise(F.size(F.split(text, r"\s+")) <= 3)
    return (text != "") & fits & ~text.isin(C.GENERIC_TERMS)


def valid_must_have(keywords: Column) -> Column:
    return F.filter(keywords, is_valid_must_have)


def extract_limit(query: Column) -> Column:
    """The number in "top 5" or "3 articles", else NULL."""
    top = F.regexp_extract(query, r"(?i)\btop\s+([0-9]{1,9})\b", 1)
    counted = F.regexp_extract(query, r"(?i)\b([0-9]{1,9})\s+(?:articles?|items?|results?|documents?)\b", 1)
    return F.coalesce(F.nullif(top, F.lit("")), F.nullif(counted, F.lit(""))).cast("int")


def ratio_band(query_class: Column) -> Column:
    """Recommended semantic ratio of a query class (the middle of its fixed band)."""
    return (
        F.when(query_class == "identifier", 0.25)
        .when(query_class == "product", 0.4)
        .when(query_class == "topic", 0.5)
        .when(query_class == "concept", 0.7)
        .when(query_class == "abstract", 0.85)
    )


def effective_ratio(manual: Column, requested: Column, recommended: Column) -> Column:
    return F.when(manual, requested).otherwise(F.coalesce(recommended, requested))


def intent_defaults(requests: DataFrame) -> DataFrame:
    """Blank queries fall back to the user query and missing lists to empty ones."""
    out = requests
    for name in ("keyword_query", "semantic_query"):
        out = out.withColumn(name, F.coalesce(blank_to_null(F.col(name)), F.col("user_query")))
    for name in ("months", "years", "links", "websites", "must_have", "sub_queries", "exclude_ids"):
        none = F.array().cast(NO_STRINGS)
        out = out.withColumn(name, F.coalesce(F.col(name), none) if name in out.columns else none)
    return out


def query_candidates(requests: DataFrame) -> DataFrame:
    """One row per distinct query of a request: the keyword query, then its sub-queries."""
    subs = F.filter("sub_queries", lambda q: q.isNotNull() & (q != ""))
    queries = F.array_distinct(F.array_prepend(subs, F.col("keyword_query")))
    return requests.select("*", F.posexplode(queries).alias("cand", "query"))


def embedding_source(candidates: DataFrame) -> DataFrame:
    """The text to embed: the semantic query for the keyword query, else the query itself."""
    primary = (F.col("query") == F.col("keyword_query")) & (F.coalesce(F.col("semantic_query"), F.lit("")) != "")
    return candidates.withColumn("embedding_text", F.when(primary, F.col("semantic_query")).otherwise(F.col("query")))


def validate_request(requests: DataFrame) -> DataFrame:
    """Adds ``error``, NULL for a good request."""
    query, limit, ratio = F.col("user_query"), F.col("limit"), F.col("ratio")
    error = (
        F.when(F.coalesce(query, F.lit("")) == "", "query is required")
        .when(F.length(query) > C.MAX_QUERY_CHARS, "query is too long")
        .when(limit.isNull() | (limit < 1) | (limit > C.MAX_LIMIT), "limit is out of range")
        .when(ratio.isNull() | (ratio < 0) | (ratio > 1), "semantic ratio is out of range")
    )
    return requests.withColumn("error", error)


def with_limits(requests: DataFrame, retry: Column | None = None) -> DataFrame:
    """Adds the capped limit and the number of hits to fetch per query."""
    out = requests.withColumn("final_limit", effective_limit(F.col("intent_limit"), F.col("limit")))
    return out.withColumn("pre_limit", pre_search_limit(F.col("final_limit"), retry))
