"""Bulk search: a table of requests against a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.scoring import pre_search_limit
from noticeboard.operators import intent, lexical, ranking, vector
from noticeboard.operators.common import small_side
from noticeboard.operators.filters import with_exclusions
from noticeboard.session import materialise

DOC_COLUMNS = ["id", "link", "heading_link", "website", "year_month", "year", "title", "content", "token"]


def prepare(requests: DataFrame, retry: Column | None = None) -> DataFrame:
    """Candidates of all requests with their limits, texts to embed and ratios."""
    ready = intent.with_limits(intent.intent_defaults(requests), retry)
    return intent.embedding_source(intent.query_candidates(ready))


def stored_index(docs: DataFrame) -> lexical.TermIndex:
    """Term counts of title and content, written once per corpus and read by all searches."""
    return lexical.term_index(docs, ["title", "content"])


def keyword_search(candidates: DataFrame, index: lexical.TermIndex) -> DataFrame:
    """The best ``pre_limit`` documents of every query by BM25, as a share of the best score."""
    return lexical.relative_score(lexical.bm25(candidates, index, "pre_limit"))


def multi_search(candidates: DataFrame, index: lexical.TermIndex, vectors: DataFrame) -> DataFrame:
    """All queries of all requests in one job: (request_id, cand, id, score, rank)."""
    keyword = keyword_search(candidates, index)
    semantic = vector.cosine_topk(candidates, vectors)
    return ranking.hybrid(keyword, semantic, candidates)


def with_documents(hits: DataFrame, docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Texts and request fields of the hits.

    Hits are few next to the documents. They are written once, counted, and
    sent to the document scan if they are few enough; otherwise both sides are
    shuffled by id.
    """
    stored = materialise(hits.select("request_id", "cand", "rank", "id", "score"), "hits")
    asked = requests.select("request_id", "must_have", F.col("final_limit").alias("limit"))
    found = docs.select(*DOC_COLUMNS).join(small_side(stored), "id")
    return found.join(asked, "request_id")


def search_candidates(
    candidates: DataFrame, docs: DataFrame, index: lexical.TermIndex, vectors: DataFrame
) -> DataFrame:
    """Ranked, reranked and merged results of prepared queries that carry their vectors."""
    candidates = materialise(candidates, "candidates")  # few rows that many steps read
    hits = ranking.dedupe_hits(multi_search(candidates, index, vectors))
    return ranking.rerank_and_merge(with_documents(hits, docs, candidates.filter("cand = 0")))


def two_rounds(candidates: DataFrame, docs: DataFrame, vectors: DataFrame, decisions: DataFrame) -> DataFrame:
    """A first round for all requests and a second one, without the documents already
    seen and with a wider limit, for those judged not relevant."""
    index = stored_index(docs)
    first = materialise(search_candidates(candidates, docs, index, vectors), "first-round")
    asked = candidates.filter("cand = 0").select("request_id", F.col("final_limit").alias("limit"))
    plan = ranking.retry_plan(asked, first, decisions)
    again = candidates.join(plan.filter("retry").select("request_id", "retry_limit"), "request_id")
    again = (
        again.withColumn("final_limit", F.col("retry_limit"))
        .withColumn("pre_limit", pre_search_limit(F.col("retry_limit"), F.lit(True)))
        .drop("retry_limit")
    )
    again = materialise(with_exclusions(again, ranking.seen_ids(first)), "second-round")
    second = search_candidates(again, docs, index, vectors)
    rounds = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    limits = plan.select("request_id", F.when(F.col("retry"), F.col("retry_limit")).otherwise(F.col("limit")).alias("limit"))
    return ranking.final_results(ranking.accumulate_rounds(rounds), limits)
