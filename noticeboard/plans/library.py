"""One request against stored documents: filters prune what is read, texts are fetched for the results alone.

Documents lie bucketed by id, vectors in folders of their year and month, and term counts
one row per document. A request reads the months it allows, the words of all documents, and the
slots of the few documents it returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.functions.text import year_of
from noticeboard.operators import lexical, ranking, vector
from noticeboard.operators.filters import filter_documents
from noticeboard.plans.search import DOC_COLUMNS, keyword_search, stored_index
from noticeboard.sources import buckets

CAND = ["request_id", "cand"]


@dataclass(frozen=True)
class Library:
    """A stored corpus: the bucketed table of documents, the folder of vectors, and the index of terms."""

    documents: str
    vectors: str
    index: lexical.TermIndex


def store(docs: DataFrame, vectors: DataFrame, name: str, path: str, n_buckets: int) -> Library:
    """Write a corpus once for all requests. docs: ``DOC_COLUMNS``, ids distinct; vectors: id, year_month, link, website, vector."""
    buckets.create(docs, name, f"{path}/documents", n_buckets)
    dated = vectors.withColumn("year", year_of(F.coalesce("year_month", F.lit(""))))
    # a month is shared by several tasks if it is large, and small ones leave one file each
    dated.hint("rebalance", "year", "year_month").write.partitionBy("year", "year_month").parquet(f"{path}/vectors")
    return Library(name, f"{path}/vectors", stored_index(docs))


def allowed_vectors(spark: SparkSession, library: Library, request: dict) -> DataFrame:
    """Vectors that pass the filters of a request; whole folders of other months are skipped."""
    known = spark.read.option("basePath", library.vectors).schema(
        "id string, link string, website string, vector array<double>, year string, year_month string"
    ).parquet(library.vectors)
    found = known
    for sites in (request["websites"], request["manual_websites"]):
        found = filter_documents(found, websites=sites or ())
    found = filter_documents(found, request["months"] or (), request["years"] or (), request["links"] or (), (), request["start_date"], request["end_date"])
    seen = request["exclude_ids"] or []
    return found.filter(~F.col("id").isin(seen)) if seen else found


def filtered_search(spark: SparkSession, library: Library, candidate: DataFrame) -> DataFrame:
    """rank, score and document columns of the best ``final_limit`` documents of one prepared query with its vector.

    All filters act before any cut; the two hit lists are blended by the ratio of the query.
    """
    request = candidate.first().asDict()
    semantic = _nearest(spark, library, request) if request["vector"] else None
    keyword = keyword_search(candidate, library.index)
    if semantic is None:
        semantic = keyword.select(*CAND, "id", "score").limit(0)
    best = ranking.hybrid(keyword, semantic, candidate).filter(F.col("rank") <= request["final_limit"])
    hits = spark.createDataFrame(best.select("id", "rank", "score").collect(), "id string, rank int, score double")
    texts = buckets.lookup(spark, library.documents, hits).select(*DOC_COLUMNS)
    return texts.join(F.broadcast(hits), "id")  # at most as many hits as the limit of one request


def _nearest(spark: SparkSession, library: Library, request: dict) -> DataFrame:
    asked = F.array(*[F.lit(float(x)) for x in request["vector"]])
    score = F.round(vector.cosine(F.col("vector"), asked), vector.SCORE_DIGITS)
    scored = allowed_vectors(spark, library, request).select("id", score.alias("score"))
    best = ranking.single_search(scored, request["pre_limit"])
    return best.select(F.lit(request["request_id"]).alias("request_id"), F.lit(request["cand"]).alias("cand"), "id", "score")
