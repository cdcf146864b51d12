"""Blending, de-duplication, reranking, merging of chunks and rounds of search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.scoring import (
    hybrid_score,
    keyword_hits,
    pre_merge_limit,
    rerank_score,
    retry_limit,
)
from noticeboard.functions.text import distinct_keywords
from noticeboard.operators.common import first_per_key, largest, ranked, unbounded
from noticeboard.operators.filters import exclude_ids

CAND = ["request_id", "cand"]


# -- blending -------------------------------------------------------------
def hybrid(keyword: DataFrame, semantic: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both hit lists of every query blended by its ratio and cut at its ``pre_limit``.

    A query without a vector counts its keyword hits only.
    """
    k = keyword.select(*CAND, "id", F.col("score").alias("kw_score"))
    s = semantic.select(*CAND, "id", F.col("score").alias("sem_score"))
    ratio = F.when(F.col("vector").isNotNull(), F.col("ratio")).otherwise(F.lit(0.0))
    asked = candidates.select(*CAND, ratio.alias("ratio"), "pre_limit")
    joined = k.join(s, [*CAND, "id"], "full_outer").join(asked, CAND)
    score = hybrid_score(F.col("kw_score"), F.col("sem_score"), F.col("ratio"))
    scored = joined.select(*CAND, "id", "kw_score", "sem_score", "pre_limit", score.alias("score"))
    best = ranked(scored, CAND, [F.col("score").desc(), F.col("id")], largest(candidates, "pre_limit"))
    return best.filter(F.col("rank") <= F.col("pre_limit")).drop("pre_limit")


def single_search(scored: DataFrame, limit: int) -> DataFrame:
    """The best documents of one scored list."""
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


# -- one request ----------------------------------------------------------
def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First occurrence of a document over the queries of its request."""
    known = hits.filter(F.col("id").isNotNull())
    return first_per_key(known, ["request_id", "id"], [F.col("cand"), F.col("rank")])


def rerank(hits: DataFrame, enabled: Column | None = None, top_k: int | None = None) -> DataFrame:
    """Scores raised by required keywords found and lowered by those missing.

    hits: request_id, cand, rank, id, score, title, content, must_have, limit.
    Adds rerank_score, hit_ratio, has_keyword, rerank_mode and position. All hits
    stay unless the caller names a ``top_k``.
    """
    enabled = F.lit(True) if enabled is None else enabled
    out = hits.withColumn("_keys", distinct_keywords(F.col("must_have")))
    total = F.size("_keys")
    out = out.withColumn("_found", F.when(total > 0, keyword_hits(F.col("title"), F.col("content"), F.col("_keys"))).otherwise(0))
    original = F.coalesce("score", F.lit(1.0))
    ratio = F.col("_found") / F.greatest(total, F.lit(1))
    mode = F.when(~enabled, "disabled").when(total == 0, "none").otherwise("keywords")
    out = out.withColumn("rerank_mode", mode)
    by_keyword = F.col("rerank_mode") == "keywords"
    out = (
        out.withColumn("hit_ratio", F.when(by_keyword, ratio).when(F.col("rerank_mode") == "none", F.lit(0.0)))
        .withColumn(
            "has_keyword",
            F.when(by_keyword, F.concat(F.col("_found").cast("string"), F.lit("/"), total.cast("string")))
            .when(F.col("rerank_mode") == "none", F.lit("0/0"))
            .otherwise(F.lit("disabled")),
        )
        .withColumn(
            "rerank_score",
            F.when(by_keyword, rerank_score(original, F.col("hit_ratio"))).otherwise(original),
        )
        .drop("_keys", "_found")
    )
    order = [F.col("rerank_score").desc(), F.col("cand"), F.col("rank")]
    if top_k is not None:
        return ranked(out, ["request_id"], order, top_k, "position")
    return unbounded(out, ["request_id"], order, "position")


def pre_merge_cut(reranked: DataFrame) -> DataFrame:
    return reranked.filter(F.col("position") <= pre_merge_limit(F.col("limit")))


def _append_content(content: Column, new: Column) -> tuple[Column, Column]:
    """(grown content, whether it grew): new text is added unless already contained."""
    grows = (F.coalesce(new, F.lit("")) != "") & ~F.contains(content, new)
    return F.when(grows, F.concat(content, F.lit(C.CONTENT_SEPARATOR), new)).otherwise(content), grows


def merge_links(results: DataFrame) -> DataFrame:
    """Chunks of one page become one result, in order of position.

    The best chunk keeps its metadata. A group holds at most the pre-merge
    limit of one request, so folding it inside a row is safe.
    """
    fields = [c for c in results.columns if c != "request_id"]
    key = F.coalesce(F.nullif("link", F.lit("")), F.concat(F.lit("\u0000"), F.col("id")))
    groups = results.groupBy("request_id", key.alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct("position", *[c for c in fields if c != "position"]))).alias("_rows")
    )
    first = F.element_at("_rows", 1)
    start = F.struct(
        F.array(first["id"]).alias("all_ids"),
        F.coalesce(first["content"], F.lit("")).alias("content"),
        F.coalesce(first["token"], F.lit(0)).cast("long").alias("token"),
    )

    def add(acc: Column, row: Column) -> Column:
        content, grows = _append_content(acc["content"], row["content"])
        return F.struct(
            F.array_union(acc["all_ids"], F.array(row["id"])).alias("all_ids"),
            content.alias("content"),
            F.when(grows, acc["token"] + F.coalesce(row["token"], F.lit(0))).otherwise(acc["token"]).cast("long").alias("token"),
        )

    merged = groups.withColumn("_m", F.aggregate(F.slice("_rows", 2, F.size("_rows")), start, add))
    kept = [first[c].alias(c) for c in fields if c not in ("content", "token", "all_ids")]
    return merged.select("request_id", *kept, "_m.content", "_m.token", "_m.all_ids")


def final_cut(merged: DataFrame, by: str = "position") -> DataFrame:
    """The first ``limit`` results of each request, renumbered 1, 2, ..."""
    out = unbounded(merged.drop("rank"), ["request_id"], [F.col(by)])
    return out.filter(F.col("rank") <= F.col("limit"))


def rerank_and_merge(hits: DataFrame, enabled: Column | None = None) -> DataFrame:
    return final_cut(merge_links(pre_merge_cut(rerank(dedupe_hits(hits), enabled))))


# -- rounds ---------------------------------------------------------------
def accumulate_rounds(rounds: DataFrame) -> DataFrame:
    """Results of all rounds of a request merged per page, in order of round and rank.

    rounds: request_id, round, rank, id, link, title, content, token, all_ids,
    score, rerank_score. The scores are those of the row with the highest score.
    """
    key = F.coalesce(F.nullif("link", F.lit("")), F.col("id"))
    names = ["round", "rank", "id", "link", "title", "content", "token", "all_ids", "score", "rerank_score"]
    groups = rounds.filter(key.isNotNull()).groupBy("request_id", key.alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("_rows")
    )
    first = F.element_at("_rows", 1)
    start = F.struct(
        first["all_ids"].alias("all_ids"),
        F.coalesce(first["content"], F.lit("")).alias("content"),
        F.coalesce(first["token"], F.lit(0)).cast("long").alias("token"),
        F.coalesce(first["score"], F.lit(0.0)).alias("score"),
        first["rerank_score"].alias("rerank_score"),
    )

    def add(acc: Column, row: Column) -> Column:
        content, grows = _append_content(acc["content"], row["content"])
        better = F.coalesce(row["score"], F.lit(0.0)) > acc["score"]
        return F.struct(
            F.array_union(acc["all_ids"], row["all_ids"]).alias("all_ids"),
            content.alias("content"),
            F.when(grows, acc["token"] + F.coalesce(row["token"], F.lit(0))).otherwise(acc["token"]).cast("long").alias("token"),
            F.when(better, row["score"]).otherwise(acc["score"]).alias("score"),
            F.when(better, F.coalesce(row["rerank_score"], acc["rerank_score"])).otherwise(acc["rerank_score"]).alias("rerank_score"),
        )

    merged = groups.withColumn("_m", F.aggregate(F.slice("_rows", 2, F.size("_rows")), start, add))
    kept = [first[c].alias(c) for c in ("round", "rank", "id", "link", "title")]
    return merged.select("request_id", *kept, "_m.*")


def seen_ids(results: DataFrame) -> DataFrame:
    return results.select("request_id", F.explode("all_ids").alias("id")).filter(F.col("id").isNotNull()).distinct()


def exclude_seen(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Hits without the documents that earlier results already contain."""
    return exclude_ids(hits, seen_ids(results))


def final_results(accumulated: DataFrame, limits: DataFrame) -> DataFrame:
    """Accumulated results by rerank score, cut at the limit of the last round."""
    best = F.coalesce("rerank_score", "score", F.lit(0.0))
    placed = accumulated.withColumnRenamed("rank", "round_rank")
    out = unbounded(placed, ["request_id"], [best.desc(), F.col("round"), F.col("round_rank")])
    return out.join(limits.select("request_id", "limit"), "request_id").filter(F.col("rank") <= F.col("limit"))


def retry_plan(requests: DataFrame, results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Which requests get the second round, and its limit.

    A request without results, or judged not relevant, is retried; a failed
    judgement (NULL) counts as relevant.
    """
    counts = results.groupBy("request_id").agg(F.count("*").alias("n_results"))
    out = (
        requests.select("request_id", "limit")
        .join(counts, "request_id", "left")
        .join(decisions.select("request_id", "relevant"), "request_id", "left")
        .withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    )
    good = (F.col("n_results") > 0) & F.coalesce("relevant", F.lit(True))
    return out.select(
        "request_id", "limit", "n_results", (~good).alias("retry"), retry_limit(F.col("limit")).alias("retry_limit")
    )


def query_history(rounds: DataFrame) -> DataFrame:
    """Distinct queries used by a request in order, and its sub-queries sorted.

    rounds: request_id, user_query, round, keyword_query, sub_queries; at most two rounds.
    """
    grouped = rounds.groupBy("request_id", "user_query").agg(
        F.array_sort(F.collect_list(F.struct("round", "keyword_query", "sub_queries"))).alias("_r")
    )

    def used(queries: Column) -> Column:
        return F.filter(queries, lambda q: q.isNotNull() & (q != ""))

    per_round = F.transform("_r", lambda r: F.array_prepend(r["sub_queries"], r["keyword_query"]))
    subs = F.flatten(F.transform("_r", lambda r: r["sub_queries"]))
    return grouped.select(
        "request_id",
        F.array_distinct(used(F.array_prepend(F.flatten(per_round), F.col("user_query")))).alias("query_history"),
        F.array_sort(F.array_distinct(used(subs))).alias("all_sub_queries"),
    )


def evidence_preview(results: DataFrame, top: int = 5, chars: int = 200) -> DataFrame:
    """Text shown to the judge of a request: the first results with their content cut."""
    entry = F.concat(
        F.lit("ID: "), F.col("id"), F.lit("\nTitle: "), F.col("title"),
        F.lit("\nContent: "), F.substring("content", 1, chars), F.lit("...\n\n"),
    )
    entries = results.filter(F.col("rank") <= top).select("request_id", F.struct("rank", entry.alias("entry")).alias("e"))
    return entries.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "").alias("preview")
    )
