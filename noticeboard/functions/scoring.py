"""Scores, limits and labels as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.text import distinct_keywords, once, squash


def clip01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def keyword_hits(title: Column, content: Column, keywords: Column) -> Column:
    """Number of the given distinct keywords found in the title or the content.

    The texts are squashed once per row, not once per keyword.
    """
    texts = F.struct(squash(F.coalesce(title, F.lit(""))).alias("title"), squash(F.coalesce(content, F.lit(""))).alias("content"))

    def inside(text: Column, keyword: Column) -> Column:
        return (text != "") & F.contains(text, keyword)

    def found(t: Column) -> Column:
        return F.size(F.filter(keywords, lambda k: (k != "") & once(squash(k), lambda q: inside(t["title"], q) | inside(t["content"], q))))

    return once(texts, found)


def rerank_score(score: Column, hit_ratio: Column) -> Column:
    score = clip01(score)
    kept = score * (F.lit(1.0) - F.lit(C.MISS_PENALTY) * (F.lit(1.0) - hit_ratio))
    return clip01(kept + F.lit(C.HIT_BOOST) * hit_ratio * (F.lit(1.0) - score))


def hybrid_score(keyword: Column, semantic: Column, ratio: Column) -> Column:
    """Blend of both sides; an absent side counts as 0, a NULL ratio as keyword only."""
    ratio = F.coalesce(ratio, F.lit(0.0))
    return (F.lit(1.0) - ratio) * F.coalesce(keyword, F.lit(0.0)) + ratio * F.coalesce(semantic, F.lit(0.0))


def effective_limit(intent_limit: Column, limit: Column) -> Column:
    return F.least(F.coalesce(intent_limit, limit), F.lit(C.MAX_LIMIT)).cast("int")


def pre_search_limit(limit: Column, retry: Column | None = None) -> Column:
    base = F.greatest(
        F.lit(C.PRE_LIMIT_FLOOR), F.floor(limit * F.lit(C.PRE_LIMIT_FACTOR) + F.lit(C.PRE_LIMIT_OFFSET)).cast("int")
    )
    if retry is None:
        return base
    return F.when(retry, F.floor(base * F.lit(C.RETRY_FACTOR)).cast("int")).otherwise(base)


def pre_merge_limit(limit: Column) -> Column:
    """limit * 2.5 rounded half to even."""
    return F.bround(limit * F.lit(C.PRE_MERGE_FACTOR), 0).cast("int")


def retry_limit(limit: Column) -> Column:
    return F.least(F.floor(limit * F.lit(C.RETRY_FACTOR)).cast("int"), F.lit(C.MAX_LIMIT))


def passes_threshold(score: Column, percent: Column) -> Column:
    return F.floor(score * 100 + F.lit(0.5)) >= percent


def mode_label(ratio: Column) -> Column:
    return F.when(ratio <= 0.01, "Keyword").when(ratio >= 0.99, "Semantic").otherwise("Hybrid")


def display_score(score: Column) -> Column:
    return F.concat(F.floor(score * 100).cast("string"), F.lit("%"))


def usage_band(total: Column, limit: int = C.CHAT_TOKEN_LIMIT) -> Column:
    percent = total / F.lit(limit) * 100
    return F.when(percent >= 90, "red").when(percent >= 70, "amber").otherwise("normal")


def typo_allowance(term: Column) -> Column:
    """Edits allowed for a query term: two from nine letters, one from five, else none."""
    return F.when(F.length(term) >= 9, 2).when(F.length(term) >= 5, 1).otherwise(0)
