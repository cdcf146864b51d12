"""Metadata filters of a request, as join predicates and as literal filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC_FIELDS = ["id", "year_month", "link", "website"]
REQUEST_FIELDS = ["months", "years", "links", "websites", "manual_websites", "start_date", "end_date", "exclude_ids"]


def in_list(values: Column, field: Column) -> Column:
    """An empty list is no constraint."""
    return (F.size(values) == 0) | F.array_contains(values, field)


def in_month_range(year_month: Column, months: Column, start: Column, end: Column) -> Column:
    """Inclusive months of the dates; ignored when the request names months itself."""
    after = start.isNull() | (year_month >= F.substring(start, 1, 7))
    before = end.isNull() | (year_month <= F.substring(end, 1, 7))
    return (F.size(months) > 0) | (after & before)


def matches(doc: str = "d", request: str = "r") -> Column:
    """All filters of a request on a document, for use in a join condition."""

    def d(c: str) -> Column:
        return F.col(f"{doc}.{c}")

    def r(c: str) -> Column:
        return F.col(f"{request}.{c}")

    return (
        in_list(r("months"), d("year_month"))
        & in_list(r("years"), F.substring(d("year_month"), 1, 4))
        & in_list(r("links"), d("link"))
        & in_list(r("websites"), d("website"))
        & in_list(r("manual_websites"), d("website"))
        & in_month_range(d("year_month"), r("months"), r("start_date"), r("end_date"))
        & ~F.array_contains(r("exclude_ids"), d("id"))
    )


def filter_documents(
    docs: DataFrame,
    months: list[str] = (),
    years: list[str] = (),
    links: list[str] = (),
    websites: list[str] = (),
    start_date: str | None = None,
    end_date: str | None = None,
) -> DataFrame:
    """The filters of one request as literals, which reach the scan and prune partitions."""
    out = docs
    for column, values in (("year_month", months), ("year", years), ("link", links), ("website", websites)):
        if values:
            out = out.filter(F.col(column).isin(list(values)))
    if not months:
        if start_date:
            out = out.filter(F.col("year_month") >= start_date[:7])
        if end_date:
            out = out.filter(F.col("year_month") <= end_date[:7])
    return out


def filter_hits(hits: DataFrame, requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits whose document passes the filters of their request."""
    h = hits.alias("h")
    d = docs.select(*DOC_FIELDS).alias("d")
    r = requests.select("request_id", *REQUEST_FIELDS).alias("r")
    return (
        h.join(d, F.col("h.id") == F.col("d.id"))
        .join(r, (F.col("h.request_id") == F.col("r.request_id")) & matches())
        .select("h.*")
    )


def with_exclusions(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates that must not find the documents their request has already seen.

    A request has seen at most the documents of one merged result list, so the
    list fits its row; it acts before any cut, like the other filters.
    """
    lists = seen.groupBy("request_id").agg(F.collect_set("id").alias("_seen"))
    joined = candidates.join(lists, "request_id", "left")
    found = F.array_union("exclude_ids", F.coalesce("_seen", F.array().cast("array<string>")))
    return joined.withColumn("exclude_ids", found).drop("_seen")


def exclude_ids(hits: DataFrame, seen: DataFrame) -> DataFrame:
    return hits.join(seen.select("request_id", "id"), ["request_id", "id"], "left_anti")
