"""Request rules and metadata filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.search_checks import best_by_bm25, sql_bm25
from checks.views import AS_OF, candidates, corpus, joined, quote, requests, sql_distinct, sql_strip, table, view, with_views
from noticeboard import constants as C
from noticeboard.functions import dates, scoring
from noticeboard.operators import filters, intent


def texts(items: list[str]) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


@query(
    "i1_resolve_months",
    f"""SELECT item_id, CASE item_id % 4 WHEN 0 THEN strftime(DATE '{AS_OF}' - to_months(1), '%Y-%m')
  WHEN 1 THEN array_to_string(list_transform(range(0, 1 + item_id % 6), lambda i: strftime(DATE '{AS_OF}' - to_months(CAST(i AS INTEGER)), '%Y-%m')), '|')
  WHEN 2 THEN array_to_string(list_transform(range(0, 3), lambda i: strftime(DATE '{AS_OF}' - to_months(CAST(i AS INTEGER)), '%Y-%m')), '|') ELSE '' END AS months
FROM benchmark""",
)
def i1(spark, d):
    i = F.col("item_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("last", "past", "recent", "none")]), (i % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", joined(dates.resolve_months(kind, (1 + i % 6).cast("int"), AS_OF)).alias("months"))


view(
    "asked",
    [],
    """SELECT item_id, text || ' see https://docs.example/' || item_id || '?x=1 and http://b.example top ' || (1 + item_id % 60) AS text_a,
  text || ' please 3 articles of the data' AS text_b FROM benchmark""",
)


def asked(spark, d):
    i = F.col("item_id").cast("string")
    return table(spark, d, "benchmark").select(
        "item_id", "text",
        F.concat("text", F.lit(" see https://docs.example/"), i, F.lit("?x=1 and http://b.example top "), (1 + F.col("item_id") % 60).cast("string")).alias("text_a"),
        F.concat("text", F.lit(" please 3 articles of the data")).alias("text_b"),
    )


@query("i2_extract_urls", with_views(["asked"], r"SELECT item_id, array_to_string(regexp_extract_all(text_a, 'https?://[^\s]+'), '|') AS urls FROM asked"))
def i2(spark, d):
    return asked(spark, d).select("item_id", joined(intent.extract_urls(F.col("text_a"))).alias("urls"))


@query(
    "i3_remove_noise_terms",
    with_views(
        ["asked"],
        f"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text_b, '\\s+'), lambda t: t <> '' AND lower(t) NOT IN {texts(C.NOISE_TERMS)}), ' ') AS query FROM asked""",
    ),
)
def i3(spark, d):
    return asked(spark, d).select("item_id", intent.remove_noise_terms(F.col("text_b")).alias("query"))


@query(
    "i4_valid_must_have",
    with_views(
        ["requests"],
        f"""SELECT request_id, array_to_string(list_filter(keys, lambda k: k <> '' AND CASE WHEN regexp_matches(k, '[一-龥]') THEN length(k) <= 6
  ELSE len(regexp_split_to_array(k, '\\s+')) <= 3 END AND k NOT IN {texts(C.GENERIC_TERMS)}), '|') AS must_have
FROM (SELECT request_id, list_transform(list_concat(must_have, list_concat(sub_queries, ['update', '安全性', '雲合作夥伴計劃公告', '雲端'])), lambda k: {sql_strip("lower(k)")}) AS keys FROM requests)""",
    ),
)
def i4(spark, d):
    extra = F.array(*[F.lit(k) for k in ("update", "安全性", "雲合作夥伴計劃公告", "雲端")])
    keys = F.concat("must_have", "sub_queries", extra)
    kept = F.transform(intent.valid_must_have(keys), lambda k: F.lower(k))
    return requests(spark, d).select("request_id", joined(kept).alias("must_have"))


@query(
    "i5_extract_limit",
    with_views(
        ["asked"],
        """SELECT item_id, CAST(1 + item_id % 60 AS BIGINT) AS from_top, CAST(3 AS BIGINT) AS from_count, CAST(NULL AS BIGINT) AS from_text FROM asked""",
    ),
)
def i5(spark, d):
    return asked(spark, d).select(
        "item_id",
        intent.extract_limit(F.col("text_a")).alias("from_top"),
        intent.extract_limit(F.col("text_b")).alias("from_count"),
        intent.extract_limit(F.col("text")).alias("from_text"),
    )


CLASSES = ["identifier", "product", "topic", "concept", "abstract", "other"]


@query(
    "i6_ratio",
    with_views(
        ["requests"],
        """SELECT request_id, band, CASE WHEN request_id % 2 = 0 THEN ratio ELSE coalesce(band, ratio) END AS ratio FROM (
  SELECT request_id, CAST(ratio AS DOUBLE) AS ratio, CAST([0.25, 0.4, 0.5, 0.7, 0.85, NULL][request_id % 6 + 1] AS DOUBLE) AS band FROM requests)""",
    ),
)
def i6(spark, d):
    i = F.col("request_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in CLASSES]), (i % 6 + 1).cast("int"))
    band = intent.ratio_band(kind)
    return requests(spark, d).select("request_id", band.alias("band"), intent.effective_ratio(i % 2 == 0, F.col("ratio"), band).alias("ratio"))


@query(
    "i7_intent_defaults",
    with_views(
        ["requests"],
        """SELECT request_id, user_query AS keyword_query, CASE WHEN trim(semantic_query) = '' THEN user_query ELSE semantic_query END AS semantic_query,
  CASE WHEN request_id % 3 = 0 THEN 0 ELSE len(sub_queries) END AS n_subs, len(links) AS n_links FROM requests""",
    ),
)
def i7(spark, d):
    raw = requests(spark, d).withColumn("keyword_query", F.lit("  ")).withColumn("sub_queries", F.when(F.col("request_id") % 3 != 0, F.col("sub_queries")))
    return intent.intent_defaults(raw).select(
        "request_id", "keyword_query", "semantic_query", F.size("sub_queries").alias("n_subs"), F.size("links").alias("n_links")
    )


@query("i8_query_candidates", with_views(["queries_first"], "SELECT request_id, cand, query FROM queries_first"))
def i8(spark, d):
    return candidates(spark, d).select("request_id", "cand", "query")


@query("i9_embedding_source", with_views(["candidates"], "SELECT request_id, cand, embedding_text FROM candidates"))
def i9(spark, d):
    return candidates(spark, d).select("request_id", "cand", "embedding_text")


@query(
    "i10_validate_request",
    """SELECT item_id, CASE WHEN q = '' THEN 'query is required' WHEN length(q) > 100 THEN 'query is too long'
  WHEN item_id % 60 < 1 OR item_id % 60 > 50 THEN 'limit is out of range' WHEN (item_id % 13) / 10.0 > 1 THEN 'semantic ratio is out of range' END AS error
FROM (SELECT item_id, CASE WHEN item_id % 17 = 3 THEN '' WHEN item_id % 4 = 0 THEN text ELSE split_part(text, '.', 1) END AS q FROM benchmark)""",
)
def i10(spark, d):
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(
        "item_id",
        F.when(i % 17 == 3, F.lit("")).when(i % 4 == 0, F.col("text")).otherwise(F.split_part("text", F.lit("."), F.lit(1))).alias("user_query"),
        (i % 60).cast("int").alias("limit"),
        ((i % 13) / 10.0).alias("ratio"),
    )
    return intent.validate_request(rows).select("item_id", "error")


@query(
    "i11_limits",
    with_views(
        ["limits"],
        """SELECT request_id, CAST(final_limit AS BIGINT) AS final_limit, CAST(pre_limit AS BIGINT) AS pre_limit,
  CAST(floor(pre_limit * 1.5) AS BIGINT) AS retry_pre_limit, CAST(round_even(final_limit * 2.5, 0) AS BIGINT) AS pre_merge FROM limits""",
    ),
)
def i11(spark, d):
    out = intent.with_limits(requests(spark, d))
    retry = scoring.pre_search_limit(F.col("final_limit"), F.lit(True))
    return out.select("request_id", "final_limit", "pre_limit", retry.alias("retry_pre_limit"), scoring.pre_merge_limit(F.col("final_limit")).alias("pre_merge"))


# -- filters --------------------------------------------------------------
def posted(spark, d):
    """The fifty best documents of each query by all words of the content, before any filter."""
    return best_by_bm25(candidates(spark, d), corpus(spark, d)).select("request_id", "id").distinct()


view("posted", ["terms", "corpus"], f"SELECT DISTINCT request_id, id FROM ({sql_bm25('corpus', 'terms')})")


@query("f1_filter_in", with_views(["posted", "allowed"], "SELECT DISTINCT p.request_id, p.id FROM posted p JOIN allowed a ON a.request_id = p.request_id AND a.id = p.id AND a.cand = 0"))
def f1(spark, d):
    return filters.filter_hits(posted(spark, d), candidates(spark, d).filter("cand = 0"), corpus(spark, d))


@query(
    "f2_month_range",
    with_views(["corpus"], "SELECT id, year_month FROM corpus WHERE year_month >= '2023-05' AND year_month <= '2024-02'"),
)
def f2(spark, d):
    return filters.filter_documents(corpus(spark, d), start_date="2023-05-20", end_date="2024-02-10").select("id", "year_month")


@query(
    "f3_manual_website_filter",
    with_views(
        ["corpus"],
        "SELECT id, website, year_month FROM corpus WHERE website IN ('src1', 'src8', 'src15') AND year = '2024' AND year_month IN ('2024-01', '2024-04', '2023-02')",
    ),
)
def f3(spark, d):
    return filters.filter_documents(
        corpus(spark, d), months=["2024-01", "2024-04", "2023-02"], years=["2024"], websites=["src1", "src8", "src15"], start_date="2099-01-01"
    ).select("id", "website", "year_month")


@query(
    "f4_exclude_ids",
    with_views(["posted"], "SELECT request_id, id FROM posted p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND CAST(l.doc_id AS VARCHAR) = p.id AND l.doc_id % 3 = p.request_id % 3)"),
)
def f4(spark, d):
    hits = posted(spark, d)
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 3).alias("m"))
    seen = candidates(spark, d).filter("cand = 0").select("request_id", (F.col("request_id") % 3).alias("m")).join(toxic, "m")
    return filters.exclude_ids(hits, seen)
