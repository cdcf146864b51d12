"""Whole jobs: pages to chunks, a sync run with vectors and statistics, and chat requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.search_checks import results
from checks.stats_checks import sites
from checks.sync_checks import old_set
from checks.text_checks import SQL_ARTICLE, SQL_BAD_TITLE, SQL_TITLE, sql_markdown, sql_piece
from checks.views import new_snap, old_snap, sql_rules, sql_strip, sql_tokens, table, view, with_views
from noticeboard import constants as C
from noticeboard.functions import html
from noticeboard.operators import sync
from noticeboard.plans import chat, pages
from noticeboard.plans import sync as sync_plan
from noticeboard.session import materialise

# -- pages to chunks ------------------------------------------------------
# The given pages have no headings inside their article, so each is one section under its title.
view(
    "page_texts",
    [],
    f"""SELECT page_id AS doc_id, '# ' || t || chr(10) || chr(10) || m AS text FROM (
  SELECT page_id, {SQL_TITLE} AS t, {sql_markdown(SQL_ARTICLE)} AS m FROM (SELECT page_id, {sql_rules("html", html.BOILERPLATE)} AS html FROM pages))
WHERE m <> '' AND NOT ({SQL_BAD_TITLE})""",
)
view(
    "page_smart",
    ["page_texts"],
    f"""SELECT * FROM ({sql_piece(f"(SELECT doc_id, text, 0 AS step, CAST(0 AS BIGINT) AS start FROM page_texts WHERE {sql_strip('text')} <> '')")})
UNION ALL {sql_piece("(SELECT doc_id, text, step + 1 AS step, next AS start FROM page_smart WHERE next < length(text))")}""",
)


@query(
    "pages_to_chunks",
    with_views(
        ["page_smart"],
        f"""SELECT s.page_id, s.website, s.link, s.heading_link, s.year_month, s.main_title, s.main_title AS title, c.chunk, c.content FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk, piece AS content FROM page_smart WHERE piece <> '') c
JOIN (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS website, split_part(url, '#', 1) AS link, url AS heading_link, 'latest' AS year_month, {SQL_TITLE} AS main_title FROM pages) s
ON s.page_id = c.doc_id WHERE length(c.content) >= 30""",
    ),
)
def pages_to_chunks(spark, d):
    crawled = table(spark, d, "pages").withColumn("website", F.regexp_extract("url", "^https?://([^/]+)/", 1))
    out = pages.pages_to_chunks(crawled, "latest", size=200, overlap=40, tolerance=25)
    return out.select("page_id", "website", "link", "heading_link", "year_month", "main_title", "title", "chunk", "content")


# -- sync up to vectors and statistics ------------------------------------
view(
    "run_upserts",
    ["report"],
    "SELECT * FROM new_set WHERE website IN (SELECT website FROM report WHERE status = 'SUCCESS') AND id NOT IN (SELECT id FROM old_set)",
)
view(
    "run_kept",
    ["report"],
    "SELECT * FROM old_set WHERE id IN (SELECT id FROM new_set) OR website IN (SELECT website FROM report WHERE status <> 'SUCCESS')",
)


@query(
    "sync_full_run",
    with_views(
        ["run_upserts", "run_kept", "sites"],
        """SELECT 'document' AS kind, id AS name, website AS value FROM run_kept
UNION ALL SELECT 'document', id, website FROM run_upserts WHERE seq IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'vector', r.id, CAST(CAST(floor(CAST(e.embedding[1] AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR) FROM (SELECT * FROM run_kept UNION ALL SELECT * FROM run_upserts) r JOIN embeddings e ON e.vec_id = r.seq
UNION ALL SELECT 'failed', id, 'no answer' FROM run_upserts WHERE seq NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'site', s.website, coalesce('2025-12-16 ' || u.n, s.update_date || ' ' || s.update_count) FROM sites s
  LEFT JOIN (SELECT website, count(DISTINCT link) AS n FROM run_upserts GROUP BY 1) u USING (website)""",
    ),
)
def sync_full_run(spark, d):
    old, new = old_snap(spark, d), new_snap(spark, d)
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    stored = sync_plan.enrich(old_set(spark, d), "2025-12-15-00-00")
    # written, so that neither the changes of vectors nor each round of embedding reads all texts again
    vectors = materialise(old_set(spark, d).select("id", "seq").join(emb, "seq").select("id", "vector"), "old-vectors")
    known = materialise(sync.dedupe_exact(new).select("id", "seq").join(emb, "seq").select("id", "vector", F.lit(None).cast("string").alias("error")), "known")
    run = sync_plan.full_run(stored, vectors, sites(spark, d), new, old, lambda asked, attempt: asked.join(known, "id"), "2025-12-16-00-00")
    kind = lambda name: F.lit(name).alias("kind")
    first = F.floor(F.col("vector")[0].cast("double") * 1000000).cast("string").alias("value")
    parts = [
        run.documents.select(kind("document"), F.col("id").alias("name"), F.col("website").alias("value")),
        run.vectors.select(kind("vector"), F.col("id").alias("name"), first),
        run.failed.select(kind("failed"), F.col("id").alias("name"), F.col("error").alias("value")),
        run.sites.select(kind("site"), F.col("website").alias("name"), F.concat_ws(" ", "update_date", "update_count").alias("value")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# -- chat -----------------------------------------------------------------
PERCENT, LIMIT, SYSTEM = 20, 4000, "Answer from these documents:\n"
view(
    "chat_results",
    ["page_final"],
    f"SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS n FROM page_final WHERE floor(rerank_score * 100 + 0.5) >= {PERCENT}",
)
view(
    "chat_contexts",
    ["chat_results"],
    """SELECT request_id, string_agg('<document index="' || n || '">' || chr(10) || '<title>' || title || '</title>' || chr(10) || '<year_month>' || year_month || '</year_month>' || chr(10) ||
  '<year>' || year || '</year>' || chr(10) || '<website>' || website || '</website>' || chr(10) || '<content>' || content || '</content>' || chr(10) || '</document>' || chr(10) || chr(10), '' ORDER BY n) AS context
FROM chat_results GROUP BY request_id""",
)
view(
    "chat_sizes",
    ["chat_contexts", "page_final"],
    f"""SELECT b.item_id AS request_id, CASE WHEN item_id % 9 = 8 THEN '' ELSE text END AS message, context, b.item_id IN (SELECT request_id FROM page_final) AS given,
  {sql_tokens(f"('Answer from these documents:' || chr(10) || coalesce(context, ''))")} AS system_tokens, coalesce({sql_tokens("context")}, 0) AS context_tokens, coalesce(h.t, 0) AS history_tokens
FROM benchmark b LEFT JOIN chat_contexts x ON x.request_id = b.item_id
LEFT JOIN (SELECT conv_id, CAST(sum({sql_tokens("text")}) AS BIGINT) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE coalesce(text, '') <> '') WHERE rn <= 4 GROUP BY conv_id) h ON h.conv_id = b.item_id""",
)
view(
    "chat_status",
    ["chat_sizes"],
    f"""SELECT *, system_tokens + user_tokens + history_tokens AS total_tokens,
  CASE WHEN length(message) > {C.MAX_CHAT_CHARS} THEN 'input_validation' WHEN message = '' THEN 'message_required' WHEN NOT given THEN 'no_context'
    WHEN context IS NULL THEN 'no_results' WHEN system_tokens + user_tokens + history_tokens > {LIMIT} THEN 'over_limit' ELSE 'ready' END AS status
FROM (SELECT *, {sql_tokens("message")} AS user_tokens FROM chat_sizes)""",
)


def prepared(spark, d):
    i = F.col("item_id")
    asked = table(spark, d, "benchmark").select(i.alias("request_id"), F.when(i % 9 == 8, F.lit("")).otherwise(F.col("text")).alias("message"))
    history = table(spark, d, "conversations").withColumnRenamed("conv_id", "request_id")
    return chat.prepare_chat(asked, results(spark, d), history, PERCENT, SYSTEM, LIMIT, keep=4)


@query(
    "chat_requests",
    with_views(
        ["chat_status"],
        "SELECT request_id, status, system_tokens, context_tokens, history_tokens, user_tokens, total_tokens, CASE WHEN status = 'ready' THEN message END AS last_message FROM chat_status",
    ),
)
def chat_requests(spark, d):
    out = prepared(spark, d)
    return out.withColumn("last_message", F.element_at("messages", -1)["content"]).drop("messages")


@query(
    "chat_answers",
    with_views(
        ["chat_status", "chat_results"],
        """SELECT s.request_id, CASE WHEN status = 'ready' AND s.request_id % 4 = 3 THEN 'no_answer' ELSE status END AS status,
  CASE WHEN status = 'ready' AND s.request_id % 4 < 3 THEN 'see [1] and [2] ' || s.request_id END AS answer,
  CASE WHEN s.request_id % 4 = 1 THEN 'a|b|c' ELSE '"""
        + "|".join(C.DEFAULT_SUGGESTIONS)
        + """' END AS suggestions,
  CASE WHEN status = 'ready' AND s.request_id % 4 < 3 THEN coalesce(r1.heading_link, '-') || ' ' || coalesce(r2.heading_link, '-') END AS links
FROM chat_status s LEFT JOIN chat_results r1 ON r1.request_id = s.request_id AND r1.n = 1 LEFT JOIN chat_results r2 ON r2.request_id = s.request_id AND r2.n = 2""",
    ),
)
def chat_answers(spark, d):
    """Replies as a model might give them: with four suggestions, with none, or not to be read."""
    i = F.col("item_id")
    said = F.concat(F.lit("see 【1】 and ［2］ "), i.cast("string"))
    whole = F.to_json(F.struct(said.alias("answer"), F.when(i % 4 == 1, F.array(*map(F.lit, "abcd"))).otherwise(F.array().cast("array<string>")).alias("suggestions")))
    reply = F.when(i % 4 == 3, F.lit("I cannot say")).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    replies = table(spark, d, "benchmark").select(i.alias("request_id"), reply.alias("text"))
    out, cited = chat.finish_chat(prepared(spark, d), replies, results(spark, d), PERCENT)
    linked = cited.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), F.coalesce("link", F.lit("-")).alias("link")))).alias("l"))
    return out.join(linked, "request_id", "left").select(
        "request_id", "status", "answer", F.array_join("suggestions", "|").alias("suggestions"), F.array_join(F.transform("l", lambda x: x["link"]), " ").alias("links")
    )
