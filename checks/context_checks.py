"""Answer context, budgets, citations and chat."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query
from checks.search_checks import results
from checks.views import joined, quote, sql_tokens, table, view, with_views
from noticeboard import constants as C
from noticeboard.functions import scoring, text
from noticeboard.operators import context


@query(
    "b1_score_threshold",
    with_views(["page_final"], "SELECT request_id, rank, id, rerank_score FROM page_final WHERE floor(rerank_score * 100 + 0.5) >= 20"),
)
def b1(spark, d):
    return context.score_threshold(results(spark, d), 20).select("request_id", "rank", "id", "rerank_score")


@query(
    "b2_budget_prefix",
    with_views(
        ["page_final"],
        """SELECT request_id, rank, id, CAST(running AS BIGINT) AS running_tokens FROM (
  SELECT *, sum(token) OVER (PARTITION BY request_id ORDER BY rank) AS running FROM page_final) WHERE running <= 2000 OR rank = 1""",
    ),
)
def b2(spark, d):
    return context.budget_prefix(results(spark, d), 2000).select("request_id", "rank", "id", "running_tokens")


@query(
    "b3_context_block",
    with_views(
        ["page_final"],
        """SELECT request_id, string_agg('<document index="' || rank || '">' || chr(10) || '<title>' || title || '</title>' || chr(10) || '<year_month>' || year_month || '</year_month>' || chr(10) ||
  '<year>' || year || '</year>' || chr(10) || '<website>' || website || '</website>' || chr(10) || '<content>' || content || '</content>' || chr(10) || '</document>' || chr(10) || chr(10), '' ORDER BY rank) AS context
FROM page_final GROUP BY request_id""",
    ),
)
def b3(spark, d):
    return context.context_block(results(spark, d))


@query("b4_link_mapping", with_views(["page_final"], "SELECT request_id, CAST(rank AS VARCHAR) AS n, heading_link AS link FROM page_final"))
def b4(spark, d):
    return context.link_mapping(results(spark, d)).select("request_id", F.explode("links").alias("n", "link"))


view(
    "answers",
    [],
    """SELECT item_id AS request_id, text || ' 【1】 and ［' || (item_id % 12) || '］, see [3] and 【x】' AS text FROM benchmark""",
)


def answers(spark, d):
    cited = F.concat("text", F.lit(" 【1】 and ［"), (F.col("item_id") % 12).cast("string"), F.lit("］, see [3] and 【x】"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), cited.alias("text"))


@query(
    "b5_normalize_citations",
    with_views(["answers"], "SELECT request_id, regexp_replace(text, '[【［]([0-9]+)[】］]', '[\\1]', 'g') AS text FROM answers"),
)
def b5(spark, d):
    return answers(spark, d).select("request_id", text.normalize_citations(F.col("text")).alias("text"))


@query(
    "b6_resolve_citations",
    with_views(
        ["page_final", "answers"],
        """SELECT c.request_id, c.n, p.heading_link AS link FROM (
  SELECT DISTINCT request_id, n FROM (SELECT request_id, unnest(['1', CAST(request_id % 12 AS VARCHAR), '3']) AS n FROM answers)) c
LEFT JOIN page_final p ON p.request_id = c.request_id AND CAST(p.rank AS VARCHAR) = c.n""",
    ),
)
def b6(spark, d):
    return context.resolve_citations(answers(spark, d), context.link_mapping(results(spark, d)))


@query(
    "b7_trim_history",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4",
)
def b7(spark, d):
    return context.trim_history(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role")


@query(
    "b8_map_roles",
    "SELECT conv_id, turn, CASE WHEN role IN ('assistant', 'model') THEN 'assistant' ELSE 'user' END AS role, text FROM conversations WHERE coalesce(text, '') <> ''",
)
def b8(spark, d):
    return context.map_roles(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


view(
    "usage",
    [],
    f"""SELECT c.conv_id, CAST(coalesce(sum(t) FILTER (WHERE role = 'system'), 0) + coalesce(max(d.ctx), 0) AS BIGINT) AS system_tokens, CAST(coalesce(max(d.ctx), 0) AS BIGINT) AS context_tokens,
  CAST(coalesce(sum(t) FILTER (WHERE role <> 'system' AND turn = last_turn), 0) AS BIGINT) AS user_tokens,
  CAST(coalesce(sum(t) FILTER (WHERE role <> 'system' AND turn IS DISTINCT FROM last_turn), 0) AS BIGINT) AS history_tokens
FROM (SELECT *, {sql_tokens("text")} AS t, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) c
LEFT JOIN (SELECT doc_id AS conv_id, {sql_tokens("text")} AS ctx FROM documents) d USING (conv_id) GROUP BY c.conv_id""",
)


def usage(spark, d):
    contexts = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    return context.token_usage(table(spark, d, "conversations"), contexts, 1500)


@query(
    "b9_token_usage",
    with_views(
        ["usage"],
        """SELECT *, system_tokens + user_tokens + history_tokens AS total_tokens, system_tokens + user_tokens + history_tokens > 1500 AS over_limit FROM usage""",
    ),
)
def b9(spark, d):
    return usage(spark, d)


@query(
    "b10_usage_band",
    with_views(
        ["usage"],
        """SELECT conv_id, CASE WHEN total / 1500.0 * 100 >= 90 THEN 'red' WHEN total / 1500.0 * 100 >= 70 THEN 'amber' ELSE 'normal' END AS band
FROM (SELECT conv_id, system_tokens + user_tokens + history_tokens AS total FROM usage)""",
    ),
)
def b10(spark, d):
    return usage(spark, d).select("conv_id", scoring.usage_band(F.col("total_tokens"), 1500).alias("band"))


@query(
    "b11_clip_suggestions",
    f"""SELECT conv_id, CASE WHEN len(s) = 0 THEN {quote("|".join(C.DEFAULT_SUGGESTIONS))} ELSE array_to_string(s[1:3], '|') END AS suggestions FROM (
  SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user' AND length(text) > 80), []) AS s FROM conversations GROUP BY conv_id)""",
)
def b11(spark, d):
    """The long user turns of a conversation stand for its suggestions."""
    rows = table(spark, d, "conversations").withColumn(
        "s", F.when((F.col("role") == "user") & (F.length("text") > 80), F.struct("turn", "text"))
    )
    given = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]).alias("s"))
    return given.select("conv_id", joined(context.clip_suggestions(F.col("s"))).alias("suggestions"))


@query(
    "b12_mode_label",
    """SELECT event_id, CASE WHEN r <= 0.01 THEN 'Keyword' WHEN r >= 0.99 THEN 'Semantic' ELSE 'Hybrid' END AS mode, CAST(floor(value / 20 * 100) AS BIGINT) || '%' AS shown
FROM (SELECT event_id, value, (user_id % 11) / 10.0 AS r FROM events)""",
)
def b12(spark, d):
    ratio = (F.col("user_id") % 11) / F.lit(10.0)
    return table(spark, d, "events").select(
        "event_id", scoring.mode_label(ratio).alias("mode"), scoring.display_score(F.col("value") / 20).alias("shown")
    )


ANSWER = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("note", T.StringType(), True)])


@query(
    "b13_parse_answers",
    """SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN CAST(props ->> 'k' AS BIGINT) END AS k FROM events""",
)
def b13(spark, d):
    fence = F.when(F.col("user_id") % 2 == 0, F.lit("```json\n")).otherwise(F.lit("```\n"))
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("sorry "), F.col("props"))).otherwise(F.concat(fence, F.col("props"), F.lit("\n```  ")))
    good, failed = context.parse_answers(table(spark, d, "events").select("event_id", said.alias("text")), ANSWER)
    return good.select("event_id", F.lit(True).alias("ok"), F.col("answer.k").alias("k")).unionByName(
        failed.select("event_id", F.lit(False).alias("ok"), F.lit(None).cast("long").alias("k"))
    )
