"""Chat requests over search results: checks, context, budget, messages, and what the model answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeboard import constants as C
from noticeboard.functions.text import estimate_tokens
from noticeboard.operators import context
from noticeboard.operators.common import unbounded

READY, TOO_LONG, NO_MESSAGE = "ready", "input_validation", "message_required"
NO_CONTEXT, NO_RESULTS, OVER_LIMIT = "no_context", "no_results", "over_limit"
MESSAGE = "array<struct<role:string,content:string>>"
ANSWER = T.StructType([T.StructField("answer", T.StringType(), False), T.StructField("suggestions", T.ArrayType(T.StringType()), True)])


def prepare_chat(
    requests: DataFrame,
    results: DataFrame,
    history: DataFrame,
    percent: int,
    system: str = "",
    limit: int = C.CHAT_TOKEN_LIMIT,
    max_chars: int = C.MAX_CHAT_CHARS,
    keep: int = C.CHAT_HISTORY_KEPT,
) -> DataFrame:
    """request_id, status, tokens by part and, for ready requests, the messages to send.

    requests: request_id, message; results: the chosen search results by rank, with rerank_score;
    history: request_id, turn, role, text. Results below ``percent`` are left out and the others
    numbered anew. A request has the first status that applies, in the order: message too long,
    message missing, no results chosen, none above the threshold, over the token limit, ready.
    Results and kept turns of one request are few, so they fit its row.
    """
    passed = unbounded(context.score_threshold(results, percent).drop("position").withColumnRenamed("rank", "_rank"), ["request_id"], [F.col("_rank")])
    blocks = context.context_block(passed)
    given = results.select("request_id").distinct().withColumn("_given", F.lit(True))
    recent = context.trim_history(context.map_roles(history.withColumnRenamed("request_id", "conv_id")), keep)
    said = recent.groupBy(F.col("conv_id").alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("_said"),
        F.sum(estimate_tokens(F.col("text"))).alias("history_tokens"),
    )
    joined = requests.select("request_id", F.coalesce("message", F.lit("")).alias("message")).join(given, "request_id", "left").join(blocks, "request_id", "left").join(said, "request_id", "left")
    system_text = F.concat(F.lit(system), F.coalesce("context", F.lit("")))
    sized = joined.select(
        "*",
        estimate_tokens(F.col("context")).alias("context_tokens"),
        estimate_tokens(system_text).alias("system_tokens"),
        estimate_tokens(F.col("message")).alias("user_tokens"),
    ).withColumn("history_tokens", F.coalesce("history_tokens", F.lit(0).cast("long")))
    total = F.col("system_tokens") + F.col("user_tokens") + F.col("history_tokens")
    status = (
        F.when(F.length("message") > max_chars, TOO_LONG)
        .when(F.col("message") == "", NO_MESSAGE)
        .when(F.col("_given").isNull(), NO_CONTEXT)
        .when(F.col("context").isNull(), NO_RESULTS)
        .when(total > limit, OVER_LIMIT)
        .otherwise(READY)
    )

    def turn(role: str, content):
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    messages = F.concat(turn("system", system_text), F.coalesce("_said", F.array().cast(MESSAGE)), turn("user", F.col("message")))
    checked = sized.withColumn("total_tokens", total).withColumn("status", status)
    return checked.select(
        "request_id", "status", "system_tokens", "context_tokens", "history_tokens", "user_tokens", "total_tokens",
        F.when(F.col("status") == READY, messages).alias("messages"),
    )


def finish_chat(prepared: DataFrame, replies: DataFrame, results: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(request_id, status, answer, suggestions of every request; links that its answer cites).

    replies: request_id, text, as the model gave them. A ready request without a reply that can be
    read has the status ``no_answer`` and the usual suggestions.
    """
    good, _ = context.parse_answers(replies, ANSWER)
    read = good.select("request_id", F.col("answer.answer").alias("answer"), F.col("answer.suggestions").alias("_given"))
    joined = prepared.select("request_id", "status").join(read, "request_id", "left")
    ready = F.col("status") == READY
    out = joined.select(
        "request_id",
        F.when(ready & F.col("answer").isNull(), F.lit("no_answer")).otherwise(F.col("status")).alias("status"),
        F.when(ready, F.col("answer")).alias("answer"),
        context.clip_suggestions(F.col("_given")).alias("suggestions"),
    )
    passed = unbounded(context.score_threshold(results, percent).drop("position").withColumnRenamed("rank", "_rank"), ["request_id"], [F.col("_rank")])
    cited = context.resolve_citations(out.filter(F.col("answer").isNotNull()), context.link_mapping(passed), "answer")
    return out, cited
