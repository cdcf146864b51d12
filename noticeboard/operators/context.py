"""Answer context: thresholds, token budgets, citations and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeboard import constants as C
from noticeboard.functions.scoring import passes_threshold
from noticeboard.functions.text import estimate_tokens, normalize_citations, strip_code_fence
from noticeboard.operators.common import ranked


def score_threshold(results: DataFrame, percent: int = C.SCORE_THRESHOLD_PERCENT, score: str = "rerank_score") -> DataFrame:
    return results.filter(passes_threshold(F.coalesce(score, F.lit(0.0)), F.lit(percent)))


def budget_prefix(results: DataFrame, limit: int = C.SUMMARY_TOKEN_LIMIT) -> DataFrame:
    """Leading results whose tokens fit together; the first one is always kept."""
    w = Window.partitionBy("request_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = results.withColumn("running_tokens", F.sum(F.coalesce("token", F.lit(0))).over(w))
    return running.filter((F.col("running_tokens") <= limit) | (F.col("rank") == 1))


def source_link(heading_link: Column, link: Column) -> Column:
    return F.coalesce(F.nullif(heading_link, F.lit("")), link, F.lit(""))


def document_block(rank: Column, title: Column, year_month: Column, year: Column, website: Column, content: Column) -> Column:
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return F.concat(
        F.lit('<document index="'), rank.cast("string"), F.lit('">\n<title>'), F.coalesce(title, F.lit("No Title")),
        F.lit("</title>\n<year_month>"), text(year_month), F.lit("</year_month>\n<year>"), text(year),
        F.lit("</year>\n<website>"), text(website), F.lit("</website>\n<content>"), text(content),
        F.lit("</content>\n</document>\n\n"),
    )


def context_block(results: DataFrame) -> DataFrame:
    """One text per request with its results in order of rank (at most the search limit)."""
    block = document_block(*[F.col(c) for c in ("rank", "title", "year_month", "year", "website", "content")])
    rows = results.select("request_id", F.struct("rank", block.alias("block")).alias("b"))
    return rows.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "").alias("context")
    )


def link_mapping(results: DataFrame) -> DataFrame:
    """Map from the citation number to the link of the result."""
    entries = F.array_sort(
        F.collect_list(F.struct(F.col("rank"), source_link(F.col("heading_link"), F.col("link")).alias("to")))
    )
    pairs = F.transform(entries, lambda e: F.struct(e["rank"].cast("string"), e["to"]))
    return results.groupBy("request_id").agg(F.map_from_entries(pairs).alias("links"))


def resolve_citations(texts: DataFrame, mapping: DataFrame, text: str = "text") -> DataFrame:
    """(request_id, n, link) for the numbers cited in a text; unknown ones get no link."""
    numbers = F.regexp_extract_all(normalize_citations(F.col(text)), F.lit(r"\[([0-9]+)\]"), F.lit(1))
    cited = texts.select("request_id", F.explode(F.array_distinct(numbers)).alias("n"))
    entries = mapping.select("request_id", F.explode("links").alias("n", "link"))
    return cited.join(entries, ["request_id", "n"], "left")


# -- chat -----------------------------------------------------------------
def trim_history(messages: DataFrame, keep: int = C.CHAT_HISTORY_KEPT) -> DataFrame:
    return ranked(messages, ["conv_id"], [F.col("turn").desc()], keep, "_recent").drop("_recent")


def map_roles(messages: DataFrame) -> DataFrame:
    """Model turns become ``assistant``, all others ``user``; blank ones are dropped."""
    role = F.when(F.col("role").isin("model", "assistant"), "assistant").otherwise("user")
    return messages.filter(F.coalesce("text", F.lit("")) != "").withColumn("role", role)


def token_usage(messages: DataFrame, contexts: DataFrame | None = None, limit: int = C.CHAT_TOKEN_LIMIT) -> DataFrame:
    """Tokens per conversation by part, with a flag when the total is over the limit.

    The last user turn is the question and the other turns are history. The
    context is part of the system text, so the total counts it once.
    """
    asked = messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    rows = messages.join(asked, "conv_id", "left").withColumn("tokens", estimate_tokens(F.col("text")))
    is_system = F.col("role") == "system"
    is_user = F.coalesce(F.col("turn") == F.col("last_turn"), F.lit(False)) & ~is_system

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("tokens")).otherwise(0))

    usage = rows.groupBy("conv_id").agg(
        total(is_system).alias("system_prompt"),
        total(is_user).alias("user_tokens"),
        total(~is_system & ~is_user).alias("history_tokens"),
    )
    if contexts is None:
        usage = usage.withColumn("context_tokens", F.lit(0).cast("long"))
    else:
        sizes = contexts.select("conv_id", estimate_tokens(F.col("context")).alias("context_tokens"))
        usage = usage.join(sizes, "conv_id", "left").withColumn("context_tokens", F.coalesce("context_tokens", F.lit(0)))
    usage = usage.withColumn("system_tokens", F.col("system_prompt") + F.col("context_tokens")).drop("system_prompt")
    summed = F.col("system_tokens") + F.col("user_tokens") + F.col("history_tokens")
    return usage.withColumn("total_tokens", summed).withColumn("over_limit", F.col("total_tokens") > limit)


def clip_suggestions(suggestions: Column, keep: int = 3) -> Column:
    defaults = F.array(*[F.lit(s) for s in C.DEFAULT_SUGGESTIONS])
    given = F.coalesce(suggestions, F.array().cast("array<string>"))
    return F.when(F.size(given) == 0, defaults).otherwise(F.slice(given, 1, keep))


def parse_answers(answers: DataFrame, schema: T.StructType, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(answers that parse to the schema as struct ``answer``, failed rows)."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    clean = normalize_citations(strip_code_fence(F.col(text)))
    parsed = answers.withColumn(
        "answer", F.from_json(clean, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    required = [F.col("answer")[f.name].isNotNull() for f in schema.fields if not f.nullable]
    good = F.col("answer").isNotNull() & F.col("answer._bad").isNull()
    for test in required:
        good = good & test
    return parsed.filter(F.coalesce(good, F.lit(False))), parsed.filter(~F.coalesce(good, F.lit(False))).drop("answer")
