"""Vectors for documents, with retries of what failed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.text import embedding_retry_text, embedding_text
from noticeboard.session import materialise

#: Takes (id, text) and the number of the attempt, from 0; gives id, vector and error, one row per id. A null vector is a failure.
Embedder = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Embedded:
    """attempts: id, attempt, text_chars, error of every try; vectors: id, vector, attempt; failed: id, error of the last try."""

    attempts: DataFrame
    vectors: DataFrame
    failed: DataFrame


def embed_with_retries(docs: DataFrame, embed: Embedder, text: str = "cleaned_content", retries: int = C.EMBEDDING_RETRIES) -> Embedded:
    """Embed all documents, then those that failed again with the stripped text, ``retries`` times at most.

    Every round is a written table, so a later round asks for what failed and nothing
    else, and an embedder that answers differently each time is asked once per round. A document
    that the embedder leaves out has failed too. Without failures there are no further rounds. The texts are
    written first, so that no round cleans them again, and do not move with the answers.
    """
    tried: list[DataFrame] = []
    stored = left = materialise(docs.select("id", F.col(text).alias("_text")), "texts")
    for attempt in range(retries + 1):
        body: Column = embedding_text(F.col("_text")) if attempt == 0 else embedding_retry_text(F.col("_text"))
        asked = left.select("id", body.alias("text"))
        answers = embed(asked, attempt).select("id", "vector", "error")
        sizes = asked.select("id", F.length("text").alias("text_chars"))
        met = sizes.join(answers, "id", "left").select(
            "id",
            F.lit(attempt).alias("attempt"),
            "text_chars",
            "vector",
            F.when(F.col("vector").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"),
        )
        tried.append(materialise(met, f"attempt-{attempt}"))
        again = tried[-1].filter("vector IS NULL").select("id")
        if attempt == retries or again.isEmpty():
            break
        left = stored.join(again, "id", "left_semi")
    every = reduce(DataFrame.union, tried)
    return Embedded(
        every.select("id", "attempt", "text_chars", "error"),
        every.filter("vector IS NOT NULL").select("id", "vector", "attempt"),
        tried[-1].filter("vector IS NULL").select("id", "error"),
    )


def recovered(attempts: DataFrame) -> DataFrame:
    """Documents embedded and still failing after each attempt."""
    return attempts.groupBy("attempt").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("embedded"), F.count("error").alias("failed"))
