"""From raw documents to packed training sequences, stage by stage.

Each stage gets the rows that the stage before it kept, written as Parquet and
read again, and returns the columns of ``documents``; the last returns pieces of
packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.llm import lines, mixing, near_dups, packing, quality
from noticeboard.llm.texts import read
from noticeboard.session import materialise

#: Between the share of lines that are on every tenth document of all sources and of those on every thirtieth, so that
#: chance differences between sources do not decide.
LINE_RATIO = 0.07

#: No SQL for the whole: the learned rules and the tokenizer have none.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that are on too many documents of one source; all documents stay, ``n_chars`` follows the text."""
    cut = lines.drop_boilerplate(docs, "text", "source", LINE_RATIO)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates."""
    return near_dups.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come near their target weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise all documents and pack them into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_boilerplate),
    ("near_dups", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
