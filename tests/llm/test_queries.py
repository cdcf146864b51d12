"""The registered queries of the subpackage, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from compare import TABLES, rows_of
from noticeboard.llm import queries
from noticeboard.llm.texts import read


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES


def test_pipeline_stages(spark, folder, tmp_path):
    docs = read(spark, folder, "documents")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= kept and now
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept = now
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_pipeline_of_an_empty_table(spark, folder):
    docs = read(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_line_stage_judges_sources_alike_and_counts_characters(spark, folder):
    """A line planted on every eighth document goes from all sources, one on every thirtieth from none."""
    from pyspark.sql import functions as F

    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(
            "\n",
            F.when(F.xxhash64("id", F.lit(1)) % 8 == 0, F.lit("often here")),
            F.when(F.xxhash64("id", F.lit(2)) % 30 == 0, F.lit("now and then")),
            F.concat(F.lit("own line "), F.col("id").cast("string")),
        ).alias("text"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("src"), (F.col("id") % 8).cast("string")).alias("source"),
    ).withColumn("n_chars", F.length("text").cast("long"))
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, folder)
    assert out.columns == docs.columns and out.count() == 6000
    held = out.groupBy("source").agg(
        F.sum(F.contains("text", F.lit("often here")).cast("int")).alias("often"), F.sum(F.contains("text", F.lit("now and then")).cast("int")).alias("rare")
    )
    assert all(r.often == 0 and r.rare > 0 for r in held.collect())
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0
