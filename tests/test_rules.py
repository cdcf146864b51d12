"""Keyword rules over documents where they lie, against the joins of postings and against words counted in Python."""

import os

from pyspark.sql import functions as F

from checks import registry, views
from noticeboard.operators import lexical, rules
from noticeboard.session import materialise

CAND = ["request_id", "cand"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*CAND, "id", *columns).collect())


def test_rules_equal_the_joins_of_postings(spark, folder, monkeypatch):
    """With any size of blocks of queries, of documents counted and of positions sorted at once."""
    docs, cands = views.corpus(spark, folder), materialise(views.candidates(spark, folder), "candidates")
    postings, terms = materialise(lexical.build_postings(docs), "postings"), lexical.search_terms(cands)
    expansion = materialise(lexical.expand_terms(terms, postings.select("term")), "expansion")
    counts = materialise(lexical.rule_counts(expansion, terms, postings, cands), "counts")
    front = materialise(lexical.keep_front(counts, cands), "front")
    near = lexical.proximity(front, expansion, terms, postings).withColumn("proximity", F.round("proximity", 9))
    names = ["n_terms", "words", "typos", "attr", "exact"]
    want, wanted = rows(counts, *names), rows(front.join(near, [*CAND, "id"]), *names, "proximity")
    for block, pairs, places in ((4096, 1 << 20, 1 << 22), (37, 200, 50)):
        monkeypatch.setattr(rules, "QUERY_BLOCK", block)
        monkeypatch.setattr(rules, "COUNTED_PAIRS", pairs)
        monkeypatch.setattr(rules, "SORTED_PLACES", places)
        corpus = rules.stored_words(docs, cands)
        counted = rules.rule_counts(corpus)
        assert rows(counted, *names) == want and want
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert rows(rules.front(corpus).withColumn("proximity", F.round("proximity", 9)), *names, "proximity") == wanted


def test_words_rule_returns_every_document(spark, folder):
    """Also those beyond the fifty best of a query."""
    docs = [(r.id, {w for a in (r.title, r.cleaned_content, r.content, r.main_title) for w in a}) for r in views.corpus(spark, folder).select(
        "id", *[lexical.words(F.col(a)).alias(a) for a in ("title", "cleaned_content", "content", "main_title")]).collect()]
    asked = views.candidates(spark, folder).select(*CAND, lexical.words(F.col("query")).alias("w")).collect()
    want = sorted((r.request_id, r.cand, i, n) for r in asked for i, have in docs if (n := len(have & set(r.w))))
    assert rows(registry.QUERIES["k2_words_rule"](spark, folder), "words") == want
    assert len(want) > 50 * len(asked)


def test_terms_of_fields_are_not_shuffled(spark, folder):
    out = registry.QUERIES["k1_tokenize_fields"](spark, folder)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_keywords_with_letters_that_grow_in_upper_case(spark, folder, tmp_path):
    for name in os.listdir(folder):
        if name != "benchmark.parquet":
            os.symlink(f"{folder}/{name}", tmp_path / name)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").withColumn("text", F.concat("text", F.lit(" Straßenbahnen")))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    keys = {r.request_id: r.n for r in views.requests(spark, str(tmp_path)).select("request_id", F.size("must_have").alias("n")).collect()}
    got = registry.QUERIES["r4_hit_ratio"](spark, str(tmp_path)).collect()
    assert got and all(int(r.has_keyword.split("/")[1]) == keys[r.request_id] for r in got)
