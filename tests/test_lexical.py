import random

from pyspark.sql import functions as F

from noticeboard.operators import lexical
from noticeboard.session import materialise


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_pairs_find_every_near_term(spark):
    rng = random.Random(3)
    vocab = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 13))) for _ in range(1500)}
    asked = rng.sample(sorted(vocab), 80) + ["".join(rng.choice("abc") for _ in range(n)) for n in range(3, 14)]
    v = spark.createDataFrame([(t,) for t in vocab], "term string")
    q = spark.createDataFrame([(t,) for t in asked], "term string")
    got = {tuple(r) for r in lexical.fuzzy_pairs(q, v).collect()}
    allowed = lambda t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0
    want = {(a, b, edits(a, b)) for a in asked for b in vocab if a != b and edits(a, b) <= allowed(a)}
    assert got == want and want


def test_prefix_pairs(spark):
    v = spark.createDataFrame([("sea",), ("seal",), ("search",), ("tea",)], "term string")
    q = spark.createDataFrame([("sea",)], "term string")
    assert {r.term for r in lexical.prefix_pairs(q, v).collect()} == {"seal", "search"}


DOC = "id string, year_month string, link string, website string, title string, cleaned_content string, content string, main_title string"


def small_index(spark, texts):
    rows = [(str(i), "2024-01", f"l{i}", "w", t, t, t, "m") for i, t in enumerate(texts)]
    return lexical.build_postings(spark.createDataFrame(rows, DOC))


def test_postings_hold_every_place(spark):
    texts = ["b a b", "", "c, a-a"]
    got = {
        (r.id, r.term): [(p.attr, p.pos) for p in r.places] for r in small_index(spark, texts).collect()
    }
    want = {}
    for i, t in enumerate(texts):
        for attr, body in enumerate([t, t, t, "m"]):
            for pos, term in enumerate(body.replace(",", " ").replace("-", " ").split()):
                want.setdefault((str(i), term), []).append((attr, pos))
    assert got == want


def test_proximity_matches_all_pairs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["one", "two", "six", "xx", "yy", "zz"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    postings = small_index(spark, texts)
    cands = spark.createDataFrame([(1, 0, "one two six")], "request_id long, cand int, query string")
    terms = lexical.search_terms(cands)
    expansion = lexical.expand_terms(terms, postings.select("term"))
    front = postings.filter(F.col("term").isin("one", "two", "six")).select(F.lit(1).cast("long").alias("request_id"), F.lit(0).alias("cand"), "id").distinct()
    front = front.withColumn("n_terms", F.lit(3))
    got = {int(r.id): r.proximity for r in lexical.proximity(front, expansion, terms, postings).collect()}
    for i, t in enumerate(texts):
        if i not in got:
            continue
        near = 0
        for a, b in (("one", "two"), ("two", "six")):
            where = lambda w: [p for p, x in enumerate(t.split()) if x == w]
            gaps = [abs(p - q) for p in where(a) for q in where(b)]
            near += 8 - min([8, *gaps])
        assert abs(got[i] - near / 16) < 1e-12
    assert got


def test_search_plans_have_no_cross_join(spark, folder):
    from checks import views
    from noticeboard.plans import search

    cands = views.candidates(spark, folder)
    postings = lexical.build_postings(views.corpus(spark, folder))
    terms = lexical.search_terms(cands)
    counts = lexical.rule_counts(lexical.expand_terms(terms, postings.select("term")), terms, postings, cands)
    for df in (counts, lexical.bm25(cands, search.stored_index(views.corpus(spark, folder))), materialise(lexical.build_postings(views.corpus(spark, folder)), "postings")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bm25_over_several_blocks_and_batches(spark, folder, monkeypatch):
    """The same hits whatever the size of the blocks of queries and of the batches of rows."""
    from checks import views
    from noticeboard.operators import lexical
    from noticeboard.plans import search

    index = search.stored_index(views.corpus(spark, folder))
    cands = views.candidates(spark, folder).cache()
    rows = lambda df: sorted(tuple(r) for r in df.select("request_id", "cand", "id", "score", "rank").collect())
    want = rows(lexical.bm25(cands, index, "pre_limit"))
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 37)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(lexical.bm25(cands, index, "pre_limit")) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert lexical.bm25(cands.limit(0), index).count() == 0


def test_index_of_odd_texts(spark):
    from noticeboard.operators import lexical

    docs = spark.createDataFrame([("a", "One two two", None), ("b", "", "  "), ("c", None, None), ("d", "two", "合作夥伴")], "id string, title string, content string")
    docs = docs.withColumns({c: F.lit("x") for c in ("year_month", "link", "website")})
    index = lexical.term_index(docs, ["title", "content"])
    got = {(r.id, r.term): (r.tf, r.dl) for r in index.terms.collect()}
    assert got == {("a", "one"): (1, 3), ("a", "two"): (2, 3), ("d", "two"): (1, 4), ("d", "合作"): (1, 4), ("d", "作夥"): (1, 4), ("d", "夥伴"): (1, 4)}
    assert {r.term: r.df for r in index.frequencies.collect()}["two"] == 2 and (index.documents, index.mean_length) == (2.0, 3.5)
    assert lexical.term_index(docs.limit(0), ["title"]).terms.count() == 0


def test_bm25_scores_documents_where_they_lie(spark, folder, monkeypatch):
    """No posting is shuffled to be stored or searched, and the hits do not depend on how many documents are scored at once."""
    from checks import views
    from noticeboard.plans import search

    docs, cands = views.corpus(spark, folder), views.candidates(spark, folder).cache()
    index = search.stored_index(docs)
    assert index.rows.count() == index.rows.select("id").distinct().count() == index.documents
    hits = lexical.bm25(cands, index, "pre_limit")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "rangepartitioning(term" not in plan
    rows = lambda df: sorted(tuple(r) for r in df.select("request_id", "cand", "id", "score", "rank").collect())
    want = rows(hits)
    monkeypatch.setattr(lexical, "SCORED_PAIRS", 500)
    assert rows(lexical.bm25(cands, index, "pre_limit")) == want and want
