from pyspark.sql import functions as F

from noticeboard.functions import scoring, text
from noticeboard.operators import ranking

HITS = "request_id long, cand int, rank int, id string, score double, title string, content string, link string, token long, must_have array<string>, limit int"


def hits(spark, rows):
    return spark.createDataFrame(rows, HITS)


def rerank_one(spark, title, content, keywords, score=0.5):
    row = ranking.rerank(hits(spark, [(1, 0, 1, "a", score, title, content, None, 1, keywords, 5)])).first()
    return row.hit_ratio, row.has_keyword, round(row.rerank_score, 6)


def test_keyword_match_ignores_case_blanks_and_hyphens(spark):
    cases = [
        ("a red-brick house", "Red -- Brick", True),
        ("built of red -- brick here", "red brick", True),
        ("only house", "house", True),
        ("well-known fact", "well known", True),
        ("well known fact", "Well-Known", True),
        ("any CASE Counts", "counts", True),
        ("part of a whole", "party", False),
        ("nothing alike", "brick", False),
        ("", "brick", False),
        ("brick", "", False),
    ]
    df = spark.createDataFrame(cases, "t string, k string, expected boolean")
    rows = df.select("expected", text.keyword_match(F.col("t"), F.col("k")).alias("got")).collect()
    assert all(r.got == r.expected for r in rows)


def test_hit_ratio_and_score(spark):
    assert rerank_one(spark, "Blue whale", "a whale in the sea", ["whale"]) == (1.0, "1/1", 0.8)
    assert rerank_one(spark, "Red fox", "a fox", ["whale"]) == (0.0, "0/1", 0.425)
    assert rerank_one(spark, "Blue whale", "sea", ["whale", " WHALE ", "sea"])[:2] == (1.0, "2/2")
    assert rerank_one(spark, "fox and owl", "night", ["fox", "owl", "bear", "wolf"]) == (0.5, "2/4", 0.6125)
    assert rerank_one(spark, "short AIR", "x", ["ai"])[0] == 1.0


def test_rerank_modes_and_order(spark):
    rows = [
        (1, 0, 1, "none", 0.5, "x", "x", None, 1, ["full", "part"], 5),
        (1, 0, 2, "part", 0.5, "part", "x", None, 1, ["full", "part"], 5),
        (1, 0, 3, "both", 0.5, "full", "part", None, 1, ["full", "part"], 5),
        (2, 0, 1, "b", 0.4, "x", "x", None, 1, [], 5),
        (2, 0, 2, "a", 0.9, "x", "x", None, 1, [], 5),
        (3, 0, 1, "y", 0.4, "full", "x", None, 1, ["full"], 5),
        (3, 0, 2, "z", 0.9, "x", "x", None, 1, ["full"], 5),
    ]
    out = ranking.rerank(hits(spark, rows), F.col("request_id") != 3).orderBy("request_id", "position").collect()
    assert [r.id for r in out] == ["both", "part", "none", "a", "b", "z", "y"]
    assert {(r.request_id, r.rerank_mode) for r in out} == {(1, "keywords"), (2, "none"), (3, "disabled")}
    assert all(r.hit_ratio is None and r.has_keyword == "disabled" for r in out if r.request_id == 3)


def test_rerank_score_stays_in_range(spark):
    grid = spark.range(-20, 121).withColumn("s", F.col("id") / 100).crossJoin(spark.range(0, 11).select((F.col("id") / 10).alias("r")))
    low, high = grid.select(scoring.rerank_score(F.col("s"), F.col("r")).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 0.0 <= low and high <= 1.0


def test_limits_round_half_to_even(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (5,), (50,)], "limit int")
    got = [tuple(r) for r in df.select(scoring.pre_merge_limit(F.col("limit")), scoring.pre_search_limit(F.col("limit")), scoring.retry_limit(F.col("limit"))).collect()]
    assert got == [(2, 50, 1), (5, 50, 3), (8, 50, 4), (12, 50, 7), (125, 95, 50)]


MERGE = "request_id long, position int, id string, link string, title string, content string, token long, limit int"


def test_merge_links_folds_in_order(spark):
    rows = [
        (1, 1, "a", "p1", "first", "alpha", 10, 5),
        (1, 2, "b", "p1", "second", "beta", 20, 5),
        (1, 3, "c", "p2", "other", "gamma", 5, 5),
        (1, 4, "d", "p1", "third", "alph", 7, 5),  # contained in what is there already
        (1, 5, "e", None, "no link", "delta", 1, 5),
        (1, 6, "f", None, "no link", "delta", 1, 5),
    ]
    out = {r.id: r for r in ranking.merge_links(spark.createDataFrame(rows, MERGE)).collect()}
    assert set(out) == {"a", "c", "e", "f"}
    assert out["a"].all_ids == ["a", "b", "d"]
    assert out["a"].content == "alpha\n\n --- \n\nbeta"
    assert (out["a"].token, out["a"].title) == (30, "first")


ROUND = "request_id long, round int, rank int, id string, link string, title string, content string, token long, all_ids array<string>, score double, rerank_score double"


def test_rounds_keep_the_best_scores_and_all_ids(spark):
    rows = [
        (1, 1, 1, "a", "p1", "t", "one", 1, ["a", "b"], 0.9, 0.7),
        (1, 1, 2, "c", "p2", "t", "two", 2, ["c"], 0.7, 0.6),
        (1, 2, 1, "d", "p1", "t", "three", 4, ["d"], 0.95, 0.65),
        (1, 2, 2, "e", "p2", "t", "two", 8, ["e", "c"], 0.7, 0.99),
    ]
    df = spark.createDataFrame(rows, ROUND)
    out = {r.link: r for r in ranking.accumulate_rounds(df).collect()}
    assert out["p1"].all_ids == ["a", "b", "d"] and out["p1"].content == "one\n\n --- \n\nthree"
    assert (out["p1"].score, out["p1"].rerank_score, out["p1"].token) == (0.95, 0.65, 5)
    assert (out["p2"].score, out["p2"].rerank_score, out["p2"].token) == (0.7, 0.6, 2)
    assert {r.id for r in ranking.seen_ids(df).collect()} == {"a", "b", "c", "d", "e"}


def test_retry_plan(spark):
    requests = spark.createDataFrame([(1, 5), (2, 40), (3, 5), (4, 5)], "request_id long, limit int")
    found = spark.createDataFrame([(1, "x"), (2, "x"), (4, "x")], "request_id long, id string")
    judged = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None)], "request_id long, relevant boolean")
    out = {r.request_id: (r.retry, r.retry_limit) for r in ranking.retry_plan(requests, found, judged).collect()}
    assert out == {1: (False, 7), 2: (True, 50), 3: (True, 7), 4: (False, 7)}


def test_dedupe_keeps_the_first_query(spark):
    rows = [(1, 1, 1, "a", 0.9), (1, 0, 3, "a", 0.2), (1, 0, 1, None, 0.8), (2, 0, 1, "a", 0.5)]
    df = spark.createDataFrame(rows, "request_id long, cand int, rank int, id string, score double")
    assert {(r.request_id, r.id, r.score) for r in ranking.dedupe_hits(df).collect()} == {(1, "a", 0.2), (2, "a", 0.5)}
