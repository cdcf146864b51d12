"""Whole jobs on small tables: chat requests, pages to chunks, a run with vectors and statistics."""

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import sync
from noticeboard.plans import chat, pages
from noticeboard.plans import sync as sync_plan

RESULT = "request_id long, rank int, rerank_score double, title string, year_month string, year string, website string, content string, heading_link string, link string"


def result(request, rank, score, content="text"):
    return (request, rank, score, f"t{rank}", "2025-01", "2025", "w", content, f"h{rank}", f"l{rank}")


def test_chat_statuses_messages_and_answers(spark):
    asked = spark.createDataFrame([(1, "ask"), (2, "x" * 501), (3, ""), (4, "ask"), (5, "ask"), (6, "ask"), (7, None), (8, "ask")], "request_id long, message string")
    results = spark.createDataFrame(
        [result(1, 1, 0.1), result(1, 2, 0.5), result(1, 3, 0.9), result(2, 1, 0.9), result(3, 1, 0.9), result(5, 1, 0.1), result(6, 1, 0.9, "long " * 400), result(8, 1, 0.9)], RESULT
    )
    turns = [(1, 1, "user", "old"), (1, 2, "user", "first"), (1, 3, "model", "reply"), (1, 4, "user", ""), (9, 1, "user", "other")]
    history = spark.createDataFrame(turns, "request_id long, turn long, role string, text string")
    out = chat.prepare_chat(asked, results, history, 50, "S:", limit=200, keep=2)
    got = {r.request_id: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {
        1: "ready", 2: "input_validation", 3: "message_required", 4: "no_context", 5: "no_results", 6: "over_limit", 7: "message_required", 8: "ready",
    }
    assert [(m.role, m.content) for m in got[1].messages][1:] == [("user", "first"), ("assistant", "reply"), ("user", "ask")]
    system = got[1].messages[0].content
    assert system.startswith('S:<document index="1">\n<title>t2') and '<document index="2">\n<title>t3' in system and "t1" not in system
    assert got[1].history_tokens == 4 and got[6].messages is None and got[8].messages[-1].content == "ask"
    replies = spark.createDataFrame([(1, '```json\n{"answer": "as in 【2】 and [7]", "suggestions": ["a", "b", "c", "d"]}\n```'), (8, "no json"), (4, '{"answer": "never asked"}')], "request_id long, text string")
    final, cited = chat.finish_chat(out, replies, results, 50)
    rows = {r.request_id: r for r in final.collect()}
    assert (rows[1].status, rows[1].answer, rows[1].suggestions) == ("ready", "as in [2] and [7]", ["a", "b", "c"])
    assert rows[8].status == "no_answer" and len(rows[8].suggestions) == 3 and rows[4].answer is None and rows[4].status == "no_context"
    assert {(r.n, r.link) for r in cited.collect()} == {("2", "h3"), ("7", None)}


def test_pages_become_chunks(spark):
    body = "".join(f"<p>Sentence number {i} of the page.</p>" for i in range(60))
    rows = [
        (1, "w", "https://w.example/blog/2025/03/a#x", f"<html><title>T</title><nav>menu</nav><article><h1>Head</h1>{body}</article></html>"),
        (2, "w", "https://w.example/b", "<html><title>Short</title><article><p>Just about thirty characters.</p></article></html>"),
        (3, "w", "https://w.example/c", "<html><title>No article</title><p>nothing</p></html>"),
        (4, "w", "https://w.example/d", None),
        (5, "w", "https://w.example/e", "<html><title>Page not found</title><article><p>This page is not there any more, sorry.</p></article></html>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, website string, url string, html string")
    got = pages.pages_to_chunks(df, "latest", size=100, overlap=20, tolerance=10).orderBy("page_id", "chunk").collect()
    first = [r for r in got if r.page_id == 1]
    assert len(first) > 3 and {(r.main_title, r.title, r.link, r.heading_link, r.year_month) for r in first} == {
        ("Head", "Head", "https://w.example/blog/2025/03/a", "https://w.example/blog/2025/03/a#x", "2025-03")
    }
    assert first[0].content.startswith("# Head") and "menu" not in "".join(r.content for r in first) and all(f"number {i} " in " ".join(r.content for r in first) for i in range(60))
    assert {r.page_id for r in got} <= {1, 2} and all(len(r.content) >= 30 for r in got)
    assert [r.year_month for r in got if r.page_id == 2] == ["latest"]


def test_the_mark_up_of_a_page_is_read_once(spark):
    df = spark.range(3).select(F.col("id").alias("page_id"), F.lit("w").alias("website"), F.lit("https://w.example/a").alias("url"), F.col("id").cast("string").alias("html"))
    plan = pages.pages_to_chunks(df, "latest", size=100, overlap=20, tolerance=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<noscript") == 1 and plan.count("Range (") == 1


def test_a_run_leaves_failed_documents_out_and_reports_them(spark):
    schema = "website string, link string, main_title string, title string, content string, year_month string, seq long"
    snap = lambda rows: spark.createDataFrame([(w, f"l{c}", "m", "t", c, "2025-01", i) for i, (w, c) in enumerate(rows)], schema)
    old = snap([("a", str(i)) for i in range(8)] + [("b", str(i)) for i in range(8)])
    new = snap([("a", str(i)) for i in range(1, 8)] + [("a", "good"), ("a", "flaky"), ("a", "bad")] + [("b", "0")])
    stored = sync_plan.enrich(sync.dedupe_exact(old), "2025-12-15-00-00")
    vectors = stored.select("id", F.array(F.lit(0.0)).alias("vector"))
    sites = spark.createDataFrame([("a", "A", "2025-1-1", "5"), ("b", "B", "2025-1-1", "6")], "website string, title string, update_date string, update_count string")

    def embed(asked, attempt):
        ok = (F.col("text") == "good") | ((F.col("text") == "flaky") & F.lit(attempt == 2))
        return asked.select("id", F.when(ok, F.array(F.lit(1.0))).alias("vector"), F.when(~ok, "busy").alias("error"))

    run = sync_plan.full_run(stored, vectors, sites, new, old, embed, "2025-12-16-00-00")
    docs = {(r.website, r.content) for r in run.documents.collect()}
    assert docs == {("a", str(i)) for i in range(1, 8)} | {("a", "good"), ("a", "flaky")} | {("b", str(i)) for i in range(8)}
    assert {r.id for r in run.vectors.collect()} == {r.id for r in run.documents.collect()}
    assert [(r.error) for r in run.failed.collect()] == ["busy"] and run.attempts.filter("attempt = 3").count() == 1
    assert {r.website: (r.update_date, r.update_count) for r in run.sites.collect()} == {"a": ("2025-12-16", "3"), "b": ("2025-1-1", "6")}


def test_full_run_asks_for_vectors_without_the_texts_of_the_snapshots(spark, monkeypatch):
    from checks import plan_checks, registry

    class Stop(Exception):
        pass

    def full_run(table, vectors, sites, new, old, embed, *rest):
        files = vectors.inputFiles() + embed(spark.createDataFrame([("x", "t")], "id string, text string"), 0).inputFiles()
        assert files and not any("documents" in f for f in files)
        raise Stop

    monkeypatch.setattr(plan_checks.sync_plan, "full_run", full_run)
    with pytest.raises(Stop):
        registry.QUERIES["sync_full_run"](spark, "/root/testdata/sf0.001")
