"""Retries of embeddings, sketches per site, expiring stream state, and prefixes in sorted ranges."""

import random

from pyspark.sql import functions as F

from noticeboard.operators import embedding, lexical, stats
from noticeboard.session import new_path
from noticeboard.streaming import logs


def test_failed_texts_go_round_until_the_last_retry(spark):
    docs = spark.createDataFrame([(str(i), f"a, b. c\n{i}") for i in range(6)], "id string, cleaned_content string")
    seen = []

    def embed(asked, attempt):
        rows = asked.collect()
        seen.append({r.id: r.text for r in rows})
        ok = [r for r in rows if int(r.id) <= attempt]
        bad = [r for r in rows if attempt < int(r.id) < 5]
        answers = [(r.id, [1.0, float(attempt)], None) for r in ok] + [(r.id, None, "busy") for r in bad]  # 5 gets no answer
        return spark.createDataFrame(answers, "id string, vector array<double>, error string")

    done = embedding.embed_with_retries(docs, embed)
    assert [sorted(s) for s in seen] == [list("012345"), list("12345"), list("2345"), list("345")]
    assert seen[0]["0"] == "a, b. c 0" and seen[1]["1"] == "abc\n1" and seen[3]["5"] == "abc\n5"
    assert {r.id: r.attempt for r in done.vectors.collect()} == {"0": 0, "1": 1, "2": 2, "3": 3}
    assert {r.id: r.error for r in done.failed.collect()} == {"4": "busy", "5": "no answer"}
    assert {r.attempt: (r.embedded, r.failed) for r in embedding.recovered(done.attempts).collect()} == {0: (1, 5), 1: (1, 4), 2: (1, 3), 3: (1, 2)}


def test_no_failures_no_rounds(spark):
    docs = spark.createDataFrame([("a", "x")], "id string, cleaned_content string")
    calls = []

    def embed(asked, attempt):
        calls.append(attempt)
        return asked.select("id", F.array(F.lit(1.0)).alias("vector"), F.lit(None).cast("string").alias("error"))

    done = embedding.embed_with_retries(docs, embed)
    assert calls == [0] and done.failed.count() == 0 and done.vectors.count() == 1
    none = embedding.embed_with_retries(docs.limit(0), embed)
    assert none.attempts.count() == 0 and none.failed.count() == 0


def test_sketches_merge_over_any_span(spark):
    docs = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise("small").alias("website"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise((F.col("id") % 50).cast("string")).alias("link"),
        F.concat(F.lit("2025-0"), (F.col("id") % 6 + 1).cast("string")).alias("month"),
    )
    path = new_path(spark, "sketches")
    for half in ("month < '2025-04'", "month >= '2025-04'", "month = '2025-02'"):  # a month counted again overwrites itself
        stats.store_sketches(stats.site_sketches(docs.filter(half), "month"), path)
    stored = spark.read.schema("website string, sketch binary, period string").parquet(path)
    for first, last in (("2025-01", "2025-06"), ("2025-02", "2025-03"), ("2025-04", "2025-04")):
        exact = {r.website: r.n_articles for r in stats.articles_per_site(docs.filter(F.col("month").between(first, last))).collect()}
        got = {r.website: r.n_articles for r in stats.merged_counts(stored, first, last).collect()}
        assert set(got) == set(exact) and all(abs(got[w] - n) <= 0.05 * n for w, n in exact.items())
    assert stats.merged_counts(stored, "2030-01", "2030-12").count() == 0


def test_state_expires_and_late_rows_are_counted(spark):
    schema = "event_id long, ts timestamp"
    source, out, progress = (new_path(spark, n) for n in ("feed", "out", "progress"))

    def run(hour, first, n):
        spark.range(first, first + n).select(
            F.col("id").alias("event_id"), F.expr(f"timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {hour}, 0, 0)").alias("ts")
        ).write.mode("append").parquet(source)
        feed = spark.readStream.schema(schema).parquet(source)
        done = logs.append_stream(logs.dedupe_stream(feed, "event_id"), out, progress)
        done.awaitTermination()
        return done

    assert logs.state_rows(run(0, 0, 500))[-1] == 500
    assert logs.state_rows(run(10, 1000, 100))[-1] == 100  # the first ids are forgotten once the watermark has passed them
    late = run(2, 2000, 40)
    assert logs.dropped_rows(late) == 40
    assert logs.state_rows(run(10, 1050, 100))[-1] == 150  # copies within the lateness are known
    assert spark.read.parquet(out).count() == 500 + 150


def test_prefixes_in_many_ranges(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abcé合\U0001f600"
    vocabulary = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(900)} | {""})
    prefixes = sorted({t[: rng.randint(1, 3)] for t in rng.sample(vocabulary, 200) if t} | {"zz", "\U0001f600", "a", ""})
    monkeypatch.setattr(lexical, "RANGE_TERMS", 37)
    got = lexical.prefix_pairs(spark.createDataFrame([(p,) for p in prefixes], "term string"), spark.createDataFrame([(t,) for t in vocabulary], "term string"))
    want = {(p, t) for p in prefixes if p for t in vocabulary if t.startswith(p) and t != p}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    none = spark.createDataFrame([], "term string")
    assert lexical.prefix_pairs(none, none).count() == 0
