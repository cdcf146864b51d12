"""Statistics and the incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.search_checks import rounds
from checks.sync_checks import FP, new_set, old_set
from checks.text_checks import fixed_chunks
from checks.views import AS_OF, corpus, new_snap, table, view, with_views
from noticeboard.functions.dates import staleness_label
from noticeboard.functions.text import estimate_tokens
from noticeboard.operators import embedding, stats, sync
from noticeboard.session import new_path
from noticeboard.streaming import logs as log_jobs
from noticeboard.streaming import sync as sync_jobs


@query("t1_articles_per_site", with_views(["corpus"], "SELECT website, count(DISTINCT link) AS n_articles FROM corpus GROUP BY website"))
def t1(spark, d):
    return stats.articles_per_site(corpus(spark, d))


SPANS = [("2023-01", "2023-12"), ("2023-07", "2024-06"), ("2023-01", "2024-12")]


@query(
    "t1_sketch_counts",
    with_views(
        ["corpus"],
        " UNION ALL ".join(
            f"SELECT website, '{a}/{b}' AS span, count(DISTINCT link) AS n_exact, true AS within FROM corpus WHERE year_month BETWEEN '{a}' AND '{b}' GROUP BY website"
            for a, b in SPANS
        ),
    ),
)
def t1_sketches(spark, d):
    """Whether merged monthly sketches are within 5 % of the exact count, per site and span."""
    docs, path = corpus(spark, d).select("website", "link", "year_month"), new_path(spark, "sketches")
    stats.store_sketches(stats.site_sketches(docs, "year_month"), path)
    stored = spark.read.schema("website string, sketch binary, period string").parquet(path)
    parts = []
    for a, b in SPANS:
        exact = stats.articles_per_site(docs.filter(F.col("year_month").between(a, b))).withColumnRenamed("n_articles", "n_exact")
        met = exact.join(stats.merged_counts(stored, a, b), "website", "left")
        near = F.coalesce(F.abs(F.col("n_articles") - F.col("n_exact")) <= 0.05 * F.col("n_exact"), F.lit(False))
        parts.append(met.select("website", F.lit(f"{a}/{b}").alias("span"), "n_exact", near.alias("within")))
    return parts[0].union(parts[1]).union(parts[2])


@query("t1_articles_per_site_approx")
def t1_approx(spark, d):
    return stats.articles_per_site_approx(corpus(spark, d))


SITES_SQL = "SELECT 'src' || n_nationkey AS website, n_name AS title, '2025-' || (n_regionkey + 8) || '-' || (n_nationkey % 28 + 1) AS update_date, CAST(n_nationkey AS VARCHAR) AS update_count FROM nation"
view("sites", [], SITES_SQL)


def sites(spark, d):
    key = F.col("n_nationkey")
    day = F.concat(F.lit("2025-"), (F.col("n_regionkey") + 8).cast("string"), F.lit("-"), (key % 28 + 1).cast("string"))
    return table(spark, d, "nation").select(
        F.concat(F.lit("src"), key.cast("string")).alias("website"), F.col("n_name").alias("title"), day.alias("update_date"), key.cast("string").alias("update_count")
    )


@query(
    "t2_refresh_site_table",
    with_views(
        ["sites", "new_set", "old_set"],
        """SELECT s.website, s.title, CASE WHEN n IS NULL THEN update_date ELSE '2025-12-16' END AS update_date, coalesce(CAST(n AS VARCHAR), update_count) AS update_count
FROM sites s LEFT JOIN (SELECT website, count(DISTINCT link) AS n FROM new_set WHERE id NOT IN (SELECT id FROM old_set) GROUP BY 1) c USING (website)""",
    ),
)
def t2(spark, d):
    fresh = sync.added(new_set(spark, d), old_set(spark, d))
    return stats.refresh_site_table(sites(spark, d), stats.articles_per_site(fresh), AS_OF)


@query(
    "t3_staleness_label",
    """SELECT o_orderkey, CASE WHEN days = 0 THEN 'updated today: ' || o_orderkey WHEN days BETWEEN 1 AND 7 THEN 'updated ' || days || ' days ago' ELSE 'updated on ' || day END AS label
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%-m-%-d') AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') AS days FROM orders)""",
)
def t3(spark, d):
    day = F.date_format("o_orderdate", "y-M-d")
    label = staleness_label(day, F.col("o_orderkey").cast("string"), "1996-06-30")
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query("t4_distinct_months", with_views(["corpus"], "SELECT DISTINCT year_month FROM corpus ORDER BY 1"))
def t4(spark, d):
    return stats.distinct_months(corpus(spark, d))


@query(
    "t5_chunk_token_stats",
    with_views(
        ["chunks"],
        """SELECT d.source, count(*) AS n_chunks, round(avg(t), 6) AS avg_token, min(t) AS min_token, max(t) AS max_token, count(*) FILTER (WHERE t > 180) AS n_over
FROM (SELECT doc_id, CAST(ceil(length(chunk_text) / 4.0) AS BIGINT) AS t FROM chunks) JOIN documents d USING (doc_id) GROUP BY d.source""",
    ),
)
def t5(spark, d):
    chunks = fixed_chunks(spark, d).select("doc_id", estimate_tokens(F.col("chunk_text")).alias("token"))
    return stats.chunk_token_stats(chunks.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source", 180)


@query(
    "t6_embedding_failures",
    with_views(
        ["corpus"],
        """SELECT id, 'the vector of this document...' AS error, CASE WHEN length(t) > 47 THEN substr(t, 1, 47) || '...' ELSE t END AS snippet
FROM (SELECT id, replace(cleaned_content, chr(10), ' ') AS t FROM corpus WHERE seq NOT IN (SELECT vec_id FROM embeddings))""",
    ),
)
def t6(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    joined = corpus(spark, d).select("id", "cleaned_content").join(vec, "id", "left")
    return stats.embedding_failures(joined, "the vector of this document is not there")


STRIPPED = "translate(t, ',. ''’\"，。', '')"


view(
    "embedding_tries",
    ["corpus"],
    f"""SELECT c.id, a.attempt, e.vec_id IS NOT NULL AS known, length(CASE WHEN a.attempt = 0 THEN t ELSE {STRIPPED} END) AS text_chars,
  known AND a.attempt >= CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS ok
FROM (SELECT *, replace(cleaned_content, chr(10), ' ') AS t FROM corpus) c CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS attempt) a LEFT JOIN embeddings e ON e.vec_id = c.seq""",
)


@query(
    "t6_retry_attempts",
    with_views(
        ["embedding_tries"],
        """SELECT id, CAST(attempt AS BIGINT) AS attempt, text_chars, CASE WHEN ok THEN NULL WHEN known THEN 'busy' ELSE 'no answer' END AS error
FROM embedding_tries j WHERE NOT EXISTS (SELECT 1 FROM embedding_tries b WHERE b.id = j.id AND b.ok AND b.attempt < j.attempt)""",
    ),
)
def t6_retries(spark, d):
    """An embedder that is busy for some languages until the first, second or third retry and does not know every document."""
    docs = corpus(spark, d)
    vec = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("known"))
    needed = docs.select("id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3).alias("needed"))
    known = vec.join(needed, "id")

    def embed(asked, attempt):
        ok = F.col("needed") <= attempt
        return asked.join(known, "id").select("id", F.when(ok, F.col("known")).alias("vector"), F.when(~ok, "busy").alias("error"))

    return embedding.embed_with_retries(docs.select("id", "cleaned_content"), embed).attempts


@query(
    "t7_feedback_stats",
    """SELECT d.source AS query, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS feedback_type, count(*) AS n
FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 0 GROUP BY 1, 2""",
)
def t7(spark, d):
    kind = F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, "positive").otherwise("negative")
    rows = table(spark, d, "labels").withColumn("feedback_type", kind).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("query")), "doc_id")
    return stats.feedback_stats(rows)


HOURLY = "SELECT event_type AS log_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1, 2"


@query("t8_log_volume", HOURLY)
def t8(spark, d):
    out = stats.log_volume(table(spark, d, "events").withColumnRenamed("event_type", "log_type"))
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(
    "t9_request_stats",
    with_views(["rounds"], "SELECT request_id, count(*) AS n_results, CAST(max(round) AS BIGINT) AS rounds, CAST(sum(len(all_ids)) AS BIGINT) AS n_chunks, CAST(sum(token) AS BIGINT) AS total_tokens FROM rounds GROUP BY 1"),
)
def t9(spark, d):
    return stats.request_stats(rounds(spark, d))


# -- incremental jobs -----------------------------------------------------
@query(
    "x1_sync_stream",
    with_views(
        ["new_snap"],
        f"""SELECT id, website, content, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM (SELECT {FP} AS id, * FROM new_snap)) WHERE rn = 1""",
    ),
)
def x1(spark, d):
    """A stream of change files that turns the old table into the new one."""
    cols = ["id", "website", "content", "seq"]
    old = old_set(spark, d).select(*cols)
    ups = sync.with_fingerprint(new_snap(spark, d)).select(*cols, F.lit("upsert").alias("op"))
    gone = sync.deleted(new_set(spark, d), old_set(spark, d)).select(*cols, F.lit("delete").alias("op"))
    source, out = new_path(spark, "feed"), new_path(spark, "table")
    ups.unionByName(gone).write.json(source)
    schema = ups.schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(source)
    sync_jobs.sync_stream(feed, out, new_path(spark, "progress")).awaitTermination()
    return sync_jobs.current_table(spark, old, out, schema).select(*cols)


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumnRenamed("event_type", "log_type").withColumn("ts", F.col("ts").cast("timestamp"))


@query("x2_log_stream", HOURLY)
def x2(spark, d):
    out = new_path(spark, "counts")
    log_jobs.log_stream(event_stream(spark, d), out, new_path(spark, "progress")).awaitTermination()
    stored = spark.read.schema("log_type string, hour timestamp, n long").parquet(out)
    return log_jobs.latest_counts(stored).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("x3_dedupe_stream", "SELECT event_id, event_type AS log_type, user_id FROM events")
def x3(spark, d):
    """Five runs over one checkpoint; each brings some days of events and again those of the hour before."""
    events = table(spark, d, "events")
    source, out, progress = (new_path(spark, n) for n in ("feed", "distinct", "progress"))
    days = ["2024-01-01", "2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25", "9999-01-01"]
    for low, high in zip(days, days[1:]):
        part = events.filter((F.col("ts") >= F.expr(f"timestamp_ntz '{low}' - INTERVAL 1 HOUR")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz")))
        part.unionByName(part.sample(0.2, seed=1)).write.mode("append").parquet(source)
        feed = spark.readStream.schema(events.schema).parquet(source).withColumnRenamed("event_type", "log_type")
        feed = feed.withColumn("ts", F.col("ts").cast("timestamp"))
        log_jobs.append_stream(log_jobs.dedupe_stream(feed, "event_id"), out, progress).awaitTermination()
    return spark.read.parquet(out).select("event_id", "log_type", "user_id")


@query(
    "x4_late_rows",
    """SELECT event_type AS log_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
)
def x4(spark, d):
    """Hourly counts of a feed whose last run brings its first days again: late rows are dropped.

    A batch drops rows older than the watermark that held for the batch before
    it, so the copy comes in a third run over the same checkpoint.
    """
    source, out, progress = (new_path(spark, n) for n in ("late", "counts", "progress"))
    events = table(spark, d, "events")
    for part in ("ts < '2024-01-20'", "ts >= '2024-01-20'", "ts < '2024-01-05'"):
        events.filter(part).write.mode("append").parquet(source)
        feed = spark.readStream.schema(events.schema).parquet(source)
        feed = feed.withColumnRenamed("event_type", "log_type").withColumn("ts", F.col("ts").cast("timestamp"))
        log_jobs.append_stream(log_jobs.hourly_counts(feed), out, progress).awaitTermination()
    return spark.read.parquet(out).groupBy("log_type").agg(F.sum("n").alias("n"), F.count("*").alias("hours"))
