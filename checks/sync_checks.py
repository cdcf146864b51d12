"""Sources, keyed maintenance and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query
from checks.views import corpus, new_snap, old_snap, sql_clean, sql_strip, sql_tokens, table, view, with_views
from noticeboard.operators import sync
from noticeboard.plans import sync as sync_plan
from noticeboard.session import new_path
from noticeboard.sources import logs, snapshots

FIELDS = ["website", "link", "main_title", "title", "content", "year_month", "seq"]
FP = "md5(" + " || '|' || ".join(sql_strip(f"coalesce({c}, '')") for c in ("website", "main_title", "title", "content")) + ")"

for side in ("old", "new"):
    view(
        f"{side}_set",
        [f"{side}_snap"],
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
  FROM (SELECT {FP} AS id, * FROM {side}_snap)) WHERE rn = 1""",
    )
view(
    "report",
    ["old_set", "new_set"],
    """SELECT website, n_old, n_new, n_added, n_deleted,
  CASE WHEN n_new = 0 THEN 'EMPTY_INPUT'
       WHEN n_old > 0 AND n_deleted > 5 AND n_deleted > n_old / 3.0 THEN 'CIRCUIT_BREAKER_TRIGGERED'
       WHEN n_added = 0 AND n_deleted = 0 THEN 'NO_CHANGE' ELSE 'SUCCESS' END AS status
FROM (SELECT coalesce(n.website, o.website) AS website, count(o.id) AS n_old, count(n.id) AS n_new,
    count(*) FILTER (WHERE o.id IS NULL) AS n_added, count(*) FILTER (WHERE n.id IS NULL) AS n_deleted
  FROM new_set n FULL OUTER JOIN old_set o ON n.id = o.id GROUP BY 1)""",
)


def old_set(spark: SparkSession, d: str) -> DataFrame:
    return sync.dedupe_exact(old_snap(spark, d))


def new_set(spark: SparkSession, d: str) -> DataFrame:
    return sync.dedupe_exact(new_snap(spark, d))


# -- sources --------------------------------------------------------------
CORPUS_RAW = "website, link, main_title, title, content, year_month"


@query("s1_read_snapshot", with_views(["corpus"], f"SELECT {CORPUS_RAW}, heading_link FROM corpus"))
def s1(spark, d):
    path = new_path(spark, "snapshot")
    snapshots.write_snapshot_json(corpus(spark, d).select(*[f.name for f in snapshots.RAW_CHUNK]), path)
    missing = snapshots.read_snapshot(spark, path + "-missing")
    return snapshots.read_snapshot(spark, path).unionByName(missing)


NULLED = """SELECT id, website, CASE WHEN seq % 10 = 3 THEN NULL ELSE link END AS link, CASE WHEN seq % 10 = 4 THEN NULL ELSE title END AS title,
  main_title, content, CASE WHEN lang = 'de' THEN NULL ELSE year_month END AS year_month FROM corpus"""
view("nulled", ["corpus"], NULLED)


def nulled(spark, d):
    seq = F.col("seq")
    return corpus(spark, d).select(
        "id", "website", F.when(seq % 10 != 3, F.col("link")).alias("link"), F.when(seq % 10 != 4, F.col("title")).alias("title"),
        "main_title", "content", F.when(F.col("lang") != "de", F.col("year_month")).alias("year_month"),
    )


@query(
    "s2_require_fields",
    with_views(["nulled"], "SELECT * FROM nulled WHERE link IS NOT NULL AND year_month IS NOT NULL AND title IS NOT NULL AND content IS NOT NULL"),
)
def s2(spark, d):
    return snapshots.require_fields(nulled(spark, d))


@query(
    "s3_validate_docs",
    with_views(
        ["nulled"],
        """SELECT id, CASE WHEN link IS NULL THEN 'link is missing' WHEN year_month IS NULL THEN 'year_month is missing'
  WHEN title IS NULL THEN 'title is missing' END AS error FROM nulled""",
    ),
)
def s3(spark, d):
    valid, rejects = snapshots.validate_docs(nulled(spark, d))
    return valid.select("id", F.lit(None).cast("string").alias("error")).unionByName(rejects.select("id", "error"))


@query(
    "s4_union_sources",
    with_views(["corpus"], "SELECT website, link, content, title FROM corpus UNION ALL SELECT 'pages', url, html, NULL FROM pages"),
)
def s4(spark, d):
    pages = table(spark, d, "pages").select(F.lit("pages").alias("website"), F.col("url").alias("link"), F.col("html").alias("content"))
    return snapshots.union_sources(corpus(spark, d).select("website", "link", "content", "title"), pages)


@query(
    "s5_write_snapshot",
    with_views(
        ["old_set", "new_set"],
        """SELECT website, id, content FROM new_set UNION ALL
SELECT website, id, content FROM old_set WHERE website NOT IN (SELECT website FROM new_set)""",
    ),
)
def s5(spark, d):
    path = new_path(spark, "snapshot")
    snapshots.write_snapshot(old_set(spark, d).select("website", "id", "content"), path)
    snapshots.write_snapshot(new_set(spark, d).select("website", "id", "content"), path)
    return spark.read.parquet(path).select(F.col("website").cast("string").alias("website"), "id", "content")


@query(
    "s6_retain_history",
    """SELECT event_id, event_type, age FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age
FROM events) WHERE age <= 4""",
)
def s6(spark, d):
    return snapshots.retain_history(table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "event_type", "age")


@query(
    "s7_change_sink",
    with_views(
        ["old_set", "new_set"],
        """SELECT 'upsert' AS op, id, content FROM new_set WHERE id NOT IN (SELECT id FROM old_set)
UNION ALL SELECT 'delete', id, NULL FROM old_set WHERE id NOT IN (SELECT id FROM new_set)""",
    ),
)
def s7(spark, d):
    old, new = old_set(spark, d), new_set(spark, d)
    path = new_path(spark, "changes")
    snapshots.change_sink(sync.added(new, old), sync.deleted(new, old), path, "20251216_000000")
    up = spark.read.schema(new.schema).json(f"{path}/upsert").select(F.lit("upsert").alias("op"), "id", "content")
    down = spark.read.schema("id string").json(f"{path}/delete")
    return up.unionByName(down.select(F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("content")))


@query(
    "s8_latest_batch",
    """SELECT event_id, event_type, user_id FROM events
WHERE user_id = (SELECT user_id FROM events ORDER BY ts DESC, user_id DESC LIMIT 1)""",
)
def s8(spark, d):
    return snapshots.latest_batch(table(spark, d, "events"), "user_id", "ts").select("event_id", "event_type", "user_id")


@query(
    "s9_append_log",
    "SELECT event_type AS log_type, strftime(ts, '%Y%m%d_%H') AS hour, count(*) AS n FROM events GROUP BY 1, 2",
)
def s9(spark, d):
    path = new_path(spark, "logs")
    entries = table(spark, d, "events").withColumnRenamed("event_type", "log_type")
    logs.append_log(entries, path)
    back = spark.read.schema("event_id long, log_type string, hour string").json(path)
    return back.groupBy("log_type", "hour").agg(F.count("event_id").alias("n"))


@query(
    "s10_progress_ndjson",
    """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""",
)
def s10(spark, d):
    path = new_path(spark, "progress")
    logs.write_progress(table(spark, d, "events").select("event_id", "event_type", "user_id"), path)
    return spark.read.text(path)


@query(
    "s11_local_sync",
    with_views(["corpus"], "SELECT id, content, 'add' AS op, true AS has_source, false AS rejected FROM corpus UNION ALL SELECT NULL, text, NULL, true, true FROM benchmark"),
)
def s11(spark, d):
    """A folder of arrays, among them one file per benchmark text that is no JSON."""
    path = new_path(spark, "folder")
    snapshots.write_snapshot_json(corpus(spark, d).select("id", "content"), f"{path}/arrays")
    table(spark, d, "benchmark").select("text").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/texts")
    rows, rejects = snapshots.local_sync(spark, path, T.StructType().add("id", "string").add("content", "string"), "*/*.txt")
    has_source = F.endswith("source_file", F.lit(".txt")).alias("has_source")
    good = rows.select("id", "content", "op", has_source, F.lit(False).alias("rejected"))
    bad = rejects.select(F.regexp_replace("text", r"\n$", "").alias("content"), has_source, F.lit(True).alias("rejected"))
    return good.unionByName(bad, allowMissingColumns=True)


# -- keyed maintenance ----------------------------------------------------
OUT = ["id", "website", "content", "seq"]
OUT_SQL = "id, website, content, seq"


@query(
    "m1_upsert",
    with_views(
        ["old_set", "new_snap"],
        f"""SELECT {OUT_SQL} FROM old_set WHERE id NOT IN (SELECT {FP} FROM new_snap) UNION ALL
SELECT {OUT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM (SELECT {FP} AS id, * FROM new_snap)) WHERE rn = 1""",
    ),
)
def m1(spark, d):
    return sync.upsert(old_set(spark, d), sync.with_fingerprint(new_snap(spark, d)), "seq").select(*OUT)


# Three patch rows share an id, and one field is new to the table.
PATCH_SQL = """SELECT CAST(doc_id // 3 * 3 AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'reviewed ' || doc_id END AS title,
  CASE WHEN toxic = 1 THEN 'hidden ' || doc_id END AS content, CASE WHEN quality = 0 THEN 'low' END AS grade, doc_id AS seq FROM labels"""
view("patch", [], PATCH_SQL)


def patch(spark, d):
    doc = F.col("doc_id")
    return table(spark, d, "labels").select(
        (F.floor(doc / 3) * 3).cast("string").alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("reviewed "), doc)).alias("title"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("hidden "), doc)).alias("content"),
        F.when(F.col("quality") == 0, "low").alias("grade"),
        doc.alias("seq"),
    )


@query(
    "m2_partial_update",
    with_views(
        ["corpus", "patch"],
        """SELECT coalesce(c.id, p.id) AS id, c.website, coalesce(p.title, c.title) AS title, coalesce(p.content, c.content) AS content, p.grade
FROM corpus c FULL OUTER JOIN (
  SELECT id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, arg_max(content, seq) FILTER (WHERE content IS NOT NULL) AS content,
    arg_max(grade, seq) FILTER (WHERE grade IS NOT NULL) AS grade FROM patch GROUP BY id) p ON c.id = p.id""",
    ),
)
def m2(spark, d):
    return sync.partial_update(corpus(spark, d).select("id", "website", "title", "content"), patch(spark, d), "seq")


def delete_list(spark, d):
    """Ids of pages and of labelled documents: some are in the table, some are not."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"))
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")).unionByName(pages)


view("delete_list", [], "SELECT CAST(doc_id AS VARCHAR) AS id FROM labels UNION ALL SELECT 'p' || page_id FROM pages")


@query(
    "m3_delete_by_ids",
    with_views(
        ["corpus", "delete_list"],
        """SELECT 'remaining' AS part, id FROM corpus WHERE id NOT IN (SELECT id FROM delete_list)
UNION ALL SELECT 'deleted', id FROM corpus WHERE id IN (SELECT id FROM delete_list)
UNION ALL SELECT DISTINCT 'not_found', id FROM delete_list WHERE id NOT IN (SELECT id FROM corpus)""",
    ),
)
def m3(spark, d):
    parts = sync.delete_by_ids(corpus(spark, d), delete_list(spark, d))
    named = [p.select(F.lit(n).alias("part"), "id") for n, p in zip(("remaining", "deleted", "not_found"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("m4_get_by_ids", with_views(["corpus", "delete_list"], "SELECT id, title, content FROM corpus WHERE id IN (SELECT id FROM delete_list)"))
def m4(spark, d):
    return sync.get_by_ids(corpus(spark, d), delete_list(spark, d)).select("id", "title", "content")


@query(
    "m5_add_new_only",
    with_views(["old_set", "new_set"], f"SELECT {OUT_SQL} FROM old_set UNION ALL SELECT {OUT_SQL} FROM new_set WHERE id NOT IN (SELECT id FROM old_set)"),
)
def m5(spark, d):
    # The batch holds copies under one id.
    return sync.add_new_only(old_set(spark, d), sync.with_fingerprint(new_snap(spark, d)), "seq").select(*OUT)


@query(
    "m6_auto_sync",
    with_views(
        ["old_set", "new_set"],
        f"""SELECT {OUT_SQL} FROM old_set WHERE website <> 'src1' UNION ALL SELECT {OUT_SQL} FROM new_set
WHERE id NOT IN (SELECT id FROM old_set WHERE website <> 'src1')""",
    ),
)
def m6(spark, d):
    old = old_set(spark, d)
    return sync.auto_sync(old, old.filter("website = 'src1'"), sync.with_fingerprint(new_snap(spark, d)), "seq").select(*OUT)


@query(
    "m7_sync_change_batch",
    with_views(
        ["old_set", "new_set"],
        f"""SELECT {OUT_SQL} FROM old_set WHERE id IN (SELECT id FROM new_set) AND id NOT IN (SELECT id FROM new_set WHERE length(content) > 2000)
UNION ALL SELECT {OUT_SQL} FROM new_set WHERE length(content) > 2000""",
    ),
)
def m7(spark, d):
    old, new = old_set(spark, d), new_set(spark, d)
    batch = sync.with_fingerprint(new_snap(spark, d)).filter(F.length("content") > 2000)
    return sync.sync_change_batch(old, batch, sync.deleted(new, old), "seq").select(*OUT)


@query("m8_reset", with_views(["corpus"], "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after, 'id|website|content' AS columns FROM corpus"))
def m8(spark, d):
    path = new_path(spark, "table")
    corpus(spark, d).select("id", "website", "content").write.parquet(path)
    before = spark.read.parquet(path).count()
    sync.reset(spark, path)
    after = spark.read.parquet(path)
    return after.agg(F.lit(before).cast("long").alias("rows_before"), F.count("*").alias("rows_after"), F.lit("|".join(after.columns)).alias("columns"))


@query(
    "m9_index_stats",
    with_views(["corpus"], "SELECT website, count(*) AS n_docs FROM corpus GROUP BY website UNION ALL SELECT NULL, count(*) FROM corpus"),
)
def m9(spark, d):
    return sync.index_stats(corpus(spark, d))


@query(
    "m10_attach_vectors",
    """SELECT CAST(d.doc_id AS VARCHAR) AS id, e.vec_id IS NOT NULL AS has_vector, len(e.embedding) AS dim,
  list_aggregate(list_transform(e.embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), 'string_agg', ',') AS components FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def m10(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    ok, failed = sync.attach_vectors(corpus(spark, d).select("id"), vec)
    every = F.array_join(F.transform("vector", lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ",")
    good = ok.select("id", F.lit(True).alias("has_vector"), F.size("vector").alias("dim"), every.alias("components"))
    return good.unionByName(failed.select("id", F.lit(False).alias("has_vector")), allowMissingColumns=True)


# -- differences ----------------------------------------------------------
@query("d1_fingerprint", with_views(["new_snap"], f"SELECT seq, {FP} AS id FROM new_snap"))
def d1(spark, d):
    return sync.with_fingerprint(new_snap(spark, d)).select("seq", "id")


@query("d2_dedupe_exact", with_views(["new_set"], "SELECT id, seq, website FROM new_set"))
def d2(spark, d):
    return new_set(spark, d).select("id", "seq", "website")


@query("d3_added", with_views(["old_set", "new_set"], f"SELECT {OUT_SQL} FROM new_set WHERE id NOT IN (SELECT id FROM old_set)"))
def d3(spark, d):
    return sync.added(new_set(spark, d), old_set(spark, d)).select(*OUT)


@query("d4_deleted", with_views(["old_set", "new_set"], f"SELECT {OUT_SQL} FROM old_set WHERE id NOT IN (SELECT id FROM new_set)"))
def d4(spark, d):
    return sync.deleted(new_set(spark, d), old_set(spark, d)).select(*OUT)


CHANGES_SQL = """SELECT n.id, n.website, 'add' AS op, r.status <> 'SUCCESS' AS blocked FROM new_set n JOIN report r USING (website)
WHERE n.id NOT IN (SELECT id FROM old_set) UNION ALL
SELECT o.id, o.website, 'delete', r.status <> 'SUCCESS' FROM old_set o JOIN report r USING (website) WHERE o.id NOT IN (SELECT id FROM new_set)"""


@query("d5_circuit_breaker", with_views(["report"], CHANGES_SQL))
def d5(spark, d):
    return sync.circuit_breaker(new_set(spark, d), old_set(spark, d))


@query("d6_diff_report", with_views(["report"], "SELECT * FROM report"))
def d6(spark, d):
    return sync.diff_report(new_set(spark, d), old_set(spark, d))


@query("d7_empty_guard", with_views(["report"], f"SELECT id, website, op FROM ({CHANGES_SQL}) WHERE NOT blocked"))
def d7(spark, d):
    return sync.live_changes(new_set(spark, d), old_set(spark, d))


@query(
    "d8_apply_diff",
    with_views(
        ["report"],
        """SELECT id, website, content, seq FROM new_set WHERE website IN (SELECT website FROM report WHERE status = 'SUCCESS')
UNION ALL SELECT id, website, content, seq FROM old_set WHERE website IN (SELECT website FROM report WHERE status <> 'SUCCESS')""",
    ),
)
def d8(spark, d):
    return sync.apply_diff(new_set(spark, d), old_set(spark, d)).select(*OUT)


@query("d9_oversize_chunks", with_views(["corpus"], "SELECT id, title, token FROM corpus WHERE token > 1800"))
def d9(spark, d):
    return sync.oversize_chunks(corpus(spark, d)).select("id", "title", "token")


@query(
    "d10_run_summary",
    with_views(
        ["report"],
        """SELECT r.website, status, n_added, n_deleted,
  CASE status WHEN 'EMPTY_INPUT' THEN printf('[empty] %s: 0 rows (%.1fs), diff skipped', r.website, s)
    WHEN 'CIRCUIT_BREAKER_TRIGGERED' THEN printf('[blocked] %s: tried to delete %d rows, update refused', r.website, n_deleted)
    WHEN 'NO_CHANGE' THEN printf('[no change] %s (%.1fs)', r.website, s)
    ELSE printf('[ok] %s: added %d, deleted %d (%.1fs)', r.website, n_added, n_deleted, s) END AS message
FROM (SELECT report.*, coalesce(t.seconds, 0.0) AS s FROM report LEFT JOIN
  (SELECT source AS website, CAST(sum(n_chars) AS DOUBLE) / 10 AS seconds FROM documents GROUP BY 1) t USING (website)) r""",
    ),
)
def d10(spark, d):
    seconds = table(spark, d, "documents").groupBy(F.col("source").alias("website")).agg((F.sum("n_chars").cast("double") / 10).alias("seconds"))
    return sync.run_summary(sync.diff_report(new_set(spark, d), old_set(spark, d)), seconds)


# -- the whole run --------------------------------------------------------
@query(
    "sync_run",
    with_views(
        ["report"],
        f"""SELECT id, website, year, token, cleaned_content FROM (
  SELECT id, website, split_part(year_month, '-', 1) AS year, {sql_tokens("content")} AS token, {sql_clean("content")} AS cleaned_content FROM new_set
  WHERE website IN (SELECT website FROM report WHERE status = 'SUCCESS') AND id NOT IN (SELECT id FROM old_set)
  UNION ALL
  SELECT id, website, split_part(year_month, '-', 1), {sql_tokens("content")}, {sql_clean("content")} FROM old_set
  WHERE id IN (SELECT id FROM new_set) OR website IN (SELECT website FROM report WHERE status <> 'SUCCESS'))""",
    ),
)
def sync_run(spark, d):
    old, new = old_snap(spark, d), new_snap(spark, d)
    stored = sync_plan.enrich(sync.dedupe_exact(old), "2025-12-15-00-00")
    return sync_plan.next_table(stored, new, old, "2025-12-16-00-00").select("id", "website", "year", "token", "cleaned_content")
