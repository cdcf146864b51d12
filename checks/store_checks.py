"""Stored tables: array files, newest batches, bucketed tables, the change log and its breaker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from checks.sync_checks import FP, OUT, OUT_SQL, delete_list, new_set, old_set
from checks.views import candidates, corpus, new_snap, table, vectors, view, with_views
from noticeboard.operators import sync
from noticeboard.plans import library
from noticeboard.session import new_path
from noticeboard.sources import buckets, changelog, snapshots
from noticeboard.streaming import sync as sync_jobs

BUCKETS = 16


def fresh_name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


# -- array files ----------------------------------------------------------
# Every tenth element is a bare text, every third has a field of its own, and one file per language is no JSON.
RAW = "website, link, main_title, title, content, year_month"
view(
    "elements",
    ["corpus"],
    "SELECT *, seq % 10 = 3 AS bare, CASE WHEN seq % 3 = 0 THEN '{\"grade\":' || seq || ',\"tags\":[\"' || lang || '\"]}' END AS extra FROM corpus",
)


def write_arrays(spark, d):
    """A folder with arrays, files that are no JSON, an empty array and an array with a null."""
    path = new_path(spark, "arrays")
    seq = F.col("seq")
    docs = corpus(spark, d).withColumn("grade", F.when(seq % 3 == 0, seq)).withColumn("tags", F.when(seq % 3 == 0, F.array("lang")))
    fields = F.to_json(F.struct(*RAW.split(", "), "grade", "tags"))
    rows = docs.select("website", F.when(seq % 10 == 3, F.concat(F.lit('"'), "id", F.lit('"'))).otherwise(fields).alias("row"))
    arrays = rows.groupBy("website", F.spark_partition_id()).agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    broken = table(spark, d, "documents").groupBy("lang").agg(F.concat(F.lit('[{"title": "'), F.first("lang"), F.lit('"}, {"content')).alias("value"))
    broken.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)
    spark.createDataFrame([("[]",), ("[null]",)], "value string").repartition(2).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return path


@query("s1_array_rows", with_views(["elements"], f"SELECT {RAW}, extra FROM elements WHERE NOT bare"))
def s1_rows(spark, d):
    rows = snapshots.read_arrays(spark, write_arrays(spark, d))[0]
    return rows.select(*RAW.split(", "), F.to_json("extra").alias("extra"))


@query(
    "s1_array_rejects",
    with_views(
        ["elements"],
        """SELECT 'element is no object' AS reason, '"' || id || '"' AS text FROM elements WHERE bare
UNION ALL SELECT 'element is no object', 'null'
UNION ALL SELECT 'file is no JSON', '[{"title": "' || lang || '"}, {"content' || chr(10) FROM documents GROUP BY lang""",
    ),
)
def s1_rejects(spark, d):
    return snapshots.read_arrays(spark, write_arrays(spark, d))[1].select("reason", "text")


@query(
    "s8_newest_batch",
    with_views(["old_set", "new_set"], "SELECT id, content FROM new_set WHERE id NOT IN (SELECT id FROM old_set)"),
)
def s8_newest(spark, d):
    """The batch written last has the name that sorts first."""
    old, new = old_set(spark, d).select("id", "content"), new_set(spark, d).select("id", "content")
    path = new_path(spark, "batches")
    snapshots.change_sink(old, sync.deleted(new, old), path, "20251216_000000")
    snapshots.change_sink(sync.added(new, old), sync.deleted(new, old), path, "20251215_000000")
    return snapshots.read_newest_batch(spark, f"{path}/upsert", new.schema)


# -- bucketed tables ------------------------------------------------------
def bucketed(spark, rows, kind="docs"):
    name = fresh_name(kind)
    buckets.create(rows, name, new_path(spark, name), BUCKETS)
    return name


@query(
    "m7_bucketed_changes",
    with_views(
        ["old_set", "new_set"],
        f"""SELECT {OUT_SQL} FROM old_set WHERE id IN (SELECT id FROM new_set) AND id NOT IN (SELECT id FROM new_set WHERE length(content) > 2000)
UNION ALL SELECT {OUT_SQL} FROM new_set WHERE length(content) > 2000""",
    ),
)
def m7_bucketed(spark, d):
    old = old_set(spark, d).select(*OUT)
    name = bucketed(spark, old)
    batch = sync.with_fingerprint(new_snap(spark, d)).filter(F.length("content") > 2000).select(*OUT, F.lit("upsert").alias("op"))
    gone = sync.deleted(new_set(spark, d), old).select(*OUT, F.lit("delete").alias("op"))
    buckets.apply_changes(spark, name, batch.unionByName(gone), "seq")
    return buckets.rows_of(spark, name)


@query("m4_bucketed_lookup", with_views(["corpus", "delete_list"], "SELECT id, title, content FROM corpus WHERE id IN (SELECT id FROM delete_list)"))
def m4_bucketed(spark, d):
    name = bucketed(spark, corpus(spark, d).select("id", "title", "content"))
    return buckets.lookup(spark, name, delete_list(spark, d))


@query(
    "m10_bucketed_vectors",
    """SELECT CAST(d.doc_id AS VARCHAR) AS id, e.vec_id IS NOT NULL AS has_vector, CAST(floor(CAST(e.embedding[1] AS DOUBLE) * 1000000) AS BIGINT) AS first
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def m10_bucketed(spark, d):
    docs = bucketed(spark, corpus(spark, d).select("id", "content"))
    stored = bucketed(spark, table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), "vectors")
    ok, failed = buckets.attach(spark, docs, stored)
    good = ok.select("id", F.lit(True).alias("has_vector"), F.floor(F.col("vector")[0].cast("double") * 1000000).alias("first"))
    return good.unionByName(failed.select("id", F.lit(False).alias("has_vector")), allowMissingColumns=True)


@query(
    "h3_filtered_search",
    with_views(
        ["hybrid_hits", "limits", "corpus"],
        """SELECT c.id, h.rank, h.score, c.title, c.content, c.year_month, c.website FROM hybrid_hits h JOIN limits l USING (request_id) JOIN corpus c ON c.id = h.id
WHERE h.request_id = 4 AND h.cand = 0 AND h.rank <= l.final_limit""",
    ),
)
def h3_filtered(spark, d):
    """One request with months and websites over the stored corpus."""
    path = new_path(spark, "library")
    stored = library.store(corpus(spark, d).select(*library.DOC_COLUMNS), vectors(spark, d), fresh_name("library"), path, BUCKETS)
    one = candidates(spark, d).filter("request_id = 4 AND cand = 0")
    return library.filtered_search(spark, stored, one).select("id", "rank", "score", "title", "content", "year_month", "website")


# -- change log -----------------------------------------------------------
COLS = ["id", "website", "content", "seq"]


#: Characters of texts in one file of a feed, which one task writes and one reads.
FEED_CHARS = 32 << 20


def files_per_batch(spark, d):
    """Files of each of six batches, as many as the texts need."""
    sizes = [table(spark, d, t).agg(F.sum(F.length(c))).first()[0] or 0 for t, c in (("documents", "text"), ("pages", "html"))]
    return 1 + 2 * sum(sizes) // (6 * FEED_CHARS)  # the last batch has a third of all


@query(
    "x1_compacted_stream",
    with_views(
        ["new_snap"],
        f"""SELECT id, website, content, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM (SELECT {FP} AS id, * FROM new_snap)) WHERE rn = 1""",
    ),
)
def x1_compacted(spark, d):
    """Six batches of changes with a compaction after every second one, the last in a later run."""
    old, new = old_set(spark, d), new_set(spark, d)
    ups = sync.with_fingerprint(new_snap(spark, d)).select(*COLS, F.lit("upsert").alias("op"))
    gone = sync.deleted(new, old).select(*COLS, F.lit("delete").alias("op"))
    source, out, progress = (new_path(spark, n) for n in ("feed", "table", "progress"))
    changes = ups.unionByName(gone)
    changelog.create(old.select(*COLS), out)
    each = files_per_batch(spark, d)
    for part, batches in (("seq % 3 > 0", 5), ("seq % 3 = 0", 1)):
        changes.filter(part).repartition(batches * each, "id").write.mode("append").json(source)
        feed = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", each).json(source)
        sync_jobs.sync_stream(feed, out, progress, compact_every=2).awaitTermination()
    return changelog.current(spark, out, changes.schema).select(*COLS)


GUARDED = """SELECT id, website, content, seq FROM new_set WHERE website IN (SELECT website FROM report WHERE status = 'SUCCESS') AND id NOT IN (SELECT id FROM old_set)
UNION ALL SELECT id, website, content, seq FROM old_set WHERE id IN (SELECT id FROM new_set) OR website IN (SELECT website FROM report WHERE status <> 'SUCCESS')"""


def guarded(spark, d):
    """A stream of unguarded differences, whole sources in a file; deletions name ids alone."""
    source, out = new_path(spark, "feed"), new_path(spark, "table")
    sync_jobs.start_guarded(old_set(spark, d).select(*COLS), out)
    old, new = changelog.base(spark, out), sync.with_fingerprint(new_snap(spark, d))
    site = F.col("website").alias("site")
    # copies are dropped among the added rows only, so unchanged texts are not shuffled
    ups = sync.last_per_id(sync.added(new, old), "seq").select(*COLS, F.lit("upsert").alias("op"), site)
    gone = sync.deleted(new, old).select("id", F.lit(None).cast("string").alias("website"), F.lit(None).cast("string").alias("content"), "seq", F.lit("delete").alias("op"), site)
    changes = ups.unionByName(gone)
    changes.repartition(8, "site").drop("site").write.json(source)
    schema = changes.drop("site").schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(source)
    sync_jobs.guarded_stream(feed, out, new_path(spark, "progress"), compact_every=3).awaitTermination()
    return out, schema


@query("x1_guarded_stream", with_views(["report"], GUARDED))
def x1_guarded(spark, d):
    out, schema = guarded(spark, d)
    return changelog.current(spark, out, schema).select(*COLS)


@query(
    "x1_source_states",
    with_views(
        ["report"],
        """SELECT website, CASE WHEN status IN ('SUCCESS', 'NO_CHANGE') THEN n_new ELSE n_old END AS n_rows,
  CAST(status IN ('EMPTY_INPUT', 'CIRCUIT_BREAKER_TRIGGERED') AS BIGINT) AS refused FROM report""",
    ),
)
def x1_states(spark, d):
    out, _ = guarded(spark, d)
    return sync_jobs.last_states(sync_jobs.source_states(spark, out)).select("website", "n_rows", "refused")
