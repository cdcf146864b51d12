from pyspark.sql import functions as F

from noticeboard.operators import sync
from noticeboard.session import new_path
from noticeboard.sources import snapshots
from noticeboard.streaming import sync as jobs

SNAP = "website string, main_title string, title string, content string, seq long"


def snap(spark, rows):
    return sync.dedupe_exact(spark.createDataFrame([(w, "m", "t", c, i) for i, (w, c) in enumerate(rows)], SNAP))


def statuses(spark, new, old):
    return {r.website: r for r in sync.diff_report(snap(spark, new), snap(spark, old)).collect()}


def test_breaker_needs_more_than_five_and_a_third(spark):
    old = [(w, str(i)) for w in ("five", "third", "more", "gone", "same") for i in range(18)]
    new = [("five", str(i)) for i in range(5, 18)] + [("third", str(i)) for i in range(6, 18)]
    new += [("more", str(i)) for i in range(7, 18)] + [("same", str(i)) for i in range(18)] + [("fresh", "1")]
    got = statuses(spark, new, old)
    assert {w: r.status for w, r in got.items()} == {
        "five": sync.SUCCESS, "third": sync.SUCCESS, "more": sync.BREAKER,
        "gone": sync.EMPTY_INPUT, "same": sync.NO_CHANGE, "fresh": sync.SUCCESS,
    }
    assert (got["more"].n_deleted, got["more"].n_old) == (7, 18)


def test_diff_conserves_rows(spark):
    old = [("w", str(i)) for i in range(30)]
    new = [("w", str(i)) for i in range(4, 40)]
    n, o = snap(spark, new), snap(spark, old)
    ids = lambda df: {r.id for r in df.collect()}
    assert (ids(o) - ids(sync.deleted(n, o))) | ids(sync.added(n, o)) == ids(n)
    assert ids(sync.apply_diff(n, o)) == ids(n)


def test_blocked_and_empty_sources_keep_their_rows(spark):
    old = [("a", str(i)) for i in range(12)] + [("b", "1"), ("b", "2")]
    new = [("a", "1"), ("c", "x")]
    out = sync.apply_diff(snap(spark, new), snap(spark, old)).groupBy("website").count().collect()
    assert {(r.website, r["count"]) for r in out} == {("a", 12), ("b", 2), ("c", 1)}


def test_one_hot_source(spark):
    """A source with most of the rows is joined by many tasks and stays whole."""
    rows = [("hot", str(i)) for i in range(3000)] + [(f"s{i}", "x") for i in range(50)]
    out = sync.apply_diff(snap(spark, rows), snap(spark, rows[:2990]))
    assert out.count() == 3050


def test_upsert_last_wins_and_deletes_go_first(spark):
    table = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, v string")
    batch = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "1", 3)], "id string, v string, seq int")
    gone = spark.createDataFrame([("a",), ("c",)], "id string")
    got = {(r.id, r.v) for r in sync.upsert(table, batch, "seq").collect()}
    assert got == {("a", "1"), ("b", "3"), ("c", "1")}
    got = {(r.id, r.v) for r in sync.sync_change_batch(table, batch, gone, "seq").collect()}
    assert got == {("b", "3"), ("c", "1")}


def test_missing_and_broken_snapshots_are_empty(spark):
    assert snapshots.read_snapshot(spark, new_path(spark, "missing")).count() == 0
    path = new_path(spark, "broken")
    spark.createDataFrame([("[{\"title\": ",)], "value string").coalesce(1).write.text(path)
    assert snapshots.read_snapshot(spark, path).count() == 0


def test_snapshot_replaces_only_its_sources(spark):
    path = new_path(spark, "snap")
    rows = lambda r: spark.createDataFrame(r, "website string, id string")
    snapshots.write_snapshot(rows([("a", "1"), ("b", "1")]), path)
    snapshots.write_snapshot(rows([("b", "2")]), path)
    assert {(r.website, r.id) for r in spark.read.parquet(path).collect()} == {("a", "1"), ("b", "2")}


def test_stream_applies_each_file_once(spark):
    schema = "id string, v string, op string, seq long"
    source, table, progress = (new_path(spark, n) for n in ("feed", "table", "progress"))
    base = spark.createDataFrame([("a", "0"), ("b", "0")], "id string, v string")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        jobs.sync_stream(stream, table, progress).awaitTermination()
        full = spark.createDataFrame([], schema).schema
        return {(r.id, r.v) for r in jobs.current_table(spark, base, table, full).collect()}

    feed([("a", None, "delete", 1), ("b", "1", "upsert", 2), ("c", "1", "upsert", 3), ("c", None, "delete", 4)])
    assert run() == {("b", "1"), ("c", "1")}
    feed([("c", None, "delete", 1), ("a", "2", "upsert", 2)])
    assert run() == {("a", "2"), ("b", "1")}
    assert run() == {("a", "2"), ("b", "1")}


def test_filters_reach_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("source", "website")
    from noticeboard.operators.filters import filter_documents

    plan = filter_documents(df, websites=["src1", "src2"]).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source" in plan and "text" not in plan.split("ReadSchema")[1]


def test_log_appends(spark):
    from noticeboard.sources.logs import append_log

    path = new_path(spark, "logs")
    for n in (2, 3):
        rows = spark.range(n).select("id", F.lit("chat").alias("log_type"), F.lit("2025-01-02 03:04:05").cast("timestamp").alias("ts"))
        append_log(rows, path)
    assert spark.read.json(path).filter("log_type = 'chat' and hour = '20250102_03'").count() == 5
