"""Stored tables: array files, the change log and its breaker, bucketed tables, and one request over a stored corpus."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from checks import views
from noticeboard.operators import ranking, sync
from noticeboard.plans import library, search
from noticeboard.session import Scratch, new_path, remove
from noticeboard.sources import buckets, changelog, snapshots
from noticeboard.streaming import sync as jobs


# -- array files ----------------------------------------------------------
def test_arrays_rejects_and_open_fields(spark, tmp_path):
    files = {
        "a.json": '[{"title": "x", "n": 1, "o": {"z": [1, 2]}}, {"title": null, "content": 5}, 3, null, ["y"]]',
        "broken.json": '[{"title": "x"}, {"ti',
        "blank.json": " \n ",
        "one.json": '\n{"title": "alone", "odd key": "v"}',
        "none.json": "[]",
        "empty.json": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, rejects = snapshots.read_arrays(spark, str(tmp_path))
    got = [(r.source_file, r.position, r.title, r.content, r.e) for r in rows.withColumn("e", F.to_json("extra")).orderBy("source_file", "position").collect()]
    assert got == [
        ("a.json", 0, "x", None, '{"n":1,"o":{"z":[1,2]}}'),
        ("a.json", 1, None, "5", None),
        ("one.json", 0, "alone", None, '{"odd key":"v"}'),
    ]
    bad = {(r.source_file, r.position, r.reason, r.text) for r in rejects.collect()}
    assert bad == {
        ("a.json", 2, "element is no object", "3"),
        ("a.json", 3, "element is no object", "null"),
        ("a.json", 4, "element is no object", '["y"]'),
        ("broken.json", None, "file is no JSON", files["broken.json"]),
        ("blank.json", None, "file is no JSON", files["blank.json"]),
    }
    counts = {(r.source_file, r.reason): r.n for r in snapshots.count_rejects(rejects).collect()}
    assert counts[("a.json", "element is no object")] == 3
    nothing = snapshots.read_arrays(spark, str(tmp_path / "missing"))
    assert [df.count() for df in nothing] == [0, 0] and nothing[0].columns == rows.columns


def test_array_files_stay_small_however_large_the_partition(spark, tmp_path):
    rows = spark.range(300).select(F.concat("id", F.lit('"\n'), F.repeat(F.lit("é"), 40_000)).alias("title")).coalesce(1)
    snapshots.write_snapshot_json(rows, str(tmp_path / "s"))
    sizes = [f.stat().st_size for f in (tmp_path / "s").glob("part-*")]
    assert len(sizes) > 2 and max(sizes) < 3 * snapshots.ARRAY_CHARS  # é takes two bytes
    read, rejects = snapshots.read_arrays(spark, str(tmp_path / "s"))
    assert read.select("title").exceptAll(rows).isEmpty() and read.count() == 300 and rejects.isEmpty()
    snapshots.write_snapshot_json(rows.filter("false"), str(tmp_path / "none"))
    assert [df.count() for df in snapshots.read_arrays(spark, str(tmp_path / "none"))] == [0, 0]


def test_only_a_missing_path_is_an_empty_source(spark):
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        snapshots.read_arrays(spark, "nosuchstore://x/y")[0].collect()


def test_newest_batch_by_time_of_files(spark):
    path = new_path(spark, "batches")
    for name, v in (("c", 1), ("b", 2), ("a", 3)):
        spark.createDataFrame([(v,), (v + 10,)], "v long").repartition(2).write.json(f"{path}/batch={name}")
    assert snapshots.newest_batch(spark, path).endswith("/batch=a")
    assert {r.v for r in snapshots.read_newest_batch(spark, path, spark.createDataFrame([], "v long").schema).collect()} == {3, 13}
    os.utime(path.removeprefix("file:") + "/batch=c/" + [f for f in os.listdir(path.removeprefix("file:") + "/batch=c") if f.startswith("part")][0], (4e9, 4e9))
    assert snapshots.newest_batch(spark, path).endswith("/batch=c")


# -- change log -----------------------------------------------------------
CHANGE = "id string, v string, op string, seq long"


def state(spark, table):
    schema = spark.createDataFrame([], CHANGE).schema
    return {(r.id, r.v) for r in changelog.current(spark, table, schema).collect()}


def local(path):
    return path.removeprefix("file:")


def test_compaction_keeps_the_table_and_skips_folded_batches(spark):
    table, schema = new_path(spark, "table"), spark.createDataFrame([], CHANGE).schema
    changelog.create(spark.createDataFrame([("a", "0"), ("b", "0")], "id string, v string"), table)
    batches = [
        [("a", "1", "upsert", 1), ("c", "1", "upsert", 2)],
        [("b", None, "delete", 1)],
        [("b", "2", "upsert", 2), ("a", None, "delete", 1), ("a", "3", "upsert", 0)],
        [("c", None, "delete", 1)],
    ]
    want = [{("a", "1"), ("b", "0"), ("c", "1")}, {("a", "1"), ("c", "1")}, {("a", "3"), ("b", "2"), ("c", "1")}, {("a", "3"), ("b", "2")}]
    bases = []
    for i, rows in enumerate(batches):
        changelog.append(spark.createDataFrame(rows, CHANGE), table, i)
        assert state(spark, table) == want[i]
        if i % 2:
            assert changelog.compact(spark, table, schema) == i
            assert state(spark, table) == want[i]
            bases.append(changelog.versions(spark, table)[0].base)
            # later batches alone are read, and nothing of them is left to fold
            later = changelog.later_changes(spark, table, schema, i)
            assert later.count() == 0 and f"isnotnull(batch_id" in later._jdf.queryExecution().executedPlan().toString()
    assert changelog.compact(spark, table, schema) == 3  # nothing new, nothing done
    left = {f for f in os.listdir(local(table)) if f.startswith("base-")}
    assert left == set(bases)  # the first base is gone, the one just replaced stays for its readers
    assert {f for f in os.listdir(local(table) + "/changes") if f.startswith("batch")} == {"batch_id=2", "batch_id=3"}
    # what is folded is not opened: the table is the same without it
    for n in (2, 3):
        remove(spark, f"{table}/changes/batch_id={n}")
    assert state(spark, table) == want[3]


def test_a_failed_compaction_changes_nothing(spark, monkeypatch):
    table, schema = new_path(spark, "table"), spark.createDataFrame([], CHANGE).schema
    changelog.create(spark.createDataFrame([("a", "0")], "id string, v string"), table)
    changelog.append(spark.createDataFrame([("a", "1", "upsert", 1)], CHANGE), table, 0)
    with monkeypatch.context() as m:
        m.setattr(changelog, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            changelog.compact(spark, table, schema)
    assert state(spark, table) == {("a", "1")} and changelog.versions(spark, table)[0].upto == changelog.NO_BATCH
    assert changelog.compact(spark, table, schema) == 0 and state(spark, table) == {("a", "1")}


# -- breaker --------------------------------------------------------------
GUARDED = "id string, website string, v string, op string, seq long"


def run_guarded(spark, source, table, progress, **more):
    feed = spark.readStream.schema(GUARDED).option("maxFilesPerTrigger", 1).json(source)
    jobs.guarded_stream(feed, table, progress, **more).awaitTermination()


def rows_of(spark, table):
    schema = spark.createDataFrame([], GUARDED).schema
    return {(r.id, r.website, r.v) for r in changelog.current(spark, table, schema).collect()}


def states_of(spark, table):
    return {r.website: (r.n_rows, r.refused, r.status) for r in jobs.last_states(jobs.source_states(spark, table)).collect()}


def test_refused_sources_keep_their_rows_over_restarts(spark, monkeypatch):
    source, table, progress = (new_path(spark, n) for n in ("feed", "table", "progress"))
    base = [(f"{w}{i}", w, "0") for w in ("x", "y", "z") for i in range(18)]
    jobs.start_guarded(spark.createDataFrame(base, "id string, website string, v string"), table)

    def feed(rows):
        spark.createDataFrame(rows, GUARDED).coalesce(1).write.mode("append").json(source)

    # x loses seven of eighteen rows and gains one: refused as a whole; y loses six: allowed; z is updated
    feed(
        [(f"x{i}", None, None, "delete", i) for i in range(7)] + [("x99", "x", "1", "upsert", 9)]
        + [(f"y{i}", None, None, "delete", i) for i in range(6)] + [("nobody", None, None, "delete", 1)]
        + [("z0", "z", "1", "upsert", 1), ("new0", "new", "1", "upsert", 1)]
    )
    with monkeypatch.context() as m:  # the first run is lost after its changes are stored
        m.setattr(jobs.changelog, "compact", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run_guarded(spark, source, table, progress, compact_every=1)
    run_guarded(spark, source, table, progress, compact_every=1)
    want = {r for r in base if r[1] != "y" and r[0] != "z0"} | {(f"y{i}", "y", "0") for i in range(6, 18)} | {("z0", "z", "1"), ("new0", "new", "1")}
    assert rows_of(spark, table) == want
    got = states_of(spark, table)
    assert got.pop(None) == (0, 0, sync.NO_CHANGE)  # the delete of an unknown id names no source
    assert got == {"x": (18, 1, sync.BREAKER), "y": (12, 0, sync.SUCCESS), "z": (18, 0, sync.NO_CHANGE), "new": (1, 0, sync.SUCCESS)}
    # the counts go on from batch to batch: five of twelve is too few to trip, all of new is empty, x is refused again
    feed(
        [(f"y{i}", None, None, "delete", i) for i in range(6, 11)] + [("new0", None, None, "delete", 1)]
        + [(f"x{i}", None, None, "delete", i) for i in range(18)]
    )
    run_guarded(spark, source, table, progress, compact_every=1)
    assert rows_of(spark, table) == {r for r in want if r[0] not in {f"y{i}" for i in range(6, 11)}}
    got = states_of(spark, table)
    assert got["x"] == (18, 2, sync.EMPTY_INPUT) and got["y"] == (7, 0, sync.SUCCESS) and got["new"] == (1, 1, sync.EMPTY_INPUT)
    refused = spark.read.parquet(f"{table}/refused").groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in refused} == {0: 8, 1: 19}
    run_guarded(spark, source, table, progress, compact_every=1)  # nothing new
    assert states_of(spark, table) == got


def test_a_run_leaves_nothing_behind(spark):
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(5), "five")
        assert kept.count() == 5 and os.path.isdir(local(scratch.folder))
    assert not os.path.isdir(local(scratch.folder))


# -- bucketed tables ------------------------------------------------------
def bucketed(spark, rows, n=8):
    name = f"t_{uuid.uuid4().hex}"
    buckets.create(rows, name, new_path(spark, name), n)
    return name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scans of a plan without exchanges opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def numbered(spark, n, start=0):
    return spark.range(start, n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))


def test_changes_rewrite_touched_slots_without_shuffling_the_table(spark, no_broadcast):
    name = bucketed(spark, numbered(spark, 4000), 16)
    path = local(spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'").first().data_type)
    files = lambda: {s: sorted(f for f in os.listdir(f"{path}/{s}") if f.startswith("part")) for s in os.listdir(path) if s.startswith("slot")}
    before = files()
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    changes = spark.createDataFrame([("5", 50, "upsert", 1), ("5", 51, "upsert", 2), ("7", None, "delete", 1), ("new", 1, "upsert", 1), ("none", None, "delete", 1)], "id string, v long, op string, seq long")
    rows, slots = buckets.changed_rows(spark, name, changes, "seq")
    text = plan(rows)
    table_side = text[: text.index("Exchange")] if "Exchange" in text else text
    assert "Bucketed: true" in table_side and re.search(r"PartitionFilters: \[.*slot", table_side)
    assert text.count("FileScan") == 1 and "FileScan" in table_side  # exchanges are below the other side alone
    assert buckets.apply_changes(spark, name, changes, "seq") == slots
    after = files()
    assert {s for s in before if before[s] != after[s]} == {f"slot={s}" for s in slots} and all(len(f) == 1 for f in after.values())
    want = {str(i): i for i in range(4000) if i != 7} | {"5": 51, "new": 1}
    assert {r.id: r.v for r in buckets.rows_of(spark, name).collect()} == want
    buckets.apply_changes(spark, name, changes, "seq")
    assert {r.id: r.v for r in buckets.rows_of(spark, name).collect()} == want


def test_a_slot_that_loses_all_rows_is_empty(spark):
    name = bucketed(spark, numbered(spark, 3), 4)
    gone = numbered(spark, 3).select("id", F.lit(None).cast("long").alias("v"), F.lit("delete").alias("op"), F.lit(1).alias("seq"))
    buckets.apply_changes(spark, name, gone.filter("id <> '1'"), "seq")
    assert [r.id for r in buckets.rows_of(spark, name).collect()] == ["1"]
    buckets.apply_changes(spark, name, gone.unionByName(gone), "seq")
    assert buckets.rows_of(spark, name).count() == 0
    assert buckets.apply_changes(spark, name, gone.limit(0), "seq") == []


def test_vectors_join_without_any_shuffle(spark, no_broadcast):
    docs = bucketed(spark, numbered(spark, 500))
    stored = bucketed(spark, spark.range(0, 500, 2).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vector")))
    ok, failed = buckets.attach(spark, docs, stored)
    assert "Exchange" not in plan(ok) and (ok.count(), failed.count()) == (250, 250)


def test_lookups_open_the_slots_of_their_ids(spark):
    name = bucketed(spark, numbered(spark, 2000), 32)
    few = spark.createDataFrame([("3",), ("4",), ("3",), ("none",)], "id string")
    found = buckets.lookup(spark, name, few)
    assert {r.id for r in found.collect()} == {"3", "4"} and files_read(buckets.lookup(spark, name, few)) <= 3
    many = numbered(spark, 1500).select("id")
    assert buckets.lookup(spark, name, many, most=100).count() == 1500


# -- one request ----------------------------------------------------------
@pytest.fixture(scope="module")
def stored(spark, folder):
    docs, vecs = views.corpus(spark, folder), views.vectors(spark, folder)
    return library.store(docs.select(*library.DOC_COLUMNS), vecs, f"lib_{uuid.uuid4().hex}", new_path(spark, "library"), 8)


def test_one_request_finds_what_the_bulk_search_finds(spark, folder, stored):
    cands = views.candidates(spark, folder).filter("cand = 0").cache()
    bulk = search.multi_search(cands, stored.index, views.vectors(spark, folder)).collect()
    limits = {r.request_id: r.final_limit for r in cands.select("request_id", "final_limit").collect()}
    for request in (0, 4, 7, 9, 14, 19):
        got = library.filtered_search(spark, stored, cands.filter(F.col("request_id") == request)).collect()
        want = [r for r in bulk if r.request_id == request and r["rank"] <= limits[request]]
        assert sorted((r["rank"], r.id, r.score) for r in got) == sorted((r["rank"], r.id, r.score) for r in want)


def test_months_prune_folders_and_seen_ids_are_left_out(spark, folder, stored):
    one = views.candidates(spark, folder).filter("request_id = 4 AND cand = 0")
    request = one.first().asDict()
    assert request["months"] and request["websites"]
    found = library.allowed_vectors(spark, stored, request)
    everything = library.allowed_vectors(spark, stored, request | {"months": [], "websites": [], "years": [], "manual_websites": []})
    assert files_read(found.select("id")) == 1 < files_read(everything.select("id"))
    assert everything.count() == views.vectors(spark, folder).count()
    first = library.filtered_search(spark, stored, one).orderBy("rank").first().id
    again = library.filtered_search(spark, stored, one.withColumn("exclude_ids", F.array(F.lit(first)))).collect()
    assert first not in {r.id for r in again}


def test_single_search_takes_the_best(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.9)], "id string, score double")
    assert [r.id for r in ranking.single_search(rows, 2).collect()] == ["b", "c"]


def test_batches_of_a_feed_take_as_many_files_as_their_texts_need(spark, folder, monkeypatch):
    from checks import store_checks

    assert store_checks.files_per_batch(spark, folder) == 1
    monkeypatch.setattr(store_checks, "FEED_CHARS", 20_000)
    assert store_checks.files_per_batch(spark, folder) > 2


def counting(spark):
    """A function of ids and how often it was called."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"t{i}"

    return text.asNondeterministic(), made


def test_retries_make_each_text_once(spark):
    from noticeboard.operators import embedding

    text, made = counting(spark)
    docs = spark.range(20).select(F.col("id").cast("string").alias("id"), text("id").alias("cleaned_content"))
    answers = lambda asked, attempt: asked.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit("busy").alias("error"))
    tries = embedding.embed_with_retries(docs, answers).attempts
    assert tries.select("id", "attempt").distinct().count() > 20 and made.value == 20


def test_vocabulary_is_made_once_for_prefixes(spark, monkeypatch):
    from noticeboard.operators import lexical

    monkeypatch.setattr(lexical, "RANGE_TERMS", 10)
    text, made = counting(spark)
    vocabulary = spark.range(50).select(text("id").alias("term"))
    assert lexical.prefix_pairs(spark.createDataFrame([("t1",)], "term string"), vocabulary).count() == 10
    assert made.value == 50


def test_first_states_count_the_written_base(spark, tmp_path):
    """Rows that come out otherwise when they are made again show whether they are made once."""
    site = F.udf(lambda _: f"s{os.urandom(1)[0] % 4}", "string").asNondeterministic()
    table = str(tmp_path / "table")
    jobs.start_guarded(spark.range(2000).select(F.col("id").cast("string").alias("id"), site("id").alias("website")), table)
    counts = {r.website: r["count"] for r in changelog.base(spark, table).groupBy("website").count().collect()}
    assert {r.website: r.n_rows for r in jobs.source_states(spark, table).collect()} == counts
