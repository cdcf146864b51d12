"""Toxicity and vector search."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeboard.llm import ann, toxicity
from tests.llm.brute import awkward, frame, prose


def events_of(text):
    classes = {w: k for k, ws in ((1, toxicity.INSULTS), (2, toxicity.THREATS), (3, toxicity.TARGETS), (4, toxicity.NEGATIONS), (5, toxicity.REPORTS)) for w in ws}
    return [toxicity.EVENTS[e] for e in toxicity.clause_events([classes.get(w, 0) for w in text.split()])]


def test_clauses():
    assert events_of("what an idiot") == ["insult"]
    assert events_of("you are an idiot") == ["insult_at"]
    assert events_of("she is not an idiot") == ["insult_negated"]
    assert events_of("he reportedly called the man an idiot") == ["insult_reported"]
    assert events_of("i will kill you") == ["threat"]
    assert events_of("i will never kill you") == ["threat_weak"]
    assert events_of("kill the process") == []
    assert events_of("nothing to see") == []


def test_clause_ends_stop_the_machine(spark):
    rows = [(1, "Not at all. An idiot!"), (2, "not an IDIOT,"), (3, "clean text"), (4, None), (5, ""), (None, "idiot"), (7, "stupid$$$ x")]
    got = {r.doc_id: r for r in toxicity.events(frame(spark, rows).select("doc_id", "text"), toxicity.Lexicon({})).collect()}
    assert (got[1].insult, got[1].insult_negated) == (1, 0)
    assert (got[2].insult, got[2].insult_negated) == (0, 1)
    assert all(sum(got[i][e] for e in toxicity.EVENTS) == 0 for i in (3, 4, 5))
    assert got[None].insult == 1 and got[7].insult == 1


def test_learned_stems_and_held_out_scores(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, prose(i, 40) + (f" zarg{i % 30} {prose(i, 5)} zarg{i % 17}" if bad else "")))
        labels.append((i, int(bad)))
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == bad for i, bad in labels)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(frame(spark, []), labels).count() == 0
    got = toxicity.score(frame(spark, [*awkward(), (None, "idiot"), (1, "again")]), labels.limit(0)).collect()
    assert len(got) == len(awkward()) + 2
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"list": F.lit(1), "rank": F.lit(1), "vector": F.lit("x")})


def exact(ids, table, query, k):
    value = table.astype(np.float32).astype(float) @ table[query].astype(np.float32).astype(float)
    order = np.lexsort((ids, -np.round(value, 12)))
    return [int(ids[i]) for i in order if ids[i] != ids[query]][:k]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    table = rng.normal(size=(12, 24))[rng.integers(0, 12, 4000)] + 0.6 * rng.normal(size=(4000, 24))
    table *= rng.uniform(0.5, 2, (4000, 1))  # lengths differ, so the largest product is not the smallest angle
    ids = np.arange(4000)
    rows = ann.search(vectors(spark, [(int(i), v.tolist()) for i, v in zip(ids, table, strict=True)]), F.col("vec_id") % 20 == 0, 20).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r["rank"]] = r
    hit = 0
    for q in range(0, 4000, 20):
        assert sorted(found[q]) == list(range(1, 21))
        scores = [found[q][k].score for k in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        hit += len({r.vec_id for r in found[q].values()} & set(exact(ids, table, q, 20)))
    assert hit >= 0.9 * 200 * 20


def test_ties_and_vectors_that_take_no_part(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(0, same), *[(i, same) for i in range(30, 5, -1)], (31, None), (32, [0.0, 0.0, 0.0]), (33, [1.0, None, 1.0]), (34, [float("nan"), 1.0, 1.0])]
    rows += [(35, [float("inf"), 1.0, 1.0]), (40, [1.0]), (None, same), (60, None), (6, same)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, k, k + 5, 5.0) for k in range(1, 21)]


def test_few_and_no_vectors(spark):
    got = ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0])]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert ann.search(vectors(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_near_uniform_vectors_in_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 25)  # as many lists as from 409,600 vectors on
    rng = np.random.default_rng(7)
    n = 102_400
    table = rng.normal(size=(n, 48)).astype(np.float32)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    rows = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(table.ravel(), 48).cast(pa.list_(pa.float32()))})
    found = {}
    for r in ann.search(spark.createDataFrame(rows), F.col("vec_id") % 2048 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(found[q] & set(exact(np.arange(n), table, q, 20))) for q in range(0, n, 2048))
    assert hit >= 0.9 * len(found) * 20


def test_a_query_reads_as_many_lists_as_the_ratio_asks():
    rng = np.random.default_rng(5)
    table = rng.normal(size=(6000, 48)).astype(np.float32)
    longest = float(np.linalg.norm(table, axis=1).max())
    graph = ann.Graph.build(ann.fit_centroids(ann.lifted(table, longest), 600, 2))
    queries = pa.RecordBatch.from_pydict({"vec_id": np.arange(9), "vector": pa.array(list(table[:9]), pa.list_(pa.float32()))})
    away = np.linalg.norm(ann.lifted_queries(table[:9], longest)[:, None].astype(float) - graph.centroids, axis=2)
    for ratio in (0.1, 0.5, np.inf):
        read = ann._probe(SimpleNamespace(value=graph), longest, SimpleNamespace(value=np.full(600, 10_000)), ratio)
        got = sum(np.bincount(batch["query_id"], minlength=9) for batch in read(iter([queries])))
        assert abs(got - (away <= away.min(axis=1, keepdims=True) * (1 + min(ratio, 1e9))).sum(axis=1)).max() <= 1
    assert (got == 600).all()
