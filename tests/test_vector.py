import numpy as np
from pyspark.sql import functions as F

from noticeboard.operators import vector


def tables(spark, n_docs=400, n_queries=7, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    d, q = rng.standard_normal((n_docs, dim)), rng.standard_normal((n_queries, dim))
    d[5] = d[4]  # a tie
    docs = spark.createDataFrame(
        [(f"{i:04d}", f"2024-{i % 12 + 1:02d}", f"l{i}", f"w{i % 3}", d[i].tolist()) for i in range(n_docs)],
        "id string, year_month string, link string, website string, vector array<double>",
    ).repartition(5)
    queries = spark.createDataFrame(
        [(i, 0, q[i].tolist(), 9, ["2024-03"] if i == 2 else [], ["w1"] if i == 3 else [], "2024-05-01" if i == 4 else None) for i in range(n_queries)],
        "request_id long, cand int, vector array<double>, pre_limit int, months array<string>, websites array<string>, start_date string",
    )
    none = F.array().cast("array<string>")
    for c in ("years", "links", "manual_websites"):
        queries = queries.withColumn(c, none)
    seen = F.array(F.lit("0004"), F.lit("0005"), F.lit("0010"))
    queries = queries.withColumn("exclude_ids", F.when(F.col("request_id") == 1, seen).otherwise(none))
    return d, q, docs, queries.withColumn("end_date", F.lit(None).cast("string"))


def expected(d, q):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(d).T, 6)
    out = {}
    for i in range(len(q)):
        rows = [
            (-scores[i][j], f"{j:04d}") for j in range(len(d))
            if (i != 2 or j % 12 + 1 == 3) and (i != 3 or j % 3 == 1) and (i != 4 or j % 12 + 1 >= 5)
            and (i != 1 or j not in (4, 5, 10))
        ]
        out[i] = [x for _, x in sorted(rows)[:9]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.request_id, r["rank"])):
        out.setdefault(r.request_id, []).append(r.id)
    return out


def test_cosine_topk_is_exact_with_filters(spark):
    d, q, docs, queries = tables(spark)
    assert found(vector.cosine_topk(queries, docs)) == expected(d, q)


def test_cosine_topk_in_several_blocks(spark, monkeypatch):
    d, q, docs, queries = tables(spark, n_queries=11)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert found(vector.cosine_topk(queries, docs)) == expected(d, q)


def test_lsh_finds_most_of_the_exact_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    d = np.repeat(centres, 15, axis=0) + 0.15 * rng.standard_normal((300, 16))
    docs = spark.createDataFrame([(f"{i:04d}", d[i].tolist()) for i in range(300)], "id string, vector array<double>")
    queries = spark.createDataFrame([(i, 0, centres[i].tolist()) for i in range(20)], "request_id long, cand int, vector array<double>")
    got = found(vector.cosine_topk_lsh(queries, docs, dim=16, k=10))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    exact = np.argsort(-(unit(centres) @ unit(d).T), axis=1)[:, :10]
    hit = sum(len({f"{j:04d}" for j in exact[i]} & set(got.get(i, []))) for i in range(20))
    assert hit / 200 >= 0.9


def test_match_heading_needs_the_minimum(spark):
    titles = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 20, [1.0, 0.0])], "page long, title_id long, vector array<double>")
    headings = spark.createDataFrame(
        [(1, 11, [0.9, 0.1]), (1, 12, [0.5, 0.5]), (2, 21, [0.1, 0.9])], "page long, heading_id long, vector array<double>"
    )
    assert [(r.title_id, r.heading_id) for r in vector.match_heading(titles, headings).collect()] == [(10, 11)]


def test_lsh_probes_follow_the_vectors(spark):
    """Directed probing reaches nine tenths on 100,000 clustered vectors and reads few of them."""
    n, dim, k = 100_000, 32, 10
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((400, dim))
    rows = centres[rng.integers(0, 400, n)] + 0.35 * rng.standard_normal((n, dim))
    docs = spark.createDataFrame([(f"{i:06d}", r.tolist()) for i, r in enumerate(rows)], "id string, vector array<double>").repartition(8)
    asked = rows[:50] + 0.05 * rng.standard_normal((50, dim))
    queries = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(asked)], "request_id long, cand int, vector array<double>")
    bits = 10
    planes = vector.calibrated(queries, docs, vector.Planes(dim, 16, bits, 7), k, 0.95)
    got = found(vector.cosine_topk_lsh(queries, docs, dim=dim, k=k, bits=bits))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(asked) @ unit(rows).T
    exact = {i: {f"{j:06d}" for j in np.argsort(-scores[i])[:k]} for i in range(len(asked))}
    hits = sum(len(exact[i] & set(got[i])) for i in exact)
    assert hits >= 0.9 * k * len(asked)
    assert planes.probes < 1 << vector.FLIPPED


def test_lsh_without_any_structure_answers_exactly(spark):
    d, q, docs, queries = tables(spark)
    plain = queries.select("request_id", "cand", "vector").withColumn("ten", F.lit(10))
    want = found(vector.cosine_topk(plain, docs, "ten", filtered=False))
    assert found(vector.cosine_topk_lsh(plain, docs, dim=len(q[0]), k=10, tables=1, bits=20, recall=1.01)) == want
    assert vector.cosine_topk_lsh(plain.limit(0), docs, dim=len(q[0]), k=10).count() == 0


def test_visits_start_at_home_and_never_repeat():
    planes = vector.Planes(8, 3, 5, 1, probes=32)
    margins = planes.margins(np.random.default_rng(2).standard_normal((20, 8)))
    visits = planes.visits(margins)
    assert (visits[:, :, 0] == planes.codes(margins)).all()
    assert all(len(set(visits[i, t].tolist())) == 32 for i in range(20) for t in range(3))
    crossed = lambda code, i, t: sum(margins[i, t, b] ** 2 for b in range(5) if (code ^ visits[i, t, 0]) >> b & 1)
    costs = [crossed(int(c), 0, 0) for c in visits[0, 0]]
    assert costs == sorted(costs)


def test_lsh_meets_buckets_without_a_row_per_pair(spark):
    """The nearest among the vectors of the visited buckets, from a plan that joins no buckets and drops no copies of pairs."""
    d, q, docs, queries = tables(spark, n_docs=1500, n_queries=40)
    planes = vector.Planes(8, 3, 5, 1, probes=2)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    visits, codes = planes.visits(planes.margins(unit(q))), planes.codes(planes.margins(unit(d)))
    scores = np.round(unit(q) @ unit(d).T, 6)
    want = {}
    for i in range(len(q)):
        met = [j for j in range(len(d)) if any(codes[j, t] in visits[i, t] for t in range(3))]
        want[i] = [x for _, x in sorted((-scores[i, j], f"{j:04d}") for j in met)[:9]]
        assert 9 < len(met) < len(d)
    plain = queries.select("request_id", "cand", "vector", "pre_limit")
    assert found(vector.cosine_topk(plain, docs, filtered=False, planes=planes)) == want
    plan = vector.cosine_topk_lsh(plain, docs, dim=8, k=9)._jdf.queryExecution().toString()
    assert "bucket" not in plan and plan.count("MapInArrow") == 4  # one scan, in each of the four forms of the plan
