"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is clustered into centroids, large clusters split and small ones
dissolved. Every vector is posted to its nearest list, and vectors near a border
to the neighbouring lists too, found by a walk over a neighbour graph in memory.
A query ranks all centroids and reads the lists that are at most a calibrated
ratio further than its nearest, all lists if no smaller ratio finds enough.
Inside lists scores are exact.

The largest inner product becomes the smallest distance by one more component
that brings all vectors to the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.session import materialise

#: Vectors that centroids are fitted on at most (about; chosen by a hash of the id), vectors a list should hold, lists at most.
SAMPLE, LIST_SIZE, MAX_LISTS = 65_536, 100, 4096
#: A vector goes to up to REPLICAS lists not further than (1 + POST_RATIO) times its nearest.
REPLICAS, POST_RATIO = 8, 0.15
#: A query reads the lists not further than (1 + ratio) times its nearest, and more until they hold MIN_CANDIDATES vectors.
#: The ratio is the smallest that finds the share RECALL of the neighbours of TRIALS vectors among CALIBRATION others; the last one reads all lists.
#: Both are drawn from the whole table, whether centroids were fitted on them or not: fitted vectors lie nearer to their centroids.
RATIOS = [0.02, 0.04, 0.06, 0.08, 0.1, 0.11, 0.12, 0.13, 0.14, 0.15, 0.16, 0.18, 0.2, 0.25, 0.3, 0.4, 0.5, np.inf]
RECALL, TRIALS, CALIBRATION, MIN_CANDIDATES = 0.96, 256, 8192, 1000
#: Lists that are read first; what is found there is the floor for the others.
FIRST = 2
#: Longer lists are read in parts of about this many vectors.
PART = 2048
#: Links of a centroid; centroids that a vector is compared with before it is posted; rows that a query block hands on at once.
NEIGHBOURS, BEAM, ROWS = 24, 64, 16_384


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists without nulls as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component, so that all have the length ``longest``."""
    rest = np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64), 0)
    return np.hstack([vectors, np.sqrt(rest)[:, None].astype(np.float32)])


def lifted_queries(vectors: np.ndarray, longest: float) -> np.ndarray:
    length = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return np.hstack([(vectors * (longest / np.maximum(length, 1e-300))).astype(np.float32), np.zeros((len(vectors), 1), np.float32)])


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
    return np.concatenate([np.argmax(points[i : i + 8192] @ centroids.T - half, axis=1) for i in range(0, len(points), 8192)])


def fit_centroids(points: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of about ``lists`` clusters of even size."""
    rng = np.random.default_rng(11)
    points = np.unique(points, axis=0)  # copies weigh once, so that they don't draw centroids to one spot
    lists = min(lists, len(points))
    centroids = points[rng.choice(len(points), lists, replace=False)].copy()
    for r in range(rounds):
        own = _nearest(points, centroids)
        size = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        full = size > 0
        centroids[full] = sums[full] / size[full, None]
        if r < rounds - 2:  # dissolve the smallest and split the largest in their place
            mean = len(points) / len(centroids)
            large = np.flatnonzero(size > 2 * mean)
            small = np.argsort(size)[: len(large)]
            small = small[size[small] < mean / 2]
            for a, b in zip(large[np.argsort(-size[large])], small, strict=False):
                inside = points[own == a]
                centroids[a], centroids[b] = inside[rng.choice(len(inside), 2, replace=False)]
    return centroids


@dataclass
class Graph:
    """Centroids with links to their nearest ones and a few far ones."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        rng = np.random.default_rng(13)
        half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
        near = min(NEIGHBOURS, n - 1)
        rows = []
        for i in range(n):
            value = centroids @ centroids[i] - half
            value[i] = -np.inf
            rows.append(np.argpartition(-value, near - 1)[:near] if near else np.zeros(0, np.int64))
        far = rng.integers(0, n, (n, 4))
        return cls(centroids, np.hstack([np.array(rows).reshape(n, near), far]).astype(np.int32), rng.permutation(n)[:16].astype(np.int32))

    def ranked(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of all centroids per point, nearest first."""
        square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", self.centroids, self.centroids)
        dist = np.maximum(square - 2 * (points @ self.centroids.T), 0)
        ids = np.argsort(dist, axis=1, kind="stable")
        return ids, np.take_along_axis(dist, ids, axis=1)

    def search(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of up to ``beam`` near centroids per point, nearest first; missing ones are -1."""
        n, k = len(self.centroids), len(points)
        beam = min(beam, n)
        own = np.einsum("ij,ij->i", self.centroids, self.centroids)
        square = np.einsum("ij,ij->i", points, points)

        def distance(numbers: np.ndarray) -> np.ndarray:
            dots = np.einsum("ij,ikj->ik", points, self.centroids[numbers])
            return np.maximum(square[:, None] + own[numbers] - 2 * dots, 0)

        rows = np.arange(k)
        seen = np.zeros((k, n), bool)
        ids = np.tile(self.entries, (k, 1))
        seen[rows[:, None], ids] = True
        dist, done = distance(ids), np.zeros(ids.shape, bool)
        while True:
            open_ = np.where(done, np.inf, dist)
            best = np.argmin(open_, axis=1)
            if not np.isfinite(open_[rows, best]).any():
                break
            done[rows, best] = True
            new = self.links[ids[rows, best]]
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            ordered = np.sort(np.where(fresh, new, -1), axis=1)  # a link may be there twice
            twice = np.zeros(ordered.shape, bool)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            found = np.where((ordered < 0) | twice, np.inf, distance(np.maximum(ordered, 0)))
            ids, dist = np.hstack([ids, ordered]), np.hstack([dist, found])
            done = np.hstack([done, ~np.isfinite(found)])
            keep = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(x, keep, axis=1) for x in (ids, dist, done))
        return np.where(np.isfinite(dist), ids, -1), dist


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lists_of(graph: Graph, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, list): the nearest list of each lifted point, and others almost as near."""
    ids, dist = (x[:, :REPLICAS] for x in graph.search(points))
    row, place = np.nonzero((ids >= 0) & (dist <= dist[:, :1] * (1 + POST_RATIO) ** 2 + 1e-12))
    return row, ids[row, place]


def calibrate(graph: Graph, vectors: np.ndarray, longest: float, k: int, total: int) -> float:
    """The smallest of ``RATIOS`` that reaches ``RECALL`` on the first of ``vectors``.

    As many neighbours are asked for there as make the share of the candidates
    that ``k`` make of all ``total`` vectors, one at least.
    """
    vectors = vectors[:CALIBRATION]
    trials = vectors[:TRIALS]
    k = int(np.clip(round(k * len(vectors) / max(total, 1)), 1, max(1, len(vectors) - 1)))
    value = trials @ vectors.T
    value[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    wanted = np.argpartition(-value, k - 1, axis=1)[:, :k]
    row, chosen = lists_of(graph, lifted(vectors, longest))
    ids, dist = graph.ranked(lifted_queries(trials, longest))
    reach = np.empty(ids.shape)  # by list: how much further than the nearest it is
    np.put_along_axis(reach, ids, np.sqrt(dist / np.maximum(dist[:, :1], 1e-12)) - 1, axis=1)
    need = np.full(wanted.shape, np.inf)
    starts = np.searchsorted(row, np.arange(len(vectors) + 1))
    for j in range(k):
        for i in range(len(trials)):
            w = wanted[i, j]
            need[i, j] = reach[i, chosen[starts[w] : starts[w + 1]]].min()
    return next(r for r in RATIOS if (need <= r).mean() >= RECALL)


def _post(model, longest: float):
    """A row for each list that a vector is posted to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1024):
            row, chosen = lists_of(model.value, lifted(matrix(batch.column(1)), longest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "vec_id", "vector"]
            )

    return run


def _probe(model, longest: float, sizes, ratio: float):
    """Lists that each query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Graph = model.value
        for batch in _batches(batches, 512):
            ids, dist = graph.ranked(lifted_queries(matrix(batch.column(1)), longest))
            held = sizes.value[ids]
            before = np.cumsum(held, axis=1) - held
            near = (dist <= dist[:, :1] * (1 + ratio) ** 2 + 1e-12) if np.isfinite(ratio) else np.ones(dist.shape, bool)
            rows, places = np.nonzero((near | (before < MIN_CANDIDATES)) & (held > 0))
            for at in range(0, len(rows), ROWS):
                row, place = rows[at : at + ROWS], places[at : at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, place], pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place, pa.int32())],
                    ["list", "query_id", "query", "place"],
                )

    return run


def _best(k: int):
    """The best ``k`` vectors of one part of a list for each query that reads it, if they reach its floor."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and vectors.num_rows:
            ids = vectors["vec_id"].to_numpy()
            many = int(np.unique(ids, return_counts=True)[1].max()) * k  # enough rows for k ids
            table = matrix(vectors["vector"]).astype(np.float64)
            every = matrix(queries["query"]).astype(np.float64)
            floors = queries["floor"].to_numpy()
            for at in range(0, len(every), 256):
                block, own = every[at : at + 256], queries["query_id"].to_numpy()[at : at + 256]
                rough = block @ table.T
                rough[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(rough, len(ids) - many, axis=1)[:, len(ids) - many] if len(ids) > many else np.full(len(own), -np.inf)
                least = np.maximum(least, floors[at : at + 256])
                row, col = np.nonzero((rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & np.isfinite(rough))
                value = (block[row] * table[col]).sum(axis=1)  # the same order of sums for every row, so copies tie
                order = np.lexsort((-value, ids[col], row))
                row, col, value = row[order], col[order], value[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (ids[col[1:]] != ids[col[:-1]])
                row, col, value = row[new], col[new], value[new]
                order = np.lexsort((ids[col], -value, row))
                row, col, value = row[order], col[order], value[order]
                first = np.searchsorted(row, np.arange(len(own)))
                top = np.arange(len(row)) - first[row] < k
                out.append((own[row[top]], ids[col[top]], value[top]))
        join = lambda i, t: pa.array(np.concatenate([x[i] for x in out]) if out else np.zeros(0), t)
        return pa.table({"query_id": join(0, pa.int64()), "vec_id": join(1, pa.int64()), "score": join(2, pa.float64())})

    return run


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part.

    Rows with a null id, a null or zero vector, or a null, infinite or undefined
    component take no part, nor do vectors of another length than most (the smaller
    of two equally frequent ones counts).
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<float>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~odd & F.exists("vector", lambda x: x != 0))
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.filter(F.size("vector") == F.lit(width["width"] if width else 0))


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` found vectors with the largest inner product of each query row.

    Queries are the rows that ``is_query`` (a column over vec_id) selects;
    candidates are all rows but those with the query's own id. Ties go to the smaller id. Rows that
    repeat an id and its vector count once; of different vectors under one id the
    better one counts. Which rows take part is told at :func:`usable`. Every row is
    posted; only centroids are fitted on a sample. An empty table gives no rows.
    """
    rows = materialise(usable(vectors, key, vector), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    n, longest = facts["n"], facts["longest"] or 1.0
    draw, drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)), int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    sample = rows.filter(draw < drawn).select("vector").limit(2 * SAMPLE).toArrow()["vector"]
    points = matrix(sample) if n and len(sample) else np.zeros((1, 1), np.float32)
    if drawn < 1 << 20:
        other = F.pmod(F.xxhash64("vec_id", F.lit("calibrate")), F.lit(1 << 20)) < int(2 * CALIBRATION / n * (1 << 20))
        trials = matrix(rows.filter(other).select("vector").limit(2 * CALIBRATION).toArrow()["vector"])
    else:
        trials = points
    lists = int(np.clip(n // LIST_SIZE, 1, MAX_LISTS))
    send = rows.sparkSession.sparkContext.broadcast
    graph = Graph.build(fit_centroids(lifted(points, longest), lists))
    ratio = calibrate(graph, trials if len(trials) >= CALIBRATION else points, longest, k, n)
    model = send(graph)
    posted = materialise(rows.mapInArrow(_post(model, longest), "list int, vec_id long, vector array<float>"), "postings")
    counts = posted.groupBy("list").count().collect()  # at most MAX_LISTS rows
    sizes = np.zeros(len(graph.centroids), np.int64)
    for r in counts:
        sizes[r["list"]] = r["count"]
    # a list of at most MAX_LISTS rows
    parts = F.broadcast(posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    dealt = posted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    asked = rows.filter(is_query).mapInArrow(_probe(model, longest, send(sizes), ratio), "list int, query_id long, query array<float>, place int")

    def read(asked: DataFrame) -> DataFrame:
        by_part = asked.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "place")
        schema = "query_id long, vec_id long, score double"
        return by_part.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(_best(k), schema)

    def ranked(near: DataFrame) -> DataFrame:
        near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return near.withColumn("rank", rank).filter(F.col("rank") <= k)

    first = materialise(ranked(read(asked.filter(F.col("place") < FIRST).withColumn("floor", F.lit(float("-inf"))))), "first")
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = asked.filter(F.col("place") >= FIRST).join(floors, "query_id", "left").fillna({"floor": float("-inf")})
    near = first.select("query_id", "vec_id", "score").union(read(others))
    return ranked(near).select("query_id", "rank", "vec_id", "score")
