"""Vector retrieval: exact cosine top-k, an approximate form and heading matches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from noticeboard import constants as C
from noticeboard.operators.blocks import CAND, QUERY_BLOCK, BestRows, pack_queries
from noticeboard.operators.common import largest, ranked, small_side
from noticeboard.operators.filters import DOC_FIELDS, REQUEST_FIELDS
from noticeboard.session import materialise

BUCKET = 128
#: Planes whose sides a query may change, and queries that choose the number of probes.
FLIPPED, TRIALS = 8, 64
#: Rows whose buckets are found at once.
PROBED_ROWS = 512
SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    return _unit(np.array([np.asarray(v, dtype=np.float64) for v in vectors]))


def _unit_batch(column: pa.Array) -> np.ndarray:
    """Unit rows of an Arrow list column without a Python object per row."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return _unit(np.asarray(values, dtype=np.float64).reshape(len(column), -1))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k_col: str = "pre_limit", filtered: bool = True, planes: Planes | None = None) -> DataFrame:
    """The exact ``k`` nearest vectors by cosine for every (request, query).

    Query vectors go out in blocks of a fixed size, so what is sent to the
    tasks never grows with the data: more queries mean more passes. Each task
    multiplies its Arrow batches with the block and keeps only its own best k
    per query, so no pair of query and document is ever a row. Filters are
    applied before the cut. With ``planes`` only vectors in the buckets that a query visits count.
    """
    spark = queries.sparkSession
    extra = REQUEST_FIELDS if filtered else []
    columns = [*CAND, "vector", k_col, *extra]
    asked = queries.select(*columns).filter(F.col("vector").isNotNull())
    asked = materialise(asked, "queries")  # written once, then counted and read block after block
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64(*CAND), F.lit(n_blocks)))
    schema = T.StructType(
        [asked.schema["request_id"], asked.schema["cand"], vectors.schema["id"], T.StructField("score", T.DoubleType())]
    )
    docs = vectors.select(*(DOC_FIELDS if filtered else ["id"]), "vector").filter(F.col("vector").isNotNull())
    found = None
    for b in range(n_blocks):
        rows = asked.filter(F.col("_block") == b).drop("_block").toPandas()
        if rows.empty:
            continue
        shared = spark.sparkContext.broadcast(pack_queries(rows, k_col, filtered) | {"unit": _unit_rows(rows["vector"])})
        part = docs.mapInArrow(_block_scan(shared, filtered, to_arrow_schema(schema), planes), schema)
        if n_blocks > 1:  # the next block goes out when this one is done with
            part = materialise(part, "block-hits")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    cut = asked.select(*CAND, k_col)
    best = ranked(found, CAND, [F.col("score").desc(), F.col("id")], largest(asked, k_col))
    return best.join(cut, CAND).filter(F.col("rank") <= F.col(k_col)).drop(k_col)


def _block_scan(shared, filtered: bool, schema: pa.Schema, planes: Planes | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = BestRows(block, filtered)
        visits = planes.visitors(block["unit"]) if planes else None
        for batch in batches:
            step = PROBED_ROWS if planes else max(1, batch.num_rows)
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                rows = _unit_batch(part.column("vector"))
                met = planes.met(visits, rows, len(block["unit"])) if planes else None
                best.add(np.round(block["unit"] @ rows.T, SCORE_DIGITS), met, part)
        yield from best.rows(schema)

    return scan


# -- approximate form -----------------------------------------------------
@dataclass(frozen=True)
class Planes:
    """Seeded hyperplanes: ``tables`` times ``bits`` of them, and how many buckets a query visits per table."""

    dim: int
    tables: int
    bits: int
    seed: int
    probes: int = 1

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Signed distances of unit rows to the planes, by row, table and bit."""
        planes = np.random.default_rng(self.seed).standard_normal((self.dim, self.tables * self.bits))
        return (rows @ planes).reshape(len(rows), self.tables, self.bits)

    def codes(self, margins: np.ndarray) -> np.ndarray:
        return ((margins > 0) * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)

    def visits(self, margins: np.ndarray) -> np.ndarray:
        """Buckets by row, table and order of probing: nearest first, by the planes that must be crossed.

        Sets of the ``FLIPPED`` nearest planes are tried in the order of their summed squared distances.
        """
        near = min(FLIPPED, self.bits)
        order = np.argsort(np.abs(margins), axis=2)[:, :, :near]
        cost = np.take_along_axis(margins, order, axis=2) ** 2
        sets = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
        rank = np.argsort(cost @ sets.T, axis=2, kind="stable")[:, :, : self.probes]
        flips = (np.int64(1) << order) @ sets.T
        return self.codes(margins)[:, :, None] ^ np.take_along_axis(flips, rank, axis=2)

    def visitors(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By table the visited buckets, ascending, and the query of each."""
        parts = [self.visits(self.margins(unit[at : at + PROBED_ROWS])).astype(np.int32 if self.bits < 31 else np.int64) for at in range(0, len(unit), PROBED_ROWS)]
        out = []
        for t in range(self.tables):
            buckets = np.concatenate([p[:, t] for p in parts])
            order = np.argsort(buckets.ravel(), kind="stable")
            out.append((buckets.ravel()[order], (order // buckets.shape[1]).astype(np.int32)))
        return out

    def met(self, visitors: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, n: int) -> np.ndarray:
        """Which of ``n`` queries visit a bucket of each row, in any table."""
        out = np.zeros((n, len(rows)), dtype=bool)
        codes = self.codes(self.margins(rows))
        for t, (buckets, queries) in enumerate(visitors):
            code = codes[:, t].astype(buckets.dtype)  # else all buckets are cast
            low, high = np.searchsorted(buckets, code), np.searchsorted(buckets, code, side="right")
            size = high - low
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            out[queries[at], np.repeat(np.arange(len(rows)), size)] = True
        return out


def calibrated(queries: DataFrame, vectors: DataFrame, planes: Planes, k: int, recall: float) -> Planes | None:
    """Planes with as many probes as found ``recall`` of the exact neighbours of ``TRIALS`` hash-chosen queries; None if no number does."""
    trial = queries.select(*CAND, "vector").orderBy(F.xxhash64(*CAND), *CAND).limit(TRIALS).withColumn("_k", F.lit(k))
    trial = materialise(trial, "trials")
    near = materialise(cosine_topk(trial, vectors.select("id", "vector"), "_k", filtered=False).select(*CAND, "id"), "near")
    met = small_side(near).join(vectors.select("id", F.col("vector").alias("other")), "id").join(F.broadcast(trial.select(*CAND, "vector")), CAND)
    pairs = met.select("vector", "other").toPandas()  # at most TRIALS times k
    if pairs.empty:
        return planes
    most = replace(planes, probes=1 << min(FLIPPED, planes.bits))
    visits = most.visits(most.margins(_unit_rows(pairs["vector"])))
    hit = visits == most.codes(most.margins(_unit_rows(pairs["other"])))[:, :, None]
    first = np.where(hit.any(axis=2), hit.argmax(axis=2), most.probes).min(axis=1)
    probes = 1
    while probes <= most.probes:
        if (first < probes).mean() >= recall:
            return replace(planes, probes=probes)
        probes *= 2
    return None


def cosine_topk_lsh(
    queries: DataFrame, vectors: DataFrame, dim: int, k: int, tables: int = 16, bits: int | None = None, seed: int = 7, recall: float = 0.95
) -> DataFrame:
    """Approximate top-k: vectors in the hyperplane buckets that a query visits, with exact scores.

    Buckets follow the corpus: unless ``bits`` is given, there are as many as hold about ``BUCKET``
    documents each. A query visits the buckets behind its nearest planes, as many per table as
    found ``recall`` of the exact neighbours of some trial queries; if no number of probes does, as on
    vectors without clusters in a large corpus, the exact form answers. Queries go out in blocks,
    buckets meet inside the tasks and each task keeps its best: no pair of query and document is
    ever a row, however many pairs the buckets make. Vectors are written once and not shuffled.
    """
    stored = materialise(vectors.select("id", "vector").filter(F.col("vector").isNotNull()), "vectors")
    asked = materialise(queries.select(*CAND, "vector").filter(F.col("vector").isNotNull()), "queries")
    if bits is None:
        bits = int(min(24, max(1, round(math.log2(max(stored.count(), 2) / BUCKET)))))
    planes = calibrated(asked, stored, Planes(dim, tables, bits, seed), k, recall)
    return cosine_topk(asked.withColumn("_k", F.lit(k)), stored, "_k", filtered=False, planes=planes)


def match_heading(titles: DataFrame, headings: DataFrame, minimum: float = C.HEADING_MIN_COSINE) -> DataFrame:
    """Best heading of the same page for each title, when its cosine is above the minimum.

    titles: (page, title_id, vector); headings: (page, heading_id, vector).
    """
    t, h = titles.alias("t"), headings.alias("h")
    scored = t.join(h, F.col("t.page") == F.col("h.page")).select(
        "t.page", "t.title_id", "h.heading_id", F.round(cosine(F.col("t.vector"), F.col("h.vector")), SCORE_DIGITS).alias("score")
    )
    best = scored.groupBy("page", "title_id").agg(
        F.max("score").alias("score"), F.max_by("heading_id", F.struct("score", -F.col("heading_id"))).alias("heading_id")
    )
    return best.filter(F.col("score") > minimum)
