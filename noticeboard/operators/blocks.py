"""Blocks of queries that go out to tasks, and the best documents that a task keeps for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from noticeboard.operators.filters import DOC_FIELDS, REQUEST_FIELDS

CAND = ["request_id", "cand"]
QUERY_BLOCK = 4096


def allowed(batch: pd.DataFrame, query: dict) -> np.ndarray:
    """Rows of a batch that pass the filters of one query."""
    months, mask = query["months"], np.ones(len(batch), dtype=bool)
    tests = [(batch["year_month"], months), (batch["link"], query["links"])]
    tests += [(batch["website"], query["websites"]), (batch["website"], query["manual_websites"])]
    if len(query["years"]):
        tests.append((batch["year_month"].str.slice(0, 4), query["years"]))
    for column, values in tests:
        if len(values):
            mask &= column.isin(values).to_numpy()
    if not len(months):
        for bound, inside in ((query["start_date"], "ge"), (query["end_date"], "le")):
            if bound is not None:
                mask &= getattr(batch["year_month"], inside)(bound[:7]).to_numpy()
    return mask


def pack_queries(rows: pd.DataFrame, k_col: str, filtered: bool) -> dict:
    """Limits, keys and the distinct filters of one block of queries."""
    filters, which = [], [0] * len(rows)
    if filtered:
        known: dict[str, int] = {}
        shared_fields = [f for f in REQUEST_FIELDS if f != "exclude_ids"]
        for i, meta in enumerate(rows[shared_fields].to_dict("records")):
            meta = {k: (list(v) if isinstance(v, np.ndarray) else v) for k, v in meta.items()}
            which[i] = known.setdefault(repr(meta), len(known))
            if which[i] == len(filters):
                filters.append(meta)
    return {
        "k": rows[k_col].astype(int).to_numpy(),
        "keys": rows[CAND].to_dict("list"),
        "filters": filters,
        "which": np.array(which),
        "exclude": [set(v) for v in rows["exclude_ids"]] if filtered else [set()] * len(rows),
    }


def _best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then id; ties at the cut are looked at before any row is dropped."""
    if len(scores) <= k:
        return scores, ids
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = scores >= least
    scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class BestRows:
    """The best documents of a task for each query of a block."""

    def __init__(self, block: dict, filtered: bool) -> None:
        self.block, self.filtered = block, filtered
        self.best = [(np.empty(0), np.empty(0, dtype=object))] * len(block["k"])
        self.bar = np.full(len(block["k"]), -np.inf)

    def add(self, scores: np.ndarray, scored: np.ndarray | None, docs: pa.RecordBatch | pa.Table) -> None:
        """Scores of all queries and the documents of a batch; ``scored`` tells which count at all."""
        block = self.block
        promising = scores >= self.bar[:, None]
        if scored is not None:
            promising &= scored
        if self.filtered:
            meta = docs.select(DOC_FIELDS).to_pandas()
            promising &= np.array([allowed(meta, f) for f in block["filters"]])[block["which"]]
        ids = np.asarray(docs.column("id").to_pandas(), dtype=object)
        for q in np.flatnonzero(promising.any(axis=1)):
            hit = promising[q]
            if block["exclude"][q]:
                hit = hit & ~np.isin(ids, list(block["exclude"][q]))
            row = np.concatenate((self.best[q][0], scores[q][hit]))
            names = np.concatenate((self.best[q][1], ids[hit]))
            self.best[q] = _best_rows(row, names, block["k"][q])
            if len(self.best[q][0]) == block["k"][q]:
                self.bar[q] = self.best[q][0].min()

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        sizes = [len(s) for s, _ in self.best]
        if sum(sizes):
            which = np.repeat(np.arange(len(sizes)), sizes)
            columns = {c: pa.array(self.block["keys"][c]).take(pa.array(which)) for c in CAND}
            columns["id"] = pa.array(np.concatenate([i for _, i in self.best]))
            columns["score"] = pa.array(np.concatenate([s for s, _ in self.best]))
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
