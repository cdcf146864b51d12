"""Exact substring dedup with difference-cover anchors.

Words at positions whose remainder by ``PERIOD`` lies in ``COVER`` start an
anchor of ``ANCHOR`` words. For any two positions some shift below the period
puts both on the cover, so two equal windows of ``ANCHOR + PERIOD - 1`` words
share an anchor at the same place. Anchors that one document alone holds are
dropped; around the others every window is formed and looked up exactly.

Texts are grouped into blocks of about ``BLOCK_BYTES``. A block sends each
distinct anchor and window once, with the smallest and largest document that
holds it, to a range of the hash space, and gets back what concerns it. A passage
in very many documents therefore costs one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import hashing

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Concatenated numbers of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


class Lookup:
    """Membership of 64-bit hashes in a sorted array, behind a bitmap that answers most of the noes."""

    def __init__(self, sorted_hashes: np.ndarray) -> None:
        self.sorted = sorted_hashes
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[sorted_hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be members; the rest surely are none."""
        return np.flatnonzero(self.seen[hashes & np.uint64((1 << _FILTER_BITS) - 1)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that are members."""
        if not len(self.sorted):
            return np.zeros(0, np.int64)
        at = self.places(hashes)
        slot = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        return at[self.sorted[slot] == hashes[at]]


def _texts(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    return table["doc_id"].to_numpy(), table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)


def _anchors(found: hashing.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word number, text number) of the anchors of texts that are long enough for a window."""
    place, text = hashing.window_starts(found.first, ANCHOR)
    within = (place - found.first[text]) % PERIOD
    use = np.isin(within, COVER) & (np.diff(found.first)[text] >= WINDOW)
    place, text = place[use], text[use]
    return hashing.windows(found.hash, ANCHOR)[place], place, text


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): a sorting of the keys, the first most important, and where each distinct combination begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of the hash space that each hash lies in, of n."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cut(block: int, n: int, hashes: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """Rows (range, block, columns as binary) from columns sorted by hash."""
    ends = np.searchsorted(_ranges(hashes, n), np.arange(n + 1))
    used = np.flatnonzero(np.diff(ends))
    parts = {k: pa.array([v[ends[i] : ends[i + 1]].tobytes() for i in used], pa.binary()) for k, v in columns.items()}
    return pa.table({"range": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), **parts})


def _post_anchors(n: int):
    def run(table: pa.Table) -> pa.Table:
        _, texts = _texts(table)
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, part in hashing.slices(texts):
            h, _, text = _anchors(hashing.words(part))
            hashes.append(h)
            owners.append(text + at)
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order, begins = _groups(hashes)
        owners = owners[order]
        many = np.minimum.reduceat(owners, begins) != np.maximum.reduceat(owners, begins) if len(begins) else np.zeros(0, bool)
        distinct = hashes[order][begins]
        return _cut(table["block"][0].as_py(), n, distinct, {"hash": distinct, "many": many})

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Per block the anchors that more than one document holds."""
    hashes, many = _numbers(table["hash"], np.uint64), _numbers(table["many"], bool)
    sizes = np.array([len(x) // 8 for x in table["hash"].to_pylist()])
    blocks = np.repeat(table["block"].to_numpy(), sizes)
    order, begins = _groups(hashes)
    size = np.diff(np.append(begins, len(order)))
    shared = np.empty(len(hashes), bool)
    shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], begins), size)
    hashes, blocks = hashes[shared], blocks[shared]
    order, begins = _groups(blocks)
    ends = np.append(begins, len(order))[1:]
    return pa.table(
        {
            "block": pa.array(blocks[order][begins], pa.int32()),
            "hash": pa.array([hashes[order[a:b]].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
        }
    )


def _post_windows(n: int):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        lookup = Lookup(np.sort(_numbers(anchors["hash"], np.uint64)))
        empty = pa.table({c: pa.array([], t) for c, t in (("range", pa.int32()), ("block", pa.int32()), *((x, pa.binary()) for x in ("h1", "h2", "low", "high")))})
        if not len(lookup.sorted) or not docs.num_rows:
            return empty
        ids, texts = _texts(docs)
        out = []
        for at, part in hashing.slices(texts):
            found = hashing.words(part)
            h, place, text = _anchors(found)
            hit = lookup.find(h)
            place, text = place[hit], text[hit]
            from_ = np.maximum(place - (WINDOW - ANCHOR), found.first[text])
            to = np.minimum(place, found.first[text + 1] - WINDOW)
            marks = np.zeros(len(found.hash) + 1, np.int32)
            np.add.at(marks, from_, 1)
            np.add.at(marks, to + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            if len(starts):
                owner = np.searchsorted(found.first, starts, side="right") - 1
                out.append((hashing.windows(found.hash, WINDOW)[starts], hashing.windows(found.hash, WINDOW, 1)[starts].astype(np.uint32), ids[at + owner]))
        if not out:
            return empty
        h1, h2, owner = (np.concatenate(x) for x in zip(*out, strict=True))
        order, begins = _groups(h1, h2)
        owner = owner[order]
        first = order[begins]
        columns = {"h1": h1[first], "h2": h2[first], "low": np.minimum.reduceat(owner, begins), "high": np.maximum.reduceat(owner, begins)}
        return _cut(docs["block"][0].as_py(), n, h1[first], columns)

    return run


def _earlier_windows(table: pa.Table) -> pa.Table:
    """Per block the windows that a document before its last holder holds, with the first document that does."""
    h1, h2 = _numbers(table["h1"], np.uint64), _numbers(table["h2"], np.uint32)
    low, high = _numbers(table["low"], np.int64), _numbers(table["high"], np.int64)
    blocks = np.repeat(table["block"].to_numpy(), [len(x) // 8 for x in table["h1"].to_pylist()])
    order, begins = _groups(h1, h2)
    first = np.empty(len(h1), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(low[order], begins), np.diff(np.append(begins, len(order))))
    use = np.flatnonzero(first < high)
    order, begins = _groups(blocks[use])
    use, ends = use[order], np.append(begins, len(order))[1:]
    rows = {"block": pa.array(blocks[use][begins], pa.int32())}
    for name, column in (("h1", h1), ("h2", h2), ("first", first)):
        rows[name] = pa.array([column[use[a:b]].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())
    return pa.table(rows)


def _remove(docs: pa.Table, windows: pa.Table) -> pa.Table:
    h1, h2, first = (_numbers(windows[c], t) for c, t in (("h1", np.uint64), ("h2", np.uint32), ("first", np.int64)))
    order = np.lexsort((h2, h1))
    h1, h2, first = h1[order], h2[order], first[order]
    lookup = Lookup(h1)
    ids, texts = _texts(docs) if docs.num_rows else (np.zeros(0, np.int64), pa.array([], pa.string()))
    total, lost, kept = [], [], []
    for at, part in hashing.slices(texts):
        found = hashing.words(part)
        place, text = hashing.window_starts(found.first, WINDOW)
        own1 = hashing.windows(found.hash, WINDOW)[place]
        may = lookup.places(own1) if len(h1) else np.zeros(0, np.int64)
        place, text, own1 = place[may], text[may], own1[may]
        own2 = hashing.windows(found.hash, WINDOW, 1)[place].astype(np.uint32) if len(may) else np.zeros(0, np.uint32)
        slot = np.searchsorted(h1, own1)
        covered = np.zeros(len(found.hash) + 1, np.int32)
        left = np.arange(len(own1))
        while len(left):  # the few windows that share h1 stand side by side
            left = left[slot[left] < len(h1)]
            left = left[h1[slot[left]] == own1[left]]
            same = left[h2[slot[left]] == own2[left]]
            gone = same[first[slot[same]] < ids[at + text[same]]]
            np.add.at(covered, place[gone], 1)
            np.add.at(covered, place[gone] + WINDOW, -1)
            slot[left] += 1
        covered = np.cumsum(covered[:-1]) > 0
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), found.first[:-1])
        removed[np.diff(found.first) == 0] = 0
        total.append(found.count())
        lost.append(removed)
        for raw, n, a, b in zip(part.to_pylist(), removed.tolist(), found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            words = (raw or "").encode().split()
            kept.append(b" ".join(words if not n else [w for w, c in zip(words, covered[a:b].tolist(), strict=True) if not c]))
    whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.table({"doc_id": docs["doc_id"] if docs.num_rows else pa.array([], pa.int64()), "n_words": whole(total), "n_removed": whole(lost), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: texts without the words that an earlier document holds too.

    A word goes if one of its windows of ``WINDOW`` words is also a window of a
    document with a smaller id, judged on the input. Kept words are joined by one
    blank. One row per row of ``docs``: rows that repeat an id are no earlier than
    each other; rows with a null id keep all their words and are nobody's earlier
    document; null and empty texts have no words. An empty table gives no rows.
    Windows are compared by 96-bit hashes.
    """
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = plain.filter("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    by_block = rows.groupBy("block")
    anchors = by_block.applyInArrow(_post_anchors(blocks), "range int, block int, hash binary, many binary")
    shared = anchors.groupBy("range").applyInArrow(_shared_anchors, "block int, hash binary")
    posted = "range int, block int, h1 binary, h2 binary, low binary, high binary"
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(_post_windows(blocks), posted)
    earlier = windows.groupBy("range").applyInArrow(_earlier_windows, "block int, h1 binary, h2 binary, first binary")
    out = by_block.cogroup(earlier.groupBy("block")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
    loose = plain.filter("doc_id IS NULL").withColumn("w", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), ""))
    return out.union(loose.select("doc_id", F.size("w").cast("long"), F.lit(0).cast("long"), F.array_join("w", " ")))
