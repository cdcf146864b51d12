"""Periodic runs of words, found by block convolution at dyadic scales.

A run of period q and at least ``REPEATS`` periods equals itself q words further
on over ``(REPEATS - 1) * q`` words, so for the scale L with L <= q < 2L it holds
an aligned block of L words that occurs again at distance q. For every block the
sums of squared differences to all places L to 2L - 1 words further on come from
one convolution, computed exactly modulo the Fermat prime 65537 by a number
theoretic transform of size 2L; the transform is a chain of small matrix products
whose sums stay below 2^53, so nothing is rounded. A sum of zero seeds a run: the
equal stretch around the block is extended both ways by binary search over prefix
hashes and then compared word by word.

The words of many texts stand in one row, longest text first, so that a scale
works on the front part that is long enough for it. Everything happens inside the
row of a text: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import hashing

#: A run has at least so many words and so many of its periods.
LEAST_WORDS, REPEATS = 6, 4
PRIME = 65537
#: Largest block of one transform (its size is twice that, and divides PRIME - 1); larger scales use the front of a block.
LARGEST_BLOCK = 1 << 15
#: Size of a transform that is one matrix product.
_SINGLE = 64
#: Numbers transformed at once.
_AT_ONCE = 1 << 18
_HASH_PRIME, _HASH_BASE = (1 << 31) - 1, 1_220_703_125

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, text string"


def _reduced(x: np.ndarray) -> np.ndarray:
    """The same residues between -PRIME and 2 * PRIME, in place. Entries are whole numbers below 2^52."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


@lru_cache(maxsize=64)
def _powers(size: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """The entries root^(i * k) for i below ``rows`` and k below ``columns``; root has order ``size``."""
    root = pow(3, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    table = np.array([pow(root, i, PRIME) for i in range(size)], np.float64)
    return table[np.outer(np.arange(rows), np.arange(columns)) % size]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number theoretic transform of each row modulo PRIME; the inverse is not divided by the size."""
    rows, size = x.shape
    if size <= _SINGLE:
        return _reduced(x @ _powers(size, size, size, inverse))
    a, b = _SINGLE, size // _SINGLE
    y = _reduced(x.reshape(rows, a, b).transpose(0, 2, 1) @ _powers(a, a, a, inverse))
    y = _reduced(y * _powers(size, b, a, inverse))
    y = transform(np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(rows * a, b), inverse)
    return np.ascontiguousarray(y.reshape(rows, a, b).transpose(0, 2, 1)).reshape(rows, size)


def occurrences(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) with a difference of zero modulo PRIME, for distances from ``scale`` to ``2 * scale - 1``.

    Blocks start at multiples of ``scale``; those that end after ``values`` are left out.
    """
    block = min(scale, LARGEST_BLOCK)
    size, pieces = 2 * block, scale // block
    n = len(values) // scale
    padded = np.zeros((n + 3) * scale + size, np.float64)
    padded[: len(values)] = values
    squares = np.zeros(len(padded) + 1, np.int64)
    np.cumsum((padded * padded).astype(np.int64), out=squares[1:])
    back = (-np.arange(size)) % size
    sign = 1.0 - 2.0 * (np.arange(size) % 2)
    ending = float(pow(size, PRIME - 2, PRIME))
    many = max(1, _AT_ONCE // (size * pieces))
    starts, distances = [], []
    for at in range(0, n, many):
        to = min(n, at + many)
        # parts of `block` words: those of the blocks themselves and of all places they are held against
        first, last = at * pieces, (to + 2) * pieces + 1
        parts = np.zeros((last - first, size))
        parts[:, :block] = padded[first * block : last * block].reshape(-1, block)
        parts = transform(parts)
        own = np.arange(to - at) * pieces
        mirrored = parts[own][:, back]
        begin = (at + np.arange(to - at)) * scale
        weight = squares[begin + block] - squares[begin]
        for piece in range(pieces):
            there = own + pieces + piece
            product = _reduced(mirrored * _reduced(parts[there] + sign * parts[there + 1]))
            met = _reduced(transform(product, True)[:, :block] * ending)
            place = (begin + scale + piece * block)[:, None] + np.arange(block)
            sums = weight[:, None] + squares[place + block] - squares[place]
            i, t = np.nonzero((sums - 2 * met.astype(np.int64)) % PRIME == 0)
            starts.append(begin[i])
            distances.append(scale + piece * block + t)
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (none, none)


class Prefixes:
    """Hashes of stretches of words, read off prefix sums modulo a prime of 31 bits."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.power = np.ones(n + 1, np.uint64)
        have = 1
        while have <= n:
            step = np.uint64(pow(_HASH_BASE, have, _HASH_PRIME))
            more = min(have, n + 1 - have)
            self.power[have : have + more] = self.power[:more] * step % np.uint64(_HASH_PRIME)
            have *= 2
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words % np.uint64(_HASH_PRIME) * self.power[:n] % np.uint64(_HASH_PRIME), out=self.sums[1:])

    def equal(self, a: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        prime = np.uint64(_HASH_PRIME)
        here = (self.sums[a + length] - self.sums[a]) % prime * self.power[distance] % prime
        there = (self.sums[a + distance + length] - self.sums[a + distance]) % prime
        return here == there


def _longest(holds, most: np.ndarray) -> np.ndarray:
    """Per entry the largest length up to ``most`` for which ``holds`` is true (it is for 0, and never again once false)."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = holds(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _checked(words: np.ndarray, start: int, end: int, period: int, seed: int, begin: int, stop: int) -> tuple[int, int]:
    """The exact stretch of a period around the block at ``seed``, if (start, end) is not it."""
    if (words[start : end - period] == words[start + period : end]).all():
        return start, end
    same = words[begin : stop - period] == words[begin + period : stop]
    wrong = np.flatnonzero(~same) + begin
    before, after = wrong[wrong < seed], wrong[wrong >= seed]
    return (int(before[-1]) + 1 if len(before) else begin), (int(after[0]) if len(after) else stop - period) + period


def find(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then period.

    ``words`` are hashes; text i holds those from ``first[i]`` to ``first[i + 1]``; texts stand longest first.
    """
    size = np.diff(first)
    text_of = np.repeat(np.arange(len(size)), size)
    values = (words % np.uint64(PRIME)).astype(np.float64)
    reach = np.zeros(len(words) + 1, np.int64)  # how far a run that is already found goes on from each word
    period_of: dict[tuple[int, int], int] = {}
    prefixes, scale = None, 1
    while True:
        texts = int(np.searchsorted(-size, -max(LEAST_WORDS, REPEATS * scale), side="right"))
        if not texts:
            break
        b, d = occurrences(values[: first[texts]], scale)
        block = min(scale, LARGEST_BLOCK)
        begin, stop = first[text_of[b]], first[text_of[b] + 1]
        use = (b + d + block <= stop) & (reach[b] < b + d + block)
        b, d, begin, stop = b[use], d[use], begin[use], stop[use]
        if len(b):
            prefixes = prefixes or Prefixes(words)
            equal = prefixes.equal
            right = _longest(lambda m: equal(b, d, m), stop - b - d)  # noqa: B023
            left = _longest(lambda m: equal(b - m, d, m), b - begin)  # noqa: B023
            start, end = b - left, b + right + d
            long = (end - start >= np.maximum(LEAST_WORDS, REPEATS * d)) & (right >= block)
            for k in np.flatnonzero(long).tolist():
                key = (int(start[k]), int(end[k]))
                if key in period_of:
                    continue
                period = int(d[k])
                key = _checked(words, *key, period, int(b[k]), int(begin[k]), int(stop[k]))
                if key[1] - key[0] >= max(LEAST_WORDS, REPEATS * period):
                    period_of[key] = min(period, period_of.get(key, period))
        for s, e in period_of:  # only now, so that a scale prunes by smaller ones alone
            if reach[s] < e:
                np.maximum(reach[s:e], e, out=reach[s:e])
        scale *= 2
    found = sorted((s, q, e) for (s, e), q in period_of.items())
    s, q, e = np.array(found, np.int64).reshape(-1, 3).T
    return s, e, q


def _rows(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    found = hashing.words(texts)
    count = found.count()
    order = np.argsort(-count, kind="stable")
    first = np.concatenate([[0], np.cumsum(count[order])])
    # word numbers in the order of falling length
    place = np.arange(first[-1]) + np.repeat(found.first[:-1][order] - first[:-1], count[order])
    start, end, period = find(found.hash[place], first)
    rank = np.searchsorted(first, start, side="right") - 1
    per_text: dict[int, list[tuple[int, int, int]]] = {}
    for r, s, e, q in zip(rank.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        base = int(first[r])
        per_text.setdefault(int(order[r]), []).append((s - base, e - s, q))
    runs, best, kept = [], [], []
    for i, raw in enumerate(texts.to_pylist()):
        words = (raw or "").encode().split()
        own = per_text.get(i, [])
        if own:
            gone = np.zeros(len(words) + 1, np.int64)
            for s, length, q in own:
                gone[s + q] += 1
                gone[s + length] -= 1
            words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
        top = None
        for run in own:  # by start and period, so the first of equal exponents stays
            if top is None or run[1] * top[2] > top[1] * run[2]:
                top = run
        named = [dict(zip(("start", "length", "period"), run, strict=True)) for run in own]
        runs.append(named)
        best.append(dict(zip(("start", "length", "period"), top, strict=True)) if top else None)
        kept.append(b" ".join(words))
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    columns = [ids, pa.array(count, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, names=["doc_id", "n_words", "runs", "best", "text"])


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in hashing.slices(batch.column(1)):
            yield _rows(batch.column(0).slice(at, len(part)), part)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs, best, text: periodic runs of words and the texts without their repetitions.

    A run is a stretch of consecutive words with smallest period q and at least
    ``max(LEAST_WORDS, REPEATS * q)`` words that cannot be extended. ``runs`` has all
    of them by start (a word number from 0) and then period, ``best`` the one with the
    greatest length over period (ties: smallest start, then period), or null. ``text``
    has the words, joined by one blank, that no run contains after its first period.
    One row per row of ``docs``: repeated rows and ids are judged alike, null ids
    stay null, null and empty texts have no words and no runs. An empty table gives
    no rows; other columns are left out, whatever their names. Words are told apart by
    64-bit hashes.
    """
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(_find_runs, RESULT)
