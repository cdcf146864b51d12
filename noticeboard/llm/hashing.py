"""Hashes of words and word windows for whole Arrow columns, with numpy inside tasks.

A word's hash is a polynomial over random 64-bit byte values, read off a running
sum over the bytes of many texts at once, and then mixed. A window's hash is a
polynomial over its word hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; a longer single text is still hashed whole.
SLICE_BYTES = 1 << 20
#: Bytes that one running sum covers, or one span.
SUM_BYTES = 1 << 18

_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, hashes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # word number at which text i begins; one more entry at the end
    table: np.ndarray  # value of each byte in hashes

    def stems(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of the first ``length`` bytes of the words that are so long."""
        long = np.flatnonzero(self.end - self.start >= length)
        return long, span_hashes(self.data, self.start[long], self.start[long] + length, self.table)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    have = known.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = known[base] = np.multiply.accumulate(out)
    return have[:n]


_known: dict[int, np.ndarray] = {}


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of byte spans in ascending order, read off running sums over ``SUM_BYTES`` at a time."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + SUM_BYTES, side="right")))
        part = table[data[base : end[to - 1]]]
        part *= _powers(_BASE, len(part), _known)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        begin = start[at:to] - base
        out[at:to] = (sums[end[at:to] - base] - sums[begin]) * _powers(_BASE_INVERSE, len(part) + 1, _known)[begin]
        at = to
    return mix(out)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first text, texts) with at most ``limit`` bytes each, or one text."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def words(texts: pa.Array, fold: bool = False, separators: np.ndarray = _SPACE) -> Words:
    """All words of the texts (null: none); ``fold`` reads A-Z as a-z. ``separators`` tells by byte what is between words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    space = separators[data]
    begins = ~space
    ends = begins.copy()
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins[1:] &= space[:-1] | cut[1:n]
    ends[:-1] &= space[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    table = _FOLDED if fold else _BYTES
    return Words(data, start, end, span_hashes(data, start, end, table), np.searchsorted(start, offsets), table)


@dataclass
class Units:
    """Texts cut in front of every blank and at some other bounds of pre-tokens: byte spans in ``data``, hashes, where each text's units begin, and which texts are odd."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    odd: np.ndarray


#: Second bytes of white space in UTF-8 by its first byte, some other signs included.
_WIDE_SPACE = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def units(texts: pa.Array) -> Units:
    """Units of the texts (null: none). A text with a blank before (what may be) white space or its end is odd and has no units."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    blank = np.flatnonzero(data == 32)
    after = np.append(data, np.zeros(2, np.uint8))
    one, two = after[blank + 1], after[blank + 2]
    bad = _SPACE[one] | ((one >= 28) & (one < 32)) | np.isin(blank + 1, offsets[1:])
    for lead, second in _WIDE_SPACE.items():
        bad |= (one == lead) & np.isin(two, second)
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(offsets, blank[bad], side="right") - 1] = True
    cut = np.zeros(n + 1, bool)
    cut[blank] = True
    # an ASCII letter before a stop or comma, and a single line break between ASCII signs, end a pre-token too
    plain = (data < 128) & ~_SPACE[data] & ((data < 28) | (data > 31))
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    cut[1:n] |= letter[:-1] & ((data[1:] == 46) | (data[1:] == 44))
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[plain[line - 1] & plain[line + 1]]
    cut[line] = cut[line + 1] = True
    cut[offsets] = True
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    text = np.searchsorted(offsets, start, side="right") - 1
    use = ~odd[text]
    start, end, text = start[use], end[use], text[use]
    return Units(data, start, end, span_hashes(data, start, end, _BYTES), np.searchsorted(text, np.arange(len(texts) + 1)), odd)


def windows(hashes: np.ndarray, length: int, step: int = 0) -> np.ndarray:
    """Hash of the window of ``length`` words that starts at each word.

    The last ``length - 1`` entries and those that reach into the next text mean
    nothing; :func:`window_starts` tells which do. ``step`` chooses one of two
    independent hashes.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(_STEPS[step])
    for j in range(length):
        out *= factor
        out += hashes[j : j + n]
    return mix(out ^ np.uint64(length))


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, text number) of all windows that lie inside one text."""
    per_text = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    within = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return first[:-1][text] + within, text


def shingle_sets(texts: pa.Array, length: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its windows of folded words.

    A text with fewer words has its whole sequence as one; one without words none.
    """
    for _, part in slices(texts):
        found = words(part, fold=True)
        grams = windows(found.hash, length)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if b - a >= length:
                yield np.unique(grams[a : b - length + 1])
            elif b > a:
                yield windows(found.hash[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
