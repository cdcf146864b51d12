"""Periodic runs against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from noticeboard.llm import queries, runs
from tests.llm.brute import awkward, frame, prose, words


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // runs.REPEATS + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(runs.LEAST_WORDS, runs.REPEATS * q) and not any(
                q % p == 0 and all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)
            ):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def best_of(found):
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size, kind = rng.randint(0, 130), rng.random()
        if kind < 0.3:
            w = [rng.choice("ab") for _ in range(size)]
        elif kind < 0.6:
            w = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] * 40)[:size]
            for _ in range(rng.randint(0, 2) if w else 0):
                w[rng.randrange(len(w))] = "x"
        elif kind < 0.8:
            w = (["a"] * rng.randint(1, 9) + ["X"]) * rng.randint(1, 12)
        else:
            w = prose(rng.randint(1, 10**6), size).split()
        yield " ".join(w)


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def test_as_the_plain_version(spark):
    rows = awkward()[:13] + awkward()[14:] + [(100 + i, t) for i, t in enumerate(texts_with_runs(1, 250))]
    rows += [(900, " ".join(thue_morse(1 << 11))), (901, " ".join("ab"[int((i + 1) * 0.618034) - int(i * 0.618034)] for i in range(600)))]
    got = {r.doc_id: r for r in runs.find_runs(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = words(text)
        want = plain_runs(w)
        assert got[i].n_words == len(w)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want, i
        assert (tuple(got[i].best) if got[i].best else None) == best_of(want)
        assert got[i].text.encode() == collapsed(w, want)


@pytest.mark.parametrize("size", [2, 8, 64, 128, 2048, 65536])
def test_transform_is_exact(size):
    x = np.random.default_rng(size).integers(0, runs.PRIME, (2, size)).astype(float)
    x[1] = runs.PRIME - 1
    back = runs.transform(runs.transform(x.copy()), True) * pow(size, runs.PRIME - 2, runs.PRIME)
    assert ((back - x) % runs.PRIME == 0).all()
    if size <= 64:
        root = pow(3, (runs.PRIME - 1) // size, runs.PRIME)
        slow = [[sum(int(v) * pow(root, i * k, runs.PRIME) for i, v in enumerate(row)) % runs.PRIME for k in range(size)] for row in x]
        assert (runs.transform(x.copy()) % runs.PRIME == np.array(slow)).all()


def test_long_texts_and_periods_beyond_one_transform():
    big = 2 * runs.LARGEST_BLOCK + 4321
    noise = [str(i) for i in range(900)]
    texts = {
        " ".join(str(i % big) for i in range(4 * big + 17)): [(0, 4 * big + 17, big)],
        " ".join(["a"] * 200_000): [(0, 200_000, 1)],
        " ".join(noise + ["b", "c", "c"] * 30_000 + ["d"]): [(900, 90_000, 3)],
    }
    out = runs._rows(pa.array(range(len(texts))), pa.array(list(texts)))
    assert [[tuple(r.values()) for r in found] for found in out.column(2).to_pylist()] == list(texts.values())


def test_many_distinct_distances_stay_cheap():
    """Blocks of one word at changing gaps: every block occurs at nearly every distance, hardly any is a run."""
    rng = random.Random(2)
    w = []
    while len(w) < 20_000:
        w += ["a"] * rng.randint(3, 40) + [f"x{len(w)}"]
    out = runs._rows(pa.array([1]), pa.array([" ".join(w)]))
    found = [tuple(r.values()) for r in out.column(2).to_pylist()[0]]
    want, i = [], 0
    while i < len(w):
        j = i
        while j < len(w) and w[j] == "a":
            j += 1
        want += [(i, j - i, 1)] if j - i >= 6 else []
        i = j + 1
    assert found == want


def test_odd_tables(spark):
    assert runs.find_runs(frame(spark, [])).count() == 0
    rows = [(None, "a a a a a a a"), (None, "a a a a a a a"), (1, None), (1, "a a a a a a a"), (2, ""), (3, " \t")]
    got = sorted((r.doc_id or 0, r.n_words, len(r.runs), r.text) for r in runs.find_runs(frame(spark, rows)).collect())
    assert got == [(0, 7, 1, "a"), (0, 7, 1, "a"), (1, 0, 0, ""), (1, 7, 1, "a"), (2, 0, 0, ""), (3, 0, 0, "")]


def test_registered_query(spark, folder):
    """Planted tails, digests and the best run of every document, written plainly."""
    want = {}
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = words(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(w)
        top = best_of(found)
        lines = "".join("%d,%d,%d\n" % r for r in found).encode()
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want[doc_id] = (len(found), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed(w, found)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert got == want and any(v[0] for v in want.values())
