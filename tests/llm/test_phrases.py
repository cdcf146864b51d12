"""Phrase mining against a plain version."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import phrases
from tests.llm.brute import prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mined(rows, top):
    counts, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().translate(LOWER)):
            words = [w for w in re.split(rb"[ \t]+", piece) if w]
            totals[lang] = totals.get(lang, 0) + len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    key = (lang, *words[i : i + m])
                    counts[key] = counts.get(key, 0) + 1
    kept = {k: c for k, c in counts.items() if c >= phrases.LEAST}
    longer = {}
    for k, c in kept.items():
        for part in (k[:-1], (k[0], *k[2:])):
            if len(k) > 3:
                longer[part] = max(longer.get(part, 0), c)
    out = {}
    for k, a in kept.items():
        if len(k) > 2 and 100 * longer.get(k, 0) < phrases.DROP * a:
            lang, p = k[0], k[1:]
            cuts = [(2_000_000 * a // (kept[(lang, *p[:i])] + kept[(lang, *p[i:])]), i) for i in range(1, len(p))]
            score, i = min(cuts)
            out.setdefault(lang, []).append((-score, -a, b" ".join(p), a, kept[(lang, *p[:i])], kept[(lang, *p[i:])]))
    rows = []
    for lang, found in out.items():
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), a, l, r, totals[lang], -score))
    return sorted(rows)


def corpus(seed, docs, vocabulary):
    """Texts in three languages (one of them null) with set phrases, repeated sentences and few distinct words."""
    rng = random.Random(seed)
    usual = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(usual) if rng.random() < 0.4 else [rng.choice(vocabulary)]
            if rng.random() < 0.2:
                words.append(rng.choice([".", ", x", "\n", "!\t", " ;; "]))
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append((rng.choice(["en", "en", "en", "und", None, "de"]), text))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    return df.withColumns({c: F.lit("x") for c in ("key", "word", "n", "a", "h1", "floor", "before", "_on", "_salt")})


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("top, frontier", [(2000, 8000), (5, 3), (40, 1)])
def test_as_the_plain_version_in_one_round_or_many(spark, top, frontier):
    rows = corpus(7, 300, [f"w{i}" for i in range(25)] + ["é", "naïve", "ß"])
    want = mined(rows, top)
    assert len({r[0] for r in want}) == 3 and want
    assert rows_of(phrases.mine(frame(spark, rows), top=top, frontier=frontier)) == want


def test_ties_at_the_end_go_by_bytes(spark):
    texts = [f"a{i} b{i}. é{i} ü{i}" for i in range(30)] * 30
    rows = [("en", t) for t in texts]
    got = rows_of(phrases.mine(frame(spark, rows), top=7, frontier=1))
    assert got == mined(rows, 7) and len(got) == 7


def test_odd_tables(spark):
    assert phrases.mine(frame(spark, [])).count() == 0
    assert phrases.mine(frame(spark, [("en", None), ("en", ""), (None, " .. \n"), ("fr", "one two")])).count() == 0
    rows = [(None, "same words here " * 200), ("und", "same words\there,"), ("x", "same same " * 40)]
    assert rows_of(phrases.mine(frame(spark, rows), top=50)) == mined(rows, 50)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    text = (prose(3, 400) + ". ") * 40 + "tail without an end " * 200
    monkeypatch.setattr(phrases, "SLICE_BYTES", 900)
    parts = [b for b, _ in phrases._cut(pa.array([text, None, "short"], pa.large_string()).fill_null(""), pa.array(["en"] * 3))]
    assert "".join(x for p in parts for x in p.to_pylist()) == text + "short" and len(parts) > 30
    monkeypatch.undo()
    rows = [("en", text)]
    assert rows_of(phrases.mine(frame(spark, rows), top=100)) == mined(rows, 100)


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(6_000_000_000_000, 6_000_000_000_001, 9_000_000_000_000_000)], "a long, f1 long, r long")
    got = df.select(phrases._share("a", F.col("f1") + F.col("r")).alias("s")).first().s
    assert got == 2_000_000 * 6_000_000_000_000 // (6_000_000_000_001 + 9_000_000_000_000_000)
    covered = df.select(phrases._covered(F.col("a"), F.lit(4_800_000_000_000)).alias("c"), phrases._covered(F.col("a"), F.lit(4_799_999_999_999)).alias("d")).first()
    assert covered.c and not covered.d


def test_slots_agree_inside_and_outside_tasks(spark):
    keys = np.random.default_rng(5).integers(-(2**63), 2**63, (50, 3))
    df = spark.createDataFrame([tuple(map(int, r)) for r in keys], "h1 long, h2 long, h3 long")
    got = [r.s for r in df.select(phrases._slot(["h1", "h2", "h3"]).alias("s")).collect()]
    want = phrases.folded([np.ascontiguousarray(keys[:, i]).view(np.uint64) for i in range(3)]) & np.uint64((1 << phrases.FILTER_BITS) - 1)
    assert got == want.tolist()
    bits = np.frombuffer(phrases._bitmap(df, ["h1", "h2", "h3"]).value, np.uint8)
    assert phrases._holds(bits, want).all() and np.unpackbits(bits).sum() == len(set(got))
