"""Near duplicates, substring dedup, packing and language-model scores against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest

from noticeboard.llm import hashing, near_dups, packing, substrings, suffix_tree
from tests.llm import brute
from tests.llm.brute import awkward, folded, frame, prose, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def shingles(text):
    w = folded(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((name[a], name[b]))
            name = {k: low if v == high else v for k, v in name.items()}
    return {i: (len(sets[i]), name[i], name[i] == i) for i in sets}


def family(seed, n, edits):
    """Near copies of one text, further and further from it."""
    base = prose(seed, 150).split()
    out = []
    for k in range(n):
        rng = np.random.default_rng(seed * 1000 + k)
        own = list(base)
        for place in rng.integers(0, len(own), rng.integers(0, edits)):
            own[place] = f"edit{rng.integers(0, 3)}"
        out.append(" ".join(own))
    return out


def test_near_duplicate_classes(spark):
    texts = family(1, 60, 14) + family(2, 40, 10) + [prose(k, 80) for k in range(30)]
    rows = awkward() + [(100 + i * 7 % 997, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.classify(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_chains_and_hubs_reach_the_smallest_id(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in (60, 61, 62, 99)] + [(7, 7)]
    got = {r.id: r.component for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 60 for k in (60, 61, 62, 99, 100)}}
    assert near_dups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_tables(spark):
    assert near_dups.classify(frame(spark, [])).count() == 0
    assert near_dups.keep_one(frame(spark, [])).count() == 0
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (1, "other text here"), (2, prose(1, 50)), (None, prose(1, 50)), (None, None)]
    got = near_dups.classify(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (0, True), (1, True), (2, got[0].kept and any(r.doc_id == 2 and r.kept for r in got))]
    kept = near_dups.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids.count(1) == 1 and ids.count(0) == 2


def test_repeated_rows_keep_one(spark):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(1, 50)), (3, prose(3, 50))]
    assert sorted(r.doc_id for r in near_dups.keep_one(frame(spark, rows)).collect()) == [1, 3]


def test_full_lists_fall_apart_exactly(spark):
    """Members far from the hub of a large family are still linked with each other where they should."""
    texts = family(5, 150, 30)
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.classify(frame(spark, rows)).collect()}
    assert got == classes(rows)


def without_repeats(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i or 0, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 20_000])
def test_substrings(spark, block, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    rows = [*awkward(), (None, prose(1, 120)), (4, prose(2, 60)), (40, prose(2, 60) + " x " + prose(7, 50)), (41, prose(2, 13)), (42, prose(2, 12))]
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == without_repeats(rows)


def test_substrings_of_an_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_any_long_match_has_an_aligned_anchor():
    for a, b in itertools.product(range(substrings.PERIOD), repeat=2):
        assert any((a + s) % substrings.PERIOD in substrings.COVER and (b + s) % substrings.PERIOD in substrings.COVER for s in range(substrings.PERIOD))


def whole(texts):
    encoder = packing.Encoder(TOKENIZER)
    return [np.array(x.ids, np.uint32).tobytes() for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_units_are_tokenised_as_whole_texts():
    texts = ["a  b", " a", "a ", "", "  ", None, "a\n b", "a\n \nb", "x — y", "it's 'tis <|endoftext|> ok", "\n", "a\t b", " ", "a　 b", "a 　b", "«a» « b »"]
    texts += ["1 2 33", "a\n\n\n b c\r\n d", "end.\nStart, x.y,z", "e.\n", "é.\nb", "don't  stop", "a\x1cb \x1cc", "x\n.y\n,z", "A. B", " \nb"]
    texts += [t for _, t in awkward()]
    assert packing.Encoder(TOKENIZER).encode(pa.array(texts)) == whole(texts)


@pytest.mark.parametrize("fan", [64, 2])
def test_packing(spark, fan, monkeypatch):
    monkeypatch.setattr(packing, "FAN", fan)
    rows = [*awkward(), (None, "no id"), *[(100 + i, prose(i, 10 + 37 * i % 600)) for i in range(60)]]
    got = packing.pack(frame(spark, rows).repartition(7), TOKENIZER).collect()
    coded = {i: np.frombuffer(x, np.uint32).tolist() + [0] for (i, _), x in zip(rows, whole([t for _, t in rows]), strict=True)}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in coded.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids) == (at, len(ids), ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    assert padding == 0


def test_packing_of_odd_tables(spark):
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0
    got = packing.pack(frame(spark, [(1, "a"), (1, "a"), (1, None)]), TOKENIZER).collect()
    assert sorted(r.doc_tokens for r in got if r.start == 0) == [1, 2, 2]


def test_packer_never_holds_more_than_its_windows():
    packer = packing.Packer(64, 4)
    for i in range(300):
        packer.add(packing.Piece(i, 0, 0, bytes(4 * (i * 29 % 97))))
        assert len(packer.open) <= 4


def test_lm_scores(spark):
    rows = [*awkward(), *[(100 + i, prose(i % 50, 40) + f" only{i}") for i in range(200)]]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts, documents = {}, 0
    for i, t in rows:
        if not held[i]:
            documents += 1
            for w in folded(t):
                counts[w] = counts.get(w, 0) + 1
    tokens, types = sum(counts.values()) + documents, len(counts) + 1
    base = lambda c: math.log10((c + 1) / (tokens + types + 1))
    got = {r.doc_id: r for r in suffix_tree.score(frame(spark, rows)).collect()}
    better = 0
    for i, t in rows:
        w, r = folded(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(x in counts for x in w) + 1, tokens)
        assert math.isclose(r.base_score, sum(base(counts.get(x, 0)) for x in w) + base(documents), rel_tol=1e-9)
        better += held[i] and r.score > r.base_score
    assert better > 0.8 * sum(held.values())


def test_members_of_a_hub_meet_on_prefixes(spark):
    rng = random.Random(4)
    sets = {i: set(rng.sample(range(40), 12)) for i in range(60)}
    for i in range(0, 60, 6):
        sets[i + 1] = set([*sets[i]][:10]) | {100 + i}
    rows = [(1, i, i, 8, sorted(v)) for i, v in sets.items()]
    rows += [(2, i, i, 3, [1000 + 10 * i + k for k in range(9)]) for i in range(50)]  # nothing in common: nobody meets
    parts = spark.createDataFrame(rows, "hub long, rep long, component long, needed int, outside array<long>")
    met = {}
    for r in near_dups._rarest(parts, "outside", parts["needed"]).collect():
        met.setdefault((r.hub, r.shingle), set()).add(r.rep)
    pairs = {p for (hub, _), reps in met.items() for p in itertools.combinations(sorted(reps), 2) if hub == 1}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 8}
    assert wanted and wanted <= pairs and len(pairs) < 60 * 59 / 2
    assert all(hub == 1 for hub, _ in met)


def chained(i):
    """Text in which the next word depends on up to three words before it."""
    rng, out = random.Random(i), ["a", "b", "c"]
    for _ in range(60):
        told = {("a", "b", "c"): "d", ("b", "b", "c"): "e", ("c", "d"): "a"}
        out.append(next((told[k] for k in (tuple(out[-3:]), tuple(out[-2:])) if k in told and rng.random() < 0.9), rng.choice("abcdef")))
    return " ".join(out) + f" rare{i % 60} once{i}"


def test_answers_about_contexts_are_not_shuffled_again(spark):
    got = suffix_tree.score(frame(spark, [(i, chained(i)) for i in range(40)]), least=20, least_entry=3, depth=1)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_for_lm_scores(spark):
    got = suffix_tree.score(frame(spark, [(i, chained(i)) for i in range(40)]), least=20, least_entry=3, depth=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    read = {column.split("#")[0] for column in plan.replace("(", " ").replace("[", " ").replace(",", " ").split() if "#" in column}
    assert "number" in read and not {"text", "hash"} & read


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_lm_scores_equal_a_plain_tree(spark, depth, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 8_000)  # several blocks and ranges
    rows = [(i, chained(i)) for i in range(300)] + [(1000 + i, t) for i, t in awkward()]
    expected, kept = brute.suffix_tree(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 20, 3, depth, suffix_tree.SMOOTHING)
    assert max(map(len, kept)) >= min(depth, 3)
    got = suffix_tree.score(frame(spark, rows), least=20, least_entry=3, depth=depth).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, expected[r.doc_id], rel_tol=1e-6)


def test_lm_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 2**64, 999, dtype=np.uint64), np.sort(rng.integers(0, 2**64, 50, dtype=np.uint64)), np.zeros(0, np.uint64), rng.normal(size=7).astype(np.float32), np.arange(-3, 4), np.array([2, 0, 1], np.int8)):
        cells = pa.chunked_array([[suffix_tree._packed(values), suffix_tree._packed(values[:0])]])
        assert suffix_tree._numbers(cells, values.dtype.type).tolist() == values.tolist()


def test_lm_of_odd_tables(spark):
    assert suffix_tree.score(frame(spark, [])).count() == 0
    got = suffix_tree.score(frame(spark, [(None, "a a"), (1, None), (1, None), (2, "")])).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = suffix_tree.score(frame(spark, [(only_held, "a b")])).first()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0) and math.isfinite(row.score)


def test_hashes_follow_words_alone():
    found = hashing.words(pa.array(["a b  c", "", None, " Hello\tworld\n", "a b", "x" * 10]))
    assert found.count().tolist() == [3, 0, 0, 2, 2, 1]
    assert found.hash[0] == found.hash[5] and found.hash[0] != found.hash[1]
    assert hashing.words(pa.array(["HeLLo É"]), True).hash.tolist() == hashing.words(pa.array(["x hello É"]), True).hash[1:].tolist()


def test_lm_contexts_of_a_large_corpus(spark):
    """Contexts and words keep counting however small their share of the corpus is."""
    held = [i for i in range(1000, 1099) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, prose(i, 40) + (" alpha beta gamma" if i % 3 else " gamma alpha")) for i in range(400)]
    rows += list(zip(held, ["alpha beta gamma", "beta alpha gamma"], strict=True))
    got = {r.doc_id: r.score for r in suffix_tree.score(frame(spark, rows)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_lm_retained_context_sums_to_one():
    context, entry = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 7, 9], np.uint64)
    kind, value = suffix_tree.judged(context, entry, np.array([500, 200, 720, 3]), np.log10([0.1, 0.2, 1, 1]).astype(np.float32), 64, 4)
    assert kind.tolist() == [1, 1, 2, 0]
    assert math.isclose((10 ** value[:2]).sum() + 10 ** value[2] * 0.7, 1, rel_tol=1e-5)


def test_lm_sends_a_number_once_per_symbol_and_context():
    """Next symbols do not carry the log10 of the empty context each, and answers tell no log10 per entry."""
    word = np.random.default_rng(5).integers(0, 6, 9000).astype(np.uint32)
    word[1::3] = (word[::3] + 1) % 6
    number, counts = np.arange(6, dtype=np.uint32) + suffix_tree.FIRST_WORD, np.bincount(word)
    block = suffix_tree._row(suffix_tree._NUMBERED, block=0, doc_id=[1], held_out=[False], size=np.array([9000], np.int32), word=word, count=counts, number=number)
    model = SimpleNamespace(value=suffix_tree.Model(9001, 7, 1, 0, 0.0, 0.0, 8, 64, 4))
    sent = suffix_tree._post_level(2, 1, model, 0, 1)(block)
    rows = len(suffix_tree._numbers(sent["symbol"], np.uint32)) - len(suffix_tree._numbers(sent["context"], np.uint64))
    assert len(suffix_tree._numbers(sent["wider"], np.int64)) <= 7 * len(sent) < rows
    answered = pa.concat_tables([suffix_tree._answer_level(model, 1)(sent.slice(i, 1)) for i in range(len(sent))])
    answers = suffix_tree._merged(suffix_tree._STATUS)(answered.filter(pyarrow.compute.is_valid(answered["block"])))
    status = suffix_tree._numbers(answers["status"], np.int8)
    assert len(suffix_tree._numbers(answers["value"], np.float32)) == (status == 3).sum() < (status == 2).sum()
    # what a block works out from these is what the whole table gives
    left = suffix_tree._first(suffix_tree.Stream.of(block, model.value), model.value)
    told = suffix_tree.Told.of(left, answers)
    context = left.contexts()
    own = left.symbol == suffix_tree.OWN
    key = context.astype(np.uint64) * np.uint64(1000)
    _, value = suffix_tree.judged(key, np.where(own, key, key + left.symbol), left.n, left.wider, 64, 4)
    entry = (status == 2)[left.row]
    assert np.abs(told.chance[entry] - value[left.row[entry]]).max() < 1e-6 and entry.any()
