"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased words and one end. Words with a minimum count in training
texts are symbols of their own; the others are one symbol, inside which a word has
its discounted share and all unknown words have the discount. Contexts reach back to
the begin of the text. A context counts if it occurs often enough, and is retained if
it tells the next symbol better than its suffix does, by a likelihood-ratio test. Its
distribution is smoothed with that of its suffix. Contexts of three symbols and more
are formed only where their suffix is retained, level by level until a level retains
none, or ``DEPTH`` is reached. A word is scored in the state of the longest retained
suffix.

Minimum counts are absolute, so the tree grows with the corpus. It stays distributed:
texts are read once and cut into blocks, each one row of a table bucketed by block, with
its distinct words and the number of the word at each place. Texts are not stored or
shuffled. For words and then for each length of contexts, blocks send each distinct
(context, next symbol) once to a range of the hash space, packed: a key per context, a
number per symbol. The range sums and tests, and answers in the order of what the block
sent, so that no key travels back or is looked up. It answers with counts and what a
retained context leaves; blocks get the entries' shares from these. What a level leaves to be looked at
by the next one is stored per block; a level reads that, not all that came before.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.llm import hashing
from noticeboard.llm.substrings import BLOCK_BYTES, _groups, _ranges
from noticeboard.llm.texts import bucket
from noticeboard.session import Scratch, new_path, remove

#: Counts from which words and contexts, and next symbols of a context, count.
CONTEXT_COUNT, ENTRY_COUNT = 64, 4
#: Longest context, whatever the test says.
DEPTH, SMOOTHING = 5, 4.0
#: Turns in which the contexts of one and of two symbols are sent, to hold fewer of them at a time.
TURNS = 2
#: Positions of a block that are grouped at a time.
GROUPED = 1 << 19
#: Buckets that a table of blocks has at most.
BUCKETS = 20_000
#: Numbers of symbols: none (the row of a context itself), all words that are no symbols, the end and the begin of a text; words follow.
OWN, RARE, END, BEGIN, FIRST_WORD = range(5)
#: Words that count for the training text are outside one of so many parts of the documents.
PARTS, HELD_PART = 7, 2


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: keys as differences, bytes of equal weight together."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(cells: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers of each cell."""
    out = []
    for cell in cells.to_pylist():
        n, size = int.from_bytes(cell[:8], "little"), np.dtype(kind).itemsize
        planes = pa.decompress(cell[8:], n * size, codec="zstd", asbytes=True) if n else b""
        values = np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind)
        out.append(np.cumsum(values, dtype=np.uint64) if kind is np.uint64 else values)
    return out


def _numbers(cells: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *_unpacked(cells, kind)])


def _cell(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The numbers of a column of one row; none if the column is null or was not asked for."""
    return _numbers(table[column].drop_null(), kind) if column in table.column_names else np.zeros(0, kind)


def _row(schema: str, **cells) -> pa.Table:
    """One row; arrays are packed."""
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    kinds = dict(c.split() for c in schema.split(", "))
    packed = {c: _packed(v) if isinstance(v, np.ndarray) else v for c, v in cells.items()}
    return pa.table({c: pa.array([packed[c]], types[t]) for c, t in kinds.items()})


# -- blocks and words -----------------------------------------------------
_BLOCK = "block long, doc_id array<long>, held_out array<boolean>, size binary, word binary, hash binary, n binary"


def _placed(limit: int):
    """Blocks of texts as rows: words of each text, the place of each word among the distinct ones, their hashes and counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, held, sizes, hashes, read = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            size, hash_ = np.concatenate(sizes), np.concatenate(hashes)
            known, word = np.unique(hash_, return_inverse=True)
            train = np.repeat(~np.array(held, bool), size)
            n = np.bincount(word[train], minlength=len(known))
            pa.default_memory_pool().release_unused()
            made = _row(_BLOCK, block=block, doc_id=ids, held_out=held, size=size.astype(np.int32), word=word.astype(np.uint32), hash=known, n=n.astype(np.uint32))
            return made.to_batches()[0]

        for batch in batches:
            owners, outside = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for at, part in hashing.slices(batch.column("text"), min(limit, hashing.SLICE_BYTES)):
                found = hashing.words(part, fold=True)
                ids += owners[at : at + len(part)]
                held += outside[at : at + len(part)]
                sizes.append(found.count())
                hashes.append(found.hash)
                read += len(found.data)
                if read >= limit:
                    yield row()
                    block += 1
                    ids, held, sizes, hashes, read = [], [], [], [], 0
        if sizes:
            yield row()

    return run


def _post_words(n: int):
    """Distinct words of a block, dealt to ranges; a block without words sends one row all the same."""

    def run(table: pa.Table) -> pa.Table:
        hashes, counts = _cell(table, "hash", np.uint64), _cell(table, "n", np.uint32)
        ends = np.searchsorted(_ranges(hashes, n), np.arange(n + 1))
        used = np.flatnonzero(np.diff(ends)) if len(hashes) else np.zeros(1, np.int64)
        parts = {k: pa.array([_packed(v[ends[i] : ends[i + 1]]) for i in used], pa.binary()) for k, v in (("hash", hashes), ("n", counts))}
        return pa.table({"range": pa.array(used, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(used), pa.int64()), **parts})

    return run


_COUNTED = "range int, block long, count binary, number binary, n_types long, n_tokens long, n_once long, n_symbols long, n_frequent long"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, begins = _groups(keys)
    return keys[order][begins], np.add.reduceat(counts[order], begins) if len(begins) else counts


def _count_words(least: float):
    """The training words of one range (block null) in numbers and, per block and in its order, counts of its words and their numbers among the symbols of the range, from 1."""

    def run(table: pa.Table) -> pa.Table:
        parts, counts = _unpacked(table["hash"], np.uint64), _numbers(table["n"], np.uint32).astype(np.int64)
        own, total = _summed(np.concatenate(parts), counts)
        symbols = total >= least
        number = np.where(symbols, np.cumsum(symbols), 0).astype(np.uint32)
        facts = [total > 0, total, total == 1, symbols, total[symbols]]
        here = table["range"][0].as_py()
        rows = [(here, None, None, None, *(int(x.sum()) for x in facts))]
        for block, part in zip(table["block"].to_pylist(), parts, strict=True):
            at = np.searchsorted(own, part)
            rows.append((here, block, _packed(total[at]), _packed(number[at]), *[None] * len(facts)))
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * len(facts)]
        names = [c.split()[0] for c in _COUNTED.split(", ")]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, zip(*rows, strict=True), types, strict=True)})

    return run


def _merged(columns: dict[str, type]):
    """All answers to one block as one row, in the order of the ranges, which is that of what the block sent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        cells = {c: pa.array([_packed(_numbers(table[c], t))], pa.binary()) for c, t in columns.items()}
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), **cells})

    return run


_NUMBERED = "block long, doc_id array<long>, held_out array<boolean>, size binary, word binary, count binary, number binary"


def _numbered(first):
    """Blocks with counts and numbers of their distinct words instead of hashes; ``first`` has the symbols in the ranges before each."""

    def run(table: pa.Table) -> pa.Table:
        number = _cell(table, "number", np.uint32).astype(np.int64)
        ranges = _ranges(_cell(table, "hash", np.uint64), len(first.value))
        number = np.where(number == 0, RARE, number + (FIRST_WORD - 1) + first.value[ranges])
        cell = pa.array([_packed(number.astype(np.uint32))], pa.binary())
        return pa.table({c: cell if c == "number" else table[c] for c in (x.split()[0] for x in _NUMBERED.split(", "))})

    return run


@dataclass
class Model:
    """What is the same for all words: numbers alone."""

    tokens: int
    types: int
    documents: int
    rare_tokens: int
    discount: float
    unknown: float  # log10 share of unknown words among rare ones
    n_symbols: int
    least: float
    least_entry: float

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 probabilities of symbols in the empty context."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * self.n_symbols))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values from each end to the next."""
    return np.where(np.diff(ends) > 0, np.add.reduceat(np.append(values, 0), ends[:-1]), 0)


@dataclass
class Stream:
    """Symbols of the texts of a block, begins and ends included."""

    size: np.ndarray  # by text, begin and end included
    begin: np.ndarray
    place: np.ndarray  # in the text
    train: np.ndarray
    local: np.ndarray  # symbol as place in ``symbols``
    symbols: np.ndarray  # numbers, ascending
    counts: np.ndarray  # of symbols
    words: np.ndarray  # words in front of each text
    word: np.ndarray  # place of each word among the distinct ones
    word_count: np.ndarray  # of the distinct words
    word_rare: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, m: Model) -> Stream:
        size, word = _cell(table, "size", np.int32).astype(np.int64), _cell(table, "word", np.uint32)
        count, number = _cell(table, "count", np.int64), _cell(table, "number", np.uint32).astype(np.int64)
        rare = number == RARE
        symbols, at = np.unique(np.append(number, [RARE, END, BEGIN]), return_inverse=True)
        at = at.astype(np.int32)
        held = np.zeros(len(symbols), np.int64)
        held[at] = np.append(np.where(rare, m.rare_tokens, count), [m.rare_tokens, m.documents, m.documents])
        words = np.append(0, np.cumsum(size))
        size = size + 2
        begin = np.cumsum(size) - size
        place = np.arange(size.sum(), dtype=np.int32) - np.repeat(begin, size).astype(np.int32)
        local = np.full(len(place), at[-2], np.int32)
        local[begin] = at[-1]
        inner = place > 0
        inner[begin + size - 1] = False
        local[inner] = at[:-3][word]
        train = np.repeat(~np.array(table["held_out"][0].as_py(), bool), size)
        return cls(size, begin, place, train, local, symbols, held, words, word, count, rare)

    def per_text(self, positions: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of values at ascending positions."""
        return _sums(values, np.searchsorted(positions, np.append(self.begin, len(self.place))))


# -- contexts -------------------------------------------------------------
def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the contexts ``a`` followed by the symbols ``b``."""
    return hashing.mix(hashing.mix(a) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


_LEFT = "block long, score binary, context binary, symbol binary, n binary, wider binary, position binary, row binary, loose binary"


@dataclass
class Left:
    """Positions of a block in contexts of one length, and the distinct contexts with their symbols.

    The rows of a context are together: first its own, then those of symbols that may count in it.
    """

    context: np.ndarray  # keys, ascending
    symbol: np.ndarray  # by row
    n: np.ndarray  # count in training texts of the block; of the context itself, that in all
    wider: np.ndarray  # log10 of the symbol in the suffix; nothing for the context itself
    position: np.ndarray
    row: np.ndarray  # of each position; that of the context if the symbol may not count
    loose: np.ndarray  # log10 in the suffix of the symbols of such positions

    @classmethod
    def of(cls, table: pa.Table) -> Left:
        kinds = dict(context=np.uint64, symbol=np.uint32, n=np.int64, wider=np.float32, position=np.uint32, row=np.uint32, loose=np.float32)
        cells = {c: _cell(table, c, t) for c, t in kinds.items()}
        cells["position"] = np.cumsum(cells["position"], dtype=np.int32)
        return cls(**cells | {"symbol": _ascending(cells["symbol"])})

    def cells(self) -> dict[str, np.ndarray]:
        return {
            "context": self.context, "symbol": _steps(self.symbol), "n": self.n, "wider": self.wider,
            "position": np.diff(self.position, prepend=0).astype(np.uint32), "row": self.row.astype(np.uint32), "loose": self.loose,
        }

    @classmethod
    def grouped(cls, position: np.ndarray, of: np.ndarray, keys: np.ndarray, held: np.ndarray, symbol: np.ndarray, able: np.ndarray, wider: np.ndarray, train: np.ndarray) -> Left:
        """From positions with a context each, by its place in ``keys`` and ``held``."""
        here = np.zeros(len(keys), bool)
        here[of] = True
        used = np.flatnonzero(here)
        used = used[np.argsort(keys[used])]
        rank = np.zeros(len(keys), np.int32)
        rank[used] = np.arange(len(used))
        rank = rank[of]
        row, rows, upto = np.empty(len(of), np.int32), [np.zeros(0, np.uint64)], 0
        ends = np.append(0, np.cumsum(np.bincount(rank, minlength=len(used))))
        cuts = np.unique(np.searchsorted(ends, np.arange(0, max(1, len(of)), GROUPED)))
        for a, b in zip(cuts, np.append(cuts[1:], len(used)), strict=True):  # some contexts at a time, to sort less at once
            at = np.flatnonzero((rank >= a) & (rank < b))
            shifted = np.arange(a, b, dtype=np.uint64) << np.uint64(32)
            pairs = shifted[rank[at] - a] | np.where(able[at], symbol[at], OWN).astype(np.uint64)
            found, slot = np.unique(np.append(pairs, shifted), return_inverse=True)
            row[at] = slot[: len(at)] + upto
            rows.append(found)
            upto += len(found)
        symbols = (np.concatenate(rows) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        n = np.bincount(row[train & able], minlength=len(symbols))
        n[symbols == OWN] = held[used]
        widers = np.zeros(len(symbols), np.float32)
        widers[row[able]] = wider[able]
        return cls(keys[used], symbols, n, widers, position, row, wider[~able])

    def contexts(self) -> np.ndarray:
        """Number of the context of each row."""
        return np.cumsum(self.symbol == OWN) - 1


def _steps(symbol: np.ndarray) -> np.ndarray:
    """Symbols, ascending inside each context, as differences; 0 begins a context."""
    return np.where(symbol == OWN, 0, np.diff(symbol.astype(np.int64), prepend=0)).astype(np.uint32)


def _ascending(steps: np.ndarray) -> np.ndarray:
    sums = np.cumsum(steps, dtype=np.int64)
    return (sums - sums[np.maximum.accumulate(np.where(steps == 0, np.arange(len(steps)), 0))]).astype(np.uint32)


def _first(s: Stream, m: Model, n: int = 1, turn: int = 0, turns: int = 1) -> Left:
    """Contexts of one symbol, those of the ranges of one turn."""
    keys = hashing.mix(s.symbols.astype(np.uint64) + np.uint64(0x5EED000000000000))
    position = np.flatnonzero(s.place > 0).astype(np.int32)
    if turns > 1:
        position = position[(_ranges(keys, n) % turns == turn)[s.local[position - 1]]]
    own = s.local[position]
    numbers = s.symbols.astype(np.uint32)
    return Left.grouped(position, s.local[position - 1], keys, s.counts, numbers[own], np.ones(len(position), bool), m.root(s.counts).astype(np.float32)[own], s.train[position])


def _post_level(n: int, level: int, model, turn: int, turns: int):
    """Contexts of a block with their counts, and their next symbols with the counts in training texts of the block.

    Of ``turns`` calls each sends the contexts of its share of the ranges. In contexts of one symbol
    a next symbol has its count in all instead of the log10 in the suffix, once per range.
    """

    def run(table: pa.Table) -> pa.Table:
        m: Model = model.value
        s = Stream.of(table, m) if level == 1 else None
        left = _first(s, m, n, turn, turns) if level == 1 else Left.of(table)
        ranges = _ranges(left.context, n)
        cuts = np.searchsorted(ranges, np.arange(n + 1))
        used = np.flatnonzero(np.diff(cuts))
        used = used[used % turns == turn]
        begins = np.append(np.flatnonzero(left.symbol == OWN), len(left.symbol))
        steps = _steps(left.symbol)
        cells = {"context": [], "symbol": [], "n": [], "wider": []}
        for i in used:
            a, b = cuts[i], cuts[i + 1]
            rows = slice(begins[a], begins[b])
            cells["context"].append(_packed(left.context[a:b]))
            cells["symbol"].append(_packed(steps[rows]))
            cells["n"].append(_packed(left.n[rows]))
            inner = left.symbol[rows] != OWN
            wider = left.wider[rows][inner] if level > 1 else s.counts[np.searchsorted(s.symbols, np.unique(left.symbol[rows][inner]))]
            cells["wider"].append(_packed(wider))
        out = {c: pa.array(v, pa.binary()) for c, v in cells.items()}
        return pa.table({"range": pa.array(used, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(used), pa.int64()), **out})

    return run


_POSTED = "range int, block long, context binary, symbol binary, n binary, wider binary"
_ANSWERED = "range int, block long, status binary, counted binary, value binary, n_retained long"
#: Numbers of answers: 0 nothing, 1 a count, 2 a count that is an entry of a retained context, 3 a retained context with the log10 of what it leaves.
_STATUS = {"status": np.int8, "counted": np.int64, "value": np.float32}


def judged(context: np.ndarray, entry: np.ndarray, counts: np.ndarray, wider: np.ndarray, least: float, least_entry: float) -> tuple[np.ndarray, np.ndarray]:
    """(kind, log10 value) of rows sorted by context; the row of a context itself has its whole count."""
    if not len(context):
        return np.zeros(0, np.int8), np.zeros(0, np.float32)
    begins = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    size = np.diff(np.append(begins, len(context)))
    own = context == entry
    total = np.add.reduceat(np.where(own, counts, 0), begins)
    taken = ~own & (counts >= least_entry)
    rest = np.maximum(total - np.add.reduceat(np.where(taken, counts, 0), begins), 0)
    chance = 10 ** wider.astype(np.float64)
    every = np.repeat(np.maximum(total, 1), size)
    gain = np.add.reduceat(np.where(taken, counts * (np.log(np.maximum(counts, 1) / every) - np.log(chance)), 0), begins)
    left_over = np.maximum(1e-9, 1 - np.add.reduceat(np.where(taken, chance, 0), begins))
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(total, 1) / left_over), 0)
    kept = (total >= least) & (gain > 0.5 * (np.add.reduceat(taken.astype(np.int64), begins) + 1) * np.log(np.maximum(total, 1)))
    left = np.repeat(SMOOTHING + rest, size)
    value = np.where(taken, counts + left * chance, left) / (every + SMOOTHING)
    kind = np.where(~np.repeat(kept, size), 0, np.where(taken, 1, np.where(own, 2, 0)))
    return kind.astype(np.int8), np.log10(value).astype(np.float32)


def _widers(table: pa.Table, symbols: list[np.ndarray], m: Model, level: int) -> np.ndarray:
    """log10 in the suffix of all next symbols that blocks sent."""
    if level > 1:
        return _numbers(table["wider"], np.float32)
    out = [np.zeros(0, np.float32)]
    for counts, symbol in zip(_unpacked(table["wider"], np.int64), symbols, strict=True):
        out.append(m.root(counts).astype(np.float32)[np.unique(symbol[symbol != OWN], return_inverse=True)[1]])
    return np.concatenate(out)


def _answer_level(model, level: int):
    """Per block and in its order, what became of the rows it sent to this range."""

    def run(table: pa.Table) -> pa.Table:
        m: Model = model.value
        contexts, symbols = _unpacked(table["context"], np.uint64), [_ascending(x) for x in _unpacked(table["symbol"], np.uint32)]
        known, at = np.unique(np.concatenate(contexts), return_inverse=True)
        symbol = np.concatenate(symbols)
        own = symbol == OWN
        key = at.astype(np.uint64)[np.cumsum(own) - 1] << np.uint64(32) | symbol.astype(np.uint64)
        counts, wider = _numbers(table["n"], np.int64), np.zeros(len(key), np.float32)
        wider[~own] = _widers(table, symbols, m, level)
        order, begins = _groups(key)
        one = order[begins]
        key, own = key[one], own[one]
        sums = np.where(own, counts[one], np.add.reduceat(counts[order], begins))
        context = key >> np.uint64(32)
        kind, value = judged(context, np.where(own, context, context + np.uint64(1)), sums, wider[one], m.least, m.least_entry)
        # frequent entries are contexts of the next level, other answers are needed only if they tell something
        status = np.where(kind > 0, kind + 1, ~own & (sums >= m.least_entry)).astype(np.int8)
        slot = np.empty(len(order), np.int64)
        slot[order] = np.repeat(np.arange(len(one)), np.diff(np.append(begins, len(order))))
        ends = np.cumsum([len(x) for x in symbols])
        here = table["range"][0].as_py()
        rows = [(here, None, None, None, None, int((own & (kind == 2)).sum()))]
        for block, a, b in zip(table["block"].to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
            to = slot[a:b]
            told = status[to]
            rows.append((here, block, _packed(told), _packed(sums[to][(told == 1) | (told == 2)]), _packed(value[to][told == 3]), None))
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        names = [c.split()[0] for c in _ANSWERED.split(", ")]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, zip(*rows, strict=True), types, strict=True)})

    return run


@dataclass
class Told:
    """Positions of a block after the answers: log10 probabilities, whether their context is retained, and counts of rows and positions."""

    chance: np.ndarray
    retained: np.ndarray
    counts: np.ndarray
    row_counts: np.ndarray

    @classmethod
    def of(cls, left: Left, table: pa.Table | None) -> Told:
        """A probability is the entry's, or what its context leaves to the suffix, or the suffix's if the context is not retained."""
        own = left.symbol == OWN
        able = ~own[left.row]
        chance = left.wider[left.row].astype(np.float64)
        chance[~able] = left.loose
        status = _cell(table, "status", np.int8) if table is not None else np.zeros(0, np.int8)
        row_counts = np.zeros(len(own), np.int64)
        if not len(status):
            return cls(chance, np.zeros(len(chance), bool), np.zeros(len(chance), np.int64), row_counts)
        row_counts[(status == 1) | (status == 2)] = _cell(table, "counted", np.int64)
        value = np.zeros(len(own), np.float32)
        value[status == 3] = _cell(table, "value", np.float32)
        of, entry = np.flatnonzero(own)[left.contexts()], np.flatnonzero(status == 2)
        whole = np.maximum(left.n[of[entry]], 1) + SMOOTHING
        value[entry] = np.log10(row_counts[entry] / whole + 10 ** (left.wider[entry].astype(np.float64) + value[of[entry]]))
        retained = able & (status[left.row] == 2)
        chance[retained] = value[left.row[retained]]
        context = of[left.row]
        kept = ~retained & (status[context] == 3)
        chance[kept] += value[context[kept]]
        return cls(chance, retained | kept, row_counts[left.row], row_counts)


def _before(table: pa.Table, s: Stream, m: Model, level: int) -> tuple[Left, np.ndarray]:
    """Positions in contexts of ``level`` symbols, and the sums of log10 by text of the positions that went no further."""
    return (_first(s, m), np.zeros(len(s.size))) if level == 1 else (Left.of(table), _cell(table, "score", np.float64))


def _longer(level: int, model):
    """From contexts of ``level`` symbols and the answers about them to those with one more."""

    def run(table: pa.Table) -> pa.Table:
        m: Model = model.value
        s = Stream.of(table, m)
        left, score = _before(table, s, m, level)
        told = Told.of(left, table)
        pa.default_memory_pool().release_unused()
        row = np.full(len(s.place), -1, np.int32)
        frequent = told.counts >= m.least
        row[left.position[frequent]] = left.row[frequent]
        before = row[left.position - 1]
        del row, frequent
        use = (before >= 0) & (s.place[left.position] > level)
        if level > 1:
            use &= told.retained
        score = score + s.per_text(left.position[~use], told.chance[~use])
        at = left.position[use]
        keys = _joined(left.context[left.contexts()], left.symbol)
        longer = Left.grouped(at, before[use], keys, told.row_counts, s.symbols.astype(np.uint32)[s.local[at]], told.counts[use] >= m.least_entry, told.chance[use].astype(np.float32), s.train[at])
        return _row(_LEFT, block=table["block"][0].as_py(), score=score, **longer.cells())

    return run


def _score(model, level: int):
    def run(table: pa.Table) -> pa.Table:
        m: Model = model.value
        s = Stream.of(table, m)
        left, score = _before(table, s, m, level)
        score = score + s.per_text(left.position, Told.of(left, table).chance)
        whole = np.log10(m.tokens + m.types + 1)
        # words that are no symbols have their share of the one that stands for them
        inside = np.where(s.word_count > 0, np.log10(np.maximum(s.word_count - m.discount, 1e-12) / max(m.rare_tokens, 1)), m.unknown)

        def per_text(values: np.ndarray) -> np.ndarray:
            return _sums(values[s.word], s.words)

        return pa.table(
            {
                "doc_id": pa.array(table["doc_id"][0].as_py(), pa.int64()),
                "held_out": pa.array(table["held_out"][0].as_py(), pa.bool_()),
                "n_tokens": pa.array(s.size - 1),
                "n_known": pa.array(per_text((s.word_count > 0).astype(np.int64)) + (m.documents > 0)),
                "train_tokens": pa.array(np.full(len(s.size), m.tokens, np.int64)),
                "base_score": pa.array(per_text(np.log10(s.word_count + 1.0) - whole) + np.log10(m.documents + 1) - whole),
                "score": pa.array(score + per_text(np.where(s.word_rare, inside, 0.0))),
            }
        )

    return run


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession):
    """Shuffle files of a write go at its end, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(rows: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str, str]:
    """Rows written as a table bucketed by block, its name and its path; tables with as many buckets meet without a shuffle."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    rows.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table), table, path


def _dropped(spark: SparkSession, kept: tuple[DataFrame, str, str] | None) -> None:
    if kept is not None:
        spark.sql(f"DROP TABLE {kept[1]}")
        remove(spark, kept[2])


def _answers(cells: DataFrame, columns: dict[str, type], name: str, buckets: int) -> tuple[DataFrame, str, str]:
    """The answers of all ranges, one row per block."""
    schema = ", ".join(["block long", *[f"{c} binary" for c in columns]])
    rows = cells.filter("block IS NOT NULL").select("range", "block", *columns)
    return _bucketed(rows.groupBy("block").applyInArrow(_merged(columns), schema), name, buckets)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = CONTEXT_COUNT, least_entry: int = ENTRY_COUNT, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    The model and the counts come from documents outside part ``HELD_PART`` of
    ``PARTS``. ``base_score`` is the add-one unigram score, ``score`` that of the
    tree, both log10 over the words and the end, with all unknown words as one
    symbol. Null and empty texts have the end alone. Rows with null or repeated ids
    are scored one by one (a null id is dealt to a part as the text ``null``). An
    empty table gives no rows. Words are told apart by 64-bit hashes. Words and
    contexts count from ``least`` occurrences, next symbols from ``least_entry``.
    """
    spark = docs.sparkSession
    plain = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (bucket(F.col(f"`{key}`"), PARTS) == HELD_PART).alias("held_out")
    )
    by_part = plain.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((~F.col("held_out")).cast("long")).alias("documents"))
    facts = by_part.agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.max("part").alias("last"), F.sum("documents").alias("documents")).first()
    documents, ranges = facts["documents"] or 0, max(1, -(-(facts["bytes"] or 0) // BLOCK_BYTES))
    cuts = max(1, -(-(facts["largest"] or 0) // BLOCK_BYTES))
    buckets = min(BUCKETS, ((facts["last"] or 0) + 1) * cuts)
    with _freed_shuffles(spark):
        placed = _bucketed(plain.mapInArrow(_placed(max(1, (facts["largest"] or 0) // cuts)), _BLOCK), "blocks", buckets)
        with Scratch(spark) as scratch:
            words = placed[0].select("block", "hash", "n").groupBy("block").applyInArrow(_post_words(ranges), "range int, block long, hash binary, n binary")
            counted = scratch.keep(words.groupBy("range").applyInArrow(_count_words(least), _COUNTED), "words")
            names = ("types", "tokens", "once", "symbols", "frequent")
            totals = counted.agg(*[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in names]).first()
            in_range = np.zeros(ranges, np.int64)
            for r in counted.filter("n_symbols > 0").select("range", "n_symbols").collect():
                in_range[r["range"]] = r["n_symbols"]
            known = _answers(counted, {"count": np.int64, "number": np.uint32}, "words", buckets)
            first = spark.sparkContext.broadcast(np.cumsum(in_range) - in_range)
            named = placed[0].drop("n").join(known[0], "block")
            blocks = _bucketed(named.groupBy("block").applyInArrow(_numbered(first), _NUMBERED), "numbered", buckets)[0]
            _dropped(spark, placed)
            _dropped(spark, known)
        rare_tokens, rare_types = totals["tokens"] - totals["frequent"], totals["types"] - totals["symbols"]
        discount = min(0.9, totals["once"] / rare_types) if rare_types else 0.0
        share = discount * rare_types / rare_tokens if rare_tokens else 1.0
        unknown = float(np.log10(max(share, 1e-12)))
        types, tokens = totals["types"] + (documents > 0), totals["tokens"] + documents
        model = spark.sparkContext.broadcast(Model(tokens, types, documents, rare_tokens, discount, unknown, totals["symbols"] + 2, least, least_entry))
        left, rows, level = None, blocks, 1
        while True:
            with Scratch(spark) as scratch:
                turns = min(ranges, TURNS) if level <= 2 else 1
                sent = blocks.drop("doc_id") if left is None else left[0].select("block", "context", "symbol", "n", "wider")
                parts = []
                for turn in range(turns):
                    posted = sent.groupBy("block").applyInArrow(_post_level(ranges, level, model, turn, turns), _POSTED)
                    parts.append(scratch.keep(posted.groupBy("range").applyInArrow(_answer_level(model, level), _ANSWERED), f"turn{turn}"))
                answered = reduce(DataFrame.union, parts)
                told = answered.agg(F.sum("n_retained")).first()[0]
                answers = _answers(answered, _STATUS, f"answers{level}", buckets) if told else None
            rows = blocks if left is None else blocks.join(left[0], "block")
            rows = rows.join(answers[0], "block", "left") if answers else rows.withColumns({c: F.lit(None).cast("binary") for c in _STATUS})
            if not told or level == depth:
                break
            longer = _bucketed(rows.drop("doc_id").groupBy("block").applyInArrow(_longer(level, model), _LEFT), f"left{level + 1}", buckets)
            _dropped(spark, left)
            _dropped(spark, answers)
            left, level = longer, level + 1
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").applyInArrow(_score(model, level), schema)
