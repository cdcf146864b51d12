"""Collocations per language by best-first branch-and-bound growth.

A phrase grows to the right from its prefix. With ``a`` occurrences of a prefix and
``f`` of its first word, no phrase that starts with it can score above
``SCALE * a / (f + a)``: it has at most ``a`` occurrences itself, its first cut puts
the first word on the left, and what is on the right occurs at least as often as
the phrase. The bound falls along a branch, so it orders the whole frontier.

All words and all pairs of frequent words are counted. Then each round lowers a
floor per language to the bound of the next ``FRONTIER`` pairs (four times as many
each round), expands every node whose bound reaches the floor, and settles every
candidate whose score does: occurrences of the phrases one word longer to the left
and right tell whether it is dropped. A language is done once ``TOP`` candidates at
or above its floor survive, or all is expanded; what lies below the floor cannot
matter then.

Each expansion is one scan of the texts. Tasks count the windows whose prefix or
rest may be wanted, by bitmaps of ``2 ** FILTER_BITS`` bits built by Spark from the
nodes; a window that passes by chance is counted in full all the same and falls out
of the join with the nodes. Words are 64-bit hashes that include the language, and
only the phrases of the result get their texts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm import hashing
from noticeboard.llm.texts import spread_lookup
from noticeboard.session import materialise

#: Occurrences of a candidate, phrases returned per language, share in percent of a longer one that drops it.
LEAST, TOP, DROP = 30, 2000, 80
SCALE = 2_000_000
#: Pairs that the first round expands per language.
FRONTIER = 4 * TOP
FILTER_BITS = 26
#: Bytes of text counted at once; longer texts are cut between pieces.
SLICE_BYTES = 4 << 20
_ROWS = 1 << 16

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_APART = _BREAK.copy()
_APART[list(b" \t")] = True


# -- inside tasks ---------------------------------------------------------
@dataclass
class Slice:
    """Words of some texts: keys, texts' numbers, and whether the next word follows in the same piece."""

    found: hashing.Words
    key: np.ndarray
    text: np.ndarray
    joined: np.ndarray

    def windows(self, length: int) -> np.ndarray:
        """Starts of all windows of ``length`` words inside one piece."""
        n = len(self.key) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(reduce(np.logical_and, (self.joined[j : j + n] for j in range(length - 1))))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def folded(keys: list[np.ndarray]) -> np.ndarray:
    """One number for word keys that stand side by side; :func:`_slot` is the same as a column."""
    return reduce(np.bitwise_xor, (_turned(k, 21 * i) for i, k in enumerate(keys)))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _cut(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of about ``SLICE_BYTES``; a longer text comes in parts that end between pieces."""
    for at, part in hashing.slices(texts, SLICE_BYTES):
        own = langs.slice(at, len(part))
        if len(part) > 1 or (pc.binary_length(part)[0].as_py() or 0) <= SLICE_BYTES:
            yield part, own
            continue
        data = np.frombuffer(part[0].as_buffer(), np.uint8)
        ends = np.append(np.flatnonzero(_BREAK[data]) + 1, len(data))
        begin = 0
        while begin < len(data):
            end = int(ends[max(np.searchsorted(ends, begin + SLICE_BYTES, side="right") - 1, np.searchsorted(ends, begin, side="right"))])
            yield pa.array([data[begin:end].tobytes()], pa.large_binary()).cast(pa.large_string()), own
            begin = end


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, pa.Array]]:
    seeds: dict[str, int] = {}
    for batch in batches:
        for texts, langs in _cut(batch.column(0).cast(pa.large_string()), batch.column(1)):
            found = hashing.words(texts, True, _APART)
            text = np.repeat(np.arange(len(texts)), found.count())
            seed = np.array([seeds.setdefault(x, _seed(x)) if x not in seeds else seeds[x] for x in langs.to_pylist()], np.uint64)
            key = hashing.mix(found.hash ^ seed[text])
            piece = np.cumsum(_BREAK[found.data], dtype=np.int32)[found.start] if len(text) else text
            yield Slice(found, key, text, (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])), langs


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    kinds = {"lang": pa.string(), "word": pa.binary()}
    for at in range(0, n, _ROWS):
        yield pa.record_batch([pa.array(c[at : at + _ROWS], kinds.get(name, pa.int64())) for name, c in columns.items()], names=list(columns))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, langs in _slices(batches):
        keys, index, n = np.unique(part.key, return_index=True, return_counts=True)
        lang = np.array(langs.to_pylist(), object)
        data = part.found.data.tobytes()
        spans = zip(part.found.start[index].tolist(), part.found.end[index].tolist(), strict=True)
        word = np.array([data[a:b].lower() for a, b in spans], object)
        own, many = np.unique(part.text, return_counts=True)
        totals: dict[str, int] = {}
        for x, c in zip(lang[own].tolist(), many.tolist(), strict=True):
            totals[x] = totals.get(x, 0) + c
        yield from _batches({"key": keys.view(np.int64), "lang": lang[part.text[index]], "word": word, "n": n})
        yield from _batches({"key": np.zeros(len(totals), np.int64), "lang": np.array(list(totals), object), "word": np.full(len(totals), None), "n": np.array(list(totals.values()), np.int64)})


def _holds(bits: np.ndarray, folded_keys: np.ndarray) -> np.ndarray:
    slot = folded_keys & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _count_windows(length: int, wanted: list[tuple[int, int, object]]) -> Callable:
    """Counts of windows of ``length`` words. ``wanted``: (first word, words, bitmap); with pairs all must hold, else one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [(a, n, np.frombuffer(b.value, np.uint8)) for a, n, b in wanted]
        for part, _ in _slices(batches):
            at = part.windows(length)
            if not len(at):
                continue
            held = [_holds(bits, folded([part.key[at + a + j] for j in range(n)])) for a, n, bits in filters]
            at = at[reduce(np.logical_and if length == 2 else np.logical_or, held)]
            _, index, n = np.unique(folded([part.key[at + j] for j in range(length)]), return_index=True, return_counts=True)
            yield from _batches({f"h{j + 1}": part.key[at[index] + j].view(np.int64) for j in range(length)} | {"n": n})

    return count


# -- jobs -----------------------------------------------------------------
def _names(n: int, first: int = 1) -> list[str]:
    return [f"h{j}" for j in range(first, first + n)]


def _slot(columns: list[str]) -> Column:
    turned = [F.col(c) if not i else F.shiftleft(c, 21 * i).bitwiseOR(F.shiftrightunsigned(c, 64 - 21 * i)) for i, c in enumerate(columns)]
    return reduce(lambda a, b: a.bitwiseXOR(b), turned).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def _bitmap(nodes: DataFrame, columns: list[str]):
    """The broadcast set of (hashes of) the nodes: at most ``2 ** (FILTER_BITS - 15)`` rows of 4 KB come to the driver."""
    slots = nodes.select(_slot(columns).alias("slot"))
    chunks = slots.groupBy(F.shiftright("slot", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = bytearray(1 << (FILTER_BITS - 3))
    for row in chunks.collect():
        bits[row.chunk * 4096 : (row.chunk + 1) * 4096] = row.bits
    return nodes.sparkSession.sparkContext.broadcast(bytes(bits))


def _windows(texts: DataFrame, length: int, wanted: list[tuple[int, int, object]]) -> DataFrame:
    names = _names(length)
    counted = texts.mapInArrow(_count_windows(length, wanted), ", ".join(f"{h} long" for h in names) + ", n long")
    return counted.groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= LEAST)


def _share(a: str, total: Column) -> Column:
    """floor(SCALE * a / total), exact beyond 64 bits."""
    whole = F.col(a).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, total.cast("decimal(20,0)"))


def _bound() -> Column:
    return _share("a", F.col("f1") + F.col("a"))


def _scored(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut; of equal ones that with the fewest words on the left."""
    each = [F.struct(_share("a", F.col(l) + F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts)]
    low = F.least(*each) if len(each) > 1 else each[0]
    return rows.withColumn("low", low).select(*rows.columns, "low.l", "low.r", "low.score")


def _covered(a: Column, longer: Column) -> Column:
    return F.coalesce(longer.cast("decimal(22,0)") * 100 >= a.cast("decimal(22,0)") * DROP, F.lit(False))


@dataclass
class Growth:
    """What is known of the phrases of a corpus: words, pairs, and the tables of each round."""

    texts: DataFrame
    words: DataFrame
    pairs: DataFrame
    triples: list[DataFrame] = field(default_factory=list)
    quads: list[DataFrame] = field(default_factory=list)
    scored: list[DataFrame] = field(default_factory=list)
    settled: list[DataFrame] = field(default_factory=list)

    def between(self, rows: DataFrame, by: str, floors: DataFrame, size: int) -> DataFrame:
        """Rows whose ``by`` lies between the new floor of their language and the one before."""
        met = spread_lookup(rows, floors.select("lang", "floor", "before"), "lang", size, F.col("h1"))
        return met.filter((F.col(by) >= F.col("floor")) & (F.col(by) < F.col("before"))).drop("floor", "before")

    def _counts(self, n: int, first: int, name: str) -> DataFrame:
        """Known counts of words or pairs under the names of a place in a phrase."""
        table = self.words.select(F.col("key").alias("h1"), "f") if n == 1 else self.pairs.select("h1", "h2", F.col("a").alias("f"))
        return table.select(*[F.col(f"h{j + 1}").alias(f"h{first + j}") for j in range(n)], F.col("f").alias(name))

    def _longer(self, nodes: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
        """Phrases one word longer: to the right of nodes, and around the candidates asked for."""
        left = _bitmap(nodes.select(keys).union(asked.select(keys)), keys)
        return _windows(self.texts, len(keys) + 1, [(0, len(keys), left), (1, len(keys), _bitmap(asked, keys))])

    def _settle(self, wanted: DataFrame, windows: DataFrame, length: int) -> DataFrame:
        """The wanted candidates that no phrase of one word more covers."""
        names = _names(length)
        shifted = [F.col(f"h{j + 2}").alias(f"h{j + 1}") for j in range(length)]
        longer = windows.select(*names, "a").union(windows.select(*shifted, "a")).groupBy(*names).agg(F.max("a").alias("longer"))
        met = wanted.join(longer, names, "left")
        kept = met.filter(~_covered(F.col("a"), F.col("longer")))
        return kept.select("lang", F.array(*names).alias("keys"), "a", "l", "r", "score")

    def expand(self, floors: DataFrame, size: int) -> None:
        """One round: all nodes and candidates between the new floors and those before."""
        keys = _names(2)
        nodes = materialise(self.between(self.pairs, "bound", floors, size), "nodes2")
        asked = materialise(self.between(self.pairs, "score", floors, size), "asked2")
        windows = materialise(self._longer(nodes, asked, keys), "windows3")
        self.settled.append(materialise(self._settle(asked, windows, 2), "settled2"))
        grown = windows.join(nodes.select(*keys, "lang", "f1", F.col("a").alias("a12")), keys)
        grown = grown.join(self._counts(2, 2, "a23"), ["h2", "h3"]).join(self._counts(1, 3, "f3"), "h3")
        grown = _scored(grown.withColumn("bound", _bound()), [("f1", "a23"), ("a12", "f3")])
        self.triples.append(materialise(grown.select("lang", "h1", "h2", "h3", "a", "f1", "a12", "bound", "l", "r", "score"), "triples"))

        triples = reduce(DataFrame.union, self.triples)
        nodes = materialise(self.between(triples, "bound", floors, size), "nodes3")
        asked = materialise(self.between(triples, "score", floors, size), "asked3")
        keys = _names(3)
        windows = materialise(self._longer(nodes, asked, keys), "windows4")
        self.settled.append(materialise(self._settle(asked, windows, 3), "settled3"))
        grown = windows.join(nodes.select(*keys, "lang", "f1", "a12", F.col("a").alias("a123")), keys)
        grown = grown.join(self._counts(2, 3, "a34"), ["h3", "h4"]).join(self._counts(1, 4, "f4"), "h4")
        bounds = [_bound(), _share("a", F.col("a12") + F.col("a34")), _share("a", F.col("a123") + F.col("f4"))]
        quads = grown.withColumn("bound", F.least(*bounds))
        self.quads.append(materialise(quads.select("lang", *_names(4), "a", "f1", "a12", "a34", "a123", "f4", "bound"), "quads"))

        # the rest behind the first word of a phrase of four starts with another pair, so it is counted by itself
        asked = materialise(self.between(reduce(DataFrame.union, self.quads), "bound", floors, size), "asked4")
        rests = _windows(self.texts, 3, [(0, 3, _bitmap(asked, _names(3, 2)))]).select(*[F.col(f"h{j}").alias(f"h{j + 1}") for j in (1, 2, 3)], F.col("a").alias("a234"))
        exact = _scored(asked.join(rests, _names(3, 2)), [("f1", "a234"), ("a12", "a34"), ("a123", "f4")])
        self.scored.append(materialise(exact.select("lang", F.array(*_names(4)).alias("keys"), "a", "l", "r", "score"), "scored4"))

    def survivors(self, floors: DataFrame, size: int) -> DataFrame:
        """Settled candidates that reach the floor of their language."""
        rows = reduce(DataFrame.union, self.settled + self.scored).withColumn("h1", F.col("keys")[0])
        return spread_lookup(rows, floors.select("lang", "floor"), "lang", size, F.col("h1")).filter("score >= floor").drop("floor", "h1")


def _next_floors(pairs: DataFrame, floors: DataFrame | None, expanded: int) -> DataFrame:
    """lang, floor, before: the bound (in steps of 100) of the pair that many places down; 0 where there are fewer pairs."""
    steps = pairs.groupBy("lang", (F.col("bound") / 100).cast("long").alias("step")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = steps.withColumn("many", F.sum("n").over(down))
    floor = F.coalesce(F.max(F.when(F.col("many") >= expanded, F.col("step") * 100)), F.lit(0))
    found = reached.groupBy("lang").agg(floor.alias("floor"))
    if floors is None:
        return found.withColumn("before", F.lit(SCALE).cast("long")).withColumn("done", F.lit(False))
    old = floors.select("lang", F.col("floor").alias("before"), "done")
    return found.join(old, "lang").withColumn("floor", F.when(F.col("done"), F.col("before")).otherwise(F.col("floor")))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, frontier: int = FRONTIER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best-scoring phrases of two to four words of each language.

    Texts (null: empty) are read with A-Z as a-z, cut into pieces at ``.,;:!?`` and line ends and then
    into words at blanks and tabs; a null language is ``und``. Candidates occur ``LEAST`` times or more; a
    candidate scores ``floor(SCALE * a / (l + r))`` at its lowest cut, and goes if a longer
    candidate around it has ``DROP`` percent of its occurrences. Ties: more occurrences, then the phrase in byte
    order. Repeated rows count as often as they stand there; an empty table and languages without candidates give no rows;
    other columns are left out, whatever their names. Words are told apart by 64-bit hashes. ``frontier`` pairs per
    language are expanded first; it changes the number of rounds, never the result.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(_count_words, "key long, lang string, word binary, n long")
    counted = counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("f")).filter((F.col("f") >= LEAST) | F.col("word").isNull())
    counted = materialise(counted.select("key", "lang", F.col("word").cast("string").alias("word"), "f"), "words")
    words, totals = counted.filter("word IS NOT NULL"), counted.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    known = _bitmap(words, ["key"])
    pairs = _windows(texts, 2, [(0, 1, known), (1, 1, known)])
    pairs = pairs.join(words.select(F.col("key").alias("h1"), "lang", F.col("f").alias("f1")), "h1")
    pairs = pairs.join(words.select(F.col("key").alias("h2"), F.col("f").alias("f2")), "h2")
    pairs = _scored(pairs.withColumn("bound", _bound()), [("f1", "f2")])
    growth = Growth(texts, words, materialise(pairs.select("lang", "h1", "h2", "a", "f1", "bound", "l", "r", "score"), "pairs"))

    floors, expanded = None, frontier
    while True:
        floors = materialise(_next_floors(growth.pairs, floors, expanded), "floors")
        size = floors.count() * 64
        growth.expand(floors, size)
        left = growth.survivors(floors, size)
        done = left.groupBy("lang").agg((F.count("*") >= top).alias("enough"))
        floors = floors.join(done, "lang", "left").select("lang", "floor", "before", (F.coalesce("enough", F.lit(False)) | (F.col("floor") == 0)).alias("done"))
        floors = materialise(floors, "floors")
        if floors.filter("NOT done").isEmpty():
            break
        expanded *= 4

    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    # ties at the end stay until their texts decide
    left = materialise(growth.survivors(floors, size).withColumn("place", F.rank().over(best)).filter(F.col("place") <= top), "best")
    named = left.select("*", F.posexplode("keys").alias("pos", "key")).join(words.select("key", "word"), "key")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "word")))
    named = named.groupBy("lang", "keys", "a", "l", "r", "score").agg(F.array_join(F.transform(in_order, lambda x: x["word"]), " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
