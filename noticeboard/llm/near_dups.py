"""Near duplicates by an inverted join over MinHash signature coordinates.

Documents with equal shingle sets are folded first. Each remaining one is posted
under its (coordinate, value) pairs. Two documents whose similarity is 0.75 share
48 of 64 pairs on average, and fewer than 30 about once in ten million times; so
only documents with at least ``MATCHES`` pairs that anybody else has are kept, and
of those pairs, from rare to frequent, all but the last ``MATCHES - 1`` are posted
(two documents with that many pairs in common share one of the posted ones).

Groups of copies are not expanded into pairs. Every posting list is first held
against its most central document, then against its first one, and only
documents of one list that are still in different components are paired: those
that what they share with the central one may link, and those that share a
shingle it does not have. Both kinds meet on prefixes: two sets that must have t
shingles in common share one of the rarest, all but t - 1 of each. Candidates with
enough equal coordinates are confirmed on their full sets.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import hashing
from noticeboard.llm.texts import BROADCAST_BYTES
from noticeboard.operators.common import first_per_key
from noticeboard.session import materialise

SHINGLE, COORDINATES, MATCHES = 5, 64, 30
SIMILAR = 75  # percent
#: Members of one hub that one task holds against it.
CHUNK = 256
#: Bits that the shingles outside a hub are folded into.
SKETCH = 512

_factors = np.random.default_rng(7).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash coordinates of non-empty sets, one row each."""
    every = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(every * a, begins) for a in _factors], axis=1).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at, part in hashing.slices(texts):
            sets = list(hashing.shingle_sets(part, SHINGLE))
            full = [s for s in sets if len(s)]
            coordinates = iter(signature(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(coordinates) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "fingerprint", "signature"],
            )


def features(docs: DataFrame) -> DataFrame:
    """Set size, fingerprint of the set and MinHash signature of (doc_id, text) rows; null for empty sets."""
    return docs.mapInArrow(_features, "doc_id long, n_shingles long, fingerprint binary, signature array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) can reach.

    Alternating stars: every node hands its neighbours to the smallest one it
    sees, until nothing changes. Rounds grow with the logarithm of the longest
    chain; every round is a written table.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(hub, id, set of the hub, own set) of members; rows come sorted by (hub, chunk) with the hub first."""
    held = np.zeros(0, np.uint64)
    for batch in batches:
        hubs, ids, member = (batch.column(i).to_pylist() for i in (0, 1, 2))
        for hub, doc, own, is_member in zip(hubs, ids, hashing.shingle_sets(batch.column(3), SHINGLE), member, strict=True):
            if is_member:
                yield hub, doc, held, own
            else:
                held = own


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ((a, b, len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for a, b, x, y in _against_hub(batches))
    for rows in iter(lambda: list(itertools.islice(found, 10_000)), []):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([100 * r[2] >= SIMILAR * (r[3] - r[2]) for r in rows], pa.bool_()),
            ],
            ["a", "b", "common", "linked"],
        )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, b, x, y in _against_hub(batches):
        rest = np.setdiff1d(y, x, assume_unique=True).view(np.int64)
        bits = np.zeros(-(-len(x) // 64) * 64, bool)
        bits[: len(x)] = np.isin(x, y, assume_unique=True)
        # members mostly outside the hub are not linked by what they share with it
        places = np.flatnonzero(bits) if 100 * (len(y) - len(rest)) >= SIMILAR * len(y) else []
        inside = np.packbits(bits).view(np.int64)
        bits = np.zeros(SKETCH, bool)
        bits[rest.view(np.uint64) % np.uint64(SKETCH)] = True
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (rest, places, inside, np.packbits(bits).view(np.int64))]
        numbers = [pa.array([v], pa.int64()) for v in (a, b, len(rest) - int(bits.sum()))]
        yield pa.RecordBatch.from_arrays(numbers + lists, ["hub", "rep", "crowded", "outside", "places", "inside", "sketch"])


def _rows_by_hub(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of pairs (a, b) as (a, id, member, text), each group of ``CHUNK`` partners behind its ``a``.

    Each partner is read once, and no task holds more than one set besides the row at hand.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("id"), F.lit(True).alias("member"))
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("id"), F.lit(False).alias("member"))
    wanted = materialise(members.union(hubs), "wanted")
    if wanted.count() * 40 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").repartition("a", "chunk")
    return rows.sortWithinPartitions("a", "chunk", "member").select("a", "id", "member", "text")


def measure(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, common, linked) for pairs (a, b): what their full shingle sets share and whether they are similar enough."""
    return materialise(_rows_by_hub(pairs, docs).mapInArrow(_overlaps, "a long, b long, common long, linked boolean"), "measured")


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs with at least ``MATCHES`` equal coordinates."""
    left = sets.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.join(left, "a").join(right, "b").filter(equal >= MATCHES).select("a", "b")


def _sizes_fit(x: str, y: str):
    return 100 * F.least(x, y) >= SIMILAR * F.greatest(x, y)


def _rarest(parts: DataFrame, column: str, needed: Column) -> DataFrame:
    """(hub, rep, shingle) of the shingles in ``column`` that two members of a hub must meet on.

    Shingles of one component alone are left out. Two members that share at least
    ``needed`` (and one) of the others share one of the rarest, all but ``needed`` - 1 of each.
    """
    each = parts.select("hub", "rep", "component", F.greatest(needed, F.lit(1)).cast("int").alias("needed"), F.explode(column).alias("shingle"))
    held = each.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    own = each.join(held.select("hub", "shingle", "held"), ["hub", "shingle"]).groupBy("hub", "rep")
    own = own.agg(F.first("needed").alias("needed"), F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own")).filter("size(own) >= needed")
    first = F.slice("own", F.lit(1), F.size("own") - F.col("needed") + 1)
    return own.select("hub", "rep", F.explode(F.transform(first, lambda x: x["shingle"])).alias("shingle"))


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component) of the sets that are linked to any other; ``sets``: (rep, n, signature)."""
    # sets of one or two shingles reach 0.75 with no other set
    posted = sets.filter("n > 2").select("rep", "n", F.explode("signature").alias("key"))
    shared = posted.join(posted.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "key")
    rare = F.sort_array(F.collect_list(F.struct("held", "key")))
    per_set = shared.groupBy("rep").agg(F.first("n").alias("n"), F.sum("held").alias("weight"), rare.alias("keys"))
    per_set = per_set.filter(F.size("keys") >= MATCHES)
    first = F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - 1))
    prefix = materialise(per_set.select("rep", "n", "weight", F.explode(F.transform(first, lambda x: x["key"])).alias("key")), "prefixes")

    def in_components(known: DataFrame | None) -> DataFrame:
        """Posting lists that hold two components or more, with the component of each entry."""
        if known is None:
            return prefix.withColumn("component", F.col("rep"))
        named = prefix.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        return named.join(mixed.select("key"), "key")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("h.rep").alias("a"), F.col("rep").alias("b")).distinct()

    def candidates(pairs: DataFrame) -> DataFrame:
        return materialise(_similar_pairs(ends(pairs), sets), "candidates")

    other = F.col("component") != F.col("h.component")
    lists = in_components(None)
    central = lists.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"), "rep", "n", "component")).alias("h"))
    central = materialise(central, "hubs")
    measured = measure(materialise(ends(lists.join(central, "key").filter(other)), "held"), docs)
    edges = measured.filter("linked").select("a", "b")
    lists = in_components(materialise(components(edges), "components"))
    earliest = lists.groupBy("key").agg(F.min(F.struct("rep", "n", "component")).alias("h"))
    edges = edges.union(measure(candidates(lists.join(earliest, "key").filter(other & _sizes_fit("n", "h.n"))), docs).filter("linked").select("a", "b"))
    lists = in_components(materialise(components(edges), "components"))
    # What two sets share is what both share with the hub of their list, which bit masks tell, and what they share outside it.
    hubs = central.select("key", F.col("h.rep").alias("hub"))
    shares = measured.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "common")
    family = lists.join(hubs, "key").join(shares, ["hub", "rep"]).select("hub", "rep", "n", "component", "common").distinct()
    family = materialise(family, "families")
    parts = _rows_by_hub(family.select(F.col("hub").alias("a"), F.col("rep").alias("b")), docs)
    parts = parts.mapInArrow(_parts, "hub long, rep long, crowded long, outside array<long>, places array<long>, inside array<long>, sketch array<long>")
    parts = materialise(parts.join(family, ["hub", "rep"]), "parts")
    entry = F.struct("rep", "n", "component", "common", "crowded", "inside", "sketch").alias("h")
    family = parts.drop("outside", "places")
    needed = F.ceil(SIMILAR * F.col("n") / 100)
    # overlaps inside the hub that link alone, and what must be shared outside it besides
    posted_places = materialise(_rarest(parts, "places", needed).join(family, ["hub", "rep"]), "inside")
    rest = materialise(_rarest(parts, "outside", needed - F.col("common")).join(family, ["hub", "rep"]), "outside")
    apart = other & (F.col("rep") < F.col("h.rep")) & _sizes_fit("n", "h.n")
    enough = lambda shared: 100 * shared >= SIMILAR * (F.col("n") + F.col("h.n") - shared)
    outside = F.least(F.col("n") - F.col("common"), F.col("h.n") - F.col("h.common"))
    bits = lambda c: F.aggregate(F.zip_with(c, f"h.{c}", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    both = bits("inside")
    # shared shingles share a bit, and those beyond one a bit are crowded in both
    fewer = F.least(outside, bits("sketch") + F.least("crowded", "h.crowded"))
    roughly, least = F.least("common", "h.common"), enough(both)
    by_hub = posted_places.join(posted_places.select("hub", "shingle", entry), ["hub", "shingle"]).filter(apart & F.when(enough(roughly), least).otherwise(False))
    met = rest.join(rest.select("hub", "shingle", entry), ["hub", "shingle"])
    by_rest = met.filter(apart & F.when(enough(roughly + outside), enough(both + fewer)).otherwise(False))
    pairs = candidates(by_hub.select("rep", "h").union(by_rest.select("rep", "h")))
    edges = edges.union(measure(pairs, docs).filter("linked").select("a", "b"))
    return materialise(components(edges), "components")


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per distinct id.

    ``component_id`` is the smallest id in the document's component and ``kept``
    marks that document. Empty and null texts have no shingles and are linked with
    nothing. Rows that repeat an id count as one document, read as the one whose
    text has the smallest digest. Rows with a null id are not compared: each has a
    row of its own without a component, and is kept. Empty tables give no rows.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = docs.filter("doc_id IS NOT NULL")
    found = materialise(features(known), "signatures")
    if found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        known = materialise(first_per_key(known, ["doc_id"], [F.md5(F.coalesce("text", F.lit("")).cast("binary"))]), "distinct")
        found = materialise(features(known), "signatures")
    classes = materialise(found.filter("n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    sets = found.join(classes.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "signature")
    linked = links(known, materialise(sets, "sets"))
    out = found.drop("signature").join(classes, "fingerprint", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    unnamed = features(docs.filter("doc_id IS NULL")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(unnamed)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays, columns unchanged.

    Of rows that repeat an id one stays; rows with a null id all stay. Extra columns may have any names.
    """
    judged = materialise(classify(docs, key, text), "judged")
    kept = judged.filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"))
    if kept.count() * 16 <= BROADCAST_BYTES:
        kept = F.broadcast(kept)
    # the given row travels as one column, so that its names cannot meet those used here
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(f"`{key}`").alias("key"))
    named = given.filter("key IS NOT NULL")
    out = named.join(kept, F.col("key") == F.col("kept_id")).select("given", "key")
    rows = named.agg(F.count(F.lit(1))).first()[0]
    if rows > judged.filter("doc_id IS NOT NULL").count():
        out = first_per_key(out, ["key"], [F.md5(F.coalesce(F.col("given")[text], F.lit("")).cast("binary"))])
    return out.union(given.filter("key IS NULL")).select("given.*")
