"""Bounded-space online packing of tokenised documents into windows of fixed size.

Every task reads its partition once. It keeps ``OPEN`` windows open, puts a piece
into the one it fills best, and when none has room fills the fullest with the
head of the piece and emits it. What is left open is merged in groups of ``FAN``
tasks, again by the same rule, until one group remains, so no step holds more
than ``FAN * OPEN`` windows. The last rest is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import hashing
from noticeboard.session import materialise

SIZE, OPEN, FAN, END = 1024, 16, 64, 0
#: Texts whose units a worker remembers at most, over batches.
REMEMBERED = 500_000
#: Bytes of text tokenised at once.
READ = 2 << 20

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
_PIECES = f"task long, {COLUMNS}"


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    A blank in front of anything but white space begins a pre-token, so texts are
    cut there and each distinct unit is tokenised once. Units are remembered by a
    64-bit hash. Texts with a blank before white space are tokenised whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units; those of one word go to the tokenizer many at once, a line break behind each."""
        out: list[np.ndarray | None] = [None] * len(units)
        words = [i for i, u in enumerate(units) if self.line is not None and (body := u.removeprefix(" ")).split() == [body]]
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            lines = ["\n".join(units[i] for i in part[k : k + 50]) + "\n" for k in range(0, len(part), 50)]
            ids = np.concatenate(self._whole(lines))
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(part):
                for i, a, b in zip(part, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._whole([units[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        found = self._units(units)
        size = np.array([len(x) for x in found], np.int64)
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, self.used) + (1 << 16), np.uint32)])
        self.ids[self.used : self.used + total] = np.concatenate(found)
        begin = self.used + np.cumsum(size) - size
        self.used += total
        order = np.argsort(every := np.append(self.hashes, hashes), kind="stable")
        self.hashes, self.begin, self.size = every[order], np.append(self.begin, begin)[order], np.append(self.size, size)[order]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, none for null and empty ones."""
        units = hashing.units(texts)
        odd = np.flatnonzero(units.odd)
        distinct, first, which = np.unique(units.hash, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self._forget()
        slot = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = slot < len(self.hashes)
        new[inside] = self.hashes[slot[inside]] != distinct[inside]
        if new.any():
            at = first[new]
            body = units.data.tobytes()
            self._learn(distinct[new], [body[a:b].decode() for a, b in zip(units.start[at].tolist(), units.end[at].tolist(), strict=True)])
            slot = np.searchsorted(self.hashes, distinct)
        size = self.size[slot][which] if len(which) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat((self.begin[slot][which] if len(which) else size) - (ends - size), size) + np.arange(total)].tobytes()
        cuts = 4 * np.append(0, ends)[units.first]
        out = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i, ids in zip(odd.tolist(), self._whole([texts[i].as_py() for i in odd.tolist()]), strict=True):
            out[i] = ids.tobytes()
        return out


@dataclass
class Piece:
    doc_id: int | None
    doc_tokens: int
    start: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.doc_tokens, self.start, self.ids[: 4 * at]), Piece(self.doc_id, self.doc_tokens, self.start + at, self.ids[4 * at :])


@dataclass
class Packer:
    """A fixed number of open windows; :meth:`add` returns those that a piece closed."""

    size: int = SIZE
    limit: int = OPEN
    open: list[list[Piece]] = field(default_factory=list)
    used: list[int] = field(default_factory=list)

    def _close(self, i: int) -> list[Piece]:
        self.used.pop(i)
        return self.open.pop(i)

    def add(self, piece: Piece) -> list[list[Piece]]:
        closed = []
        while len(piece) >= self.size:
            head, piece = piece.cut(self.size)
            closed.append([head])
        while len(piece):
            room = [(self.size - u, i) for i, u in enumerate(self.used) if self.size - u >= len(piece)]
            if room:
                i = min(room)[1]
                self.open[i].append(piece)
                self.used[i] += len(piece)
                if self.used[i] == self.size:
                    closed.append(self._close(i))
                break
            if len(self.open) < self.limit:
                self.open.append([piece])
                self.used.append(len(piece))
                break
            i = max(range(len(self.used)), key=lambda j: (self.used[j], -j))
            head, piece = piece.cut(self.size - self.used[i])
            self.open[i].append(head)
            closed.append(self._close(i))
        return closed

    def rest(self) -> list[list[Piece]]:
        """All open windows joined into full ones, and a last rest in windows of powers of two."""
        out, now, room = [], [], self.size
        for piece in [p for w in sorted(self.open, key=lambda w: -sum(map(len, w))) for p in w]:
            while len(piece):
                head, piece = piece.cut(min(room, len(piece)))
                now.append(head)
                room -= len(head)
                if not room:
                    out.append(now)
                    now, room = [], self.size
        left = self.size - room
        while left:
            need = 1 << (left.bit_length() - 1)
            left -= need
            part = []
            while need:
                head, tail = now[0].cut(min(need, len(now[0])))
                now[:1] = [tail] if len(tail) else []
                part.append(head)
                need -= len(head)
            out.append(part)
        self.open, self.used = [], []
        return out


def _rows(task: int, windows: Iterator[tuple[int | None, list[Piece]]]) -> pa.RecordBatch | None:
    """Pieces of (sequence or None, window) as rows."""
    flat = []
    for sequence, window in windows:
        offset = 0
        for p in window:
            flat.append((p, sequence, offset))
            offset += len(p)
    if not flat:
        return None
    ids = np.frombuffer(b"".join(p.ids for p, _, _ in flat), np.int32)
    length = np.array([len(p) for p, _, _ in flat], np.int64)
    columns = {
        "task": pa.array([task] * len(flat), pa.int64()),
        "doc_id": pa.array([p.doc_id for p, _, _ in flat], pa.int64()),
        "start": pa.array([p.start for p, _, _ in flat], pa.int64()),
        "length": pa.array(length),
        "ids_crc32": pa.array([zlib.crc32(p.ids) for p, _, _ in flat], pa.int64()),
        "doc_tokens": pa.array([p.doc_tokens for p, _, _ in flat], pa.int64()),
        "sequence_id": pa.array([s for _, s, _ in flat], pa.int64()),
        "offset": pa.array([o for _, _, o in flat], pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids)),
    }
    return pa.RecordBatch.from_pydict(columns)


_encoders: dict[str, Encoder] = {}


def _pack_partition(path: str, size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        task = TaskContext.get().partitionId()
        packer, sequence = Packer(size, limit), task << 32
        for batch in batches:
            for at, part in hashing.slices(batch.column(1), READ):
                closed = []
                coded = encoder.encode(part)
                for doc_id, ids in zip(batch.column(0).slice(at, len(part)).to_pylist(), coded, strict=True):
                    ids += np.uint32(END).tobytes()
                    for window in packer.add(Piece(doc_id, len(ids) // 4, 0, ids)):
                        closed.append((sequence, window))
                        sequence += 1
                if (rows := _rows(task, closed)) is not None:
                    yield rows
        if (rows := _rows(task, [(None, w) for w in packer.open])) is not None:
            yield rows
        pa.default_memory_pool().release_unused()

    return run


def _merge(level: int, last: bool, size: int, limit: int):
    """Pack the open windows of one group of tasks; the last level leaves none open."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        group = table["group"][0].as_py()
        packer, done, sequence = Packer(size, limit), [], (level << 56) + (group << 32)
        for r in table.select(["doc_id", "doc_tokens", "start", "ids"]).to_pylist():
            done += packer.add(Piece(r["doc_id"], r["doc_tokens"], r["start"], np.array(r["ids"], np.uint32).tobytes()))
        open_ = [(None, w) for w in packer.open]
        if last:
            done, open_ = done + packer.rest(), []
        rows = _rows(group, [*((sequence + i, w) for i, w in enumerate(done)), *open_])
        return pa.Table.from_batches([rows])

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, limit: int = OPEN) -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``size`` tokens, with their ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.
    Every document ends with id 0, so null and empty texts are one token long.
    Null and repeated ids are carried along; rows are packed one by one. An empty
    table gives no rows. The tokenizer file must be on every executor. The result
    reads a written table, so pieces stay the same when tasks are repeated.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    packed = materialise(rows.mapInArrow(_pack_partition(tokenizer, size, limit), _PIECES), "packed")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    done = packed.filter("sequence_id IS NOT NULL").select(*names)
    tasks, level = (packed.agg(F.max("task")).first()[0] or 0) + 1, 0
    while True:
        level += 1
        last = tasks <= FAN
        left = packed.filter("sequence_id IS NULL").withColumn("group", F.floor(F.col("task") / FAN).cast("long"))
        packed = materialise(left.groupBy("group").applyInArrow(_merge(level, last, size, limit), _PIECES), "merged")
        done = done.union(packed.filter("sequence_id IS NOT NULL").select(*names))
        if last:
            return done
        tasks = -(-tasks // FAN)
