"""WARC archives: pages written as transactions, and transactions assembled from archives.

A page becomes three records: its request, its response or revisit, and its
metadata; the request and the metadata name the other in ``WARC-Concurrent-To``.
Spark's text writer stores them, so archives lie wherever Spark can write, one
gzip file per ``PER_FILE`` pages at most. Reading takes whole files apart as a
stream; records are then joined through their concurrent-to identifiers, in either
direction and over several steps, and each response, revisit or resource gets one
nested row with all that belongs to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.llm.texts import spread_lookup
from noticeboard.operators.common import first_per_key
from noticeboard.session import materialise

#: Payloads of at least so many bytes are stored once.
LEAST_REPEATED = 1000
PER_FILE = 4096
DATE = "2024-01-01T00:00:00Z"
#: Fixed names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = ("response", "revisit", "resource")
_END = "\r\n"
#: Bytes decompressed at once, and bytes of records handed on at once.
_PIECE, _BATCH = 1 << 20, 4 << 20

RECORD = (
    "archive string, offset long, record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, "
    "refers_to string, named_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


# -- writing --------------------------------------------------------------
def _uuid(role: str, row: Column) -> Column:
    """A record identifier that a repeated task makes again."""
    h = F.md5(F.concat(F.lit(f"{role}:"), row.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str | Column, record_id: Column, headers: dict[str, Column], content_type: str, block: Column) -> Column:
    """One record without the two line ends after it; headers that are null are left out."""
    head = {
        "WARC-Type": F.lit(kind) if isinstance(kind, str) else kind,
        "WARC-Record-ID": record_id,
        "WARC-Date": F.lit(DATE),
        **headers,
        "Content-Type": F.lit(content_type),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in head.items()]
    return F.concat(F.concat_ws(_END, F.lit(VERSION), *lines), F.lit(_END + _END), block)


def staged(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """row, key, url, payload, digest, bytes, and for repeated payloads the row to refer to; written once.

    Of rows with equal payloads of at least ``LEAST_REPEATED`` bytes, that with the largest key
    (nulls are smallest; of equal keys the last) is kept, ``refers`` names it on the others.
    """
    text = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    plain = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), text.alias("payload"))
    plain = plain.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    plain = materialise(plain, "pages")
    # copies are combined before the shuffle, so a page copied a million times costs one row per task
    held = plain.filter(F.col("bytes") >= LEAST_REPEATED).groupBy("digest").agg(F.max(F.struct("key", "row"))["row"].alias("kept"), F.count("*").alias("n"))
    held = materialise(held.filter("n > 1").select("digest", "kept"), "repeated-payloads")
    rows = spread_lookup(plain, held, "digest", held.count() * 64, F.col("row"))
    return rows.withColumn("refers", F.when(F.col("kept") != F.col("row"), F.col("kept"))).drop("kept")


def _transactions(rows: DataFrame) -> DataFrame:
    """All records of a row of :func:`staged`, as one text."""
    row, revisit = F.col("row"), F.col("refers").isNotNull()
    # line ends and other control characters must not end a header
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.coalesce(target, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    here = {"WARC-Target-URI": target}
    main = _uuid("capture", row)
    joined = here | {"WARC-Concurrent-To": main}
    request = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(_END + _END))
    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(_END + _END),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    fields = F.concat(F.lit("via: pages" + _END), F.coalesce(F.concat(F.lit("page-id: "), F.col("key").cast("string"), F.lit(_END)), F.lit("")))
    capture = here | {
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Profile": F.when(revisit, F.lit(PROFILE)),
        "WARC-Refers-To": F.when(revisit, _uuid("capture", F.col("refers"))),
    }
    records = [
        _record("request", _uuid("request", row), joined, "application/http; msgtype=request", request),
        _record(F.when(revisit, "revisit").otherwise("response"), main, capture, "application/http; msgtype=response", answer),
        _record("metadata", _uuid("metadata", row), joined, "application/warc-fields", fields),
    ]
    return rows.select(F.concat(F.concat_ws(_END + _END, *records), F.lit(_END)).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write request, response or revisit, and metadata records of every row to gzip archives below ``path``.

    A null payload is empty, a null url leaves out the target, a null key is not named;
    repeated rows are captures of their own. An empty table gives archives without records.
    Columns besides the three are not read, whatever their names.
    """
    out = _transactions(staged(pages, key, url, payload)).write.option("lineSep", _END).option("compression", "gzip")
    out.option("maxRecordsPerFile", PER_FILE).text(path)


# -- reading --------------------------------------------------------------
def _pieces(content: bytes) -> Iterator[bytes]:
    """The archive's bytes, decompressed if need be; gzip members follow each other."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + _PIECE] for i in range(0, len(content), _PIECE))
        return
    at, member = 0, zlib.decompressobj(31)
    left = b""
    while left or at < len(content):
        if not left:
            left, at = content[at : at + _PIECE], at + _PIECE
        try:
            piece = member.decompress(left, _PIECE)
        except zlib.error:
            return
        if piece:
            yield piece
        left = member.unconsumed_tail
        if member.eof:
            left, member = member.unused_data, zlib.decompressobj(31)
    piece = member.flush()
    if piece:
        yield piece


_HEADER = re.compile(rb"([^\s:][^:\r\n]*):[ \t]*([^\r\n]*)")


def _named(block: bytes) -> list[tuple[str, str]]:
    return [(k.decode("utf-8", "replace").strip().lower(), v.decode("utf-8", "replace").strip()) for k, v in _HEADER.findall(block)]


def read_records(content: bytes) -> Iterator[tuple[int, list[tuple[str, str]] | None, bytes]]:
    """(offset, headers, block) of an archive's records; headers are None where something cannot be read as one.

    What follows damage is searched for the next record.
    """
    buffer, offset, pieces = bytearray(), 0, _pieces(content)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    def drop(n: int) -> None:
        nonlocal offset
        del buffer[:n]
        offset += n

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            drop(len(buffer) - len(buffer.lstrip(b"\r\n")))
        if not buffer:
            return
        fill(5)
        end, length = -1, None
        if buffer[:5] == b"WARC/":
            while (end := buffer.find(b"\r\n\r\n")) < 0 and len(buffer) < _PIECE and fill(len(buffer) + 1):
                pass
            if end >= 0:
                headers = _named(bytes(buffer[:end]))
                length = dict(headers).get("content-length", "")
        if length is not None and length.isdecimal() and fill(end + 4 + int(length)):
            begin = end + 4
            yield offset, headers, bytes(memoryview(buffer)[begin : begin + int(length)])
            drop(begin + int(length))
            continue
        yield offset, None, b""
        drop(1)
        while (found := buffer.find(b"\nWARC/")) < 0:
            drop(max(0, len(buffer) - 5))
            if not fill(len(buffer) + 1):
                return
        drop(found + 1)


def _row(archive: str, offset: int, headers: list[tuple[str, str]] | None, block: bytes, with_payload: bool) -> dict:
    of = dict(headers or [])
    payload = block
    if of.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        payload = block[head + 4 :] if head >= 0 else b""
    kind = of.get("warc-type", "").lower() if headers is not None else "damaged"
    return {
        "archive": archive,
        "offset": offset,
        "record_id": of.get("warc-record-id") or f"{archive}#{offset}",
        "record_type": kind,
        "target_uri": of.get("warc-target-uri"),
        "date": of.get("warc-date"),
        "concurrent_to": [v for k, v in headers or [] if k == "warc-concurrent-to"],
        "refers_to": of.get("warc-refers-to"),
        "named_digest": of.get("warc-payload-digest"),
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha1(payload).hexdigest(),
        "fields": list(dict(_named(block)).items()) if of.get("content-type", "").startswith("application/warc-fields") else None,
        "payload": payload if with_payload else None,
    }


_TYPES = pa.schema(
    [
        *[(c, pa.int64() if c in ("offset", "payload_bytes") else pa.string()) for c in ("archive", "offset", "record_id", "record_type", "target_uri", "date")],
        ("concurrent_to", pa.list_(pa.string())),
        *[(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in ("refers_to", "named_digest", "payload_bytes", "payload_digest")],
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path``, one flat row each (columns of ``RECORD``).

    Archives may be plain or gzip (one member or one per record). What cannot be read as
    a record gives a row of type ``damaged``, and reading goes on at the next record.
    A record without identifier is named by its archive and offset. Length and SHA-1
    are of the record's own payload: a revisit has none. Without ``with_payload`` that column is null.
    """

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column(0)[i].as_py()
                for offset, headers, block in read_records(batch.column(1)[i].as_py()):
                    rows.append(_row(archive, offset, headers, block, with_payload))
                    size += 500 + len(block) * with_payload
                    if size > _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _TYPES)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TYPES)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(take_apart, RECORD)


# -- assembly -------------------------------------------------------------
def _owners(rows: DataFrame) -> DataFrame:
    """(record_id, capture) of requests and metadata that concurrent-to identifiers tie to a capture, directly or through others."""
    links = rows.select("record_id", F.explode("concurrent_to").alias("near"))
    links = links.union(links.select("near", "record_id")).distinct()
    known = rows.select("record_id", F.col("record_type").isin(*CAPTURED).alias("is_capture"))
    # only links whose far end is not a capture carry ownership on
    links = materialise(links.join(known.filter("NOT is_capture").select("record_id"), "record_id", "left_semi"), "links")
    reached = known.filter("is_capture").select(F.col("record_id").alias("near"), F.col("record_id").alias("capture"))
    owned = None
    while True:
        step = links.join(reached, "near").select("record_id", "capture").distinct()
        step = materialise(step if owned is None else step.join(owned, ["record_id", "capture"], "left_anti"), "owners")
        if owned is not None and step.isEmpty():
            return owned
        owned = step if owned is None else owned.union(step)
        # most archives need one step: all that has links is owned
        if links.join(owned, "record_id", "left_anti").isEmpty():
            return owned
        reached = step.select(F.col("record_id").alias("near"), "capture")


def captures(rows: DataFrame) -> DataFrame:
    """One nested row per response, revisit or resource: capture_id, record, requests, metadata.

    ``record`` holds the columns of :func:`records`; ``requests`` and ``metadata`` are arrays of
    (record_id, archive, offset, payload_digest, payload_bytes, fields) by record_id, empty if there are none.
    A record that belongs to several captures stands in each; requests and metadata without
    one, and damaged records, give no row. Of records with the same identifier the first by archive and offset
    counts. Captures have a handful of records each, so the arrays are small. An empty table gives no rows.
    Payloads take part in the shuffle only if they are selected afterwards.
    """
    rows = rows.filter(F.col("record_type").isin(*CAPTURED, "request", "metadata"))
    order = [F.col("archive"), F.col("offset")]
    narrow = materialise(first_per_key(rows.drop("payload"), ["record_id"], order), "records")
    part = F.struct("record_id", "archive", "offset", "payload_digest", "payload_bytes", "fields")
    others = narrow.join(_owners(narrow), "record_id").groupBy("capture").agg(
        *[F.collect_list(F.when(F.col("record_type") == kind, part)).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    )
    others = others.select("capture", *[F.array_sort(c, lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias(c) for c in ("requests", "metadata")])
    main = narrow.filter(F.col("record_type").isin(*CAPTURED))
    if "payload" in rows.columns:
        main = main.join(rows.select("archive", "offset", "payload"), ["archive", "offset"], "left")
    none = F.array().cast(narrow.select(F.array(part)).schema[0].dataType)
    joined = main.join(others, main.record_id == others.capture, "left")
    return joined.select(
        main.record_id.alias("capture_id"),
        F.struct(*[F.col(c) for c in main.columns]).alias("record"),
        *[F.coalesce(c, none).alias(c) for c in ("requests", "metadata")],
    )


def resolve(nested: DataFrame) -> DataFrame:
    """The captures with ``original``: record and metadata of the response that a revisit refers to, or null.

    ``original.record`` leaves out the payload, so that very many revisits of one response carry
    little; join by ``original.record.record_id`` to have it. Referred responses are sent to all tasks or,
    if they take more than a broadcast may, repeated under salts, since one may be revisited by any share of the rows.
    """
    wanted = nested.filter("record.record_type = 'revisit'").select(F.col("record.refers_to").alias("capture_id")).distinct()
    to = nested.filter("record.record_type = 'response'").join(wanted, "capture_id", "left_semi")
    original = F.struct(F.col("record").dropFields("payload").alias("record"), "metadata")
    to = materialise(to.select(F.col("capture_id").alias("refers"), original.alias("original")), "originals")
    size = to.agg(F.sum(F.length(F.to_json("original")) + 100)).first()[0] or 0
    rows = nested.withColumn("refers", F.when(F.col("record.record_type") == "revisit", F.col("record.refers_to")))
    return spread_lookup(rows, to, "refers", size, F.col("capture_id")).drop("refers")
