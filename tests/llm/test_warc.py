"""Archives: round trips, foreign layouts, damage and assembly."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from noticeboard.llm import warc

PAGES = [
    (1, "https://a.example/x?y=1", "<html>" + "é" * 600 + "</html>"),
    (2, "https://a.example/y", "<html>" + "é" * 600 + "</html>"),
    (3, "http://b.example", "small"),
    (4, "http://b.example", "small"),
    (5, None, None),
    (6, "weird url\r\nWARC-Type: response", ""),
    (7, "https://c.example/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfake!\r\n\r\n" * 40),
    (8, "https://c.example/", "line\r\n\r\nline\n\x00\x01 tail \r\n\r\n"),
    (9, "https://d.example/", "b" * 999),
    (10, "https://d.example/", "b" * 999),
    (11, "https://d.example/", "c" * 1000),
    (12, "https://d.example/", "c" * 1000),
    (12, "https://d.example/", "c" * 1000),
    (None, "https://d.example/", "c" * 1000),
    (None, None, None),
    (13, "https://e.example/", "long " * 400_000),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("row", "key", "payload", "digest", "bytes", "kept", "refers", "_on", "_salt", "n")})


@pytest.fixture(scope="module")
def nested(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archives") / "a")
    warc.write_archives(frame(spark, PAGES).repartition(4), path)
    return warc.resolve(warc.captures(warc.records(spark, path))).cache()


def test_payloads_come_back(nested):
    rows = nested.collect()
    assert len(rows) == len(PAGES)
    stored, seen = {r.capture_id: r.record for r in rows}, []
    for r in rows:
        page = r.metadata[0].fields.get("page-id")
        own = stored[r.original.record.record_id] if r.record.record_type == "revisit" else r.record
        assert r.original is None or r.original.record.payload_digest == own.payload_digest
        assert r.record.named_digest == "sha1:" + own.payload_digest
        seen.append((page and int(page), bytes(own.payload)))
        assert len(r.requests) == len(r.metadata) == 1 and r.capture_id == r.record.record_id
    want = [(i, (html or "").encode()) for i, _, html in PAGES]
    assert sorted(seen, key=str) == sorted(want, key=str)


def test_largest_id_answers_and_the_rest_revisit(nested):
    rows = nested.select(
        F.col("metadata")[0]["fields"]["page-id"].alias("page"),
        F.col("record.record_type").alias("kind"),
        F.col("original.metadata")[0]["fields"]["page-id"].alias("to"),
        F.col("record.payload_bytes").alias("size"),
    ).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.page, []).append((r.kind, r.to))
        assert r.kind == "response" or r.size == 0
    assert kinds["1"] == [("revisit", "2")] and kinds["2"] == [("response", None)]
    assert all(kinds[str(k)] == [("response", None)] for k in (3, 4, 5, 6, 7, 8, 9, 10, 13))
    assert kinds["11"] == [("revisit", "12")] and sorted(kinds["12"], key=str) == [("response", None), ("revisit", "12")]
    assert sorted(kinds[None], key=str) == [("response", None), ("revisit", "12")]


def test_targets_cannot_break_headers(nested):
    targets = {r.record.target_uri for r in nested.select("record").collect()}
    assert "weird%20url%20%20WARC-Type:%20response" in targets and None in targets


def test_empty_table(spark, tmp_path):
    warc.write_archives(frame(spark, []), str(tmp_path / "none"))
    found = warc.records(spark, str(tmp_path / "none"))
    assert found.count() == 0
    assert warc.resolve(warc.captures(found)).count() == 0


def record(kind, name, block, *headers):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *headers, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def http(body):
    return b"HTTP/1.1 200 OK\r\n\r\n" + body


def test_foreign_layouts(spark, tmp_path):
    """Members of their own, links in either direction and over other records, strays, and a record of two captures."""
    answer = "Content-Type: application/http; msgtype=response"
    parts = [
        record("warcinfo", "<i>", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
        record("response", "<r1>", http(b"one"), answer, "WARC-Concurrent-To: <q1>"),
        record("metadata", "<m1>", b"k: v\r\nk2: w\r\n", "Content-Type: application/warc-fields", "WARC-Concurrent-To: <q1>"),
        record("metadata", "<m2>", b"", "WARC-Concurrent-To: <m1>"),
        record("resource", "<r2>", b"\x00\xff raw", "Content-Type: image/x"),
        record("metadata", "<m3>", b"", "WARC-Concurrent-To: <r2>", "warc-concurrent-to: <r1>"),
        record("metadata", "<m4>", b"", "WARC-Concurrent-To: <nowhere>"),
        record("request", "<q2>", b""),
        record("response", "<r1>", http(b"again"), answer),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    found = warc.records(spark, str(tmp_path / "in"))
    assert [r.record_type for r in found.orderBy("offset").collect()].count("metadata") == 4
    got = {r.capture_id: r for r in warc.captures(found).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    names = lambda x: [y.record_id for y in x]
    assert names(got["<r1>"].requests) == ["<q1>"] and names(got["<r1>"].metadata) == ["<m1>", "<m2>", "<m3>"]
    assert names(got["<r2>"].requests) == [] and names(got["<r2>"].metadata) == ["<m3>"]
    assert got["<r1>"].metadata[0].fields == {"k": "v", "k2": "w"}
    assert bytes(got["<r1>"].record.payload) == b"one" and bytes(got["<r2>"].record.payload) == b"\x00\xff raw"


def test_damage_costs_only_what_is_damaged(spark, tmp_path):
    good = [record("resource", f"<{i}>", b"x" * i) for i in range(5)]
    whole = good[0] + b"rubbish\r\n" + good[1] + good[2].replace(b"Content-Length: 2", b"Content-Length: x") + good[3] + good[4][:-10]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "p.warc").write_bytes(whole)
    (tmp_path / "plain" / "cut.warc.gz").write_bytes(gzip.compress(good[0]) + gzip.compress(good[1])[:-12])
    rows = warc.records(spark, str(tmp_path / "plain")).orderBy("archive", "offset").collect()
    kinds = [(r.archive.rsplit("/", 1)[1], r.record_id if r.record_type == "resource" else r.record_type) for r in rows]
    assert [k for f, k in kinds if f == "p.warc"] == ["<0>", "damaged", "<1>", "damaged", "<3>", "damaged"]
    assert kinds[0] == ("cut.warc.gz", "<0>")
    assert warc.captures(warc.records(spark, str(tmp_path / "plain"))).filter("capture_id LIKE '<%'").count() >= 3


def test_reader_spans_pieces(monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 512)
    blocks = [bytes([65 + i]) * (i * 700) for i in range(8)]
    whole = b"".join(record("resource", f"<{i}>", b) for i, b in enumerate(blocks))
    for content in (whole, gzip.compress(whole)):
        assert [b for _, h, b in warc.read_records(content)] == blocks
        offsets = [o for o, _, _ in warc.read_records(content)]
        assert all(whole[o : o + 5] == b"WARC/" for o in offsets)


def test_digests_are_of_the_payload(nested):
    for r in nested.filter("record.record_type = 'response'").select("record").collect():
        body = bytes(r.record.payload)
        assert (r.record.payload_bytes, r.record.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
