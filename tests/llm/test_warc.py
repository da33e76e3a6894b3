"""WARC: exact round trip of payloads through the archives, and awkward rows."""

import base64
import hashlib
import zlib

import pytest

from bramble.llm import warc
from bramble.llm.queries import QUERIES

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "ü", "é" * 20_000), (7, "u", "x" * 3_000_000), (8, "u", "é" * 20_000), (8, "u", "é" * 20_000), (None, "u", "<p>one</p>"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, digest string, bytes int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = sorted(QUERIES["op6_warc"](spark, str(tmp_path)).collect(), key=str)
    first = {}
    for i, _, t in ROWS:
        first[t or ""] = max(first.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t in ROWS:
        t = t or ""
        revisit = i is not None and i != first[t]
        want.append((i, len(t.encode()), digest(t), "revisit" if revisit else "response", first[t] if revisit else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    warc.write_archives(pages, f"{tmp_path}/archives")
    captures = warc.assemble(warc.read_records(spark, f"{tmp_path}/archives")).collect()
    assert len(captures) == len(ROWS) and all(c.request and c.metadata for c in captures)
    bodies = {c.metadata.fields["page-id"]: c.response.payload for c in captures if c.response.type == "response"}
    assert bytes(bodies["5"]) == ROWS[4][2].encode() and bytes(bodies["4"]) == b"" and bytes(bodies["8"]) == ROWS[7][2].encode()


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/a", least_bytes=3)
    got = {c.metadata.fields["page-id"]: c.response.type for c in warc.assemble(warc.read_records(spark, f"{tmp_path}/a")).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_members_and_plain_text(spark, tmp_path):
    """Archives gzipped by record or by file, or not at all; blocks that hold what records begin with; other record types."""
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0 WARC/1.WARC/1.1\r\n\xff\xfe"
    tricky = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <t>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    pack = lambda b: (z := zlib.compressobj(wbits=31)).compress(b) + z.flush()
    for i, (name, data) in enumerate([("a.warc", record + tricky + record), ("b.warc.gz", pack(record) + pack(tricky) + pack(record)), ("c.warc.gz", pack(record + tricky + record))]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / name).write_bytes(data)
        rows = warc.read_records(spark, str(folder)).collect()
        assert [r.record_id for r in rows] == ["<r>", "<t>", "<r>"]
        assert bytes(rows[1].payload) == body.partition(b"\r\n\r\n")[2] and rows[1].payload_bytes == len(body) - 19


def test_pieces():
    record = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nxWARC/1.y\r\n\r\n"
    assert [b for _, b in warc.parse_records((record * 2).split(b"WARC/1."))] == [b"xWARC/1.y"] * 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.parse_records(record[:-8].split(b"WARC/1.")))


def test_revisits_name_their_response(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, bytes int"), f"{tmp_path}/a")
    captures = warc.assemble(warc.read_records(spark, f"{tmp_path}/a")).collect()
    by_id = {c.response.record_id: c for c in captures}
    assert len(by_id) == len(ROWS)
    for c in captures:
        if c.response.type == "revisit":
            target = by_id[c.response.refers_to]
            assert target.response.type == "response" and target.response.digest == c.response.digest and target.response.payload_bytes == c.response.payload_bytes
        else:
            assert c.response.refers_to is None


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op6_warc"](spark, str(tmp_path)).count() == 0
