import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from cairn.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string, n_bytes long"
ROWS = [(i, f"http://a/{i}", t, None, None) for i, t in enumerate(["<p>é</p>", "<p>é</p>", None, "", "x" * 3_000_000, "x" * 3_000_000, "WARC/1.1\r\n\r\n", "<b>"])] + [(9, None, "<b>", "s", 1)]


def expected(rows):
    first = {}
    for r in sorted(rows):
        first.setdefault(r[2] or "", r[0])
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        lead = first[html or ""]
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page_id == lead else "revisit", None if page_id == lead else lead))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.page_records(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_chunks_rebuild_payloads(spark):
    folder, manifest = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA))
    parts = defaultdict(dict)
    for r in warc.read_archives(folder, manifest, chunk_bytes=100_000).collect():
        if r.record_type == "response":
            parts[r.page_id][r.chunk_no] = r
    for page_id, _, html, *_ in ROWS:
        if page_id in parts:
            rows = [parts[page_id][k] for k in range(len(parts[page_id]))]
            data = b"".join(bytes(r.data) for r in rows)
            assert data == (html or "").encode() and rows[-1].last and rows[-1].n_bytes == len(data)
            assert all(len(r.data) <= 100_000 for r in rows)


def test_file_begins_with_warcinfo_and_missing_chunks_are_told(spark):
    folder, manifest = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), chunk_bytes=1000)
    assert folder.startswith("file:/")
    for row in manifest.collect():
        with open(row.file, "rb") as f:
            head = gzip.decompress(f.read())
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and head.count(b"WARC-Type: re") >= row.records
    chunks = warc.read_archives(folder, manifest, chunk_bytes=1000)
    assert warc.whole_records(chunks).count() == len(ROWS)
    with pytest.raises(Exception, match="chunks are missing"):
        warc.whole_records(chunks.where("chunk_no <> 7")).collect()


def test_null_and_repeated_page_ids(spark):
    rows = [(1, "u", "a", None, None), (1, "u", "a", None, None), (None, "u", "a", None, None), (None, "u", "b", None, None), (1, "u", "b", None, None)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1, "response", None), (1, 1, "response", None), (None, 1, "revisit", 1), (None, 1, "revisit", 1), (1, 1, "response", None)], key=str)


def test_empty_table(spark):
    assert warc.page_records(spark.createDataFrame([], SCHEMA)).collect() == []
