import hashlib
from collections import defaultdict

from cairn.llm import exact_dedup as x
from tests.llm.rows import awkward, documents


def test_fingerprints_compose():
    data = bytes(range(256)) * 700
    whole = x.fingerprint(data)
    for k in (1, 1000, 65536, 100_000):
        parts = [x.fingerprint(p) for p in (data[:k], data[k:])]
        lanes = [(p >> 31, p & x.PRIME) for p in parts]
        assert x.pack(x.combine(*lanes, len(data) - k)) == whole


def test_chunk_table_gives_the_same_fingerprint(spark):
    data = ("é" * 90_000).encode()
    chunks = [(1, i, bytearray(data[k : k + 50_000])) for i, k in enumerate(range(0, len(data), 50_000))]
    got = x.fingerprint_chunks(spark.createDataFrame(chunks, "doc_id long, chunk_no int, data binary")).collect()
    assert [(r.n_bytes, r.fp) for r in got] == [(len(data), x.fingerprint(data))]


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return sorted((r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), r[0] == max(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def test_awkward_rows(spark):
    assert sorted(map(tuple, x.exact_dedup(documents(spark)).collect())) == expected(awkward())


def test_empty_table(spark):
    assert x.exact_dedup(documents(spark, [])).collect() == []


def test_equal_fingerprints_of_different_texts_are_told_apart(spark):
    rows = [(1, "ab", *[None] * 6), (2, "ba", *[None] * 6), (3, "ab", *[None] * 6), (4, "ab" * 70_000, *[None] * 6), (5, "ba" * 70_000, *[None] * 6)]
    for huge in (x.HUGE_BYTES, 10):
        got = x.exact_dedup(documents(spark, rows), huge_bytes=huge, bases=(1, 1)).collect()  # sums of bytes
        assert sorted(map(tuple, got)) == expected(rows)


def test_huge_texts_by_chunks(spark):
    rows = awkward() + [(2000, "é" * 3_000_000, *[None] * 6), (2001, "é" * 3_000_000, *[None] * 6), (2002, "é" * 2_999_999 + "ee", *[None] * 6)]
    docs = documents(spark, rows)
    whole, dealt = (sorted(map(tuple, x.fingerprints(docs, huge_bytes=n).collect()), key=str) for n in (x.HUGE_BYTES, 20))
    assert whole == dealt
    assert sorted(map(tuple, x.exact_dedup(docs, huge_bytes=20).collect())) == expected(rows)


def test_null_id(spark):
    rows = [(None, "a", *[None] * 6), (3, "a", *[None] * 6), (None, "b", *[None] * 6)]
    got = {(r.text_sha256[:4], r.doc_id): (r.keep_id, r.group_size, r.kept) for r in x.exact_dedup(documents(spark, rows)).collect()}
    assert sorted(map(str, got.values())) == sorted(map(str, [(3, 2, False), (3, 2, True), (None, 1, True)]))
