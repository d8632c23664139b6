"""Exact duplicates by composable polynomial fingerprints.

A text is its UTF-8 bytes. Bytes are cut into chunks; each chunk has the value
sum(byte * base**(bytes after it)) modulo a prime, and two neighbours combine as
H(AB) = H(A) * base**len(B) + H(B). The chunks of a huge text become rows of their own,
are hashed wherever they are dealt, shifted by the bytes that follow them, and added
up (`chunk_prints`); a smaller text is hashed where it lies, chunk after chunk.
Texts of equal length and fingerprint are then compared chunk by chunk.

Defined cases: a null text counts as empty, empty texts equal one another, rows
that repeat a doc_id count as members of their group like any other row, a null
doc_id stays only where its group has no other, rows that share both the text and the
doc_id that stays are not told apart and all stay, an empty table gives no rows, other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import bit_filter
from cairn.session import cut

PRIME = (1 << 31) - 1
#: One base for each of the two lanes of a fingerprint.
BASES = (911_382_323, 972_663_749)
CHUNK_BYTES = 1 << 16
#: Bytes beyond which a text's chunks are hashed as rows of their own.
HUGE_BYTES = 8 << 20
#: Chunks that are handed on together.
CHUNKS_AT_ONCE = 16
PRINTS = "doc_id long, n_bytes long, fp long, text_sha256 string"


@lru_cache(maxsize=8)
def _powers(base: int, n: int = CHUNK_BYTES) -> np.ndarray:
    """base**(n-1) .. base**0 modulo PRIME."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(PRIME)])
        step = step * step % PRIME
    return out[:n][::-1].copy()


def hash_chunk(data: np.ndarray, bases: tuple[int, int] = BASES) -> tuple[int, int]:
    """Both lanes of at most CHUNK_BYTES bytes; sums stay below 2**55."""
    wide = data.astype(np.uint64)
    return tuple(int(np.dot(wide, _powers(b)[CHUNK_BYTES - len(wide) :]) % PRIME) for b in bases)


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int, bases: tuple[int, int] = BASES) -> tuple[int, int]:
    """The lanes of a text from those of its two parts."""
    return tuple((a * pow(base, right_bytes, PRIME) + b) % PRIME for a, b, base in zip(left, right, bases, strict=True))


def pack(lanes: tuple[int, int]) -> int:
    """Both lanes in one 62-bit number."""
    return lanes[0] << 31 | lanes[1]


def fingerprint(data: bytes | memoryview | np.ndarray, bases: tuple[int, int] = BASES) -> int:
    """The packed fingerprint of a whole text, one chunk in hand at a time."""
    raw = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
    total = (0, 0)
    for at in range(0, len(raw), CHUNK_BYTES):
        piece = raw[at : at + CHUNK_BYTES]
        total = combine(total, hash_chunk(piece, bases), len(piece), bases) if at else hash_chunk(piece, bases)
    return pack(total)


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value, as views on the column's buffer."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield raw[a:b]


def _described(bases: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, digests = [], [], []
            for raw in text_bytes(batch.column("text")):
                prints.append(fingerprint(raw, bases))
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "fp": pa.array(prints, pa.int64()), "text_sha256": pa.array(digests, pa.string())})

    return run


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each text, with the bytes after each; the first carries the text's digest."""
    step = CHUNK_BYTES * CHUNKS_AT_ONCE
    for batch in batches:
        for row, doc_id, raw in zip(batch.column("row"), batch.column("doc_id"), text_bytes(batch.column("text")), strict=True):
            digest = hashlib.sha256(raw).hexdigest()
            for at in range(0, len(raw), step):
                parts = [raw[k : k + CHUNK_BYTES] for k in range(at, min(at + step, len(raw)), CHUNK_BYTES)]
                after = [len(raw) - at - k * CHUNK_BYTES - len(p) for k, p in enumerate(parts)]
                same = lambda v, t: pa.array([v.as_py()] * len(parts), t)
                yield pa.RecordBatch.from_pydict(
                    {"row": same(row, pa.int64()), "doc_id": same(doc_id, pa.int64()), "after": pa.array(after, pa.int64()), "text_sha256": pa.array([None if at or k else digest for k in range(len(parts))], pa.string()), "data": pa.array([p.tobytes() for p in parts], pa.binary())}
                )


def _shifted(bases: tuple[int, int], names: list[str]):
    """Both lanes of each chunk, shifted by the bytes after it, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in b.column("data")]
            lanes = [combine(hash_chunk(p, bases), (0, 0), k, bases) for p, k in zip(parts, b.column("after").to_pylist(), strict=True)]
            made = {"n": pa.array([len(p) for p in parts], pa.int64()), "a": pa.array([x[0] for x in lanes], pa.int64()), "b": pa.array([x[1] for x in lanes], pa.int64())}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in names} | made)

    return run


def _added_up(rows: DataFrame, *keys: str, **more) -> DataFrame:
    lane = lambda c: F.sum(c) % F.lit(PRIME)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n_bytes"), (F.shiftleft(lane("a"), 31) + lane("b")).alias("fp"), *(c.alias(k) for k, c in more.items()))


def chunk_prints(rows: DataFrame, bases: tuple[int, int] = BASES) -> DataFrame:
    """PRINTS of (doc_id, text) rows whose chunks are dealt out and hashed apart."""
    chunks = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut_up, "row long, doc_id long, after long, text_sha256 string, data binary")
    hashed = chunks.repartition("row", "after").mapInArrow(_shifted(bases, ["row", "doc_id", "text_sha256"]), "row long, doc_id long, text_sha256 string, n long, a long, b long")
    return _added_up(hashed, "row", "doc_id", text_sha256=F.max("text_sha256")).select("doc_id", "n_bytes", "fp", "text_sha256")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", huge_bytes: int = HUGE_BYTES, bases: tuple[int, int] = BASES) -> DataFrame:
    """doc_id, n_bytes, fp, text_sha256 for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small = rows.where(F.octet_length("text") <= huge_bytes).mapInArrow(_described(bases), PRINTS)
    return small.unionByName(chunk_prints(rows.where(F.octet_length("text") > huge_bytes), bases))


def fingerprint_chunks(chunks: DataFrame) -> DataFrame:
    """Fingerprints of documents stored as (doc_id, chunk_no, data) rows of at most CHUNK_BYTES."""
    rows = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("long"), F.col("data").cast("binary"), F.octet_length("data").cast("long").alias("size"))
    later = Window.partitionBy("doc_id").orderBy(F.desc("chunk_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after", F.coalesce(F.sum("size").over(later), F.lit(0).cast("long")))
    return _added_up(rows.mapInArrow(_shifted(BASES, ["doc_id"]), "doc_id long, n long, a long, b long"), "doc_id")


def _members(words: np.ndarray, bases: tuple[int, int]):
    """n_bytes, fp, chunk_no, chunk of the texts that may be in a group, cut once and handed on some chunks at a time."""
    step = CHUNK_BYTES * CHUNKS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in text_bytes(batch.column("text")):
                fp = fingerprint(raw, bases)
                lanes = np.array([fp, fp & PRIME], np.int64) << [2, 33]  # both begin with the leading bits of a lane
                if not bit_filter.maybe(words, lanes[:1], lanes[1:])[0]:
                    continue
                for at in range(0, max(1, len(raw)), step):
                    parts = [raw[k : k + CHUNK_BYTES].tobytes() for k in range(at, max(1, min(at + step, len(raw))), CHUNK_BYTES)]
                    first = at // CHUNK_BYTES
                    yield pa.RecordBatch.from_pydict({"n_bytes": pa.array([len(raw)] * len(parts), pa.int64()), "fp": pa.array([fp] * len(parts), pa.int64()), "chunk_no": pa.array(range(first, first + len(parts)), pa.int32()), "chunk": pa.array(parts, pa.binary())})

    return run


def unequal_groups(docs: DataFrame, groups: DataFrame, text: str = "text", bases: tuple[int, int] = BASES) -> DataFrame:
    """The (n_bytes, fp) of groups whose texts are not all identical.

    Members stream past in chunks: a group is identical when the least and the
    greatest value of each chunk agree, which needs one row a task and chunk,
    however many members there are. A filter of fixed size spares most other texts.
    """
    words = bit_filter.build(groups, F.shiftleft("fp", 2), F.shiftleft(F.col("fp").bitwiseAND(F.lit(PRIME)), 33))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_members(words, bases), "n_bytes long, fp long, chunk_no int, chunk binary")
    rows = rows.join(groups.select("n_bytes", "fp"), ["n_bytes", "fp"], "left_semi")
    sides = rows.groupBy("n_bytes", "fp", "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return sides.where("least <> most").select("n_bytes", "fp").distinct()


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", huge_bytes: int = HUGE_BYTES, bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays.
    """
    seen = cut(fingerprints(docs, text, doc_id, huge_bytes, bases), "fingerprints")
    key = ["n_bytes", "fp"]
    size = [F.count("*").alias("n"), F.max("doc_id").alias("keep")]
    groups = cut(seen.groupBy(*key).agg(*size).where("n > 1"), "groups")
    odd = cut(unequal_groups(docs, groups, text, bases), "unequal")
    if odd.take(1):  # different texts of one fingerprint: there the digest is part of the key
        apart = seen.join(odd, key, "left_semi").groupBy(*key, "text_sha256").agg(*size)
        groups = cut(groups.join(odd, key, "left_anti").withColumn("only", F.lit(None).cast("string")).unionByName(apart.withColumnRenamed("text_sha256", "only")), "groups")
    else:
        groups = groups.withColumn("only", F.lit(None).cast("string"))
    s, g = seen.alias("s"), groups.alias("g")
    same = (F.col("s.n_bytes") == F.col("g.n_bytes")) & (F.col("s.fp") == F.col("g.fp")) & (F.col("g.only").isNull() | (F.col("g.only") == F.col("s.text_sha256")))
    out = s.join(g, same, "left").select("s.doc_id", F.coalesce("g.keep", "s.doc_id").alias("keep_id"), F.coalesce("g.n", F.lit(1)).cast("long").alias("group_size"), "s.text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
