"""Dates of pictures, from the EXIF block of their files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the EXIF standard: when a picture was taken, when its file was made, where the first of them lies.
TAKEN, MADE, SUB_BLOCK = 36867, 306, 34665
#: Bytes of a file that may hold its EXIF block: a JPEG segment has at most 64 kB, and others may come first.
HEAD_BYTES = 1 << 18


def _block(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG or TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _tags(block: bytes, at: int, order: str) -> dict[int, bytes | int]:
    """Texts and whole numbers of one directory."""
    found = {}
    (n,) = struct.unpack_from(order + "H", block, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * k)
        place = at + 10 + 12 * k
        if kind == 2:
            place = place if count <= 4 else struct.unpack_from(order + "I", block, place)[0]
            found[tag] = block[place : place + count]
        elif kind == 4:
            found[tag] = struct.unpack_from(order + "I", block, place)[0]
    return found


def exif_datetime(data: bytes | None) -> str | None:
    """When a picture was taken, else when its file was made; None where neither is told or the block is broken."""
    block = _block(data or b"")
    if block is None:
        return None
    order = "<" if block[:2] == b"II" else ">"
    try:
        tags = _tags(block, struct.unpack_from(order + "I", block, 4)[0], order)
        if SUB_BLOCK in tags:
            tags = {MADE: tags.get(MADE)} | _tags(block, tags[SUB_BLOCK], order)
    except (struct.error, TypeError):
        return None
    raw = tags.get(TAKEN) or tags.get(MADE)
    return raw.rstrip(b"\0 ").decode("ascii", "replace") or None if isinstance(raw, bytes) else None


def _dated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"path": b.column("path"), "datetime_raw": pa.array([exif_datetime(x.as_py()) for x in b.column("head")], pa.string())})


def datetimes(spark: SparkSession, path: str) -> DataFrame:
    """path, datetime_raw and taken (a timestamp) of every picture under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD_BYTES).alias("head"))
    rows = files.mapInArrow(_dated, "path string, datetime_raw string")
    return rows.withColumn("taken", F.try_to_timestamp("datetime_raw", F.lit("yyyy:MM:dd HH:mm:ss")))
