"""Binary PLY point clouds as a Spark data source.

Reading: the header is parsed once on the driver and gives the schema; records have a
fixed width, so the body is dealt out as byte ranges and decoded to Arrow batches.
Writing: tasks write their records to part files beside the target, and the commit
puts the header with the true number of records and the parts, in task order, into
one file; parts of lost attempts are not in the commit's messages.

With raw=true a row is point_id and the record's own bytes; written with
like=<source file> under that file's format and properties, records stay as they are,
byte for byte. A path without a scheme is a local one here; `cairn.session.qualified`
gives a path the scheme that Hadoop would.

    spark.dataSource.register(PlySource)
    spark.read.format("ply").load(path)
    df.write.format("ply").mode("overwrite").save(path)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

#: Fixed values of the format: scalar names and their widths.
SCALARS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
SPARK = {"i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "f4": FloatType(), "f8": DoubleType()}
WIDER = {"u1": "i2", "u2": "i4", "u4": "i8"}
COLOURS = {"red": "r", "green": "g", "blue": "b"}
BATCH = 1 << 16


@dataclass(frozen=True)
class Header:
    """What a PLY header says about its vertices."""

    order: str
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    count: int
    length: int
    properties: tuple[str, ...] = ()

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, self.order + k) for n, k in zip(self.names, self.kinds, strict=True)])

    def has(self, *names: str) -> bool:
        return all(n in self.names for n in names)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + __import__("os").path.abspath(path))


def read_header(path: str) -> Header:
    """Parse a header; ascii bodies, list properties and missing coordinates are errors."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        head = b""
        while b"end_header" not in head or not head.split(b"end_header", 1)[1].count(b"\n"):
            got = f.read(4096)
            if not got:
                raise ValueError(f"{path} has no PLY header")
            head += got
    text, _, rest = head.partition(b"end_header")
    length = len(text) + len(b"end_header") + rest.index(b"\n") + 1
    lines = [x.split() for x in text.decode("ascii").replace("\r", "").split("\n") if x.strip()]
    if lines[0] != ["ply"]:
        raise ValueError(f"{path} is not a PLY file")
    order, element, count, names, kinds, properties = None, None, 0, [], [], []
    for words in lines[1:]:
        if words[0] == "format":
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1])
            if order is None:
                raise ValueError(f"PLY format {words[1]} is not binary")
        elif words[0] == "element":
            if element is None and words[1] != "vertex":
                raise ValueError("the vertex element must come first")
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[0] == "property" and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties of vertices cannot be read")
            if words[1] not in SCALARS:
                raise ValueError(f"unknown PLY type {words[1]}")
            kinds.append(SCALARS[words[1]])
            properties.append(" ".join(words))
            names.append(words[2])
    if order is None or not {"x", "y", "z"} <= set(names):
        raise ValueError("a PLY cloud needs a binary format and x, y, z")
    return Header(order, tuple(names), tuple(kinds), count, length, tuple(properties))


def fields(header: Header, extras: bool) -> list[tuple[str, str, str]]:
    """(column, property, kind) in the order of the schema."""
    out = [(a, a, "f8") for a in "xyz"]
    if header.has(*COLOURS):
        out += [(c, n, "f8") for n, c in COLOURS.items()]
    if header.has("nx", "ny", "nz"):
        out += [(n, n, "f8") for n in ("nx", "ny", "nz")]
    used = {n for _, n, _ in out}
    if extras:
        out += [(n, n, k) for n, k in zip(header.names, header.kinds, strict=True) if n not in used]
    return out


def seeded_places(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each of 0 .. n - 1 in an order that a seed sets: a permutation, so any task knows it for any record.

    Rounds that swap and mix the halves of a number permute the next power of four; numbers
    that leave 0 .. n - 1 go through again until they are back.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 64, 6, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & low
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & low)
        return (left << half) | right

    out = once(ids.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass
class _Range(InputPartition):
    first: int
    count: int


class PlyReader(DataSourceReader):
    """Reads records first .. first + count - 1 of each range; of a sample only those whose seeded place is below it, exactly as many in all."""

    def __init__(self, path: str, extras: bool, records: int, raw: bool = False, sample: int | None = None, seed: int = 1):
        self.path, self.extras, self.records, self.raw, self.sample, self.seed = path, extras, records, raw, sample, seed
        self.header = read_header(path)
        store, at = opened(path)
        size = store.get_file_info(at).size
        if size < self.header.length + self.header.count * self.header.dtype.itemsize:
            raise ValueError(f"{path} ends before its {self.header.count} vertices do")

    def partitions(self):
        n, step = self.header.count, self.records
        return [_Range(k, min(step, n - k)) for k in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        dtype, made = self.header.dtype, fields(self.header, self.extras)
        store, at = opened(self.path)
        with store.open_input_file(at) as f:
            for k in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - k)
                f.seek(self.header.length + k * dtype.itemsize)
                data, ids = f.read(n * dtype.itemsize), np.arange(k, k + n)
                if self.sample is not None and self.sample < self.header.count:
                    own = np.flatnonzero(seeded_places(ids, self.header.count, self.seed) < self.sample)
                    data, ids, n = np.frombuffer(data, f"V{dtype.itemsize}")[own].tobytes(), ids[own], len(own)
                if self.raw:
                    edges = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(dtype.itemsize))
                    records = pa.Array.from_buffers(pa.binary(), n, [None, edges, pa.py_buffer(data)])
                    yield pa.RecordBatch.from_pydict({"point_id": pa.array(ids), "record": records})
                    continue
                rows = np.frombuffer(data, dtype)
                columns = {"point_id": pa.array(ids)}
                for column, name, kind in made:
                    values = rows[name]
                    if column in COLOURS.values():
                        values = values / 255.0
                    columns[column] = pa.array(values.astype(WIDER.get(kind, kind)))
                yield pa.RecordBatch.from_pydict(columns)


def _joined(records: pa.Array, size: int) -> bytes:
    """The bytes of records one after another."""
    edges = np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records) + 1]
    if (np.diff(edges) != size).any():
        raise ValueError(f"a record has {size} bytes")
    return records.buffers()[2][int(edges[0]) : int(edges[-1])].to_pybytes() if len(records) else b""


@dataclass
class _Part(WriterCommitMessage):
    path: str
    records: int


class PlyWriter(DataSourceArrowWriter):
    """Doubles for coordinates and normals, bytes for colours, whatever else as it is; or records like another file's."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, like: str | None = None):
        self.path, self.overwrite, self.columns = path, overwrite, []
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        store, at = opened(path)
        if not overwrite and store.get_file_info(at).type != pafs.FileType.NotFound:
            raise ValueError(f"{path} exists")
        self.like = None if like is None else read_header(like)
        if self.like is not None:
            if schema["record"].dataType != BinaryType():
                raise ValueError("records are bytes")
            return
        names = [f.name for f in schema.fields if f.name != "point_id"]
        back = {v: k for k, v in COLOURS.items()}
        kinds = {ByteType(): "i1", ShortType(): "i2", IntegerType(): "i4", LongType(): "f8", FloatType(): "f4", DoubleType(): "f8"}  # PLY has no whole numbers of 64 bits
        types = {f.name: f.dataType for f in schema.fields}
        unknown = [n for n in names if n not in back and types[n] not in kinds]
        if unknown:
            raise ValueError(f"no PLY type for {unknown}")
        self.columns = [(n, back.get(n, n), "u1" if n in back else kinds[types[n]]) for n in names]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        store, at = opened(self.parts)
        store.create_dir(at, recursive=True)
        context = TaskContext.get()
        path, n = f"{at}/{context.partitionId():08d}-{context.taskAttemptId()}", 0
        dtype = np.dtype([(p, "<" + k) for _, p, k in self.columns])
        with store.open_output_stream(path) as out:
            for batch in iterator:
                n += len(batch)
                if self.like is not None:
                    out.write(_joined(batch.column("record"), self.like.dtype.itemsize))
                    continue
                rows = np.zeros(len(batch), dtype)
                for column, name, kind in self.columns:
                    values = batch.column(column).to_numpy(zero_copy_only=False)
                    rows[name] = np.clip(np.rint(values * 255), 0, 255) if kind == "u1" else values
                out.write(rows.tobytes())
        return _Part(path, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.path)
        names = {v: k for k, v in SCALARS.items() if k in ("char", "uchar", "short", "int", "float", "double")}
        order, properties = ("<", [f"property {names[k]} {p}" for _, p, k in self.columns]) if self.like is None else (self.like.order, self.like.properties)
        lines = ["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", f"element vertex {sum(p.records for p in parts)}", *properties, "end_header", ""]
        store, at = opened(self.path)
        with store.open_output_stream(at + ".new") as out:
            out.write("\n".join(lines).encode())
            for p in parts:
                with store.open_input_stream(p.path) as f:
                    while chunk := f.read(1 << 22):
                        out.write(chunk)
        store.move(at + ".new", at)
        self.abort(messages)

    def abort(self, messages) -> None:
        store, at = opened(self.parts)
        if store.get_file_info(at).type != pafs.FileType.NotFound:
            store.delete_dir(at)


class PlySource(DataSource):
    """Options: path; extras=true keeps other scalars; raw=true gives whole records; records sets the rows of a partition; sample gives exactly so many records (all, if there are fewer) in one scan, chosen by seed; like, for writing, names the file whose records these are."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _says(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def schema(self) -> StructType:
        if self._says("raw"):
            return StructType([StructField("point_id", LongType()), StructField("record", BinaryType())])
        extras = self._says("extras")
        own = [StructField(c, SPARK[k]) for c, _, k in fields(read_header(self.options["path"]), extras)]
        return StructType([StructField("point_id", LongType()), *own])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], self._says("extras"), int(self.options.get("records", 1 << 20)), self._says("raw"), None if (k := self.options.get("sample")) is None else int(k), int(self.options.get("seed", 1)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema, overwrite, self.options.get("like"))
