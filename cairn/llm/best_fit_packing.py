"""Best-fit packing of token pieces into sequences, by a histogram of lengths on the driver.

Documents become token ids and an end id; only documents longer than a sequence are
cut. Within a length every piece has a rank, from
block counts and a window inside each block, so no task holds a whole length. Gaps
are held as runs of sequences with equal room. A superstep takes the longest
lengths left, sweeps the runs of gaps upwards from the smallest that fits (the
successor), gives the pieces of lowest rank the gaps of lowest room, splits the run
where pieces or gaps end, updates the gaps and repeats; what finds no gap opens new
sequences. As pieces of one length are alike, a sweep moves whole runs: its tables
have at most a few rows a length, whatever the number of pieces, and the pieces
themselves look their places up by rank where they lie. The sweep runs on the driver, one
length after the other: it takes the place of distributed sweeps and of conflicts resolved
by rank, because its tables do not grow with the input beyond the 4096 lengths.

Defined cases: a null text is empty, an empty document is the end id alone; rows that
repeat a doc_id, or have none, are packed each; ties go by doc_id and piece; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.tokens import tokenizer, vocabulary_path
from cairn.session import cut

SEQUENCE = 4096
END_ID = 1
#: Blocks that all lengths together have at most, beside one each, and rows of a block at least.
BLOCKS, BLOCK_ROWS = 1 << 16, 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """PIECES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocabulary or vocabulary_path())
        for batch in batches:
            ids, counts = encoder.encode_texts(batch.column("text"))
            totals = counts + 1
            ends = np.cumsum(totals)
            all_ids = np.full(int(totals.sum()), END_ID, "<u4")
            all_ids[np.delete(np.arange(len(all_ids)), ends - 1)] = ids
            pieces = -(-totals // size)
            row = np.repeat(np.arange(len(totals)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * size
            length = np.minimum(size, totals[row] - start)
            at = (ends - totals)[row] + start
            crc = [zlib.crc32(all_ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def supersteps(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs of (length, first rank, pieces, first sequence, offset) for pieces of all lengths, sorted.

    Pieces first .. first + n - 1 of a length go to as many consecutive sequences.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, deque[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted, of gaps that have sequences
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = deque()
                insort(rooms, room)
            gaps[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (k := bisect_left(rooms, length)) < len(rooms):
            room = rooms[k]
            first, n = gaps[room].popleft()
            took = min(n, left)
            runs.append((length, rank, took, first, size - room))
            if took < n:
                gaps[room].appendleft((first + took, n - took))
            elif not gaps[room]:
                del gaps[room], rooms[k]
            add(room - length, first, took)
            rank, left = rank + took, left - took
        each = size // length
        full, rest = divmod(left, each)
        for k in range(each if full else 0):
            runs.append((length, rank, full, opened, k * length))
            rank += full
        add(size - each * length, opened, full)
        opened += full
        for k in range(rest):
            runs.append((length, rank, 1, opened, k * length))
            rank += 1
        if rest:
            add(size - rest * length, opened, 1)
            opened += 1
    made = np.array(runs, np.int64).reshape(-1, 5)
    return made[np.lexsort((made[:, 1], made[:, 0]))]


def _placed(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_keys, block_first, runs = shared.value
        run_keys = runs[:, 0] << 40 | runs[:, 1]
        for b in batches:
            length, block, rank = (b.column(c).to_numpy() for c in ("length", "block", "rank"))
            rank = rank + block_first[np.searchsorted(block_keys, length << 32 | block)]
            own = runs[np.searchsorted(run_keys, length << 40 | rank, "right") - 1]
            made = {"sequence_id": pa.array(own[:, 3] + rank - own[:, 1]), "offset": pa.array(own[:, 4])}
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in names} | made)

    return run


def pack(pieces: DataFrame, size: int = SEQUENCE, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces plus sequence_id and offset; lengths are 1 .. size, `order` breaks ties.

    To the driver come a count for each length and for each of at most BLOCKS + size blocks.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    rows = max(BLOCK_ROWS, sum(counts.values()) // BLOCKS)
    blocks = spark.createDataFrame([(k, -(-n // rows)) for k, n in counts.items()], "of long, blocks long")
    dealt = pieces.join(F.broadcast(blocks), F.col("length") == F.col("of"))  # a row a length
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(*order), F.col("blocks"))).drop("of", "blocks")
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "block"])
    keys = (sizes["length"].to_numpy() << 32) | sizes["block"].to_numpy()
    first = (sizes.groupby("length")["n"].cumsum() - sizes["n"]).to_numpy()
    shared = spark.sparkContext.broadcast((keys, first, supersteps(counts, size)))
    names = pieces.columns
    within = Window.partitionBy("length", "block").orderBy(*order, *(c for c in names if c not in order and c != "length"))
    ranked = dealt.withColumn("rank", (F.row_number().over(within) - 1).cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(_placed(shared, names), fields + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(cut(token_pieces(docs, size, vocabulary, text, doc_id), "pieces"), size)
