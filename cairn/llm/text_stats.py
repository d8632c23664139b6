"""Counts over whole texts, one pass over the bytes of each.

A null text counts as empty: all zeros. A text is held once, with eight bytes a
word beside it; nothing is kept from one text to the next.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.exact_dedup import text_bytes

WINDOW = 8
NAMES = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_unique_words", "n_upper", "n_digits", "n_marks", "n_bars")
SCHEMA = ", ".join(f"{n} long" for n in NAMES)
#: Odd factors of the window hash.
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)]


def _codes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SPACE = _codes(bytes(range(9, 14)) + b" ")
_SYMBOLS = _codes(b"#*$%&|<>")
_UPPER = _codes(bytes(range(65, 91)))
_DIGITS = _codes(b"0123456789")
_MARKS = _codes(b"!?.,;:")
_BARS = _codes(b"|")
_STARTS = np.ones(256, np.int64)
_STARTS[0x80:0xC0] = 0


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found at least twice.

    Windows are told apart by a 64-bit hash; those that share one are compared.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(window):
        sums += ids[k : k + n] * np.uint64(_FACTORS[k])
    order = np.sort(sums)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(sums, again))
    held = Counter(tuple(words[i : i + window]) for i in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if held[tuple(words[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def describe(raw: np.ndarray) -> tuple[int, ...]:
    """The counts of NAMES for a text in UTF-8."""
    held = np.bincount(raw, minlength=256)
    data = raw.tobytes()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    chars = int(held @ _STARTS)
    return (chars, len(words), chars - int(held @ _SPACE), int(held @ _SYMBOLS), len(lines), len(lines) - len(set(lines)), repeat_words(words), len(set(words)), int(held @ _UPPER), int(held @ _DIGITS), int(held @ _MARKS), int(held @ _BARS))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([describe(raw) for raw in text_bytes(b.column("text"))], np.int64).reshape(-1, len(NAMES))
        others = {n: b.column(n) for n in b.schema.names if n != "text"}
        yield pa.RecordBatch.from_pydict(others | {n: pa.array(rows[:, i]) for i, n in enumerate(NAMES)})


def text_stats(docs: DataFrame, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """The given key columns and NAMES for every row."""
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_run, f"{fields}, {SCHEMA}")
