"""Words of whole texts by a byte table, a block at a time.

A table maps every byte that stands in no word to a space, A-Z to a-z, and keeps all
others. All bytes of a character beyond ASCII are kept alike, so words stay valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a text that are split at once.
BLOCK_BYTES = 1 << 20
_UPPER, _LOWER, _DIGITS, _WIDE = range(65, 91), range(97, 123), range(48, 58), range(128, 256)


def table(*kept: range) -> bytes:
    """The byte table of words made of the kept bytes."""
    out = bytearray(b" " * 256)
    for run in kept:
        for b in run:
            out[b] = b
    for b in _UPPER:
        out[b] = out[b + 32]
    return bytes(out)


LETTERS = table(_LOWER, _WIDE)
LETTERS_AND_DIGITS = table(_LOWER, _DIGITS, _WIDE)


def texts(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of every text, a null one as empty, without a copy."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    held = memoryview(data) if data is not None else memoryview(b"")
    known = column.is_valid().to_pylist()
    for i, ok in enumerate(known):
        yield held[ends[i] : ends[i + 1]] if ok else held[:0]


def blocks(text: memoryview, kept: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The mapped text in blocks that end between words; a word longer than a block is in one piece."""
    at, step = 0, size
    while at < len(text):
        block = bytes(text[at : at + step]).translate(kept)
        if at + step < len(text):
            edge = block.rfind(b" ") + 1
            if not edge:
                step *= 2
                continue
            block = block[:edge]
        yield block
        at += len(block)
        step = size
