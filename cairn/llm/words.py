"""Hashes of the words of whole texts, by arithmetic over their bytes.

A word is a run of bytes other than space and \\t..\\r, A-Z lower-cased. Its hash is the
polynomial of a table value for each byte, modulo 2**64: running sums over a block give
it for all words of the block at once, wherever they stand. Polynomials modulo a power
of two are weak for long words, so words beyond LONG bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of texts that are taken at once, or a text that alone is larger; and bytes of a block of running sums.
STEP_BYTES, BLOCK = 1 << 18, 1 << 18
#: Bytes of the longest word whose hash comes from running sums.
LONG = 32
BASE = 0x9E3779B97F4A7C13  # 3 modulo 8


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of a number spread over all bits of another."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _table() -> np.ndarray:
    out = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019))
    out[65:91] = out[97:123]
    return out


_VALUES = _table()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def _powers() -> np.ndarray:
    """BASE ** 0 .. BASE ** BLOCK, made once a process."""
    if not _POWERS:
        steps = np.full(BLOCK + 1, BASE, np.uint64)
        steps[0] = 1
        _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0]


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends): the texts in runs of some STEP_BYTES, a null one as empty; ends begin with 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_BYTES, "right")) - 1)
        yield raw[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at]
        at = upto


def _block(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of at most BLOCK bytes; a word ends at every break."""
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = breaks[(breaks > 0) & (breaks < len(raw))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers[BLOCK - starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG):
        hashes[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes().lower())
    return hashes, starts


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes one after another, and for each text the number of words before its end, from 0."""
    if len(raw) <= BLOCK:
        hashes, starts = _block(raw, ends)
        return hashes, np.searchsorted(starts, ends)
    parts, places, at = [], [], 0
    while at < len(raw):  # blocks end at white space, or hold one word that is longer than a block
        upto = min(at + BLOCK, len(raw))
        own = ends[(ends > at) & (ends < upto)] - at
        if upto < len(raw) and upto not in ends:
            spaces = np.flatnonzero(_SPACE[raw[at:upto]])
            edge = max(int(spaces[-1]) + 1 if len(spaces) else 0, int(own[-1]) if len(own) else 0)
            if not edge:
                rest = np.flatnonzero(_SPACE[raw[upto:]])
                stop = min(upto + int(rest[0]) if len(rest) else len(raw), int(ends[ends > at][0]))
                parts.append(np.array([xxhash.xxh64_intdigest(raw[at:stop].tobytes().lower())], np.uint64))
                places.append(np.array([at]))
                at = stop
                continue
            upto = at + edge
        hashes, starts = _block(raw[at:upto], own)
        parts.append(hashes)
        places.append(starts + at)
        at = upto
    return np.concatenate(parts), np.searchsorted(np.concatenate(places), ends)
