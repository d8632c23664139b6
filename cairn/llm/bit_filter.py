"""A bit filter of fixed size over hashed values: rules rows out before an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter as a power of two: 2 MB, whatever is put in.
BITS = 24


def build(values: DataFrame, *hashes: Column) -> np.ndarray:
    """The words of the filter that holds the leading bits of the 64-bit hashes; one row comes for each word at most."""
    place = lambda h: F.shiftright(h, 64 - BITS).bitwiseAND((1 << BITS) - 1)
    bits = values.select(F.explode(F.array(*map(place, hashes))).alias("p"))
    bits = bits.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    held = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << BITS - 6, np.uint64)
    words[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def maybe(words: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Whether a value with these hashes may be in the filter."""
    keep = np.ones(len(hashes[0]), bool)
    for h in hashes:
        p = (h >> (64 - BITS)) & ((1 << BITS) - 1)
        keep &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return keep
