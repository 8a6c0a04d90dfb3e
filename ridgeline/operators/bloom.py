"""A Bloom filter of 64-bit hashes: built by Spark, sent to its tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 6
BITS_PER_KEY = 16
#: Largest filter in bits (4 MB), and the least bits for each key that it is worth having.
MOST_BITS, LEAST_PER_KEY = 1 << 25, 8


def _places(h: Column, bits: int) -> list[Column]:
    """Bits of a hash: its halves as start and odd step."""
    start, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(start + step * F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


class Bloom:
    """The filter as an array of words, small enough to be sent to every task."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes (unsigned) that may be in the table; the others
        are not."""
        at = np.arange(len(h))
        start, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            place = (start[at] + step[at] * np.uint64(i)) & np.uint64(len(self.words) * 64 - 1)
            at = at[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at


def bloom_of(hashes: DataFrame, column: str, keys: int) -> Bloom | None:
    """Filter of a column of hashes (long) with ``keys`` rows; None where that
    many would fill the largest filter, and nothing is gained by one.  Bits are
    set by Spark; the driver gets the words that are not zero."""
    bits = min(MOST_BITS, 1 << max(10, (keys * BITS_PER_KEY - 1).bit_length()))
    if keys * LEAST_PER_KEY > bits:
        return None
    at = hashes.select(F.explode(F.array(*_places(F.col(column), bits))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 AS int))")
    found = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bloom(words)
