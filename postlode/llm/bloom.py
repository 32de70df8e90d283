"""A Bloom filter of fixed size over 64-bit hashes: built in the JVM, tested in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the filter: 16 MB. Under 2 % of other hashes pass it up to ten million, one in a million up to sixty thousand.
BITS = 1 << 27


def _places(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def built(hashes: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """The filter of a column of 64-bit hashes, as bits / 64 words: a bitwise or per word, of which at most that many reach the driver."""
    placed = hashes.select(F.explode(F.array(*_places(F.col(name), bits))).alias("p"))
    words = placed.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy()
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (int64 or uint64) may be one of those the filter was built of."""
    h, top = hashes.view(np.uint64), np.uint64(64 * len(table) - 1)
    bit = lambda p: table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64) & 1
    return (bit(h & top) & bit(h >> np.uint64(32) & top)).astype(bool)
