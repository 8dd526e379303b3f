"""Bloom filters of a fixed size over columns of 64-bit hashes, put together by the executors.

A filter lets a few rows through that it shouldn't, more as it fills; it never holds one
back.  So it only saves work, and its size is bounded whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** BITS bits; a key's own bits from these shifts on are its three places.
BITS, SHIFTS = 27, (0, 18, 37)


def bloom(rows: DataFrame, key: Column) -> np.ndarray:
    """The filter of ``key`` over ``rows``, as words of 64 bits."""
    mask = F.lit((1 << BITS) - 1)
    bits = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(mask) for s in SHIFTS]))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = rows.select(key.alias("key")).select(bits.alias("bit")).select(F.shiftright("bit", 6).alias("word"), one.alias("one"))
    got = words.groupBy("word").agg(F.bit_or("one").alias("ones")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("ones").to_numpy()
    return out.view(np.uint64)


def passes(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be in the filter."""
    keep = np.ones(len(key), bool)
    for s in SHIFTS:
        bit = (key >> np.uint64(s)) & np.uint64((1 << BITS) - 1)
        keep &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
    return keep
