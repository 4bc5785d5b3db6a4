"""Bloom filters of 64-bit hashes: made in the cluster, bounded in size, looked up in the workers.

A filter tells which rows can match a table that may be too large to send. It never holds a match back; how
many others it lets through grows with the table once its bits are as many as they may be, so what passes
is joined with the table afterwards. Null hashes are in no filter.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per hash, and the power of two that bounds the bits of a filter (2 MB).
BITS_EACH, MOST_BITS = 32, 24
#: The seed of the function xxhash64 of Spark.
SEED = 42


def text_hash(text: str) -> int:
    """The hash that ``xxhash64`` gives a text in Spark, without sign."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)


class HashFilter:
    """Two bits per hash."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, len(words) * 64 - 1

    def __contains__(self, h: int) -> bool:
        """Whether a hash without sign can be in the filter."""
        a, b = h & self.mask, (h >> 32) & self.mask
        return bool(int(self.words[a >> 6]) >> (a & 63) & 1 and int(self.words[b >> 6]) >> (b & 63) & 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """The same of many (uint64)."""
        found = np.ones(len(hashes), dtype=bool)
        for places in (hashes & np.uint64(self.mask), (hashes >> np.uint64(32)) & np.uint64(self.mask)):
            found &= (self.words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def hash_filter(hashes: DataFrame, column: str, most_bits: int = MOST_BITS) -> HashFilter:
    """The filter of a column of hashes (bigint). Its words are merged in the cluster; 2 ** most_bits bits at most come back."""
    kept = hashes.where(F.col(column).isNotNull())
    bits = max(6, min(most_bits, (BITS_EACH * kept.count()).bit_length()))
    mask = F.lit((1 << bits) - 1).cast("bigint")
    place = lambda h: h.bitwiseAND(mask)
    places: Column = F.array(place(F.col(column)), place(F.shiftrightunsigned(column, 32)))
    each = kept.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    words = np.zeros((1 << bits) // 64, dtype=np.uint64)
    for word, held in each.groupBy("word").agg(F.bit_or("bit")).collect():
        words[word] = held & 0xFFFFFFFFFFFFFFFF
    return HashFilter(words)
