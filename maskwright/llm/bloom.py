"""A Bloom filter of 64-bit hashes: which rows of a second pass can matter.

``PROBES`` slices of a hash are bit positions. Spark ORs the bits of each word, and at most
``MAX_BITS / 64`` words come to the driver and are shipped. Beyond some ten million hashes
the filter lets more rows through, which costs time and changes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 26
PROBES = (0, 19, 38)


def build(ids: DataFrame, column: str = "id"):
    """The filter of a column, ready to be shipped."""
    bits = 1 << 12
    while bits < min(MAX_BITS, 16 * ids.count()):
        bits *= 2
    at = F.explode(F.array(*[F.expr(f"shiftrightunsigned(`{column}`, {p}) & {bits - 1}L") for p in PROBES]))
    words = ids.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("held")
    ).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["held"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def has(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; those that are in it always may."""
    mask = np.uint64(64 * len(words) - 1)
    out = np.ones(len(ids), dtype=bool)
    for probe in PROBES:
        at = (ids >> np.uint64(probe)) & mask
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
