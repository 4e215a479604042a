"""Whole texts as byte arrays: words found and hashed for a block of texts at once.

Helpers of the Arrow tasks. A block is a bounded stretch of consecutive rows, so a task
holds a few copies of ``BLOCK_BYTES`` (or of one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BLOCK_BYTES = 1 << 19

# An odd 64-bit multiplier, its inverse modulo 2^64, and mixing multipliers.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: dict[int, np.ndarray] = {}


def schema(fields: list[StructField], added: str) -> StructType:
    """``fields`` and the columns of the DDL string ``added``."""
    return StructType([*fields, *StructType.fromDDL(added).fields])


def pack(docs: DataFrame, *needed: str) -> DataFrame:
    """``text``, the ``needed`` columns, and all columns but the text as one struct, so that
    an operator's own column names cannot meet theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*needed, "text", F.struct(*rest).alias("__rest"))


def unpack(found: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns that were packed, ``text`` as it is now and others as ``replaced``."""
    out = {c: F.col("text") if c == "text" else F.col("__rest").getField(c) for c in columns} | replaced
    return found.select(*[out[c].alias(c) for c in columns])


def byte_table(member) -> np.ndarray:
    """``table[b]`` is true for the byte values ``member`` accepts."""
    return np.array([bool(member(b)) for b in range(256)])


NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALPHANUMERIC = byte_table(
    lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one bound more than texts)."""
    kind = pa.large_binary() if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(
        texts.type
    ) else pa.binary()
    filled = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(kind)
    wide = np.int64 if kind == pa.large_binary() else np.int32
    bounds = np.frombuffer(filled.buffers()[1], dtype=wide)[
        filled.offset : filled.offset + len(filled) + 1
    ].astype(np.int64)
    held = filled.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """Starts and ends of maximal runs of ``table`` bytes, none across texts, and the
    number of words before each text (one bound more than texts)."""
    inside = table[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, BLOCK_BYTES)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held)
    return held[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any stretch of ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), _STEP), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch; equal bytes give equal hashes wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), _BACK)[starts] + (ends - starts).astype(np.uint64))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash from several, in order."""
    out = parts[0]
    for part in parts[1:]:
        out = mix(out * np.uint64(_STEP) + part)
    return out


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The text each word lies in."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
