"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Links join
fingerprints that differ in at most ``radius`` bits.

Candidates come from ``2^(radius+1) - 1`` tables. Every bit position carries a non-zero
vector of ``radius + 1`` bits, dealt out evenly; table ``v`` keeps the positions whose
vector has odd parity with ``v``. For any ``radius`` positions some ``v`` is orthogonal to
all their vectors, so two fingerprints within the radius agree on all bits that table
keeps: every such pair meets in at least one table.

Only distinct fingerprints are tabled, so copies cost one row. A bucket of more than
``bucket_rows`` fingerprints is refined: its free bits are cut into ``radius + 1`` blocks
and each block makes a sub-bucket in which its bits are fixed too; two members that differ
in ``radius`` bits or fewer agree on a whole block. Free bits shrink at every level, so
buckets end up below the bound whatever the input. In a bucket, members are compared at
growing distance in the sorted order and only a spanning star of each linked set leaves
the task, never the pairs.

Defined cases: a null, empty or blank text has no words and fingerprint zero, and is
linked like any other; repeated rows and ties share a fingerprint; a row with a null id
takes part and gets a component, but is named by none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.lineage import cut, dealt
from maskwright.llm import textbytes as tb
from maskwright.operators.components import connected_components

SHINGLE = 4
RADIUS = 4
BUCKET_ROWS = 4096
SEED = 42
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_bits(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text, as signed 64-bit integers."""
    data, bounds = tb.flatten(texts)
    data = tb.LOWER[data]
    starts, ends, firsts = tb.words(data, bounds, tb.NOT_SPACE)
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    if not len(starts):
        return out
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1  # words laid out anew, one space between them
    new_starts = new_ends - sizes
    laid = np.full(int(new_ends[-1]), 0x20, dtype=np.uint8)
    inside = np.repeat(new_starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    laid[inside] = data[tb.NOT_SPACE[data]]
    raw = laid.tobytes()
    counts = np.diff(firsts)
    rows = np.flatnonzero(counts)
    made = np.maximum(counts[rows] - shingle + 1, 1)
    heads = np.repeat(firsts[rows] - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    tails = np.minimum(heads + shingle, np.repeat(firsts[rows + 1], made)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(raw[a:b], SEED) for a, b in zip(new_starts[heads].tolist(), new_ends[tails].tolist())],
        dtype=np.uint64,
    )
    upto = np.cumsum(made)
    for a in range(0, len(rows), 256):
        part = slice(a, min(a + 256, len(rows)))
        low = upto[a] - made[a]
        own = hashes[low : upto[part.stop - 1]]
        bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits = np.add.reduceat(bits, upto[part] - made[part] - low, axis=0, dtype=np.int64)
        majority = np.packbits(set_bits * 2 > made[part, None], axis=1)
        out[rows[part]] = majority.view(">i8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` as a long."""
    kept = docs.drop("fingerprint")
    fields = [f for f in kept.schema if f.name != text]
    schema = tb.schema(fields, "fingerprint long")

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, text):
                bits = pa.array(shingle_bits(part.column(text), shingle))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in fields), bits], names=[*(f.name for f in fields), "fingerprint"]
                )

    return kept.mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The bits each table keeps."""
    vectors = [1 + at % ((1 << (radius + 1)) - 1) for at in range(64)]
    return [
        sum(1 << at for at, own in enumerate(vectors) if (own & v).bit_count() % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def refinements(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with each of ``radius + 1`` blocks of its free bits fixed as well."""
    free = [at for at in range(64) if not mask >> at & 1]
    blocks = [free[k :: radius + 1] for k in range(radius + 1)]
    return [mask | sum(1 << at for at in block) for block in blocks]


def _stars(bucket: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, least value linked to it) inside equal stretches of ``bucket``."""
    n = len(values)
    label = np.arange(n)
    group = np.concatenate(([0], np.cumsum(bucket[1:] != bucket[:-1])))
    size = np.bincount(group)[group]
    place = np.arange(n) - np.concatenate(([0], np.cumsum(np.bincount(group))[:-1]))[group]
    left = np.flatnonzero(place < size - 1)
    gap = 1
    while len(left):
        near = np.bitwise_count(values[left] ^ values[left + gap]) <= radius
        a, b = left[near], left[near] + gap
        while True:
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != label[label]).any():
                label = label[label]
        gap += 1
        left = left[place[left] + gap < size[left]]
    linked = np.flatnonzero(label != np.arange(n))
    return values[linked], values[label[linked]]


def _compare(radius: int, rows: int):
    """Rows sorted by bucket, whole buckets at a time, as spanning stars."""

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            got = np.column_stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            held.append(got)
            if sum(map(len, held)) < rows:
                continue
            table = np.concatenate(held)
            same = (table[:, :2] == table[-1, :2]).all(1)
            held = [table[same]]
            yield from _emit(table[~same], radius)
        if held:
            yield from _emit(np.concatenate(held), radius)

    return run


def _emit(table: np.ndarray, radius: int):
    if len(table):
        bucket = tb.chain(table[:, 0].copy(), table[:, 1].copy())
        node, root = _stars(bucket, table[:, 2], radius)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], names=["node", "root"]
        )


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(node, root)`` between distinct ``fingerprint`` values, enough of them to
    connect all that are within ``radius`` bits of each other."""
    spark = distinct.sparkSession
    masks = [_signed(m) for m in covering_masks(radius)]
    rows = distinct.select(
        F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), F.col("fingerprint").alias("value")
    )
    found = None
    while True:
        rows = cut(rows.withColumn("key", F.col("value").bitwiseAND(F.col("mask"))))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = cut(sizes)
        small = rows.join(sizes.where(F.col("n") <= bucket_rows).drop("n"), ["mask", "key"])
        part = (
            dealt(small.select("mask", "key", "value"), "mask", "key")
            .sortWithinPartitions("mask", "key", "value")
            .mapInArrow(_compare(radius, 50_000), "node long, root long")
        )
        part = cut(part.distinct())
        found = part if found is None else found.unionByName(part)
        large = sizes.where(F.col("n") > bucket_rows)
        used = [r.mask for r in large.select("mask").distinct().collect()]  # of a fixed set of masks
        if not used:
            return found
        finer = spark.createDataFrame(
            [(m, _signed(f)) for m in used for f in refinements(m & _ALL, radius)], "mask long, finer long"
        )
        rows = (
            rows.join(large.drop("n"), ["mask", "key"])
            .join(F.broadcast(finer), "mask")
            .select(F.col("finer").alias("mask"), "value")
            .distinct()
        )


def components(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``prints(doc_id, fingerprint, ..)`` with ``component_id``, the smallest id reachable."""
    prints = cut(prints)
    copies = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("lowest")))
    joined = connected_components(links(copies, radius, bucket_rows), []).select(
        F.col("node").alias("fingerprint"), "component"
    )
    labelled = copies.join(joined, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    lowest = labelled.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = cut(labelled.join(lowest, "component").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint")


def report(found: DataFrame) -> DataFrame:
    """The contract's columns of ``components``."""
    text = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; rows that
    share this id stay together and rows without an id stay."""
    prints = fingerprints(docs.select("doc_id", "text"))
    firsts = components(prints, radius, bucket_rows).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(firsts, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
