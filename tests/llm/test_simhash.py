from __future__ import annotations

import re

import numpy as np
import xxhash

from maskwright.llm import simhash as sh

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def lowest(ids, prints, radius=4):
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= radius
    label = np.array(ids)
    while True:
        new = np.where(near, label[None], label.max()).min(1)
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(0)
    masks = sh.covering_masks(4)
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 30
    for flips in range(1, 5):
        for _ in range(500):
            gap = sum(1 << int(k) for k in rng.choice(64, flips, replace=False))
            assert any(gap & m == 0 for m in masks)
            assert any(gap & finer == 0 for m in masks if gap & m == 0 for finer in sh.refinements(m, 4))


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (5005, "a b c d"), (5006, "a b c d e"),
           (5007, "Ärger ÄRGER \x1c x"), (5008, "w " * 50_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    expected = lowest([r.doc_id for r in rows], prints)
    found = sh.report(sh.components(sh.fingerprints(docs))).collect()
    assert len(found) == len(rows)
    want = {r.doc_id: (f"{p:016x}", expected[r.doc_id]) for r, p in zip(rows, prints)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == want


def test_refined_buckets_keep_every_link(spark):
    rng = np.random.default_rng(1)
    values = set()
    for centre in rng.integers(0, 2**63, 4):
        for _ in range(150):
            value = int(centre)
            for k in rng.integers(0, 63, rng.integers(0, 7)):
                value ^= 1 << int(k)
            values.add(value)
    values = sorted(values)
    prints = spark.createDataFrame(list(enumerate(values)), "doc_id long, fingerprint long")
    expected = lowest(list(range(len(values))), values)
    found = sh.components(prints, bucket_rows=30).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_buckets_stay_whole_if_their_sizes_are_broadcast_when_it_runs(spark):
    rng = np.random.default_rng(2)
    values = [int(v) ^ (1 << int(k)) ^ (1 << int(j)) for v in rng.integers(0, 2**62, 300) for k, j in rng.integers(0, 62, (6, 2))]
    prints = spark.createDataFrame(list(enumerate(values)), "doc_id long, fingerprint long")
    sizes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        found = {r.doc_id: r.component_id for r in sh.components(prints).collect()}
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert found == lowest(list(range(len(values))), values)


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d e f g", 1), (2, "A b c d e f g", 2), (2, "A b c d e f g", 2), (None, "a b c d e f g", 3), (9, "other words", 4)],
        "doc_id long, text string, component_id int",
    )
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [
        (2, "A b c d e f g", 2), (2, "A b c d e f g", 2), (9, "other words", 4), (None, "a b c d e f g", 3),
    ]
    assert sh.keep_one(docs.limit(0)).count() == 0
