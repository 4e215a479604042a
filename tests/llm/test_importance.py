from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from maskwright.llm import importance, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(docs, target, percent=25, min_words=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count([x for _, x in docs]), count(target)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        n, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long_enough = sorted((-r[4], r[0] is None, r[0] or 0, k) for k, r in enumerate(rows) if r[1] >= min_words)
    ranks = {x[3]: i + 1 for i, x in enumerate(long_enough[: percent * len(long_enough) // 100])}
    return [(*r, ranks.get(k)) for k, r in enumerate(rows)]


def names(found):
    return [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").collect()
    expected = brute_force([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
    assert sorted(names(queries.op12_importance_resampling(spark, folder).collect())) == sorted(expected)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "A\x00b É9 " * 30), (None, "one two " * 15), (4, "w" * 500_000), (5, "--- !"), (6, "a  b\nc-" * 40_000)]
    docs += [(7, "same text " * 12)] * 3 + [(k, "same text " * 12) for k in range(8, 20)]
    target = ["same text same", None, ""]
    frame = spark.createDataFrame([(d, t, "own", 5) for d, t in docs], "doc_id long, text string, rank string, score int")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 25, 50, 100):
        found = names(importance.resample(frame, items, percent=percent).collect())
        assert sorted(found, key=str) == sorted(brute_force(docs, target, percent), key=str)
    assert importance.resample(frame.limit(0), items).count() == 0
    assert importance.resample(frame, items.limit(0)).count() == len(docs)


def test_ties_at_the_border_go_to_the_smaller_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(importance, "noise", lambda seed, key: F.lit(3).cast("long"))
    rows = spark.createDataFrame([(k, 30, 0) for k in range(100, 0, -1)], "doc_id long, n_words long, weight long")
    found = importance.draw(rows, percent=25).where("rank is not null").orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in found] == [(k, k) for k in range(1, 26)]
