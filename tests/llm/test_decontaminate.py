from __future__ import annotations

import hashlib
import re

from maskwright.llm import decontaminate as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute_force(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = {}
    for doc, text in docs:
        words = words_of(text)
        hit, found = [False] * len(words), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k : k + size])):
                    found |= own
                    hit[k : k + size] = [True] * size
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        digest = hashlib.sha256(ids.encode()).hexdigest()
        out[doc] = (len(words), sum(hit), len(ids.split(",")) if ids else 0, digest, any(hit))
    return out


EXTRA = [(900, "the of"), (901, "The"), (902, "and and"), (903, None), (904, "..."), (None, "of the"), (901, "in the")]
ODD = [(5000, None), (5001, ""), (5002, " .,\n"), (5003, "THE"), (5004, "the of " * 4000), (5004, "x the")]


def report(spark, docs, items, **options):
    rows = dc.report(dc.find_hits(docs, items, **options)).collect()
    return sorted((r[0], tuple(r)[1:]) for r in rows)


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(ODD[:-1], docs.schema))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    for own in (items, items.unionByName(spark.createDataFrame(EXTRA, items.schema))):
        expected = sorted(brute_force(docs.collect(), own.collect()).items())
        assert report(spark, docs, own) == expected


def test_shards_and_pieces_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = items.unionByName(spark.createDataFrame(EXTRA, items.schema))
    assert report(spark, docs, items, shard_words=200, piece_words=15) == report(spark, docs, items)


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x a b c y", "s", 4, 9), (1, "x a b c y", "s", 4, 9), (2, "plain", None, None, None)],
        "doc_id long, text string, spans string, items int, n_chars long",
    )
    assert dc.find_hits(docs.limit(0), items).count() == 0
    assert [r.n_words for r in dc.find_hits(docs, items.limit(0)).orderBy("doc_id").collect()] == [5, 5, 1]
    kept = dc.decontaminate(docs, items, window=3, min_span=3, max_coverage=0.7)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [
        (1, "x  y", "s", 4, 4), (1, "x  y", "s", 4, 4), (2, "plain", None, None, None),
    ]
    assert [tuple(r) for r in dc.decontaminate(docs, items, window=3, max_coverage=0.0).collect()] == [
        (2, "plain", None, None, None)
    ]
