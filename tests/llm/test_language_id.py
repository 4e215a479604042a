from __future__ import annotations

import numpy as np
import pyarrow as pa

from maskwright.llm import language_id as li


def test_codewords_are_apart():
    for classes in (2, 3, 4, 6, 9, 30):
        code = li.codewords(classes)
        distance = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(distance, code.shape[1])
        assert distance.min() >= 1 and code.shape[0] == classes
    four = li.codewords(4)
    assert ((7 - four @ four.T) / 2)[~np.eye(4, dtype=bool)].min() == 4


def test_letters():
    texts = pa.array(["", None, "123 .,", "é", "1a", "日本", "٣"])
    assert li.has_letter(texts).tolist() == [False, False, False, True, True, True, False]


def test_held_out_accuracy_and_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = li.fit(docs.where(~li.held_out()))
    found = li.identify(docs, model).select("lang", "lang_pred", "score", li.held_out().alias("held")).collect()
    held = [r for r in found if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    import zlib

    ids = [r.doc_id for r in docs.where(li.held_out()).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def test_sample_bound_and_determinism(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = li.fit(docs, per_language=5, max_rows=15)
    two = li.fit(docs.repartition(7), per_language=5, max_rows=15)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat", "en", 1.5), (2, "der hund lag", "de", 2.5), (3, None, None, 0.0), (4, "12 !", "en", 0.1),
         (None, "x" * 300_000, "en", 0.2), (1, "the cat sat", "en", 1.5)],
        "doc_id long, text string, lang string, score double",
    )
    nothing = li.fit(docs.limit(0))
    assert {r.lang_pred for r in li.identify(docs, nothing).collect()} == {"und"}
    model = li.fit(docs)
    rows = li.identify(docs, model).collect()
    assert [r.lang_pred for r in rows if r.text is None or r.text == "12 !"] == ["und", "und"]
    kept = li.keep_identified(docs, model, 0.0)
    assert kept.columns == docs.columns and sorted(r.score for r in kept.collect()) == [0.2, 1.5, 1.5, 2.5]
    assert li.identify(docs.limit(0), model).count() == 0
