from __future__ import annotations

import numpy as np

from maskwright.llm import language_id, quality_model as qm


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    model = qm.fit(docs, labels.where(~language_id.held_out()))
    rows = (
        qm.score(docs.join(labels, "doc_id"), model)
        .where(language_id.held_out()).select("quality", "score", "predicted").collect()
    )
    good = np.array([r.quality for r in rows])
    score = np.array([r.score for r in rows])
    assert ((score >= 0) & (score <= 1)).all()
    assert (np.array([r.predicted for r in rows]) == (score >= qm.GOOD)).all()
    assert (np.array([r.predicted for r in rows]) == good).mean() > 0.97
    assert np.abs(score.mean() - good.mean()) < 0.03  # calibrated on the whole


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert np.array_equal(qm.word_vectors(docs.repartition(5)), qm.word_vectors(docs.coalesce(1)))


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 5), (2, None, 6), (3, "", 7), (None, "### $$$", 8), (1, "good words here", 5)],
        "doc_id long, text string, score int",
    )
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int")
    model = qm.fit(docs, labels)
    assert {r.score for r in qm.score(docs, model).collect()} == {1.0}
    assert {r.score for r in qm.score(docs, qm.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert qm.score(docs.limit(0), model).count() == 0
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(qm.score(docs, qm.fit(docs, both)).collect()) == 5
    assert qm.fit(docs.limit(0), labels).network.constant == 0.5
