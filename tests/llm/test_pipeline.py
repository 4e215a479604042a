from __future__ import annotations

import corpus_pipeline

from maskwright.llm import language_id
from maskwright.llm.queries import default_tokenizer
from test_decontaminate import brute_force as contaminated
from test_simhash import fingerprint, lowest

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    """Every stage's decisions worked out anew from what the stage before kept."""
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs = start
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        tables.append(docs)
    spoken, cleaned, single, free, encoded = tables
    assert all(t.schema.names == start.schema.names for t in tables[:4])
    model = language_id.fit(start.where(~language_id.held_out()))
    clear = language_id.identify(start, model).where("not ambiguous")
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in clear.collect()}
    assert cleaned.count() == spoken.count()
    rows = cleaned.select("doc_id", "text").collect()
    first = lowest([r.doc_id for r in rows], [fingerprint(r.text) for r in rows])
    assert {r.doc_id for r in single.collect()} == set(first.values())
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    hits = contaminated(single.select("doc_id", "text").collect(), items)
    assert {r.doc_id for r in free.collect()} == {d for d, h in hits.items() if not h[4]}
    codec = default_tokenizer(spark)
    assert codec.value and encoded.count() == free.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in encoded.collect()}
    for table in tables:
        table.unpersist()


def test_odd_documents_pass_every_stage(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (2, "the cat " * 20, "en", "s", None, 3),
            (2, "the cat " * 20, "en", "s", None, 3), (3, "x" * 200_000, None, None, 200_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF)
        table.collect()
