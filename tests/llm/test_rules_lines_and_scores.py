from __future__ import annotations

from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import line_dedup, lm_scoring, quality_rules

SF = "/root/testdata/sf0.001"
SHOWN = [(1, "a b c a b c a b c", "s"), (2, None, "s"), (3, "", None), (4, "x\ny\nx\n \n\nx", "s"), (5, "# $ a|b <c>\x0bd", None),
         (6, "é è é è é è", "t"), (7, "the " * 30_000, "t"), (8, "A b\nB a b A b", "s")]


def compare(spark, build, sql, docs):
    con = duckdb.connect()
    con.register("given", docs.toArrow())
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    found = build(docs)
    names = sorted(found.columns)
    own = sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)
    held = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert own == sorted(held, key=str)
    return own


def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    return docs, spark.createDataFrame(SHOWN, docs.schema)


def test_quality_rules(spark):
    build = lambda d: quality_rules.judge(d).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")
    for docs in tables(spark):
        compare(spark, build, quality_rules.oracle(), docs)
    named = tables(spark)[1].withColumnRenamed("source", "kept")
    assert quality_rules.judge(named).count() == len(SHOWN)
    assert quality_rules.judge(named.limit(0)).count() == 0


def test_rules_stay_in_one_projection(spark):
    plan = quality_rules.judge(tables(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_verdict_bounds():
    assert quality_rules.verdict([("r", "a", "b", None, None)]) == "true"
    assert quality_rules.verdict([("r", "a", "b", 1, 2.5)]) == "(a >= 1.0D * b) AND (a <= 2.5D * b)"


@pytest.mark.parametrize("vocabulary,min_count", [(60_000, 2), (40, 2), (300, 5), (60_000, 1)])
def test_lm_scores(spark, vocabulary, min_count):
    docs, shown = tables(spark)
    docs = docs.unionByName(shown.selectExpr("doc_id + 100000 AS doc_id", "text", "source"))
    build = lambda d: lm_scoring.score(d, vocabulary=vocabulary, min_count=min_count, dense=10, part_pairs=3000, home_docs=50)
    compare(spark, build, lm_scoring.oracle(vocabulary, min_count), docs)


def test_lm_scores_odd_tables(spark):
    _, shown = tables(spark)
    assert lm_scoring.score(shown.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "b a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in lm_scoring.score(twice).collect()} == {1: 4, None: 1}


def test_lm_pairs_of_the_unknown_word_are_not_shipped():
    held = lm_scoring.Vocabulary([("a", 9), ("b", 8), ("c", 7)], 100)
    model = lm_scoring.Model(held, np.ones(4, int), np.zeros(9, int), dense=2, min_count=2, backoff=0.4)
    texts = ["x y z " * 50 + "a q a", "c b c b c b c a"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["doc", "text"])
    rows = [r for b in lm_scoring._explode(SimpleNamespace(value=model), 1, 1)([batch]) for r in b.to_pylist() if r["part"] >= 0]
    assert [r["docs"] for r in rows] == [[2, 2, 2]]
    assert sorted(rows[0]["times"]) == [1, 3, 3]


def pages(spark):
    rows = [(k, f"menu\nbody {k}\nmenu\n  \nfooter" + ("\nrare" if k < 3 else ""), "h" if k % 2 else None, 0) for k in range(40)]
    rows += [(100, None, "h", 1), (101, "", "z", 2), (102, "menu", "z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_dropped int")


def test_line_dedup_paths_agree(spark):
    expected = None
    for ship in (1000, 0):
        found = line_dedup.drop_boilerplate(pages(spark), ship_rows=ship)
        rows = sorted((tuple(r) for r in found.collect()), key=str)
        expected = expected or rows
        assert rows == expected
    by_id = {r[0]: r for r in found.collect()}
    assert by_id[0].text == "body 0\n  \nrare" and (by_id[0].n_lines, by_id[0].n_dropped) == (5 + 1, 3)
    assert by_id[102].text == "menu" and by_id[100].text is None


def test_line_dedup_keeps_columns(spark):
    cleaned = line_dedup.clean(pages(spark))
    assert cleaned.columns == ["doc_id", "text", "source", "n_dropped"]
    assert {r.n_dropped for r in cleaned.collect()} == {0, 1, 2, None}
    assert line_dedup.clean(pages(spark).limit(0)).count() == 0


def test_line_dedup_is_native(spark):
    plan = line_dedup.drop_boilerplate(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
