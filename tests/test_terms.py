from __future__ import annotations

import random

from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.operators import ranking, terms


def test_groups_equal_the_column_expression(spark):
    rng = random.Random(1)
    words = ["map", "maps", "wax figure", "wax", "figure", " and wife", "ai generated", "m", "é", "the map"]
    texts = [" ".join(rng.choice(["map", "maps", "wax", "figure", "bitmap", "and", "wife", "ai", "generated", "x", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, hay string")
    rules = terms.table(spark, [("hay", "penalty", 0.5, (w,)) for w in words] + [("other", "bonus", 1.0, ("x",))])
    expected = {r.k: [n for n in range(len(words)) if r[f"g{n}"]] for r in df.select(
        "k", *[text.has_term(F.coalesce("hay", F.lit("")), F.lit(w)).alias(f"g{n}") for n, w in enumerate(words)]).collect()}
    for part_bytes in (1 << 26, 1000):  # in one pass, and in parts
        found = terms.find_groups(df, rules, ["hay"], part_bytes=part_bytes)
        assert {r.k: r.groups for r in found.collect()} == expected


def test_ten_thousand_terms_are_one_pass(spark):
    rules = terms.table(spark, [("hay", "penalty", 0.5, tuple(f"word{k}" for k in range(0, 10_000, 2))), ("hay", "bonus", 0.1, tuple(f"word{k}" for k in range(1, 10_000, 2)))])
    df = spark.range(2000).select("id", F.concat(F.lit("see word"), "id", F.lit(" here")).alias("hay"))
    found = terms.find_groups(df, rules, ["hay"])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.id: r.groups for r in found.collect()} == {k: [k % 2] for k in range(2000)}


def test_a_table_of_ones_own_replaces_the_vocabulary(spark):
    rows = spark.createDataFrame(
        [("Ada Lovelace", "ada lovelace portrait.jpg", "ada lovelace"), ("Ada Lovelace", "ada lovelace robot.jpg", "Ada Lovelace the map")],
        "name string, filename string, caption string")
    score = lambda **o: [round(r.score, 6) for r in ranking.score_candidates(rows, **o).orderBy("filename").collect()]
    assert score() == score(table=terms.table(spark, ranking.Rules().groups()))
    own = terms.table(spark, [("hay", "penalty", 0.25, ("robot",)), ("file", "bonus", 0.02, ("ada",))])
    assert score(table=own) == [0.92, round(0.92 * 0.25, 6)]
    assert score(table=own.limit(0)) == [0.9, 0.9]
    assert [round(r.score, 6) for r in ranking.score_candidates(rows, floor=0.9, table=own).collect()] == [0.92]
