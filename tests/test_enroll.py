from __future__ import annotations

import duckdb
import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import components, enroll

FACES = "name string, ord bigint, embedding array<float>"


def faces(seed, names=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    rows = []
    for k, name in enumerate(names):
        centre = rng.normal(size=(3, 5))
        vectors = [centre[rng.integers(0, 3)] + rng.normal(size=5) * 0.4 for _ in range(6 + 5 * k)]
        vectors += [vectors[0]] * 3 + [np.zeros(5)] * 2
        rows += [(name, i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    return rows


def groups(rows):
    out = {}
    for name, _, v in rows:
        out.setdefault(name, []).append(v)
    return out


@pytest.mark.parametrize("block_rows", [4096, 3])
@pytest.mark.parametrize("min_cluster", [3, 99])
def test_graph_and_cluster(spark, block_rows, min_cluster):
    rows = faces(min_cluster)
    df = spark.createDataFrame(rows, FACES)
    graph = enroll.similarity_graph(df, ["name"], 1 - 0.2, block_rows)
    picked = enroll.pick_cluster(graph, ["name"], min_cluster)
    for name, vectors in groups(rows).items():
        degree, label, reason = naive.cluster(vectors, 0.2, min_cluster)
        got = {r.ord: (r.degree, r.component) for r in graph.where(F.col("name") == name).collect()}
        assert got == {i: (degree[i], label[i]) for i in range(len(vectors))}
        verdict = {r.ord: r.reason for r in picked.where(F.col("name") == name).collect()}
        assert verdict == reason


@pytest.mark.parametrize("group_rows", [4096, 0])
def test_prototypes(spark, group_rows):
    rows = [r for r in faces(5)]
    df = spark.createDataFrame(rows, FACES)
    got = enroll.prototypes(df, ["name"], 5, group_rows)
    for name, vectors in groups(rows).items():
        assert {r.ord for r in got.where(F.col("name") == name).collect()} == naive.prototypes(vectors, 5)


def test_cluster_faces_single_and_empty(spark):
    one = spark.createDataFrame([("solo", 4, [1.0, 0.0])], FACES)
    r = enroll.cluster_faces(one, ["name"]).first()
    assert (r.kept, r.reason, r.is_prototype) == (True, None, True)
    assert enroll.cluster_faces(one.limit(0), ["name"]).count() == 0


def test_components_of_a_long_chain_and_random_graph(spark):
    rng = np.random.default_rng(1)
    edges = [("chain", i, i + 1) for i in range(60)] + [
        ("rand", int(a), int(b)) for a, b in rng.integers(0, 80, (70, 2)) if a != b
    ]
    df = spark.createDataFrame(edges, "g string, node bigint, root bigint")
    got = components.connected_components(df, ["g"]).collect()
    for g in ("chain", "rand"):
        mine = [(a, b) for n, a, b in edges if n == g]
        nodes = {x for e in mine for x in e}
        assert {r.node: r.component for r in got if r.g == g} == naive.components(nodes, mine)


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_pairs_collapse_copies(spark, block_rows):
    rows = faces(8, ("a",))
    got = enroll.similar_pairs(spark.createDataFrame(rows, FACES), ["name"], 0.7, block_rows).collect()
    first = {}
    for i, (_, _, v) in enumerate(rows):
        first.setdefault(tuple(v), i)
    ids = sorted(first.values())
    u = {i: naive.unit(rows[i][2]) for i in ids}
    want = {(i, j) for i in ids for j in ids if i < j and naive.dot(u[i], u[j]) >= 0.7}
    assert {(r.ord_a, r.ord_b) for r in got} == want


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_pairs_of_copies_are_all_there(spark, block_rows):
    rows = faces(8, ("a",))
    rows += [(name, len(rows) + i, v) for i, (name, _, v) in enumerate(rows)]
    got = enroll.similar_pairs(spark.createDataFrame(rows, FACES), ["name"], 0.7, block_rows, copies=True).collect()
    u = [naive.unit(v) for _, _, v in rows]
    want = [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if naive.dot(u[i], u[j]) >= 0.7]
    assert sorted((r.ord_a, r.ord_b) for r in got) == want


@pytest.mark.parametrize("query", ["similarity_join", "similarity_join_blocks"])
def test_similarity_join_on_repeated_vectors_equals_its_sql(spark, tmp_path, query):
    from maskwright.plans import all_queries
    from tools import check

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    again = rows.withColumn("vec_id", F.col("vec_id") + 1_000_000)
    rows.unionByName(again).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = all_queries.QUERIES[query](spark, str(tmp_path))
    assert check.compare(found, con, all_queries.ORACLES[query]).startswith("ok")


def test_far_cells_never_meet(spark):
    """Tight clusters in a group of many blocks: fewer block pairs, the same graph."""
    from maskwright.operators import blocks

    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        v = np.eye(12)[i % 12] + rng.normal(size=12) * 0.03
        rows.append(("g", i, [float(np.float32(x)) for x in v]))
    rows.append(("g", 240, [0.0] * 12))
    df = spark.createDataFrame(rows, FACES)
    near = blocks.near_blocks(df, ["name"], "ord", "embedding", 0.8, 10)
    every = blocks.pair_blocks(df, ["name"], "ord", 10)
    assert near.count() < every.count() / 3
    graph = enroll.similarity_graph(df, ["name"], 0.8, 10).collect()
    degree, label, _ = naive.cluster([r[2] for r in rows], 0.2, 3)
    assert {r.ord: (r.degree, r.component) for r in graph} == {i: (degree[i], label[i]) for i in range(241)}


def test_preview_accounts_for_every_candidate(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=5)
    vec = lambda v: [float(x) for x in naive.unit(np.asarray(v, dtype=np.float32))]
    good = [vec(centre + rng.normal(size=5) * 0.6) for _ in range(5)]
    rows = [("p", i, v) for i, v in enumerate(good)]
    rows += [("p", 5, good[0]), ("p", 6, vec(-centre)), ("p", 7, None), ("p", 8, good[1]), ("p", 8, good[2])]
    faces_df = spark.createDataFrame(rows, FACES)

    cands = spark.range(9).select(
        F.lit("p").alias("name"), F.col("id").alias("ord"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.lit("t").alias("thumb_url"), F.lit("f").alias("filename"), F.lit("commons").alias("source"),
        F.lit(0.9).alias("score"),
    )
    done = spark.createDataFrame([("p", False)], "name string, complete boolean")
    kept, rejected, counted = enroll.build_preview(cands, faces_df, done)
    reasons = {(r.url, r.reason) for r in rejected.collect()}
    assert {("u5", "duplicate"), ("u6", "outlier"), ("u7", "0 faces"), ("u8", "2 faces")} <= reasons, reasons
    assert ("", "search-incomplete") in reasons
    assert {r.url for r in kept.collect()} <= {f"u{i}" for i in range(5)}
    row = counted.first()
    assert (row.candidates_tried, row.faces_found) == (9, 7)



def test_curated_and_confirm(spark):
    refs = spark.createDataFrame(
        [("x", "X Y", 0, "samples/a.jpg", None), ("x", "X Y", 1, "samples/b.jpg", "own")],
        "identity_id string, name string, ord int, path string, source string",
    )
    found = spark.createDataFrame(
        [("x", 0, [1.0, 0.0]), ("x", 1, [1.0, 0.0]), ("x", 1, [0.0, 1.0])],
        "identity_id string, ord int, embedding array<float>",
    )
    kept, rejected = enroll.curated_preview(refs, found)
    assert [(r.filename, r.source, r.score) for r in kept.collect()] == [("a.jpg", "curated", 1.0)]
    assert [(r.url, r.reason) for r in rejected.collect()] == [("samples/b.jpg", "2 faces")]
    faces_df = spark.createDataFrame(
        [(" X Y ", 0, "u", [1.0, 0.0]), ("Új", 0, "u", [0.0, 1.0]), ("  ", 0, "u", [0.0, 1.0])],
        "name string, ord int, url string, embedding array<float>",
    )
    known = spark.createDataFrame([("X Y", "x")], "name string, identity_id string")
    ids, gallery = enroll.confirm(faces_df, known, now_ms=5)
    assert {(r.name, r.identity_id) for r in ids.collect()} == {("X Y", "x"), ("Új", "j")}
    assert gallery.count() == 2


def test_pairs_of_a_task_come_in_parts(spark, monkeypatch):
    from maskwright.operators import blocks

    strips = blocks.strips
    monkeypatch.setattr(blocks, "strips", lambda rows, columns, cells: strips(rows, columns, 300))
    seen = []
    found = blocks.pairs_at_least
    unit = blocks.unit_rows(np.random.default_rng(3).normal(size=(60, 8)).astype(np.float32))
    monkeypatch.setattr(blocks, "pairs_at_least", lambda a, b, m: (seen.append(len(a)), found(a, b, m))[1])
    faces = spark.createDataFrame([("n", i, v.tolist()) for i, v in enumerate(unit)], "name string, ord int, embedding array<float>")
    got = sorted((r.ord_a, r.ord_b) for r in enroll.similar_pairs(faces, ["name"], 0.3, block_rows=20).collect())
    exact = blocks.exact_dots(np.repeat(unit, 60, 0), np.tile(unit, (60, 1))).reshape(60, 60)
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60) if exact[a, b] >= 0.3]
