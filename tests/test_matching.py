from __future__ import annotations

import math

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import vectors
from maskwright.operators import matching

GALLERY = "identity_id string, identity_ord bigint, kind string, ord bigint, embedding array<float>"


def random_units(rng, n, width=8):
    v = rng.normal(size=(n, width)).astype(np.float32)
    return [[float(x) for x in naive.unit(r)] for r in v]


def make(seed, n_ids=6, n_queries=40):
    rng = np.random.default_rng(seed)
    shared = random_units(rng, 1)[0]
    identities, rows, thresholds = [], [], []
    for i in range(n_ids):
        ident = {
            "id": f"id-{i}",
            "embeddings": random_units(rng, int(rng.integers(0, 5))) + ([shared] if i % 2 else []),
            "prototypes": random_units(rng, 2) if i % 3 == 0 else [],
            "negatives": random_units(rng, 3) if i % 2 else [],
            "threshold": [0.2, 0.5, float("nan"), None, float("inf"), 0.3][i % 6],
        }
        identities.append(ident)
        thresholds.append((ident["id"], ident["threshold"]))
        for kind, key in (("embedding", "embeddings"), ("prototype", "prototypes"), ("hard_negative", "negatives")):
            rows += [(ident["id"], i, kind, o, v) for o, v in enumerate(ident[key])]
    queries = random_units(rng, n_queries) + [shared, [0.0] * 8]
    return identities, rows, thresholds, queries


@pytest.mark.parametrize("agreements", [1, 3])
@pytest.mark.parametrize("blocked", [False, True])
def test_match_equals_model(spark, agreements, blocked):
    identities, rows, thresholds, queries = make(agreements)
    gallery = spark.createDataFrame(rows, GALLERY)
    limits = spark.createDataFrame(thresholds, "identity_id string, threshold double")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, embedding array<float>")
    sizes = {"broadcast_bytes": 0, "block_rows": 4} if blocked else {}
    got = matching.score_queries(
        q, gallery, limits, default_threshold=0.25, min_agreements=agreements, **sizes
    ).collect()
    assert len(got) == len(queries)
    for row in got:
        want = naive.match(queries[row.query_id], identities, 0.25, agreements, 0.02)
        assert (row.identity_id, row.score) == (want or (None, None))
        everything = [
            (naive.dot(queries[row.query_id], g), -i, ident["id"])
            for i, ident in enumerate(identities)
            for g in (ident["prototypes"] or ident["embeddings"])
        ]
        top = max(everything)
        assert (row.best_cosine, row.best_identity_id) == (top[0], top[2])


def test_empty_gallery_and_agreement_floor(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    empty = spark.createDataFrame([], GALLERY)
    assert matching.match(q, empty).count() == 0
    assert matching.best_cosine(q, empty).first().best_cosine is None
    with pytest.raises(ValueError):
        matching.match(q, empty, min_agreements=0)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 3}])
def test_top_k(spark, sizes):
    _, rows, _, queries = make(9)
    gallery = spark.createDataFrame(rows, GALLERY)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, embedding array<float>")
    got = matching.top_k_cosines(q, gallery, 2, **sizes).collect()
    want = {}
    for i, v in enumerate(queries):
        for ident, _, _, _, g in rows:
            want.setdefault((i, ident), []).append(naive.dot(naive.unit(v), g))
    expected = {
        (k, r + 1, s) for k, ss in want.items() for r, s in enumerate(sorted(ss, reverse=True)[:2])
    }
    assert {((r.query_id, r.identity_id), r["rank"], r.cosine) for r in got} == expected


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 3}])
def test_top_k_padded_of_a_query_id_that_is_there_twice(spark, sizes):
    one, two = [1.0, 0.0], [0.0, 1.0]
    gallery = spark.createDataFrame(
        [("a", 0, "prototype", 0, one), ("a", 0, "prototype", 1, two), ("b", 1, "prototype", 0, one)], GALLERY
    )
    q = spark.createDataFrame([(7, one), (7, two), (8, one)], "query_id bigint, embedding array<float>")
    got = matching.top_k_cosines(q, gallery, 3, pad=True, **sizes).collect()
    none = -math.inf
    want = {(7, "a"): [1, 1, 0], (7, "b"): [1, 0, none], (8, "a"): [1, 0, none], (8, "b"): [1, none, none]}
    assert sorted((r.query_id, r.identity_id, r["rank"], r.cosine) for r in got) == sorted(
        (q, i, n + 1, float(s)) for (q, i), scores in want.items() for n, s in enumerate(scores)
    )


def test_sanitize_gallery(spark):
    good, bad = [1.0, 0.0], [2.0, 0.0]
    rows = [
        ("a", 0, "embedding", 0, good), ("a", 0, "embedding", 1, bad),
        ("b", 1, "embedding", 0, [0.0, 0.0]), ("b", 1, "hard_negative", 0, good),
        ("c", 2, "embedding", 0, [float("nan"), 1.0]), ("c", 2, "prototype", 0, good),
        ("d", 3, "embedding", 0, [1.0, 0.0, 0.0]),
    ]
    clean, status = matching.sanitize_gallery(spark.createDataFrame(rows, GALLERY), 2)
    assert {(r.identity_id, r.status) for r in status.collect()} == {
        ("a", "degraded"), ("b", "dropped"), ("c", "degraded"), ("d", "dropped")
    }
    assert {(r.identity_id, r.kind) for r in clean.collect()} == {("a", "embedding"), ("c", "prototype")}


def test_vector_faults(spark):
    rows = [
        ("ok", [0.6, 0.8]), ("zero", [0.0, 0.0]), ("not-unit", [1.0, 1.0]), ("not-finite", [1e40, 0.0]),
        ("not-finite", [float("nan"), 0.0]), ("not-finite", [None, 1.0]), ("width", [1.0]), ("missing", None),
    ]
    df = spark.createDataFrame(rows, "want string, v array<double>")
    fault = F.coalesce(vectors.embedding_fault(F.col("v"), 2), F.lit("ok"))
    for r in df.select("want", fault.alias("got")).collect():
        assert r.got == r.want


def test_dot_rejects_different_widths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="widths differ"):
        df.select(vectors.dot(F.col("a"), F.col("b"))).collect()
    n = df.select(vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert n.z == [0.0, 0.0]


def test_analyse_media_keeps_media_without_faces(spark):
    media = spark.createDataFrame([(1, 100.0, 50.0), (2, 10.0, 10.0)], "media_id int, width double, height double")
    dets = spark.createDataFrame(
        [(1, 0, 7, (90.0, 40.0, 10.0, 10.0))],
        "media_id int, det_ord int, query_id int, box struct<x:double,y:double,width:double,height:double>",
    )
    found = spark.createDataFrame([(7, "a", 0.9)], "query_id int, identity_id string, score double")
    regions, summary = matching.analyse_media(media, dets, found)
    r = regions.first().region
    assert (r.x, r.y) == (89.0, 38.75)
    assert math.isclose(r.width, 11.0) and math.isclose(r.height, 11.25)
    assert {(s.media_id, s.face_count, s.region_count) for s in summary.collect()} == {(1, 1, 1), (2, 0, 0)}


def _gallery(spark, rows):
    return spark.createDataFrame(
        [(f"i{o}", o, kind, k, v) for o, kind, k, v in rows],
        "identity_id string, identity_ord long, kind string, ord long, embedding array<float>",
    )


@pytest.mark.parametrize("bad", [[1.0], None, [1.0, 0.0, 0.0, 0.0]])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 1}])
def test_ragged_and_null_vectors_are_errors(spark, bad, sizes):
    from maskwright.operators import blocks

    known = _gallery(spark, [(0, "embedding", 0, [1.0, 0.0]), (1, "embedding", 0, [0.0, 1.0])])
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, bad)], "query_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="width"):
        matching.match(asked, known, default_threshold=0.5, min_agreements=1, **sizes).collect()
    with pytest.raises(Exception, match="width|size"):
        matching.top_k_cosines(asked, known, 1, **sizes).collect()
    usable, rejected = matching.reject_vectors(asked, 2)
    assert [r.query_id for r in rejected.collect()] == [2]
    assert [r.identity_id for r in matching.match(usable, known, default_threshold=0.5, min_agreements=1, **sizes).collect()] == ["i0"]
    import pyarrow as pa

    assert blocks.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1)).tolist() == [[3.0, 4.0]]


def test_pile_of_copies_is_reduced_strip_by_strip(monkeypatch):
    from maskwright.operators import blocks

    seen = []
    plain = blocks.pairs_at_least
    monkeypatch.setattr(blocks, "pairs_at_least", lambda a, b, bound: seen.append(len(a) * len(b)) or plain(a, b, bound))
    import pyarrow as pa

    n = 3000
    rows = pa.table({
        "embedding": [[1.0, 0.0]] * n, "identity_ord": [k % 3 for k in range(n)], "kind": ["embedding"] * n,
        "threshold": [0.5] * n, "need": [1] * n,
    })
    found = matching._partial_matches(np.tile(np.float32([1, 0]), (4000, 1)), matching._Gallery(rows), 0.02)
    assert max(seen) <= 4_000_000 and len(found["row"]) == 12_000 and set(found["agree"]) == {1000}


def test_latest_revision_decides(spark):
    media = spark.createDataFrame([(1,)], "media_id long")
    states = spark.createDataFrame([(True, 1), (False, 3), (True, 2)], "enabled boolean, revision long")
    assert matching.enabled_only(media, states).count() == 0
    assert matching.enabled_only(media, states.where("revision < 3")).count() == 1


def test_blocks_settle_each_identity_in_its_task(spark):
    """Blocks of queries hand on one row per query and identity, however small the parts are."""
    rng = np.random.default_rng(5)
    known = _gallery(spark, [(o, "embedding", k, rng.normal(size=4).tolist()) for o in range(3) for k in range(40)])
    asked = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "query_id long, embedding array<float>")
    rows = known.select("identity_ord", "embedding")
    tally = lambda ids, vectors: matching._TopTally(ids, vectors, 2, 3)
    found = matching._meet_in_blocks(asked, rows, tally, "query_id long, identity_ord long, cosine double", 4)
    assert found.count() == 30 * 3 * 2
    rules = matching.with_rules(known, None, 0.1, 2)
    for visits in (0, 10**9):  # blocks instead of an index that leaves out nothing, and the index itself
        before, matching.MANY_VISITS = matching.MANY_VISITS, visits
        whole = matching._score_by_index(asked, rules, 0.02, True, True, 3, 120).orderBy("query_id").collect()
        matching.MANY_VISITS = before
        plain = matching._score_broadcast(asked, rules, 0.02, True, True).orderBy("query_id").collect()
        assert whole == plain
