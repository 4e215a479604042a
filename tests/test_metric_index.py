from __future__ import annotations

import numpy as np
import pytest

from maskwright.operators import matching, metric_index


def clustered(rng, clusters, each, width, spread):
    centres = rng.normal(size=(clusters, width))
    rows = np.repeat(centres, each, 0) + spread * rng.normal(size=(clusters * each, width))
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def frames(spark, gallery, queries):
    rows = [
        (f"p{k % 40}", k % 40, "hard_negative" if k % 11 == 0 else "embedding", k, v.tolist()) for k, v in enumerate(gallery)
    ]
    known = spark.createDataFrame(rows, "identity_id string, identity_ord long, kind string, ord long, embedding array<float>")
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(queries)], "query_id long, embedding array<float>")
    return known, asked


@pytest.mark.parametrize("threshold", [0.7, 0.1, -0.5])
def test_index_equals_a_scan(spark, threshold):
    rng = np.random.default_rng(1)
    gallery = clustered(rng, 12, 40, 16, 0.1)
    gallery = np.concatenate((gallery, np.repeat(gallery[:1], 90, 0), np.zeros((2, 16), np.float32), 3 * gallery[5:9]))
    queries = np.concatenate((clustered(rng, 6, 4, 16, 0.3), gallery[:30], np.zeros((1, 16), np.float32), 7 * gallery[40:44]))
    known, asked = frames(spark, gallery, queries)
    options = {"default_threshold": threshold, "min_agreements": 3}
    whole = sorted(map(tuple, matching.score_queries(asked, known, **options).collect()))
    for part_rows in (25, 4000):
        found = matching.score_queries(asked, known, broadcast_bytes=0, part_rows=part_rows, **options)
        assert sorted(map(tuple, found.collect())) == whole


def test_most_partitions_are_skipped(spark):
    rng = np.random.default_rng(2)
    gallery, queries = clustered(rng, 60, 50, 32, 0.02), clustered(rng, 1, 30, 32, 0.01)
    known, asked = frames(spark, gallery, np.concatenate((queries, gallery[::300])))
    rules = matching.with_rules(known, None, 0.8, 1).selectExpr(
        "*", "kind = 'hard_negative' as negative", "threshold - if(kind = 'hard_negative', 0.02, 0) as bound"
    )
    index = metric_index.build(rules, 120, ["identity_ord", "kind", "ord"])
    visits = metric_index.visits(asked, index)
    made, possible = sum(r.queries for r in visits.collect()), len(index.sizes) * asked.count()
    assert made < 0.15 * possible and visits.count() < len(index.sizes)
    assert index.sizes.sum() == len(gallery)


def test_visits_are_counted_without_rows_and_handed_on_in_bounded_batches(spark):
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    gallery, queries = rng.normal(size=(2, 600, 16)).astype(np.float32)
    known, asked = frames(spark, gallery, queries)
    rules = matching.with_rules(known, None, -1.0, 1).selectExpr("*", "false as negative", "threshold as bound")
    index = metric_index.build(rules, 100, ["identity_ord", "kind", "ord"])
    routed = metric_index.route(asked, index, metric_index.reaching_bound)
    rows = {r.cell: r["count"] for r in routed.groupBy("cell").count().collect()}
    assert metric_index.counted(asked, index) == rows and sum(rows.values()) > 3 * metric_index.VISITS

    context = SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))
    batch = pa.table({"query_id": np.arange(600), "embedding": pa.array(queries.tolist(), pa.list_(pa.float32()))}).to_batches()
    local = SimpleNamespace(
        schema=asked.schema, sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, _: list(run(iter(batch)))
    )
    made = [b.num_rows for b in metric_index.route(local, index, metric_index.reaching_bound)]
    assert sum(made) == sum(rows.values()) and max(made) <= metric_index.VISITS


def test_rings_out_of_reach_are_not_scored():
    import pyarrow as pa

    angle = np.sort(np.linspace(0, 1.2, 5000))
    vectors = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    columns = {c: pa.array(np.zeros(5000)) for c in metric_index._TYPES} | {"angle": pa.array(angle), "norm": pa.array(np.ones(5000))}
    table = pa.table(columns | {"embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), 2).cast(pa.list_(pa.float32()))})
    rings = metric_index._Rings(table, np.array([1.0, 0.0]))
    upper = [u[0] for u, _ in rings.reachable(np.array([[1.0, 0.0]], np.float32))]
    assert len(upper) == 5 and upper == sorted(upper, reverse=True) and upper[0] >= 1 and upper[-1] < 0.7
