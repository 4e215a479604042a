from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import hard_negatives as hn


def points_of(kind, n, rng):
    if kind == "spread":
        return rng.integers(-300, 300, (n, 24)).astype(float)
    if kind == "clusters":
        return np.repeat(rng.integers(-300, 300, (n // 20 + 1, 24)), 20, 0)[:n] + rng.integers(-9, 9, (n, 24)).astype(float)
    return np.repeat(rng.integers(-3, 3, (3, 24)), n, 0)[:n].astype(float)  # copies


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_search_equals_a_scan(kind):
    rng = np.random.default_rng(3)
    points = points_of(kind, 600, rng)
    ids = rng.permutation(10_000)[:600]
    tree = hn.CoverTree.unpack(hn.CoverTree.build(ids, points).pack())
    visits = []
    for query in [*points[:20], *rng.integers(-300, 300, (20, 24)).astype(float), np.zeros(24)]:
        exact = (points @ query).astype(int)
        one = hn.Search(tree, query, int(ids[7]))
        for low, high in [(-(1 << 62), 1 << 62), (0, 10**5), (int(exact.mean()), int(exact.max()) - 1), (5, 4)]:
            kept = sorted(((s, -i) for s, i in zip(exact.tolist(), ids.tolist()) if low <= s <= high and i != ids[7]), reverse=True)
            assert one.best(3, low, high, []) == kept[:3]
            assert one.best(3, low, high, [(high, -5)]) == sorted([*kept, (high, -5)], reverse=True)[:3]
        visits.append(one.visited)
    assert all((tree.first[n] + tree.count[n] <= len(tree.center)) for n in range(len(tree.center)))


def test_clusters_are_skipped_whole():
    rng = np.random.default_rng(4)
    points = points_of("clusters", 2000, rng)
    tree = hn.CoverTree.build(np.arange(2000), points)
    one = hn.Search(tree, points[0])
    one.best(3, -(1 << 62), 1 << 62, [])
    assert one.visited < 500


def brute_force(rows, labels):
    good = {}
    for vec, label, v in rows:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (labels(vec, label), [math.floor(256 * x) for x in v])
        good[vec] = min(good.get(vec, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in good:
        if a % 50:
            continue
        scored = [(-dot(good[a][1], good[o][1]), o) for o in good if o != a]
        same = sorted(x for x in scored if good[x[1]][0] == good[a][0])[:5]
        for s, p in same:
            other = sorted(x for x in scored if good[x[1]][0] != good[a][0] and -50 * s <= -100 * x[0] <= -95 * s)[:3]
            out += [(a, p, r + 1, o, -s, -n) for r, (n, o) in enumerate(other)]
    return out


def mined(frame, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hn.mine(hn.usable(frame, relabel=label), F.col("id") % 50 == 0, **sizes).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "part_bytes": 900}])
def test_odd_rows_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 4)), (rng.normal(size=6) + 1).tolist()) for k in range(320)]
    rows += [(400, 1, [0.0] * 6), (401, None, [1.0]), (402, 1, None), (None, 1, [1.0]), (403, 1, [float("nan")]), (404, 1, [1.0, None])]
    rows += [(405, 2, [float("inf")]), (450, 2, [1.0, 2.0]), (406, 2, [3.0] * 9), (407, 1, []), (3, 0, [5.0]), *rows[:9], (500, -7, [2.0, 1.0])]
    rows += [(k, 2, [1.0, 1.0, 0.5]) for k in range(600, 640)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, id string")
    labels = lambda vec, label: int(math.fmod(label + 1, 10)) if vec % 7 == 0 else label
    assert mined(frame, **sizes) == sorted(brute_force(rows, labels))
    assert mined(frame.limit(0)) == []


def test_vectors_too_long_for_exact_products_are_an_error(spark):
    frame = spark.createDataFrame([(50, 1, [1e9]), (51, 1, [1e9])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="squared norm"):
        mined(frame)
