from __future__ import annotations

import os

import naive
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from maskwright import lineage
from maskwright.functions import boxes
from maskwright.operators import detections, enroll, greedy

BOX = "struct<x:double,y:double,width:double,height:double>"
PATHS = {
    "fold": {},
    "grouped": {"fold_rows": 0},
    "rounds": {"fold_rows": 0, "group_rows": 0, "block_rows": 5},
}


def random_boxes(seed, groups=4, most=25):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for i in range(int(rng.integers(1, most))):
            x, y, w, h = (float(v) for v in rng.integers(0, 30, 4))
            rows.append((g, i, float(rng.integers(0, 4)) / 4, (x, y, w + 1, h + 1)))
        rows.append((g, 100, 0.5, rows[-1][3]))
    return rows


@pytest.mark.parametrize("path", PATHS)
def test_suppression(spark, path):
    rows = random_boxes(1)
    df = spark.createDataFrame(rows, f"g int, i int, score double, box {BOX}")
    got = detections.suppress(df, ["g"], ["i"], 0.3, **PATHS[path]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        kept = naive.first_come([r[3] for r in mine], lambda a, b: naive.box_iou(a, b) > 0.3)
        want = [(mine[k][1], n + 1) for n, k in enumerate(kept)]
        assert sorted(((r.i, r.kept_ord) for r in got if r.g == g), key=lambda t: t[1]) == want


@pytest.mark.parametrize("path", PATHS)
def test_merge_keeps_every_existing_row(spark, path):
    rows = random_boxes(2)
    df = spark.createDataFrame(rows, f"g int, i int, score double, box {BOX}")
    first, second = df.where("score >= 0.5"), df.where("score < 0.5")
    got = detections.merge_passes(first, second, ["g"], ["i"], **PATHS[path]).collect()

    def centre_in(a, b):
        cx, cy = b[0] + b[2] / 2, b[1] + b[3] / 2
        return a[0] <= cx <= a[0] + a[2] and a[1] <= cy <= a[1] + a[3]

    same = lambda a, b: naive.box_iou(a, b) > 0.4 or centre_in(a, b) or centre_in(b, a)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] < 0.5, r[1]))
        kept = naive.first_come([r[3] for r in mine], same, [r[2] >= 0.5 for r in mine])
        assert {r.i for r in got if r.g == g} == {mine[k][1] for k in kept}


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 0, "block_rows": 4}])
def test_near_duplicates(spark, sizes):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 6))
    rows = []
    for name in ("a", "b"):
        for i in range(30):
            v = base[rng.integers(0, 5)] + rng.normal(size=6) * 0.3
            rows.append((name, i, [float(x) for x in naive.unit(v.astype(np.float32))]))
    df = spark.createDataFrame(rows, "name string, ord bigint, embedding array<float>")
    unique, dropped = enroll.drop_near_duplicates(df, ["name"], 0.9, **sizes)
    for name in ("a", "b"):
        mine = [r[2] for r in rows if r[0] == name]
        want = set(naive.first_come(mine, lambda a, b: naive.dot(a, b) >= 0.9))
        assert {r.ord for r in unique.where(F.col("name") == name).collect()} == want
        assert {r.ord for r in dropped.where(F.col("name") == name).collect()} == set(range(30)) - want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 12)] * 4), min_size=1, max_size=14), st.integers(0, 3))
def test_task_kernel_equals_model(raw, every):
    rows = np.array([(x, y, w + 1, h + 1) for x, y, w, h in raw], dtype=float)
    fixed = np.array([every > 0 and i % (every + 1) == 0 for i in range(len(rows))])
    keep = greedy._keep_in_order(rows, fixed, greedy.overlap_conflict(0.3))
    want = naive.first_come(list(map(tuple, rows)), lambda a, b: naive.box_iou(a, b) > 0.3, list(fixed))
    assert list(np.nonzero(keep)[0]) == want


def test_tiles_and_cascade(spark):
    one = (0.0, 0.0, 10.0, 10.0)
    det = lambda rows: spark.createDataFrame(rows, f"media_id int, i int, box {BOX}")
    media = spark.createDataFrame([(m,) for m in (1, 2, 3)], "media_id int")
    fast = det([(1, 0, one), (1, 1, (50.0, 0.0, 10.0, 10.0)), (2, 0, one)])
    full = det([(2, 0, (30.0, 0.0, 9.0, 9.0)), (3, 0, one)])
    tiles = det([(1, 0, (1.0, 1.0, 9.0, 9.0)), (1, 1, (90.0, 0.0, 5.0, 5.0)), (2, 0, (70.0, 0.0, 5.0, 5.0))])
    got = detections.cascade(media, fast, full, tiles, ["i"]).collect()
    assert sorted((r.media_id, r.box.x) for r in got) == [(1, 0.0), (1, 50.0), (1, 90.0), (2, 0.0), (3, 0.0)]
    images = spark.createDataFrame([(900, 600)], "width int, height int")
    grid = detections.tile_grid(images).collect()
    assert (0, 0, 300, 200) in {(t.ox, t.oy, t.tile_width, t.tile_height) for t in grid}
    assert all(t.tile_width >= 64 and t.tile_height >= 64 for t in grid)
    moved = det([(1, 0, one)]).withColumn("oy", F.lit(5)).withColumn("ox", F.lit(7))
    assert detections.merge_tiles(moved, ["media_id"], ["i"]).first().box.x == 7.0
    assert boxes is not None


def test_cascade_meets_once_and_equals_the_joined_path(spark):
    """Media of few rows take no join; unknown media, null ids and hot media change nothing."""
    rng = np.random.default_rng(4)
    ids = [None, *range(12)]

    def det(n, skip):
        rows = [(ids[m], i, tuple(map(float, rng.integers(1, 40, 4)))) for i, m in enumerate(rng.integers(0, 13, n)) if m not in skip]
        return spark.createDataFrame(rows, f"media_id int, i int, box {BOX}")

    fast, full, tiles = det(40, {3, 4, 5, 11}), det(60, {5, 6}), det(80, {7})
    media = spark.createDataFrame([(m,) for m in [None, *range(9), 3, 3]], "media_id int")
    result = detections.cascade(media, fast, full, tiles, ["i"])
    assert "Join" not in result._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((r.media_id is None, r.media_id, r.i, r.second_pass, r.kept_ord) for r in df.collect())
    want = rows(detections._joined_cascade(media, fast, full, tiles, ["i"], 2))
    assert rows(result) == want and len({r[1] for r in want}) > 9
    for limit in (1, 12, 15):
        assert rows(detections.cascade(media, fast, full, tiles, ["i"], fold_rows=limit)) == want


def test_odd_boxes_give_one_answer_on_every_path(spark):
    """NaN, infinite, null and negative boxes: the fold, the task and the rounds agree."""
    nan, inf = float("nan"), float("inf")
    odd = [
        (0.0, 0.0, 10.0, 10.0), (nan, 0.0, 10.0, 10.0), (1.0, 1.0, 10.0, 10.0), (0.0, nan, 10.0, 10.0),
        (0.0, 0.0, inf, 10.0), (-inf, 0.0, inf, 10.0), (0.0, 0.0, -5.0, 10.0), (5.0, 5.0, 0.0, 0.0),
        (0.0, 0.0, nan, 10.0), None, (0.0, None, 10.0, 10.0), (2.0, 2.0, 10.0, inf),
    ]
    rows = [(1, k, b, k % 3 == 0) for k, b in enumerate(odd)]
    kind = "media long, place int, box struct<x: double, y: double, width: double, height: double>, second boolean"
    df = spark.createDataFrame(rows, kind)
    paths = ({}, {"fold_rows": 1}, {"fold_rows": 1, "group_rows": 1, "block_rows": 3})
    for run in (
        lambda sizes: detections.suppress(df.withColumn("score", F.lit(1.0)), ["media"], ["place"], 0.3, **sizes),
        lambda sizes: detections.merge_passes(df.where("not second"), df.where("second"), ["media"], ["place"], **sizes),
    ):
        kept = [sorted(r.place for r in run(sizes).collect()) for sizes in paths]
        assert kept[0] == kept[1] == kept[2]
        assert {1, 3, 8} <= set(kept[0])


def test_boxes_of_a_large_group_only_meet_in_their_cells(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from maskwright.functions import boxes
    from maskwright.operators import detections, greedy

    rng = np.random.default_rng(7)
    n = 400
    x, y = rng.uniform(-4000, 4000, (2, n))
    w, h = 2.0 ** rng.uniform(0, 9, (2, n))
    w[::17] *= -1
    x[5], w[6] = np.nan, np.nan
    x[-60:], y[-60:], w[-60:], h[-60:] = 10.0, 20.0, 30.0, 40.0  # a pile in one cell
    rows = [(1, k, *map(float, v)) for k, v in enumerate(zip(x, y, w, h))]
    met = []
    real = greedy.blocks.pair_blocks

    def counted(df, keys, order, block_rows):
        met.append((list(keys), df.select("__ord").count()))
        return real(df, keys, order, block_rows)

    monkeypatch.setattr(greedy.blocks, "pair_blocks", counted)

    def kept(more=(), **sizes):
        df = spark.createDataFrame([*rows, *more], "media_id int, i int, x double, y double, w double, h double").select(
            "media_id", "i", boxes.box(*map(F.col, "xywh")).alias("box"), (F.lit(1.0) - F.col("i") / 1e4).alias("score"))
        return {r.i for r in detections.suppress(df, ["media_id"], ["i"], 0.1, **sizes).collect()}

    rounds = {"fold_rows": 1, "group_rows": 5, "block_rows": 9}
    assert kept(**rounds) == kept(fold_rows=1) and met and all("__cx" in keys for keys, n in met if n)
    met.clear()
    endless = [(1, 1000, 0.0, 0.0, float("inf"), 5.0)]
    assert kept(endless, **rounds) == kept(endless, fold_rows=1) and all("__cx" not in keys for keys, n in met if n)


def test_small_groups_are_selected_together():
    rng = np.random.default_rng(8)
    sizes = [1, 7, 2, 70, 5, 64, 3]
    at = np.r_[0, np.cumsum(sizes)]
    rows = rng.integers(0, 20, (at[-1], 4)).astype(float)
    rows[::9, 0] = np.nan
    fixed = rng.random(at[-1]) < 0.1
    calls = []
    for conflict in (greedy.overlap_conflict(0.3), greedy.same_face_conflict(0.4), greedy.cosine_conflict(0.9)):
        values = np.nan_to_num(rows) / 50 if "cosine" in conflict.__qualname__ else rows
        want = np.concatenate([
            greedy._keep_in_order(values[a:b], fixed[a:b], conflict) for a, b in zip(at[:-1], at[1:])
        ])
        counted = greedy._conflict(lambda a, b, c=conflict: calls.append(1) or c(a, b), conflict.pairs)
        assert (greedy._keep_in_groups(at, values, fixed, counted) == want).all()
    assert len(calls) <= 3 * 3  # matrices of the one group above SMALL_ROWS only


def test_rows_of_a_group_of_tiny_blocks_are_sent_to_few_tasks(spark):
    from maskwright.operators import blocks

    rows = spark.range(400).select(F.lit(1).alias("g"), F.col("id").alias("ord"))
    met = blocks.pair_blocks(rows, ["g"], "ord", 2)
    assert met.count() <= 400 * blocks.FEW_BLOCKS
    assert met.groupBy("ord").agg(F.count_distinct(blocks.LEFT, blocks.RIGHT).alias("n")).where(f"n > {blocks.FEW_BLOCKS}").count() == 0


def test_groups_stay_whole_beside_a_large_one(spark):
    """Small groups that lie in many input partitions, after the join that sets a large one aside."""
    rows = [(g, i, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(4) for g in range(3000)]
    rows += [(-1, i, [float(np.cos(i)), float(np.sin(i))]) for i in range(9)]
    df = lineage.cut(spark.createDataFrame(rows, "name long, ord long, embedding array<float>").repartition(16, "ord", "name"))
    # planned as a sort-merge join of several partitions, found to be small enough for a broadcast when it runs
    sizes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        unique, _ = enroll.drop_near_duplicates(df, ["name"], 0.9, group_rows=5, block_rows=3)
        found = unique.where("name >= 0").groupBy("ord").count().orderBy("ord").collect()
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert [tuple(r) for r in found] == [(0, 3000), (1, 3000)]


def test_groups_up_to_group_rows_are_neither_ranked_nor_written(spark, monkeypatch):
    rows = random_boxes(5)
    df = spark.createDataFrame(rows, f"g int, i int, score double, box {BOX}")
    want = sorted(map(str, detections.suppress(df, ["g"], ["i"], 0.3).collect()))
    monkeypatch.setattr(greedy, "rank_in_group", None)
    monkeypatch.setattr(greedy, "cut_packed", None)
    assert sorted(map(str, detections.suppress(df, ["g"], ["i"], 0.3, fold_rows=1).collect())) == want


def test_packed_rows_take_less_room_and_come_back(spark):
    df = spark.range(50_000).selectExpr(
        "id", "id % 7 as k", "named_struct('x', id % 97 + 0.5D) as box", "array(id % 5 + 0.0D, 1.0D) as f"
    )

    def room():
        folder = lineage.ensure_checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)

    start = room()
    lineage.cut(df)
    plain = room() - start
    packed = lineage.cut_packed(df)
    assert room() - start - plain < plain / 3
    assert packed.schema == df.schema and packed.exceptAll(df).count() == 0 and packed.count() == 50_000
