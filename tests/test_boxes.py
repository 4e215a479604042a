from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import boxes
from maskwright.operators import chips, detections, reports

BOX = "struct<x:double,y:double,width:double,height:double>"
POINTS = "array<struct<x:double,y:double>>"


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def b(*v):
    return boxes.box(*[float(x) for x in v])


def test_overlap_edges(spark):
    assert one(spark, boxes.iou(b(0, 0, 10, 10), b(0, 0, 10, 10))) == 1.0
    assert one(spark, boxes.iou(b(0, 0, 10, 10), b(10, 0, 10, 10))) == 0.0
    assert one(spark, boxes.iou(b(0, 0, -5, 10), b(-5, 0, 10, 10))) == 0.0
    assert one(spark, boxes.iou(b(0, 0, 10, 10), b(5, 0, 10, 10))) == pytest.approx(1 / 3)
    assert one(spark, boxes.contains(b(0, 0, 10, 10), boxes.center(b(10, 10, 0, 0)))) is True


@pytest.mark.parametrize(
    "value, x, y",
    [
        ("left", (0, 0, False), (50, 0, False)), ("10px", (0, 10, False), (50, 0, False)),
        ("right 10px top 5%", (0, 10, True), (5, 0, False)), ("top right", (0, 0, True), (0, 0, False)),
        ("center 20%", (50, 0, False), (20, 0, False)), ("1em 7px", (0, 7, False), (50, 0, False)),
        ("-3.5px 0", (0, -3.5, False), (0, 0, False)), (None, (50, 0, False), (50, 0, False)),
        ("bottom 10px", (50, 0, False), (0, 10, True)),
    ],
)
def test_positions(spark, value, x, y):
    got = one(spark, boxes.parse_position(F.lit(value).cast("string")))
    assert (tuple(got.x), tuple(got.y)) == (x, y)


def test_similarity_degenerate(spark):
    pts = lambda *p: F.array(*[boxes.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    t = one(spark, boxes.similarity_transform(pts((1, 1)), pts((5, 5))))
    assert tuple(t) == (1, 0, 0, 0)
    t = one(spark, boxes.similarity_transform(pts((1, 1), (1, 1)), pts((5, 6), (5, 6))))
    assert tuple(t) == (1, 0, 4, 5)
    t = one(spark, boxes.similarity_transform(pts((0, 0), (1, 0)), pts((0, 0), (0, 2), (9, 9))))
    assert [round(v, 9) for v in t] == [0, 2, 0, 0]


def test_decode_skips_missing_tensors(spark):
    zeros = lambda n: [0.0] * n
    cls, obj = zeros(4), zeros(4)
    cls[2], obj[2] = 0.81, 1.0
    rows = [(1, 8, 2, cls, obj, zeros(16), zeros(40)), (1, 16, 2, cls, None, zeros(16), zeros(40))]
    df = spark.createDataFrame(
        rows, "m int, stride int, side int, cls array<float>, obj array<float>, bbox array<float>, kps array<float>"
    )
    got = detections.decode_tensors(df, ["m"], 0.5).collect()
    assert [(r.stride, r.cell, tuple(r.box)) for r in got] == [(8, 2, (-4.0, 4.0, 8.0, 8.0))]
    assert tuple(got[0].landmarks[4]) == (0.0, 8.0) and got[0].score == pytest.approx(0.9, abs=1e-6)


def naive_chip(pixels, box, marks, size):
    """Loops over every chip pixel, whole image in hand."""
    h, w, _ = pixels.shape
    at = lambda y, x: pixels[y, x] if 0 <= y < h and 0 <= x < w else np.zeros(3)

    def bilinear(y, x, img):
        y0, x0 = math.floor(y), math.floor(x)
        fy, fx = y - y0, x - x0
        return (img(y0, x0) * (1 - fx) * (1 - fy) + img(y0, x0 + 1) * fx * (1 - fy)
                + img(y0 + 1, x0) * (1 - fx) * fy + img(y0 + 1, x0 + 1) * fx * fy)

    out = np.zeros((size, size, 3))
    if marks is not None:
        src = np.array(marks, dtype=float)
        dst = np.array(boxes.TEMPLATE_POINTS) * size / 112
        u, v = src - src.mean(0), dst - dst.mean(0)
        den = (u * u).sum()
        a, bb = (u * v).sum() / den, (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / den
        m = np.array([[a, -bb], [bb, a]])
        shift = dst.mean(0) - m @ src.mean(0)
        for dy in range(size):
            for dx in range(size):
                x, y = np.linalg.solve(m, np.array([dx, dy]) - shift)
                out[dy, dx] = bilinear(y, x, at)
        return out
    x, y, bw, bh = box
    cx, cy = x + bw / 2, y + bh / 2
    x0, y0 = max(0, math.floor(cx - bw * 0.6)), max(0, math.floor(cy - bh * 0.6))
    x1, y1 = min(w, math.ceil(cx + bw * 0.6)), min(h, math.ceil(cy + bh * 0.6))
    if x1 <= x0 or y1 <= y0:
        return out
    crop = pixels[y0:y1, x0:x1]
    ch, cw = crop.shape[:2]
    edge = lambda yy, xx: crop[min(yy, ch - 1), min(xx, cw - 1)]
    for dy in range(size):
        for dx in range(size):
            sy = min(max((dy + 0.5) * ch / size - 0.5, 0), ch - 1)
            sx = min(max((dx + 0.5) * cw / size - 0.5, 0), cw - 1)
            out[dy, dx] = bilinear(sy, sx, edge)
    return out


def test_chips_equal_full_image_loops(spark):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (14, 18, 3)).astype(np.uint8)
    images = spark.createDataFrame([(1, 18, 14, bytearray(pixels.tobytes()))], "media_id int, width int, height int, data binary")
    faces = [
        ((4.0, 3.0, 6.0, 5.0), None), ((15.0, 10.0, 9.0, 9.0), None), ((40.0, 40.0, 3.0, 3.0), None),
        ((0.0, 0.0, 5.0, 5.0), [(3.0, 4.0), (9.0, 4.5), (6.0, 7.0), (4.0, 9.0), (8.5, 9.5)]),
        ((0.0, 0.0, 5.0, 5.0), [(-3.0, 2.0), (16.0, 9.0), (9.0, 9.0), (2.0, 15.0), (12.0, 20.0)]),
    ]
    df = spark.createDataFrame(
        [(1, i, box, marks) for i, (box, marks) in enumerate(faces)], f"media_id int, det_ord int, box {BOX}, landmarks {POINTS}"
    )
    got = {r.det_ord: r.chip for r in chips.face_chips(images, df, size=12).collect()}
    for i, (box, marks) in enumerate(faces):
        want = naive_chip(pixels[..., ::-1].astype(float), box, marks, 12)
        want = ((want - 127.5) / 127.5).transpose(2, 0, 1).reshape(-1)
        assert np.allclose(got[i], want, atol=1e-4), i


def test_batch_inference_loads_once_per_task(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)] + [(99, [0.0, -1.0])], "k int, t array<float>")

    def load():
        return lambda x: x + np.array([0.0, 1.0])

    out = chips.batch_inference(df, ["k"], "t", load)
    good, bad = chips.checked_embeddings(out, ["k"], 2)
    assert [(r.k, r.reason) for r in bad.collect()] == [(99, "zero")]
    r = good.where("k = 3").first()
    assert np.allclose(r.embedding, np.array([3.0, 2.0]) / math.sqrt(13))


def test_coverage_crosses_grid_cells(spark):
    masks = spark.createDataFrame([("p", (100.0, 100.0, 300.0, 10.0)), ("p", (0.0, 0.0, 0.0, 9.0))], f"page string, box {BOX}")
    targets = spark.createDataFrame(
        [("p", 1, (390.0, 105.0, 50.0, 50.0)), ("p", 2, (401.0, 100.0, 5.0, 5.0)), ("q", 3, (100.0, 100.0, 5.0, 5.0))],
        f"page string, target_id int, box {BOX}",
    )
    got = reports.mask_coverage(masks, targets, "page").collect()
    assert {r.target_id: r.covered for r in got} == {1: True, 2: False, 3: False}


def test_rows_are_not_dealt_out_by_position(spark, capsys):
    from maskwright.plans import box_queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        box_queries.box_position(spark, "/root/testdata/sf0.001").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cells_of_tensors_of_unequal_length(spark):
    rows = [
        (0, 8, 2, [1.0] * 5, [1.0] * 5), (1, 8, 2, [1.0] * 3, [1.0] * 4), (2, 8, 2, [], []),
        (3, 8, 0, [1.0], [1.0]), (4, 8, 2, None, [1.0] * 4), (5, 8, 2, [1.0], [1.0] * 4),
    ]
    df = spark.createDataFrame(
        [(*r, [0.0] * 16, [0.0] * 40) for r in rows],
        "m int, stride int, side int, cls array<float>, obj array<float>, bbox array<float>, kps array<float>",
    )
    cells = lambda least: sorted((r.m, r.cell) for r in detections.decode_tensors(df, ["m"], least).collect())
    assert cells(0.5) == [(0, i) for i in range(4)] + [(1, i) for i in range(3)] + [(5, 0)]
    assert cells(0.0) == [(m, i) for m in (0, 1, 5) for i in range(4)]


def test_costly_rows_are_dealt_by_their_number(spark):
    from maskwright.lineage import spread

    assert spread(spark.range(1000, numPartitions=1), 40).rdd.getNumPartitions() == 25


def test_chips_of_a_batch_are_drawn_in_parts(spark, monkeypatch):
    from maskwright.operators import chips

    rows = spark.range(40).selectExpr("id AS media_id")
    images = rows.select("media_id", F.lit(2).alias("width"), F.lit(2).alias("height"), F.unhex(F.lit("0a" * 12)).alias("data"))
    found = rows.select(
        "media_id", F.lit(0).alias("det_ord"), boxes.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)).alias("box"),
        F.lit(None).cast("array<struct<x:double,y:double>>").alias("landmarks"),
    )
    whole = sorted(map(tuple, chips.face_chips(images, found, size=4).collect()))
    monkeypatch.setattr(chips, "CHIP_VALUES", 100)  # two chips
    assert sorted(map(tuple, chips.face_chips(images, found, size=4).collect())) == whole and len(whole) == 40
