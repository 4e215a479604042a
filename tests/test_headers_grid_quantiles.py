from __future__ import annotations

import math
import random
import struct

from pyspark.sql import functions as F

from maskwright.functions import boxes, images
from maskwright.operators import reports
from maskwright.sources import media


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + b"\x03"


def test_header_sizes(spark):
    app = b"\xff\xe1" + struct.pack(">H", 60_000) + b"\xff\xc0" * 29_999  # frames inside a segment are none
    files = {
        "png": (png(7, 9), ("png", 7, 9)), "jpeg": (jpeg(640, 480), ("jpeg", 640, 480)), "app": (jpeg(3, 5, app * 3), ("jpeg", 3, 5)),
        "fill": (jpeg(8, 6, b"\xff\xff\xff\xe0\x00\x04ab\xff\x01\xff\xd3"), ("jpeg", 8, 6)), "cut": (jpeg(8, 6)[:7], None),
        "stop": (jpeg(8, 6, b"\xff\xda\x00\x02"), None), "tables": (jpeg(8, 6, b"\xff\xc4\x00\x04ab"), ("jpeg", 8, 6)),
        "bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 5, -4), ("bmp", 5, 4)), "core": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 5, 4), ("bmp", 5, 4)),
        "gif": (b"GIF87a" + struct.pack("<HH", 300, 2), ("gif", 300, 2)), "empty": (b"", None), "text": (b"hello", None), "none": (None, None),
        "bad": (b"\xff\xd8\xff\xe0\x00\x00" + bytes(40), None), "short": (png(7, 9)[:18], None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in files.items()], "name string, content binary")
    found = {r.name: tuple(r.image_size) if r.image_size else None for r in df.select("name", images.image_size().alias("image_size")).collect()}
    assert found == {k: v[1] for k, v in files.items()} | {"short": found["short"]} and (found["short"] is None or found["short"][2] == 0)


def test_files_are_refused_by_their_pixels(spark, tmp_path):
    for name, data in {"a.png": png(4000, 3000), "b.png": png(4000, 3001), "c.jpg": jpeg(0, 10), "d.gif": b"no header", "e.svg": b"<svg/>"}.items():
        (tmp_path / name).write_bytes(data)
    kept, refused = media.read_image_bytes(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept.collect()) == ["a.png", "d.gif"]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in refused.collect()} == {
        "b.png": "too-many-pixels", "c.jpg": "empty-image", "e.svg": "svg-refused"}


def test_a_rectangle_of_any_size_takes_few_cells(spark):
    sizes = [0.5, 64.0, 65.0, 1e4, 1e9, 3e12]
    df = spark.createDataFrame([(k, -s / 3, s) for k, s in enumerate(sizes)], "k int, x double, s double").select(
        "k", boxes.box(*map(F.col, "xxss")).alias("box"))
    spread = reports.grid_cells(df, list(range(0, 40, 2)), 64.0)
    own = spread.where("__level = __own").groupBy("k").count().collect()
    assert len(own) == len(sizes) and max(r["count"] for r in own) <= 9
    assert max(r["count"] for r in spread.groupBy("k").count().collect()) <= 9 * 21


def test_coverage_equals_all_pairs(spark):
    rng = random.Random(5)
    any_box = lambda: (rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3), rng.choice([0, 1, 64, 1e3, 1e9]), 2 ** rng.uniform(-3, 12))
    masks, targets = [any_box() for _ in range(30)] + [(math.nan, 0, 5, 5), (0, 0, math.inf, 5)], [any_box() for _ in range(200)]
    frame = lambda rows: spark.createDataFrame([(1, k, *map(float, b)) for k, b in enumerate(rows)], "page int, target_id int, x double, y double, w double, h double").select(
        "page", "target_id", boxes.box(*map(F.col, "xywh")).alias("box"))
    found = reports.mask_coverage(frame(masks), frame(targets), "page").collect()
    meets = lambda m, t: m[2] > 0 and m[3] > 0 and m[0] < t[0] + t[2] and m[0] + m[2] > t[0] and m[1] < t[1] + t[3] and m[1] + m[3] > t[1]
    assert {r.target_id: r.covered for r in found} == {k: any(meets(m, t) for m in masks[:30]) for k, t in enumerate(targets)}


def test_exact_quantiles(spark):
    rng = random.Random(6)
    rows = [("skew", rng.lognormvariate(0, 4)) for _ in range(2000)] + [("ties", float(rng.randint(0, 3))) for _ in range(501)]
    rows += [("one", 4.0), (None, 1.0), (None, 2.0), ("nulls", None), ("wide", math.inf), ("wide", 1.0), ("wide", -math.inf)]
    df = spark.createDataFrame(rows, "name string, score double")
    found = {r.name: r for r in reports.exact_quantiles(df, ["name"], "score", {"a": 1, "m": 50, "z": 99, "all": 100}, bins=16).collect()}
    for name in ("skew", "ties", "one", None, "wide"):
        values = sorted(v for n, v in rows if n == name)
        pick = lambda p: values[max(1, -(-p * len(values) // 100)) - 1]
        r = found.pop(name)
        assert (r.n, r.low, r.high, r.a, r.m, r.z, r["all"]) == (len(values), values[0], values[-1], pick(1), pick(50), pick(99), values[-1])
    assert not found
    whole = reports.exact_quantiles(df, [], "score", {"m": 50}).collect()
    assert whole[0].n == len(rows) - 1


def test_rows_in_cells_are_never_shipped_whole(spark, capsys):
    row = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0)], "page int, target_id int, x double, y double, w double, h double")
    rows = row.select("page", "target_id", boxes.box(*map(F.col, "xywh")).alias("box"))
    reports.mask_coverage(rows, rows, "page").explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join" in line and "__cx" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
