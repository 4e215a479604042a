"""Boxes, detector output and face geometry, over detections read from ``lineitem``.

A medium is an order, its detections are the order's lines: corner from the part and
supplier numbers, sides from the quantity, score from the discount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import boxes
from maskwright.lineage import spread, table
from maskwright.operators import chips, detections, reports
from maskwright.plans import sql
from maskwright.plans.registry import query
from maskwright.plans.rounding import r6


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_A = sql.box("l_partkey % 97", "l_suppkey % 89", "10 + l_quantity", "10 + l_quantity")
_B = sql.box(
    "l_suppkey % 97", "l_partkey % 89", "l_extendedprice % 60 - 2", "8 + l_linenumber * 7"
)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "lineitem").select(*[c.strip() for c in _LINE.split(",")]))


def _box_a() -> Column:
    side = 10 + F.col("l_quantity")
    return boxes.box(F.col("l_partkey") % 97, F.col("l_suppkey") % 89, side, side)


def _box_b() -> Column:
    return boxes.box(
        F.col("l_suppkey") % 97,
        F.col("l_partkey") % 89,
        F.col("l_extendedprice") % 60 - 2,
        8 + F.col("l_linenumber") * 7,
    )


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_KEY_SQL = ", ".join(_KEYS)


def _parts(df: DataFrame, column: Column, prefix: str = "") -> list[Column]:
    return [r6(column[c]).alias(prefix + c) for c in ("x", "y", "width", "height")]


def _parts_sql(column: str, prefix: str = "") -> str:
    return ", ".join(
        f"{sql.r6(f'{column}.{c}')} AS {prefix}{c}" for c in ("x", "y", "width", "height")
    )


@query(
    f"""
    WITH d AS (SELECT {_KEY_SQL}, {_A} AS a, {_B} AS b FROM lineitem)
    SELECT {_KEY_SQL}, {sql.r6(sql.iou('a', 'b'))} AS iou,
           {sql.r6(sql.iou('a', 'b', guard=False))} AS detector_iou,
           {sql.inside('a', 'b')} AS b_center_in_a, {sql.inside('b', 'a')} AS a_center_in_b,
           (a.width > 0 AND a.height > 0 AND a.x < b.x + b.width AND a.x + a.width > b.x
            AND a.y < b.y + b.height AND a.y + a.height > b.y) AS meets
    FROM d"""
)
def box_overlap(spark, folder):
    d = _lines(spark, folder).select(*_KEYS, _box_a().alias("a"), _box_b().alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.select(
        *_KEYS,
        r6(boxes.iou(a, b)).alias("iou"),
        r6(boxes.detector_iou(a, b)).alias("detector_iou"),
        boxes.contains(a, boxes.center(b)).alias("b_center_in_a"),
        boxes.contains(b, boxes.center(a)).alias("a_center_in_b"),
        boxes.intersects(a, b).alias("meets"),
    )


_CLAMP = lambda v, top: f"greatest(0, least({v}, {top}))"
_GROW_SQL = f"""
    d AS (SELECT {_KEY_SQL}, {_A} AS a FROM lineitem),
    c AS (SELECT *, {_CLAMP('a.x + a.width / 2 - a.width * 1.2::DOUBLE / 2', 100)} AS x0,
                 {_CLAMP('a.y + a.height / 2 - a.height * 1.25::DOUBLE / 2', 90)} AS y0,
                 {_CLAMP('a.x + a.width / 2 + a.width * 1.2::DOUBLE / 2', 100)} AS x1,
                 {_CLAMP('a.y + a.height / 2 + a.height * 1.25::DOUBLE / 2', 90)} AS y1,
                 a.x - a.width * 0.15::DOUBLE AS mx, a.y - a.height * 0.2::DOUBLE AS my FROM d)"""


@query(
    f"""
    WITH {_GROW_SQL}
    SELECT {_KEY_SQL}, {sql.r6('x0')} AS cx, {sql.r6('y0')} AS cy, {sql.r6('x1 - x0')} AS cwidth,
           {sql.r6('y1 - y0')} AS cheight, {sql.r6('mx')} AS mx, {sql.r6('my')} AS my,
           {sql.r6('a.width * 1.2::DOUBLE')} AS mwidth, {sql.r6('a.height * 1.25::DOUBLE')} AS mheight,
           {sql.r6('greatest(mx, 0)')} AS kx, {sql.r6('greatest(my, 0)')} AS ky,
           {sql.r6('greatest(least(mx + a.width * 1.2::DOUBLE, 100) - greatest(mx, 0), 0)')} AS kwidth,
           {sql.r6('greatest(least(my + a.height * 1.25::DOUBLE, 90) - greatest(my, 0), 0)')} AS kheight
    FROM c"""
)
def box_grow(spark, folder):
    d = _lines(spark, folder).select(*_KEYS, _box_a().alias("a"))
    a, w, h = F.col("a"), F.lit(100.0), F.lit(90.0)
    grown = d.select(
        *_KEYS,
        boxes.grow_centered(a, w, h).alias("c"),
        boxes.grow_by_margin(a).alias("m"),
        boxes.grow_by_margin(a, clamp_width=w, clamp_height=h).alias("k"),
    )
    return grown.select(
        *_KEYS, *[p for n in ("c", "m", "k") for p in _parts(grown, F.col(n), n)]
    )


_FITS = "['fill', 'contain', 'cover', 'none', 'scale-down', 'stretch']"
_FIT_SOURCE = f"""
    d AS (SELECT {_KEY_SQL}, {_A} AS a, (l_suppkey % 5 * 60)::DOUBLE AS sw, (40 + l_partkey % 200)::DOUBLE AS sh,
                 (50 + l_linenumber * 30)::DOUBLE AS rw, (l_partkey % 3 * 70)::DOUBLE AS rh,
                 {_FITS}[l_partkey % 6 + 1] AS fit FROM lineitem),
    s AS (SELECT *, CASE WHEN fit = 'contain' THEN least(rw / sw, rh / sh)
                         WHEN fit = 'cover' THEN greatest(rw / sw, rh / sh)
                         WHEN fit = 'none' THEN 1.0::DOUBLE
                         WHEN fit = 'scale-down' THEN
                           CASE WHEN sw > rw OR sh > rh THEN least(rw / sw, rh / sh) ELSE 1.0::DOUBLE END END AS u
          FROM d),
    t AS (SELECT *, coalesce(u, rw / sw) AS fx, coalesce(u, rh / sh) AS fy FROM s)"""


def _fit_rows(spark: SparkSession, folder: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    fits = F.array(*[F.lit(f) for f in ("fill", "contain", "cover", "none", "scale-down", "stretch")])
    return _lines(spark, folder).select(
        *_KEYS,
        "l_quantity",
        _box_a().alias("a"),
        (supp % 5 * 60).cast("double").alias("sw"),
        (40 + part % 200).cast("double").alias("sh"),
        (50 + F.col("l_linenumber") * 30).cast("double").alias("rw"),
        (part % 3 * 70).cast("double").alias("rh"),
        F.get(fits, (part % 6).cast("int")).alias("fit"),
    )


@query(
    f"""
    WITH {_FIT_SOURCE}
    SELECT {_KEY_SQL}, fit,
      {sql.r6("CASE WHEN sw <= 0 OR sh <= 0 THEN 0 WHEN u IS NULL THEN a.x * fx ELSE a.x * fx + (rw - sw * fx) / 2 END")} AS x,
      {sql.r6("CASE WHEN sw <= 0 OR sh <= 0 THEN 0 WHEN u IS NULL THEN a.y * fy ELSE a.y * fy + (rh - sh * fy) / 2 END")} AS y,
      {sql.r6("CASE WHEN sw <= 0 OR sh <= 0 THEN 0 ELSE a.width * fx END")} AS width,
      {sql.r6("CASE WHEN sw <= 0 OR sh <= 0 THEN 0 ELSE a.height * fy END")} AS height
    FROM t"""
)
def box_fit(spark, folder):
    d = _fit_rows(spark, folder)
    mapped = boxes.fit_to_element(*[F.col(c) for c in ("a", "sw", "sh", "rw", "rh", "fit")])
    d = d.select(*_KEYS, "fit", mapped.alias("m"))
    return d.select(*_KEYS, "fit", *_parts(d, F.col("m")))


# position text -> (x percent, x px, x from end, y percent, y px, y from end)
_POSITIONS = {
    "center": (50, 0, False, 50, 0, False),
    "left top": (0, 0, False, 0, 0, False),
    "right 10px bottom 25%": (0, 10, True, 25, 0, True),
    "30% 20px": (30, 0, False, 0, 20, False),
    "bottom": (50, 0, False, 0, 0, True),
    "calc(1px) 0": (0, 0, False, 50, 0, False),
    "": (50, 0, False, 50, 0, False),
    "  RIGHT  CENTER ": (0, 0, True, 50, 0, False),
}
_POS_LIST = "[" + ", ".join(f"'{p}'" for p in _POSITIONS) + "]"
_POS_VALUES = ", ".join(
    f"('{p}', {a}::DOUBLE, {b}::DOUBLE, {c}, {d}::DOUBLE, {e}::DOUBLE, {f})"
    for p, (a, b, c, d, e, f) in _POSITIONS.items()
)


def _axis_sql(pct: str, px: str, end: str, free: str) -> str:
    o = f"({px} + {pct} / 100.0::DOUBLE * ({free}))"
    return f"(CASE WHEN {end} THEN ({free}) - {o} ELSE {o} END)"


_EMPTY = "sw <= 0 OR sh <= 0 OR rw <= 0 OR rh <= 0"


@query(
    f"""
    WITH {_FIT_SOURCE},
    pos(position, xp, xx, xe, yp, yx, ye) AS (VALUES {_POS_VALUES}),
    j AS (SELECT t.*, pos.* FROM t JOIN pos ON position = {_POS_LIST}[l_linenumber % {len(_POSITIONS)} + 1])
    SELECT {_KEY_SQL}, fit, position,
      {sql.r6(f"CASE WHEN {_EMPTY} THEN 0 ELSE a.x * fx + {_axis_sql('xp', 'xx', 'xe', 'rw - sw * fx')} END")} AS x,
      {sql.r6(f"CASE WHEN {_EMPTY} THEN 0 ELSE a.y * fy + {_axis_sql('yp', 'yx', 'ye', 'rh - sh * fy')} END")} AS y,
      {sql.r6(f"CASE WHEN {_EMPTY} THEN 0 ELSE a.width * fx END")} AS width,
      {sql.r6(f"CASE WHEN {_EMPTY} THEN 0 ELSE a.height * fy END")} AS height
    FROM j"""
)
def box_position(spark, folder):
    texts = F.array(*[F.lit(p) for p in _POSITIONS])
    d = _fit_rows(spark, folder).withColumn(
        "position", F.get(texts, (F.col("l_linenumber") % len(_POSITIONS)).cast("int"))
    )
    # few distinct strings: parsed once each, then joined
    parsed = d.select("position").distinct().withColumn("p", boxes.parse_position(F.col("position")))
    mapped = boxes.fit_with_position(
        *[F.col(c) for c in ("a", "sw", "sh", "rw", "rh", "fit", "p")]
    )
    # one row per entry of _POSITIONS; dealt out by position, each would be one task
    m = d.join(F.broadcast(parsed), "position").select(*_KEYS, "fit", "position", mapped.alias("m"))
    return m.select(*_KEYS, "fit", "position", *_parts(m, F.col("m")))


@query(
    f"""
    WITH d AS (SELECT {_KEY_SQL}, {_A} AS a, (l_partkey % 7)::DOUBLE AS bl, (l_suppkey % 5)::DOUBLE AS br,
                 (l_linenumber)::DOUBLE AS bt, 2.0::DOUBLE AS bb, (l_partkey % 11)::DOUBLE AS pl,
                 (l_suppkey % 9)::DOUBLE AS pr, 1.0::DOUBLE AS pt, (l_linenumber * 3)::DOUBLE AS pb,
                 320 + l_partkey % 3 * 640 AS fw, l_suppkey % 4 * 180 AS fh FROM lineitem),
    e AS (SELECT *, a.width - bl - br - pl - pr AS w, a.height - bt - bb - pt - pb AS h FROM d)
    SELECT {_KEY_SQL},
      CASE WHEN w > 0 AND h > 0 THEN {sql.r6('a.x + bl + pl')} END AS x,
      CASE WHEN w > 0 AND h > 0 THEN {sql.r6('a.y + bt + pt')} END AS y,
      CASE WHEN w > 0 AND h > 0 THEN {sql.r6('w')} END AS width,
      CASE WHEN w > 0 AND h > 0 THEN {sql.r6('h')} END AS height,
      CASE WHEN fh > 0 THEN greatest(1, floor(fw * least(1.0::DOUBLE, 480.0::DOUBLE / fw) + 0.5::DOUBLE))::BIGINT END AS frame_width,
      CASE WHEN fh > 0 THEN greatest(1, floor(fh * least(1.0::DOUBLE, 480.0::DOUBLE / fw) + 0.5::DOUBLE))::BIGINT END AS frame_height,
      CASE WHEN fh > 0 THEN {sql.r6('a.x * 1920.0::DOUBLE / fw')} END AS source_x,
      CASE WHEN fh > 0 THEN {sql.r6('a.height * 1080.0::DOUBLE / fh')} END AS source_height
    FROM e"""
)
def box_layout(spark, folder):
    """Content boxes, sampled frame sizes and frame-to-source scaling."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    dbl = lambda c: c.cast("double")
    content = boxes.content_box(
        F.col("a"), dbl(part % 7), dbl(supp % 5), dbl(line), F.lit(2.0),
        dbl(part % 11), dbl(supp % 9), F.lit(1.0), dbl(line * 3),
    )
    fw, fh = 320 + part % 3 * 640, supp % 4 * 180
    d = _lines(spark, folder).withColumn("a", _box_a()).select(
        *_KEYS,
        content.alias("c"),
        boxes.frame_size(fw, fh).alias("f"),
        boxes.frame_to_source(F.col("a"), fw, fh, F.lit(1920), F.lit(1080)).alias("s"),
    )
    return d.select(
        *_KEYS,
        *_parts(d, F.col("c")),
        F.col("f.width").alias("frame_width"),
        F.col("f.height").alias("frame_height"),
        r6(F.col("s.x")).alias("source_x"),
        r6(F.col("s.height")).alias("source_height"),
    )


# ---- greedy selection. Line columns break ties; rows equal in all of them are copies.

_TIES = ["line", "part", "supplier", "side"]
_RANKED = f"""
    ranked AS (
      SELECT l_orderkey AS media_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
             l_quantity AS side, {_A} AS box, l_discount AS score FROM lineitem
    )"""


def _detections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("media_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("side"),
        F.col("l_discount").alias("score"),
        _box_a().alias("box"),
    )


def _greedy_sql(order: str, conflict: str, fixed: str = "false") -> str:
    return f"""
    o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY {order}, line, part, supplier, side) AS i
          FROM ranked),
    r AS (
      SELECT media_id, 0::BIGINT AS i, []::STRUCT(x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE)[] AS kept,
             NULL::INTEGER AS line, NULL::BIGINT AS part, NULL::BIGINT AS supplier, true AS dropped
      FROM (SELECT DISTINCT media_id FROM o)
      UNION ALL
      SELECT o.media_id, o.i,
             CASE WHEN {fixed} OR len(list_filter(r.kept, lambda k: {conflict})) = 0
                  THEN list_append(r.kept, o.box) ELSE r.kept END,
             o.line, o.part, o.supplier,
             NOT ({fixed} OR len(list_filter(r.kept, lambda k: {conflict})) = 0)
      FROM r JOIN o ON o.media_id = r.media_id AND o.i = r.i + 1
    )
    SELECT media_id, line, part, supplier, row_number() OVER (PARTITION BY media_id ORDER BY i) AS kept_ord
    FROM r WHERE NOT dropped"""


_KEPT = ["media_id", "line", "part", "supplier", "kept_ord"]


@query(
    f"WITH RECURSIVE {_RANKED}, "
    + _greedy_sql("score DESC", f"{sql.iou('k', 'o.box', guard=False)} > 0.3")
)
def nms(spark, folder):
    kept = detections.suppress(_detections(spark, folder), ["media_id"], _TIES, 0.3)
    return kept.select(*_KEPT)


_SAME = (
    f"({sql.iou('k', 'o.box', guard=False)} > 0.4 OR {sql.inside('k', 'o.box')}"
    f" OR {sql.inside('o.box', 'k')})"
)


@query(
    f"WITH RECURSIVE {_RANKED}, " + _greedy_sql("score < 0.05", _SAME, fixed="o.score >= 0.05")
)
def cross_pass_merge(spark, folder):
    rows = _detections(spark, folder)
    first, second = rows.where("score >= 0.05"), rows.where("not score >= 0.05")
    return detections.merge_passes(first, second, ["media_id"], _TIES).select(*_KEPT)


_TILES = """
    ranked AS (
      SELECT * REPLACE ({'x': box.x + line % 2 * 10, 'y': box.y + line % 3 * 8,
                         'width': box.width, 'height': box.height} AS box),
             line % 3 * 8 AS oy, line % 2 * 10 AS ox
      FROM ranked0
    )"""


@query(
    "WITH RECURSIVE "
    + _RANKED.replace("ranked AS (", "ranked0 AS (")
    + ", "
    + _TILES
    + ", "
    + _greedy_sql("oy, ox", f"{sql.iou('k', 'o.box', guard=False)} > 0.4")
)
def tile_merge(spark, folder):
    tiled = _detections(spark, folder).withColumn("oy", F.col("line") % 3 * 8).withColumn(
        "ox", F.col("line") % 2 * 10
    )
    return detections.merge_tiles(tiled, ["media_id"], _TIES).select(*_KEPT)


@query(
    """
    WITH c AS (SELECT o_orderkey AS media_id,
                 (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.05) AS fast,
                 (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS fully FROM orders)
    SELECT media_id, CASE WHEN fast = 0 THEN 'full' ELSE 'fast' END AS base_pass,
           CASE WHEN fast = 0 THEN fully ELSE fast END AS base_faces,
           CASE WHEN fast = 0 THEN fully ELSE fast END >= 2 AS tiled
    FROM c"""
)
def pass_policy(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("media_id"), "l_discount")
    count = lambda d: d.groupBy("media_id").agg(F.count("*").alias("faces"))
    media = table(spark, folder, "orders").select(F.col("o_orderkey").alias("media_id"))
    return detections.pass_policy(media, count(lines.where("l_discount >= 0.05")), count(lines))


@query(
    """
    WITH i AS (SELECT o_orderkey AS media_id, (100 + o_orderkey * 7 % 900)::BIGINT AS width,
                 (80 + o_custkey * 11 % 700)::BIGINT AS height FROM orders),
    s AS (SELECT *, ceil(width / 3.0::DOUBLE)::BIGINT AS tw, ceil(height / 3.0::DOUBLE)::BIGINT AS th FROM i),
    p AS (SELECT *, greatest(1, floor(tw * 0.75::DOUBLE + 0.5::DOUBLE))::BIGINT AS sx,
                 greatest(1, floor(th * 0.75::DOUBLE + 0.5::DOUBLE))::BIGINT AS sy FROM s),
    y AS (SELECT *, unnest(range(0, height, sy)) AS oy FROM p),
    x AS (SELECT *, unnest(range(0, width, sx)) AS ox FROM y)
    SELECT media_id, ox, oy, least(tw, width - ox) AS tile_width, least(th, height - oy) AS tile_height
    FROM x WHERE least(tw, width - ox) >= 64 AND least(th, height - oy) >= 64"""
)
def tile_grid(spark, folder):
    images = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        (100 + F.col("o_orderkey") * 7 % 900).alias("width"),
        (80 + F.col("o_custkey") * 11 % 700).alias("height"),
    )
    return detections.tile_grid(images).select("media_id", "ox", "oy", "tile_width", "tile_height")


@query(
    """
    WITH i AS (SELECT DISTINCT (s_suppkey % 20 * 8 + 30)::BIGINT AS input_size FROM supplier),
    g AS (SELECT input_size, s AS stride, (input_size // s)::INTEGER AS side FROM i, (VALUES (8), (16), (32)) v(s)),
    c AS (SELECT *, unnest(range(0, side * side))::INTEGER AS cell FROM g WHERE side > 0)
    SELECT input_size, stride, side, cell, (cell // side)::INTEGER AS "row", (cell % side)::INTEGER AS col FROM c"""
)
def prior_grid(spark, folder):
    inputs = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") % 20 * 8 + 30).alias("input_size")
    ).distinct()
    return detections.prior_grid(inputs)


def _wave(i: Column, *terms: Column) -> Column:
    """A repeatable value in [0, 1) of a position and some keys."""
    total = i * 37
    for k, t in enumerate(terms):
        total = total + t * (11 + 6 * k)
    return _level(total)


def _level(total: Column) -> Column:
    return ((total % 101) / F.lit(101.0)).cast("float")


def _wave_sql(i: str, *terms: str) -> str:
    total = f"{i} * 37" + "".join(f" + {t} * {11 + 6 * k}" for k, t in enumerate(terms))
    return f"((({total}) % 101) / 101.0::DOUBLE)::FLOAT"


_SIDE = {8: 8, 16: 4, 32: 2}


@query(
    f"""
    WITH t AS (SELECT o_orderkey AS media_id, o_orderkey AS k, o_custkey AS c, s AS stride, side FROM orders,
                 (VALUES (8, 8), (16, 4), (32, 2)) v(s, side)),
    cells AS (SELECT *, unnest(range(0, side * side)) AS cell FROM t
              WHERE NOT (stride = 32 AND c % 4 = 0)),
    v AS (SELECT *, sqrt(greatest(0, {_wave_sql('cell', 'k')}::DOUBLE - 0.1::DOUBLE::FLOAT::DOUBLE)
                     * greatest(0, {_wave_sql('cell', 'c')}::DOUBLE - 0.1::DOUBLE::FLOAT::DOUBLE)) AS score,
                 cell % side AS col, cell // side AS rw FROM cells),
    b AS (SELECT *, (col + {_wave_sql('(cell * 4)', 'k', 'c')}::DOUBLE) * stride AS cx,
                 (rw + {_wave_sql('(cell * 4 + 1)', 'k', 'c')}::DOUBLE) * stride AS cy,
                 exp({_wave_sql('(cell * 4 + 2)', 'k', 'c')}::DOUBLE) * stride AS w,
                 exp({_wave_sql('(cell * 4 + 3)', 'k', 'c')}::DOUBLE) * stride AS h,
                 (col + {_wave_sql('0', 'k')}::DOUBLE) * stride AS eye_x,
                 (rw + {_wave_sql('9', 'k')}::DOUBLE) * stride AS mouth_y
          FROM v WHERE score >= 0.6)
    SELECT media_id, stride::INTEGER AS stride, cell::INTEGER AS cell, {sql.r6('score')} AS score,
           {sql.r6('cx - w / 2')} AS x, {sql.r6('cy - h / 2')} AS y, {sql.r6('w')} AS width,
           {sql.r6('h')} AS height, {sql.r6('eye_x')} AS eye_x, {sql.r6('mouth_y')} AS mouth_y FROM b"""
)
def tensor_decode(spark, folder):
    """Tensors of waves, which repeat: one row of ready arrays per remainder is joined."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    both = (k * 11 + c * 17) % 101
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), 200_000)
    orders = orders.select(
        k.alias("media_id"), (c % 4 != 0).alias("large"),
        (k * 11 % 101).alias("__k"), (c * 11 % 101).alias("__c"), both.alias("__b"),
    )
    parts = []
    for stride, side in _SIDE.items():
        series = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
        wave = lambda i: _level(i * 37 + F.col("at"))
        cells = side * side
        waves = spark.range(101).withColumnRenamed("id", "at").select(
            "at",
            series(cells, lambda i: wave(i).cast("double") - F.lit(0.1).cast("float").cast("double")).alias("score"),
            series(cells * 4, wave).alias("bbox"),
            F.flatten(F.array_repeat(series(10, wave), cells)).alias("kps"),
        )
        pick = lambda key, column, name: F.broadcast(waves.select(F.col("at").alias(key), F.col(column).alias(name)))
        present = F.lit(True) if stride != 32 else F.col("large")
        tensors = orders
        for key, column, name in (("__k", "score", "cls"), ("__c", "score", "obj"), ("__b", "bbox", "bbox")):
            tensors = tensors.join(pick(key, column, name), key, "left")
        parts.append(
            tensors.join(pick("__k", "kps", "kps"), "__k", "left")
            .select(
                "media_id", F.lit(stride).alias("stride"), F.lit(side).alias("side"),
                F.when(present, F.col("cls")).alias("cls"), "obj", "bbox", "kps",
            )
        )
    tensors = parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = detections.decode_tensors(tensors, ["media_id"], 0.6)
    return found.select(
        "media_id", "stride", "cell", r6(F.col("score")).alias("score"),
        *_parts(found, F.col("box")),
        r6(F.col("landmarks")[0]["x"]).alias("eye_x"),
        r6(F.col("landmarks")[4]["y"]).alias("mouth_y"),
    )


# ---- five-point geometry

_POINT = lambda i: (
    f"(l_partkey * {3 + i} % 101 + {20 * i})::DOUBLE", f"(l_suppkey * {5 + i} % 83 + {15 * i})::DOUBLE"
)
_SRC = ", ".join(f"{_POINT(i)[0]} AS sx{i}, {_POINT(i)[1]} AS sy{i}" for i in range(5))
_N = range(5)
_SUM = lambda f: "(" + " + ".join(["0.0::DOUBLE"] + [f(i) for i in _N]) + ")"
_TX = [p[0] for p in boxes.TEMPLATE_POINTS]
_TY = [p[1] for p in boxes.TEMPLATE_POINTS]


def _face_points() -> Column:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return F.array(
        *[boxes.point(part * (3 + i) % 101 + 20 * i, supp * (5 + i) % 83 + 15 * i) for i in _N]
    )


_FIT_POINTS = f"""
    p AS (SELECT {_KEY_SQL}, {_A} AS a, {_SRC} FROM lineitem),
    m AS (SELECT *, {_SUM(lambda i: f'sx{i}')} / 5 AS mx, {_SUM(lambda i: f'sy{i}')} / 5 AS my,
                 {_SUM(lambda i: f'{_TX[i]}::DOUBLE')} / 5 AS dx, {_SUM(lambda i: f'{_TY[i]}::DOUBLE')} / 5 AS dy FROM p),
    s AS (SELECT *,
      {_SUM(lambda i: f'((sx{i} - mx) * (sx{i} - mx) + (sy{i} - my) * (sy{i} - my))')} AS den,
      {_SUM(lambda i: f'((sx{i} - mx) * ({_TX[i]}::DOUBLE - dx) + (sy{i} - my) * ({_TY[i]}::DOUBLE - dy))')} AS na,
      {_SUM(lambda i: f'((sx{i} - mx) * ({_TY[i]}::DOUBLE - dy) - (sy{i} - my) * ({_TX[i]}::DOUBLE - dx))')} AS nb
      FROM m),
    f AS (SELECT *, CASE WHEN den = 0 THEN 1 ELSE na / den END AS ta, CASE WHEN den = 0 THEN 0 ELSE nb / den END AS tb FROM s),
    g AS (SELECT *, dx - (ta * mx - tb * my) AS tx, dy - (tb * mx + ta * my) AS ty, ta * ta + tb * tb AS det FROM f)"""


@query(
    f"""
    WITH {_FIT_POINTS}
    SELECT {_KEY_SQL}, {sql.r6('ta')} AS a, {sql.r6('tb')} AS b, {sql.r6('tx')} AS tx, {sql.r6('ty')} AS ty,
           {sql.r6('ta * sx0 - tb * sy0 + tx')} AS eye_x, {sql.r6('tb * sx4 + ta * sy4 + ty')} AS mouth_y
    FROM g"""
)
def similarity_transform(spark, folder):
    d = _lines(spark, folder).select(*_KEYS, _face_points().alias("pts"))
    d = d.withColumn("t", boxes.similarity_transform(F.col("pts"), boxes.template()))
    at = lambda i: boxes.apply_transform(F.col("pts")[i], F.col("t"))
    return d.select(
        *_KEYS,
        *[r6(F.col(f"t.{c}")).alias(c) for c in ("a", "b", "tx", "ty")],
        r6(at(0)["x"]).alias("eye_x"),
        r6(at(4)["y"]).alias("mouth_y"),
    )


_CORNERS = [(0, 0), (111, 0), (0, 111), (111, 111)]
_CX = ", ".join(f"(ia * {x} - ib * {y} + itx)" for x, y in _CORNERS)
_CY = ", ".join(f"(ib * {x} + ia * {y} + ity)" for x, y in _CORNERS)


@query(
    f"""
    WITH {_FIT_POINTS},
    i0 AS (SELECT *, ta / nullif(det, 0) AS ia, -tb / nullif(det, 0) AS ib FROM g),
    i AS (SELECT *, -(ia * tx - ib * ty) AS itx, -(ib * tx + ia * ty) AS ity FROM i0),
    c AS (SELECT *, floor(least({_CX}) + 1e-7) - 1 AS x0, floor(least({_CY}) + 1e-7) - 1 AS y0,
                 floor(greatest({_CX}) + 1e-7) + 3 AS x1, floor(greatest({_CY}) + 1e-7) + 3 AS y1 FROM i)
    SELECT {_KEY_SQL}, CASE WHEN det = 0 THEN 0 ELSE x0 END AS x, CASE WHEN det = 0 THEN 0 ELSE y0 END AS y,
           CASE WHEN det = 0 THEN 0 ELSE x1 - x0 END AS width, CASE WHEN det = 0 THEN 0 ELSE y1 - y0 END AS height,
           floor(a.x - a.width * 0.1::DOUBLE) AS plain_x,
           greatest(0, floor(a.x - a.width * 0.6::DOUBLE)) AS region_x,
           greatest(1, least(150, ceil(a.x + a.width + a.width * 0.6::DOUBLE)) - greatest(0, floor(a.x - a.width * 0.6::DOUBLE))) AS region_width
    FROM c"""
)
def alignment_rect(spark, folder):
    d = _lines(spark, folder).select(*_KEYS, _box_a().alias("a"), _face_points().alias("pts"))
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    d = d.select(
        *_KEYS,
        boxes.alignment_footprint(F.col("a"), F.col("pts")).alias("r"),
        boxes.alignment_footprint(F.col("a"), none).alias("p"),
        boxes.padded_region(F.col("a"), F.lit(150), F.lit(130)).alias("g"),
    )
    return d.select(
        *_KEYS,
        *[(F.col(f"r.{c}") + 0.0).alias(c) for c in ("x", "y", "width", "height")],
        F.col("p.x").alias("plain_x"),
        F.col("g.x").alias("region_x"),
        F.col("g.width").alias("region_width"),
    )


@query(
    f"""
    WITH d AS (SELECT {_KEY_SQL}, {_A} AS a, {_SRC} FROM lineitem)
    SELECT {_KEY_SQL}, {sql.r6('a.x * 2.5::DOUBLE')} AS x, {sql.r6('a.height * 1.5::DOUBLE')} AS height,
           {sql.r6('least(sx0, sx1) * 2.5::DOUBLE')} AS left_eye_x, {sql.r6('greatest(sx3, sx4) * 2.5::DOUBLE')} AS right_mouth_x,
           {sql.r6('CASE WHEN sx0 <= sx1 THEN sy0 ELSE sy1 END * 1.5::DOUBLE')} AS left_eye_y
    FROM d"""
)
def detection_scaling(spark, folder):
    d = _lines(spark, folder).select(*_KEYS, _box_a().alias("a"), _face_points().alias("pts"))
    moved, pts = boxes.scale_detection(F.col("a"), F.col("pts"), F.lit(2.5), F.lit(1.5))
    d = d.select(*_KEYS, moved.alias("m"), pts.alias("q"))
    return d.select(
        *_KEYS,
        r6(F.col("m.x")).alias("x"),
        r6(F.col("m.height")).alias("height"),
        r6(F.col("q")[0]["x"]).alias("left_eye_x"),
        r6(F.col("q")[4]["x"]).alias("right_mouth_x"),
        r6(F.col("q")[0]["y"]).alias("left_eye_y"),
    )


@query(
    f"""
    WITH m AS (SELECT DISTINCT l_orderkey AS page, {_B} AS box FROM lineitem),
    t AS (SELECT o_orderkey AS page, {sql.box('o_custkey % 120', 'o_orderkey % 110', '5 + o_custkey % 30', '6 + o_orderkey % 25')} AS box
          FROM orders)
    SELECT page, EXISTS (SELECT 1 FROM m WHERE m.page = t.page AND m.box.width > 0 AND m.box.height > 0
        AND m.box.x < t.box.x + t.box.width AND m.box.x + m.box.width > t.box.x
        AND m.box.y < t.box.y + t.box.height AND m.box.y + m.box.height > t.box.y) AS covered
    FROM t"""
)
def mask_coverage(spark, folder):
    masks = _lines(spark, folder).select(F.col("l_orderkey").alias("page"), _box_b().alias("box"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    targets = table(spark, folder, "orders").select(
        k.alias("page"), k.alias("target_id"), boxes.box(c % 120, k % 110, 5 + c % 30, 6 + k % 25).alias("box")
    )
    return reports.mask_coverage(masks, targets, "page").select("page", "covered")


@query(
    """
    WITH m AS (SELECT DISTINCT l_suppkey AS page, l_partkey % 1000 * 5000.0::DOUBLE - 900000 AS x, l_orderkey % 977 * 3000.0::DOUBLE - 5 AS y,
                 l_linenumber % 3 * pow(2.0::DOUBLE, l_orderkey % 31) AS w, pow(1.5::DOUBLE, l_partkey % 50) AS h FROM lineitem),
    t AS (SELECT o_orderkey AS id, o_custkey % 7 AS page, o_custkey % 1000 * 5000.0::DOUBLE AS x, o_orderkey % 977 * 3000.0::DOUBLE AS y,
                 pow(3.0::DOUBLE, o_orderkey % 17) - 1 AS w, 1.0::DOUBLE + o_custkey % 9000 AS h FROM orders)
    SELECT id, EXISTS (SELECT 1 FROM m WHERE m.page = t.page AND m.w > 0 AND m.h > 0
        AND m.x < t.x + t.w AND m.x + m.w > t.x AND m.y < t.y + t.h AND m.y + m.h > t.y) AS covered
    FROM t"""
)
def mask_coverage_of_any_size(spark, folder):
    """Masks and targets from one to some thousand million pixels wide."""
    n = lambda c, m: F.col(c) % m
    power = lambda base, e: F.pow(F.lit(base), e)
    masks = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("page"), boxes.box(
        n("l_partkey", 1000) * 5000.0 - 900000, n("l_orderkey", 977) * 3000.0 - 5,
        n("l_linenumber", 3) * power(2.0, n("l_orderkey", 31)), power(1.5, n("l_partkey", 50)),
    ).alias("box"))
    targets = table(spark, folder, "orders").select(F.col("o_orderkey").alias("target_id"), n("o_custkey", 7).alias("page"), boxes.box(
        n("o_custkey", 1000) * 5000.0, n("o_orderkey", 977) * 3000.0, power(3.0, n("o_orderkey", 17)) - 1, 1.0 + n("o_custkey", 9000),
    ).alias("box"))
    return reports.mask_coverage(masks, targets, "page").select(F.col("target_id").alias("id"), "covered")


_CHIP_X = [f"(vec_id * {3 + i} % 8)::DOUBLE" for i in _N]
_CHIP_Y = [f"(vec_id * {5 + i} % 8)::DOUBLE" for i in _N]
_CHIP_TX = [f"({x * 16 / 112!r}::DOUBLE)" for x in _TX]
_CHIP_TY = [f"({y * 16 / 112!r}::DOUBLE)" for y in _TY]


def _tap(x: str, y: str, weight: str, width: str, height: str, ox: str, oy: str, green: bool) -> str:
    """One bilinear tap, zero outside width x height."""
    inside = f"{x} >= 0 AND {x} < {width} AND {y} >= 0 AND {y} < {height}"
    level = f"lv[(({y} + {oy}) * 8 + {x} + {ox} + 1)::BIGINT]"
    level = f"(255 - {level})" if green else level
    return f"(CASE WHEN {inside} THEN {level} * {weight} ELSE 0.0::DOUBLE END)"


def _channels(width: str, height: str, ox: str = "0", oy: str = "0") -> str:
    """Two equal channels and the complementary one, each rounded to float as stored."""

    def channel(green: bool) -> str:
        taps = [
            ("x0", "y0", "(1 - fx) * (1 - fy)"),
            ("(x0 + 1)", "y0", "fx * (1 - fy)"),
            ("x0", "(y0 + 1)", "(1 - fx) * fy"),
            ("(x0 + 1)", "(y0 + 1)", "fx * fy"),
        ]
        total = " + ".join(_tap(*t, width, height, ox, oy, green) for t in taps)
        return f"((({total})::FLOAT::DOUBLE - 127.5::DOUBLE) * (1.0::DOUBLE / 127.5::DOUBLE))::FLOAT::DOUBLE"

    return f"(2 * {channel(False)} + {channel(True)})"


@query(
    f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x:
                 greatest(0, least(255, floor(x::DOUBLE * 255 + 128)))::DOUBLE) AS lv FROM embeddings),
    grid AS (SELECT dx, dy FROM range(16) a(dx), range(16) b(dy)),
    m AS (SELECT *, {_SUM(lambda i: _CHIP_X[i])} / 5 AS mx, {_SUM(lambda i: _CHIP_Y[i])} / 5 AS my,
                 {_SUM(lambda i: _CHIP_TX[i])} / 5 AS qx, {_SUM(lambda i: _CHIP_TY[i])} / 5 AS qy
          FROM e WHERE vec_id % 2 = 0),
    s AS (SELECT *,
      {_SUM(lambda i: f'(({_CHIP_X[i]} - mx) * ({_CHIP_X[i]} - mx) + ({_CHIP_Y[i]} - my) * ({_CHIP_Y[i]} - my))')} AS den,
      {_SUM(lambda i: f'(({_CHIP_X[i]} - mx) * ({_CHIP_TX[i]} - qx) + ({_CHIP_Y[i]} - my) * ({_CHIP_TY[i]} - qy))')} AS na,
      {_SUM(lambda i: f'(({_CHIP_X[i]} - mx) * ({_CHIP_TY[i]} - qy) - ({_CHIP_Y[i]} - my) * ({_CHIP_TX[i]} - qx))')} AS nb
      FROM m),
    f AS (SELECT *, CASE WHEN den = 0 THEN 1 ELSE na / den END AS ta, CASE WHEN den = 0 THEN 0 ELSE nb / den END AS tb FROM s),
    g AS (SELECT *, qx - (ta * mx - tb * my) AS tx, qy - (tb * mx + ta * my) AS ty, ta * ta + tb * tb AS det FROM f),
    i AS (SELECT *, ta / det AS ia, -tb / det AS ib FROM g),
    w0 AS (SELECT vec_id, lv, ia * dx - ib * dy - (ia * tx - ib * ty) AS sx, ib * dx + ia * dy - (ib * tx + ia * ty) AS sy
           FROM i, grid),
    w1 AS (SELECT vec_id, lv, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM w0),
    warped AS (SELECT vec_id, sum({_channels('8', '8')}) AS total FROM w1 GROUP BY vec_id),
    bx AS (SELECT *, (vec_id % 5)::DOUBLE AS x, (vec_id % 4)::DOUBLE AS y, (2 + vec_id % 3)::DOUBLE AS w, (2 + vec_id % 4)::DOUBLE AS h
           FROM e WHERE vec_id % 2 = 1),
    cr AS (SELECT *, greatest(0, floor(x + w / 2 - w * 1.2::DOUBLE / 2)) AS cx, greatest(0, floor(y + h / 2 - h * 1.2::DOUBLE / 2)) AS cy,
                  least(8, ceil(x + w / 2 + w * 1.2::DOUBLE / 2)) AS ex, least(8, ceil(y + h / 2 + h * 1.2::DOUBLE / 2)) AS ey FROM bx),
    r0 AS (SELECT vec_id, lv, cx, cy, ex - cx AS cw, ey - cy AS ch,
                  greatest(0, least(ex - cx - 1, (dx + 0.5::DOUBLE) * ((ex - cx) / 16) - 0.5::DOUBLE)) AS sx,
                  greatest(0, least(ey - cy - 1, (dy + 0.5::DOUBLE) * ((ey - cy) / 16) - 0.5::DOUBLE)) AS sy FROM cr, grid),
    r1 AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM r0),
    resized AS (SELECT vec_id, sum({_channels('cw', 'ch', 'cx', 'cy')}) AS total
                FROM r1 GROUP BY vec_id)
    SELECT vec_id AS media_id, 768 AS "values", floor(total * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS total
    FROM (SELECT * FROM warped UNION ALL SELECT * FROM resized)"""
)
def face_chips(spark, folder):
    """Chips from 8 x 8 rasters made of each embedding's components, one face per raster."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    level = F.transform(
        "embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 255 + 128))).cast("int")
    )
    pixel = lambda v: F.lpad(F.hex(v), 2, "0")
    data = F.unhex(F.array_join(F.transform(level, lambda v: F.concat(pixel(v), pixel(255 - v), pixel(v))), ""))
    images = rows.select(
        F.col("vec_id").alias("media_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data")
    )
    v = F.col("vec_id")
    points = F.array(*[boxes.point((v * (3 + i)) % 8, (v * (5 + i)) % 8) for i in _N])
    found = rows.select(
        v.alias("media_id"),
        F.lit(0).alias("det_ord"),
        boxes.box(v % 5, v % 4, 2 + v % 3, 2 + v % 4).alias("box"),
        F.when(v % 2 == 0, points).alias("landmarks"),
    )
    made = chips.face_chips(images, found, size=16)
    total = F.aggregate("chip", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return made.select("media_id", F.size("chip").alias("values"), (F.floor(total * 1000 + 0.5) / F.lit(1000.0)).alias("total"))


@query(
    f"""
    WITH m AS (SELECT vec_id, list_transform(range(1, 65), lambda i:
                 (embedding[i] - embedding[i % 64 + 1])::FLOAT) AS e FROM embeddings),
    u AS (SELECT vec_id, {sql.unit('e')} AS u FROM m)
    SELECT vec_id, len(u)::INTEGER AS width, round(u[1]::DOUBLE, 5) + 0.0 AS first, round(u[64]::DOUBLE, 5) + 0.0 AS last
    FROM u"""
)
def model_inference(spark, folder):
    """A stand-in model (neighbour differences) through the batch inference path."""

    def load():
        import numpy as np

        return lambda x: x - np.roll(x, -1, axis=1)

    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    out = chips.batch_inference(rows, ["vec_id"], "embedding", load)
    good, _ = chips.checked_embeddings(out, ["vec_id"], 64)
    return good.select(
        "vec_id",
        F.size("embedding").alias("width"),
        (F.round(F.col("embedding")[0].cast("double"), 5) + 0.0).alias("first"),
        (F.round(F.col("embedding")[63].cast("double"), 5) + 0.0).alias("last"),
    )
