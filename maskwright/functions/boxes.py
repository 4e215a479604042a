"""Column expressions over boxes: STRUCT<x, y, width, height: DOUBLE>, and point sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.functions.bind import let


def box(x, y, width, height) -> Column:
    parts = {"x": x, "y": y, "width": width, "height": height}
    return F.struct(
        *[
            (v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k)
            for k, v in parts.items()
        ]
    )


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def half_up(v: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(v + 0.5)


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return wide, high


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when disjoint or when a side is not positive."""
    wide, high = _overlap(a, b)
    inter = wide * high
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    positive = (a["width"] > 0) & (a["height"] > 0) & (b["width"] > 0) & (b["height"] > 0)
    return F.when(
        positive & (wide > 0) & (high > 0) & (union > 0),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), inter / F.when(union > 0, union))),
    ).otherwise(F.lit(0.0))


def detector_iou(a: Column, b: Column) -> Column:
    """The detector's variant: no guard on the sides and no clamp."""
    wide, high = _overlap(a, b)
    inter = wide * high
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(
        (wide > 0) & (high > 0) & (union > 0), inter / F.when(union > 0, union)
    ).otherwise(F.lit(0.0))


def center(b: Column) -> Column:
    return point(b["x"] + b["width"] / 2, b["y"] + b["height"] / 2)


def number(v: Column) -> Column:
    """Not NaN; Spark orders NaN above every number, plain arithmetic compares it false."""
    return ~F.isnan(v)


def complete(b: Column) -> Column:
    """All four values are there and are numbers; anything else meets no other box."""
    parts = [b[k] for k in ("x", "y", "width", "height")]
    return F.coalesce(*[F.when(p.isNull() | F.isnan(p), False) for p in parts], F.lit(True))


def contains(b: Column, p: Column) -> Column:
    """Inclusive on all four edges; a NaN edge or coordinate contains nothing."""
    right, bottom = b["x"] + b["width"], b["y"] + b["height"]
    return (
        (p["x"] >= b["x"])
        & (p["x"] <= right)
        & (p["y"] >= b["y"])
        & (p["y"] <= bottom)
        & number(p["x"]) & number(p["y"]) & number(right) & number(bottom)
    )


def overlaps(a: Column, b: Column, threshold: float) -> Column:
    """Detector overlap above the threshold; NaN overlaps nothing."""
    shared = detector_iou(a, b)
    return (shared > threshold) & number(shared)


def same_face(a: Column, b: Column, threshold: float = settings.MERGE_IOU) -> Column:
    """Two passes saw the same face: overlap, or either centre inside the other."""
    return (
        overlaps(a, b, threshold) | contains(a, center(b)) | contains(b, center(a))
    )


def intersects(mask: Column, rect: Column) -> Column:
    """A visible mask shares some area with a rectangle."""
    return (
        (mask["width"] > 0)
        & (mask["height"] > 0)
        & (mask["x"] < rect["x"] + rect["width"])
        & (mask["x"] + mask["width"] > rect["x"])
        & (mask["y"] < rect["y"] + rect["height"])
        & (mask["y"] + mask["height"] > rect["y"])
    )


def grow_centered(
    b: Column,
    image_width: Column,
    image_height: Column,
    scale_x: float = settings.BOX_SCALE_X,
    scale_y: float = settings.BOX_SCALE_Y,
) -> Column:
    """Grow about the centre, every corner clamped into the image."""

    def clamp(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, top.cast("double")))

    half_w, half_h = b["width"] * scale_x / 2, b["height"] * scale_y / 2
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    left, right = clamp(cx - half_w, image_width), clamp(cx + half_w, image_width)
    top, bottom = clamp(cy - half_h, image_height), clamp(cy + half_h, image_height)
    return box(
        left, top, F.greatest(F.lit(0.0), right - left), F.greatest(F.lit(0.0), bottom - top)
    )


def grow_by_margin(
    b: Column,
    margin_x: float = settings.BOX_MARGIN_X,
    margin_y: float = settings.BOX_MARGIN_Y,
    scale_x: float = settings.BOX_SCALE_X,
    scale_y: float = settings.BOX_SCALE_Y,
    clamp_width: Column | None = None,
    clamp_height: Column | None = None,
) -> Column:
    """Shift by a margin, scale the sides, optionally cut to a frame."""
    x, y = b["x"] - b["width"] * margin_x, b["y"] - b["height"] * margin_y
    width, height = b["width"] * scale_x, b["height"] * scale_y
    if clamp_width is None or clamp_height is None:
        return box(x, y, width, height)
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    right = F.least(x + width, clamp_width.cast("double"))
    bottom = F.least(y + height, clamp_height.cast("double"))
    return box(
        left, top, F.greatest(right - left, F.lit(0.0)), F.greatest(bottom - top, F.lit(0.0))
    )


def _fit_scales(sw: Column, sh: Column, rw: Column, rh: Column, fit: Column):
    wide = rw / F.when(sw > 0, sw)
    high = rh / F.when(sh > 0, sh)
    shrink = (sw > rw) | (sh > rh)
    uniform = (
        F.when(fit == "contain", F.least(wide, high))
        .when(fit == "cover", F.greatest(wide, high))
        .when(fit == "none", F.lit(1.0))
        .when(fit == "scale-down", F.when(shrink, F.least(wide, high)).otherwise(F.lit(1.0)))
    )
    return F.coalesce(uniform, wide), F.coalesce(uniform, high)


def _d(*columns: Column) -> list[Column]:
    return [c.cast("double") for c in columns]


def fit_to_element(
    b: Column,
    source_width: Column,
    source_height: Column,
    rendered_width: Column,
    rendered_height: Column,
    fit: Column,
) -> Column:
    """Source pixels to rendered pixels for the five object-fit modes, centred."""
    sw, sh, rw, rh = _d(source_width, source_height, rendered_width, rendered_height)
    scale_x, scale_y = _fit_scales(sw, sh, rw, rh, fit)
    mapped = box(
        b["x"] * scale_x + (rw - sw * scale_x) / 2,
        b["y"] * scale_y + (rh - sh * scale_y) / 2,
        b["width"] * scale_x,
        b["height"] * scale_y,
    )
    # "fill" stretches edge to edge, so its offset is exactly zero.
    filled = box(b["x"] * scale_x, b["y"] * scale_y, b["width"] * scale_x, b["height"] * scale_y)
    known = fit.isin("contain", "cover", "none", "scale-down")
    empty = (sw <= 0) | (sh <= 0)
    return F.when(empty, box(0, 0, 0, 0)).when(known, mapped).otherwise(filled)


def axis_offset(component: Column, free: Column) -> Column:
    offset = component["px"] + component["pct"] / 100.0 * free
    return F.when(component["from_end"], free - offset).otherwise(offset)


def fit_with_position(
    b: Column,
    source_width: Column,
    source_height: Column,
    content_width: Column,
    content_height: Column,
    fit: Column,
    position: Column,
) -> Column:
    """Like :func:`fit_to_element` with an object-position; empty content maps to zero."""
    sw, sh, cw, ch = _d(source_width, source_height, content_width, content_height)
    scale_x, scale_y = _fit_scales(sw, sh, cw, ch, fit)
    mapped = box(
        b["x"] * scale_x + axis_offset(position["x"], cw - sw * scale_x),
        b["y"] * scale_y + axis_offset(position["y"], ch - sh * scale_y),
        b["width"] * scale_x,
        b["height"] * scale_y,
    )
    empty = (sw <= 0) | (sh <= 0) | (cw <= 0) | (ch <= 0)
    return F.when(empty, box(0, 0, 0, 0)).otherwise(mapped)


# A leading decimal number, as a lenient float parser reads it.
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def parse_position(value: Column) -> Column:
    """STRUCT<x, y: STRUCT<pct, px, from_end>> of an object-position string.

    One left fold over the tokens: edge keywords open an axis for a following length,
    bare lengths fill x then y, unknown tokens are skipped.
    """
    text = F.when(value.isNull() | (value == ""), "center").otherwise(value)
    tokens = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != "")

    def axis(pct, px, from_end):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            lit(pct).cast("double").alias("pct"),
            lit(px).cast("double").alias("px"),
            lit(from_end).cast("boolean").alias("from_end"),
        )

    def state(x, y, pending, x_done, y_done):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            x.alias("x"),
            y.alias("y"),
            lit(pending).cast("string").alias("pending"),
            lit(x_done).cast("boolean").alias("x_done"),
            lit(y_done).cast("boolean").alias("y_done"),
        )

    middle = axis(50, 0, False)

    def step(s: Column, t: Column) -> Column:
        number = F.regexp_extract(t, _NUMBER, 0)
        amount = F.when(number != "", number.try_cast("double"))
        pct = F.when(t.endswith("%"), amount).otherwise(F.lit(0.0))
        px = F.when(t.endswith("px"), amount).otherwise(F.lit(0.0))
        is_length = ((t.endswith("%") | t.endswith("px")) & amount.isNotNull()) | (t == "0")
        onto = lambda a: axis(pct, px, a["from_end"])
        fresh = axis(pct, px, False)
        length = (
            F.when(s["pending"] == "x", state(onto(s["x"]), s["y"], None, s["x_done"], s["y_done"]))
            .when(s["pending"] == "y", state(s["x"], onto(s["y"]), None, s["x_done"], s["y_done"]))
            .when(~s["x_done"], state(fresh, s["y"], None, True, s["y_done"]))
            .when(~s["y_done"], state(s["x"], fresh, None, s["x_done"], True))
            .otherwise(s)
        )
        middle_word = (
            F.when(~s["x_done"], state(middle, s["y"], None, True, s["y_done"]))
            .when(~s["y_done"], state(s["x"], middle, None, s["x_done"], True))
            .otherwise(state(s["x"], s["y"], None, s["x_done"], s["y_done"]))
        )
        return (
            F.when(
                t.isin("left", "right"),
                state(axis(0, 0, t == "right"), s["y"], "x", True, s["y_done"]),
            )
            .when(
                t.isin("top", "bottom"),
                state(s["x"], axis(0, 0, t == "bottom"), "y", s["x_done"], True),
            )
            .when(t == "center", middle_word)
            .when(is_length, length)
            .otherwise(s)
        )

    return F.aggregate(
        tokens,
        state(middle, middle, None, False, False),
        step,
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")),
    )


def content_box(
    border: Column, left: Column, right: Column, top: Column, bottom: Column,
    pad_left: Column, pad_right: Column, pad_top: Column, pad_bottom: Column,
) -> Column:
    """Border box minus borders and padding; null when nothing is left."""
    number = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
    left, right, top, bottom = (number(c) for c in (left, right, top, bottom))
    pad_left, pad_right, pad_top, pad_bottom = (
        number(c) for c in (pad_left, pad_right, pad_top, pad_bottom)
    )
    width = border["width"] - left - right - pad_left - pad_right
    height = border["height"] - top - bottom - pad_top - pad_bottom
    visible = (border["width"] > 0) & (border["height"] > 0) & (width > 0) & (height > 0)
    return F.when(
        visible, box(border["x"] + left + pad_left, border["y"] + top + pad_top, width, height)
    )


def frame_to_source(
    b: Column, frame_width: Column, frame_height: Column, source_width: Column, source_height: Column
) -> Column:
    """A box of a down-scaled frame in intrinsic pixels; null without a frame size."""
    fw, fh, sw, sh = _d(frame_width, frame_height, source_width, source_height)
    safe_w, safe_h = F.when(fw > 0, fw), F.when(fh > 0, fh)
    return F.when(
        (fw > 0) & (fh > 0) & (sw > 0) & (sh > 0),
        box(
            b["x"] * sw / safe_w,
            b["y"] * sh / safe_h,
            b["width"] * sw / safe_w,
            b["height"] * sh / safe_h,
        ),
    )


def frame_size(width: Column, height: Column, max_width: int = settings.FRAME_MAX_WIDTH) -> Column:
    """Down-scale only, half-up rounding, at least one pixel; null for an empty source."""
    scale = F.least(F.lit(1.0), F.lit(float(max_width)) / F.when(width > 0, width))
    side = lambda v: F.greatest(F.lit(1), half_up(v * scale)).cast("bigint")
    return F.when(
        (width > 0) & (height > 0),
        F.struct(side(width).alias("width"), side(height).alias("height")),
    )


def scale_detection(
    b: Column, landmarks: Column, scale_x: Column, scale_y: Column,
    offset_x: Column | None = None, offset_y: Column | None = None,
) -> tuple[Column, Column]:
    """Detector-input box and five points in source pixels, eyes and mouth left to right."""
    ox = F.lit(0.0) if offset_x is None else offset_x
    oy = F.lit(0.0) if offset_y is None else offset_y
    moved = box(
        b["x"] * scale_x + ox, b["y"] * scale_y + oy, b["width"] * scale_x, b["height"] * scale_y
    )
    pts = F.transform(landmarks, lambda p: point(p["x"] * scale_x + ox, p["y"] * scale_y + oy))
    first = lambda i, j: F.when(pts[i]["x"] <= pts[j]["x"], pts[i]).otherwise(pts[j])
    second = lambda i, j: F.when(pts[i]["x"] <= pts[j]["x"], pts[j]).otherwise(pts[i])
    return moved, F.array(first(0, 1), second(0, 1), pts[2], first(3, 4), second(3, 4))


# The five-point face template on a 112 pixel chip
# (left eye, right eye, nose, left mouth corner, right mouth corner).
TEMPLATE_POINTS = (
    (38.2946, 51.6963),
    (73.5318, 51.5014),
    (56.0252, 71.7366),
    (41.5493, 92.3655),
    (70.7299, 92.2041),
)


def template(size: int = settings.CHIP_SIZE) -> Column:
    scale = size / settings.CHIP_SIZE
    return F.array(*[point(F.lit(x * scale), F.lit(y * scale)) for x, y in TEMPLATE_POINTS])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def similarity_transform(src: Column, dst: Column) -> Column:
    """Least-squares STRUCT<a, b, tx, ty> mapping src points onto dst points.

    Fewer than two pairs give the identity, coincident sources a pure translation.
    """
    count = F.least(F.size(src), F.size(dst))
    zipped = F.slice(
        F.zip_with(src, dst, lambda s, d: F.struct(s.alias("s"), d.alias("d"))),
        1,
        F.greatest(count, F.lit(1)),
    )
    n = F.greatest(count, F.lit(1)).cast("double")

    def fit(pairs: Column) -> Column:
        mean = lambda side, axis: _total(F.transform(pairs, lambda p: p[side][axis])) / n
        means = F.struct(
            mean("s", "x").alias("sx"),
            mean("s", "y").alias("sy"),
            mean("d", "x").alias("dx"),
            mean("d", "y").alias("dy"),
        )
        return let(means, lambda m: solve(pairs, m))

    def solve(pairs: Column, m: Column) -> Column:
        u = lambda p, axis: p["s"][axis] - m["s" + axis]
        v = lambda p, axis: p["d"][axis] - m["d" + axis]
        sums = F.struct(
            _total(F.transform(pairs, lambda p: u(p, "x") * u(p, "x") + u(p, "y") * u(p, "y"))).alias(
                "denom"
            ),
            _total(F.transform(pairs, lambda p: u(p, "x") * v(p, "x") + u(p, "y") * v(p, "y"))).alias(
                "along"
            ),
            _total(F.transform(pairs, lambda p: u(p, "x") * v(p, "y") - u(p, "y") * v(p, "x"))).alias(
                "across"
            ),
        )

        def finish(s: Column) -> Column:
            safe = F.when(s["denom"] != 0, s["denom"])
            a = F.when(s["denom"] == 0, 1.0).otherwise(s["along"] / safe)
            b = F.when(s["denom"] == 0, 0.0).otherwise(s["across"] / safe)
            return _transform(
                a, b, m["dx"] - (a * m["sx"] - b * m["sy"]), m["dy"] - (b * m["sx"] + a * m["sy"])
            )

        return let(sums, finish)

    identity = _transform(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.when(count < 2, identity).otherwise(let(zipped, fit))


def _transform(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    return F.struct(
        a.cast("double").alias("a"),
        b.cast("double").alias("b"),
        tx.cast("double").alias("tx"),
        ty.cast("double").alias("ty"),
    )


def apply_transform(p: Column, t: Column) -> Column:
    return point(
        t["a"] * p["x"] - t["b"] * p["y"] + t["tx"], t["b"] * p["x"] + t["a"] * p["y"] + t["ty"]
    )


def invert_transform(t: Column) -> Column:
    """The inverse similarity; null when the transform has no area."""
    det = t["a"] * t["a"] + t["b"] * t["b"]
    safe = F.when(det != 0, det)
    a, b = t["a"] / safe, -t["b"] / safe
    return F.when(
        det != 0,
        _transform(a, b, -(a * t["tx"] - b * t["ty"]), -(b * t["tx"] + a * t["ty"])),
    )


def alignment_footprint(b: Column, landmarks: Column, size: int = settings.CHIP_SIZE) -> Column:
    """The source rectangle a chip is read from, in whole pixels.

    With five landmarks: the inverse-mapped chip corners, one source pixel wider on
    each side plus the second bilinear tap. Without: the box grown by a fifth.
    """
    edge = float(size - 1)
    chip = F.array(*[point(F.lit(x), F.lit(y)) for y in (0.0, edge) for x in (0.0, edge)])

    def around(corners: Column) -> Column:
        xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
        left, top = F.floor(F.array_min(xs)) - 1, F.floor(F.array_min(ys)) - 1
        return box(left, top, F.floor(F.array_max(xs)) + 3 - left, F.floor(F.array_max(ys)) + 3 - top)

    def footprint(inverse: Column) -> Column:
        corners = F.transform(chip, lambda p: apply_transform(p, inverse))
        return F.when(inverse.isNull(), box(0, 0, 0, 0)).otherwise(let(corners, around))

    fitted = similarity_transform(F.slice(landmarks, 1, 5), template(size))
    warped = let(let(fitted, invert_transform), footprint)
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    half_w, half_h = b["width"] * 1.2 / 2, b["height"] * 1.2 / 2
    x0, y0 = F.floor(cx - half_w), F.floor(cy - half_h)
    grown = box(x0, y0, F.ceil(cx + half_w) - x0, F.ceil(cy + half_h) - y0)
    return F.when(landmarks.isNotNull() & (F.size(landmarks) >= 5), warped).otherwise(grown)


def padded_region(
    b: Column, image_width: Column, image_height: Column, pad: float = 0.6
) -> Column:
    """The box padded on every side, in whole pixels inside the image, at least 1 by 1."""
    pad_x, pad_y = b["width"] * pad, b["height"] * pad
    x0 = F.greatest(F.lit(0), F.floor(b["x"] - pad_x))
    y0 = F.greatest(F.lit(0), F.floor(b["y"] - pad_y))
    x1 = F.least(image_width.cast("bigint"), F.ceil(b["x"] + b["width"] + pad_x))
    y1 = F.least(image_height.cast("bigint"), F.ceil(b["y"] + b["height"] + pad_y))
    return box(x0, y0, F.greatest(F.lit(1), x1 - x0), F.greatest(F.lit(1), y1 - y0))
