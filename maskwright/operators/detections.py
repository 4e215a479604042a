"""Detector output: decoding, suppression, merging, tiles and the pass policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.functions import boxes
from maskwright.operators import blocks, greedy


def prior_grid(inputs: DataFrame, strides: tuple[int, ...] = settings.STRIDES) -> DataFrame:
    """Cells of each stride for ``inputs(input_size, ...)``: adds stride, side, row, col."""
    grid = inputs.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides]))).withColumn(
        "side", F.floor(F.col("input_size") / F.col("stride")).cast("int")
    )
    cell = grid.where("side > 0").withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1))
    )
    return cell.withColumn("row", (F.col("cell") / F.col("side")).cast("int")).withColumn(
        "col", F.col("cell") % F.col("side")
    )


def decode_tensors(
    tensors: DataFrame, keys: list[str], threshold: float = settings.DETECTION_SCORE
) -> DataFrame:
    """Raw detector tensors to boxes in detector-input pixels.

    ``tensors(keys, stride, side, cls, obj, bbox, kps)``, one row per medium and stride.
    Scores are filtered before any box is built; a missing tensor yields nothing. Adds
    ``cell, score, box, landmarks``.
    """
    value = lambda a, i: F.get(F.col(a), i).cast("double")
    cells = F.least(F.greatest(F.size("cls"), F.size("obj")), F.col("side") * F.col("side")).cast("int")
    cell = F.col("__cell")
    positive = lambda a: F.greatest(F.lit(0.0), value(a, cell))
    # a row per cell costs far less than functions over arrays of them
    hits = (
        tensors.where("cls is not null and obj is not null and bbox is not null and kps is not null")
        .withColumn("__cell", F.explode(F.when(cells > 0, F.sequence(F.lit(0), cells - 1))))
        .withColumn("__score", F.sqrt(positive("cls") * positive("obj")))
        .where(F.col("__score") >= threshold)
    )
    col = (cell % F.col("side")).cast("double")
    row = F.floor(cell / F.col("side")).cast("double")
    stride = F.col("stride").cast("double")
    cx, cy = (col + value("bbox", cell * 4)) * stride, (row + value("bbox", cell * 4 + 1)) * stride
    width = F.exp(value("bbox", cell * 4 + 2)) * stride
    height = F.exp(value("bbox", cell * 4 + 3)) * stride
    points = F.array(
        *[
            boxes.point(
                (col + value("kps", cell * 10 + 2 * k)) * stride,
                (row + value("kps", cell * 10 + 2 * k + 1)) * stride,
            )
            for k in range(5)
        ]
    )
    return hits.select(
        *keys,
        "stride",
        cell.alias("cell"),
        F.col("__score").alias("score"),
        boxes.box(cx - width / 2, cy - height / 2, width, height).alias("box"),
        points.alias("landmarks"),
    )


def suppress(
    detections: DataFrame,
    keys: list[str],
    ties: list[str],
    threshold: float = settings.NMS_IOU,
    score: str = "score",
    box: str = "box",
    **sizes,
) -> DataFrame:
    """Non-maximum suppression per group: best score first, ties in ``ties`` order."""
    return greedy.keep_first_boxes(
        detections,
        keys,
        [-F.col(score), *[F.col(t) for t in ties]],
        box,
        greedy.overlap_conflict(threshold),
        **sizes,
    )


def merge_passes(
    existing: DataFrame,
    added: DataFrame,
    keys: list[str],
    order: list[str],
    threshold: float = settings.MERGE_IOU,
    box: str = "box",
    **sizes,
) -> DataFrame:
    """Detections of a second pass join the first unless they show a face already there.

    All existing rows stay in front, in their order; ``second_pass`` marks the added ones.
    """
    both = existing.withColumn("second_pass", F.lit(False)).unionByName(
        added.withColumn("second_pass", F.lit(True))
    )
    return greedy.keep_first_boxes(both, *_merging(keys, order, threshold, box), **sizes)


def _merging(keys: list[str], order: list[str], threshold: float = settings.MERGE_IOU, box: str = "box") -> tuple:
    """How rows marked by ``second_pass`` join those that are not."""
    second = F.col("second_pass")
    return keys, [second, *[F.col(c) for c in order]], box, greedy.same_face_conflict(threshold), ~second


def tile_grid(
    images: DataFrame,
    grid: int = settings.TILE_GRID,
    overlap: float = settings.TILE_OVERLAP,
    minimum: int = settings.MIN_TILE_PX,
) -> DataFrame:
    """Overlapping tiles of ``images(width, height, ...)``: adds ox, oy, tile_width,
    tile_height; slivers under ``minimum`` are skipped."""
    side = lambda v: F.ceil(F.col(v) / F.lit(float(grid))).cast("bigint")
    step = lambda v: F.greatest(F.lit(1), boxes.half_up(side(v) * (1.0 - overlap))).cast("bigint")
    starts = lambda v: F.sequence(
        F.lit(0).cast("bigint"), F.col(v).cast("bigint") - 1, step(v)
    )
    tiles = (
        images.where("width > 0 and height > 0")
        .withColumn("oy", F.explode(starts("height")))
        .withColumn("ox", F.explode(starts("width")))
        .withColumn("tile_width", F.least(side("width"), F.col("width").cast("bigint") - F.col("ox")))
        .withColumn("tile_height", F.least(side("height"), F.col("height").cast("bigint") - F.col("oy")))
    )
    return tiles.where((F.col("tile_width") >= minimum) & (F.col("tile_height") >= minimum))


def merge_tiles(
    tile_detections: DataFrame,
    keys: list[str],
    rank: list[str],
    threshold: float = settings.MERGE_IOU,
    **sizes,
) -> DataFrame:
    """Tile-local boxes in image coordinates, the first of each face across tiles.

    ``tile_detections(keys, oy, ox, rank..., box)``; order is tile row, tile column, rank.
    """
    b = F.col("box")
    moved = tile_detections.withColumn(
        "box", boxes.box(b["x"] + F.col("ox"), b["y"] + F.col("oy"), b["width"], b["height"])
    )
    return greedy.keep_first_boxes(
        moved,
        keys,
        [F.col("oy"), F.col("ox"), *[F.col(r) for r in rank]],
        "box",
        greedy.overlap_conflict(threshold),
        **sizes,
    )


def pass_policy(
    media: DataFrame,
    fast_counts: DataFrame,
    full_counts: DataFrame,
    crowd: int = settings.CROWD_FACES,
) -> DataFrame:
    """Which passes each medium needs: ``media_id, base_pass, base_faces, tiled``.

    ``*_counts(media_id, faces)`` count the detections of a pass; no row means none. A
    medium is taken from the full pass when the fast one found nothing, and tiled when
    its base pass found a crowd.
    """
    fast = fast_counts.select("media_id", F.col("faces").alias("__fast"))
    full = full_counts.select("media_id", F.col("faces").alias("__full"))
    empty = F.coalesce("__fast", F.lit(0)) == 0
    base = F.when(empty, F.coalesce("__full", F.lit(0))).otherwise(F.col("__fast"))
    return (
        media.select("media_id")
        .join(fast, "media_id", "left")
        .join(full, "media_id", "left")
        .select(
            "media_id",
            F.when(empty, "full").otherwise("fast").alias("base_pass"),
            base.cast("bigint").alias("base_faces"),
            (base >= crowd).alias("tiled"),
        )
    )


def cascade(
    media: DataFrame,
    fast: DataFrame,
    full: DataFrame,
    tiled: DataFrame,
    order: list[str],
    crowd: int = settings.CROWD_FACES,
    **sizes,
) -> DataFrame:
    """Final detections: fast pass, else full pass, tiles merged into crowds.

    Passes are lazy inputs ``(media_id, order..., box)``. The rows of a medium meet once, all
    passes together, and the counts of its passes tell which of them are used; media of too
    many rows for that are restricted by joins.
    """
    passes = [d.withColumn("__pass", F.lit(k)) for k, d in enumerate((fast, full, tiled))]
    rows = passes[0].unionByName(passes[1]).unionByName(passes[2])
    small, large = blocks.split_by_size(rows, ["media_id"], sizes.get("fold_rows", settings.FOLD_ROWS))
    known = media.select("media_id", F.lit(len(passes)).alias("__pass"))
    own = Window.partitionBy("media_id")
    count = lambda k: F.count(F.when(F.col("__pass") == k, 1)).over(own)
    # a medium without an id is none that joins find
    base = F.when(F.col("__n0") > 0, F.col("__n0")).when((F.col("__known") > 0) & F.col("media_id").isNotNull(), F.col("__n1"))
    used = F.when(F.col("__pass") == 1, (F.col("__n0") == 0) & base.isNotNull()).otherwise(
        (base >= max(crowd, 1)) & F.col("media_id").isNotNull()
    )
    both = (
        small.unionByName(known, allowMissingColumns=True)
        .withColumns({"__n0": count(0), "__n1": count(1), "__known": count(len(passes))})
        .where((F.col("__pass") == 0) | (F.col("__pass") < len(passes)) & used)
        .select(*fast.columns, (F.col("__pass") == 2).alias("second_pass"))
    )
    result = greedy.fold_boxes(both, *_merging(["media_id"], order))
    if large is None:
        return result
    fast, full, tiled = (large.where(F.col("__pass") == k).drop("__pass") for k in range(len(passes)))
    return result.unionByName(_joined_cascade(media, fast, full, tiled, order, crowd, **sizes))


def _joined_cascade(
    media: DataFrame, fast: DataFrame, full: DataFrame, tiled: DataFrame, order: list[str], crowd: int, **sizes
) -> DataFrame:
    """``cascade`` with the later passes restricted by joins."""
    count = lambda d: d.groupBy("media_id").agg(F.count("*").alias("faces"))
    missing = media.join(fast.select("media_id"), "media_id", "left_anti").select("media_id")
    base = fast.unionByName(full.join(missing, "media_id", "left_semi"))
    crowded = count(base).where(F.col("faces") >= crowd).select("media_id")
    extra = tiled.join(crowded, "media_id", "left_semi")
    return merge_passes(base, extra, ["media_id"], order, **sizes)
