"""Face chips and batch model inference: the two jobs that need pixels or a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.functions import boxes, vectors
from maskwright.functions.bind import let
from maskwright.operators import blocks


#: Values of the chips that a task holds at once.
CHIP_VALUES = 1_000_000


def _bilinear(pixels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sample HWC pixels at float coordinates; taps outside the image count as zero."""
    height, width, _ = pixels.shape
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    out = np.zeros((*x.shape, pixels.shape[2]))
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            tx, ty = x0 + dx, y0 + dy
            inside = (tx >= 0) & (tx < width) & (ty >= 0) & (ty < height)
            tap = pixels[np.clip(ty, 0, height - 1), np.clip(tx, 0, width - 1)]
            out += np.where(inside[..., None], tap * wx[..., None] * wy[..., None], 0.0)
    return out


def warp_chip(pixels: np.ndarray, inverse: tuple[float, float, float, float], size: int) -> np.ndarray:
    """Inverse-mapped chip of HWC pixels; ``inverse`` is (a, b, tx, ty), chip to source."""
    a, b, tx, ty = inverse
    dy, dx = np.mgrid[0:size, 0:size].astype(np.float64)
    return _bilinear(pixels, a * dx - b * dy + tx, b * dx + a * dy + ty).astype(np.float32)


def resize_chip(pixels: np.ndarray, size: int) -> np.ndarray:
    """Pixel-centre aligned bilinear resize with clamped edges."""
    height, width, _ = pixels.shape
    axis = lambda n: np.clip((np.arange(size) + 0.5) * (n / size) - 0.5, 0, n - 1)
    y, x = np.meshgrid(axis(height), axis(width), indexing="ij")
    return _bilinear(pixels, x, y).astype(np.float32)


def face_chips(
    images: DataFrame,
    detections: DataFrame,
    size: int = settings.CHIP_SIZE,
    mean: float = 127.5,
    std: float = 127.5,
    bgr_source: bool = True,
    bgr_chip: bool = False,
) -> DataFrame:
    """Normalised planar chips, one ``ARRAY<FLOAT>`` of 3*size*size per detection.

    ``images(media_id, width, height, data)`` holds packed 3-channel rows, as Spark's
    image source delivers them; ``detections(media_id, det_ord, box, landmarks)``. The
    geometry is planned in Spark; tasks only read the pixels under each face, and
    images are cut to the needed region before they leave the join.
    """
    landmarks = F.col("landmarks")
    marked = landmarks.isNotNull() & (F.size(landmarks) >= 5)
    fitted = boxes.similarity_transform(F.slice(landmarks, 1, 5), boxes.template(size))
    inverse = let(fitted, boxes.invert_transform)
    footprint = boxes.alignment_footprint(F.col("box"), landmarks, size)
    planned = (
        detections.withColumn("__marked", marked)
        .withColumn("__inv", F.when(marked, inverse))
        .withColumn("__rect", footprint)
        .join(images.select("media_id", "width", "height", "data"), "media_id")
    )

    def inside(r: Column) -> Column:
        x0, y0 = F.greatest(F.lit(0.0), r["x"]), F.greatest(F.lit(0.0), r["y"])
        x1 = F.least(F.col("width").cast("double"), r["x"] + r["width"])
        y1 = F.least(F.col("height").cast("double"), r["y"] + r["height"])
        whole = lambda v: F.greatest(F.lit(0), v.cast("int"))
        return F.struct(
            x0.cast("int").alias("x0"),
            y0.cast("int").alias("y0"),
            whole(x1 - x0).alias("w"),
            whole(y1 - y0).alias("h"),
        )

    cut_rows = planned.select(
        "media_id",
        "det_ord",
        F.col("__marked").alias("marked"),
        "__inv.*",
        F.inline(F.array(let(F.col("__rect"), inside))),
        F.col("width").cast("int").alias("width"),
        "data",
    )
    # Only the image rows under the face travel to Python.
    region = F.substring(
        F.col("data"), F.col("y0") * F.col("width") * 3 + 1, F.col("h") * F.col("width") * 3
    )
    cut_rows = cut_rows.withColumn("data", F.when((F.col("w") > 0) & (F.col("h") > 0), region))
    schema = T.StructType(
        [
            detections.schema["media_id"],
            detections.schema["det_ord"],
            T.StructField("chip", T.ArrayType(T.FloatType())),
        ]
    )

    most = max(1, CHIP_VALUES // (3 * size * size))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (b.iloc[at : at + most] for b in batches for at in range(0, len(b), most)):
            chips = []
            for r in rows.itertuples(index=False):
                if r.data is None or (r.marked and pd.isna(r.a)):
                    chip = np.zeros((size, size, 3), dtype=np.float32)
                else:
                    strip = np.frombuffer(r.data, dtype=np.uint8).reshape(r.h, r.width, 3)
                    pixels = strip[:, r.x0 : r.x0 + r.w].astype(np.float64)
                    if bgr_source != bgr_chip:
                        pixels = pixels[..., ::-1]
                    if r.marked:
                        # the inverse map, shifted to the region's own origin
                        chip = warp_chip(pixels, (r.a, r.b, r.tx - r.x0, r.ty - r.y0), size)
                    else:
                        chip = resize_chip(pixels, size)
                scaled = ((chip.astype(np.float64) - mean) * (1.0 / (std or 1.0))).astype(np.float32)
                chips.append(np.ascontiguousarray(scaled.transpose(2, 0, 1)).reshape(-1))
            yield pd.DataFrame(
                {"media_id": rows["media_id"], "det_ord": rows["det_ord"], "chip": chips}
            )

    return cut_rows.mapInPandas(draw, schema)


def batch_inference(
    rows: DataFrame,
    keys: list[str],
    tensor: str,
    session_factory: Callable[[], Callable[[np.ndarray], np.ndarray]],
    output: str = "embedding",
) -> DataFrame:
    """Run a user's model over a tensor column, loaded once per task.

    ``session_factory()`` returns a function from a 2-d float array to a 2-d float array
    with as many rows.
    """
    schema = T.StructType(
        [*[rows.schema[k] for k in keys], T.StructField(output, T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = session_factory()
        for batch in batches:
            if not batch.num_rows:
                continue
            result = np.asarray(model(blocks.matrix(batch.column(tensor))), dtype=np.float32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], blocks.list_column(result)], names=[*keys, output]
            )

    return rows.select(*keys, tensor).mapInArrow(run, schema)


def checked_embeddings(
    outputs: DataFrame, keys: list[str], width: int, column: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Unit-length model outputs, and the faulty ones with their reason."""
    fault = vectors.embedding_fault(F.col(column), width, tolerance=None)
    rejected = outputs.select(*keys, fault.alias("reason")).where("reason is not null")
    good = outputs.where(fault.isNull()).withColumn(column, vectors.l2_normalize(F.col(column)))
    return good, rejected
