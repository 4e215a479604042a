"""Media references in documents, image bytes and frame payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.functions import images, text


def discover_media(
    documents: DataFrame,
    html: str = "html",
    keep: tuple[str, ...] = ("page_id", "url"),
    tag: str = "img",
    attribute: str = "src",
) -> DataFrame:
    """Every ``tag`` of every document in order: ``keep..., ord, ref, media_url``.

    Attribute values may be quoted either way or bare.
    """
    found = F.regexp_extract_all(
        html,
        F.lit(rf"""(?i)<{tag}\b[^>]*?\s{attribute}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""),
        1,
    )
    refs = documents.select(*keep, F.posexplode(found).alias("ord", "__raw"))
    bare = F.regexp_replace("__raw", "^[\"']|[\"']$", "")
    return (
        refs.withColumn("ref", F.replace(bare, F.lit("&amp;"), F.lit("&")))
        .drop("__raw")
        .withColumn("media_url", text.resolve_url(F.col("url"), F.trim("ref")))
    )


def type_fault(media_type: Column) -> Column:
    """Why a media type is refused, or null. An unknown type is let through."""
    plain = F.lower(F.trim(F.substring_index(F.coalesce(media_type, F.lit("")), ";", 1)))
    return F.when(plain == "image/svg+xml", "svg-refused").when(
        (plain != "") & (plain != "application/octet-stream") & ~plain.startswith("image/"),
        "unsupported-type",
    )


def image_fault(
    length: Column, media_type: Column, width: Column | None = None, height: Column | None = None
) -> Column:
    """First failed check of an image: type, empty, byte cap, pixel cap."""
    fault = F.coalesce(
        type_fault(media_type),
        F.when(length == 0, "empty").when(length > settings.MAX_IMAGE_BYTES, "too-large"),
    )
    if width is None or height is None:
        return fault
    pixels = width.cast("bigint") * height.cast("bigint")
    return F.coalesce(
        fault,
        F.when(pixels == 0, "empty-image").when(pixels > settings.MAX_IMAGE_PIXELS, "too-many-pixels"),
    )


def read_image_bytes(
    spark: SparkSession, path: str, media_type: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted files with content, and ``(path, reason)`` of refused ones.

    Size tests read the file listing only, so a file refused by them is never opened; the
    pixel cap reads the width and height in a file's header, before anything is decoded.
    A file without a readable header is left to the decoder. Spark's file listing leaves
    empty files out, so they are in neither result.
    """
    files = spark.read.format("binaryFile").load(path)
    if media_type is None:
        ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
        media_type = (
            F.when(ending == "svg", "image/svg+xml")
            .when(ending.isin("jpg", "jpeg"), "image/jpeg")
            .when(ending.isin("png", "webp", "gif", "bmp"), F.concat(F.lit("image/"), ending))
            .when(ending == "", "")
            .otherwise("application/octet-stream")
        )
    listed = image_fault(F.col("length"), media_type)
    sized = files.where(listed.isNull()).withColumn("__size", images.image_size("content"))
    pixels = image_fault(F.col("length"), media_type, F.col("__size.width"), F.col("__size.height"))
    rejected = files.where(listed.isNotNull()).select("path", listed.alias("reason")).unionByName(
        sized.where(pixels.isNotNull()).select("path", pixels.alias("reason"))
    )
    return sized.where(pixels.isNull()).select("path", "length", "content"), rejected


def decode_frames(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Base64 frame payloads to ``content``; ``fault`` says why there is none.

    Over-long text is refused by its length, before any decoding.
    """
    size = F.length(payload)
    usable = (size > 0) & (size <= settings.MAX_BASE64_CHARS)
    content = F.when(usable, F.try_to_binary(F.col(payload), F.lit("base64")))
    return frames.withColumn("content", content).withColumn(
        "fault",
        F.when(F.col(payload).isNull() | (size == 0), "empty")
        .when(size > settings.MAX_BASE64_CHARS, "too-long")
        .when(F.col("content").isNull() | (F.length("content") == 0), "malformed"),
    )


def eligibility(media: DataFrame, url: str = "media_url") -> DataFrame:
    """Add ``reason``: why a medium is skipped, else "queued".

    ``natural_width`` is the decoded width (0 = failed image), ``shown_width`` and
    ``shown_height`` the size on the page.
    """
    return media.withColumn(
        "reason",
        F.when(F.coalesce(F.col(url), F.lit("")) == "", "no-source")
        .when(~F.col(url).rlike("(?i)^https?://"), "scheme")
        .when(F.col("natural_width") == 0, "empty")
        .when(
            (F.col("shown_width") < settings.MIN_MEDIA_PX)
            | (F.col("shown_height") < settings.MIN_MEDIA_PX),
            "small",
        )
        .otherwise("queued"),
    )


def random_unit_vectors(spark: SparkSession, rows: int, width: int, seed: int) -> DataFrame:
    """Seeded unit vectors ``(vec_id, embedding)``, for tests and demonstrations."""
    from maskwright.functions.vectors import l2_normalize

    parts = [F.randn(seed + d).cast("float") for d in range(width)]
    return spark.range(rows).select(
        F.col("id").alias("vec_id"), l2_normalize(F.array(*parts)).alias("embedding")
    )


ROUND_SCHEMA = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("generation", T.LongType()),
        T.StructField("captured_ms", T.LongType()),
        T.StructField("arrived_ms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField(
            "boxes",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height")]
                    + [T.StructField("identity_id", T.StringType())]
                )
            ),
        ),
    ]
)


def stream_rounds(
    spark: SparkSession, path: str, max_files_per_trigger: int = 1, schema: T.StructType = ROUND_SCHEMA
) -> DataFrame:
    """Detection rounds landing as parquet files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def write_results(df: DataFrame, path: str, by: str | None = None, mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)
