"""The curated directory of people, and the persisted gallery."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEOPLE = (
    "id STRING, name STRING, aliases ARRAY<STRING>,"
    " references ARRAY<STRUCT<path: STRING, source: STRING>>"
)
GALLERY = (
    "identity_id STRING, identity_ord BIGINT, kind STRING, ord BIGINT, embedding ARRAY<FLOAT>"
)
IDENTITY = (
    "identity_id STRING, identity_ord BIGINT, name STRING, threshold DOUBLE, created_at BIGINT"
)
META = "enabled BOOLEAN, revision BIGINT"


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """People of a JSON array, in file order as ``person_ord``; any other shape is an error."""
    whole = spark.read.text(path, wholetext=True)
    people = F.from_json("value", f"ARRAY<STRUCT<{PEOPLE}>>", {"mode": "PERMISSIVE"})
    checked = whole.select(
        F.when(F.ltrim("value").startswith("[") & people.isNotNull(), people)
        .otherwise(F.raise_error(F.lit("the directory is not an array of people, or cut short")))
        .alias("people")
    )
    return checked.select(F.posexplode("people").alias("person_ord", "person")).select(
        "person_ord", "person.*"
    )


def write_gallery(
    folder: str, revision: int, gallery: DataFrame, identities: DataFrame, enabled: bool = True, retry: bool = False
) -> None:
    """One directory per revision; the small state row is written last, so a revision
    without it was never committed.

    A revision is claimed by creating a file that must not exist, so of several writers of
    one revision all but the first get an error, and a committed one is never written again.
    ``retry`` takes over a claim whose writer failed before it committed.
    """
    spark = gallery.sparkSession
    if revision in _revisions(spark, folder):
        raise ValueError(f"revision {revision} is committed already")
    base = f"{folder}/revision={revision}"
    claim = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/_claim")
    fs = claim.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(claim, retry).close()
    except Py4JJavaError as error:
        raise ValueError(f"revision {revision} is being written by another") from error
    gallery.write.mode("overwrite").parquet(f"{base}/gallery")
    identities.write.mode("overwrite").parquet(f"{base}/identity")
    state = gallery.sparkSession.createDataFrame([(enabled, revision)], META)
    state.coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")


def _revisions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("revision=")]
    committed = lambda n: fs.exists(
        jvm.org.apache.hadoop.fs.Path(f"{folder}/revision={n}/meta/_SUCCESS")
    )
    return sorted(n for n in numbers if committed(n))


def read_gallery(
    spark: SparkSession, folder: str, revision: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(gallery, identity, meta)`` of a revision, by default the last committed one.

    A store without one starts enabled, empty and at revision 0.
    """
    known = _revisions(spark, folder)
    if not known:
        return (
            spark.createDataFrame([], GALLERY),
            spark.createDataFrame([], IDENTITY),
            spark.createDataFrame([(True, 0)], META),
        )
    base = f"{folder}/revision={known[-1] if revision is None else revision}"
    return (
        spark.read.schema(GALLERY).parquet(f"{base}/gallery"),
        spark.read.schema(IDENTITY).parquet(f"{base}/identity"),
        spark.read.schema(META).parquet(f"{base}/meta"),
    )


def redacted_view(meta: DataFrame) -> DataFrame:
    """What callers outside the owner see: the switch and the revision, no identities."""
    return meta.select("enabled", "revision")
