"""Reconciling files with ledgers and allow-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "path STRING, bytes BIGINT, sha256 STRING, shipped BOOLEAN"


def read_ledger(
    spark: SparkSession, path: str, schema: str = LEDGER, root: str | None = None
) -> DataFrame:
    """JSON ledger rows; missing, malformed and empty ledgers are errors, not empty sets.

    ``root`` names the field that holds the entries of an object-shaped ledger. An entry
    without a path is malformed, and so is an object read without its ``root``.
    """
    shape = schema if root is None else f"`{root}` ARRAY<STRUCT<{schema}>>"
    rows = spark.read.schema(f"{shape}, _broken STRING").option("multiLine", True).option(
        "mode", "PERMISSIVE"
    ).option("columnNameOfCorruptRecord", "_broken").json(path)
    if root is not None:
        rows = rows.select("_broken", F.explode_outer(root).alias("entry")).select("_broken", "entry.*")
    if rows.isEmpty():
        raise ValueError("the ledger has no entries")
    return rows.select(
        *[
            F.when(F.col("_broken").isNull() & F.col("path").isNotNull(), F.col(c))
            .otherwise(F.raise_error(F.lit("the ledger is malformed")))
            .alias(c)
            for c in rows.columns
            if c != "_broken"
        ]
    )


def hash_files(files: DataFrame, content: str = "content") -> DataFrame:
    """``(path, length, sha256)`` of binary files; content is read once and not kept."""
    return files.select("path", "length", F.sha2(F.col(content), 256).alias("sha256"))


def reconcile(files: DataFrame, ledger: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Issue rows ``(path, issue)`` of a ledger against hashed files ``(path, length, sha256)``.

    An entry that is not shipped may be absent, but is checked when it exists.
    """
    f = files.select("path", F.col("length").alias("f_bytes"), F.col("sha256").alias("f_sha"))
    l = ledger.select(
        "path", F.col("bytes").alias("l_bytes"), F.col("sha256").alias("l_sha"),
        F.coalesce("shipped", F.lit(True)).alias("shipped"), F.lit(True).alias("listed"),
    )
    both = f.join(l, "path", "full_outer")
    present = F.col("f_bytes").isNotNull()
    listed = F.coalesce("listed", F.lit(False))
    issue = lambda condition, name: F.when(condition, F.lit(name))
    found = F.array_compact(
        F.array(
            issue(listed & ~present & F.col("shipped"), "missing-file"),
            issue(listed & present & (F.col("l_bytes") != F.col("f_bytes")), "byte-count"),
            issue(listed & present & (F.col("l_sha") != F.col("f_sha")), "sha256"),
            issue(listed & present & F.col("l_sha").isNull(), "no-sha256"),
        )
    )
    issues = both.select("path", F.explode(found).alias("issue"))
    if required is None:
        return issues
    absent = required.select("path").join(ledger.select("path"), "path", "left_anti")
    return issues.unionByName(absent.select("path", F.lit("not-in-ledger").alias("issue")))


def normal_path(path: Column) -> Column:
    forward = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(F.regexp_replace(forward, r"^\./", ""), "/$", "")


def classify_paths(
    paths: DataFrame, allowed: DataFrame, banned_suffixes: tuple[str, ...] = (".DS_Store", ".map"),
    never: DataFrame | None = None,
) -> DataFrame:
    """Add ``verdict``: "allowed" for a normalised path on the list, else "forbidden".

    A banned suffix or an entry of ``never`` outranks the list.
    """
    normal = paths.withColumn("normal", normal_path(F.col("path")))
    listed = allowed.select(F.col("path").alias("normal")).distinct().withColumn("__ok", F.lit(True))
    judged = normal.join(listed, "normal", "left")
    bad = F.col("normal") == ""
    for suffix in banned_suffixes:
        bad = bad | F.col("normal").endswith(suffix)
    if never is not None:
        judged = judged.join(
            never.select(F.col("path").alias("normal")).distinct().withColumn("__never", F.lit(True)),
            "normal", "left",
        )
        bad = bad | F.coalesce("__never", F.lit(False))
    ok = F.coalesce("__ok", F.lit(False)) & ~bad
    return judged.withColumn("verdict", F.when(ok, "allowed").otherwise("forbidden")).drop(
        "__ok", "__never"
    )


def check_listing(
    entries: DataFrame, allowed: DataFrame, required: DataFrame, never: DataFrame
) -> DataFrame:
    """Issues of an archive listing: unapproved, missing and forbidden entries.

    Directory entries (trailing slash) are ignored.
    """
    files = entries.where(~F.col("path").endswith("/"))
    files = files.select(normal_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    judged = classify_paths(files, allowed, never=never)
    tag = lambda df, name: df.select("path", F.lit(name).alias("issue"))
    return (
        tag(judged.where("verdict = 'forbidden'"), "unapproved")
        .unionByName(tag(required.select("path").join(files, "path", "left_anti"), "missing"))
        .unionByName(tag(never.select("path").join(files, "path", "left_semi"), "excluded-present"))
    )


def dangling_references(people: DataFrame, files: DataFrame) -> DataFrame:
    """Local reference paths of a directory that no file stands behind."""
    refs = people.select("id", F.explode("references").alias("r")).select("id", "r.path")
    local = refs.where(F.col("path").isNotNull() & ~F.col("path").rlike("(?i)^https?://"))
    return local.join(files.select("path"), "path", "left_anti")
