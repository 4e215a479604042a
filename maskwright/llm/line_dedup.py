"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain
it over the number of the host's pages; lines above ``max_ratio`` that stand on at least
``min_pages`` pages are boilerplate and every occurrence is dropped.

Lines are keyed by two 64-bit hashes. Counting is a map-side combined aggregation over
the distinct lines of each page, so a host with a third of all pages adds one row per
task and line. Lines below ``min_pages`` go before the host totals are joined. What is
left is small where hosts repeat themselves little: up to ``ship_rows`` counted rows are
shipped to every page; beyond that the line positions of all pages meet the boilerplate
table by key, and only the positions to drop are grouped by page.

Defined cases: a null text has no lines and stays null; a null host is a host of its own;
a line with nothing but white space is a line break and is never boilerplate, nor is it
dropped; repeated rows are separate pages; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.lineage import cut

MAX_RATIO = 0.05
MIN_PAGES = 5
SHIP_ROWS = 100_000

_TYPE = "struct<a: bigint, b: bigint>"


def _key(line: str) -> str:
    return f"named_struct('a', xxhash64({line}), 'b', xxhash64({line}, 'line'))"


_LINES = "filter(split(text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


def line_counts(pages: DataFrame, host: str, min_pages: int) -> DataFrame:
    """``(host, line, pages)`` of lines on at least ``min_pages`` pages of a host."""
    lines = pages.select(
        F.col(f"`{host}`").alias("host"),
        F.explode(F.expr(f"array_distinct(transform({_LINES}, x -> {_key('x')}))")).alias("line"),
    )
    return lines.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)


def boilerplate(
    pages: DataFrame, host: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(host, line, pages, host_pages)`` of the lines to drop."""
    totals = pages.groupBy(F.col(f"`{host}`").alias("total_host")).agg(F.count("*").alias("host_pages"))
    counts = line_counts(pages, host, min_pages)
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("pages") > F.col("host_pages") * F.lit(float(max_ratio)))
        .select("host", "line", "pages", "host_pages")
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    ship_rows: int = SHIP_ROWS,
) -> DataFrame:
    """``pages`` with ``text`` without boilerplate lines, ``n_lines`` and ``n_dropped``."""
    drop = cut(boilerplate(pages, host, max_ratio, min_pages).select("host", "line"))
    split = F.expr("split(text, '\\n', -1)")
    kept = pages.drop("n_lines", "n_dropped", "__host", "__bad")
    if drop.count() <= ship_rows:
        per_host = drop.groupBy("host").agg(F.collect_list("line").alias("__bad")).withColumnRenamed("host", "__host")
        found = kept.join(
            F.broadcast(per_host), F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left"
        ).withColumn("__keep", F.expr(
            f"if(__bad is null, null, transform(split(text, '\\n', -1), x -> not array_contains(__bad, {_key('x')})))"
        ))
        left = F.expr("filter(split(text, '\\n', -1), (x, k) -> __keep[k])")
        dropped = F.expr("size(filter(__keep, x -> not x))")
        return _finish(found.drop("__bad", "__host"), split, left, dropped, F.col("__keep").isNotNull(), kept.columns)
    keyed = cut(kept.withColumn("__row", F.monotonically_increasing_id()))
    places = keyed.select(
        "__row", F.col(f"`{host}`").alias("host"), F.posexplode(split).alias("at", "value")
    ).select("__row", "host", "at", F.expr(_key("value")).alias("line"))
    gone = (
        places.join(drop, (places["line"] == drop["line"]) & places["host"].eqNullSafe(drop["host"]), "left_semi")
        .groupBy("__row")
        .agg(F.collect_set("at").alias("__gone"))
    )
    found = keyed.join(gone, "__row", "left").drop("__row")
    left = F.expr("filter(split(text, '\\n', -1), (x, k) -> not array_contains(__gone, k))")
    return _finish(found, split, left, F.size("__gone"), F.col("__gone").isNotNull(), kept.columns)


def _finish(found, split, left, dropped, hit, columns) -> DataFrame:
    n_dropped = F.when(hit, dropped).otherwise(0).cast("long")
    text = F.when(hit & (n_dropped > 0), F.array_join(left, "\n")).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns]
    return found.select(*out, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "source", "n_lines", "n_dropped",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``docs`` with their columns as they were, ``text`` cleaned and ``n_chars`` counted anew
    where a line went."""
    packed = docs.select(
        F.col(f"`{host}`").alias("host"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest")
    )
    found = drop_boilerplate(packed, "host", **limits)
    replaced = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        replaced["n_chars"] = F.when(F.col("n_dropped") > 0, counted).otherwise(F.col("__rest.n_chars"))
    return found.select(*[replaced.get(c, F.col("__rest").getField(c)).alias(c) for c in docs.columns])
