"""Roll-ups over results: funnels, diagnostics, evaluation, coverage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import boxes
from maskwright.lineage import cut
from maskwright.operators.grid import grid_cells, grid_level


def count_reasons(rows: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def funnel(media: DataFrame, page: str = "page_id") -> DataFrame:
    """Counts per page and reason, per page, and overall (nulls mark the totals)."""
    return media.rollup(page, "reason").agg(F.count("*").alias("n"))


def face_diagnostics(detections: DataFrame, scored: DataFrame) -> DataFrame:
    """Per face: best cosine and its identity, and whether and whom it matched."""
    return detections.join(scored, "query_id", "left").select(
        "media_id",
        "det_ord",
        "best_identity_id",
        "best_cosine",
        F.col("identity_id").isNotNull().alias("matched"),
        F.col("identity_id").alias("matched_identity_id"),
    )


def media_diagnostics(
    diagnostics: DataFrame, gallery_status: DataFrame, threshold: float, min_agreements: int
) -> DataFrame:
    """Per medium: faces, matches, the operating point and the gallery's health."""
    health = gallery_status.agg(
        F.count_if(F.col("status") == "dropped").alias("dropped_identities"),
        F.count_if(F.col("status") == "degraded").alias("degraded_identities"),
    )
    # one aggregated row
    media = diagnostics.groupBy("media_id").agg(
        F.count("*").alias("face_count"),
        F.count_if("matched").alias("matched_count"),
        F.max("best_cosine").alias("best_cosine"),
    )
    one = F.lit(1)
    return (
        media.withColumn("__one", one)
        .join(F.broadcast(health.withColumn("__one", one)), "__one")
        .drop("__one")
        .withColumn("threshold", F.lit(threshold))
        .withColumn("min_agreements", F.lit(min_agreements).cast("bigint"))
    )


def evidence_class(evaluation: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``evidence``: "self-match" when the medium was an enrolment reference, by any
    of ``keys`` (hash, url), else "held-out"."""
    out = evaluation
    for key in keys:
        used = sources.select(F.col(key).alias(f"__{key}")).where(f"__{key} is not null").distinct()
        out = out.join(used, F.col(key) == F.col(f"__{key}"), "left")
    hit = F.lit(False)
    for key in keys:
        hit = hit | F.col(f"__{key}").isNotNull()
    return out.withColumn("evidence", F.when(hit, "self-match").otherwise("held-out")).drop(
        *[f"__{k}" for k in keys]
    )


def check_media(media: DataFrame) -> DataFrame:
    """Add ``verdict`` to ``(media_id, expected, face_count, matched_count)``.

    A positive needs a face and a match, a control a face and no match; without a face
    neither was tested.
    """
    matched = F.col("matched_count") > 0
    passed = F.when(F.col("expected") == "positive", matched).otherwise(~matched)
    return media.withColumn(
        "verdict",
        F.when(F.col("face_count") == 0, "untested").when(passed, "pass").otherwise("fail"),
    )


def exact_quantiles(rows: DataFrame, by: list[str], value: str, percents: dict[str, int], bins: int = 1024) -> DataFrame:
    """Per class: ``n``, ``low``, ``high`` and, by name, the least value that at least so many
    percent of the class's values do not exceed. Nulls are left out.

    A first pass counts values in equal bins between a class's least and greatest; those
    counts add up over tasks and tell which bin holds each rank. A second pass counts the
    different values of those bins alone, so no class is ever sorted whole.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    ranges = known.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    width = F.col("high") - F.col("low")
    usable = (width > 0) & (width < float("inf"))
    slot = F.when(usable, F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("low")) / width * bins))).otherwise(0).cast("int")
    binned = _meet(known, ranges, by).select(*by, "__v", "n", slot.alias("__slot"))
    order = Window.partitionBy(*by)
    counted = binned.groupBy(*by, "__slot").agg(F.count("*").alias("__k"), F.first("n").alias("n"))
    before = F.sum("__k").over(order.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.expr(f"({p} * n + 99) div 100")).alias("rank")) for name, p in percents.items()])
    held = cut(counted.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__ranks", F.filter(
        ranks, lambda r: (r["rank"] > F.col("__before")) & (r["rank"] <= F.col("__before") + F.col("__k"))
    )).where(F.size("__ranks") > 0).select(*by, "__slot", "__before", "__ranks"))
    values = _meet(binned, held, [*by, "__slot"]).groupBy(*by, "__slot", "__v").agg(
        F.count("*").alias("__k"), F.first("__before").alias("__before"), F.first("__ranks").alias("__ranks")
    )
    inside = Window.partitionBy(*by, "__slot").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = values.withColumn("__upto", F.col("__before") + F.sum("__k").over(inside))
    hit = upto.withColumn("__hit", F.explode(F.filter(
        "__ranks", lambda r: (r["rank"] <= F.col("__upto")) & (r["rank"] > F.col("__upto") - F.col("__k"))
    )))
    found = hit.groupBy(*by).agg(*[F.min(F.when(F.col("__hit.name") == name, F.col("__v"))).alias(name) for name in percents])
    return _meet(ranges, found, by).select(*by, "n", "low", *percents, "high")


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one class side by side, null being a class."""
    other = b.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    terms = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] or [F.lit(True)]
    return a.join(other, functools.reduce(lambda x, y: x & y, terms)).drop(*[f"__of_{k}" for k in keys])


def similarity_ranges(scores: DataFrame, by: list[str]) -> DataFrame:
    """Lowest, median and highest score of genuine and impostor comparisons, and the scores
    that bound the middle nine tenths."""
    return exact_quantiles(scores, by, "score", {"p05": 5, "median": 50, "p95": 95})


def threshold_sweep(
    scores: DataFrame, genuine: Column, low: float, high: float, step: float
) -> DataFrame:
    """Accepted genuine and impostor scores at each threshold.

    Scores are reduced to one count per threshold step first, then summed from the top:
    no score meets every threshold.
    """
    steps = int(round((high - low) / step))
    grid = [low + step * i for i in range(steps + 1)]
    limits = F.array(*[F.lit(round(g, 9)) for g in grid])
    slot = F.size(F.filter(limits, lambda t: t <= F.col("score")))
    counted = (
        scores.withColumn("__g", genuine)
        .groupBy(slot.alias("slot"))
        .agg(F.count_if("__g").alias("g"), F.count_if(~F.col("__g")).alias("i"))
    )
    spark = scores.sparkSession
    levels = spark.range(steps + 1).select(
        F.col("id").alias("level"), F.get(limits, F.col("id").cast("int")).alias("threshold")
    )
    # at most steps + 2 counted rows on one side
    joined = levels.join(F.broadcast(counted), F.col("slot") > F.col("level"), "left")
    return joined.groupBy("threshold").agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("genuine_accepted"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("impostor_accepted"),
    )


def mask_coverage(
    masks: DataFrame, targets: DataFrame, key: str, cell: float = 64.0
) -> DataFrame:
    """Add ``covered``: some mask of the same page meets the target rectangle.

    Both sides lie in a grid whose cells double from level to level; a rectangle is in the
    cells of the level that fits it, however large it is. Two rectangles meet at the level
    of the larger one, so each is also put into its few cells of the higher levels the other
    side uses: tens of rows at most for any rectangle. ``masks(key, box)``,
    ``targets(key, target_id, box)``; a box with a NaN or infinite number meets nothing.
    """
    finite = functools.reduce(lambda a, b: a & b, [F.abs(F.col(f"box.{c}")) < 1e300 for c in ("x", "y", "width", "height")])
    masks = masks.where("box.width > 0 and box.height > 0").where(finite).select(key, "box").distinct()
    held = targets.select(key, "target_id", "box").where(finite)
    masks = masks.join(held.select(key).distinct(), key, "left_semi")
    # one row each, of a number for every doubling there is at most
    levels = [df.agg(F.collect_set(grid_level("box", cell))).first()[0] for df in (masks, held)]
    on_grid = grid_cells(masks, levels[1], cell).select(key, "__level", "__cx", "__cy", F.col("box").alias("mask"), F.col("__own").alias("__mask"))
    met = (
        # Rows in cells are many times what Spark estimates, too many to ship to every executor.
        grid_cells(held, levels[0], cell).join(on_grid.hint("merge"), [key, "__level", "__cx", "__cy"])
        .where(F.col("__level") == F.greatest("__own", "__mask"))
        .where(boxes.intersects(F.col("mask"), F.col("box")))
        .select(key, "target_id")
        .distinct()
        .withColumn("__met", F.lit(True))
    )
    return (
        targets.join(met, [key, "target_id"], "left")
        .withColumn("covered", F.coalesce("__met", F.lit(False)))
        .drop("__met")
    )


def class_ranges(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Per class: count, least, greatest and lower median of ``value``, and whether some
    threshold separates two classes whole (``separable``, the same for all rows)."""
    ranges = rows.groupBy(label).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.percentile_approx(value, 0.5, 1_000_000).alias("lower_median"),
    )
    verdict = ranges.agg((F.min("high") < F.max("low")).alias("separable"))
    return ranges.crossJoin(F.broadcast(verdict))  # one row
