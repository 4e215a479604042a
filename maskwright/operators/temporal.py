"""Event-time rules around the tracker: generations, latches, streaks, lateness, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.operators import scan
from maskwright.operators.tracking import run_in_order, with_segments


def generations(events: DataFrame, keys: list[str], order: list[str], boundary: Column) -> DataFrame:
    """Add ``generation``: how many boundaries (seek, source change) a row has behind it,
    its own included."""
    return scan.running(
        events.withColumn("__boundary", boundary.cast("bigint")),
        keys,
        order,
        sums={"generation": F.col("__boundary")},
    ).drop("__boundary")


def current_generation(replies: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Replies captured in the generation that is current for their video."""
    return replies.join(current.select(*keys, "generation"), [*keys, "generation"])


def mark_late(results: DataFrame, bound_ms: int = settings.TRACK_MAX_AGE_MS) -> DataFrame:
    """Add ``late``: arrived more than the bound after capture. Marked, so it can be counted."""
    return results.withColumn("late", F.col("arrived_ms") - F.col("captured_ms") > bound_ms)


def drop_late(results: DataFrame, bound_ms: int = settings.TRACK_MAX_AGE_MS) -> DataFrame:
    return mark_late(results, bound_ms).where("not late").drop("late")


def degraded(
    rounds: DataFrame,
    keys: list[str],
    order: list[str],
    failed: Column,
    lost: Column | None = None,
    streak: int = settings.FAIL_STREAK,
    range_rows: int | None = None,
) -> DataFrame:
    """Add ``fail_streak`` and ``degraded`` after each round.

    Degraded after ``streak`` failures in a row or once tracks were lost to age (``lost``);
    a valid round clears both.
    """
    marked = rounds.withColumn("__fail", failed.cast("bigint")).withColumn(
        "__lost", (F.lit(False) if lost is None else lost).cast("bigint")
    )
    ranges = scan.plan_ranges(rounds, order[0], range_rows, keys)
    counted = scan.running(
        marked,
        keys,
        order,
        sums={"__fails": F.col("__fail"), "__losses": F.col("__lost")},
        ranges=ranges,
    )
    valid = (F.col("__fail") == 0) & (F.col("__lost") == 0)
    based = scan.running(
        counted.withColumn("__valid", valid),
        keys,
        order,
        lasts={
            "__fails_then": F.when(F.col("__valid"), F.col("__fails")),
            "__losses_then": F.when(F.col("__valid"), F.col("__losses")),
        },
        ranges=ranges,
    )
    zero = F.lit(0).cast("bigint")
    return (
        based.withColumn("fail_streak", F.col("__fails") - F.coalesce("__fails_then", zero))
        .withColumn(
            "degraded",
            (F.col("fail_streak") >= streak)
            | (F.col("__losses") - F.coalesce("__losses_then", zero) > 0),
        )
        .drop("__fail", "__lost", "__fails", "__losses", "__valid", "__fails_then", "__losses_then")
    )


def lost_coverage(
    rounds: DataFrame,
    max_age_ms: int = settings.TRACK_MAX_AGE_MS,
    forget_ms: int = 3_600_000,
    streak: int = settings.FAIL_STREAK,
    range_rows: int | None = None,
) -> DataFrame:
    """Rounds and the moments between them at which tracks grew too old, in one history.

    ``rounds(video_id, captured_ms, seq, failed, live)``, ``live`` being the times at which
    the tracks that live after the round were last seen. A track not seen again within
    ``max_age_ms`` is lost one millisecond later (before a round of that time), unless a
    round comes first: that row has ``lost``, and the round's ``seq``. Adds ``fail_streak``
    and ``degraded``; a round after a pause of more than ``forget_ms`` starts afresh.
    """
    keys = ["video_id", "segment"]
    cut_up = with_segments(
        rounds.select("video_id", "captured_ms", "seq", "failed", "live"), ["video_id"], "captured_ms", "seq", forget_ms
    )
    backwards = cut_up.withColumn("__neg", -F.col("captured_ms")).withColumn("__tie", -F.col("seq"))
    followed = scan.running(
        backwards, ["video_id"], ["__neg", "__tie"], lasts={"__next": F.col("captured_ms")}, inclusive=False,
        ranges=scan.plan_ranges(backwards, "__neg", range_rows, ["video_id"]),
    )
    gone = F.filter(F.array_distinct("live"), lambda t: F.col("__next").isNull() | (t + max_age_ms < F.col("__next")))
    losses = followed.select(*keys, F.explode(gone).alias("__seen"), "seq").select(
        *keys, (F.col("__seen") + max_age_ms + 1).alias("captured_ms"), F.lit(0).alias("__turn"), "seq",
        F.lit(False).alias("failed"), F.lit(True).alias("lost"),
    )
    history = losses.unionByName(
        cut_up.select(*keys, "captured_ms", F.lit(1).alias("__turn"), "seq", "failed", F.lit(False).alias("lost"))
    )
    marked = degraded(history, keys, ["captured_ms", "__turn", "seq"], F.col("failed"), F.col("lost"), streak, range_rows)
    return marked.select("video_id", "captured_ms", "seq", "lost", "fail_streak", "degraded")


def resource_latch(
    samples: DataFrame,
    keys: list[str],
    order: list[str],
    resource: str,
    outcome: str,
    range_rows: int | None = None,
) -> DataFrame:
    """Add ``resource_epoch`` and ``unreadable``.

    A new non-empty resource key starts an epoch. A "tainted" sample makes the rest of
    its epoch unreadable; other failures are recoverable.
    """
    known = F.when(F.col(resource) != "", F.col(resource))
    ranges = scan.plan_ranges(samples, order[0], range_rows, keys)
    prior = scan.running(
        samples, keys, order, lasts={"__before": known}, inclusive=False, ranges=ranges
    )
    fresh = known.isNotNull() & (F.col("__before").isNull() | (known != F.col("__before")))
    epochs = scan.running(
        prior.withColumn("__fresh", fresh.cast("bigint")),
        keys,
        order,
        sums={"resource_epoch": F.col("__fresh")},
        ranges=ranges,
    )
    tainted = F.when(F.col(outcome) == "tainted", F.col("resource_epoch"))
    latched = scan.running(
        epochs.withColumn("__tainted", tainted),
        keys,
        order,
        maxes={"__last": F.col("__tainted")},
        ranges=ranges,
    )
    return latched.withColumn(
        "unreadable", F.coalesce(F.col("__last") == F.col("resource_epoch"), F.lit(False))
    ).drop("__before", "__fresh", "__tainted", "__last")


def freshest(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest pending frame of each key; older ones are superseded."""
    data = [c for c in frames.columns if c not in keys]
    newest = F.max_by(F.struct(*data), F.struct(*order))
    return frames.groupBy(*keys).agg(newest.alias("__f")).select(*keys, "__f.*")


def admit_one_at_a_time(
    frames: DataFrame, keys: list[str], arrived: str, done: str, tie: str
) -> DataFrame:
    """Add ``busy``: a frame arriving while an admitted one is in flight is refused, not queued.

    A frame arriving after everything before it is done is always admitted, so the
    history is cut there and the stretches run independently.
    """
    order = [arrived, tie]
    ranges = scan.plan_ranges(frames, arrived, keys=keys)
    earlier = scan.running(
        frames, keys, order, maxes={"__until": F.col(done)}, inclusive=False, ranges=ranges
    )
    free = F.coalesce(F.col("__until") <= F.col(arrived), F.lit(True))
    parts = scan.running(
        earlier.withColumn("__free", free.cast("bigint")),
        keys,
        order,
        sums={"__part": F.col("__free")},
        ranges=ranges,
    ).select(*keys, arrived, done, tie, F.col("__part").alias("part"))
    schema = T.StructType(
        [*[parts.schema[c] for c in (*keys, arrived, tie)], T.StructField("busy", T.BooleanType())]
    )

    def fold(until, row):
        start = getattr(row, arrived)
        busy = until is not None and start < until
        label = [getattr(row, c) for c in (*keys, arrived, tie)]
        return (until if busy else getattr(row, done)), [(*label, busy)]

    judged = run_in_order(parts, [*keys, "part"], order, fold, schema.fieldNames(), schema)
    return frames.join(judged, [*keys, arrived, tie])


def expire(work: DataFrame, enqueued: str, started: str, wait_ms: int = settings.QUEUE_WAIT_MS):
    """Work that did not wait longer than the bound."""
    return work.where(F.col(started) - F.col(enqueued) <= wait_ms)


def largest_videos(
    videos: DataFrame, keys: list[str], arrival: str, limit: int = settings.MAX_TRACKED_VIDEOS
) -> DataFrame:
    """The largest videos of each page, earlier arrivals first among equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("area"), arrival)
    return videos.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


ARRIVE, RESIZE, LEAVE = "arrive", "resize", "leave"


def watch(watched: dict, kind: str, video, area, limit: int) -> list[tuple]:
    """Apply one event to the videos a page watches, kept in the order they came to be so;
    returns ``(is watched, evicted)`` for an arrival."""
    if kind == LEAVE:
        watched.pop(video, None)
        return []
    if video in watched:
        watched[video] = area
        return [(True, None)] if kind == ARRIVE else []
    if kind != ARRIVE:
        return []
    evicted = None
    if len(watched) >= limit:
        smallest = min(watched, key=watched.get)  # the earliest among equals
        if watched[smallest] >= area:
            return [(False, None)]
        evicted = smallest
        del watched[smallest]
    watched[video] = area
    return [(True, evicted)]


def watched_videos(events: DataFrame, limit: int = settings.MAX_TRACKED_VIDEOS) -> DataFrame:
    """Which arriving videos a page watches, and which one each of them displaces.

    ``events(page, at_ms, seq, kind, video, area)`` in order of (at_ms, seq): an ``arrive`` takes a
    free place or that of the smallest watched video, by areas as they are then, if it is
    larger; ``resize`` changes the area of a watched video and ``leave`` frees its place.
    Returns ``(page, at_ms, seq, video, watched, evicted)`` of every arrival. A task streams
    its pages in order with ``limit`` videos in memory.
    """
    kinds = {f.name: f.dataType for f in events.schema}
    schema = T.StructType([
        *(T.StructField(c, kinds[c]) for c in ("page", "at_ms", "seq", "video")),
        T.StructField("watched", T.BooleanType()), T.StructField("evicted", kinds["video"]),
    ])

    def fold(state, row):
        watched = {} if state is None else state
        found = watch(watched, row.kind, row.video, row.area, limit)
        return watched, [(row.page, row.at_ms, row.seq, row.video, *x) for x in found]

    rows = events.select("page", "at_ms", "seq", "kind", "video", "area")
    return run_in_order(rows, ["page"], ["at_ms", "seq"], fold, schema.fieldNames(), schema)
