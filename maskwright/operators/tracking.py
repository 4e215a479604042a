"""Following regions through video: detection rounds to tracks, tracks to positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.operators import scan


@dataclass(frozen=True)
class TrackOptions:
    iou: float = settings.TRACK_IOU
    max_misses: int = settings.TRACK_MISSES_APP
    max_age_ms: float | None = settings.TRACK_MAX_AGE_MS
    center_fallback: bool = True
    radius_factor: float = settings.ASSOCIATION_RADIUS_FACTOR
    min_radius: float = settings.MIN_ASSOCIATION_RADIUS_PX


# A track in a task: [id, x, y, width, height, vx, vy, last_seen_ms, misses, identity].
_ID, _X, _Y, _W, _H, _VX, _VY, _SEEN, _MISSES, _WHO = range(10)


def _iou(t, d) -> float:
    if t[_W] <= 0 or t[_H] <= 0 or d[2] <= 0 or d[3] <= 0:
        return 0.0
    wide = min(t[_X] + t[_W], d[0] + d[2]) - max(t[_X], d[0])
    high = min(t[_Y] + t[_H], d[1] + d[3]) - max(t[_Y], d[1])
    if wide <= 0 or high <= 0:
        return 0.0
    shared = wide * high
    return min(1.0, shared / (t[_W] * t[_H] + d[2] * d[3] - shared))


def _pair_up(scored: list[tuple[float, int, int]], owner: dict[int, int]) -> None:
    """Take pairs best first; the sort breaks ties by track, then by detection."""
    used = set(owner.values())
    for _, t, d in sorted(scored):
        if t not in owner and d not in used:
            owner[t] = d
            used.add(d)


def fold_round(tracks: list[list], boxes: list[tuple], now: float, next_id: int, o: TrackOptions):
    """Tracks after one detection round, and the next free track id."""
    if o.max_age_ms is not None:
        tracks = [t for t in tracks if now - t[_SEEN] <= o.max_age_ms]
    owner: dict[int, int] = {}
    overlaps = [(-_iou(t, d), i, j) for i, t in enumerate(tracks) for j, d in enumerate(boxes)]
    _pair_up([s for s in overlaps if -s[0] > o.iou], owner)
    if o.center_fallback:
        taken = set(owner.values())
        near = []
        for i, t in enumerate(tracks):
            if i in owner:
                continue
            radius = max(o.radius_factor * max(t[_W], t[_H]), o.min_radius)
            for j, d in enumerate(boxes):
                if j in taken:
                    continue
                gap = math.hypot(
                    d[0] + d[2] / 2 - (t[_X] + t[_W] / 2), d[1] + d[3] / 2 - (t[_Y] + t[_H] / 2)
                )
                if gap <= radius:
                    near.append((gap, i, j))
        _pair_up(near, owner)
    after = []
    for i, t in enumerate(tracks):
        if i in owner:
            d = boxes[owner[i]]
            dt = now - t[_SEEN]
            vx, vy = ((d[0] - t[_X]) / dt, (d[1] - t[_Y]) / dt) if dt > 0 else (t[_VX], t[_VY])
            after.append([t[_ID], *d[:4], vx, vy, now, 0, d[4]])
        elif t[_MISSES] < o.max_misses:
            after.append([*t[:_MISSES], t[_MISSES] + 1, t[_WHO]])
    born = set(range(len(boxes))) - set(owner.values())
    for j in sorted(born):
        d = boxes[j]
        after.append([next_id, *d[:4], 0.0, 0.0, now, 0, d[4]])
        next_id += 1
    return after, next_id


def fold_signal(tracks: list[list], signal: str | None, now: float) -> list[list]:
    """A page becoming visible: a playing video loses its tracks, a paused one keeps them fresh."""
    if signal == "visible-playing":
        return []
    if signal == "visible-paused":
        return [[*t[:_SEEN], now, *t[_MISSES:]] for t in tracks]
    return tracks


def fold_row(state, r, o: TrackOptions):
    """Apply one round or signal; returns the new state and a row per live track."""
    tracks, next_id = state or ([], 0)
    signal = getattr(r, "signal", None)
    if isinstance(signal, str):
        return (fold_signal(tracks, signal, r.captured_ms), next_id), []
    boxes = [
        (b["x"], b["y"], b["width"], b["height"], b.get("identity_id"))
        for b in (r.boxes if r.boxes is not None else [])
    ]
    tracks, next_id = fold_round(tracks, boxes, r.captured_ms, next_id, o)
    label = (r.video_id, r.generation, r.segment, r.captured_ms, r.seq)
    return (tracks, next_id), [(*label, i, *t) for i, t in enumerate(tracks)]


TRACK_COLUMNS = (
    "video_id", "generation", "segment", "captured_ms", "seq", "position", "track_id",
    "x", "y", "width", "height", "vx", "vy", "last_seen_ms", "misses", "identity_id",
)


def track_schema(rounds: DataFrame) -> T.StructType:
    kind = {
        "video_id": rounds.schema["video_id"].dataType,
        "generation": T.LongType(), "segment": T.LongType(), "captured_ms": T.LongType(),
        "seq": T.LongType(),
        "position": T.LongType(), "track_id": T.LongType(), "last_seen_ms": T.LongType(),
        "misses": T.LongType(), "identity_id": T.StringType(),
    }
    return T.StructType([T.StructField(c, kind.get(c, T.DoubleType())) for c in TRACK_COLUMNS])


def run_in_order(
    df: DataFrame, keys: list[str], order: list[str], fold: Callable, columns, schema: T.StructType
) -> DataFrame:
    """Feed each key's rows to ``fold(state, row) -> (state, output rows)`` in order.

    Partitions are sorted by Spark and streamed batch by batch, so a task holds one batch
    and one state, never a whole key.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for rows in batches:
            out = []
            labels = zip(*[rows[k].tolist() for k in keys])
            for key, row in zip(labels, rows.itertuples(index=False)):
                if key != last:
                    last, state = key, None
                state, produced = fold(state, row)
                out.extend(produced)
            yield pd.DataFrame(out, columns=list(columns), dtype=object)

    return (
        df.repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(stream, schema)
    )


def with_segments(
    rows: DataFrame, keys: list[str], time: str, tie: str, gap: float, keep: Column | None = None
) -> DataFrame:
    """Number stretches of a key without a pause longer than ``gap``, as ``segment``.

    A pause that ends every track cuts the history exactly there, so the stretches are
    independent and one long video spreads over many tasks. Rows where ``keep`` holds
    never start a stretch.
    """
    ranges = scan.plan_ranges(rows, time, keys=keys)
    timed = scan.running(
        rows, keys, [time, tie], lasts={"__previous": F.col(time)}, inclusive=False, ranges=ranges
    )
    pause = F.col("__previous").isNull() | (F.col(time) - F.col("__previous") > gap)
    if keep is not None:
        pause = pause & (~keep | F.col("__previous").isNull())
    cutting = timed.withColumn("__cut", pause.cast("bigint"))
    return scan.running(
        cutting, keys, [time, tie], sums={"segment": F.col("__cut")}, ranges=ranges
    ).drop("__previous", "__cut")


def track_rounds(rounds: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """Live tracks after every detection round.

    ``rounds(video_id, generation, captured_ms, seq, boxes[, signal])``: one row per
    round, empty ones included, since they add misses. Track ids count within
    ``(video_id, generation, segment)``.
    """
    columns = ["video_id", "generation", "captured_ms", "seq", "boxes"]
    keep = None
    if "signal" in rounds.columns:
        columns.append("signal")
        keep = F.coalesce(F.col("signal") == "visible-paused", F.lit(False))
    keys = ["video_id", "generation"]
    rows = rounds.select(*columns)
    if options.max_age_ms is None:
        rows = rows.withColumn("segment", F.lit(1).cast("bigint"))
    else:
        rows = with_segments(rows, keys, "captured_ms", "seq", options.max_age_ms, keep)
    return run_in_order(
        rows,
        [*keys, "segment"],
        ["captured_ms", "seq"],
        lambda state, row: fold_row(state, row, options),
        TRACK_COLUMNS,
        track_schema(rounds),
    )


def velocities(observations: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Velocity of single-face videos from the last two observations ``(seen_ms, x, y)``.

    A non-positive time step keeps the previous velocity; the first has none.
    """
    order = ["seen_ms", tie]
    ranges = scan.plan_ranges(observations, "seen_ms", keys=keys)
    prior = scan.running(
        observations,
        keys,
        order,
        lasts={"__t": F.col("seen_ms"), "__x": F.col("x"), "__y": F.col("y")},
        inclusive=False,
        ranges=ranges,
    )
    dt = F.col("seen_ms") - F.col("__t")
    speed = lambda now, before: F.when(dt > 0, (F.col(now) - F.col(before)) / F.when(dt > 0, dt))
    moved = prior.withColumn("__vx", speed("x", "__x")).withColumn("__vy", speed("y", "__y"))
    known = scan.running(
        moved, keys, order, lasts={"vx": F.col("__vx"), "vy": F.col("__vy")}, ranges=ranges
    )
    return (
        known.withColumn("vx", F.coalesce("vx", F.lit(0.0)))
        .withColumn("vy", F.coalesce("vy", F.lit(0.0)))
        .drop("__t", "__x", "__y", "__vx", "__vy")
    )


def coasted(position: Column, velocity: Column, seen: Column, now: Column) -> Column:
    """Observed position plus velocity over the elapsed time, which is never negative."""
    return position + velocity * F.greatest(F.lit(0).cast("bigint"), now - seen)


def coast_positions(
    frames: DataFrame,
    versions: DataFrame,
    keys: list[str],
    max_age_ms: int = settings.TRACK_MAX_AGE_MS,
) -> DataFrame:
    """Every live track's predicted box at every presented frame.

    ``frames(keys, frame_ms, ..)``, whose columns all come along, so frames of one time
    stay apart; ``versions(keys, track_id, from_ms, until_ms, last_seen_ms,
    x, y, width, height, vx, vy)`` valid over ``[from_ms, until_ms)`` (null = open). A
    version lives at most ``max_age_ms`` after its last observation, so it falls into a
    bounded number of time slots and the interval join becomes an equi-join on the slot.
    """
    slot = max(1, int(max_age_ms))
    ends = F.least(
        F.coalesce("until_ms", F.lit(2**62)), F.col("last_seen_ms") + F.lit(int(max_age_ms) + 1)
    )
    spread = (
        versions.withColumn("__end", ends)
        .where(F.col("__end") > F.col("from_ms"))
        .withColumn(
            "__slot",
            F.explode(
                F.sequence(
                    F.floor(F.col("from_ms") / slot), F.floor((F.col("__end") - 1) / slot)
                )
            ),
        )
    )
    slotted = frames.select(
        *keys, "frame_ms", F.struct(*frames.columns).alias("__frame"), F.floor(F.col("frame_ms") / slot).alias("__slot")
    )
    live = slotted.join(spread, [*keys, "__slot"]).where(
        (F.col("frame_ms") >= F.col("from_ms")) & (F.col("frame_ms") < F.col("__end"))
    )
    at = lambda p, v: coasted(F.col(p), F.col(v), F.col("last_seen_ms"), F.col("frame_ms"))
    return live.select(
        *[F.col(f"__frame.{c}").alias(c) for c in frames.columns],
        "track_id",
        at("x", "vx").alias("x"),
        at("y", "vy").alias("y"),
        "width",
        "height",
    )


def track_versions(tracks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Tracks as versions valid until the video's next detection round; of rounds captured
    at one time, the last by ``seq`` is the one shown."""
    keys = ["video_id", "generation"]
    times = rounds.select(*keys, "captured_ms", "seq")
    backwards = times.select(
        *keys, (-F.col("captured_ms")).alias("__neg"), (-F.col("seq")).alias("__tie"), "captured_ms"
    )
    following = scan.running(
        backwards.withColumn("seq", -F.col("__tie")), keys, ["__neg", "__tie"],
        lasts={"until_ms": F.col("captured_ms")}, inclusive=False,
    ).select(*keys, "captured_ms", "seq", "until_ms")
    return (
        tracks.join(following, [*keys, "captured_ms", "seq"], "left")
        .withColumnRenamed("captured_ms", "from_ms")
        .drop("segment", "seq", "position", "misses")
    )


def sample_frames(
    frames: DataFrame,
    idle_ms: int = settings.SAMPLE_IDLE_MS,
    active_ms: int = settings.SAMPLE_ACTIVE_MS,
    min_px: int = settings.MIN_MEDIA_PX,
) -> DataFrame:
    """Frames a greedy sampler takes: the next one at least an interval after the last.

    ``frames(video_id, frame_ms, seq, live, visible, ready, inflight, width, height)``;
    the interval is the short one while tracks are live. A pause of the long interval
    always ends in a sample, so the history is cut there.
    """
    open_frames = frames.where(
        F.col("visible") & F.col("ready") & ~F.col("inflight")
        & (F.col("width") >= min_px) & (F.col("height") >= min_px)
    )
    rows = with_segments(
        open_frames.select("video_id", "frame_ms", "seq", "live"),
        ["video_id"], "frame_ms", "seq", max(idle_ms, active_ms) - 1,
    )
    schema = T.StructType(
        [
            rows.schema["video_id"],
            T.StructField("frame_ms", T.LongType()),
            T.StructField("seq", rows.schema["seq"].dataType),
        ]
    )

    def fold(last, r):
        if last is not None and r.frame_ms - last < (active_ms if r.live else idle_ms):
            return last, []
        return r.frame_ms, [(r.video_id, r.frame_ms, r.seq)]

    return run_in_order(
        rows, ["video_id", "segment"], ["frame_ms", "seq"], fold, schema.fieldNames(), schema
    )
