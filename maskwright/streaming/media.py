"""Videos and media over streams: sampling, coasting, lost coverage, scoring once.

Each stream returns the rows of its batch twin. Two streams that meet (frames and tracks)
are put together as one stream of marked rows, since each has to wait for the other's
watermark anyway.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright import settings
from maskwright.operators import temporal
from maskwright.streaming.ordered import in_order, struct

_HOUR = 3_600_000
# Of rows of one time, those that change what is known come before those that ask.
_KNOWN, _ASKED = 0, 1


def _together(keys: list[str], known: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of both streams as ``(keys, at_ms, part, seq, payload)``: what only one of them
    has is packed as text, so that no number turns into a null or a float on its way."""

    def packed(df: DataFrame, part: int) -> DataFrame:
        common = [*keys, "at_ms", "seq"]
        rest = [c for c in df.columns if c not in common]
        payload = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
        return df.select(*common, F.lit(part).alias("part"), payload.alias("payload"))

    return packed(known, _KNOWN).unionByName(packed(asked, _ASKED))


def sample_stream(
    frames: DataFrame, live: DataFrame, idle_ms: int = settings.SAMPLE_IDLE_MS, active_ms: int = settings.SAMPLE_ACTIVE_MS,
    min_px: int = settings.MIN_MEDIA_PX, delay_ms: int = 10_000, forget_ms: int = 24 * _HOUR,
) -> DataFrame:
    """``(video_id, frame_ms, seq)`` of the frames a greedy sampler takes.

    ``frames(video_id, frame_ms, seq, visible, ready, inflight, width, height)`` and
    ``live(video_id, at_ms, live_tracks)``, the number of live tracks from then on: the
    interval is the short one while there are some. Streaming twin of
    ``tracking.sample_frames``.
    """
    asked = frames.where(
        F.col("visible") & F.col("ready") & ~F.col("inflight") & (F.col("width") >= min_px) & (F.col("height") >= min_px)
    ).select("video_id", F.col("frame_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"))
    known = live.select("video_id", F.col("at_ms").cast("long").alias("at_ms"), F.col("live_tracks").cast("long").alias("live_tracks"))

    def fold(key, state, row):
        last, tracks = state or (None, 0)
        if row["part"] == _KNOWN:
            return (last, json.loads(row["payload"])["live_tracks"] or 0), []
        interval = active_ms if tracks > 0 else idle_ms
        if last is not None and row["at_ms"] - last < interval:
            return (last, tracks), []
        return (row["at_ms"], tracks), [(key[0], row["at_ms"], row["seq"])]

    output = T.StructType([frames.schema["video_id"], T.StructField("frame_ms", T.LongType()), T.StructField("seq", T.LongType())])
    together = _together(["video_id"], known.withColumn("seq", F.lit(0).cast("long")), asked)
    return in_order(together, ["video_id"], ["at_ms", "part", "seq"], fold, output, delay_ms, forget_ms)


def coast_stream(
    frames: DataFrame, rounds: DataFrame, max_age_ms: int = settings.TRACK_MAX_AGE_MS, delay_ms: int = 10_000, forget_ms: int | None = None
) -> DataFrame:
    """Every live track's predicted box at every presented frame: an as-of join of streams.

    ``frames(video_id, frame_seq, frame_ms)``; ``rounds(video_id, seen_ms, seq, track_id, x,
    y, width, height, vx, vy)``, one row per track of a detection round, or one row without
    a track. A round replaces the video's tracks; of rounds of one time the last by ``seq``
    stands. A track is shown ``max_age_ms`` after it was seen, at most. Streaming twin of
    ``tracking.coast_positions``.
    """
    shape = ["x", "y", "width", "height", "vx", "vy"]
    known = rounds.select(
        "video_id", F.col("seen_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"),
        F.col("track_id").cast("long").alias("track_id"), *(F.col(c).cast("double").alias(c) for c in shape),
    )
    asked = frames.select("video_id", F.col("frame_ms").cast("long").alias("at_ms"), F.col("frame_seq").cast("long").alias("seq"))

    def fold(key, state, row):
        seen, tracks = state or (None, {})
        if row["part"] == _KNOWN:
            if seen != [row["at_ms"], row["seq"]]:
                tracks = {}
            track = json.loads(row["payload"])
            if track["track_id"] is not None:
                tracks = tracks | {str(track["track_id"]): [track[c] for c in shape]}
            return ([row["at_ms"], row["seq"]], tracks), []
        age = row["at_ms"] - seen[0] if seen else 0
        if age > max_age_ms:
            return (seen, {}), []
        return (seen, tracks), [
            (key[0], row["seq"], row["at_ms"], int(track), x + vx * age, y + vy * age, width, height)
            for track, (x, y, width, height, vx, vy) in tracks.items()
        ]

    output = T.StructType([frames.schema["video_id"], *struct(
        "frame_seq long, frame_ms long, track_id long, x double, y double, width double, height double"
    ).fields])
    together = _together(["video_id"], known, asked)
    return in_order(together, ["video_id"], ["at_ms", "part", "seq"], fold, output, delay_ms, max_age_ms + 1 if forget_ms is None else forget_ms)


class CoverageProcessor(StatefulProcessor):
    """One video's failures, and the times its live tracks were last seen. An event-time
    timer fires when the first of them grows too old, so coverage is lost on time even if
    the video falls silent; another ends the video's state."""

    COLUMNS = ["video_id", "captured_ms", "seq", "lost", "fail_streak", "degraded"]

    def __init__(self, max_age_ms: int, forget_ms: int, streak: int):
        self.max_age_ms, self.forget_ms, self.streak = max_age_ms, forget_ms, streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", struct("fails long, lost boolean, last_ms long, seq long"))
        self.live = handle.getListState("live", struct("seen_ms long"))

    def _losses(self, key, state, live: list[int], upto: int):
        """Rows for tracks too old before ``upto``, the state after and the tracks left."""
        fails, lost, last, seq = state
        out = []
        for seen in sorted(set(live)):
            if seen + self.max_age_ms < upto:
                lost = True
                out.append((key[0], seen + self.max_age_ms + 1, seq, True, fails, True))
        return out, (fails, lost, last, seq), [s for s in live if s + self.max_age_ms >= upto]

    def _keep(self, state, live: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(state)
        self.live.put([(s,) for s in live]) if live else self.live.clear()
        self.handle.registerTimer(min([state[2] + self.forget_ms, *(s + self.max_age_ms for s in live)]) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["captured_ms", "seq"])
        state = tuple(self.state.get()) if self.state.exists() else None
        live = [s for s, in self.live.get()] if self.live.exists() else []
        out = []
        for captured, seq, failed, seen in zip(*(batch[c].tolist() for c in ("captured_ms", "seq", "failed", "live"))):
            if state is not None:
                losses, state, live = self._losses(key, state, live, captured)
                out += losses
                if captured - state[2] > self.forget_ms:
                    state = None
            fails, lost = (state[0], state[1]) if state else (0, False)
            fails, lost = (fails + 1, lost) if failed else (0, False)
            state, live = (fails, lost, captured, seq), [int(s) for s in seen] if seen is not None else []
            out.append((key[0], captured, seq, False, fails, fails >= self.streak or lost))
        self._keep(state, live)
        yield pd.DataFrame(out, columns=self.COLUMNS, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.state.get())
        live = [s for s, in self.live.get()] if self.live.exists() else []
        out, state, live = self._losses(key, state, live, now)
        if now > state[2] + self.forget_ms:
            self.state.clear()
            self.live.clear()
        else:
            self._keep(state, live)
        yield pd.DataFrame(out, columns=self.COLUMNS, dtype=object)

    def close(self) -> None:
        pass


def coverage_stream(
    rounds: DataFrame, max_age_ms: int = settings.TRACK_MAX_AGE_MS, forget_ms: int = _HOUR,
    streak: int = settings.FAIL_STREAK, delay_ms: int = 10_000,
) -> DataFrame:
    """Streaming twin of ``temporal.lost_coverage``; rounds of a video must arrive in order
    of micro-batches. Needs the RocksDB state store."""
    if forget_ms <= max_age_ms:
        raise ValueError("a video must not be forgotten before its tracks are too old")
    timed = rounds.select("video_id", "captured_ms", "seq", "failed", "live").withColumn(
        "__at", F.timestamp_millis(F.col("captured_ms"))
    ).withWatermark("__at", f"{delay_ms} milliseconds")
    output = T.StructType([rounds.schema["video_id"], *struct(
        "captured_ms long, seq long, lost boolean, fail_streak long, degraded boolean"
    ).fields])
    return timed.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=CoverageProcessor(max_age_ms, forget_ms, streak),
        outputStructType=output, outputMode="Append", timeMode="EventTime",
    )


class OnceProcessor(StatefulProcessor):
    """The newest revision that a medium was handed on for; kept for ``ttl_ms``."""

    def __init__(self, columns: list[str], ttl_ms: int):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", struct("revision long"), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        for part in rows:
            fresh = part if newest is None else part[part["revision"] > newest]
            if len(fresh):
                newest = int(fresh["revision"].max())
                self.newest.update((newest,))
                yield fresh[fresh["revision"] == newest].head(1)[self.columns]

    def close(self) -> None:
        pass


def score_once_stream(media: DataFrame, key: str = "media_url", ttl_ms: int = 24 * _HOUR) -> DataFrame:
    """Arriving media that have not been handed on at their ``revision`` of the gallery, or a
    newer one: a new revision lets every medium through again, a repeat is dropped. One row
    per key and micro-batch at most. Streaming twin of ``gallery.unprocessed``."""
    return media.groupBy(key).transformWithStateInPandas(
        statefulProcessor=OnceProcessor(media.columns, ttl_ms), outputStructType=media.schema,
        outputMode="Append", timeMode="ProcessingTime",
    )


class ReplyProcessor(StatefulProcessor):
    """The latest request of a medium; replies to another one are stale."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", struct("token long, revision long"), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "part"], kind="stable")
        current = tuple(self.current.get()) if self.current.exists() else None
        out = []
        for part, token, revision, reply in zip(*(batch[c].tolist() for c in ("part", "token", "revision", "reply_id"))):
            if part == _KNOWN:
                current = (int(token), int(revision))
            elif current == (token, revision):
                out.append((key[0], int(reply)))
        if current:
            self.current.update(current)
        yield pd.DataFrame(out, columns=["media_id", "reply_id"], dtype=object)

    def close(self) -> None:
        pass


def current_replies_stream(requests: DataFrame, replies: DataFrame, ttl_ms: int = _HOUR) -> DataFrame:
    """``(media_id, reply_id)`` of replies to the latest request of their medium as it was
    when they came: ``requests(media_id, at_ms, token, revision)``, ``replies(media_id,
    at_ms, token, revision, reply_id)``. A request and its replies must arrive in order of
    micro-batches. Streaming twin of ``gallery.current_only``."""
    columns = ["media_id", *(F.col(c).cast("long").alias(c) for c in ("at_ms", "token", "revision"))]
    known = requests.select(*columns, F.lit(_KNOWN).alias("part"), F.lit(0).cast("long").alias("reply_id"))
    asked = replies.select(*columns, F.lit(_ASKED).alias("part"), F.col("reply_id").cast("long").alias("reply_id"))
    output = T.StructType([requests.schema["media_id"], T.StructField("reply_id", T.LongType())])
    return known.unionByName(asked).groupBy("media_id").transformWithStateInPandas(
        statefulProcessor=ReplyProcessor(ttl_ms), outputStructType=output, outputMode="Append", timeMode="ProcessingTime",
    )


class LargestProcessor(StatefulProcessor):
    """The videos a page watches: at most ``limit`` (video, area) pairs by age."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watched = handle.getListState("watched", struct("video long, area double"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "seq"])
        watched = dict(self.watched.get()) if self.watched.exists() else {}
        out = []
        for at, seq, kind, video, area in zip(*(batch[c].tolist() for c in ("at_ms", "seq", "kind", "video", "area"))):
            out += [(key[0], at, seq, video, *found) for found in temporal.watch(watched, kind, video, area, self.limit)]
        self.watched.put(list(watched.items())) if watched else self.watched.clear()
        yield pd.DataFrame(out, columns=["page", "at_ms", "seq", "video", "watched", "evicted"], dtype=object)

    def close(self) -> None:
        pass


def watched_stream(events: DataFrame, limit: int = settings.MAX_TRACKED_VIDEOS) -> DataFrame:
    """Streaming twin of ``temporal.watched_videos`` for ``(page, at_ms, seq, kind, video,
    area)`` with long times and videos; rows of a page must arrive in order of
    micro-batches. Needs the RocksDB state store."""
    output = T.StructType([events.schema["page"], *struct("at_ms long, seq long, video long, watched boolean, evicted long").fields])
    return events.groupBy("page").transformWithStateInPandas(
        statefulProcessor=LargestProcessor(limit), outputStructType=output, outputMode="Append", timeMode="None",
    )
