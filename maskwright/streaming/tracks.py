"""The tracker, the degraded monitor and the gallery match over streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright import settings
from maskwright.operators import matching, temporal
from maskwright.operators.tracking import TRACK_COLUMNS, TrackOptions, fold_row, track_schema


class TrackProcessor(StatefulProcessor):
    """One video generation: its live tracks are the state, one list per track."""

    def __init__(self, options: TrackOptions = TrackOptions(), idle_ms: int | None = None):
        self.options = options
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = T.StructType([T.StructField("tracks", T.StringType())])
        self.tracks = handle.getValueState("tracks", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["captured_ms", "seq"])
        batch["segment"] = 0
        state = json.loads(self.tracks.get()[0]) if self.tracks.exists() else None
        out = []
        for row in batch.itertuples(index=False):
            state, produced = fold_row(state, row, self.options)
            out.extend(produced)
        self.tracks.update((json.dumps(state),))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=list(TRACK_COLUMNS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tracks.clear()
        yield pd.DataFrame([], columns=list(TRACK_COLUMNS))

    def close(self) -> None:
        pass


def track_stream(
    rounds: DataFrame, options: TrackOptions = TrackOptions(), idle_ms: int | None = None
) -> DataFrame:
    """Streaming twin of ``tracking.track_rounds``; rounds of a video must arrive in order
    of micro-batches. Needs the RocksDB state store. ``idle_ms`` forgets silent videos."""
    return rounds.groupBy("video_id", "generation").transformWithStateInPandas(
        statefulProcessor=TrackProcessor(options, idle_ms),
        outputStructType=track_schema(rounds),
        outputMode="Append",
        timeMode="ProcessingTime" if idle_ms is not None else "None",
    )


class StreakProcessor(StatefulProcessor):
    """Consecutive failures and the degraded flag of one video."""

    def __init__(self, streak: int = settings.FAIL_STREAK):
        self.streak = streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("fails", T.LongType())])
        self.fails = handle.getValueState("fails", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["captured_ms", "seq"])
        fails = self.fails.get()[0] if self.fails.exists() else 0
        out = []
        for r in batch.itertuples(index=False):
            fails = fails + 1 if r.failed else 0
            out.append((key[0], r.captured_ms, r.seq, fails, fails >= self.streak))
        if fails:
            self.fails.update((fails,))
        else:  # no state for a video whose last round was valid
            self.fails.clear()
        yield pd.DataFrame(out, columns=["video_id", "captured_ms", "seq", "fail_streak", "degraded"])

    def close(self) -> None:
        pass


def degraded_stream(rounds: DataFrame, streak: int = settings.FAIL_STREAK) -> DataFrame:
    """Streaming twin of ``temporal.degraded`` for ``(video_id, captured_ms, seq, failed)``."""
    schema = T.StructType(
        [
            rounds.schema["video_id"],
            T.StructField("captured_ms", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("fail_streak", T.LongType()),
            T.StructField("degraded", T.BooleanType()),
        ]
    )
    return rounds.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=StreakProcessor(streak),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )


def fresh_media(media: DataFrame, key: list[str], time: str, horizon: str) -> DataFrame:
    """Arriving media not seen within the horizon: the streaming form of skipping known ones."""
    return media.withWatermark(time, horizon).dropDuplicatesWithinWatermark(key)


def on_time(results: DataFrame, captured: str, arrived: str, bound_ms: int) -> DataFrame:
    """Results within the age bound. The watermark lets Spark drop state, the filter is exact."""
    age = F.unix_millis(arrived) - F.unix_millis(captured)
    return results.withWatermark(captured, f"{bound_ms} milliseconds").where(age <= bound_ms)


def match_stream(
    queries: DataFrame,
    load_gallery: Callable[[], tuple[DataFrame, DataFrame]],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    **options,
):
    """Match arriving vectors against the gallery as it stands at each micro-batch.

    ``load_gallery()`` returns ``(gallery, identities)``, so a new revision takes effect
    with the next batch; ``sink(matches, batch_id)`` must be idempotent per batch id.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        gallery, identities = load_gallery()
        sink(matching.match(batch, gallery, identities, **options), batch_id)

    return (
        queries.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(one_batch)
        .trigger(availableNow=True)
        .start()
    )


def freshest_per_batch(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Within a micro-batch a newer pending frame replaces older ones."""
    return temporal.freshest(batch, keys, order)
