"""Each stream, fed in five batches, returns the rows of its batch twin."""

from __future__ import annotations

import glob
import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.operators import gallery, temporal, tracking
from maskwright.plans import state_queries as sq
from maskwright.streaming import media

FOLDER = "/root/testdata/sf0.001"
HOUR = 3_600_000


def fed(spark, tmp_path, name, rows, when, batches=5):
    """The rows as files of rising time, read as a stream of one file per batch."""
    place = f"{tmp_path}/{name}"
    cuts = rows.select(F.percentile(when, [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    for k in range(batches):
        part = rows
        if k:
            part = part.where(F.col(when) > cuts[k - 1])
        if k < batches - 1:
            part = part.where(F.col(when) <= cuts[k])
        part.coalesce(1).write.parquet(f"{place}/{k}")
        for n, path in enumerate(glob.glob(f"{place}/{k}/*.parquet")):
            os.utime(path, (1_000_000 + 100 * k + n, 1_000_000 + 100 * k + n))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(place)


def ran(spark, tmp_path, stream, name):
    run = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", f"{tmp_path}/checkpoint-{name}").trigger(availableNow=True).start()
    if not run.awaitTermination(150):
        run.stop()
        raise TimeoutError(name)
    assert run.exception() is None
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def until_read(run, rows):
    """End a stream of processing-time state, which never runs out of batches by itself."""
    end = time.time() + 90
    while sum(p["numInputRows"] for p in run.recentProgress) < rows and run.isActive and time.time() < end:
        time.sleep(0.2)
    run.stop()
    assert run.exception() is None and sum(p["numInputRows"] for p in run.recentProgress) == rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def late(df, when, **fixed):
    """A row so late that the watermark passes all others."""
    end = df.limit(1).select(*[F.lit(fixed[c]).cast(df.schema[c].dataType).alias(c) if c in fixed else F.col(c) for c in df.columns])
    return df.unionByName(end.withColumn(when, F.lit(4_000_000_000_000).cast("long")))


def test_watched_videos(spark, tmp_path):
    events = sq.video_events(spark, FOLDER)
    stream = media.watched_stream(fed(spark, tmp_path, "in", events, "at_ms"))
    assert ran(spark, tmp_path, stream, "watched") == rows_of(temporal.watched_videos(events))


def test_lost_coverage_and_silent_videos(spark, tmp_path):
    rounds = sq.rounds_with_tracks(spark, FOLDER)
    source = fed(spark, tmp_path, "in", late(rounds, "captured_ms", video_id=-1), "captured_ms")
    stream = media.coverage_stream(source, HOUR, 12 * HOUR)
    found = [r for r in ran(spark, tmp_path, stream, "coverage") if r[0] != -1]
    expected = rows_of(temporal.lost_coverage(rounds, HOUR, 12 * HOUR))
    assert found == expected and any(r[3] for r in expected)
    # state of silent videos is gone: only the late row's video has some
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/checkpoint-coverage")
    assert {r[0] for r in state.select("key.video_id").collect()} <= {-1}


def test_sampling_waits_for_the_tracks(spark, tmp_path):
    e = sq._events(spark, FOLDER)
    frames = e.where("event_type <> 'click'").select(
        "video_id", F.col("ms").alias("frame_ms"), "seq", F.lit(True).alias("visible"), (F.col("event_type") != "error").alias("ready"),
        F.lit(False).alias("inflight"), (F.col("k") + 20).alias("width"), F.lit(64).alias("height"),
    )
    live = e.where("event_type = 'click'").select("video_id", F.col("ms").alias("at_ms"), F.coalesce(F.col("k") % 2, F.lit(0)).alias("live_tracks"))
    # the state of the tracks as of each frame, for the batch twin
    both = frames.select("video_id", F.col("frame_ms").alias("t"), F.lit(1).alias("p"), "seq", F.lit(None).cast("long").alias("n")).unionByName(
        live.select("video_id", F.col("at_ms").alias("t"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("seq"), F.col("live_tracks").alias("n")))
    known = Window.partitionBy("video_id").orderBy("t", "p", "seq")
    asof = both.withColumn("live", F.coalesce(F.last("n", True).over(known) > 0, F.lit(False))).where("p = 1").select("video_id", "seq", "live")
    expected = rows_of(tracking.sample_frames(frames.join(asof, ["video_id", "seq"]), 12 * HOUR, 4 * HOUR))
    frames, live = late(frames, "frame_ms", video_id=-1), late(live, "at_ms", video_id=-1)
    # the frames come in four batches, the tracks in five: they are never in step
    stream = media.sample_stream(
        fed(spark, tmp_path, "frames", frames, "frame_ms", 4), fed(spark, tmp_path, "live", live, "at_ms", 5),
        12 * HOUR, 4 * HOUR, delay_ms=40 * 24 * HOUR, forget_ms=400 * 24 * HOUR,
    )
    assert [r for r in ran(spark, tmp_path, stream, "sampled") if r[0] != -1] == expected


def test_coasting_is_an_as_of_join(spark, tmp_path):
    e = sq._events(spark, FOLDER, 6 * HOUR)  # many rows of one time
    seen = sq._observations(e).select(
        "video_id", "seen_ms", "seq", F.col("seq").alias("track_id"), "x", "y", F.lit(10.0).alias("width"), F.lit(10.0).alias("height"), "vx", "vy")
    frames = e.where("event_type = 'view'").select("video_id", F.col("seq").alias("frame_seq"), F.col("ms").alias("frame_ms"))
    next_round = F.lead("seen_ms").over(Window.partitionBy("video_id").orderBy("seen_ms", "seq"))
    versions = seen.withColumn("until_ms", next_round).withColumn("from_ms", F.col("seen_ms")).withColumnRenamed("seen_ms", "last_seen_ms")
    expected = tracking.coast_positions(frames, versions.drop("seq"), ["video_id"], 24 * HOUR)
    columns = ["video_id", "frame_seq", "frame_ms", "track_id", "x", "y", "width", "height"]
    stream = media.coast_stream(
        fed(spark, tmp_path, "frames", late(frames, "frame_ms", video_id=-1), "frame_ms"),
        fed(spark, tmp_path, "seen", late(seen, "seen_ms", video_id=-1), "seen_ms"), 24 * HOUR, delay_ms=40 * 24 * HOUR,
    )
    assert [r for r in ran(spark, tmp_path, stream, "coasted") if r[0] != -1] == rows_of(expected.select(columns))


def test_media_are_scored_once_per_revision_across_restarts(spark, tmp_path):
    schema = "media_url string, media_id long, revision long"
    arrivals = [[("a", 1, 1), ("b", 2, 1)], [("a", 3, 1), ("b", 4, 2)], [("a", 5, 2), ("a", 6, 2)], [("b", 7, 1), ("c", 8, 2)], [("a", 9, 3)]]
    found = []
    for k, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

        def keep(df, n):
            found.extend((r.media_url, r.revision) for r in df.collect())

        run = media.score_once_stream(source).writeStream.outputMode("append").foreachBatch(keep).option(
            "checkpointLocation", f"{tmp_path}/ck").start()
        until_read(run, len(rows))  # a restart for every batch
    assert sorted(found) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 2)]
    # what the batch twin leaves over at the last revision is what was never handed on there
    seen = spark.createDataFrame(found, "media_url string, revision long")
    all_media = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "media_url string")
    assert {r[0] for r in gallery.unprocessed(all_media, seen, 2).collect()} == {"d"}


def test_stale_replies_are_dropped(spark, tmp_path):
    kind = "media_id long, at_ms long, token long, revision long"
    requests = spark.createDataFrame([(1, 10, 1, 1), (1, 30, 2, 1), (2, 10, 5, 1), (1, 60, 2, 2)], kind)
    replies = spark.createDataFrame(
        [(1, 20, 1, 1, 100), (1, 40, 1, 1, 101), (1, 41, 2, 1, 102), (2, 90, 5, 1, 103), (1, 70, 2, 1, 104), (1, 71, 2, 2, 105), (3, 5, 1, 1, 106)],
        kind + ", reply_id long")
    stream = media.current_replies_stream(fed(spark, tmp_path, "q", requests, "at_ms", 1), fed(spark, tmp_path, "r", replies, "at_ms", 1))
    run = stream.writeStream.format("memory").queryName("replies").outputMode("append").option(
        "checkpointLocation", f"{tmp_path}/ck").start()
    until_read(run, 11)
    assert rows_of(spark.table("replies")) == [(1, 100), (1, 102), (1, 105), (2, 103)]
