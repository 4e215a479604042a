from __future__ import annotations

import math

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.operators import gallery, scan, temporal, tracking
from maskwright.streaming import tracks as streams

BOX = "struct<x:double,y:double,width:double,height:double,identity_id:string>"
ROUNDS = f"video_id bigint, generation bigint, captured_ms bigint, seq bigint, boxes array<{BOX}>"


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranges_do_not_change_running_values(spark, keys, inclusive):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 3)), i * i, int(rng.integers(-5, 5)) if rng.random() < 0.6 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t bigint, v bigint")
    ask = dict(
        sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")}, maxes={"m": F.col("v")}, inclusive=inclusive
    )
    plain = scan.running(df, keys, ["t"], ranges=scan.Ranges(), **ask)
    cutting = scan.plan_ranges(df, "t", rows=7)
    assert cutting.cuts
    for ranges in (cutting, scan.Ranges(cutting.cuts[::6], 5)):
        cut_up = scan.running(df, keys, ["t"], ranges=ranges, **ask)
        columns = ["k", "t", "v", "s", "l", "m"]
        key = lambda r: r["t"]
        assert sorted(plain.select(columns).collect(), key=key) == sorted(cut_up.select(columns).collect(), key=key)


def test_rank_in_group(spark):
    df = spark.createDataFrame([(i % 2, (i * 7) % 50, i) for i in range(50)], "g int, a int, b int")
    got = scan.rank_in_group(df, ["g"], [F.desc("a"), F.col("b")], "r").collect()
    for g in (0, 1):
        want = sorted(((r.a, r.b) for r in got if r.g == g), key=lambda t: (-t[0], t[1]))
        assert [(r.a, r.b) for r in sorted((r for r in got if r.g == g), key=lambda r: r.r)] == want
        assert sorted(r.r for r in got if r.g == g) == list(range(1, 26))


@pytest.mark.parametrize("scan_rows", [2_000_000, 9])
def test_replay_equals_a_sequential_store(spark, monkeypatch, scan_rows):
    monkeypatch.setattr(settings, "SCAN_ROWS", scan_rows)
    rng = np.random.default_rng(4)
    log = []
    for seq in range(150):
        op = rng.choice(["CONFIRM", "CONFIRM", "REMOVE", "SET_ENABLED"])
        switch = op == "SET_ENABLED"
        log.append((
            seq, str(op), None if switch else f"i{rng.integers(0, 6)}", bool(rng.random() < 0.5) and op == "CONFIRM",
            bool(rng.random() < 0.5) if switch else None,
            float(rng.choice([0.3, 0.5, float("nan")])), int(rng.choice([0, seq + 1])),
        ))
    df = spark.createDataFrame(
        log, "seq bigint, op string, identity_id string, explicit boolean, enabled boolean, threshold double, created_at bigint"
    )
    replayed = gallery.replay(df)
    store, on, revision, want = {}, True, 0, {}
    for seq, op, ident, explicit, enabled, threshold, created in log:
        done = False
        if op == "SET_ENABLED":
            done, on = on != enabled, enabled
        elif op == "REMOVE":
            done = store.pop(ident, None) is not None
        elif not explicit or ident in store:
            done = True
            old = store.get(ident, (float("nan"), 0))
            store[ident] = (
                old[0] if math.isfinite(old[0]) else threshold, old[1] if old[1] > 0 else created
            )
        revision += done
        want[seq] = (done, revision)
    assert {r.seq: (r.effective, r.revision) for r in replayed.collect()} == want
    clean = lambda t: None if t is None or math.isnan(t) else t
    final = {r.identity_id: (clean(r.threshold), r.created_at) for r in gallery.gallery_after(replayed).collect()}
    assert final == {k: (clean(t), c) for k, (t, c) in store.items()}


def test_upsert_keeps_finite_threshold_and_time(spark):
    schema = "identity_id string, identity_ord bigint, name string, threshold double, created_at bigint"
    stored = spark.createDataFrame([("a", 0, "A", 0.5, 10), ("b", 1, "B", float("nan"), 0), ("c", 2, "C", 0.7, 3)], schema)
    new = spark.createDataFrame([("a", 9, "A2", 0.4, 99), ("b", 9, "B2", 0.4, 99), ("d", 9, "D", 0.4, 99)], schema)
    got = {r.identity_id: tuple(r)[1:] for r in gallery.upsert(stored, new).collect()}
    assert got == {
        "a": (0, "A2", 0.5, 10), "b": (1, "B2", 0.4, 99), "c": (2, "C", 0.7, 3), "d": (9, "D", 0.4, 99)
    }


def rounds(seed, videos=3, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for v in range(videos):
        now = 0
        for i in range(n):
            now += int(rng.choice([250, 400, 800, 1999, 2000, 2001, 3500], p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.1]))
            boxes = [
                tuple(float(x) for x in (*rng.integers(0, 90, 2), *rng.integers(5, 30, 2)))
                for _ in range(int(rng.integers(0, 5)))
            ]
            out.append((v, 0, now, i, [(*b, f"id{int(b[0]) % 3}") for b in boxes]))
    return out


def by_round(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.video_id, r.captured_ms, r.position)):
        got.setdefault((r.video_id, r.captured_ms), []).append(
            ((r.x, r.y, r.width, r.height), (r.vx, r.vy), r.last_seen_ms, r.misses)
        )
    return got


def model(data):
    trackers, want = {}, {}
    for v, _, now, _, boxes in data:
        live = trackers.setdefault(v, naive.Tracker()).round(now, [b[:4] for b in boxes])
        if live:
            want[(v, now)] = live
    return want


@pytest.mark.parametrize("scan_rows", [2_000_000, 10])
def test_tracks_equal_model(spark, monkeypatch, scan_rows):
    monkeypatch.setattr(settings, "SCAN_ROWS", scan_rows)
    data = rounds(scan_rows)
    got = tracking.track_rounds(spark.createDataFrame(data, ROUNDS)).collect()
    assert by_round(got) == model(data)
    assert {r.identity_id for r in got} <= {"id0", "id1", "id2"}


def test_stream_equals_batch(spark, tmp_path):
    data = rounds(7)
    cutoff = sorted(r[2] for r in data)[len(data) // 2]
    for part, name in (([r for r in data if r[2] <= cutoff], "a"), ([r for r in data if r[2] > cutoff], "b")):
        spark.createDataFrame(part, ROUNDS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    source = spark.readStream.schema(ROUNDS).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True
    ).parquet(str(tmp_path / "in"))
    run = (
        streams.track_stream(source)
        .writeStream.format("memory").queryName("tracked").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    run.awaitTermination(240)
    assert run.exception() is None
    assert by_round(spark.table("tracked").collect()) == model(data)


def test_degraded_stream_equals_batch(spark, tmp_path):
    rows = [(v, i, i, (i * (v + 2)) % 5 < 3) for v in range(2) for i in range(30)]
    schema = "video_id bigint, captured_ms bigint, seq bigint, failed boolean"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = (
        streams.degraded_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        .writeStream.format("memory").queryName("streaks").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    run.awaitTermination(240)
    batch = temporal.degraded(df, ["video_id"], ["captured_ms", "seq"], F.col("failed"))
    columns = ["video_id", "seq", "fail_streak", "degraded"]
    assert sorted(spark.table("streaks").select(columns).collect()) == sorted(batch.select(columns).collect())


def test_match_stream_follows_the_gallery(spark, tmp_path):
    gallery_schema = "identity_id string, identity_ord bigint, kind string, ord bigint, embedding array<float>"
    versions = [
        spark.createDataFrame([("a", 0, "embedding", 0, [1.0, 0.0])], gallery_schema),
        spark.createDataFrame([("b", 0, "embedding", 0, [1.0, 0.0])], gallery_schema),
    ]
    schema = "query_id bigint, embedding array<float>"
    for i in range(2):
        spark.createDataFrame([(i, [1.0, 0.0])], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    seen = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True
    ).parquet(str(tmp_path / "in"))
    run = streams.match_stream(
        source, lambda: (versions[len(seen)], None),
        lambda df, n: seen.append([r.identity_id for r in df.collect()]), str(tmp_path / "ck"), min_agreements=1,
    )
    run.awaitTermination(240)
    assert seen == [["a"], ["b"]]


def test_visibility_signals(spark):
    b = [(0.0, 0.0, 10.0, 10.0, "p")]
    rows = [(1, 0, 0, 0, b, None), (1, 0, 5000, 1, None, "visible-paused"), (1, 0, 5100, 2, [], None),
            (2, 0, 0, 0, b, None), (2, 0, 500, 1, None, "visible-playing"), (2, 0, 600, 2, [], None)]
    df = spark.createDataFrame(rows, ROUNDS + ", signal string")
    got = tracking.track_rounds(df).where("captured_ms > 500").collect()
    assert [(r.video_id, r.last_seen_ms, r.misses) for r in got] == [(1, 5000, 1)]


def test_age_bound_and_coasting(spark):
    b = lambda x: [(x, 0.0, 10.0, 10.0, "p")]
    rows = [(1, 0, 0, 0, b(0.0)), (1, 0, 1000, 1, b(5.0)), (1, 0, 3000, 2, []), (1, 0, 3001, 3, [])]
    df = spark.createDataFrame(rows, ROUNDS)
    tracks = tracking.track_rounds(df)
    assert {r.captured_ms for r in tracks.collect()} == {0, 1000, 3000}
    frames = spark.createDataFrame([(1, 0, t) for t in (500, 1000, 2000, 2999, 3000, 3500)],
                                   "video_id bigint, generation bigint, frame_ms bigint")
    at = tracking.coast_positions(frames, tracking.track_versions(tracks, df), ["video_id", "generation"]).collect()
    assert {r.frame_ms: round(r.x, 9) for r in at} == {500: 0.0, 1000: 5.0, 2000: 10.0, 2999: 14.995, 3000: 15.0}


def test_sampling_and_admission(spark):
    times = [0, 100, 250, 800, 1000, 1100, 1700, 5000, 5100]
    frames = spark.createDataFrame(
        [(1, t, i, i >= 4, True, True, False, 64, 64) for i, t in enumerate(times)],
        "video_id int, frame_ms bigint, seq bigint, live boolean, visible boolean, ready boolean, inflight boolean, width int, height int",
    )
    assert sorted(r.frame_ms for r in tracking.sample_frames(frames).collect()) == [0, 800, 1100, 1700, 5000]
    work = spark.createDataFrame([(1, 0, 50, 0), (1, 10, 500, 1), (1, 50, 60, 2), (1, 55, 90, 3), (1, 600, 700, 4)],
                                 "v int, arrived bigint, done bigint, seq bigint")
    got = temporal.admit_one_at_a_time(work, ["v"], "arrived", "done", "seq").collect()
    assert {r.seq: r.busy for r in got} == {0: False, 1: True, 2: False, 3: True, 4: False}
    lost = temporal.degraded(
        spark.createDataFrame([(1, i, f, l) for i, (f, l) in enumerate([(0, 0), (0, 1), (1, 0), (0, 0)])], "v int, t bigint, f int, l int"),
        ["v"], ["t"], F.col("f") == 1, F.col("l") == 1,
    )
    assert [r.degraded for r in lost.orderBy("t").collect()] == [False, True, True, False]


def test_tied_capture_times_keep_the_last_round_visible(spark):
    box = lambda x: [{"x": x, "y": 0.0, "width": 10.0, "height": 10.0, "identity_id": "a"}]
    kind = ("video_id long, generation long, captured_ms long, seq long,"
            " boxes array<struct<x: double, y: double, width: double, height: double, identity_id: string>>")
    rounds = spark.createDataFrame([(1, 0, 100, 1, box(0.0)), (1, 0, 100, 2, box(4.0))], kind)
    versions = tracking.track_versions(tracking.track_rounds(rounds), rounds)
    frames = spark.createDataFrame(
        [(1, 0, 150, "first"), (1, 0, 150, "second")], "video_id long, generation long, frame_ms long, frame string"
    )
    shown = tracking.coast_positions(frames, versions, ["video_id", "generation"]).collect()
    assert sorted((r.frame, r.x) for r in shown) == [("first", 4.0), ("second", 4.0)]


def test_many_small_keys_need_no_ranges(spark, monkeypatch):
    monkeypatch.setattr(settings, "SCAN_ROWS", 10)
    many = spark.range(100).selectExpr("id AS t", "id % 20 AS k")
    assert scan.plan_ranges(many, "t").cuts and not scan.plan_ranges(many, "t", keys=["k"]).cuts
    hot = many.withColumn("k", F.when(F.col("t") < 50, F.lit(0)).otherwise(F.col("k")))
    assert scan.plan_ranges(hot, "t", keys=["k"]).cuts
    assert scan.plan_ranges(many, "t", rows=7, keys=["k"]).cuts
