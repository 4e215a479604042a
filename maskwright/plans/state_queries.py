"""Gallery state from ``orders`` and video streams from ``events``.

A video is a user, a round is an event: x from the value, y from the key in props.
Errors are failed rounds, sign-ups are generation boundaries. Gaps are minutes to hours
here, so ages are scaled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.lineage import cut, table
from maskwright.operators import gallery, matching, reports, temporal, tracking
from maskwright.plans import sql
from maskwright.plans.registry import query
from maskwright.plans.rounding import r6
from maskwright.sources import directory

HOUR = 3_600_000


# ---- gallery state


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """One mutation per order: urgent orders switch, P removes, O refreshes, F confirms."""
    o = table(spark, folder, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    status = F.col("o_orderstatus")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(urgent, "SET_ENABLED").when(status == "P", "REMOVE").otherwise("CONFIRM").alias("op"),
        F.when(urgent, F.lit(None)).otherwise(F.col("o_custkey")).alias("identity_id"),
        (~urgent & (status == "O")).alias("explicit"),
        F.when(urgent, status != "P").alias("enabled"),
        F.when(cents % 3 == 0, F.lit(float("nan"))).otherwise((cents % 100) / 100.0).alias("threshold"),
        F.when(cents % 5 == 0, F.lit(0)).otherwise(cents).cast("bigint").alias("created_at"),
    )


_LOG = """
    l0 AS (SELECT o_orderkey AS seq, o_custkey AS c, o_orderpriority = '1-URGENT' AS urgent, o_orderstatus AS st,
                  floor(o_totalprice * 100 + 0.5)::BIGINT AS cents FROM orders),
    l AS (SELECT seq, CASE WHEN urgent THEN 'SET_ENABLED' WHEN st = 'P' THEN 'REMOVE' ELSE 'CONFIRM' END AS op,
                 CASE WHEN NOT urgent THEN c END AS identity_id, NOT urgent AND st = 'O' AS explicit,
                 CASE WHEN urgent THEN st <> 'P' END AS enabled,
                 CASE WHEN cents % 3 = 0 THEN NULL ELSE (cents % 100) / 100.0::DOUBLE END AS thr,
                 CASE WHEN cents % 5 = 0 THEN 0 ELSE cents END AS created FROM l0),
    p AS (SELECT *, coalesce(last_value(CASE WHEN op = 'REMOVE' THEN 0 WHEN op = 'CONFIRM' AND NOT explicit THEN 1 END
                   IGNORE NULLS) OVER (PARTITION BY identity_id ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS present,
                 coalesce(last_value(enabled::INTEGER IGNORE NULLS) OVER (ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS was_on FROM l),
    e AS (SELECT *, CASE WHEN op = 'SET_ENABLED' THEN enabled::INTEGER <> was_on WHEN op = 'REMOVE' THEN present
                         ELSE NOT explicit OR present END AS effective FROM p),
    rp AS (SELECT *, (sum(effective::INTEGER) OVER (ORDER BY seq))::BIGINT AS revision,
                 (coalesce(sum((op = 'REMOVE' AND effective)::INTEGER) OVER (PARTITION BY identity_id ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS epoch FROM e)"""


@query(f"WITH {_LOG} SELECT seq, op, effective, revision, epoch FROM rp")
def gallery_replay(spark, folder):
    return gallery.replay(_log(spark, folder)).select("seq", "op", "effective", "revision", "epoch")


@query(
    f"""
    WITH {_LOG},
    g AS (SELECT identity_id, epoch, arg_max(op, seq) AS last_op, arg_min(thr, seq) FILTER (WHERE thr IS NOT NULL) AS thr,
                 arg_min(created, seq) FILTER (WHERE created > 0) AS first_c, arg_max(created, seq) AS last_c,
                 max(seq) AS last_seq, max(revision) AS revision
          FROM rp WHERE op <> 'SET_ENABLED' AND effective GROUP BY ALL)
    SELECT identity_id, thr AS threshold, coalesce(first_c, last_c)::BIGINT AS created_at, last_seq, revision
    FROM g WHERE last_op = 'CONFIRM'"""
)
def gallery_state(spark, folder):
    final = gallery.gallery_after(gallery.replay(_log(spark, folder)))
    threshold = F.when(~F.isnan("threshold"), F.col("threshold"))
    return final.withColumn("threshold", threshold)


@query(
    f"""
    WITH {_LOG}, m AS (SELECT max(revision) AS revision, arg_max(enabled, seq) FILTER (WHERE enabled IS NOT NULL) AS enabled FROM rp)
    SELECT coalesce(enabled, true) AS enabled, revision FROM m"""
)
def shared_state(spark, folder):
    """What callers outside the owner see."""
    log = gallery.replay(_log(spark, folder))
    meta = log.agg(
        F.coalesce(
            F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("seq"))), F.lit(True)
        ).alias("enabled"),
        F.max("revision").alias("revision"),
    )
    return directory.redacted_view(meta)


@query(
    f"""
    WITH s AS (SELECT c_custkey AS identity_ord, {sql.identity_id('c_name')} AS id, c_name AS name,
                 CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 10000 END AS thr,
                 CASE WHEN c_nationkey < 5 THEN 0 ELSE c_custkey + 1 END AS created FROM customer),
    n AS (SELECT o_custkey AS identity_ord, {sql.identity_id("'Customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0')")} AS id,
                 'new ' || o_custkey AS name, 0.4::DOUBLE AS thr, max(o_orderkey) AS created
          FROM orders GROUP BY o_custkey)
    SELECT coalesce(s.id, n.id) AS identity_id, coalesce(s.identity_ord, n.identity_ord) AS identity_ord,
           CASE WHEN n.id IS NOT NULL THEN n.name ELSE s.name END AS name,
           CASE WHEN n.id IS NULL OR s.thr IS NOT NULL THEN s.thr ELSE n.thr END AS threshold,
           (CASE WHEN n.id IS NULL OR s.created > 0 THEN s.created ELSE n.created END)::BIGINT AS created_at
    FROM s FULL JOIN n ON s.id = n.id"""
)
def gallery_upsert(spark, folder):
    stored = table(spark, folder, "customer").select(
        text.identity_id(F.col("c_name")).alias("identity_id"),
        F.col("c_custkey").alias("identity_ord"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal") / 10000).alias("threshold"),
        F.when(F.col("c_nationkey") < 5, F.lit(0)).otherwise(F.col("c_custkey") + 1).alias("created_at"),
    )
    buyers = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("created_at"))
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    confirmed = buyers.select(
        text.identity_id(name).alias("identity_id"),
        F.col("o_custkey").alias("identity_ord"),
        F.concat(F.lit("new "), F.col("o_custkey").cast("string")).alias("name"),
        F.lit(0.4).alias("threshold"),
        "created_at",
    )
    return gallery.upsert(stored, confirmed)


@query(
    """
    SELECT c_custkey AS identity_id FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""
)
def gallery_remove(spark, folder):
    stored = table(spark, folder, "customer").select(F.col("c_custkey").alias("identity_id"))
    gone = table(spark, folder, "orders").where("o_orderstatus = 'P'")
    return gallery.remove(stored, gone.select(F.col("o_custkey").alias("identity_id")))


@query(
    """
    WITH m AS (SELECT p_partkey, p_size % 2 = 0 AS enabled, p_size::BIGINT AS revision FROM part)
    SELECT true AS enabled, CASE WHEN enabled THEN revision ELSE revision + 1 END AS revision, count(*) AS n
    FROM m GROUP BY ALL"""
)
def enable_switch(spark, folder):
    states = table(spark, folder, "part").select(
        (F.col("p_size") % 2 == 0).alias("enabled"), F.col("p_size").cast("bigint").alias("revision")
    )
    switched = gallery.set_enabled(states, True)
    return reports.count_reasons(switched, ["enabled", "revision"])


@query(
    f"""
    WITH {_LOG}, m AS (SELECT coalesce(arg_max(enabled, seq) FILTER (WHERE enabled IS NOT NULL), true) AS enabled FROM l)
    SELECT page_id FROM pages, m WHERE enabled"""
)
def enabled_media(spark, folder):
    meta = _log(spark, folder).agg(
        F.coalesce(
            F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("seq"))), F.lit(True)
        ).alias("enabled"),
        F.max("seq").alias("revision"),
    )
    return matching.enabled_only(table(spark, folder, "pages").select("page_id"), meta)


@query(
    """
    WITH done AS (SELECT 'https://media.example/' || o_custkey AS media_url, o_orderkey % 3 AS revision FROM orders)
    SELECT p_partkey AS media_id FROM part
    WHERE NOT EXISTS (SELECT 1 FROM done WHERE revision = 2 AND media_url = 'https://media.example/' || p_partkey)"""
)
def incremental_media(spark, folder):
    url = lambda c: F.concat(F.lit("https://media.example/"), F.col(c).cast("string"))
    media = table(spark, folder, "part").select(
        F.col("p_partkey").alias("media_id"), url("p_partkey").alias("media_url")
    )
    results = table(spark, folder, "orders").select(
        url("o_custkey").alias("media_url"), (F.col("o_orderkey") % 3).alias("revision")
    )
    return gallery.unprocessed(media, results, 2).select("media_id")


@query(
    """
    SELECT o_orderkey AS reply_id FROM orders
    JOIN (SELECT c_custkey, c_nationkey % 4 AS token, c_custkey % 3 AS revision FROM customer) c
      ON o_custkey = c_custkey AND o_orderkey % 4 = token AND o_orderkey % 3 = revision"""
)
def stale_replies(spark, folder):
    k = F.col("o_orderkey")
    replies = table(spark, folder, "orders").select(
        k.alias("reply_id"), F.col("o_custkey").alias("media_id"), (k % 4).alias("token"), (k % 3).alias("revision")
    )
    current = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("media_id"),
        (F.col("c_nationkey") % 4).cast("bigint").alias("token"),
        (F.col("c_custkey") % 3).alias("revision"),
    )
    return gallery.current_only(replies, current).select("reply_id")


# ---- video streams


def _events(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """``step`` makes times coarser, so that rows of a video share one."""
    e = table(spark, folder, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ms = F.floor(ms / step) * step if step > 1 else ms
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("video_id"), ms.alias("ms"), F.col("event_id").alias("seq"), "event_type",
        F.col("value").alias("x"), k.alias("k"), "value",
    )


_E = """
    ev AS (SELECT user_id AS video_id, epoch_us(ts) // 1000 AS ms, event_id AS seq, event_type, value AS x,
                  (props->>'$.k')::BIGINT AS k, value FROM events)"""
DAY = 24 * 3_600_000


def coarse(sql_text: str, step: int = DAY) -> str:
    """The same SQL over the coarser times of ``_events(.., step)``."""
    return sql_text.replace("epoch_us(ts) // 1000 AS ms", f"epoch_us(ts) // 1000 // {step} * {step} AS ms")


_ORDERED = "(PARTITION BY video_id ORDER BY ms, seq)"
_BEFORE = "(PARTITION BY video_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    f"""
    WITH {_E}
    SELECT video_id, seq, (sum((event_type = 'signup')::INTEGER) OVER {_ORDERED})::BIGINT AS generation FROM ev"""
)
def generations(spark, folder):
    e = _events(spark, folder)
    numbered = temporal.generations(e, ["video_id"], ["ms", "seq"], F.col("event_type") == "signup")
    return numbered.select("video_id", "seq", "generation")


@query(
    f"""
    WITH {_E}, g AS (SELECT *, (sum((event_type = 'signup')::INTEGER) OVER {_ORDERED})::BIGINT AS generation FROM ev),
    c AS (SELECT video_id, max(generation) AS generation FROM g GROUP BY 1)
    SELECT g.video_id, seq FROM g JOIN c USING (video_id, generation)"""
)
def current_replies(spark, folder):
    e = _events(spark, folder)
    g = temporal.generations(e, ["video_id"], ["ms", "seq"], F.col("event_type") == "signup")
    current = g.groupBy("video_id").agg(F.max("generation").alias("generation"))
    return temporal.current_generation(g, current, ["video_id"]).select("video_id", "seq")


@query(
    f"""
    WITH {_E}, d AS (SELECT video_id, seq, ms, ms + k * 50 AS arrived FROM ev)
    SELECT video_id, arrived - ms > 2000 AS late, count(*) AS n FROM d GROUP BY ALL"""
)
def late_results(spark, folder):
    e = _events(spark, folder).select(
        "video_id", F.col("ms").alias("captured_ms"), (F.col("ms") + F.col("k") * 50).alias("arrived_ms")
    )
    return reports.count_reasons(temporal.mark_late(e), ["video_id", "late"])


@query(
    f"""
    WITH {_E}, f AS (SELECT *, (event_type = 'error')::INTEGER AS bad FROM ev),
    c AS (SELECT *, sum(1 - bad) OVER {_ORDERED} AS island FROM f),
    s AS (SELECT *, (sum(bad) OVER (PARTITION BY video_id, island ORDER BY ms, seq))::BIGINT AS fail_streak FROM c)
    SELECT video_id, seq, fail_streak, fail_streak >= 3 AS degraded FROM s"""
)
def degraded_streaks(spark, folder):
    e = _events(spark, folder)
    marked = temporal.degraded(e, ["video_id"], ["ms", "seq"], F.col("event_type") == "error")
    return marked.select("video_id", "seq", "fail_streak", "degraded")


@query(
    f"""
    WITH {_E}, s AS (SELECT *, CASE WHEN k % 10 < 3 THEN '' ELSE 'r' || (k % 3) END AS res,
                       CASE WHEN event_type = 'error' THEN 'tainted' ELSE 'ok' END AS outcome FROM ev),
    b AS (SELECT *, last_value(nullif(res, '') IGNORE NULLS) OVER {_BEFORE} AS prev FROM s),
    e AS (SELECT *, (sum((res <> '' AND (prev IS NULL OR prev <> res))::INTEGER) OVER {_ORDERED})::BIGINT AS resource_epoch FROM b)
    SELECT video_id, seq, resource_epoch,
           bool_or(outcome = 'tainted') OVER (PARTITION BY video_id, resource_epoch ORDER BY ms, seq) AS unreadable FROM e"""
)
def resource_latch(spark, folder):
    e = _resources(spark, folder)
    latched = temporal.resource_latch(e, ["video_id"], ["ms", "seq"], "resource", "outcome")
    return latched.select("video_id", "seq", "resource_epoch", "unreadable")


def _resources(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, folder).withColumn(
        "resource", F.when(k % 10 < 3, "").otherwise(F.concat(F.lit("r"), (k % 3).cast("string")))
    ).withColumn("outcome", F.when(F.col("event_type") == "error", "tainted").otherwise("ok"))


@query(
    f"""
    WITH {_E}, w AS (SELECT *, ms // {6 * HOUR} AS batch FROM ev)
    SELECT video_id, batch, max(ms) AS ms, arg_max(seq, (ms, seq)) AS seq FROM w GROUP BY video_id, batch"""
)
def freshest_frame(spark, folder):
    e = _events(spark, folder).withColumn("batch", F.floor(F.col("ms") / (6 * HOUR)))
    newest = temporal.freshest(e.select("video_id", "batch", "ms", "seq"), ["video_id", "batch"], ["ms", "seq"])
    return newest.select("video_id", "batch", "ms", "seq")


@query(
    f"""
    WITH RECURSIVE {_E},
    f AS (SELECT video_id, seq, ms, ms + k * 600000 AS done, row_number() OVER {_ORDERED} AS i FROM ev),
    r AS (
      SELECT video_id, 0::BIGINT AS i, NULL::BIGINT AS seq, false AS busy, -1::BIGINT AS until
      FROM (SELECT DISTINCT video_id FROM f)
      UNION ALL
      SELECT f.video_id, f.i, f.seq, f.ms < r.until, CASE WHEN f.ms < r.until THEN r.until ELSE f.done END
      FROM r JOIN f ON f.video_id = r.video_id AND f.i = r.i + 1
    )
    SELECT video_id, seq, busy FROM r WHERE seq IS NOT NULL"""
)
def busy_frames(spark, folder):
    e = _events(spark, folder).withColumn("done", F.col("ms") + F.col("k") * 600000)
    judged = temporal.admit_one_at_a_time(e, ["video_id"], "ms", "done", "seq")
    return judged.select("video_id", "seq", "busy")


@query(f"WITH {_E} SELECT video_id, seq FROM ev WHERE k * 1000 <= 60000")
def queue_expiry(spark, folder):
    e = _events(spark, folder).withColumn("started", F.col("ms") + F.col("k") * 1000)
    return temporal.expire(e, "ms", "started").select("video_id", "seq")


@query(
    """
    WITH r AS (SELECT o_custkey AS page, o_orderkey AS video,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 5000) DESC, o_orderkey) AS rn FROM orders)
    SELECT page, video, rn::INTEGER AS rank FROM r WHERE rn <= 8"""
)
def largest_videos(spark, folder):
    videos = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("page"),
        F.col("o_orderkey").alias("video"),
        F.floor(F.col("o_totalprice") / 5000).alias("area"),
    )
    return temporal.largest_videos(videos, ["page"], "video").select("page", "video", "rank")


_VELOCITY = f"""
    o AS (SELECT * FROM ev WHERE event_type <> 'view'),
    p AS (SELECT *, lag(ms) OVER {_ORDERED} AS pt, lag(x) OVER {_ORDERED} AS px, lag(k) OVER {_ORDERED} AS pk FROM o),
    q AS (SELECT *, CASE WHEN ms > pt THEN (x - px) / (ms - pt) END AS rvx, CASE WHEN ms > pt THEN (k - pk)::DOUBLE / (ms - pt) END AS rvy FROM p),
    v AS (SELECT *, coalesce(last_value(rvx IGNORE NULLS) OVER {_ORDERED}, 0) AS vx,
                    coalesce(last_value(rvy IGNORE NULLS) OVER {_ORDERED}, 0) AS vy FROM q)"""


def _observations(e: DataFrame) -> DataFrame:
    seen = e.where("event_type <> 'view'").select(
        "video_id", F.col("ms").alias("seen_ms"), "seq", "x", F.col("k").cast("double").alias("y")
    )
    return tracking.velocities(seen, ["video_id"], "seq")


@query(
    f"WITH {_E}, {_VELOCITY} SELECT video_id, seq, {sql.r6('vx * 3600000')} AS vx_hour, {sql.r6('vy * 3600000')} AS vy_hour FROM v"
)
def track_velocity(spark, folder):
    v = _observations(_events(spark, folder))
    return v.select(
        "video_id", "seq", r6(F.col("vx") * HOUR).alias("vx_hour"), r6(F.col("vy") * HOUR).alias("vy_hour")
    )


@query(
    f"""
    WITH {_E}, {_VELOCITY},
    n AS (SELECT *, lead(ms) OVER {_ORDERED} AS nxt FROM v),
    f AS (SELECT video_id, seq AS frame_seq, ms AS frame_ms FROM ev WHERE event_type = 'view')
    SELECT f.video_id, frame_seq, n.seq AS track_id, {sql.r6('n.x + vx * (frame_ms - ms)')} AS x,
           {sql.r6('n.k + vy * (frame_ms - ms)')} AS y
    FROM f JOIN n ON n.video_id = f.video_id AND frame_ms >= ms AND (nxt IS NULL OR frame_ms < nxt)
      AND frame_ms - ms <= {24 * HOUR}"""
)
def coast_positions(spark, folder):
    """View events are presented frames; every other event is an observation."""
    return positions(spark, folder)


def positions(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    e = _events(spark, folder, step)
    v = _observations(e)
    following = _following(v)
    versions = following.select(
        "video_id", F.col("seq").alias("track_id"), F.col("seen_ms").alias("from_ms"),
        F.col("next_ms").alias("until_ms"), F.col("seen_ms").alias("last_seen_ms"), "x", "y",
        F.lit(10.0).alias("width"), F.lit(10.0).alias("height"), "vx", "vy",
    )
    frames = e.where("event_type = 'view'").select(
        "video_id", F.col("seq").alias("frame_seq"), F.col("ms").alias("frame_ms")
    )
    at = tracking.coast_positions(frames, versions, ["video_id"], 24 * HOUR)
    return at.select(
        "video_id", "frame_seq", "track_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y")
    )


def _following(v: DataFrame) -> DataFrame:
    from maskwright.operators import scan

    backwards = v.withColumn("__neg", -F.col("seen_ms")).withColumn("__tie", -F.col("seq"))
    return scan.running(
        backwards, ["video_id"], ["__neg", "__tie"], lasts={"next_ms": F.col("seen_ms")}, inclusive=False
    ).drop("__neg", "__tie")


def _rounds(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    e = _events(spark, folder, step)
    g = temporal.generations(e, ["video_id"], ["ms", "seq"], F.col("event_type") == "signup")
    side = lambda by: 8 + F.col("k") % by
    box = lambda dx: F.struct(
        (F.col("x") + dx).cast("double").alias("x"),
        (F.col("k") + dx).cast("double").alias("y"),
        side(7).cast("double").alias("width"),
        side(5).cast("double").alias("height"),
        F.concat(F.lit("id-"), (F.col("k") % 4).cast("string")).alias("identity_id"),
    )
    none = F.array().cast("array<struct<x:double,y:double,width:double,height:double,identity_id:string>>")
    boxes_ = (
        F.when(F.col("event_type") == "error", none)
        .when(F.col("event_type") == "click", F.array(box(0), box(25)))
        .otherwise(F.array(box(0)))
    )
    return g.select("video_id", "generation", F.col("ms").alias("captured_ms"), "seq", boxes_.alias("boxes"))


_TRACKER = tracking.TrackOptions(max_age_ms=24 * HOUR)


# ---- the tracker as one recursive query: a step per round, tracks carried as a list.

_TRACK = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, vx DOUBLE, vy DOUBLE, seen BIGINT, misses BIGINT, who VARCHAR)"
_OVERLAP_W = "(least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x))"
_OVERLAP_H = "(least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y))"
_TRACK_IOU = f"""(CASE WHEN {_OVERLAP_W} > 0 AND {_OVERLAP_H} > 0 THEN {_OVERLAP_W} * {_OVERLAP_H}
    / (t.w * t.h + d.w * d.h - {_OVERLAP_W} * {_OVERLAP_H}) ELSE 0.0::DOUBLE END)"""
_CENTER_GAP = "sqrt(pow(d.x + d.w / 2 - (t.x + t.w / 2), 2) + pow(d.y + d.h / 2 - (t.y + t.h / 2), 2))"


def _pairs(value: str) -> str:
    """Every (track, detection) index pair with a value, as a flat list."""
    return f"""flatten(list_transform(live, lambda t, i: list_transform(dets, lambda d, j:
        {{'v': {value}, 't': i, 'd': j}})))"""


_TRACKER_SQL = f"""
    gen AS (SELECT *, (sum((event_type = 'signup')::INTEGER) OVER {_ORDERED})::BIGINT AS generation FROM ev),
    box AS (SELECT *, {{'x': x, 'y': k::DOUBLE, 'w': (8 + k % 7)::DOUBLE, 'h': (8 + k % 5)::DOUBLE,
                       'who': 'id-' || k % 4}} AS b FROM gen),
    rounds AS (
      SELECT video_id, generation, ms, row_number() OVER (PARTITION BY video_id, generation ORDER BY ms, seq) AS i,
             CASE WHEN event_type = 'error' THEN []
                  WHEN event_type = 'click' THEN [b, {{'x': b.x + 25, 'y': b.y + 25, 'w': b.w, 'h': b.h, 'who': b.who}}]
                  ELSE [b] END AS dets
      FROM box
    ),
    st AS (
      SELECT video_id, generation, 0::BIGINT AS i, NULL::BIGINT AS ms, []::{_TRACK}[] AS tracks, 0::BIGINT AS next_id
      FROM (SELECT DISTINCT video_id, generation FROM rounds)
      UNION ALL
      SELECT video_id, generation, i, ms,
             list_concat(list_filter(moved, lambda t: t.misses <= 4),
               list_transform(born, lambda j, n: {{'id': next_id + n - 1, 'x': dets[j].x, 'y': dets[j].y, 'w': dets[j].w,
                 'h': dets[j].h, 'vx': 0.0::DOUBLE, 'vy': 0.0::DOUBLE, 'seen': ms, 'misses': 0::BIGINT, 'who': dets[j].who}})),
             next_id + len(born)
      FROM (
        SELECT *, list_filter(range(1, len(dets) + 1), lambda j: NOT list_contains(list_transform(won, lambda p: p.d), j)) AS born,
          list_transform(live, lambda t, n: CASE
            WHEN list_contains(list_transform(won, lambda p: p.t), n) THEN
              list_transform(list_filter(won, lambda p: p.t = n), lambda p: {{'id': t.id, 'x': dets[p.d].x, 'y': dets[p.d].y,
                'w': dets[p.d].w, 'h': dets[p.d].h,
                'vx': CASE WHEN ms > t.seen THEN (dets[p.d].x - t.x) / (ms - t.seen) ELSE t.vx END,
                'vy': CASE WHEN ms > t.seen THEN (dets[p.d].y - t.y) / (ms - t.seen) ELSE t.vy END,
                'seen': ms, 'misses': 0::BIGINT, 'who': dets[p.d].who}})[1]
            ELSE {{'id': t.id, 'x': t.x, 'y': t.y, 'w': t.w, 'h': t.h, 'vx': t.vx, 'vy': t.vy, 'seen': t.seen,
                   'misses': t.misses + 1, 'who': t.who}} END) AS moved
        FROM (
          SELECT *, list_filter([m1, m2, n1, list_filter(near, lambda p: p.t <> n1.t AND p.d <> n1.d)[1]],
                                lambda p: p IS NOT NULL) AS won
          FROM (
            SELECT *, near[1] AS n1 FROM (
              SELECT *, list_sort(list_filter({_pairs(_CENTER_GAP)}, lambda p:
                  p.v <= greatest(1.5::DOUBLE * greatest(live[p.t].w, live[p.t].h), 24)
                  AND (m1 IS NULL OR (p.t <> m1.t AND p.d <> m1.d)) AND (m2 IS NULL OR (p.t <> m2.t AND p.d <> m2.d)))) AS near
              FROM (
                SELECT *, list_filter(best, lambda p: p.t <> m1.t AND p.d <> m1.d)[1] AS m2 FROM (
                  SELECT *, best[1] AS m1 FROM (
                    SELECT *, list_sort(list_filter({_pairs('-' + _TRACK_IOU)}, lambda p: -p.v > 0.3::DOUBLE)) AS best
                    FROM (
                      SELECT r.video_id, r.generation, r.i, r.ms, r.dets, s.next_id,
                             list_filter(s.tracks, lambda t: r.ms - t.seen <= {24 * HOUR}) AS live
                      FROM st s JOIN rounds r ON r.video_id = s.video_id AND r.generation = s.generation AND r.i = s.i + 1
                    )
                  )
                )
              )
            )
          )
        )
      )
    )"""


@query(
    f"""
    WITH RECURSIVE {_E}, {_TRACKER_SQL},
    u AS (SELECT video_id, generation, ms AS captured_ms, unnest(range(len(tracks))) AS "position", unnest(tracks) AS t FROM st)
    SELECT video_id, generation, captured_ms, "position", {sql.r6('t.x')} AS x, {sql.r6('t.y')} AS y,
           {sql.r6('t.vx * 3600000')} AS vx_hour, t.seen AS last_seen_ms, t.misses AS misses, t.who AS identity_id FROM u"""
)
def track_rounds(spark, folder):
    tracks = tracking.track_rounds(_rounds(spark, folder), _TRACKER)
    return tracks.select(
        "video_id", "generation", "captured_ms", "position", r6(F.col("x")).alias("x"),
        r6(F.col("y")).alias("y"), r6(F.col("vx") * HOUR).alias("vx_hour"), "last_seen_ms", "misses", "identity_id",
    )


@query(
    f"""
    WITH RECURSIVE {_E}, {_TRACKER_SQL},
    ver AS (SELECT video_id, generation, ms AS from_ms, tracks,
                   lead(ms) OVER (PARTITION BY video_id, generation ORDER BY i) AS until_ms FROM st WHERE i > 0),
    u AS (SELECT video_id, generation, from_ms, until_ms, unnest(tracks) AS t FROM ver),
    f AS (SELECT video_id, generation, ms AS frame_ms FROM gen WHERE event_type = 'view')
    SELECT video_id, generation, frame_ms, {sql.r6('t.x + t.vx * greatest(0, frame_ms - t.seen)')} AS x,
           {sql.r6('t.y + t.vy * greatest(0, frame_ms - t.seen)')} AS y, t.w AS width, t.h AS height
    FROM f JOIN u USING (video_id, generation)
    WHERE frame_ms >= from_ms AND (until_ms IS NULL OR frame_ms < until_ms) AND frame_ms - t.seen <= {24 * HOUR}"""
)
def coasted_tracks(spark, folder):
    """The tracker's output shown at every view event of the same generation."""
    return coasted(spark, folder)


def coasted(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    rounds = cut(_rounds(spark, folder, step))
    versions = tracking.track_versions(tracking.track_rounds(rounds, _TRACKER), rounds)
    e = _events(spark, folder, step)
    g = temporal.generations(e, ["video_id"], ["ms", "seq"], F.col("event_type") == "signup")
    frames = g.where("event_type = 'view'").select("video_id", "generation", F.col("ms").alias("frame_ms"))
    at = tracking.coast_positions(frames, versions, ["video_id", "generation"], 24 * HOUR)
    at = at.withColumn("x", r6(F.col("x"))).withColumn("y", r6(F.col("y")))
    return at.drop("track_id")


@query(
    f"""
    WITH RECURSIVE {_E},
    f AS (SELECT video_id, seq, ms, event_type = 'click' AS live, row_number() OVER {_ORDERED} AS i FROM ev
          WHERE event_type <> 'error' AND 20 + k >= 32),
    r AS (
      SELECT video_id, 0::BIGINT AS i, NULL::BIGINT AS seq, false AS taken, -1000000000000::BIGINT AS last
      FROM (SELECT DISTINCT video_id FROM f)
      UNION ALL
      SELECT f.video_id, f.i, f.seq, f.ms - r.last >= CASE WHEN f.live THEN {4 * HOUR} ELSE {12 * HOUR} END,
             CASE WHEN f.ms - r.last >= CASE WHEN f.live THEN {4 * HOUR} ELSE {12 * HOUR} END THEN f.ms ELSE r.last END
      FROM r JOIN f ON f.video_id = r.video_id AND f.i = r.i + 1
    )
    SELECT video_id, seq FROM r WHERE taken"""
)
def frame_sampling(spark, folder):
    e = _events(spark, folder)
    frames = e.select(
        "video_id", F.col("ms").alias("frame_ms"), "seq", (F.col("event_type") == "click").alias("live"),
        F.lit(True).alias("visible"), (F.col("event_type") != "error").alias("ready"),
        F.lit(False).alias("inflight"), (F.col("k") + 20).alias("width"), F.lit(64).alias("height"),
    )
    return tracking.sample_frames(frames, 12 * HOUR, 4 * HOUR).select("video_id", "seq")


_ROUNDS = f"""
    {_E}, ro AS (
      SELECT video_id, ms, seq, event_type = 'error' AS failed,
             CASE WHEN event_type = 'click' THEN [ms, ms - (k % 50) * 60000] WHEN event_type = 'view' THEN [ms - (k % 50) * 60000]
                  ELSE []::BIGINT[] END AS live
      FROM ev
    )"""


@query(
    f"""
    WITH {_ROUNDS},
    p AS (SELECT *, lag(ms) OVER {_ORDERED} AS before, lead(ms) OVER {_ORDERED} AS nxt FROM ro),
    g AS (SELECT *, sum((before IS NOT NULL AND ms - before > {12 * HOUR})::INTEGER) OVER {_ORDERED} AS segment FROM p),
    gone AS (
      SELECT video_id, segment, t + {HOUR} + 1 AS ms, 0 AS turn, seq, false AS failed, true AS lost
      FROM (SELECT *, unnest(list_distinct(live)) AS t FROM g) WHERE nxt IS NULL OR t + {HOUR} < nxt
    ),
    h AS (SELECT * FROM gone UNION ALL SELECT video_id, segment, ms, 1, seq, failed, false FROM g),
    i AS (SELECT *, sum((NOT failed AND NOT lost)::INTEGER) OVER (PARTITION BY video_id, segment ORDER BY ms, turn, seq) AS island FROM h)
    SELECT video_id, ms AS captured_ms, seq, lost, (sum(failed::INTEGER) OVER w)::BIGINT AS fail_streak,
           sum(failed::INTEGER) OVER w >= 3 OR sum(lost::INTEGER) OVER w > 0 AS degraded
    FROM i WINDOW w AS (PARTITION BY video_id, segment, island ORDER BY ms, turn, seq)"""
)
def lost_coverage(spark, folder):
    return temporal.lost_coverage(rounds_with_tracks(spark, folder), HOUR, 12 * HOUR)


def rounds_with_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as detection rounds, with the times their live tracks were last seen."""
    e = _events(spark, folder)
    kind, older = F.col("event_type"), F.col("ms") - F.col("k") % 50 * 60000
    live = F.when(kind == "click", F.array("ms", older)).when(kind == "view", F.array(older)).otherwise(F.array().cast("array<bigint>"))
    return e.select("video_id", F.col("ms").alias("captured_ms"), "seq", (kind == "error").alias("failed"), live.alias("live"))


@query(
    """
    WITH RECURSIVE e AS (
      SELECT l_suppkey AS page, epoch_ms(l_shipdate) AS at_ms, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq, l_orderkey % 40 AS video,
             floor(l_extendedprice / 2000) AS area,
             CASE l_linenumber % 4 WHEN 2 THEN 'resize' WHEN 3 THEN CASE WHEN l_orderkey % 5 = 0 THEN 'leave' ELSE 'resize' END ELSE 'arrive' END AS kind
      FROM lineitem
    ),
    o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY at_ms, seq) AS i FROM e),
    r AS (
      SELECT page, 0::BIGINT AS i, []::STRUCT(v BIGINT, a DOUBLE)[] AS held, NULL::BIGINT AS at_ms, NULL::BIGINT AS seq,
             NULL::BIGINT AS video, NULL::BOOLEAN AS watched, NULL::BIGINT AS evicted
      FROM (SELECT DISTINCT page FROM o)
      UNION ALL
      SELECT page, i,
        CASE WHEN kind = 'leave' THEN list_filter(held, lambda x: x.v <> video)
             WHEN inside THEN list_transform(held, lambda x: {'v': x.v, 'a': CASE WHEN x.v = video THEN area ELSE x.a END})
             WHEN kind <> 'arrive' OR NOT room AND least >= area THEN held
             ELSE list_append(list_filter(held, lambda x: room OR x.v <> loser), {'v': video, 'a': area}) END,
        at_ms, seq, video, CASE WHEN kind = 'arrive' THEN inside OR room OR least < area END,
        CASE WHEN kind = 'arrive' AND NOT inside AND NOT room AND least < area THEN loser END
      FROM (
        SELECT *, held[list_position(list_transform(held, lambda x: x.a), least)].v AS loser
        FROM (
          SELECT o.*, r.held, len(r.held) < 8 AS room, list_contains(list_transform(r.held, lambda x: x.v), o.video) AS inside,
                 list_min(list_transform(r.held, lambda x: x.a)) AS least
          FROM r JOIN o ON o.page = r.page AND o.i = r.i + 1
        )
      )
    )
    SELECT page, at_ms, seq, video, watched, evicted FROM r WHERE watched IS NOT NULL"""
)
def watched_videos(spark, folder):
    """Line items as arrivals, changes of size and departures of forty videos a page."""
    return temporal.watched_videos(video_events(spark, folder))


def video_events(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    last = F.when(F.col("l_orderkey") % 5 == 0, temporal.LEAVE).otherwise(temporal.RESIZE)
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at_ms"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"),
        F.when(n == 2, temporal.RESIZE).when(n == 3, last).otherwise(temporal.ARRIVE).alias("kind"),
        (F.col("l_orderkey") % 40).alias("video"), F.floor(F.col("l_extendedprice") / 2000).cast("double").alias("area"),
    )
