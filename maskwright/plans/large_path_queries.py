"""The large paths of operators that change their plan with size, forced by parameters.

Every query here has the SQL of its small twin, so both paths are held to one definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import boxes
from maskwright.operators import detections, enroll, gallery, matching, reports, temporal
from maskwright.plans import box_queries, sql, state_queries, vector_queries
from maskwright.plans.registry import ORACLES, query
from maskwright.plans.rounding import r6

# Shipped part by part, a few hundred gallery rows at a time.
_PARTS = {"broadcast_bytes": 0, "block_rows": 150}
_ROUNDS = {"fold_rows": 1, "group_rows": 5, "block_rows": 3}
_GROUPED = {"fold_rows": 1}
_RANGE_ROWS = 700


@query(ORACLES["nms"])
def nms_grouped(spark, folder):
    rows = box_queries._detections(spark, folder)
    return detections.suppress(rows, ["media_id"], box_queries._TIES, 0.3, **_GROUPED).select(*box_queries._KEPT)


@query(ORACLES["nms"])
def nms_rounds(spark, folder):
    rows = box_queries._detections(spark, folder)
    return detections.suppress(rows, ["media_id"], box_queries._TIES, 0.3, **_ROUNDS).select(*box_queries._KEPT)


@query(ORACLES["cross_pass_merge"])
def cross_pass_merge_rounds(spark, folder):
    rows = box_queries._detections(spark, folder)
    first, second = rows.where("score >= 0.05"), rows.where("not score >= 0.05")
    return detections.merge_passes(first, second, ["media_id"], box_queries._TIES, **_ROUNDS).select(*box_queries._KEPT)


@query(ORACLES["near_duplicate_drop"])
def near_duplicate_drop_rounds(spark, folder):
    faces = vector_queries._vectors(spark, folder).select("label", F.col("vec_id").alias("ord"), "embedding")
    unique, dropped = enroll.drop_near_duplicates(faces, ["label"], 0.3, group_rows=1, block_rows=20)
    mark = lambda d, v: d.select("label", F.col("ord").alias("vec_id"), F.lit(v).alias("dropped"))
    return mark(unique, False).unionByName(mark(dropped, True))


def _found(found):
    return found.select(F.col("query_id").alias("vec_id"), "identity_id", r6(F.col("score")).alias("score"))


@query(ORACLES["match_agreements"])
def match_agreements_parts(spark, folder):
    rows = vector_queries._vectors(spark, folder)
    label = F.col("label")
    identities = rows.select("label").distinct().select(
        F.concat(F.lit("label-"), label.cast("string")).alias("identity_id"),
        F.when(label % 3 == 0, F.lit(float("nan"))).otherwise(0.2 + label / F.lit(100.0)).alias("threshold"),
    )
    return _found(matching.match(
        vector_queries._queries(spark, folder), vector_queries._label_gallery(rows, "embedding"), identities,
        default_threshold=0.25, min_agreements=3, **_PARTS,
    ))


# A metric index with a few dozen rows in a part of a cell.
_INDEX = {"broadcast_bytes": 0, "part_rows": 40}


@query(ORACLES["match_hard_negative"])
def match_hard_negative_index(spark, folder):
    rows = vector_queries._prototype_rows(spark, folder)
    negatives = vector_queries._label_gallery(rows, "hard_negative", (F.col("label") + 9) % 10)
    known = vector_queries._label_gallery(rows, "prototype").unionByName(negatives)
    return _found(matching.match(
        vector_queries._queries(spark, folder), known, default_threshold=0.25, min_agreements=1, margin=0.02, **_INDEX,
    ))


@query(ORACLES["match_agreements"])
def match_agreements_index(spark, folder):
    rows = vector_queries._vectors(spark, folder)
    label = F.col("label")
    identities = rows.select("label").distinct().select(
        F.concat(F.lit("label-"), label.cast("string")).alias("identity_id"),
        F.when(label % 3 == 0, F.lit(float("nan"))).otherwise(0.2 + label / F.lit(100.0)).alias("threshold"),
    )
    return _found(matching.match(
        vector_queries._queries(spark, folder), vector_queries._label_gallery(rows, "embedding"), identities,
        default_threshold=0.25, min_agreements=3, **_INDEX,
    ))


@query(ORACLES["best_cosine_report"])
def best_cosine_report_index(spark, folder):
    known = vector_queries._label_gallery(vector_queries._prototype_rows(spark, folder), "prototype")
    scored = matching.score_queries(
        vector_queries._queries(spark, folder), known, default_threshold=0.30, min_agreements=1, **_INDEX,
    )
    faces = reports.face_diagnostics(vector_queries._detections(spark, folder), scored)
    return faces.withColumn("best_cosine", r6(F.col("best_cosine")))


@query(ORACLES["match_hard_negative"])
def match_hard_negative_parts(spark, folder):
    rows = vector_queries._prototype_rows(spark, folder)
    negatives = vector_queries._label_gallery(rows, "hard_negative", (F.col("label") + 9) % 10)
    known = vector_queries._label_gallery(rows, "prototype").unionByName(negatives)
    return _found(matching.match(
        vector_queries._queries(spark, folder), known, default_threshold=0.25, min_agreements=1, margin=0.02,
        broadcast_bytes=0, block_rows=30,
    ))


@query(ORACLES["best_cosine_report"])
def best_cosine_report_parts(spark, folder):
    known = vector_queries._label_gallery(vector_queries._prototype_rows(spark, folder), "prototype")
    scored = matching.score_queries(
        vector_queries._queries(spark, folder), known, default_threshold=0.30, min_agreements=1,
        broadcast_bytes=0, block_rows=30,
    )
    faces = reports.face_diagnostics(vector_queries._detections(spark, folder), scored)
    return faces.withColumn("best_cosine", r6(F.col("best_cosine")))


@query(ORACLES["top_k_cosines"])
def top_k_cosines_parts(spark, folder):
    known = vector_queries._label_gallery(vector_queries._vectors(spark, folder), "embedding")
    top = matching.top_k_cosines(vector_queries._queries(spark, folder), known, 3, **_PARTS)
    return top.select(
        F.col("query_id").alias("vec_id"), "identity_id", "rank", r6(F.col("cosine")).alias("cosine")
    )


@query(ORACLES["similarity_join"])
def similarity_join_blocks(spark, folder):
    pairs = enroll.similar_pairs(vector_queries._one_group(spark, folder), ["name"], 0.35, block_rows=90, copies=True)
    return pairs.select("ord_a", "ord_b", r6(F.col("cosine")).alias("cosine"))


@query(ORACLES["similarity_components"])
def similarity_components_blocks(spark, folder):
    graph = enroll.similarity_graph(vector_queries._one_group(spark, folder), ["name"], 1 - 0.65, block_rows=90)
    return graph.select(F.col("ord").alias("vec_id"), "degree", "component")


@query(ORACLES["prototypes"])
def prototypes_rounds(spark, folder):
    faces = vector_queries._vectors(spark, folder).select("label", F.col("vec_id").alias("ord"), "embedding")
    return enroll.prototypes(faces, ["label"], 8, group_rows=1).select("label", F.col("ord").alias("vec_id"))


@query(ORACLES["gallery_replay"])
def gallery_replay_ranges(spark, folder):
    replayed = gallery.replay(state_queries._log(spark, folder), range_rows=_RANGE_ROWS)
    return replayed.select("seq", "op", "effective", "revision", "epoch")


@query(ORACLES["degraded_streaks"])
def degraded_streaks_ranges(spark, folder):
    e = state_queries._events(spark, folder)
    marked = temporal.degraded(
        e, ["video_id"], ["ms", "seq"], F.col("event_type") == "error", range_rows=_RANGE_ROWS
    )
    return marked.select("video_id", "seq", "fail_streak", "degraded")


@query(ORACLES["resource_latch"])
def resource_latch_ranges(spark, folder):
    latched = temporal.resource_latch(
        state_queries._resources(spark, folder), ["video_id"], ["ms", "seq"], "resource", "outcome",
        range_rows=_RANGE_ROWS,
    )
    return latched.select("video_id", "seq", "resource_epoch", "unreadable")


_FAULTY = """
    f AS (
      SELECT vec_id, label, CASE vec_id % 11
        WHEN 1 THEN embedding[1:63] WHEN 2 THEN NULL
        WHEN 3 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 5 THEN 'nan'::FLOAT ELSE x END)
        WHEN 4 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 5 THEN 'inf'::FLOAT ELSE x END)
        WHEN 5 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS v,
        CASE vec_id % 11 WHEN 1 THEN 'width' WHEN 2 THEN 'missing' WHEN 3 THEN 'not-finite' WHEN 4 THEN 'not-finite'
          WHEN 5 THEN 'zero' END AS fault
      FROM embeddings
    )"""


@query(
    f"""
    WITH {_FAULTY},
    q AS (SELECT vec_id, {sql.unit('v')}::DOUBLE[] AS u FROM f WHERE fault IS NULL),
    s AS (SELECT q.vec_id, g.label, max(list_dot_product(q.u, g.embedding::DOUBLE[])) AS s
          FROM q, embeddings g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM s WHERE s >= 0.3)
    SELECT f.vec_id, fault, 'label-' || r.label AS identity_id
    FROM f LEFT JOIN r ON r.vec_id = f.vec_id AND rn = 1"""
)
def match_with_rejects(spark, folder):
    """Vectors of a wrong width, null, NaN, infinite or zero are set aside, not compared."""
    e, case = F.col("embedding"), F.col("vec_id") % 11
    spoilt = lambda value: F.transform(e, lambda x, i: F.when(i == 4, F.lit(value).cast("float")).otherwise(x))
    rows = vector_queries._vectors(spark, folder)
    asked = rows.select(
        F.col("vec_id").alias("query_id"),
        F.when(case == 1, F.slice(e, 1, 63)).when(case == 2, F.lit(None)).when(case == 3, spoilt(float("nan")))
        .when(case == 4, spoilt(float("inf"))).when(case == 5, F.transform(e, lambda x: F.lit(0).cast("float")))
        .otherwise(e).alias("embedding"),
    )
    usable, rejected = matching.reject_vectors(asked, vector_queries.WIDTH)
    scored = matching.score_queries(
        usable, vector_queries._label_gallery(rows, "embedding"), default_threshold=0.3, min_agreements=1, want_best=False
    )
    both = scored.select("query_id", F.lit(None).cast("string").alias("fault"), "identity_id").unionByName(
        rejected.withColumn("identity_id", F.lit(None).cast("string"))
    )
    return both.withColumnRenamed("query_id", "vec_id")


@query(state_queries.coarse(ORACLES["coasted_tracks"]))
def coasted_tracks_tied(spark, folder):
    """Times in whole days: many rounds and frames of a video share one."""
    return state_queries.coasted(spark, folder, state_queries.DAY)


@query(state_queries.coarse(ORACLES["coast_positions"]))
def coast_positions_tied(spark, folder):
    return state_queries.positions(spark, folder, state_queries.DAY)


_BOXES = """
    b AS (
      SELECT l_orderkey AS media_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
             l_partkey % 97 + 0.0::DOUBLE AS x, l_suppkey % 89 + 0.0::DOUBLE AS y,
             CASE WHEN (l_partkey + l_linenumber) % 7 = 0 THEN -5.0::DOUBLE ELSE 30.0::DOUBLE END AS w,
             30.0::DOUBLE AS h, (l_partkey * 31 + l_suppkey) % 5 = 0 AS broken
      FROM lineitem
    )"""


@query(
    f"""
    WITH RECURSIVE {_BOXES},
    o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY line, part, supplier) AS i FROM b),
    r AS (
      SELECT media_id, 0::BIGINT AS i, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS kept,
             NULL::INTEGER AS line, NULL::BIGINT AS part, NULL::BIGINT AS supplier, true AS dropped
      FROM (SELECT DISTINCT media_id FROM o)
      UNION ALL
      SELECT media_id, i, CASE WHEN hit OR broken THEN kept ELSE list_append(kept, {{'x': x, 'y': y, 'w': w, 'h': h}}) END,
             line, part, supplier, hit AND NOT broken
      FROM (
        SELECT o.*, r.kept, len(list_filter(r.kept, lambda k:
            least(k.x + k.w, o.x + o.w) > greatest(k.x, o.x) AND least(k.y + k.h, o.y + o.h) > greatest(k.y, o.y)
            AND (least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * (least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y))
                > 0.3::DOUBLE * (k.w * k.h + o.w * o.h
                  - (least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * (least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y))))) > 0 AS hit
        FROM r JOIN o ON o.media_id = r.media_id AND o.i = r.i + 1
      )
    )
    SELECT media_id, line, part, supplier FROM r WHERE NOT dropped"""
)
def nms_broken_boxes(spark, folder):
    """Boxes with a NaN corner neither block nor are blocked; sides may be negative."""
    return _broken_boxes(spark, folder)


@query(ORACLES["nms_broken_boxes"])
def nms_broken_boxes_rounds(spark, folder):
    return _broken_boxes(spark, folder, **_ROUNDS)


@query(ORACLES["nms_broken_boxes"])
def nms_broken_boxes_grouped(spark, folder):
    return _broken_boxes(spark, folder, **_GROUPED)


def _broken_boxes(spark, folder, **sizes):
    from maskwright.lineage import table

    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        boxes.box(
            F.when(F.expr("(l_partkey * 31 + l_suppkey) % 5 = 0"), F.lit(float("nan"))).otherwise(F.col("l_partkey") % 97),
            F.col("l_suppkey") % 89,
            F.when(F.expr("(l_partkey + l_linenumber) % 7 = 0"), -5.0).otherwise(30.0),
            F.lit(30.0),
        ).alias("box"),
        F.lit(0.5).alias("score"),
    )
    kept = detections.suppress(rows, ["media_id"], ["line", "part", "supplier"], 0.3, **sizes)
    return kept.select("media_id", "line", "part", "supplier")
