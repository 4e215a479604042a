"""Vectors, matching and enrolment over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import boxes, vectors
from maskwright.lineage import cut, table
from maskwright.operators import enroll, matching, reports
from maskwright.plans import sql
from maskwright.plans.registry import query
from maskwright.plans.rounding import r6

WIDTH = 64


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select(F.col("vec_id").alias("query_id"), "embedding")


def _label_gallery(rows: DataFrame, kind: str, label: Column | None = None) -> DataFrame:
    owner = F.col("label") if label is None else label
    return rows.select(
        F.concat(F.lit("label-"), owner.cast("string")).alias("identity_id"),
        owner.cast("bigint").alias("identity_ord"),
        F.lit(kind).alias("kind"),
        F.col("vec_id").alias("ord"),
        "embedding",
    )


def _prototype_rows(spark: SparkSession, folder: str, k: int = 8) -> DataFrame:
    rows = _vectors(spark, folder)
    faces = rows.select("label", F.col("vec_id").alias("ord"), "embedding")
    chosen = enroll.prototypes(faces, ["label"], k).select("label", F.col("ord").alias("vec_id"))
    return cut(rows.join(chosen, ["label", "vec_id"], "left_semi"))


_PROTOTYPES = sql.farthest_points("embeddings", "label", 8)
_SCALED = "list_transform(embedding, lambda x: (x::DOUBLE * label)::FLOAT)"


@query(
    f"""
    WITH s AS (SELECT vec_id, embedding AS a, {_SCALED} AS b FROM embeddings),
    n AS (SELECT vec_id, a, b, {sql.norm('a')} AS na, {sql.norm('b')} AS nb FROM s)
    SELECT vec_id, {sql.r6('na')} AS norm, {sql.r6('nb')} AS scaled_norm,
           CASE WHEN len(a) <> {WIDTH} THEN 'width' WHEN na = 0 THEN 'zero'
                WHEN abs(na - 1) > 0.001 THEN 'not-unit' ELSE 'ok' END AS fault,
           CASE WHEN len(b) <> {WIDTH} THEN 'width' WHEN nb = 0 THEN 'zero'
                WHEN abs(nb - 1) > 0.001 THEN 'not-unit' ELSE 'ok' END AS scaled_fault,
           {sql.r6("list_sum(" + sql.unit('b') + "::DOUBLE[])")} AS unit_sum
    FROM n"""
)
def vector_validity(spark, folder):
    scaled = F.transform(
        "embedding", lambda x: (x.cast("double") * F.col("label")).cast("float")
    )
    rows = _vectors(spark, folder).withColumn("scaled", scaled)
    fault = lambda c: F.coalesce(vectors.embedding_fault(F.col(c), WIDTH), F.lit("ok"))
    unit = vectors.l2_normalize(F.col("scaled"))
    return rows.select(
        "vec_id",
        r6(vectors.l2_norm(F.col("embedding"))).alias("norm"),
        r6(vectors.l2_norm(F.col("scaled"))).alias("scaled_norm"),
        fault("embedding").alias("fault"),
        fault("scaled").alias("scaled_fault"),
        r6(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("unit_sum"),
    )


@query(
    f"""
    WITH d AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings)
    SELECT vec_id, {sql.r6(sql.dot('a', 'b'))} AS dot_product,
           {sql.r6(sql.dot(sql.unit('a'), sql.unit('b')))} AS cosine,
           {sql.r6('1 - ' + sql.dot(sql.unit('a'), sql.unit('b')))} AS distance,
           {sql.dot(sql.unit('a'), sql.unit('b'))} >= 0.1 AS accepted
    FROM d"""
)
def vector_similarity(spark, folder):
    rows = _vectors(spark, folder).withColumn("other", F.reverse("embedding"))
    a, b = F.col("embedding"), F.col("other")
    return rows.select(
        "vec_id",
        r6(vectors.dot(a, b)).alias("dot_product"),
        r6(vectors.cosine(a, b)).alias("cosine"),
        r6(vectors.cosine_distance(a, b)).alias("distance"),
        matching.should_redact(vectors.cosine(a, b), 0.1).alias("accepted"),
    )


@query(f"WITH RECURSIVE {_PROTOTYPES} SELECT label, vec_id FROM picked")
def prototypes(spark, folder):
    faces = _vectors(spark, folder).select("label", F.col("vec_id").alias("ord"), "embedding")
    return enroll.prototypes(faces, ["label"], 8).select("label", F.col("ord").alias("vec_id"))


_MATCH_TAIL = f"""
    q AS (SELECT vec_id AS query_id, {sql.unit('embedding')}::DOUBLE[] AS u FROM embeddings),
    s AS (
      SELECT q.query_id, g.label, list_dot_product(q.u, g.embedding::DOUBLE[]) AS s
      FROM q, (SELECT e.label, e.embedding FROM embeddings e JOIN picked p
               ON e.label = p.label AND e.vec_id = p.vec_id) g
    )"""


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL},
    best AS (SELECT query_id, label, max(s) AS score FROM s GROUP BY ALL HAVING max(s) >= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM best)
    SELECT query_id AS vec_id, 'label-' || label AS identity_id, {sql.r6('score')} AS score
    FROM r WHERE rn = 1"""
)
def match_gallery(spark, folder):
    gallery = _label_gallery(_prototype_rows(spark, folder), "prototype")
    found = matching.match(
        _queries(spark, folder), gallery, default_threshold=0.30, min_agreements=1
    )
    return found.select(F.col("query_id").alias("vec_id"), "identity_id", r6(F.col("score")).alias("score"))


@query(
    f"""
    WITH q AS (SELECT vec_id AS query_id, {sql.unit('embedding')}::DOUBLE[] AS u FROM embeddings),
    t AS (SELECT label, CASE WHEN label % 3 = 0 THEN 0.25 ELSE 0.2 + label / 100.0::DOUBLE END AS thr,
                 least(3, count(*)) AS need FROM embeddings GROUP BY label),
    s AS (
      SELECT q.query_id, g.label, list_dot_product(q.u, g.embedding::DOUBLE[]) AS s
      FROM q, embeddings g
    ),
    best AS (
      SELECT query_id, s.label, max(s) AS score FROM s JOIN t USING (label)
      GROUP BY query_id, s.label, thr, need
      HAVING max(s) >= thr AND count(*) FILTER (WHERE s >= thr) >= need
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM best)
    SELECT query_id AS vec_id, 'label-' || label AS identity_id, {sql.r6('score')} AS score
    FROM r WHERE rn = 1"""
)
def match_agreements(spark, folder):
    rows = _vectors(spark, folder)
    gallery = _label_gallery(rows, "embedding")
    label = F.col("label")
    identities = rows.select("label").distinct().select(
        F.concat(F.lit("label-"), label.cast("string")).alias("identity_id"),
        F.when(label % 3 == 0, F.lit(float("nan"))).otherwise(0.2 + label / F.lit(100.0)).alias("threshold"),
    )
    found = matching.match(
        _queries(spark, folder), gallery, identities, default_threshold=0.25, min_agreements=3
    )
    return found.select(F.col("query_id").alias("vec_id"), "identity_id", r6(F.col("score")).alias("score"))


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL},
    m AS (SELECT query_id, label, max(s) AS score FROM s GROUP BY ALL),
    best AS (
      SELECT p.query_id, p.label, p.score FROM m p
      JOIN m n ON n.query_id = p.query_id AND n.label = (p.label + 1) % 10
      WHERE p.score >= 0.25 AND p.score - n.score >= 0.02
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM best)
    SELECT query_id AS vec_id, 'label-' || label AS identity_id, {sql.r6('score')} AS score
    FROM r WHERE rn = 1"""
)
def match_hard_negative(spark, folder):
    """Each label's hard negatives are the prototypes of the next label."""
    rows = _prototype_rows(spark, folder)
    negatives = _label_gallery(rows, "hard_negative", (F.col("label") + 9) % 10)
    gallery = _label_gallery(rows, "prototype").unionByName(negatives)
    found = matching.match(
        _queries(spark, folder), gallery, default_threshold=0.25, min_agreements=1, margin=0.02
    )
    return found.select(F.col("query_id").alias("vec_id"), "identity_id", r6(F.col("score")).alias("score"))


_MEDIA = "vec_id // 5 AS media_id, vec_id % 5 AS det_ord"
_REGION = {
    "x": "(vec_id * 37 % 600)", "y": "(vec_id * 53 % 440)",
    "w": "(20 + vec_id % 50)", "h": "(24 + vec_id % 60)",
}


def _detections(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    return _vectors(spark, folder).select(
        F.floor(v / 5).alias("media_id"),
        (v % 5).alias("det_ord"),
        v.alias("query_id"),
        boxes.box(v * 37 % 600, v * 53 % 440, 20 + v % 50, 24 + v % 60).alias("box"),
    )


def _media(spark: SparkSession, folder: str) -> DataFrame:
    return _detections(spark, folder).select("media_id").distinct().select(
        "media_id", F.lit(640.0).alias("width"), F.lit(480.0).alias("height")
    )


_WINNERS = f"""
    best AS (SELECT query_id, label, max(s) AS score FROM s GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM best)"""


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL}, {_WINNERS},
    raw AS (
      SELECT q.vec_id, e.label, max({sql.dot('q.embedding', 'e.embedding')}) AS c
      FROM embeddings q, embeddings e JOIN picked p ON e.label = p.label AND e.vec_id = p.vec_id
      GROUP BY ALL
    ),
    rt AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS rn FROM raw)
    SELECT query_id // 5 AS media_id, query_id % 5 AS det_ord,
           'label-' || rt.label AS best_identity_id, {sql.r6('c')} AS best_cosine,
           score >= 0.3 AS matched,
           CASE WHEN score >= 0.3 THEN 'label-' || top.label END AS matched_identity_id
    FROM top JOIN rt ON rt.vec_id = query_id WHERE top.rn = 1 AND rt.rn = 1"""
)
def best_cosine_report(spark, folder):
    gallery = _label_gallery(_prototype_rows(spark, folder), "prototype")
    scored = matching.score_queries(
        _queries(spark, folder), gallery, default_threshold=0.30, min_agreements=1
    )
    faces = reports.face_diagnostics(_detections(spark, folder), scored)
    return faces.withColumn("best_cosine", r6(F.col("best_cosine")))


def _analysis(spark: SparkSession, folder: str):
    gallery = _label_gallery(_prototype_rows(spark, folder), "prototype")
    found = matching.match(
        _queries(spark, folder), gallery, default_threshold=0.30, min_agreements=1
    )
    return matching.analyse_media(_media(spark, folder), _detections(spark, folder), found)


_GROWN = f"""
    d AS (SELECT vec_id, {_MEDIA}, {_REGION['x']}::DOUBLE AS x, {_REGION['y']}::DOUBLE AS y,
                 {_REGION['w']}::DOUBLE AS w, {_REGION['h']}::DOUBLE AS h FROM embeddings),
    e AS (SELECT *, greatest(0, least(x + w / 2 - w * 1.2::DOUBLE / 2, 640)) AS x0,
                 greatest(0, least(y + h / 2 - h * 1.25::DOUBLE / 2, 480)) AS y0,
                 greatest(0, least(x + w / 2 + w * 1.2::DOUBLE / 2, 640)) AS x1,
                 greatest(0, least(y + h / 2 + h * 1.25::DOUBLE / 2, 480)) AS y1 FROM d)"""


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL}, {_WINNERS}, {_GROWN}
    SELECT media_id, det_ord, {sql.r6('x0')} AS x, {sql.r6('y0')} AS y,
           {sql.r6('x1 - x0')} AS width, {sql.r6('y1 - y0')} AS height,
           {sql.r6('score')} AS confidence, 'label-' || label AS identity_id
    FROM e JOIN top ON query_id = vec_id WHERE rn = 1 AND score >= 0.3"""
)
def redaction_regions(spark, folder):
    regions, _ = _analysis(spark, folder)
    return regions.select(
        "media_id",
        "det_ord",
        *[r6(F.col(f"region.{c}")).alias(c) for c in ("x", "y", "width", "height")],
        r6(F.col("confidence")).alias("confidence"),
        "identity_id",
    )


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL}, {_WINNERS}
    SELECT query_id // 5 AS media_id, 640.0::DOUBLE AS width, 480.0::DOUBLE AS height,
           count(*) AS face_count, count(*) FILTER (WHERE score >= 0.3) AS region_count
    FROM top WHERE rn = 1 GROUP BY ALL"""
)
def media_results(spark, folder):
    return _analysis(spark, folder)[1]


@query(
    f"""
    WITH q AS (SELECT vec_id AS query_id, {sql.unit('embedding')}::DOUBLE[] AS u FROM embeddings),
    s AS (
      SELECT q.query_id, g.label, list_dot_product(q.u, g.embedding::DOUBLE[]) AS s
      FROM q, embeddings g
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC) AS rn FROM s)
    SELECT query_id AS vec_id, 'label-' || label AS identity_id, rn::INTEGER AS rank,
           {sql.r6('s')} AS cosine
    FROM r WHERE rn <= 3"""
)
def top_k_cosines(spark, folder):
    gallery = _label_gallery(_vectors(spark, folder), "embedding")
    top = matching.top_k_cosines(_queries(spark, folder), gallery, 3)
    return top.select(
        F.col("query_id").alias("vec_id"), "identity_id", "rank", r6(F.col("cosine")).alias("cosine")
    )


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL},
    r AS (SELECT query_id, label, s, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC) AS rn FROM s),
    w AS (SELECT DISTINCT query_id, label, unnest(range(1, 12)) AS rn FROM s)
    SELECT query_id AS vec_id, 'label-' || label AS identity_id, rn::INTEGER AS rank,
           coalesce({sql.r6('s')}, '-inf'::DOUBLE) AS cosine
    FROM w LEFT JOIN r USING (query_id, label, rn)"""
)
def top_k_padded(spark, folder):
    """Eleven places for the eight prototypes of each label."""
    gallery = _label_gallery(_prototype_rows(spark, folder), "prototype")
    top = matching.top_k_cosines(_queries(spark, folder), gallery, 11, pad=True)
    cosine = F.when(F.col("cosine") == float("-inf"), F.col("cosine")).otherwise(r6(F.col("cosine")))
    return top.select(F.col("query_id").alias("vec_id"), "identity_id", "rank", cosine.alias("cosine"))


def _one_group(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select(
        F.lit("all").alias("name"), F.col("vec_id").alias("ord"), "embedding"
    )


_UNITS = f"u AS (SELECT vec_id, label, {sql.unit('embedding')}::DOUBLE[] AS u FROM embeddings)"


@query(
    f"""
    WITH {_UNITS}
    SELECT a.vec_id AS ord_a, b.vec_id AS ord_b, {sql.r6('list_dot_product(a.u, b.u)')} AS cosine
    FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.35"""
)
def similarity_join(spark, folder):
    pairs = enroll.similar_pairs(_one_group(spark, folder), ["name"], 0.35, copies=True)
    return pairs.select("ord_a", "ord_b", r6(F.col("cosine")).alias("cosine"))


_LINKS = f"""
    {_UNITS},
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.u, b.u) >= 1 - 0.65::DOUBLE),
    reach AS (
      SELECT vec_id AS n, vec_id AS m FROM embeddings
      UNION
      SELECT e.b AS n, reach.m FROM reach JOIN e ON e.a = reach.n WHERE reach.m <= e.b
    ),
    comp AS (SELECT n AS vec_id, min(m) AS component FROM reach GROUP BY n),
    deg AS (SELECT a AS vec_id, count(*) AS degree FROM e GROUP BY a)"""


@query(
    f"""
    WITH RECURSIVE {_LINKS}
    SELECT vec_id, coalesce(degree, 0) AS degree, component
    FROM comp LEFT JOIN deg USING (vec_id)"""
)
def similarity_components(spark, folder):
    graph = enroll.similarity_graph(_one_group(spark, folder), ["name"], 1 - 0.65)
    return graph.select(F.col("ord").alias("vec_id"), "degree", "component")


def _cluster_sql(min_cluster: int) -> str:
    return f"""
    WITH RECURSIVE {_LINKS},
    g AS (SELECT vec_id, coalesce(degree, 0) AS degree, component FROM comp LEFT JOIN deg USING (vec_id)),
    big AS (SELECT component, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, component LIMIT 1),
    hub AS (SELECT component FROM g ORDER BY degree DESC, vec_id LIMIT 1),
    pick AS (SELECT CASE WHEN big.n < {min_cluster} THEN hub.component ELSE big.component END AS c,
                    CASE WHEN big.n < {min_cluster} THEN 'small-cluster' ELSE 'outlier' END AS why
             FROM big, hub)
    SELECT vec_id, component = c AS kept, CASE WHEN component <> c THEN why END AS reason
    FROM g, pick"""


@query(_cluster_sql(3))
def dominant_cluster(spark, folder):
    graph = enroll.similarity_graph(_one_group(spark, folder), ["name"], 1 - 0.65)
    kept = enroll.pick_cluster(graph, ["name"], 3)
    return kept.select(F.col("ord").alias("vec_id"), "kept", "reason")


@query(_cluster_sql(1_000_000))
def weak_cluster(spark, folder):
    """The low-confidence path: no component is large enough."""
    graph = enroll.similarity_graph(_one_group(spark, folder), ["name"], 1 - 0.65)
    kept = enroll.pick_cluster(graph, ["name"], 1_000_000)
    return kept.select(F.col("ord").alias("vec_id"), "kept", "reason")


@query(
    """
    WITH RECURSIVE v AS (
      SELECT label, vec_id, embedding::DOUBLE[] AS u,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings
    ),
    r AS (
      SELECT label, 0::BIGINT AS i, []::DOUBLE[][] AS kept, NULL::BIGINT AS vec_id, false AS dropped
      FROM embeddings GROUP BY label
      UNION ALL
      SELECT r.label, v.i,
             CASE WHEN len(list_filter(r.kept, lambda k: list_dot_product(k, v.u) >= 0.3)) > 0
                  THEN r.kept ELSE list_append(r.kept, v.u) END,
             v.vec_id,
             len(list_filter(r.kept, lambda k: list_dot_product(k, v.u) >= 0.3)) > 0
      FROM r JOIN v ON v.label = r.label AND v.i = r.i + 1
    )
    SELECT label, vec_id, dropped FROM r WHERE vec_id IS NOT NULL"""
)
def near_duplicate_drop(spark, folder):
    faces = _vectors(spark, folder).select("label", F.col("vec_id").alias("ord"), "embedding")
    unique, dropped = enroll.drop_near_duplicates(faces, ["label"], 0.3)
    mark = lambda d, v: d.select("label", F.col("ord").alias("vec_id"), F.lit(v).alias("dropped"))
    return mark(unique, False).unionByName(mark(dropped, True))


@query(
    f"""
    WITH RECURSIVE v AS (
      SELECT label, vec_id, embedding, embedding::DOUBLE[] AS u, {sql.unit('embedding')}::DOUBLE[] AS n,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings
    ),
    dd AS (
      SELECT label, 0::BIGINT AS i, []::DOUBLE[][] AS kept, NULL::BIGINT AS vec_id, false AS dropped
      FROM embeddings GROUP BY label
      UNION ALL
      SELECT r.label, v.i,
             CASE WHEN len(list_filter(r.kept, lambda k: list_dot_product(k, v.u) >= 0.4)) > 0
                  THEN r.kept ELSE list_append(r.kept, v.u) END,
             v.vec_id, len(list_filter(r.kept, lambda k: list_dot_product(k, v.u) >= 0.4)) > 0
      FROM dd r JOIN v ON v.label = r.label AND v.i = r.i + 1
    ),
    un AS (SELECT v.* FROM v JOIN dd ON dd.vec_id = v.vec_id WHERE NOT dropped),
    ed AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM un a JOIN un b ON a.label = b.label AND a.vec_id <> b.vec_id
           WHERE list_dot_product(a.n, b.n) >= 1 - 0.7::DOUBLE),
    reach AS (
      SELECT vec_id AS x, vec_id AS m FROM un
      UNION
      SELECT ed.b, reach.m FROM reach JOIN ed ON ed.a = reach.x WHERE reach.m <= ed.b
    ),
    gr AS (SELECT label, vec_id, (SELECT count(*) FROM ed WHERE ed.a = un.vec_id) AS degree,
                  (SELECT min(m) FROM reach WHERE reach.x = un.vec_id) AS comp FROM un),
    sz AS (SELECT label, comp, count(*) AS members FROM gr GROUP BY ALL),
    big AS (SELECT label, arg_max(comp, (members, -comp)) AS comp, max(members) AS members FROM sz GROUP BY label),
    hub AS (SELECT label, arg_max(comp, (degree, -vec_id)) AS comp FROM gr GROUP BY label),
    pick AS (SELECT label, CASE WHEN members < 3 THEN hub.comp ELSE big.comp END AS comp,
                    CASE WHEN members < 3 THEN 'small-cluster' ELSE 'outlier' END AS why FROM big JOIN hub USING (label)),
    kp AS (SELECT gr.label, gr.vec_id, embedding FROM gr JOIN pick ON pick.label = gr.label AND pick.comp = gr.comp
           JOIN embeddings e ON e.vec_id = gr.vec_id),
    {sql.farthest_points('kp', 'label', 8)},
    rows_ AS (
      SELECT label, 'duplicate' AS reason FROM dd WHERE dropped
      UNION ALL SELECT gr.label, why FROM gr JOIN pick ON pick.label = gr.label AND pick.comp <> gr.comp
      UNION ALL SELECT label, 'kept' FROM picked
      UNION ALL SELECT label, 'too-few' FROM picked GROUP BY label HAVING count(*) < 3
    )
    SELECT 'label-' || label AS name, reason, count(*) AS n FROM rows_ GROUP BY ALL"""
)
def enrolment_preview(spark, folder):
    """All labels at once: dedup, cluster, prototypes and every rejection, counted by reason."""
    rows = _vectors(spark, folder).select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("name"),
        F.col("vec_id").alias("ord"),
        "embedding",
    )
    path = F.concat(F.lit("https://media.example/"), F.col("ord").cast("string"))
    candidates = rows.select(
        "name", "ord", path.alias("url"), path.alias("thumb_url"), path.alias("filename"),
        F.lit("commons").alias("source"), F.lit(1.0).alias("score"),
    )
    kept, rejected, counted = enroll.build_preview(
        candidates, rows, duplicate=0.4, radius=0.7, max_prototypes=8
    )
    reasons = reports.count_reasons(rejected.withColumn(
        "reason", F.when(F.col("reason").startswith("too-few"), "too-few").otherwise(F.col("reason"))
    ), ["name", "reason"])
    kept_count = kept.groupBy("name").agg(F.count("*").alias("n"))
    return reasons.unionByName(kept_count.select("name", F.lit("kept").alias("reason"), "n"))


_HEALTH = f"""
    hs AS (SELECT label, vec_id,
        CASE WHEN label = 0 THEN {_SCALED} WHEN vec_id % 10 < label THEN embedding
             ELSE list_transform(embedding, lambda x: (x::DOUBLE * 1.5::DOUBLE)::FLOAT) END AS v
      FROM embeddings),
    hf AS (SELECT label, abs({sql.norm('v')} - 1) <= 0.001 AS ok FROM hs),
    hc AS (SELECT label, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS rejected
          FROM hf GROUP BY label),
    health AS (SELECT 'label-' || label AS identity_id, kept, rejected,
           CASE WHEN kept = 0 THEN 'dropped' WHEN rejected > 0 THEN 'degraded' ELSE 'ok' END AS status
    FROM hc)"""


@query(f"WITH {_HEALTH} SELECT * FROM health")
def gallery_health(spark, folder):
    """Some vectors are stretched first, so that identities lose some or all of them."""
    rows = _vectors(spark, folder)
    scale = lambda by: F.transform("embedding", lambda x: (x.cast("double") * by).cast("float"))
    damaged = F.when(F.col("label") == 0, scale(F.col("label"))).when(
        F.col("vec_id") % 10 < F.col("label"), F.col("embedding")
    ).otherwise(scale(F.lit(1.5)))
    gallery = _label_gallery(rows.withColumn("embedding", damaged), "embedding")
    return matching.sanitize_gallery(gallery, WIDTH)[1]


@query(
    f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL}, {_WINNERS}, {_HEALTH},
    raw AS (
      SELECT q.vec_id, max({sql.dot('q.embedding', 'e.embedding')}) AS c
      FROM embeddings q, embeddings e JOIN picked p ON e.label = p.label AND e.vec_id = p.vec_id
      GROUP BY ALL
    )
    SELECT query_id // 5 AS media_id, count(*) AS face_count, count(*) FILTER (WHERE score >= 0.3) AS matched_count,
           {sql.r6('max(c)')} AS best_cosine, 0.3::DOUBLE AS threshold, 1::BIGINT AS min_agreements,
           (SELECT count(*) FROM health WHERE status = 'dropped') AS dropped_identities,
           (SELECT count(*) FROM health WHERE status = 'degraded') AS degraded_identities
    FROM top JOIN raw ON vec_id = query_id WHERE rn = 1 GROUP BY 1"""
)
def media_diagnostics(spark, folder):
    gallery = _label_gallery(_prototype_rows(spark, folder), "prototype")
    scored = matching.score_queries(
        _queries(spark, folder), gallery, default_threshold=0.30, min_agreements=1
    )
    faces = reports.face_diagnostics(_detections(spark, folder), scored)
    report = reports.media_diagnostics(faces, gallery_health(spark, folder), 0.3, 1)
    return report.withColumn("best_cosine", r6(F.col("best_cosine")))


@query(
    """
    SELECT 'label-' || label AS identity_id, 'samples/' || vec_id || '.jpg' AS url, 'kept' AS outcome,
           vec_id || '.jpg' AS filename, 1.0::DOUBLE AS score FROM embeddings WHERE label >= 3
    UNION ALL
    SELECT 'label-' || label, 'samples/' || vec_id || '.jpg', '2 faces', NULL, NULL FROM embeddings WHERE label < 3"""
)
def curated_preview(spark, folder):
    """Every vector is a directory reference; labels under 3 show two faces per photo."""
    rows = _vectors(spark, folder)
    owner = F.concat(F.lit("label-"), F.col("label").cast("string")).alias("identity_id")
    references = rows.select(
        owner,
        F.col("label").cast("string").alias("name"),
        F.col("vec_id").alias("ord"),
        F.concat(F.lit("samples/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.lit(None).cast("string").alias("source"),
    )
    found = rows.select(owner, F.col("vec_id").alias("ord"), "embedding", "label")
    found = found.unionByName(found.where("label < 3")).drop("label")
    kept, rejected = enroll.curated_preview(references, found)
    return kept.select(
        "identity_id", "url", F.lit("kept").alias("outcome"), "filename", "score"
    ).unionByName(
        rejected.select(
            "identity_id", "url", F.col("reason").alias("outcome"),
            F.lit(None).cast("string").alias("filename"), F.lit(None).cast("double").alias("score"),
        )
    )


@query(
    f"""
    SELECT 'name-' || label AS identity_id, 'Name ' || label AS name, 0.4::DOUBLE AS threshold,
           1000::BIGINT AS created_at, count(*) AS "references"
    FROM embeddings WHERE abs({sql.norm('embedding')} - 1) <= 0.001 GROUP BY label"""
)
def confirm_identities(spark, folder):
    faces = _vectors(spark, folder).select(
        F.concat(F.lit("  Name "), F.col("label").cast("string")).alias("name"),
        F.col("vec_id").alias("ord"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("source"),
        F.lit(float("nan")).alias("score"),
        "embedding",
    )
    return enroll.confirm(enroll.sanitize_preview(faces, WIDTH), now_ms=1000)[0]


_SCORES = f"""
    WITH RECURSIVE {_PROTOTYPES}, {_MATCH_TAIL},
    b AS (SELECT query_id, label, max(s) AS score FROM s GROUP BY ALL),
    sc AS (SELECT b.score, b.label = e.label AS genuine FROM b JOIN embeddings e ON e.vec_id = b.query_id)"""


def _comparison_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Best score of every vector against every label's prototypes."""
    rows = _prototype_rows(spark, folder)
    top = matching.top_k_cosines(
        _queries(spark, folder), _label_gallery(rows, "prototype"), 1
    )
    owners = _vectors(spark, folder).select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("owner"),
    )
    return top.join(owners, "query_id").select(
        F.col("cosine").alias("score"), (F.col("owner") == F.col("identity_id")).alias("genuine")
    )


@query(
    f"""{_SCORES},
    t AS (SELECT round(-0.2 + 0.05 * i, 9)::DOUBLE AS threshold FROM range(0, 25) r(i))
    SELECT threshold, count(*) FILTER (WHERE score >= threshold AND genuine) AS genuine_accepted,
           count(*) FILTER (WHERE score >= threshold AND NOT genuine) AS impostor_accepted
    FROM t, sc GROUP BY threshold"""
)
def threshold_sweep(spark, folder):
    return reports.threshold_sweep(
        _comparison_scores(spark, folder), F.col("genuine"), -0.2, 1.0, 0.05
    )


@query(
    f"""{_SCORES},
    r AS (SELECT genuine, score, row_number() OVER (PARTITION BY genuine ORDER BY score) AS i, count(*) OVER (PARTITION BY genuine) AS n FROM sc)
    SELECT genuine, count(*) AS n, {sql.r6('min(score)')} AS low, {sql.r6('max(score)')} AS high,
           {sql.r6('max(score) FILTER (WHERE i = (5 * n + 99) // 100)')} AS p05,
           {sql.r6('max(score) FILTER (WHERE i = (50 * n + 99) // 100)')} AS median,
           {sql.r6('max(score) FILTER (WHERE i = (95 * n + 99) // 100)')} AS p95
    FROM r GROUP BY genuine"""
)
def similarity_ranges(spark, folder):
    ranges = reports.similarity_ranges(_comparison_scores(spark, folder), ["genuine"])
    return ranges.select("genuine", "n", *(r6(F.col(c)).alias(c) for c in ("low", "p05", "median", "p95", "high")))
