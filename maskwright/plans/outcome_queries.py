"""Outputs that other queries only count or pass on, compared row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import boxes
from maskwright.lineage import table
from maskwright.operators import detections, matching, ranking
from maskwright.plans import box_queries, sql, text_queries, vector_queries
from maskwright.plans.registry import query
from maskwright.sources import responses


@query(
    "WITH RECURSIVE "
    + box_queries._RANKED.replace("ranked AS (", "ranked0 AS (")
    + """,
    swift AS (SELECT DISTINCT media_id FROM ranked0 WHERE score >= 0.05),
    base AS (SELECT * FROM ranked0 WHERE score >= 0.05 OR media_id NOT IN (SELECT media_id FROM swift)),
    crowd AS (SELECT media_id FROM base GROUP BY media_id HAVING count(*) >= 2),
    ranked AS (
      SELECT * REPLACE (1.0::DOUBLE AS score) FROM base
      UNION ALL
      SELECT * REPLACE (0.0::DOUBLE AS score, {'x': box.x + 7, 'y': box.y + 5, 'width': box.width,
                        'height': box.height}::STRUCT(x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE) AS box)
      FROM ranked0 WHERE media_id IN (SELECT media_id FROM crowd)
    ), """
    + box_queries._greedy_sql("score < 0.05", box_queries._SAME, fixed="o.score >= 0.05")
)
def detection_cascade(spark, folder):
    """Fast pass, full pass where that found nothing, shifted tiles merged into crowds."""
    rows = box_queries._detections(spark, folder)
    moved = boxes.box(F.col("box.x") + 7, F.col("box.y") + 5, F.col("box.width"), F.col("box.height"))
    media = rows.select("media_id").distinct()
    fast, full, tiled = rows.where("score >= 0.05"), rows, rows.withColumn("box", moved)
    return detections.cascade(media, fast, full, tiled, box_queries._TIES).select(*box_queries._KEPT)


@query(
    f"""
    WITH {vector_queries._HEALTH},
    lost AS (SELECT label FROM hc WHERE kept = 0)
    SELECT 'label-' || label AS identity_id, vec_id AS ord FROM hs
    WHERE abs({sql.norm('v')} - 1) <= 0.001 AND label NOT IN (SELECT label FROM lost)"""
)
def gallery_cleaned(spark, folder):
    """The rows that a damaged gallery keeps."""
    rows = vector_queries._vectors(spark, folder)
    scale = lambda by: F.transform("embedding", lambda x: (x.cast("double") * by).cast("float"))
    damaged = F.when(F.col("label") == 0, scale(F.col("label"))).when(
        F.col("vec_id") % 10 < F.col("label"), F.col("embedding")
    ).otherwise(scale(F.lit(1.5)))
    gallery = vector_queries._label_gallery(rows.withColumn("embedding", damaged), "embedding")
    return matching.sanitize_gallery(gallery, vector_queries.WIDTH)[0].select("identity_id", "ord")


@query(
    f"""
    WITH f AS (SELECT page_id, url, html, {text_queries._TITLE} AS plain FROM pages)
    SELECT 'page ' || page_id AS name, url, {sql.web_trim('plain')} AS filename,
           'page ' || page_id AS page_title, {text_queries._CAPTION} AS caption FROM f"""
)
def repository_by_title(spark, folder):
    """Records looked up by title carry the name as page title."""
    facts = text_queries._page_facts(spark, folder)
    value = lambda c: F.struct(F.col(c).alias("value"))
    described = F.struct(value("html").alias("ImageDescription"), value("plain").alias("Categories"))
    info = F.struct(F.col("url"), described.alias("extmetadata"))
    page = F.struct(F.col("title"), F.array(info).alias("imageinfo"))
    body = F.to_json(F.struct(F.struct(F.create_map(F.lit("-1"), page).alias("pages")).alias("query")))
    found = responses.repository_candidates(facts.select("name", body.alias("body")), page_title=None)
    return found.select("name", "url", "filename", "page_title", "caption")


@query(
    """
    WITH p AS (SELECT 'page ' || page_id AS name, page_id, url FROM pages)
    SELECT name, url, 0 AS source_ord FROM p WHERE page_id % 2 = 0
    UNION ALL SELECT name, url, 1 FROM p WHERE page_id % 3 = 0
    UNION ALL SELECT name, url, 2 FROM p WHERE page_id % 5 = 0
    UNION ALL SELECT name, url, 3 FROM p WHERE page_id % 7 = 0
    UNION ALL SELECT a.name, b.url, 4 FROM p a JOIN p b ON a.page_id // 4 = b.page_id // 4"""
)
def source_union(spark, folder):
    """All five sources with rows of their own, in their fixed order."""
    facts = text_queries._page_facts(spark, folder)
    label = F.floor(F.col("page_id") / 4).cast("string")
    expanded = ranking.expand_categories(
        facts.select("name", label.alias("category")), facts.select(label.alias("category"), "url")
    )
    some = [facts.where(F.col("page_id") % k == 0).select("name", "url") for k in (2, 3, 5, 7)]
    return ranking.union_sources(*some, expanded).select("name", "url", "source_ord")


_SPLIT = """
    s AS (SELECT quality AS class, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high
          FROM documents JOIN labels USING (doc_id) GROUP BY quality)"""


@query(
    f"""
    WITH {_SPLIT},
    v AS (SELECT quality AS class, list_sort(list(n_chars)) AS sorted
          FROM documents JOIN labels USING (doc_id) GROUP BY quality)
    SELECT s.class, s.n, s.low, s.high, sorted[(n + 1) // 2] AS lower_median,
           (SELECT min(high) < max(low) FROM s) AS separable
    FROM s JOIN v USING (class)"""
)
def class_separation(spark, folder):
    """Range and lower median of a value per class, and whether a threshold separates them."""
    from maskwright.operators import reports

    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("class"))
    rows = table(spark, folder, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    return reports.class_ranges(rows, "class", "n_chars")
