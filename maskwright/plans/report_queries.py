"""Evaluation, rejection and manifest reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import images
from maskwright.lineage import table
from maskwright.operators import enroll, manifest, reports
from maskwright.plans.registry import query
from maskwright.sources import media


@query(
    """
    WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CASE WHEN n = 1 THEN 'kept' ELSE n || ' faces' END AS reason, count(*) AS n FROM c GROUP BY 1"""
)
def reject_report(spark, folder):
    """An order is an image, its lines the faces found in it."""
    faces = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("embedding"))
    kept, rejected = enroll.single_face_only(faces, ["l_orderkey"])
    both = rejected.unionByName(kept.select("l_orderkey", F.lit("kept").alias("reason")))
    return reports.count_reasons(both, ["reason"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    content = F.encode("text", "utf-8")
    return table(spark, folder, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        content.alias("content"),
    )


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger of the documents with some entries wrong, missing or extra."""
    d = table(spark, folder, "documents")
    label = table(spark, folder, "labels")
    ok = d.join(label, "doc_id", "left").select(
        F.concat(
            F.lit("docs/"), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, "x").otherwise("")
        ).alias("path"),
        (F.octet_length("text") + F.when(F.col("quality") == 0, 1).otherwise(0)).cast("bigint").alias("bytes"),
        F.when(F.col("lang") == "de", F.lit(None))
        .when(F.col("lang") == "es", F.sha2(F.upper("text"), 256))
        .otherwise(F.sha2("text", 256))
        .alias("sha256"),
        (F.col("source") != "src1").alias("shipped"),
    )
    return ok


_FILES = """
    f AS (SELECT 'docs/' || doc_id AS path, octet_length(encode(text)) AS n, sha256(text) AS h FROM documents),
    l AS (SELECT 'docs/' || d.doc_id || CASE WHEN toxic = 1 THEN 'x' ELSE '' END AS path,
                 octet_length(encode(text)) + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS bytes,
                 CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN sha256(upper(text)) ELSE sha256(text) END AS sha,
                 source <> 'src1' AS shipped
          FROM documents d LEFT JOIN labels USING (doc_id))"""


@query(
    f"""
    WITH {_FILES}, j AS (SELECT l.*, f.n, f.h FROM l LEFT JOIN f USING (path))
    SELECT path, 'missing-file' AS issue FROM j WHERE n IS NULL AND shipped
    UNION ALL SELECT path, 'byte-count' FROM j WHERE n <> bytes
    UNION ALL SELECT path, 'sha256' FROM j WHERE h <> sha
    UNION ALL SELECT path, 'no-sha256' FROM j WHERE n IS NOT NULL AND sha IS NULL
    UNION ALL SELECT path, 'not-in-ledger' FROM f WHERE path NOT IN (SELECT path FROM l)"""
)
def manifest_check(spark, folder):
    files = _files(spark, folder)
    hashed = manifest.hash_files(files)
    return manifest.reconcile(hashed, _ledger(spark, folder), required=files.select("path"))


_RAW_PATH = """
    CASE p_partkey % 5 WHEN 0 THEN './' || p_type || '/' || p_brand WHEN 1 THEN p_type || chr(92) || p_brand
      WHEN 2 THEN p_type || '/' || p_brand || '/' WHEN 3 THEN p_type || '/' || p_brand || '.map' ELSE p_name END"""


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    join = lambda *c: F.concat(*[F.lit(x) if x in ("./", "/", "\\", ".map") else F.col(x) for x in c])
    kind = F.col("p_partkey") % 5
    return table(spark, folder, "part").select(
        F.when(kind == 0, join("./", "p_type", "/", "p_brand"))
        .when(kind == 1, join("p_type", "\\", "p_brand"))
        .when(kind == 2, join("p_type", "/", "p_brand", "/"))
        .when(kind == 3, join("p_type", "/", "p_brand", ".map"))
        .otherwise(F.col("p_name"))
        .alias("path")
    )


_NORMAL = "regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^\\./', ''), '/$', '')"
_ALLOWED = "SELECT DISTINCT p_type || '/' || p_brand AS path FROM part WHERE p_size <= 20"
_NEVER = "SELECT DISTINCT p_type || '/' || p_brand AS path FROM part WHERE p_size = 3"


def _rules(spark: SparkSession, folder: str, condition: str) -> DataFrame:
    return table(spark, folder, "part").where(condition).select(
        F.concat("p_type", F.lit("/"), "p_brand").alias("path")
    ).distinct()


@query(
    f"""
    WITH p AS (SELECT {_RAW_PATH} AS path FROM part), n AS (SELECT path, {_NORMAL} AS normal FROM p)
    SELECT path, normal, CASE WHEN normal IN ({_ALLOWED}) AND normal NOT IN ({_NEVER})
        AND normal <> '' AND NOT ends_with(normal, '.map') AND NOT ends_with(normal, '.DS_Store')
        THEN 'allowed' ELSE 'forbidden' END AS verdict, count(*) AS n
    FROM n GROUP BY ALL"""
)
def path_rules(spark, folder):
    judged = manifest.classify_paths(
        _paths(spark, folder), _rules(spark, folder, "p_size <= 20"), never=_rules(spark, folder, "p_size = 3")
    )
    return reports.count_reasons(judged, ["path", "normal", "verdict"])


@query(
    f"""
    WITH p AS (SELECT {_RAW_PATH} AS path FROM part),
    f AS (SELECT DISTINCT {_NORMAL} AS path FROM p WHERE NOT ends_with(path, '/'))
    SELECT path, 'unapproved' AS issue FROM f WHERE NOT (path IN ({_ALLOWED}) AND path NOT IN ({_NEVER})
        AND NOT ends_with(path, '.map') AND NOT ends_with(path, '.DS_Store'))
    UNION ALL SELECT path, 'missing' FROM ({_ALLOWED}) WHERE path NOT IN (SELECT path FROM f)
    UNION ALL SELECT path, 'excluded-present' FROM ({_NEVER}) WHERE path IN (SELECT path FROM f)"""
)
def listing_check(spark, folder):
    allowed = _rules(spark, folder, "p_size <= 20")
    return manifest.check_listing(
        _paths(spark, folder), allowed, allowed, _rules(spark, folder, "p_size = 3")
    )


@query(
    """
    WITH r AS (SELECT s_suppkey AS id, unnest(['docs/' || s_suppkey * 20, 'https://x.example/' || s_suppkey]) AS path FROM supplier)
    SELECT id, path FROM r WHERE NOT starts_with(path, 'https://')
      AND path NOT IN (SELECT 'docs/' || doc_id FROM documents)"""
)
def dangling_references(spark, folder):
    key = F.col("s_suppkey")
    ref = lambda p: F.struct(p.alias("path"), F.lit("s").alias("source"))
    people = table(spark, folder, "supplier").select(
        key.alias("id"),
        F.array(
            ref(F.concat(F.lit("docs/"), (key * 20).cast("string"))),
            ref(F.concat(F.lit("https://x.example/"), key.cast("string"))),
        ).alias("references"),
    )
    return manifest.dangling_references(people, _files(spark, folder).select("path")).select("id", "path")


@query(
    """
    WITH e AS (SELECT doc_id, sha256(text) AS h, source || '/' || lang AS u FROM documents),
    s AS (SELECT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    v AS (SELECT source || '/' || lang AS u FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT doc_id, CASE WHEN h IN (SELECT h FROM s) OR u IN (SELECT u FROM v) THEN 'self-match' ELSE 'held-out' END AS evidence
    FROM e"""
)
def evidence_class(spark, folder):
    """Documents are evaluation media; labelled ones were used for enrolment."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.concat("source", F.lit("/"), "lang").alias("url")
    )
    labelled = docs.join(table(spark, folder, "labels"), "doc_id")
    sources = labelled.select(
        F.when(F.col("quality") == 1, F.col("sha256")).alias("sha256"),
        F.when(F.col("toxic") == 1, F.col("url")).alias("url"),
    )
    return reports.evidence_class(docs, sources, ["sha256", "url"]).select("doc_id", "evidence")


@query(
    """
    WITH m AS (SELECT o_orderkey AS media_id, CASE WHEN o_orderstatus = 'F' THEN 'positive' ELSE 'control' END AS expected,
                 count(l_orderkey) AS faces, count(*) FILTER (WHERE l_discount >= 0.09) AS matched
               FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT expected, CASE WHEN faces = 0 THEN 'untested' WHEN (matched > 0) = (expected = 'positive') THEN 'pass' ELSE 'fail' END AS verdict,
           count(*) AS n FROM m GROUP BY ALL"""
)
def control_checks(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(
        F.count("*").alias("face_count"), F.count_if(F.col("l_discount") >= 0.09).alias("matched_count")
    )
    measured = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        F.when(F.col("o_orderstatus") == "F", "positive").otherwise("control").alias("expected"),
    ).join(lines, "media_id", "left").na.fill(0, ["face_count", "matched_count"])
    return reports.count_reasons(reports.check_media(measured), ["expected", "verdict"])


@query(
    """
    SELECT l_returnflag AS config, count(*) AS faces, count(*) FILTER (WHERE l_discount >= 0.05) AS matched
    FROM lineitem GROUP BY ALL"""
)
def detection_counts(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("config"), "l_discount")
    return lines.groupBy("config").agg(
        F.count("*").alias("faces"), F.count_if(F.col("l_discount") >= 0.05).alias("matched")
    )


@query(
    """
    WITH f AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'image/svg+xml; charset=utf-8' WHEN lang = 'fr' THEN 'text/html'
                 WHEN lang = 'es' THEN '' ELSE 'image/PNG' END AS t, octet_length(encode(text)) * 100 AS n,
                 n_chars AS w FROM documents)
    SELECT doc_id, CASE WHEN t LIKE 'image/svg%' THEN 'svg-refused' WHEN t = 'text/html' THEN 'unsupported-type'
        WHEN n = 0 THEN 'empty' WHEN n > 12582912 THEN 'too-large' WHEN w * 2000 = 0 THEN 'empty-image'
        WHEN w * 2000 > 12000000 THEN 'too-many-pixels' ELSE 'ok' END AS fault FROM f"""
)
def image_limits(spark, folder):
    lang = F.col("lang")
    kind = (
        F.when(lang == "de", "image/svg+xml; charset=utf-8").when(lang == "fr", "text/html")
        .when(lang == "es", "").otherwise("image/PNG")
    )
    fault = media.image_fault(F.octet_length("text") * 100, kind, F.col("n_chars"), F.lit(2000))
    return table(spark, folder, "documents").select(
        "doc_id", F.coalesce(fault, F.lit("ok")).alias("fault")
    )


_SHAPE = "doc_id % 7 AS k, n_chars * 7 % 16384 AS w, (doc_id * 37 + n_chars) % 9000 AS h"


@query(
    f"""
    WITH f AS (SELECT doc_id, {_SHAPE} FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' ELSE 'webp' END AS kind,
           w + (k > 4)::BIGINT AS width, h + (k > 4)::BIGINT AS height,
           CASE WHEN (w + (k > 4)::BIGINT) * (h + (k > 4)::BIGINT) = 0 THEN 'empty-image'
                WHEN (w + (k > 4)::BIGINT) * (h + (k > 4)::BIGINT) > 12000000 THEN 'too-many-pixels' ELSE 'ok' END AS fault
    FROM f"""
)
def image_headers(spark, folder):
    """A file header of each kind for every document, its size made of the document's; sizes
    that WebP stores less one come out one larger."""
    n = lambda c, size: F.lpad(F.hex(F.col(c)), 2 * size, "0")
    little = lambda c, size: F.concat(*[F.substring(n(c, size), 2 * k + 1, 2) for k in range(size - 1, -1, -1)])
    w, h = F.col("w"), F.col("h")
    packed = F.concat(*[F.lpad(F.hex(b), 2, "0") for b in (w % 256, F.floor(w / 256) + h % 4 * 64, F.floor(h / 4) % 256, F.floor(h / 1024))])
    # a JPEG with as many comments before its frame as the document's number gives it
    comment = F.expr("repeat(concat('FFFFFE', '0006', 'FFC00011'), cast(doc_id % 9 as int))")
    files = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), n("w", 4), n("h", 4), F.lit("0802000000")),
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), comment, F.lit("FFC2001108"), n("h", 2), n("w", 2), F.lit("03011100")),
        F.concat(F.lit("474946383961"), little("w", 2), little("h", 2), F.lit("F70000")),
        F.concat(F.lit("424D00000000000000003600000028000000"), little("w", 4), little("h", 4), F.lit("01001800")),
        F.concat(F.lit("52494646000000005745425056503820000000000000009D012A"), little("w", 2), little("h", 2), F.lit("0000")),
        F.concat(F.lit("524946460000000057454250565038580A00000010000000"), little("w", 3), little("h", 3), F.lit("0000")),
        F.concat(F.lit("5249464600000000574542505650384C000000002F"), packed, F.lit("0000")),
    ]
    docs = table(spark, folder, "documents").selectExpr("doc_id", *_SHAPE.split(", "))
    held = docs.select("doc_id", F.unhex(F.element_at(F.array(*files), (F.col("k") + 1).cast("int"))).alias("content"))
    size = images.image_size("content")
    fault = media.image_fault(F.lit(1), F.lit("image/png"), F.col("size.width"), F.col("size.height"))
    return held.select("doc_id", size.alias("size")).select("doc_id", "size.*", F.coalesce(fault, F.lit("ok")).alias("fault"))


@query(
    """
    WITH f AS (SELECT doc_id, lang, base64(encode(text)) AS p, text FROM documents)
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'malformed' WHEN text = '' THEN 'empty' ELSE 'ok' END AS fault,
           CASE WHEN lang <> 'fr' AND text <> '' THEN sha256(text) END AS sha256 FROM f"""
)
def frame_payloads(spark, folder):
    payload = F.when(F.col("lang") == "fr", F.concat(F.lit("*"), F.base64(F.encode("text", "utf-8")))).otherwise(
        F.base64(F.encode("text", "utf-8"))
    )
    frames = table(spark, folder, "documents").select("doc_id", payload.alias("payload"))
    return media.decode_frames(frames).select(
        "doc_id", F.coalesce("fault", F.lit("ok")).alias("fault"), F.sha2("content", 256).alias("sha256")
    )
