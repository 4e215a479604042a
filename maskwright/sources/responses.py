"""Landed JSON answers of the three photo sources, as candidate rows.

The engine reads responses that something else fetched: ``raw(name, body)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text

# Labels the candidates carry, and the claims read from an entity.
LEAD_CAPTION, ARTICLE_CAPTION = "Wikipedia lead image", "Wikipedia article image"
REPOSITORY_TITLE = "Wikimedia Commons"
ENCYCLOPEDIA, KNOWLEDGE, REPOSITORY = "wikipedia", "wikidata", "commons"
IMAGE_CLAIM, CATEGORY_CLAIM = "P18", "P373"

_PAGES = (
    "STRUCT<query: STRUCT<pages: MAP<STRING, STRUCT<title: STRING,"
    " original: STRUCT<source: STRING>, thumbnail: STRUCT<source: STRING>,"
    " images: ARRAY<STRUCT<title: STRING>>>>>>"
)
_IMAGEINFO = (
    "STRUCT<query: STRUCT<pages: MAP<STRING, STRUCT<title: STRING, imageinfo: ARRAY<STRUCT<"
    "url: STRING, thumburl: STRING, extmetadata: STRUCT<ImageDescription: STRUCT<value: STRING>,"
    " Categories: STRUCT<value: STRING>>>>>>>>"
)
_SEARCH = "STRUCT<search: ARRAY<STRUCT<id: STRING>>>"
_CLAIM = "ARRAY<STRUCT<mainsnak: STRUCT<datavalue: STRUCT<value: VARIANT>>>>"
_ENTITIES = (
    f"STRUCT<entities: MAP<STRING, STRUCT<claims: STRUCT<{IMAGE_CLAIM}: {_CLAIM},"
    f" {CATEGORY_CLAIM}: {_CLAIM}>>>>"
)


def _exploded_pages(raw: DataFrame, schema: str) -> DataFrame:
    """Pages in the order the web reads an object: whole-number keys ascending, then the rest."""
    entries = F.map_entries(F.from_json("body", schema)["query"]["pages"])

    def placed(entry, position):
        whole = entry["key"].rlike("^(0|[1-9][0-9]{0,8})$")
        return F.struct(
            F.when(whole, 0).otherwise(1).alias("late"),
            F.when(whole, entry["key"].try_cast("bigint"))
            .otherwise(position.cast("bigint"))
            .alias("place"),
            entry["value"].alias("page"),
        )

    ordered = F.array_sort(F.transform(entries, placed))
    return raw.select("name", F.posexplode(ordered).alias("page_ord", "item")).select(
        "name", "page_ord", "item.page"
    )


def encyclopedia_candidates(raw: DataFrame) -> DataFrame:
    """Lead image of each page, then its article images, whose URL is still empty."""
    pages = _exploded_pages(raw, _PAGES).withColumn(
        "title", F.coalesce(F.col("page.title"), F.col("name"))
    )
    lead = pages.where(F.coalesce(F.col("page.original.source"), F.lit("")) != "").select(
        "name",
        (F.col("page_ord").cast("bigint") * 1_000_000).alias("ord"),
        F.col("page.original.source").alias("url"),
        F.col("page.thumbnail.source").alias("thumb_url"),
        text.file_title_to_name(F.col("title")).alias("filename"),
        F.col("title").alias("page_title"),
        F.lit(LEAD_CAPTION).alias("caption"),
        F.lit(ENCYCLOPEDIA).alias("source"),
    )
    images = pages.select(
        "name", "page_ord", "title", F.posexplode("page.images").alias("at", "image")
    )
    article = images.where(F.col("image.title").rlike("(?i)^File:")).select(
        "name",
        (F.col("page_ord").cast("bigint") * 1_000_000 + F.col("at") + 1).alias("ord"),
        F.lit("").alias("url"),
        F.lit(None).cast("string").alias("thumb_url"),
        text.file_title_to_name(F.col("image.title")).alias("filename"),
        F.col("title").alias("page_title"),
        F.lit(ARTICLE_CAPTION).alias("caption"),
        F.lit(ENCYCLOPEDIA).alias("source"),
    )
    return lead.unionByName(article)


def repository_candidates(
    raw: DataFrame, source: str = REPOSITORY, page_title: str | None = REPOSITORY_TITLE
) -> DataFrame:
    """Image records of the media repository, by title or by search.

    ``page_title=None`` takes the name as page title, as title look-ups do.
    """
    info = _exploded_pages(raw, _IMAGEINFO).withColumn("info", F.get("page.imageinfo", 0))
    meta = F.col("info.extmetadata")
    return info.where("info is not null").select(
        "name",
        F.col("page_ord").cast("bigint").alias("ord"),
        F.coalesce("info.url", F.lit("")).alias("url"),
        F.col("info.thumburl").alias("thumb_url"),
        text.file_title_to_name(F.coalesce(F.col("page.title"), F.lit(""))).alias("filename"),
        (F.col("name") if page_title is None else F.lit(page_title)).alias("page_title"),
        text.build_caption(
            meta["ImageDescription"]["value"], meta["Categories"]["value"]
        ).alias("caption"),
        F.lit(source).alias("source"),
    )


def _string(value: Column) -> Column:
    """A claim's value if it is a JSON string; objects and numbers name no file."""
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def knowledge_claims(search: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image titles ``(name, ord, title)`` and first category ``(name, category)`` of the
    best search hit of each name."""
    best = search.select(
        "name", F.get(F.from_json("body", _SEARCH)["search"], 0)["id"].alias("entity")
    ).where("entity is not null")
    parsed = entities.select(
        "name", F.explode(F.from_json("body", _ENTITIES)["entities"]).alias("entity", "value")
    )
    claims = best.join(parsed, ["name", "entity"])
    values = lambda c: F.filter(
        F.transform(F.col(f"value.claims.{c}"), lambda s: _string(s["mainsnak"]["datavalue"]["value"])),
        lambda v: v.isNotNull(),
    )
    images = claims.select("name", F.posexplode(values(IMAGE_CLAIM)).alias("ord", "file")).select(
        "name", "ord", F.concat(F.lit("File:"), "file").alias("title")
    )
    categories = claims.select("name", F.get(values(CATEGORY_CLAIM), 0).alias("category")).where(
        "category is not null"
    )
    return images, categories
