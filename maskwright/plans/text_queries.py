"""Names, URLs, captions, landed responses and candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.lineage import spread, table
from maskwright.operators import gallery, ranking, reports, terms
from maskwright.plans import sql
from maskwright.plans.registry import ORACLES, query
from maskwright.plans.rounding import r6
from maskwright.sources import media, responses

# Digits in another script, so that some names slug to nothing.
_DIGITS, _OTHER = "0123456789", "〇一二三四五六七八九"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    customers = spread(table(spark, folder, "customer"))
    digits = F.translate(F.regexp_replace("c_name", "[^0-9]", ""), _DIGITS, _OTHER)
    return (
        customers.select(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\u00a0 x ")).alias("name"))
        .unionByName(customers.select(digits.alias("name")))
        .unionByName(table(spark, folder, "part").select(F.col("p_name").alias("name")))
        .unionByName(
            table(spark, folder, "pages").select(
                F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("name")
            )
        )
    )


_NAMES = f"""
    SELECT '  ' || upper(c_name) || chr(160) || ' x ' AS name FROM customer
    UNION ALL SELECT translate(regexp_replace(c_name, '[^0-9]', '', 'g'), '{_DIGITS}', '{_OTHER}')
      FROM customer
    UNION ALL SELECT p_name FROM part
    UNION ALL SELECT regexp_extract(html, '(?s)<title>(.*?)</title>', 1) FROM pages"""


@query(
    f"""
    WITH n AS ({_NAMES})
    SELECT md5({sql.normalize_name('name')}) AS name_key, md5({sql.identity_id('name')}) AS id_key,
           CASE WHEN starts_with({sql.identity_id('name')}, 'person-') THEN {sql.identity_id('name')} END AS hashed_id,
           count(*) AS n
    FROM n GROUP BY ALL"""
)
def name_keys(spark, folder):
    keyed = _names(spark, folder).select(
        text.normalize_name(F.col("name")).alias("name"), text.identity_id(F.col("name")).alias("id")
    ).select(
        F.md5("name").alias("name_key"),
        F.md5("id").alias("id_key"),
        F.when(F.col("id").startswith("person-"), F.col("id")).alias("hashed_id"),
    )
    return reports.count_reasons(keyed, ["name_key", "id_key", "hashed_id"])


@query(
    f"""
    WITH t AS (SELECT doc_id, {sql.normalize_text('text')} AS n FROM documents)
    SELECT doc_id, md5(n) AS normalized, md5({sql.strip_initials('n')}) AS no_initials,
           len({sql.tokens('n')})::BIGINT AS n_tokens
    FROM t"""
)
def text_normalize(spark, folder):
    docs = spread(table(spark, folder, "documents")).select(
        "doc_id", text.normalize_text(F.col("text")).alias("n")
    )
    n = F.col("n")
    return docs.select(
        "doc_id",
        F.md5(n).alias("normalized"),
        F.md5(text.strip_initials(n)).alias("no_initials"),
        F.size(text.tokens(n)).cast("bigint").alias("n_tokens"),
    )


@query(
    f"""
    WITH t AS (SELECT page_id, {sql.strip_html('html')} AS s FROM pages)
    SELECT page_id, md5(s) AS stripped, len(s)::BIGINT AS n_chars FROM t"""
)
def html_text(spark, folder):
    stripped = spread(table(spark, folder, "pages")).select(
        "page_id", text.strip_html(F.col("html")).alias("s")
    )
    return stripped.select(
        "page_id", F.md5("s").alias("stripped"), F.length("s").cast("bigint").alias("n_chars")
    )


_HREFS = """list_transform(
      regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1),
      lambda r: replace(regexp_replace(r, '^["'']|["'']$', '', 'g'), '&amp;', '&'))"""


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return media.discover_media(
        table(spark, folder, "pages"), keep=("page_id", "url"), tag="a", attribute="href"
    )


_LINKS = f"""
    l0 AS (SELECT page_id, url, {_HREFS} AS refs
           FROM pages),
    l1 AS (SELECT page_id, url, unnest(range(len(refs)))::INTEGER AS ord, unnest(refs) AS ref FROM l0),
    links AS (SELECT *, {sql.resolve_url('url', 'trim(ref)')} AS media_url FROM l1)"""


@query(f"WITH {_LINKS} SELECT page_id, ord, ref, media_url FROM links")
def media_discovery(spark, folder):
    return _links(spark, folder).select("page_id", "ord", "ref", "media_url")


@query(
    f"""
    WITH {_LINKS}, u AS (SELECT url AS u FROM pages UNION ALL SELECT media_url FROM links
                         UNION ALL SELECT ref FROM links
                         UNION ALL SELECT media_url || '.JPG?w=' || ord FROM links)
    SELECT u AS url, {sql.url_extension('u')} AS extension, {sql.url_key('u')} AS key,
           {sql.usable_photo('u')} AS usable, count(*) AS n
    FROM u GROUP BY ALL"""
)
def url_parts(spark, folder):
    links = _links(spark, folder)
    photo = F.concat("media_url", F.lit(".JPG?w="), F.col("ord").cast("string"))
    urls = (
        table(spark, folder, "pages").select("url")
        .unionByName(links.select(F.col("media_url").alias("url")))
        .unionByName(links.select(F.col("ref").alias("url")))
        .unionByName(links.select(photo.alias("url")))
    )
    url = F.col("url")
    parts = urls.select(
        "url",
        text.url_extension(url).alias("extension"),
        text.url_key(url).alias("key"),
        text.is_usable_photo(url).alias("usable"),
    )
    return reports.count_reasons(parts, ["url", "extension", "key", "usable"])


# The test pages carry no pixel sizes; sizes come from the length of each reference.
_SIZES = """
    length(ref) % 7 * 20 AS natural_width, length(ref) * 13 % 90 AS shown_width,
    length(ref) * 29 % 120 AS shown_height"""


@query(
    f"""
    WITH {_LINKS}, m AS (SELECT page_id, media_url, {_SIZES} FROM links),
    r AS (SELECT page_id, CASE WHEN media_url = '' THEN 'no-source'
             WHEN NOT regexp_matches(media_url, '(?i)^https?://') THEN 'scheme'
             WHEN natural_width = 0 THEN 'empty'
             WHEN shown_width < 32 OR shown_height < 32 THEN 'small' ELSE 'queued' END AS reason
          FROM m)
    SELECT page_id, reason, count(*) AS n FROM r GROUP BY ROLLUP (page_id, reason)"""
)
def eligibility_funnel(spark, folder):
    size = F.length("ref")
    sized = _links(spark, folder).select(
        "page_id",
        "media_url",
        (size % 7 * 20).alias("natural_width"),
        (size * 13 % 90).alias("shown_width"),
        (size * 29 % 120).alias("shown_height"),
    )
    return reports.funnel(media.eligibility(sized))


# ---- candidates: the page's own photo, then one photo per link; every second caption also
# carries a phrase from the list, so that each scoring rule meets real rows.
_PHRASES = (
    "", "signature", "with wife", "wax figure", "look alike", "look-alike", "ai generated",
    "and others", "jr", "iii", "photo", "book cover", "crowd", "masked ball",
)
_FILE_WORDS = ("", "portrait", "photograph", "official photo", "close up")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages")).select(
        "page_id",
        "url",
        text.strip_html(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"),
        text.strip_html(F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)).alias("para"),
        "html",
    )
    two = F.array_join(F.slice(text.tokens(text.normalize_text(F.col("title"))), 1, 2), " ")
    named = pages.withColumn("name", two).where("name <> ''")
    n = F.col("page_id")
    own = named.select(
        "name",
        F.lit(0).alias("source_ord"),
        n.alias("ord"),
        F.concat(text.url_origin(F.col("url")), text.url_path(F.col("url")), F.lit(".jpg")).alias("url"),
        F.concat_ws("_", F.regexp_replace("title", " ", "_"), _pick(_FILE_WORDS, n)).alias("filename"),
        F.concat_ws(" ", "para", "name", _pick(_PHRASES, n)).alias("caption"),
    )
    linked = media.discover_media(named, keep=("page_id", "url", "name", "title"), tag="a", attribute="href")
    place = n * 1000 + F.col("ord")
    links = linked.select(
        "name",
        F.lit(1).alias("source_ord"),
        place.alias("ord"),
        F.concat("media_url", F.lit(".png?src="), F.col("ord").cast("string")).alias("url"),
        F.concat_ws(" ", "ref", _pick(_FILE_WORDS, place)).alias("filename"),
        F.concat_ws(" ", "name", _pick(_PHRASES, place), "title").alias("caption"),
    )
    return own.unionByName(links)


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_CANDIDATES = f"""
    p0 AS (SELECT page_id, url, html, {sql.strip_html(_TITLE)} AS title,
                  {sql.strip_html("regexp_extract(html, '(?s)<p>(.*?)</p>', 1)")} AS para FROM pages),
    p1 AS (SELECT *, array_to_string(list_slice({sql.tokens(sql.normalize_text('title'))}, 1, 2), ' ') AS name
           FROM p0),
    p2 AS (SELECT * FROM p1 WHERE name <> ''),
    own AS (SELECT name, 0 AS source_ord, page_id AS ord,
              {sql.url_origin('url')} || {sql.url_path('url')} || '.jpg' AS url,
              concat_ws('_', replace(title, ' ', '_'), {_list(_FILE_WORDS)}[page_id % {len(_FILE_WORDS)} + 1]) AS filename,
              concat_ws(' ', para, name, {_list(_PHRASES)}[page_id % {len(_PHRASES)} + 1]) AS caption
            FROM p2),
    lk0 AS (SELECT *, {_HREFS} AS refs FROM p2),
    lk1 AS (SELECT page_id, url, name, title, unnest(range(len(refs))) AS o, unnest(refs) AS ref FROM lk0),
    linked AS (SELECT name, 1 AS source_ord, page_id * 1000 + o AS ord,
              {sql.resolve_url('url', 'trim(ref)')} || '.png?src=' || o AS url,
              concat_ws(' ', ref, {_list(_FILE_WORDS)}[(page_id * 1000 + o) % {len(_FILE_WORDS)} + 1]) AS filename,
              concat_ws(' ', name, {_list(_PHRASES)}[(page_id * 1000 + o) % {len(_PHRASES)} + 1], title) AS caption
            FROM lk1),
    cand AS (SELECT * FROM own UNION ALL SELECT * FROM linked)"""


def _has_any(hay: str, terms: tuple[str, ...]) -> str:
    return f"""(len(list_filter({_list(terms)}, lambda t: instr({hay}, t) > 0
        AND (instr({hay}, t) = 1 OR NOT regexp_matches(substr({hay}, instr({hay}, t) - 1, 1), '[a-z0-9]'))
        AND NOT regexp_matches(substr({hay}, instr({hay}, t) + len(t), 1), '[a-z0-9]'))) > 0)"""


def _scored(source: str) -> str:
    """CTEs ending in ``scored``: ``source(name, filename, caption, ...)`` with its score."""
    return f"""
    s0 AS (SELECT *, {sql.normalize_text("filename || ' ' || caption")} AS hay,
                  {sql.strip_initials(sql.normalize_text('filename'))} AS file,
                  {sql.tokens(sql.normalize_text('name'))} AS want FROM {source}),
    s1 AS (SELECT *, {sql.strip_initials('hay')} AS contig, array_to_string(want, ' ') AS fulln FROM s0),
    s2 AS (SELECT *, instr(contig, fulln) AS pos,
                  len(list_filter(want, lambda t: list_contains({sql.tokens('hay')}, t))) AS covered FROM s1),
    s3 AS (SELECT *, string_split(trim(substr(contig, pos + len(fulln))), ' ')[1] AS nxt,
                  string_split(trim(substr(contig, 1, greatest(pos - 1, 0))), ' ')[-1] AS prev FROM s2),
    scored AS (SELECT *, CASE WHEN hay = '' OR len(want) = 0 THEN 0.0::DOUBLE ELSE greatest(0, least(1,
        ((CASE WHEN pos > 0 THEN 0.75::DOUBLE WHEN covered = len(want) THEN 0.15::DOUBLE
               ELSE 0.1::DOUBLE * (covered::DOUBLE / len(want)) END)
         + (CASE WHEN instr(file, fulln) > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)
         + (CASE WHEN {_has_any('file', ranking.COMPOSITION)} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END))
        * (CASE WHEN {_has_any('hay', ranking.NON_PHOTO)} THEN 0.1::DOUBLE ELSE 1 END)
        * (CASE WHEN {_has_any('hay', ranking.LOOKALIKE)} THEN 0.05::DOUBLE ELSE 1 END)
        * (CASE WHEN {_has_any('hay', ranking.FABRICATED)} THEN 0.05::DOUBLE ELSE 1 END)
        * (CASE WHEN {_has_any('hay', ranking.CROWD)} THEN 0.6::DOUBLE ELSE 1 END)
        * (CASE WHEN pos > 0 AND nxt IN ('jr','sr','ii','iii','iv') THEN 0.1::DOUBLE ELSE 1 END)
        * (CASE WHEN pos > 0 AND (nxt IN ('and','with') OR prev IN ('and','with')) THEN 0.5::DOUBLE ELSE 1 END)
        )) END AS score FROM s3)"""


@query(
    f"""
    WITH {_CANDIDATES}, {_scored('cand')}
    SELECT name, source_ord, ord, {sql.r6('score')} AS score FROM scored"""
)
def context_score(spark, folder):
    scored = ranking.score_candidates(_candidates(spark, folder))
    return scored.select("name", "source_ord", "ord", r6(F.col("score")).alias("score"))


@query(ORACLES["context_score"])
def context_score_by_table(spark, folder):
    """The vocabulary as a user's table, compiled into one automaton."""
    vocabulary = terms.table(spark, ranking.Rules().groups())
    scored = ranking.score_candidates(_candidates(spark, folder), table=vocabulary)
    return scored.select("name", "source_ord", "ord", r6(F.col("score")).alias("score"))


@query(
    f"""
    WITH {_CANDIDATES},
    usable AS (SELECT *, row_number() OVER (
                 PARTITION BY name, {sql.url_key('url')} ORDER BY source_ord, ord) AS rn
               FROM cand WHERE {sql.usable_photo('url')}),
    kept AS (SELECT name, source_ord, ord, url, filename, caption FROM usable WHERE rn = 1),
    {_scored('kept')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, source_ord, ord) AS rank
               FROM scored WHERE score >= 0.4)
    SELECT name, rank::INTEGER AS rank, url, {sql.r6('score')} AS score FROM ranked WHERE rank <= 48"""
)
def candidate_rank(spark, folder):
    ranked = ranking.rank_candidates(_candidates(spark, folder))
    return ranked.select("name", "rank", "url", r6(F.col("score")).alias("score"))


# ---- landed responses: each page answers as a source would, and is parsed back.


def _page_facts(spark: SparkSession, folder: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return spread(table(spark, folder, "pages")).select(
        "page_id", "url", "html", F.concat(F.lit("file:"), title).alias("title"), title.alias("plain"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"),
    )


@query(
    f"""
    WITH f AS (SELECT page_id, url, {_TITLE} AS plain FROM pages)
    SELECT 'page ' || page_id AS name, 0::BIGINT AS ord, url, {sql.web_trim('plain')} AS filename,
           'Wikipedia lead image' AS caption FROM f
    UNION ALL
    SELECT 'page ' || page_id, 1::BIGINT, '', {sql.web_trim('plain')} || '.jpg',
           'Wikipedia article image' FROM f"""
)
def encyclopedia_scan(spark, folder):
    facts = _page_facts(spark, folder)
    page = F.struct(
        F.col("title"),
        F.struct(F.col("url").alias("source")).alias("original"),
        F.array(
            F.struct(F.concat(F.lit("File:"), F.trim("plain"), F.lit(".jpg")).alias("title")),
            F.struct(F.concat(F.lit("Category:"), F.col("plain")).alias("title")),
        ).alias("images"),
    )
    body = F.to_json(
        F.struct(F.struct(F.create_map(F.col("page_id").cast("string"), page).alias("pages")).alias("query"))
    )
    found = responses.encyclopedia_candidates(facts.select("name", body.alias("body")))
    return found.select("name", "ord", "url", "filename", "caption")


_CAPTION = f"""substr(array_to_string(list_filter([{sql.strip_html('html')},
    replace(plain, '|', ' ')], lambda x: x <> ''), ' '), 1, 500)"""


@query(
    f"""
    WITH f AS (SELECT page_id, url, html, {_TITLE} AS plain FROM pages)
    SELECT 'page ' || page_id AS name, url, {sql.web_trim('plain')} AS filename,
           'Wikimedia Commons' AS page_title, {_CAPTION} AS caption FROM f"""
)
def repository_scan(spark, folder):
    facts = _page_facts(spark, folder)
    value = lambda c: F.struct(F.col(c).alias("value"))
    info = F.struct(
        F.col("url"),
        F.struct(value("html").alias("ImageDescription"), value("plain").alias("Categories")).alias(
            "extmetadata"
        ),
    )
    page = F.struct(F.col("title"), F.array(info).alias("imageinfo"))
    body = F.to_json(
        F.struct(F.struct(F.create_map(F.lit("-1"), page).alias("pages")).alias("query"))
    )
    found = responses.repository_candidates(facts.select("name", body.alias("body")))
    return found.select("name", "url", "filename", "page_title", "caption")


@query(
    f"""
    WITH f AS (SELECT page_id, {_TITLE} AS plain FROM pages)
    SELECT 'page ' || page_id AS name, 0 AS ord, 'File:' || plain AS title,
           CASE WHEN page_id % 3 > 0 THEN 'Category ' || page_id END AS category FROM f"""
)
def knowledge_scan(spark, folder):
    facts = _page_facts(spark, folder)
    entity = F.concat(F.lit("Q"), F.col("page_id").cast("string"))
    hit = lambda e: F.struct(e.alias("id"))
    search = F.to_json(F.struct(F.array(hit(entity), hit(F.lit("Q0x"))).alias("search")))
    claim = lambda v: F.array(
        F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))
    )
    category = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("Category "), F.col("page_id").cast("string")))
    claims = F.struct(claim(F.col("plain")).alias("P18"), claim(category).alias("P373"))
    entities = F.to_json(
        F.struct(F.create_map(entity, F.struct(claims.alias("claims"))).alias("entities"))
    )
    images, categories = responses.knowledge_claims(
        facts.select("name", search.alias("body")), facts.select("name", entities.alias("body"))
    )
    return images.join(categories, "name", "left").select("name", "ord", "title", "category")


@query(
    f"""
    WITH f AS (SELECT 'page ' || page_id AS name, page_id, url, {_TITLE} AS plain FROM pages),
    i AS (SELECT {sql.web_trim('plain')} || '.jpg' AS filename, url FROM f),
    w AS (SELECT DISTINCT name, {sql.web_trim('plain')} || '.jpg' AS filename FROM f)
    SELECT w.name, w.filename, i.url, w.name AS page_title FROM w JOIN i USING (filename)"""
)
def title_resolution(spark, folder):
    facts = _page_facts(spark, folder)
    file = F.concat(text.web_trim(F.col("plain")), F.lit(".jpg"))
    unresolved = facts.select("name", file.alias("filename"), F.col("page_id").alias("ord"), F.lit("").alias("url"))
    info = facts.select(
        "name", file.alias("filename"), F.col("page_id").alias("ord"), "url", F.lit("x").alias("page_title")
    )
    return ranking.resolve_titles(unresolved, info).select("name", "filename", "url", "page_title")


@query(
    """
    WITH c AS (SELECT 'page ' || page_id AS name, 'Category ' || page_id // 5 AS category FROM pages),
    f AS (SELECT 'Category ' || page_id // 5 AS category, url FROM pages)
    SELECT name, url, 4 AS source_ord FROM c JOIN f USING (category)"""
)
def category_expansion(spark, folder):
    facts = _page_facts(spark, folder)
    label = F.concat(F.lit("Category "), F.floor(F.col("page_id") / 5).cast("string"))
    categories = facts.select("name", label.alias("category"))
    files = facts.select(label.alias("category"), "url")
    expanded = ranking.expand_categories(categories, files)
    empty = expanded.limit(0)
    united = ranking.union_sources(empty, empty, empty, empty, expanded)
    return united.select("name", "url", "source_ord")


@query(
    """
    WITH n AS (SELECT DISTINCT source AS name FROM documents),
    r AS (SELECT source AS name, count(DISTINCT lang) AS sources FROM documents GROUP BY source)
    SELECT name, coalesce(sources, 0) AS sources, coalesce(sources, 0) >= 4 AS complete
    FROM n LEFT JOIN r USING (name)"""
)
def response_completeness(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("source").alias("name"), F.col("lang").alias("source")
    )
    return ranking.completeness(docs.select("name").distinct(), docs, 4)


@query(
    """
    WITH n AS (SELECT DISTINCT c_name AS name FROM customer)
    SELECT name, endpoint, name AS term FROM n, (VALUES ('encyclopedia'), ('knowledge'), ('repository')) e(endpoint)
    UNION ALL SELECT c_name, 'repository', 'incategory:' || c_mktsegment FROM customer"""
)
def query_ledger(spark, folder):
    customers = table(spark, folder, "customer")
    names = customers.select(F.col("c_name").alias("name")).distinct()
    categories = customers.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return ranking.query_ledger(names, categories)


@query(
    f"""
    WITH people AS (SELECT p_partkey AS person_ord, 'part-' || p_partkey AS id, p_name AS name,
                           [upper(p_brand), p_type || ' ' || p_brand] AS aliases FROM part),
    lab AS (SELECT person_ord, id, unnest(list_prepend(name, aliases)) AS label FROM people),
    first AS (SELECT {sql.normalize_name('label')} AS k, arg_min(id, person_ord) AS person_id FROM lab GROUP BY 1),
    req AS (SELECT '  ' || upper(p_name) AS name FROM part UNION ALL SELECT p_brand || ' ' FROM part
            UNION ALL SELECT s_name FROM supplier)
    SELECT name, person_id, count(*) AS n FROM req LEFT JOIN first ON {sql.normalize_name('name')} = k
    GROUP BY ALL"""
)
def person_lookup(spark, folder):
    part = table(spark, folder, "part")
    people = part.select(
        F.col("p_partkey").alias("person_ord"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.array(F.upper("p_brand"), F.concat("p_type", F.lit(" "), "p_brand")).alias("aliases"),
    )
    requests = (
        part.select(F.concat(F.lit("  "), F.upper("p_name")).alias("name"))
        .unionByName(part.select(F.concat("p_brand", F.lit(" ")).alias("name")))
        .unionByName(table(spark, folder, "supplier").select(F.col("s_name").alias("name")))
    )
    return reports.count_reasons(gallery.find_people(requests, people), ["name", "person_id"])


@query(
    f"""
    WITH ids AS (SELECT s_suppkey AS o, {sql.identity_id('s_name')} AS id, s_name AS name FROM supplier
                 UNION ALL SELECT 1000000 + c_custkey, 'c-' || c_custkey, c_name FROM customer),
    req AS (SELECT o_orderkey AS request_id,
              CASE WHEN o_orderkey % 2 = 0 THEN 'Customer#' || lpad((o_custkey // 2)::VARCHAR, 9, '0')
                   ELSE ' SUPPLIER#' || lpad((o_custkey // 4)::VARCHAR, 9, '0') END AS name,
              CASE WHEN o_orderstatus = 'P' THEN 'c-' || o_custkey * 2 ELSE '' END AS explicit_id,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'c-' || o_custkey * 3 END AS canonical_id
            FROM orders),
    byname AS (SELECT {sql.normalize_name('name')} AS k, arg_min(id, o) AS id FROM ids GROUP BY 1)
    SELECT request_id,
           CASE WHEN explicit_id <> '' THEN e.id ELSE coalesce(c.id, s.id, n.id) END AS identity_id,
           CASE WHEN explicit_id <> '' AND e.id IS NULL THEN 'no such identity' END AS error
    FROM req LEFT JOIN ids e ON e.id = explicit_id LEFT JOIN ids c ON c.id = canonical_id
    LEFT JOIN ids s ON s.id = {sql.identity_id('req.name')}
    LEFT JOIN byname n ON n.k = {sql.normalize_name('req.name')}"""
)
def refresh_target(spark, folder):
    suppliers = table(spark, folder, "supplier")
    customers = table(spark, folder, "customer")
    identities = suppliers.select(
        F.col("s_suppkey").alias("identity_ord"), text.identity_id(F.col("s_name")).alias("identity_id"),
        F.col("s_name").alias("name"),
    ).unionByName(
        customers.select(
            (F.col("c_custkey") + 1000000).alias("identity_ord"),
            F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("identity_id"),
            F.col("c_name").alias("name"),
        )
    )
    key = F.col("o_custkey")
    number = lambda by: F.lpad(F.floor(key / by).cast("string"), 9, "0")
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Customer#"), number(2)))
        .otherwise(F.concat(F.lit(" SUPPLIER#"), number(4)))
        .alias("name"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("c-"), (key * 2).cast("string")))
        .otherwise("")
        .alias("explicit_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("c-"), (key * 3).cast("string"))).alias(
            "canonical_id"
        ),
    )
    return gallery.choose_target(requests, identities).select("request_id", "identity_id", "error")
