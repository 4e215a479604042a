"""Column expressions over names, captions, file titles and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.functions.bind import let

# The white space of the web's string functions (not Java's ASCII \s),
# and the photo extensions accepted.
WEB_SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WEB_SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp")


def web_trim(s: Column) -> Column:
    return F.trim(s, F.lit(WEB_SPACE_CHARS))


def normalize_name(s: Column) -> Column:
    """Trimmed, single-spaced, lower case."""
    return F.lower(F.regexp_replace(web_trim(s), f"{WEB_SPACE}+", " "))


def identity_slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_name(name), "[^a-z0-9]+", "-"), F.lit("-"))


def identity_id(name: Column) -> Column:
    """Kebab-case slug; a name without Latin letters or digits gets a hashed id."""
    code_points = F.transform(
        F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")
    )
    hashed = F.aggregate(
        code_points, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % F.lit(4294967296)
    )
    fallback = F.concat(F.lit("person-"), F.lower(F.conv(hashed.cast("string"), 10, 36)))
    # No column stands inside a lambda here: Spark would resolve it to an alias of the same
    # select first, as in select(normalize_name(name).alias("name"), identity_id(name)).
    return F.coalesce(F.nullif(identity_slug(name), F.lit("")), fallback)


def strip_html(s: Column) -> Column:
    no_tags = F.regexp_replace(s, "<[^>]*>", " ")
    no_entities = F.regexp_replace(no_tags, "(?i)&[a-z]+;", " ")
    return web_trim(F.regexp_replace(no_entities, f"{WEB_SPACE}+", " "))


def file_title_to_name(title: Column) -> Column:
    return web_trim(F.regexp_replace(title, "(?i)^File:", ""))


def build_caption(description: Column, categories: Column) -> Column:
    """Stripped description and categories, joined, cut to the caption length."""
    parts = F.array(
        F.coalesce(strip_html(description), F.lit("")),
        F.coalesce(F.regexp_replace(categories, r"\|", " "), F.lit("")),
    )
    joined = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return F.substring(joined, 1, settings.CAPTION_CHARS)


# scheme, user info, host, port, path of an absolute URL.
_URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d*))?([^?#]*)"


def _url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def _resolve_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.slice(parts, 1, 0),
        lambda out, p: F.when(p == ".", out)
        .when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1))))
        .otherwise(F.array_append(out, p)),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), tail)


def url_path(url: Column) -> Column:
    """Path of an absolute URL with dot segments resolved; null when not a URL."""

    def tidy(raw: Column) -> Column:
        return (
            F.when(raw.rlike(r"/\.{1,2}(/|$)"), _resolve_dots(raw)).when(raw == "", "/").otherwise(raw)
        )

    return let(url, lambda u: F.when(u.rlike(_URL), let(_url_part(u, 4), tidy)))


def url_origin(url: Column) -> Column:
    """scheme://host[:port], lower case, without a default port; null when not a URL."""

    def build(u: Column) -> Column:
        scheme, host, port = F.lower(_url_part(u, 1)), F.lower(_url_part(u, 2)), _url_part(u, 3)
        default = (
            (port == "")
            | ((scheme == "https") & (port == "443"))
            | ((scheme == "http") & (port == "80"))
        )
        tail = F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
        return F.when(u.rlike(_URL), F.concat(scheme, F.lit("://"), host, tail))

    return let(url, build)


def url_extension(url: Column) -> Column:
    """Lower-case tail after the last dot of the whole path; empty when there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url_path(url), r"\.([^.]*)$", 1)), F.lit(""))


def url_key(url: Column) -> Column:
    """Dedup key: origin and path, so tracking parameters collapse."""
    return let(url, lambda u: F.coalesce(F.concat(url_origin(u), url_path(u)), u))


def is_usable_photo(url: Column) -> Column:
    return let(
        url, lambda u: u.startswith("https://") & url_extension(u).isin(*PHOTO_EXTENSIONS)
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """An href as a browser reports it: absolute against the page it stands on."""
    origin = url_origin(base)

    def absolute(r: Column) -> Column:
        return (
            F.when(r == "", "")
            .when(r.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), r)
            .when(r.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), r))
            .when(r.startswith("/"), F.concat(origin, r))
            .when(r.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), r))
            .when(r.startswith("?"), F.concat(origin, url_path(base), r))
            .otherwise(F.concat(origin, F.regexp_replace(url_path(base), "[^/]*$", ""), r))
        )

    return let(ref, absolute)


def normalize_text(s: Column) -> Column:
    """Lower case, every run outside a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def strip_initials(normalized: Column) -> Column:
    """Drop single letters, so a middle initial does not break a full-name hit."""
    return F.trim(F.regexp_replace(normalized, "(?:^| )[a-z](?= |$)", ""))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: F.length(t) >= 2)


def has_term(haystack: Column, term: Column) -> Column:
    """The FIRST occurrence of ``term`` stands between non-alphanumerics."""
    clear = lambda c: ~c.rlike("[a-z0-9]")

    def bounded(at: Column) -> Column:
        before = F.substring(haystack, at - 1, 1)
        after = F.substring(haystack, at + F.length(term), 1)
        return (at > 0) & (F.when(at == 1, True).otherwise(clear(before))) & clear(after)

    return F.contains(haystack, term) & let(F.instr(haystack, term), bounded)
