"""SQL fragments shared by the defining queries (DuckDB dialect)."""

from __future__ import annotations


def r6(x: str) -> str:
    """Six decimals by plain arithmetic, so that both engines round alike."""
    return f"(floor(({x})::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


def norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[]))"


def unit(v: str) -> str:
    """Unit copy rounded to float."""
    n = norm(v)
    return (
        f"list_transform({v}, lambda x: "
        f"(x::DOUBLE * (CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / {n} END))::FLOAT)"
    )


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def farthest_points(source: str, key: str, k: int, name: str = "picked") -> str:
    """CTEs ending in ``name(key, vec_id)``: prototypes of ``source(key, vec_id, embedding)``."""
    return f"""
    fp_v AS (
      SELECT {key} AS g, vec_id, {unit('embedding')}::DOUBLE[] AS u, {norm('embedding')} AS n
      FROM {source}
    ),
    fp_0 AS (
      SELECT *, first_value(vec_id) OVER w AS pick, first_value(u) OVER w AS pick_u
      FROM fp_v WINDOW w AS (PARTITION BY g ORDER BY n DESC, vec_id)
    ),
    fp_r AS (
      SELECT g, vec_id, u, 1 AS step, pick, pick_u,
             CASE WHEN vec_id = pick THEN '-inf'::DOUBLE
                  ELSE 1 - list_dot_product(u, pick_u) END AS d
      FROM fp_0
      UNION ALL
      SELECT g, vec_id, u, step + 1, pick, pick_u,
             CASE WHEN vec_id = pick THEN '-inf'::DOUBLE
                  ELSE least(d, 1 - list_dot_product(u, pick_u)) END
      FROM (
        SELECT g, vec_id, u, step, d,
               first_value(vec_id) OVER w AS pick, first_value(u) OVER w AS pick_u,
               max(d) OVER (PARTITION BY g) AS far
        FROM fp_r WHERE step < {k}
        WINDOW w AS (PARTITION BY g ORDER BY d DESC, vec_id)
      ) WHERE far > '-inf'::DOUBLE
    ),
    fp_p AS (SELECT DISTINCT g, pick, pick_u FROM fp_r),
    {name} AS (
      SELECT DISTINCT g AS {key}, vec_id FROM (
        SELECT p.g, v.vec_id, row_number() OVER (
                 PARTITION BY p.g, p.pick ORDER BY list_dot_product(p.pick_u, v.u) DESC, v.vec_id) AS rn
        FROM fp_p p JOIN fp_v v ON p.g = v.g
      ) WHERE rn = 1
    )"""


def iou(a: str, b: str, guard: bool = True) -> str:
    w = f"(least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    h = f"(least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    union = f"({a}.width * {a}.height + {b}.width * {b}.height - {w} * {h})"
    positive = (
        f"{a}.width > 0 AND {a}.height > 0 AND {b}.width > 0 AND {b}.height > 0 AND " if guard else ""
    )
    return (
        f"(CASE WHEN {positive}{w} > 0 AND {h} > 0 AND {union} > 0 "
        f"THEN {w} * {h} / {union} ELSE 0.0::DOUBLE END)"
    )


def inside(outer: str, inner: str) -> str:
    cx, cy = f"({inner}.x + {inner}.width / 2)", f"({inner}.y + {inner}.height / 2)"
    return (
        f"({cx} >= {outer}.x AND {cx} <= {outer}.x + {outer}.width AND "
        f"{cy} >= {outer}.y AND {cy} <= {outer}.y + {outer}.height)"
    )


def box(x: str, y: str, w: str, h: str) -> str:
    return (
        f"{{'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE, "
        f"'width': ({w})::DOUBLE, 'height': ({h})::DOUBLE}}"
    )


SPACE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def web_trim(s: str) -> str:
    return f"regexp_replace({s}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def normalize_name(s: str) -> str:
    return f"lower(regexp_replace({web_trim(s)}, '{SPACE}+', ' ', 'g'))"


def slug(s: str) -> str:
    return (
        f"regexp_replace(regexp_replace({normalize_name(s)}, '[^a-z0-9]+', '-', 'g'),"
        f" '^-+|-+$', '', 'g')"
    )


def identity_id(s: str) -> str:
    hashed = (
        f"list_reduce(list_transform(string_split({s}, ''), lambda c: unicode(c)::BIGINT),"
        f" lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT)"
    )
    digits = (
        "array_to_string(list_transform([2176782336,60466176,1679616,46656,1296,36,1]::BIGINT[],"
        " lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz',"
        f" (({hashed}) // p % 36 + 1)::INTEGER, 1)), '')"
    )
    return (
        f"(CASE WHEN {slug(s)} <> '' THEN {slug(s)}"
        f" ELSE 'person-' || ltrim({digits}, '0') END)"
    )


def normalize_text(s: str) -> str:
    return f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"


def strip_initials(s: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({s}, '\\b[a-z]\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def tokens(s: str) -> str:
    return f"list_filter(string_split({s}, ' '), lambda t: len(t) >= 2)"


def strip_html(s: str) -> str:
    return web_trim(
        f"regexp_replace(regexp_replace(regexp_replace({s}, '<[^>]*>', ' ', 'g'),"
        f" '(?i)&[a-z]+;', ' ', 'g'), '{SPACE}+', ' ', 'g')"
    )


URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d*))?([^?#]*)"


def url_path(u: str) -> str:
    raw = f"regexp_extract({u}, '{URL}', 4)"
    return (
        f"(CASE WHEN NOT regexp_matches({u}, '{URL}') THEN NULL"
        f" WHEN {raw} = '' THEN '/' ELSE {raw} END)"
    )


def url_origin(u: str) -> str:
    scheme = f"lower(regexp_extract({u}, '{URL}', 1))"
    port = f"regexp_extract({u}, '{URL}', 3)"
    tail = (
        f"(CASE WHEN {port} = '' OR ({scheme} = 'https' AND {port} = '443')"
        f" OR ({scheme} = 'http' AND {port} = '80') THEN '' ELSE ':' || {port} END)"
    )
    return (
        f"(CASE WHEN regexp_matches({u}, '{URL}') THEN {scheme} || '://' ||"
        f" lower(regexp_extract({u}, '{URL}', 2)) || {tail} END)"
    )


def url_extension(u: str) -> str:
    return f"coalesce(lower(regexp_extract({url_path(u)}, '\\.([^.]*)$', 1)), '')"


def url_key(u: str) -> str:
    return f"coalesce({url_origin(u)} || {url_path(u)}, {u})"


def usable_photo(u: str) -> str:
    return f"(starts_with({u}, 'https://') AND {url_extension(u)} IN ('jpg','jpeg','png','webp'))"


def resolve_url(base: str, ref: str) -> str:
    folder = f"regexp_replace({url_path(base)}, '[^/]*$', '')"
    return f"""(CASE WHEN {ref} = '' THEN ''
      WHEN regexp_matches({ref}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {ref}
      WHEN starts_with({ref}, '//') THEN regexp_extract({base}, '^([^:]+:)', 1) || {ref}
      WHEN starts_with({ref}, '/') THEN {url_origin(base)} || {ref}
      WHEN starts_with({ref}, '#') THEN regexp_replace({base}, '#.*$', '') || {ref}
      WHEN starts_with({ref}, '?') THEN {url_origin(base)} || {url_path(base)} || {ref}
      ELSE {url_origin(base)} || {folder} || {ref} END)"""
