"""Width and height of images from the first bytes of their files, without decoding.

Column expressions over binary columns for PNG, JPEG, GIF, WebP (its three kinds) and BMP.
``HEADER_BYTES`` are looked at, at most; a JPEG's size stands behind a run of segments of
any length, of which ``MAX_SEGMENTS`` are skipped. Files of another kind, cut off before
their size or broken have no size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 1 << 18
MAX_SEGMENTS = 512


def _big(content: str, at: str, size: int) -> str:
    """SQL of the number in ``size`` bytes from offset ``at``, highest byte first."""
    return f"cast(conv(hex(substring({content}, {at} + 1, {size})), 16, 10) as bigint)"


def _little(content: str, at: int, size: int) -> str:
    return " + ".join(f"{1 << 8 * k} * {_big(content, str(at + k), 1)}" for k in range(size))


def _signed(value: str) -> str:
    return f"if({value} >= {1 << 31}, {1 << 32} - ({value}), {value})"


def _jpeg(c: str) -> str:
    """A walk over segments: the place of the next one, or null at the end, and the size."""
    marker, length = _big(c, "a.at + 1", 1), _big(c, "a.at + 2", 2)
    state = "named_struct('at', {at}, 'width', {width}, 'height', {height})"
    none = "cast(null as bigint)"
    go_on = lambda to: state.format(at=f"cast({to} as bigint)", width=none, height=none)
    frame = state.format(at=none, width=_big(c, "a.at + 7", 2), height=_big(c, "a.at + 5", 2))
    return f"""aggregate(sequence(1, {MAX_SEGMENTS}), {go_on(2)}, (a, i) -> CASE
        WHEN a.at IS NULL THEN a
        WHEN a.at + 9 > length({c}) OR {_big(c, "a.at", 1)} <> 255 THEN {state.format(at=none, width="a.width", height="a.height")}
        WHEN {marker} = 255 THEN {go_on("a.at + 1")}
        WHEN {marker} BETWEEN 192 AND 207 AND {marker} NOT IN (196, 200, 204) THEN {frame}
        WHEN {marker} = 1 OR {marker} BETWEEN 208 AND 215 THEN {go_on("a.at + 2")}
        WHEN {marker} IN (217, 218) OR {length} < 2 THEN {state.format(at=none, width="a.width", height="a.height")}
        ELSE {go_on(f"a.at + 2 + {length}")} END, a -> named_struct('width', a.width, 'height', a.height))"""


def _sizes(c: str) -> list[tuple[str, str, str, str]]:
    """(kind, condition, width, height) in SQL over the binary value ``c``."""
    at = lambda place, text: f"hex(substring({c}, {place} + 1, {len(text) // 2})) = '{text}'"
    webp = at(0, "52494646") + " AND " + at(8, "57454250")
    low = lambda place: _big(c, str(place), 1)
    return [
        ("png", at(0, "89504E470D0A1A0A") + " AND " + at(12, "49484452"), _big(c, "16", 4), _big(c, "20", 4)),
        ("gif", at(0, "474946383761") + " OR " + at(0, "474946383961"), _little(c, 6, 2), _little(c, 8, 2)),
        ("bmp", at(0, "424D") + f" AND {_little(c, 14, 4)} = 12", _little(c, 18, 2), _little(c, 20, 2)),
        ("bmp", at(0, "424D"), _signed(_little(c, 18, 4)), _signed(_little(c, 22, 4))),
        ("webp", webp + " AND " + at(12, "56503858"), "1 + " + _little(c, 24, 3), "1 + " + _little(c, 27, 3)),
        ("webp", webp + " AND " + at(12, "5650384C") + " AND " + at(20, "2F"),
         f"1 + ({low(22)} & 63) * 256 + {low(21)}", f"1 + ({low(24)} & 15) * 1024 + {low(23)} * 4 + shiftright({low(22)}, 6)"),
        ("webp", webp + " AND " + at(12, "56503820") + " AND " + at(23, "9D012A"),
         f"({_little(c, 26, 2)}) & 16383", f"({_little(c, 28, 2)}) & 16383"),
    ]


def image_size(content: str = "content") -> Column:
    """``struct(kind, width, height)`` of the image in a binary column; null where there is none."""
    of = lambda kind, width, height: f"named_struct('kind', '{kind}', 'width', {width}, 'height', {height})"
    jpeg = f"transform(array({_jpeg('c')}), s -> {of('jpeg', 's.width', 's.height')})[0]"
    kinds = [f"WHEN hex(substring(c, 1, 3)) = 'FFD8FF' THEN {jpeg}"]
    kinds += [f"WHEN {test} THEN {of(kind, width, height)}" for kind, test, width, height in _sizes("c")]
    found = F.expr(f"transform(array(substring(`{content}`, 1, {HEADER_BYTES})), c -> CASE {' '.join(kinds)} END)[0]")
    return F.when(found["width"].isNotNull() & found["height"].isNotNull(), F.struct(
        found["kind"].alias("kind"), found["width"].alias("width"), F.abs(found["height"]).alias("height")
    ))
