"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A text is split by a pattern into pieces, and a task encodes each distinct piece once. A piece starts as one row per byte; each step joins neighbouring tokens to the
merge table and contracts the leftmost pair of lowest rank of every piece, until no piece
changes. Decoding joins token ids to the vocabulary and aggregates bytes in order.

Pieces of up to ``LONG_PIECE`` bytes go through one recursive query per block. It keeps
every step's rows, which grow with the square of a piece, so longer pieces run the same
contraction as a loop over one table. There all occurrences of a piece's lowest pair are
contracted together, left to right, which is the same as one after the other unless that
made a pair of lower rank; such a piece repeats its step with the leftmost pair alone.

A task holds the merge table (about six rows per vocabulary entry), at most
``CACHE_PIECES`` encoded pieces and one block of texts.

Defined cases: a null or empty text has no ids and decodes to no bytes; ids that are null
or not in the vocabulary make ``decode`` fail; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import textbytes as tb

LONG_PIECE = 128
CACHE_PIECES = 600_000
STEP_ROWS = 1_500_000
DECODE_IDS = 250_000

# A row is a token: its key (piece and byte offset), the next token and that one's key. The
# least (rank, offset) of a piece is its leftmost pair of lowest rank.
_ENCODE = """
    WITH RECURSIVE step AS (
      SELECT k, tok, nk, nxt, id, 0 AS it FROM start LEFT JOIN merges ON lr = (tok << 32) | nxt
      UNION ALL (
        WITH best AS (
          SELECT k >> 8 AS w, min((id << 32) | (k & 255)) AS low FROM step WHERE id IS NOT NULL GROUP BY 1
        ),
        heads AS (
          SELECT w, s.k AS head, low >> 32 AS made, s.nk AS gone
          FROM best JOIN step s ON s.k = ((w << 8) | (low & 255))
        ),
        pairs AS (SELECT heads.*, g.nk AS after, g.nxt AS follows FROM heads JOIN step g ON g.k = gone),
        moved AS (
          SELECT s.k, s.it + 1 AS it,
            CASE WHEN s.k = head THEN made ELSE s.tok END AS tok,
            CASE WHEN s.k = head THEN after ELSE s.nk END AS nk,
            CASE WHEN s.k = head THEN follows WHEN s.nk = head THEN made ELSE s.nxt END AS nxt
          FROM step s JOIN pairs ON s.k >> 8 = w WHERE s.k <> gone
        )
        SELECT moved.k, moved.tok, moved.nk, moved.nxt, merges.id, moved.it
        FROM moved LEFT JOIN merges ON lr = (moved.tok << 32) | moved.nxt
      )
    )
    SELECT k >> 8 AS w, tok FROM step
    JOIN (SELECT k >> 8 AS w, max(it) AS it FROM step GROUP BY 1) last
      ON last.w = step.k >> 8 AND last.it = step.it
    ORDER BY k"""
# One step of the loop: ``take`` marks the left half of each contracted pair. Pairs of the
# lowest rank that overlap form a run, of which every second one is taken.
_MARKED = """
    CREATE OR REPLACE TABLE marked AS
    WITH n AS (
      SELECT w, pos, tok, lead(tok) OVER o AS nxt, lead(pos) OVER o AS npos
      FROM state WINDOW o AS (PARTITION BY w ORDER BY pos)
    ),
    m AS (SELECT n.*, merges.id FROM n LEFT JOIN merges ON lr = (tok << 32) | nxt),
    b AS (SELECT *, min(id) OVER (PARTITION BY w) AS best FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) AS rn FROM b WHERE best IS NOT NULL),
    i AS (SELECT *, id = best AS hit,
            rn - row_number() OVER (PARTITION BY w, id = best ORDER BY pos) AS island FROM r)
    SELECT w, pos, tok, npos, id, best,
           coalesce(hit, false) AND (row_number() OVER (PARTITION BY w, hit, island ORDER BY pos)) % 2 = 1 AS take
    FROM i"""
_APPLY = """
    SELECT w, pos, CASE WHEN take THEN id ELSE tok END AS tok
    FROM {marked} a WHERE NOT EXISTS (SELECT 1 FROM {marked} b WHERE b.take AND b.w = a.w AND b.npos = a.pos)
"""


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for ASCII texts, where the faster standard module serves; None if
    it uses more than letters and numbers as Unicode classes."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        token = pattern[at : at + 5] if pattern[at : at + 2] == "\\p" else pattern[at : at + 1 + (pattern[at] == "\\")]
        if token in (r"\p{L}", r"\p{N}"):
            held = "A-Za-z" if token == r"\p{L}" else "0-9"
            out.append(held if inside else f"[{held}]")
        elif token[:2] in ("\\p", "\\P", "\\X"):
            return None
        else:
            inside = token == "[" or inside and token != "]"
            out.append(token)
        at += len(token)
    try:
        return re.compile("".join(out), re.ASCII)
    except re.error:
        return None


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tables:
    """Vocabulary and merge table as arrays, made once and shipped to the workers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in self.tokens], dtype=np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        splits = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.merges = np.array(splits, dtype=np.int32).reshape(-1, 3)


class Decoder:
    """The vocabulary in a task's own DuckDB."""

    def __init__(self, tables: Tables):
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self._load("vocabulary", {"id": tables.ids, "hex": [t.hex() for t in tables.tokens]})

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def close(self) -> None:
        self.db.close()

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of each row of ids, in blocks of about ``DECODE_IDS``."""
        sizes = np.array([len(x) if x.is_valid else 0 for x in ids]) if ids.null_count else np.diff(ids.offsets)
        out: list[bytes] = []
        start = 0
        upto = np.cumsum(sizes)
        while start < len(ids):
            base = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, base + DECODE_IDS, side="right")))
            out.extend(self._decode(ids.slice(start, stop - start), sizes[start:stop]))
            start = stop
        return pa.array(out, pa.binary())

    def _decode(self, ids: pa.Array, sizes: np.ndarray) -> list[bytes]:
        tokens = ids.flatten()
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.db.register("given", pa.table({"d": rows, "pos": np.arange(len(rows), dtype=np.int32), "id": tokens}))
        found = self.db.execute(
            "SELECT d, string_agg(hex, '' ORDER BY pos) AS hex, count(hex) AS known"
            " FROM given LEFT JOIN vocabulary USING (id) GROUP BY d"
        ).fetchall()
        self.db.unregister("given")
        out = [b""] * len(sizes)
        for d, text, known in found:
            if known != sizes[d]:
                raise ValueError("a token id is not in the vocabulary")
            out[d] = bytes.fromhex(text)
        return out


class Codec(Decoder):
    """A task's merge table and the pieces it has encoded so far."""

    def __init__(self, tables: Tables):
        super().__init__(tables)
        self.pattern = regex.compile(tables.pattern)
        self.ascii = ascii_pattern(tables.pattern) or self.pattern
        self.bytes = tables.bytes
        self.ints = list(range(int(tables.ids.max()) + 1))  # one object per id, shared by the cache
        self.whole = dict(zip(tables.tokens, (self.ints[i] for i in tables.ids.tolist())))
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # of which those still met come back
        left, right, rank = tables.merges.astype(np.int64).T
        self._load("merges", {"lr": (left << 32) | right, "id": rank})

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not in the cache; afterwards all of ``pieces`` are."""
        if len(self.cache) + len(pieces) > CACHE_PIECES // 2:
            self.older, self.cache = self.cache, {}
        fresh, raw = [], []
        for piece in pieces:
            if piece not in self.cache:
                if (seen := self.older.get(piece)) is not None:
                    self.cache[piece] = seen
                    continue
                data = piece.encode()
                if (known := self.whole.get(data)) is not None:
                    self.cache[piece] = (known,)
                else:
                    fresh.append(piece)
                    raw.append(data)
        rows, chunk = 0, []
        for at, data in enumerate(raw):
            if len(data) > LONG_PIECE:
                self._keep(fresh[at : at + 1], self._loop(raw[at : at + 1]))
                continue
            chunk.append(at)
            rows += len(data) * len(data)
            if rows > STEP_ROWS:
                self._recurse([fresh[k] for k in chunk], [raw[k] for k in chunk])
                rows, chunk = 0, []
        if chunk:
            self._recurse([fresh[k] for k in chunk], [raw[k] for k in chunk])

    def _start(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece, offset and token of every byte, and whether it ends its piece."""
        sizes = np.array([len(x) for x in raw])
        ends = np.cumsum(sizes)
        tokens = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int64)
        last = np.zeros(len(tokens), dtype=bool)
        last[ends - 1] = True
        return np.repeat(np.arange(len(raw)), sizes), np.arange(len(tokens)) - np.repeat(ends - sizes, sizes), tokens, last

    def _recurse(self, pieces: list[str], raw: list[bytes]) -> None:
        words, places, tokens, last = self._start(raw)
        keys = (words << 8) | places
        follows = pa.array(np.roll(tokens, -1), mask=last)
        self._load("start", {"k": keys, "tok": tokens, "nk": pa.array(keys + 1, mask=last), "nxt": follows})
        self._keep(pieces, self.db.execute(_ENCODE).fetchnumpy())

    def _loop(self, raw: list[bytes]) -> dict:
        db = self.db
        words, places, tokens, _ = self._start(raw)
        self._load("start", {"w": words, "pos": places, "tok": tokens})
        db.execute("CREATE OR REPLACE TABLE state AS SELECT w, pos, tok FROM start")
        db.execute("CREATE OR REPLACE TABLE done AS SELECT w, pos, tok FROM state LIMIT 0")
        while True:
            db.execute(_MARKED)
            db.execute(
                "INSERT INTO done SELECT w, pos, tok FROM state WHERE w NOT IN (SELECT w FROM marked)"
            )
            best = db.execute("SELECT min(best), count(*) FROM marked").fetchone()
            if not best[1]:
                return db.execute("SELECT w, tok FROM done ORDER BY w, pos").fetchnumpy()
            db.execute("CREATE OR REPLACE TABLE state AS " + _APPLY.format(marked="marked"))
            lower = db.execute(
                "SELECT count(*) FROM (SELECT w, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM state) n"
                " JOIN merges ON lr = (n.tok << 32) | n.nxt"
                " JOIN (SELECT DISTINCT w, best FROM marked) o ON o.w = n.w WHERE merges.id < o.best"
            ).fetchone()[0]
            if lower:
                db.execute(
                    "CREATE OR REPLACE TABLE one AS SELECT * REPLACE (take AND pos = min(CASE WHEN take THEN pos END)"
                    " OVER (PARTITION BY w) AS take) FROM marked"
                )
                db.execute("CREATE OR REPLACE TABLE state AS " + _APPLY.format(marked="one"))

    def _keep(self, pieces: list[str], found: dict) -> None:
        words, tokens = found["w"], [self.ints[i] for i in found["tok"].tolist()]
        upto = np.searchsorted(words, np.arange(len(pieces) + 1)).tolist()
        for k, piece in enumerate(pieces):
            self.cache[piece] = tuple(tokens[upto[k] : upto[k + 1]])

    def ids(self, texts: list[str | None]) -> pa.Array:
        split = [(self.ascii if t.isascii() else self.pattern).findall(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        parts: list[np.ndarray] = []
        for pieces in split:
            parts.append(np.fromiter(chain.from_iterable(map(self.cache.__getitem__, pieces)), dtype=np.int32))
        upto = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(upto, np.concatenate(parts) if parts else np.zeros(0, np.int32))


def tables(spark, path: str, pattern: str):
    """The vocabulary at ``path``, ready to be shipped; its size is fixed by the file."""
    return spark.sparkContext.broadcast(Tables(read_ranks(path), pattern))


def encode(docs: DataFrame, held, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text."""
    kept = docs.drop("ids")
    schema = tb.schema(kept.schema.fields, "ids array<int>")

    def run(batches):
        codec = Codec(held.value)
        for batch in batches:
            for part in tb.blocks(batch, text):
                ids = codec.ids(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])
        codec.close()

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, held, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ids stand for."""
    kept = encoded.drop("decoded")
    schema = tb.schema(kept.schema.fields, "decoded binary")

    def run(batches):
        decoder = Decoder(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, decoder.decode(batch.column(ids))], names=[*batch.schema.names, "decoded"]
            )
        decoder.close()

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, held, text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` without the text, in one pass: half the Python workers."""
    kept = docs.drop("ids", "decoded")
    fields = [f for f in kept.schema if f.name != text]
    schema = tb.schema(fields, "ids array<int>, decoded binary")

    def run(batches):
        codec = Codec(held.value)
        for batch in batches:
            for part in tb.blocks(batch, text):
                ids = codec.ids(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in fields), ids, codec.decode(ids)],
                    names=[*(f.name for f in fields), "ids", "decoded"],
                )
        codec.close()

    return kept.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """The contract's columns of ``round_trip(docs)`` or ``decode(encode(docs))``."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join("ids", ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
