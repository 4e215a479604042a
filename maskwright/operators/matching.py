"""Matching query vectors against galleries of identities.

Gallery rows: ``(identity_id, identity_ord, kind, ord, embedding)`` with kind
``embedding``, ``prototype`` or ``hard_negative``. Identity rows:
``(identity_id, threshold)``. Query rows: ``(query_id, embedding)``.

A small gallery (its bytes are counted first) is shipped once to every executor and
queries are scored where they lie: no shuffle. A larger one gets a metric index
(:mod:`metric_index`): queries go only to those of its cells that can hold a decisive
score. With ``block_rows``, or where hardly a cell can be left out, it streams past blocks
of queries instead, parts of that size at a time. Partial results per (query, identity)
are added up.
Vectors must share one width: :func:`reject_vectors` sets others aside first.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.functions import vectors
from maskwright.lineage import cut
from maskwright.operators import blocks, metric_index

MATCH_COLUMNS = ("identity_id", "score")


def sanitize_gallery(
    gallery: DataFrame, width: int, tolerance: float | None = settings.NORM_TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """Usable gallery rows, and one status row per identity that lost vectors.

    An identity left without any positive vector is ``dropped`` whole, one that lost
    some is ``degraded``.
    """
    fault = vectors.embedding_fault(F.col("embedding"), width, tolerance)
    positive = F.col("kind") != "hard_negative"
    judged = gallery.withColumn("__fault", fault)
    report = judged.groupBy("identity_id").agg(
        F.count_if(positive & F.col("__fault").isNull()).alias("kept"),
        F.count_if(positive & F.col("__fault").isNotNull()).alias("rejected"),
    )
    status = report.select(
        "identity_id",
        "kept",
        "rejected",
        F.when(F.col("kept") == 0, "dropped")
        .when(F.col("rejected") > 0, "degraded")
        .otherwise("ok")
        .alias("status"),
    )
    dropped = status.where("status = 'dropped'").select("identity_id")
    clean = judged.where("__fault is null").drop("__fault").join(dropped, "identity_id", "left_anti")
    return clean, status


def reject_vectors(queries: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Queries whose vector can be compared, and ``(query_id, fault)`` of the others."""
    judged = queries.withColumn("__fault", vectors.embedding_fault(F.col("embedding"), width, None))
    rejected = judged.where("__fault is not null").select("query_id", F.col("__fault").alias("fault"))
    return judged.where("__fault is null").drop("__fault"), rejected


def choose_gallery(gallery: DataFrame) -> DataFrame:
    """Prototypes where an identity has some, else its embeddings; hard negatives stay."""
    has = gallery.groupBy("identity_id").agg(
        F.max(F.col("kind") == "prototype").alias("__has_prototypes")
    )
    positive = F.when(F.col("__has_prototypes"), "prototype").otherwise("embedding")
    return (
        gallery.join(has, "identity_id")
        .where((F.col("kind") == positive) | (F.col("kind") == "hard_negative"))
        .drop("__has_prototypes")
    )


def with_rules(
    gallery: DataFrame,
    identities: DataFrame | None,
    default_threshold: float,
    min_agreements: int,
) -> DataFrame:
    """Attach each identity's threshold and the agreements it needs to its chosen rows."""
    if min_agreements < 1:
        raise ValueError("min_agreements must be at least 1")
    chosen = choose_gallery(gallery)
    counts = chosen.where("kind <> 'hard_negative'").groupBy("identity_id").agg(
        F.least(F.count("*"), F.lit(min_agreements)).alias("need")
    )
    rules = chosen.join(counts, "identity_id")
    if identities is None:
        return rules.withColumn("threshold", F.lit(float(default_threshold)))
    thresholds = identities.select(
        "identity_id", F.col("threshold").cast("double").alias("threshold")
    )
    return rules.join(thresholds, "identity_id", "left").withColumn(
        "threshold", vectors.finite_or(F.col("threshold"), float(default_threshold))
    )


class _Gallery:
    """The chosen rows of one gallery (or one block of it) as arrays."""

    def __init__(self, rows: pa.Table):
        self.vectors = blocks.matrix(rows["embedding"])
        self.identity = np.asarray(rows["identity_ord"].to_numpy(), dtype=np.int64)
        self.negative = np.asarray(
            [k == "hard_negative" for k in rows["kind"].to_pylist()], dtype=bool
        )
        self.threshold = rows["threshold"].to_numpy().astype(np.float64)
        self.need = rows["need"].to_numpy().astype(np.int64)


def _partial_matches(queries: np.ndarray, g: _Gallery, margin: float) -> dict[str, np.ndarray]:
    """Per (query row, identity) that any decisive score was found for: best positive
    score, number of positives at the threshold, best negative score.

    Hits are reduced strip by strip, so a pile of near copies costs one strip of pairs."""
    blocks.same_width(queries, g.vectors)
    bound = np.where(g.negative, g.threshold - margin - blocks.SLACK, g.threshold)
    parts = [
        _reduced(blocks.unit_rows(queries[strip]), strip.start, g, bound)
        for strip in blocks.strips(len(queries), len(g.vectors), 1_000_000)
    ] or [_reduced(queries[:0], 0, g, bound)]
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _reduced(unit: np.ndarray, start: int, g: _Gallery, bound: np.ndarray) -> dict[str, np.ndarray]:
    i, j, s = blocks.pairs_at_least(unit, g.vectors, bound)
    span = int(g.identity.max()) + 1 if len(g.identity) else 1
    code, slot = np.unique(i * span + g.identity[j], return_inverse=True)
    positive = np.full(len(code), -np.inf)
    negative = np.full(len(code), -np.inf)
    agree = np.zeros(len(code), dtype=np.int64)
    neg = g.negative[j]
    np.maximum.at(positive, slot[~neg], s[~neg])
    np.add.at(agree, slot[~neg], 1)
    np.maximum.at(negative, slot[neg], s[neg])
    return {
        "row": code // span + start,
        "identity_ord": code % span,
        "best": positive,
        "agree": agree,
        "negative": negative,
    }


def _best_scores(queries: np.ndarray, g: _Gallery) -> tuple[np.ndarray, np.ndarray]:
    """Highest positive score of each query and the earliest identity reaching it."""
    blocks.same_width(queries, g.vectors)
    keep = ~g.negative
    vecs, identity = g.vectors[keep], g.identity[keep]
    best = np.full(len(queries), -np.inf)
    owner = np.full(len(queries), -1, dtype=np.int64)
    if not len(vecs):
        return best, owner
    strip = max(1, 8_000_000 // len(vecs))
    for start in range(0, len(queries), strip):
        part = queries[start : start + strip]
        rough = part @ vecs.T
        i, j = np.nonzero(rough >= rough.max(axis=1, keepdims=True) - blocks.SLACK)
        s = blocks.exact_dots(part[i], vecs[j])
        order = np.lexsort((identity[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.r_[True, i[1:] != i[:-1]]
        best[start + i[first]] = s[first]
        owner[start + i[first]] = identity[j[first]]
    return best, owner


def _passing(p: dict[str, np.ndarray], threshold: np.ndarray, need: np.ndarray, margin: float):
    return (p["agree"] >= need) & (p["best"] >= threshold) & (p["best"] - p["negative"] >= margin)


def _scored_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("best_ord", T.LongType()),
            T.StructField("best_cosine", T.DoubleType()),
            T.StructField("match_ord", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _local_matches(queries: np.ndarray, rows: pa.Table, margin: float) -> dict[str, np.ndarray]:
    """What :func:`_partial_matches` returns, from rows that are sorted by identity."""
    tally = _MatchTally(pa.array(range(len(queries)), pa.int64()), queries, margin, PART_ROWS)
    found = [part for held in rows.to_batches() for part in tally.add(held)]
    found = pa.Table.from_batches([*found, *tally.close()], _LOCAL)
    return {c: found[c].to_numpy() for c in ("query_id", "identity_ord", "best", "agree", "negative")}


def _score_locally(batches, rows: pa.Table, margin: float, want_best: bool, want_match: bool):
    """mapInArrow body: the whole gallery is here, so each query is finished in place."""
    rows = rows.sort_by("identity_ord")
    g = _Gallery(rows)
    threshold = {int(o): t for o, t in zip(g.identity, g.threshold)}
    need = {int(o): n for o, n in zip(g.identity, g.need)}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        q = blocks.matrix(batch.column("embedding"))
        best, owner = (
            _best_scores(q, g) if want_best else (np.full(n, -np.inf), np.full(n, -1))
        )
        score, match = np.full(n, -np.inf), np.full(n, -1, dtype=np.int64)
        if want_match:
            p = _local_matches(q, rows, margin)
            t = np.array([threshold[int(o)] for o in p["identity_ord"]])
            k = np.array([need[int(o)] for o in p["identity_ord"]])
            ok = _passing(p, t, k, margin)
            row, ident, s = p["query_id"][ok], p["identity_ord"][ok], p["best"][ok]
            order = np.lexsort((ident, -s, row))
            row, ident, s = row[order], ident[order], s[order]
            first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
            score[row[first]], match[row[first]] = s[first], ident[first]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("query_id"),
                pa.array(owner, pa.int64(), mask=owner < 0),
                pa.array(best, pa.float64(), mask=owner < 0),
                pa.array(match, pa.int64(), mask=match < 0),
                pa.array(score, pa.float64(), mask=match < 0),
            ],
            names=["query_id", "best_ord", "best_cosine", "match_ord", "score"],
        )


def _score_broadcast(queries, rules, margin, want_best, want_match):
    spark = queries.sparkSession
    rows = rules.select(
        "identity_ord", "kind", "embedding", "threshold", F.col("need").cast("bigint").alias("need")
    ).toArrow()
    shared = spark.sparkContext.broadcast(rows)
    return queries.select("query_id", "embedding").mapInArrow(
        lambda batches: _score_locally(batches, shared.value, margin, want_best, want_match),
        _scored_schema(queries),
    )


#: Queries of one block, and the fewest of a block made only to keep all cores at work.
BLOCK_QUERIES, LEAST_QUERIES = 8192, 1024


def _query_blocks(queries: DataFrame) -> int:
    asked, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-asked // BLOCK_QUERIES), min(3 * cores, -(-asked // LEAST_QUERIES)))


def _meet_in_blocks(queries, gallery, tally, schema, query_blocks):
    """Every block of queries meets the whole gallery, which streams past it by identity.

    Queries cross one shuffle, gallery rows one per block of queries; nothing passes
    through the driver. ``tally(ids, vectors)`` keeps what is known of a block:
    ``add(rows)`` takes the gallery's rows and ``close()`` ends them, and both yield the
    results of those identities that are complete.
    """
    kinds = {f.name: f.dataType for f in gallery.schema.fields if f.name != "embedding"}
    unset = lambda named: [F.lit(None).cast(t).alias(c) for c, t in named.items()]
    id_kind = {"query_id": queries.schema["query_id"].dataType}
    asked = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("__block"), F.lit(0).alias("__side"),
        "query_id", "embedding", *unset(kinds),
    )
    held = gallery.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("__block"), F.lit(1).alias("__side"),
        *unset(id_kind), "embedding", *kinds,
    )
    dealt = asked.unionByName(held).repartitionById(query_blocks, F.col("__block"))

    def run(batches):
        block, own, waiting = None, None, []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("__block", "__side")])
            heads = np.r_[0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, batch.num_rows]
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if a == b:
                    continue
                if marks[0, a] != block:
                    if own:
                        yield from own.close()
                    block, own, waiting = marks[0, a], None, []
                part = batch.slice(a, b - a)
                if not marks[1, a]:
                    waiting.append(part)
                elif own or waiting:
                    if own is None:
                        rows = pa.Table.from_batches(waiting)
                        own, waiting = tally(rows["query_id"].combine_chunks(), blocks.matrix(rows["embedding"])), []
                    yield from own.add(part)
        if own:
            yield from own.close()

    return dealt.sortWithinPartitions("__block", "__side", "identity_ord").mapInArrow(run, schema)


#: Most gallery rows of one product; agreements of a part are counted in bytes.
PART_ROWS = 255


def _slack(vectors: np.ndarray) -> np.ndarray:
    """How far single-precision products of unit queries with these rows may be off."""
    return blocks.SLACK * np.maximum(1.0, np.sqrt(blocks.exact_dots(vectors, vectors)))


def _floats(values: np.ndarray) -> np.ndarray:
    return values.astype(np.float32)


def _runs(values: np.ndarray):
    """``(value, rows)`` of every stretch of equal values."""
    heads = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
    return [(values[a], slice(a, b)) for a, b in zip(heads[:-1], heads[1:]) if a < b]


class _MatchTally:
    """Best positive, agreements and best negative of a block's queries, identity by identity."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, margin: float, part_rows: int):
        self.ids, self.margin, self.part_rows = ids, margin, min(part_rows, PART_ROWS)
        self.unit = blocks.unit_rows(vectors)
        self.identity = None

    def _open(self, identity):
        n = len(self.unit)
        self.identity, self.agree = identity, np.zeros(n, dtype=np.int64)
        self.best, self.negative = np.full(n, -np.inf), np.full(n, -np.inf)

    def add(self, rows: pa.RecordBatch):
        g = _Gallery(rows)
        blocks.same_width(self.unit, g.vectors)
        for identity, at in _runs(g.identity):
            if identity != self.identity:
                yield from self.close()
                self._open(identity)
            for start in range(at.start, at.stop, self.part_rows):
                part = slice(start, min(start + self.part_rows, at.stop))
                for strip in blocks.strips(len(self.unit), part.stop - part.start, 1_000_000):
                    self._meet(strip, g, part)

    def _meet(self, strip: slice, g: _Gallery, part: slice):
        unit = self.unit[strip]
        fits = np.flatnonzero(~g.negative[part]) + part.start
        if len(fits):
            vectors, bound = g.vectors[fits], g.threshold[fits]
            slack = _slack(vectors)
            rough = vectors @ unit.T
            near, sure = (rough >= _floats(bound + by)[:, None] for by in (-slack, slack))
            agree, best = self.agree[strip], self.best[strip]
            agree += np.add.reduce(sure.view(np.uint8), axis=0, dtype=np.uint8)
            top = _floats(np.maximum(rough.max(0), best) - slack.max())
            j, i = np.nonzero(near & (~sure | (rough >= top)))
            score = blocks.exact_dots(unit[i], vectors[j])
            reached = score >= g.threshold[fits[j]]
            np.add.at(agree, i[reached & ~sure[j, i]], 1)
            np.maximum.at(best, i[reached], score[reached])
        against = np.flatnonzero(g.negative[part]) + part.start
        if len(against):
            bound = g.threshold[against] - self.margin - blocks.SLACK
            i, _, score = blocks.pairs_at_least(unit, g.vectors[against], bound)
            np.maximum.at(self.negative[strip], i, score)

    def close(self):
        if self.identity is None:
            return
        row = np.flatnonzero((self.best > -np.inf) | (self.negative > -np.inf))
        if len(row):
            yield _partial_rows(self.ids, {
                "row": row, "identity_ord": np.full(len(row), self.identity), "best": self.best[row],
                "agree": self.agree[row], "negative": self.negative[row],
            }, "match")
        self.identity = None


class _BestTally:
    """The highest positive score of a block's queries and the earliest identity reaching it."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.best, self.owner = np.full(len(vectors), -np.inf), np.full(len(vectors), -1, dtype=np.int64)

    def add(self, rows: pa.RecordBatch):
        score, owner = _best_scores(self.vectors, _Gallery(rows))
        better = (owner >= 0) & ((self.owner < 0) | (score > self.best) | ((score == self.best) & (owner < self.owner)))
        self.best[better], self.owner[better] = score[better], owner[better]
        return ()

    def close(self):
        hit = np.flatnonzero(self.owner >= 0)
        none = np.zeros(len(hit))
        if len(hit):
            yield _partial_rows(self.ids, {
                "row": hit, "identity_ord": self.owner[hit], "best": self.best[hit], "agree": none, "negative": none,
            }, "best")


class _TopTally:
    """The k highest scores of a block's queries, identity by identity."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, part_rows: int):
        self.ids, self.k, self.part_rows = ids, k, min(part_rows, PART_ROWS)
        self.unit = blocks.unit_rows(vectors)
        self.identity = None

    def add(self, rows: pa.RecordBatch):
        vectors = blocks.matrix(rows.column("embedding"))
        blocks.same_width(self.unit, vectors)
        for identity, at in _runs(rows.column("identity_ord").to_numpy()):
            if identity != self.identity:
                yield from self.close()
                self.identity, self.top = identity, np.full((len(self.unit), self.k), -np.inf)
            for start in range(at.start, at.stop, self.part_rows):
                part = vectors[start : min(start + self.part_rows, at.stop)]
                for strip in blocks.strips(len(self.unit), len(part), 1_000_000):
                    self._meet(strip, part)

    def _meet(self, strip: slice, vectors: np.ndarray):
        unit, top = self.unit[strip], self.top[strip]
        rough = unit @ vectors.T
        floor = top[:, -1]
        if len(vectors) > self.k and (floor == -np.inf).any():
            floor = np.maximum(floor, np.partition(rough, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(rough >= _floats(floor - _slack(vectors).max())[:, None])
        if not len(i):
            return
        hit = np.unique(i)
        owner = np.r_[i, np.repeat(hit, self.k)]
        score = np.r_[blocks.exact_dots(unit[i], vectors[j]), top[hit].ravel()]
        order = np.lexsort((-score, owner))
        first = np.searchsorted(owner[order], hit)
        top[hit] = score[order][first[:, None] + np.arange(self.k)]

    def close(self):
        if self.identity is None:
            return
        row, place = np.nonzero(self.top > -np.inf)
        for part in blocks.strips(len(row), 1, 500_000):
            yield pa.RecordBatch.from_arrays(
                [
                    self.ids.take(pa.array(row[part])),
                    pa.array(np.full(len(row[part]), self.identity), pa.int64()),
                    pa.array(self.top[row[part], place[part]]),
                ],
                names=["query_id", "identity_ord", "cosine"],
            )
        self.identity = None


def _partial_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("identity_ord", T.LongType()),
            T.StructField("best", T.DoubleType()),
            T.StructField("agree", T.LongType()),
            T.StructField("negative", T.DoubleType()),
            T.StructField("role", T.StringType()),
        ]
    )


def _match_in_blocks(queries, rules, margin, part_rows, query_blocks):
    tally = lambda ids, vectors: _MatchTally(ids, vectors, margin, part_rows)
    return _meet_in_blocks(queries, rules, tally, _partial_schema(queries), query_blocks)


def _best_in_blocks(queries, rules, query_blocks):
    return _meet_in_blocks(queries, rules, _BestTally, _partial_schema(queries), query_blocks)


def _score_in_parts(queries, rules, margin, want_best, want_match, part_rows):
    """Every query meets the gallery part by part."""
    rows = rules.select("identity_ord", "kind", "embedding", "threshold", F.col("need").cast("bigint").alias("need"))
    slim, query_blocks = queries.select("query_id", "embedding"), _query_blocks(queries)
    partial = []
    if want_match:
        partial.append(_match_in_blocks(slim, rows, margin, part_rows, query_blocks))
    if want_best:
        partial.append(_best_in_blocks(slim, rows, query_blocks))
    return _settled(queries, rules, functools.reduce(DataFrame.unionByName, partial), margin)


class _Ring(_Gallery):
    """Rows of one ring of an index cell."""

    def __init__(self, held: dict[str, np.ndarray]):
        self.vectors, self.identity = held["embedding"], held["identity_ord"]
        self.negative, self.threshold, self.need = held["negative"].astype(bool), held["threshold"], held["need"]


_LOCAL = pa.schema([
    ("query_id", pa.int64()), ("identity_ord", pa.int64()), ("best", pa.float64()), ("agree", pa.int64()),
    ("negative", pa.float64()), ("role", pa.string()),
])


def _partial_rows(ids: pa.Array, p: dict[str, np.ndarray], role: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(p["row"])), pa.array(p["identity_ord"], pa.int64()), pa.array(p["best"], pa.float64()),
            pa.array(p["agree"].astype(np.int64)), pa.array(p["negative"], pa.float64()), pa.array([role] * len(p["row"]), pa.string()),
        ],
        names=["query_id", "identity_ord", "best", "agree", "negative", "role"],
    )


#: Visits up to which the index is used whatever blocks of queries would move.
MANY_VISITS = 2_000_000


def _score_by_index(queries, rules, margin, want_best, want_match, part_rows, gallery_rows):
    """Queries visit only the cells of a metric index that can hold a decisive score.

    The visits are counted first. Where the bounds keep queries out of so few cells that
    visits would move more rows than blocks of queries that meet the whole gallery, those
    are used."""
    schema, key = _partial_schema(queries), ["identity_ord", "kind", "ord"]
    query_blocks = _query_blocks(queries)
    most = max(MANY_VISITS, query_blocks * gallery_rows)
    plain = rules.select("identity_ord", "kind", "embedding", "threshold", F.col("need").cast("bigint").alias("need"))
    cells = 4 * -(-gallery_rows // part_rows)
    negative = F.col("kind") == "hard_negative"
    rows = rules.select(
        *key, negative.alias("negative"), "embedding", "threshold", F.col("need").cast("bigint").alias("need"),
        F.when(negative, F.col("threshold") - margin).otherwise(F.col("threshold")).alias("bound"),
    )
    slim = queries.select("query_id", "embedding")

    def matches(ids, vectors, rings):
        parts = []
        for upper, held in rings:
            at = np.flatnonzero(~(upper < held["bound"].min()))
            found = _partial_matches(vectors[at], _Ring(held), margin)
            parts.append(found | {"row": at[found["row"]]})
        return _partial_rows(ids, {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, "match")

    def bests(ids, vectors, rings):
        length = np.sqrt(blocks.exact_dots(vectors, vectors))
        best, owner = np.full(len(vectors), -np.inf), np.full(len(vectors), -1, dtype=np.int64)
        for upper, held in sorted(rings, key=lambda ring: -ring[0].max()):
            at = np.flatnonzero(~(upper * length < best - blocks.SLACK * length))
            score, own = _best_scores(vectors[at], _Ring(held))
            better = (own >= 0) & ((score > best[at]) | ((score == best[at]) & (own < owner[at])))
            best[at[better]], owner[at[better]] = score[better], own[better]
        hit = np.flatnonzero(owner >= 0)
        none = np.zeros(len(hit))
        return _partial_rows(ids, {"row": hit, "identity_ord": owner[hit], "best": best[hit], "agree": none, "negative": none}, "best")

    partial = []
    if want_match:
        index = metric_index.build(rows, cells, key)
        counts = metric_index.counted(slim, index)
        if sum(counts.values()) <= most:
            routed = metric_index.route(slim, index, metric_index.reaching_bound)
            partial.append(metric_index.meet(routed, index, matches, schema, part_rows, counts))
        else:
            partial.append(_match_in_blocks(slim, plain, margin, part_rows, query_blocks))
    if want_best:
        index = metric_index.build(rows.where("not negative"), cells, key)
        routed = metric_index.route(slim, index, metric_index.promising)
        once = metric_index.counted(slim, index, metric_index.promising)
        first = cut(metric_index.meet(routed, index, bests, schema, part_rows, once))
        floors = first.groupBy("query_id").agg(F.max("best").alias("floor"))
        asked = slim.join(floors, "query_id")
        counts = metric_index.counted(asked, index, metric_index.reaching_floor)
        if sum(counts.values()) <= most:
            routed = metric_index.route(asked, index, metric_index.reaching_floor)
            partial += [first, metric_index.meet(routed, index, bests, schema, part_rows, counts)]
        else:
            partial.append(_best_in_blocks(slim, plain, query_blocks))
    return _settled(queries, rules, functools.reduce(DataFrame.unionByName, partial), margin)


def _settled(queries, rules, partial, margin):
    """One row per query from partial results per (query, identity, role)."""
    limits = rules.select("identity_ord", "threshold", "need").distinct()
    whole = partial.groupBy("query_id", "identity_ord", "role").agg(
        F.max("best").alias("best"), F.sum("agree").alias("agree"), F.max("negative").alias("negative")
    )
    judged = whole.join(limits, "identity_ord")
    passed = (F.col("role") == "match") & (F.col("agree") >= F.col("need")) & (
        F.col("best") >= F.col("threshold")
    ) & (F.col("best") - F.col("negative") >= margin)
    rank = F.struct(F.col("best"), -F.col("identity_ord"))
    top = judged.groupBy("query_id").agg(
        F.max(F.when(F.col("role") == "best", rank)).alias("b"), F.max(F.when(passed, rank)).alias("m")
    )
    found = top.select(
        "query_id",
        (-F.col("b.col2")).alias("best_ord"),
        F.col("b.best").alias("best_cosine"),
        (-F.col("m.col2")).alias("match_ord"),
        F.col("m.best").alias("score"),
    )
    return queries.select("query_id").join(found, "query_id", "left")


def score_queries(
    queries: DataFrame,
    gallery: DataFrame,
    identities: DataFrame | None = None,
    default_threshold: float = settings.DEFAULT_THRESHOLD,
    min_agreements: int = settings.MIN_AGREEMENTS,
    margin: float = settings.HARD_NEGATIVE_MARGIN,
    want_best: bool = True,
    want_match: bool = True,
    broadcast_bytes: int = settings.BROADCAST_BYTES,
    block_rows: int | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """One row per query: unthresholded best cosine, and the accepted identity if any.

    Columns ``query_id, best_identity_id, best_cosine, identity_id, score``; the last
    two are null when no identity is accepted.
    """
    rules = with_rules(gallery, identities, default_threshold, min_agreements)
    size = rules.agg(
        F.count("*").alias("rows"), F.max(F.size("embedding")).alias("width")
    ).first()
    if size["rows"] == 0:
        return queries.select(
            "query_id",
            F.lit(None).cast("string").alias("best_identity_id"),
            F.lit(None).cast("double").alias("best_cosine"),
            F.lit(None).cast("string").alias("identity_id"),
            F.lit(None).cast("double").alias("score"),
        )
    if size["rows"] * size["width"] * 4 <= broadcast_bytes:
        scored = _score_broadcast(queries, rules, margin, want_best, want_match)
    else:
        if block_rows:
            scored = _score_in_parts(queries, rules, margin, want_best, want_match, block_rows)
        else:
            part_rows = part_rows or max(1, broadcast_bytes // (4 * max(1, size["width"])))
            scored = _score_by_index(queries, rules, margin, want_best, want_match, part_rows, size["rows"])
    names = gallery.select("identity_ord", "identity_id").distinct()
    if size["rows"] * size["width"] * 4 <= broadcast_bytes:
        names = F.broadcast(names)  # no more rows than the gallery that was just shipped
    # Queries without an identity get keys of their own below every real one, so that they
    # do not meet in one task.
    spread = F.lit(-1).cast("bigint") - F.pmod(F.xxhash64("query_id"), F.lit(10_007))
    for found, name in (("best_ord", "best_identity_id"), ("match_ord", "identity_id")):
        own = names.select(F.col("identity_ord").alias("__own"), F.col("identity_id").alias(name))
        scored = scored.join(own, F.coalesce(found, spread) == F.col("__own"), "left").drop("__own")
    return scored.select("query_id", "best_identity_id", "best_cosine", "identity_id", "score")


def match(queries: DataFrame, gallery: DataFrame, identities: DataFrame | None = None, **options):
    """Accepted identities only: ``query_id, identity_id, score``."""
    scored = score_queries(queries, gallery, identities, want_best=False, **options)
    return scored.where("identity_id is not null").select("query_id", "identity_id", "score")


def best_cosine(queries: DataFrame, gallery: DataFrame, **options) -> DataFrame:
    """Highest cosine over the whole gallery, without a threshold; null without a gallery."""
    scored = score_queries(queries, gallery, want_match=False, **options)
    return scored.select("query_id", "best_identity_id", "best_cosine")


def should_redact(score, threshold):
    return score >= threshold


def top_k_cosines(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    broadcast_bytes: int = settings.BROADCAST_BYTES,
    block_rows: int | None = None,
    pad: bool = False,
) -> DataFrame:
    """The k highest cosines of each query within each identity, best first; with ``pad``
    always k rows, of minus infinity where an identity has fewer vectors.

    Columns ``query_id, identity_id, rank, cosine``; queries are normalised, gallery
    rows are taken as they are. Each task keeps k scores per (query, identity), and
    the final ranking keeps k before and after its shuffle.
    """
    size = gallery.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("w")).first()
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("identity_ord", T.LongType()),
            T.StructField("cosine", T.DoubleType()),
        ]
    )

    def top(q: pa.Table, g: pa.Table) -> pa.Table:
        unit = blocks.unit_rows(blocks.matrix(q["embedding"]))
        vecs = blocks.matrix(g["embedding"])
        owner = np.asarray(g["identity_ord"].to_numpy(), dtype=np.int64)
        rough = unit @ vecs.T
        rows, owners, scores = [], [], []
        for o in np.unique(owner):
            members = np.nonzero(owner == o)[0]
            part = rough[:, members]
            kth = np.partition(part, -min(k, len(members)), axis=1)[:, -min(k, len(members))]
            i, j = np.nonzero(part >= kth[:, None] - blocks.SLACK)
            s = blocks.exact_dots(unit[i], vecs[members[j]])
            order = np.lexsort((-s, i))
            i, s = i[order], s[order]
            start = np.r_[0, np.nonzero(np.diff(i))[0] + 1]
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            kept = place < k
            rows.append(i[kept]), scores.append(s[kept])
            owners.append(np.full(kept.sum(), o, dtype=np.int64))
        return pa.table(
            {
                "query_id": q["query_id"].combine_chunks().take(pa.array(np.concatenate(rows))),
                "identity_ord": pa.array(np.concatenate(owners), pa.int64()),
                "cosine": pa.array(np.concatenate(scores), pa.float64()),
            }
        )

    rows = gallery.select("identity_ord", "kind", "ord", "embedding")
    if size["n"] * (size["w"] or 0) * 4 <= broadcast_bytes:
        shared = queries.sparkSession.sparkContext.broadcast(rows.toArrow())

        def local(batches):
            for batch in batches:
                if batch.num_rows and shared.value.num_rows:
                    # strips keep the score matrix of a task small
                    strip = max(1, 8_000_000 // shared.value.num_rows)
                    for start in range(0, batch.num_rows, strip):
                        piece = pa.Table.from_batches([batch.slice(start, strip)])
                        yield from top(piece, shared.value).to_batches()

        partial = queries.select("query_id", "embedding").mapInArrow(local, schema)
    else:
        block_rows = block_rows or max(1, broadcast_bytes // (4 * max(1, size["w"])))
        tally = lambda ids, vectors: _TopTally(ids, vectors, k, block_rows)
        slim = queries.select("query_id", "embedding")
        partial = _meet_in_blocks(slim, rows.select("identity_ord", "embedding"), tally, schema, _query_blocks(slim))
    best = Window.partitionBy("query_id", "identity_ord").orderBy(F.desc("cosine"))
    names = gallery.select("identity_ord", "identity_id").distinct()
    ranked = (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .join(names, "identity_ord")
    )
    if pad:  # the last row of fewer than k, of a query id that may be there twice, also stands for what is missing
        ranked = ranked.withColumn("__held", F.count("*").over(Window.partitionBy("query_id", "identity_ord")))
        missing = F.when(
            (F.col("rank") == F.col("__held")) & (F.col("__held") < k), F.sequence(F.col("rank"), F.lit(k))
        ).otherwise(F.array("rank"))
        ranked = ranked.withColumn("__rank", F.explode(missing)).select(
            "query_id", "identity_id", F.col("__rank").cast("int").alias("rank"),
            F.when(F.col("__rank") == F.col("rank"), F.col("cosine")).otherwise(F.lit(float("-inf"))).alias("cosine"),
        )
    return ranked.select("query_id", "identity_id", "rank", "cosine")


def enabled_only(media: DataFrame, meta: DataFrame, identity_count: int | None = None) -> DataFrame:
    """Nothing is processed while protection is off or the list is empty.

    ``meta`` is the state table; its latest revision decides.
    """
    if identity_count == 0:
        return media.limit(0)
    switch = meta.agg(F.max_by("enabled", "revision").alias("__on"))
    return (
        media.withColumn("__one", F.lit(1))
        .join(F.broadcast(switch.withColumn("__one", F.lit(1))), "__one")
        .where("__on")
        .drop("__one", "__on")
    )


def analyse_media(
    media: DataFrame, detections: DataFrame, matches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Regions to redact, and one summary row per medium.

    ``media(media_id, width, height)``, ``detections(media_id, det_ord, query_id, box)``,
    ``matches(query_id, identity_id, score)``. Regions stay one row each, so a medium
    with very many faces is never packed into one value.
    """
    from maskwright.functions import boxes

    seen = media.select("media_id", "width", "height").join(detections, "media_id")
    regions = seen.join(matches, "query_id").select(
        "media_id",
        "det_ord",
        boxes.grow_centered(F.col("box"), F.col("width"), F.col("height")).alias("region"),
        F.col("score").alias("confidence"),
        "identity_id",
    )
    faces = detections.groupBy("media_id").agg(F.count("*").alias("face_count"))
    found = regions.groupBy("media_id").agg(F.count("*").alias("region_count"))
    summary = (
        media.join(faces, "media_id", "left")
        .join(found, "media_id", "left")
        .select(
            "media_id",
            "width",
            "height",
            F.coalesce("face_count", F.lit(0)).alias("face_count"),
            F.coalesce("region_count", F.lit(0)).alias("region_count"),
        )
    )
    return regions, summary
