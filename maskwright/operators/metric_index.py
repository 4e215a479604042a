"""Exact matching against a large gallery through a metric index.

Gallery rows go to the cell of their nearest pivot; a cell knows the widest angle between
its rows and its pivot, their shortest and longest norm, and the least score that decides
anything there. By the triangle inequality on angles no row of a cell can score higher
with a query than the cosine of what is left of the angle to the pivot, so a query visits
only cells that can still reach their bound, and inside a cell only those rings of rows
(sorted by their angle) that can. What is skipped cannot hold a decisive score, hence
results are those of a scan.

Pivots and cell figures are tables of at most ``MAX_CELLS`` rows. Cells larger than a task's
share are hashed into parts that share the figures; queries that crowd into one cell are
spread over copies of it. A task keeps one part of a cell in memory and streams its queries.

The best cosine has no threshold; it is found in two visits: the most promising cell first,
then those cells that could hold more than was found there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.lineage import cut
from maskwright.operators import blocks

MAX_CELLS = 1024
RING_ROWS = 1024
QUERY_ROWS = 200_000
#: Angles between rows and pivots that a task holds at once, and visits of one batch it hands on.
ANGLES, VISITS = 500_000, 16_384


@dataclass
class Index:
    """``rows`` with ``cell``, ``angle`` and ``bound``; one entry per cell in the arrays."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    norms: np.ndarray
    bound: np.ndarray
    sizes: np.ndarray

    def upper(self, unit: np.ndarray) -> np.ndarray:
        """The highest score each query can have in each cell."""
        angle = angles(unit, self.pivots)
        return highest(np.maximum(angle - self.radius - blocks.ANGLE_SLACK, 0), *self.norms) + blocks.SLACK


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between unit rows and pivots; rows of no length are at right angles to all."""
    return np.arccos(np.clip(unit.astype(np.float64) @ pivots.T, -1, 1))


def highest(angle: np.ndarray, shortest, longest) -> np.ndarray:
    """The highest product with a unit vector at ``angle`` or more."""
    c = np.cos(angle)
    return np.where(c >= 0, longest * c, shortest * c)


def build(rows: DataFrame, cells: int, key: list[str]) -> Index:
    """The index of ``rows(*key, identity_ord, negative, embedding, threshold, need, bound)``.

    Pivots are the ``cells`` rows of the lowest hash of ``key``; ``bound`` is the least
    score that matters for a row."""
    cells = max(1, min(cells, MAX_CELLS))
    chosen = rows.orderBy(F.xxhash64(*key), *key).limit(cells).select("embedding").toArrow()
    pivots = blocks.unit_rows(blocks.matrix(chosen["embedding"])).astype(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    fields = [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("norm", T.DoubleType())]

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = blocks.matrix(batch.column("embedding"))
            unit = blocks.unit_rows(vectors)
            cell, angle = np.zeros(len(unit), dtype=np.int32), np.zeros(len(unit))
            for strip in blocks.strips(len(unit), len(shared.value), ANGLES):
                apart = angles(unit[strip], shared.value)
                cell[strip], angle[strip] = apart.argmin(1), apart.min(1)
            norm = np.sqrt(blocks.exact_dots(vectors, vectors))
            columns = [cell, np.where(norm > 0, angle, 0.0), norm]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], names=[*batch.schema.names, "cell", "angle", "norm"])

    rows = rows.withColumn("deal", F.xxhash64(*key))
    placed = cut(rows.mapInArrow(place, T.StructType([*rows.schema.fields, *fields])))
    figures = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("norm").alias("shortest"),
        F.max("norm").alias("longest"), F.min("bound").alias("bound"),
    ).orderBy("cell").collect()
    held = np.array([r.cell for r in figures], dtype=np.int64)
    numbers = F.create_map(*[F.lit(int(x)) for place in enumerate(held) for x in place[::-1]])
    renumbered = placed.withColumn("cell", F.element_at(numbers, F.col("cell")).cast("int"))
    column = lambda name: np.array([r[name] for r in figures], dtype=np.float64)
    return Index(
        renumbered, pivots[held], column("radius"), np.stack([column("shortest"), column("longest")]), column("bound"),
        column("n").astype(np.int64),
    )


def reaching_bound(index: Index, upper: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
    """Visit every cell where a score can decide anything."""
    return ~(upper < index.bound)


def promising(index: Index, upper: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
    """Visit the one cell where the score can be highest."""
    return np.arange(upper.shape[1]) == upper.argmax(1)[:, None]


def reaching_floor(index: Index, upper: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
    """Visit the other cells that can beat or equal ``floor``, a product reached with the
    query as it is, at its own length."""
    vectors = blocks.matrix(part.column("embedding"))
    length = np.sqrt(blocks.exact_dots(vectors, vectors))[:, None]
    floor = part.column("floor").to_numpy(zero_copy_only=False)[:, None]
    return ~(upper * length < floor - blocks.SLACK * length) & ~promising(index, upper, part)


def _visiting(queries: DataFrame, index: Index, visits):
    """``run(batch)`` for tasks: parts of the batch with the queries and the cells they visit."""
    held = queries.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.norms, index.bound, index.sizes))

    def run(batch: pa.RecordBatch):
        here = Index(None, *held.value)
        for strip in blocks.strips(batch.num_rows, len(here.sizes), ANGLES):
            part = batch.slice(strip.start, strip.stop - strip.start)
            upper = here.upper(blocks.unit_rows(blocks.matrix(part.column("embedding"))))
            yield part, *np.nonzero(visits(here, upper, part))

    return run


def route(queries: DataFrame, index: Index, visits) -> DataFrame:
    """``(query_id, embedding, cell)`` of every cell that a query visits."""
    visiting, names = _visiting(queries, index, visits), ["query_id", "embedding"]
    schema = T.StructType([*(queries.schema[c] for c in names), T.StructField("cell", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part, i, cell in visiting(batch):
                for some in blocks.strips(len(i), 1, VISITS):
                    at = pa.array(i[some])
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(at) for c in names), pa.array(cell[some].astype(np.int32))], names=[*names, "cell"]
                    )

    return queries.mapInArrow(run, schema)


def visits(queries: DataFrame, index: Index, reaching=reaching_bound) -> DataFrame:
    """``(cell, queries)``: how many queries visit each cell; cells without one are left out.
    A task counts them without laying out a row for every visit."""
    visiting, cells = _visiting(queries, index, reaching), len(index.sizes)

    def run(batches):
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for _, _, cell in visiting(batch):
                total += np.bincount(cell, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "queries"])

    return queries.mapInArrow(run, "cell int, queries long").groupBy("cell").agg(F.sum("queries").alias("queries"))


def counted(queries: DataFrame, index: Index, reaching=reaching_bound) -> dict[int, int]:
    """How many queries visit each cell."""
    return {r.cell: r.queries for r in visits(queries, index, reaching).collect()}


def meet(
    routed: DataFrame, index: Index, work, schema: T.StructType, part_rows: int, counts: dict[int, int],
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``work(query ids, queries, rings)`` for every part of a cell and the queries there.

    ``rings`` are pairs of the highest score each unit query can have in a ring, and the
    ring's rows as a dict of arrays."""
    plan = [(int(c), int(-(-index.sizes[c] // part_rows)), -(-n // query_rows)) for c, n in counts.items()]
    planned = F.broadcast(routed.sparkSession.createDataFrame(plan, "cell int, __parts int, __copies int"))
    spots = ["cell", "__part", "__copy"]
    id_type = routed.schema["query_id"].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = routed.join(planned, "cell").withColumn("__copy", F.pmod(F.xxhash64("query_id"), F.col("__copies")).cast("int")).withColumn(
        "__part", every("__parts")
    ).select(*spots, F.lit(1).alias("__side"), "query_id", "embedding", *(F.lit(None).cast(t).alias(c) for c, t in _TYPES.items()))
    held = index.rows.join(planned, "cell").withColumn("__part", F.pmod(F.col("deal"), F.col("__parts")).cast("int")).withColumn(
        "__copy", every("__copies")
    ).select(*spots, F.lit(0).alias("__side"), F.lit(None).cast(id_type).alias("query_id"), "embedding", *(F.col(c).cast(t).alias(c) for c, t in _TYPES.items()))
    pivots = routed.sparkSession.sparkContext.broadcast(index.pivots)
    together = held.unionByName(ask).repartition(*spots).sortWithinPartitions(*spots, "__side", "angle")

    def run(batches):
        key, rows, rings = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in [*spots, "__side"]])
            heads = np.concatenate(([0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(marks[:3, a]) != key:
                    key, rows, rings = tuple(marks[:3, a]), [], None
                if not marks[3, a]:
                    rows.append(part)
                elif rows or rings:
                    rings = rings or _rings(rows, pivots.value[key[0]])
                    rows = []
                    for strip in blocks.strips(part.num_rows, RING_ROWS * 4):
                        asked = part.slice(strip.start, strip.stop - strip.start)
                        vectors = blocks.matrix(asked.column("embedding"))
                        yield work(asked.column("query_id"), vectors, rings.reachable(blocks.unit_rows(vectors)))

    return together.mapInArrow(run, schema)


_TYPES = {"identity_ord": "bigint", "negative": "boolean", "threshold": "double", "need": "bigint", "angle": "double", "norm": "double", "bound": "double"}


class _Rings:
    """Rows of a part of a cell, by rising angle, in stretches of ``RING_ROWS``."""

    def __init__(self, table: pa.Table, pivot: np.ndarray):
        self.pivot = pivot[None]
        self.stretches = []
        for start in range(0, table.num_rows, RING_ROWS):
            part = table.slice(start, RING_ROWS)
            held = {c: part[c].to_numpy() for c in _TYPES}
            held["embedding"] = blocks.matrix(part["embedding"])
            self.stretches.append(held)

    def reachable(self, unit: np.ndarray):
        angle = angles(unit, self.pivot)[:, 0]
        for held in self.stretches:
            low, high = held["angle"][0] - blocks.ANGLE_SLACK, held["angle"][-1] + blocks.ANGLE_SLACK
            left = np.maximum(np.maximum(angle - high, low - angle), 0)
            upper = highest(left, held["norm"].min(), held["norm"].max()) + blocks.SLACK
            yield upper, held


def _rings(rows: list[pa.RecordBatch], pivot: np.ndarray) -> _Rings:
    return _Rings(pa.Table.from_batches(rows).combine_chunks(), pivot)
