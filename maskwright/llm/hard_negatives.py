"""Hard negatives by cover trees: for each anchor and positive, the best other-label rows
whose inner product lies in a window below the positive's.

Candidates lie in blocks of one label each, and every block has a cover tree, built once
and written to the checkpoint folder. Vectors get one more component that makes all norms
of a block equal, so inner products are cosines on one sphere. A node stands for its
point and all points below it, which lie within its covering radius; halving radii level by
level, points are dealt to centres that are farther apart than the level's radius. The
angle between an anchor and a node's centre, less or plus the angle of the radius, bounds
the inner products below the node from both sides.

A search descends best first: the node of the highest bound (cut off at the window's upper
end) comes next; nodes whose bounds miss the window, or cannot beat the ``k`` found, are
skipped with all below them. Points are decided by their exact inner product. A label's
positives are searched in its own trees, negatives in all others.

Anchors are a stated query set, shipped in parts of ``part_bytes``: each part meets the
trees where they lie, and a task hands on at most ``k`` rows of an anchor and window.

Components are floor(scale * x), so products are whole numbers, exact in doubles as long as
every squared norm is below 2^53; larger vectors are an error.

Defined cases: rows without an id, a label or a vector, or with a null, NaN or infinite
component, take no part; repeated rows of an id are one, the least by label and vector;
vectors are compared as if shorter ones ended in zeros; ties go to the smaller id; an
anchor without positives, or a positive whose window is empty, has no rows, nor has an empty table;
columns beyond the three named are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.lineage import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH, WHOLE = 50, 95, 100
BLOCK_ROWS = 4096
LEAF_ROWS = 8
PART_BYTES = 8 * 1024 * 1024
_LIMIT = float(1 << 53)
_TREE = "label long, width long, whole boolean, ids binary, points binary, norm double, center binary, first binary, count binary, radius binary"


class CoverTree:
    """A cover tree over the rows of one block, as arrays. Nodes are numbered so that the
    children of one stand in a row; a node of no children is its centre point alone."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, norm: float, center, first, count, radius):
        self.ids, self.points, self.norm = ids, points, norm
        self.center, self.first, self.count, self.radius = center, first, count, radius
        #: Half the angle that a node's points lie around its centre.
        self.angle = 2 * np.arcsin(np.minimum(radius / (2 * norm), 1.0)) if norm else np.zeros(len(radius))

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> CoverTree:
        squares = np.einsum("ij,ij->i", points, points)
        norm = math.sqrt(squares.max())
        wide = np.concatenate((points, np.sqrt(np.maximum(norm * norm - squares, 0))[:, None]), 1)
        span = lambda c, rows: np.sqrt(np.maximum(2 * norm * norm - 2 * (wide[rows] @ wide[c]), 0))
        center, first, count, radius = [0], [0], [0], [0.0]
        waiting = [(0, np.arange(1, len(ids)))]  # a node, and the points below it
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            own = center[node]
            far = span(own, rows)
            radius[node] = float(far.max())
            groups = [(own, rows[:0])]
            if len(rows) < leaf_rows or radius[node] <= 1e-9 * norm:
                groups += [(int(r), rows[:0]) for r in rows]
            else:
                near = far <= radius[node] / 2
                groups[0] = (own, rows[near])
                rest = rows[~near]
                while len(rest):
                    c, rest = int(rest[0]), rest[1:]
                    near = span(c, rest) <= radius[node] / 2
                    groups.append((c, rest[near]))
                    rest = rest[~near]
            first[node], count[node] = len(center), len(groups)
            for c, below in groups:
                waiting.append((len(center), below))
                for held, value in ((center, c), (first, 0), (count, 0), (radius, 0.0)):
                    held.append(value)
        as_int = lambda x: np.array(x, dtype=np.int32)
        return cls(ids, points, norm, as_int(center), as_int(first), as_int(count), np.array(radius))

    def pack(self) -> dict:
        whole = bool((np.abs(self.points) < 1 << 31).all())  # half the bytes
        points = self.points.astype(np.int32) if whole else self.points
        return {
            "width": points.shape[1], "whole": whole, "ids": self.ids.tobytes(), "points": points.tobytes(), "norm": self.norm,
            "center": self.center.tobytes(), "first": self.first.tobytes(), "count": self.count.tobytes(), "radius": self.radius.tobytes(),
        }

    @classmethod
    def unpack(cls, row: dict) -> CoverTree:
        held = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        points = held("points", np.int32 if row["whole"] else np.float64).reshape(-1, row["width"])
        return cls(held("ids", np.int64), points.astype(np.float64), row["norm"], *(held(n, np.int32) for n in ("center", "first", "count")), held("radius", np.float64))


class Search:
    """One anchor in one tree; what is worked out about nodes serves all its windows."""

    def __init__(self, tree: CoverTree, query: np.ndarray, skip_id: int | None = None):
        self.tree, self.query, self.skip_id = tree, query, skip_id
        self.size = math.sqrt(float(query @ query))
        self.opened: dict[int, tuple] = {}
        self.visited = 0
        self.root = self._bounds(np.array([0]))

    def _bounds(self, nodes: np.ndarray):
        """Exact products with the nodes' centres, and bounds on those with all below."""
        tree = self.tree
        exact = tree.points[tree.center[nodes]] @ self.query
        self.visited += len(nodes)
        scale = self.size * tree.norm
        if not scale:
            return nodes, exact, exact, exact
        angle = np.arccos(np.clip(exact / scale, -1.0, 1.0))
        slack = 1e-7 * scale
        alone = tree.count[nodes] == 0
        upper = scale * np.cos(np.maximum(angle - tree.angle[nodes], 0.0)) + slack
        lower = scale * np.cos(np.minimum(angle + tree.angle[nodes], np.pi)) - slack
        upper, lower = np.where(alone, exact, upper), np.where(alone, exact, lower)
        order = np.argsort(-upper, kind="stable")
        return nodes[order], exact[order], upper[order], lower[order]

    def _children(self, node: int):
        if node not in self.opened:
            first = int(self.tree.first[node])
            self.opened[node] = self._bounds(np.arange(first, first + int(self.tree.count[node])))
        return self.opened[node]

    def best(self, k: int, low: float, high: float, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The ``k`` rows of the highest product within [low, high], ties to the smaller id,
        as (product, -id) in falling order; ``found`` are rows of other trees."""
        top = sorted(found)  # a heap: the least of the k best first
        heap: list[tuple] = []
        serial = 0

        def push(level: tuple, live: np.ndarray, at: int) -> None:
            """The next node of a level; its live ones fall by upper bound."""
            nonlocal serial
            if at < len(live):
                heapq.heappush(heap, (-min(float(level[2][live[at]]), high), serial, at, live, level))
                serial += 1

        def enter(level: tuple) -> None:
            """Nodes of a level that can hold a row."""
            least = max(low, top[0][0]) if len(top) == k else low
            push(level, np.flatnonzero((level[2] >= least) & (level[3] <= high)), 0)

        enter(self.root)
        while heap:
            bound, _, at, live, level = heapq.heappop(heap)
            if len(top) == k and -bound < top[0][0]:
                break
            place = live[at]
            node = int(level[0][place])
            if self.tree.count[node]:
                enter(self._children(node))
            elif low <= level[1][place] <= high and (own := int(self.tree.ids[self.tree.center[node]])) != self.skip_id:
                row = (int(level[1][place]), -own)
                if len(top) < k:
                    heapq.heappush(top, row)
                elif row > top[0]:
                    heapq.heapreplace(top, row)
            push(level, live, at + 1)
        return sorted(top, reverse=True)


def usable(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, relabel: Column | None = None) -> DataFrame:
    """``(id, label, v)``: one row per id, with whole components as doubles."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
        .select(F.col(key).cast("long").alias("id"), (F.col(label) if relabel is None else relabel).cast("long").alias("label"), v.alias("v"))
        .groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    )


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows, shorter ones ending in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(out) and not (np.einsum("ij,ij->i", out, out) < _LIMIT).all():
        raise ValueError("a vector is too long for exact products: its squared norm must be below 2^53")
    return out


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def trees(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per block of up to ``block_rows`` rows of one label and partition."""
    names = [c.split()[0] for c in _TREE.split(", ")]

    def made(label, ids, points):
        tree = CoverTree.build(ids, points).pack() | {"label": label}
        return pa.RecordBatch.from_pydict({n: [tree[n]] for n in names})

    def run(batches):
        label, ids, points = None, [], []
        for batch in batches:
            labels = batch.column("label").to_numpy()
            own, matrix = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            heads = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                while a < b:
                    held = sum(map(len, ids))
                    if held and (labels[a] != label or held >= block_rows):
                        yield made(label, np.concatenate(ids), _stack(points))
                        ids, points, held = [], [], 0
                    label, take = int(labels[a]), min(b - a, block_rows - held)
                    ids.append(own[a : a + take])
                    points.append(matrix[a : a + take])
                    a += take
        if ids:
            yield made(label, np.concatenate(ids), _stack(points))

    return rows.sortWithinPartitions("label", "id").mapInArrow(run, ", ".join(_TREE.split(", ")))


def search(forest: DataFrame, anchors: DataFrame, same_label: bool, k: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(anchor_id, wanted, other_id, score)``: of every ``anchors(id, label, v, wanted)``
    row and each of its ``wanted(low, high)`` windows, the ``k`` best rows of a task's trees
    of the same label, or of the others; the best of all are among them."""
    spark = forest.sparkSession
    size = anchors.agg(F.sum(F.size("v") * 8 + F.size("wanted") * 16 + 64).alias("bytes")).first().bytes or 0
    parts = max(1, math.ceil(size / part_bytes))
    found = None
    for part in range(parts):
        here = anchors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        asked = here.select("id", "label", "v", "wanted").toArrow().combine_chunks()
        got = cut(forest.mapInArrow(_searcher(spark.sparkContext.broadcast(asked), same_label, k), "anchor_id long, low long, high long, other_id long, score long"))
        found = got if found is None else found.unionByName(got)
    best = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _searcher(held, same_label: bool, k: int):
    def run(batches):
        ids, labels = (held.value.column(c).to_pylist() for c in ("id", "label"))
        vectors = _matrix(held.value.column("v").chunk(0)) if len(ids) else np.zeros((0, 0))
        wanted = [[(w["low"], w["high"]) for w in own] for own in held.value.column("wanted").to_pylist()]
        found: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tree = CoverTree.unpack(row)
                shared = min(row["width"], vectors.shape[1])
                for own, label, vector, windows in zip(ids, labels, vectors, wanted):
                    if (label == row["label"]) != same_label:
                        continue
                    query = np.zeros(row["width"])
                    query[:shared] = vector[:shared]
                    one = Search(tree, query, own)
                    for low, high in windows:
                        if better := one.best(k, low, high, found.get((own, low, high), [])):
                            found[own, low, high] = better
        rows = [(*key, -other, score) for key, best in found.items() for score, other in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
            names=["anchor_id", "low", "high", "other_id", "score"],
        )

    return run


def mine(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, whole: int = WHOLE, block_rows: int = BLOCK_ROWS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of
    ``usable`` rows: anchors are those for which ``anchor`` (over ``id`` and ``label``) holds.
    A negative's score lies between ``low`` and ``high`` parts of ``whole`` of the positive's."""
    forest = cut(trees(rows, block_rows))
    anchors = cut(rows.where(anchor))
    any_score = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    first = search(forest, anchors.withColumn("wanted", any_score), True, positives, part_bytes)
    first = cut(first.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    least, most = f"positive_score * {low}", f"positive_score * {high}"
    asked = first.withColumns({  # rounded up and down to whole scores
        "low": F.expr(f"({least} + pmod(-({least}), {whole})) div {whole}"), "high": F.expr(f"({most} - pmod({most}, {whole})) div {whole}"),
    }).where("low <= high")
    wanted = asked.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set(F.struct("low", "high")).alias("wanted"))
    second = search(forest, anchors.join(wanted, "id"), False, negatives, part_bytes)
    return asked.join(second, ["anchor_id", "low", "high"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def oracle() -> str:
    """The query in DuckDB's SQL, all anchors against all rows."""
    return f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score
  FROM r a JOIN r o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= {WHOLE} * score AND {WHOLE} * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
