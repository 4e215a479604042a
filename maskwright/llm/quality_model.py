"""Quality classifier: random-indexing word vectors, pooled per document, then a small net.

Random indexing gives every word a fixed sparse random vector; a word's context vector is
the sum of the random vectors of the words up to ``SPAN`` places away, over all documents.
Words are hashed into ``WORDS`` slots, so the context table has a fixed size. Tasks add
up their own table and send it once, in slices; slices are summed in two salted rounds.

A document is the mean and spread of its words' centred unit vectors. A two-layer numpy
network is trained on at most ``MAX_ROWS`` labelled rows, taken in hash order of their ids,
and its scores are calibrated by a temperature fitted on a fifth of them.

Defined cases: null and empty texts pool to zeros and are scored as such; labels that are
null or have no document are not learned from; several labels of one id count as their
largest; without both classes among the labels every score is the share of ones (0.5
without any). Words are runs of letters, of digits or of other visible bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import textbytes as tb

WORDS = 1 << 14
WIDTH = 48
NONZERO = 8
SPAN = 2
MAX_ROWS = 8000
HIDDEN = 24
ROUNDS = 250
SLICES = 16
SALTS = 16
GOOD = 0.7

_KIND = np.array(
    [
        0 if b == 0x20 or 0x09 <= b <= 0x0D
        else 1 if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
        else 2 if 0x30 <= b <= 0x39
        else 3
        for b in range(256)
    ],
    dtype=np.int8,
)


def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every word, and the number of words before each text."""
    data, bounds = tb.flatten(texts)
    kind = _KIND[data]
    change = np.ones(len(data), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[bounds[bounds < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    hashes = tb.span_hashes(tb.prefix_sums(data), starts, ends)
    return (hashes % np.uint64(WORDS)).astype(np.int64), np.searchsorted(starts, bounds)


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS, WIDTH), dtype=np.int32)
    for row in range(WORDS):
        out[row, rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def _add_contexts(table: np.ndarray, vectors: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> None:
    """Add what the words of one block see to ``table``, whose last column counts words."""
    if not len(words):
        return
    text = tb.row_of(firsts)
    seen = np.zeros((len(words), WIDTH), dtype=np.int32)
    own = vectors[words]
    for gap in range(1, SPAN + 1):
        near = (text[gap:] == text[:-gap])[:, None]
        seen[gap:] += own[:-gap] * near
        seen[:-gap] += own[gap:] * near
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1])))
    table[sorted_words[heads], :WIDTH] += np.add.reduceat(seen[order], heads, axis=0)
    table[:, WIDTH] += np.bincount(words, minlength=WORDS)


def _sum_slices(batches):
    """One row per slice: the sum of the slices of a partition, in constant memory."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
            values = np.frombuffer(raw, dtype=np.int64)
            sums[part] = values + sums[part] if part in sums else values
    if sums:
        yield pa.RecordBatch.from_pylist([{"part": k, "sums": v.tobytes()} for k, v in sums.items()],
                                         schema=pa.schema([("part", pa.int32()), ("sums", pa.binary())]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Centred unit context vectors of all slots, gathered over every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(index_vectors())

    def run(batches):
        table = np.zeros((WORDS, WIDTH + 1), dtype=np.int64)
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                _add_contexts(table, held.value, *slots(part.column("text")))
        yield pa.RecordBatch.from_pylist(
            [{"part": k, "sums": piece.tobytes()} for k, piece in enumerate(np.split(table, SLICES))],
            schema=pa.schema([("part", pa.int32()), ("sums", pa.binary())]),
        )

    kind = "part int, sums binary"
    partial = docs.select("text").mapInArrow(run, kind)
    salted = partial.repartition(SLICES * SALTS, "part", F.spark_partition_id() % SALTS).mapInArrow(_sum_slices, kind)
    total = salted.repartition(SLICES, "part").mapInArrow(_sum_slices, kind)
    table = np.zeros((WORDS, WIDTH + 1), dtype=np.int64)
    for row in total.collect():  # SLICES rows of fixed size
        table.reshape(SLICES, -1)[row.part] += np.frombuffer(bytes(row.sums), dtype=np.int64)
    contexts = table[:, :WIDTH].astype(np.float64)
    counts = table[:, WIDTH].astype(np.float64)
    contexts /= np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)
    centre = (contexts * counts[:, None]).sum(0) / max(counts.sum(), 1.0)
    contexts[counts > 0] -= centre
    contexts /= np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)
    return contexts.astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors, length of the mean, log word count."""
    words, firsts = slots(texts)
    n = np.diff(firsts)
    out = np.zeros((len(n), 2 * WIDTH + 2), dtype=np.float32)
    some = np.flatnonzero(n)
    if len(some):
        own = vectors[words]
        mean = np.add.reduceat(own, firsts[some], axis=0) / n[some, None]
        square = np.add.reduceat(own * own, firsts[some], axis=0) / n[some, None]
        out[some, :WIDTH] = mean
        out[some, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, -2] = np.linalg.norm(mean, axis=1)
        out[some, -1] = np.log1p(n[some])
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.centre) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(0), np.ones(0), [], 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    check = np.zeros(len(y), dtype=bool)
    check[::5] = True
    learn = ~check if y[~check].min() != y[~check].max() else np.ones(len(y), dtype=bool)
    centre, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    z, t = (x[learn] - centre) / scale, y[learn].astype(np.float64)
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))  # both classes count alike
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, ROUNDS + 1):
        h = np.tanh(z @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -60, 60)))
        g = weight * (p - t) / len(t)
        back = np.outer(g, w[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum()]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            w[k] = w[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre.astype(np.float32), scale.astype(np.float32), w, 1.0)
    held, truth = net.logits(x[check]), y[check]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    losses = [np.logaddexp(0, np.where(truth == 1, -held, held) / t).mean() for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Word vectors over all ``docs(doc_id, text)``; the network from a sample of ``labels``."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("__label"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    held = spark.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                rows = pool(part.column("text"), held.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("__label"), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "label", "pooled"],
                )

    pooled = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", F.col("__label").cast("int"))
        .mapInArrow(run, "doc_id long, label int, pooled binary")
    )
    rows = sorted((r.doc_id, r.label, bytes(r.pooled)) for r in pooled.orderBy(F.xxhash64("doc_id"), "pooled").limit(max_rows).collect())
    x = np.array([np.frombuffer(p, dtype=np.float32) for _, _, p in rows])
    return Model(vectors, _train(x, np.array([int(y) for _, y, _ in rows])))


def score(docs: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; a map over the rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    schema = tb.schema(kept.schema.fields, "score double, predicted int")

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                found = held.value.network.score(pool(part.column("text"), held.value.vectors)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found), pa.array((found >= good).astype(np.int32))],
                    names=[*part.schema.names, "score", "predicted"],
                )

    return kept.mapInArrow(run, schema)
