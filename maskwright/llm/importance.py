"""Importance resampling towards a target: hashed n-gram gains and a Gumbel top-k draw.

Texts are lower-cased (A-Z) and split by a tokenizer library's Regex Split, which returns
words with their offsets; nothing is trained. Words stand one blank apart, and every window
of one or two neighbouring words is the stretch between the first word's start and the last
word's end. A window's bucket is the CRC-32 of its bytes modulo ``buckets``. Histograms of
the corpus and of the target give each bucket a gain, a document's weight is the floored
mean of its windows' gains, and a Gumbel term seeded by ``seed:doc_id`` is added; the
highest scores are drawn, which samples without replacement by weight.

Texts are split once; the windows' buckets are written, some two thirds of the text's
bytes. A task hands on one histogram, whose size is fixed. Scores are whole numbers of a narrow
range (logarithms of 64-bit counts), so ranks come from the counts per score and a window
inside each drawn score; no task sees all documents.

Defined cases: a null or text without words has no features and weight zero; a very long
word or text is one document like any other; repeated rows are features, and drawn, each; a
row without an id has the seed text ``seed:`` and comes after all ids among ties; an empty
corpus gives no rows, an empty target only negative or equal gains; columns named like an
added one are replaced, all others pass through.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from maskwright.lineage import cut
from maskwright.llm import textbytes as tb

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_WORDS = 2
BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25


class Features:
    """The windows of a text as buckets."""

    def __init__(self, buckets: int, n_words: int):
        self.split = pre_tokenizers.Split(Regex(WORDS), behavior="removed", invert=True)
        self.buckets, self.n_words = buckets, n_words

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Words of the text, and the bucket of every window."""
        found = self.split.pre_tokenize_str(text.encode().lower().decode()) if text else []
        if not found:
            return 0, np.zeros(0, dtype=np.int64)
        words = [word.encode() for word, _ in found]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        ends, row, crc = ends.tolist(), memoryview(b" ".join(words)), zlib.crc32
        hashes = [crc(row[a:b]) for n in range(self.n_words) for a, b in zip(starts, ends[n:])]
        return len(words), np.array(hashes, dtype=np.int64) % self.buckets


def featured(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, n_words: int = N_WORDS) -> DataFrame:
    """``docs`` without the text, with ``n_words`` and ``features``, the buckets of all
    windows as 32-bit numbers, or 16-bit ones if they fit. Texts are split here only."""
    kept = docs.drop("n_words", "features")
    fields = [f for f in kept.schema if f.name != text]

    def run(batches):
        windows, kind = Features(buckets, n_words), _kind(buckets)
        for batch in batches:
            for part in tb.blocks(batch, text):
                rows = [windows.of(value.as_py()) for value in part.column(text)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(f.name) for f in fields), pa.array([n for n, _ in rows], pa.int64()),
                        pa.array([found.astype(kind).tobytes() for _, found in rows], pa.binary()),
                    ],
                    names=[*(f.name for f in fields), "n_words", "features"],
                )

    return kept.mapInArrow(run, tb.schema(fields, "n_words long, features binary"))


def _kind(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: windows per bucket, over all ``featured`` rows; empty buckets have
    no row."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), _kind(buckets)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of a nat that each bucket is likelier in the target than in the corpus,
    with one more of every bucket on both sides. Two tables of ``buckets`` rows at most."""
    counts = []
    for side in (corpus, target):
        held = np.zeros(buckets, dtype=np.int64)
        for row in side.collect():
            held[row.bucket] = row.n
        counts.append(held)
    s, t = counts
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist())],
        dtype=np.int64,
    )


def noise(seed: int = SEED, key: str = "doc_id") -> Column:
    """The Gumbel term of a document, the same whenever and wherever it is worked out."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` rows with ``n_features`` and ``weight`` in place of the features."""
    kept = found.drop("n_features", "weight")
    fields = [f for f in kept.schema if f.name != "features"]
    held = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        table = held.value
        for batch in batches:
            rows = [np.frombuffer(value.as_py(), _kind(len(table))) for value in batch.column("features")]
            weight = [int(table[r].sum()) // len(r) if len(r) else 0 for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array([len(r) for r in rows], pa.int64()), pa.array(weight, pa.int64())],
                names=[*(f.name for f in fields), "n_features", "weight"],
            )

    return kept.mapInArrow(run, tb.schema(fields, "n_features long, weight long"))


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``weighed`` with ``score``, and ``rank`` 1, 2, 3... of the drawn rows: the highest
    ``percent`` of the rows of at least ``min_words`` words, ties to the smaller id."""
    scored = cut(weighed.drop("score", "rank").withColumn("score", F.col("weight") + noise(seed, key)))
    long_enough = F.col("n_words") >= min_words
    counts = scored.where(long_enough).groupBy("score").agg(F.count("*").alias("n"))
    rows = sorted(((r.score, r.n) for r in counts.collect()), reverse=True)  # a row per score value
    left = percent * sum(n for _, n in rows) // 100
    drawn, before = [], 0
    for score, n in rows:
        if left <= before:
            break
        drawn.append((score, before, min(n, left - before)))
        before += n
    offsets = scored.sparkSession.createDataFrame(drawn, "__score long, __before long, __room long")
    order = Window.partitionBy("score").orderBy(F.col(f"`{key}`").asc_nulls_last())
    chosen = long_enough & F.col("__score").isNotNull()
    met = scored.join(F.broadcast(offsets), F.col("score") == F.col("__score"), "left")
    inside = met.where(chosen).withColumn("__place", F.row_number().over(order)).withColumn(
        "rank", F.when(F.col("__place") <= F.col("__room"), F.col("__before") + F.col("__place"))
    )
    outside = met.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    names = [f"`{c}`" for c in [*scored.columns, "rank"]]
    return inside.select(*names).unionByName(outside.select(*names))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS, n_words: int = N_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank``, the place of the drawn ones in the order of the draw."""
    found = cut(featured(docs, text, buckets, n_words))
    wanted = featured(target.select(F.col(f"`{text}`")), text, buckets, n_words)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets), buckets)
    return draw(weigh(found, gain), percent, min_words, seed, key)


def oracle() -> str:
    """The report in DuckDB's SQL, with CRC-32 by its table of 256 remainders."""
    words = WORDS.replace("'", "''")
    return f"""
WITH RECURSIVE bits AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
remainders AS (SELECT list(c ORDER BY b) AS held FROM bits WHERE k = 8),
texts AS (
  SELECT 's' AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark
),
split AS (
  SELECT side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}') AS w FROM texts
),
grams AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM split
),
counted AS (SELECT side, doc_id, gram, count(*) AS n FROM grams GROUP BY ALL),
crcs AS (
  SELECT gram,
    xor(list_reduce(
      [4294967295::BIGINT] || list_transform(range(1, 2 * strlen(gram), 2), lambda i: ('0x' || substr(hex(gram), i, 2))::BIGINT),
      lambda a, b: xor(a >> 8, held[xor(a & 255, b) + 1])
    ), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT gram FROM counted), remainders
),
used AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS t
  FROM counted JOIN crcs USING (gram) GROUP BY bucket
),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM used, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM used)
),
summed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN crcs USING (gram) JOIN gain USING (bucket) WHERE side = 's' GROUP BY doc_id
),
scored AS (
  SELECT s.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || s.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split s LEFT JOIN summed USING (doc_id) WHERE side = 's'
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS}
)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
