"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one linear classifier per code position
predicts that bit from byte n-grams of the letters. Decoding sums the logistic loss of all
bits against each codeword and takes the nearest; the runner-up's distance flags texts
that lie between two languages.

Learning uses a bounded sample: for each language the ``per_language`` training rows that
come first by a hash of id and text, at most ``max_rows`` in all. Prediction reads
every whole text and nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any
training row every text is ``und``; rows with a null id or null language are not learned
from; repeated rows are predicted one by one.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm import textbytes as tb

FEATURES = 4096
PER_LANGUAGE = 500
MAX_ROWS = 4000
RIDGE = 1e-3
PROFILE_ROWS = 256
AMBIGUOUS = 0.15
UNDETERMINED = "und"

# Letters are lower-cased, other ASCII bytes become one separator value.
_LETTERS = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)],
    dtype=np.uint8,
)
_HAS_ASCII = tb.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 per class. Up to six classes get every distinct split of the
    classes; more get random splits, with the rows kept far apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=float).T
    bits = int(np.ceil(10 * np.log2(classes)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        if (nearest := (bits - agree.max()) / 2) > apart and (np.abs(code.sum(0)) < classes).all():
            best, apart = code, nearest
    return best if best is not None else code


def profiles(texts: pa.Array, features: int = FEATURES) -> np.ndarray:
    """One unit row per text: square roots of the shares of its hashed byte trigrams."""
    data, bounds = tb.flatten(texts)
    n = len(bounds) - 1
    out = np.zeros((n, features), dtype=np.float32)
    if len(data) < 3:
        return out
    low = _LETTERS[data].astype(np.uint32)
    slots = (low[:-2] * np.uint32(2654435761) ^ low[1:-1] * np.uint32(2246822519) ^ low[2:] * np.uint32(3266489917))
    slots = ((slots ^ (slots >> np.uint32(15))) % np.uint32(features)).astype(np.int64)
    used = (low[:-2] != 0x20) | (low[1:-1] != 0x20)
    for row in range(n):
        a, b = bounds[row], max(bounds[row], bounds[row + 1] - 2)
        counts = np.bincount(slots[a:b][used[a:b]], minlength=features)
        total = counts.sum()
        if total:
            out[row] = np.sqrt(counts / total)
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    data, bounds = tb.flatten(texts)
    ascii_letters = np.concatenate(([0], np.cumsum(_HAS_ASCII[data])))
    found = ascii_letters[bounds[1:]] > ascii_letters[bounds[:-1]]
    for row in np.flatnonzero(~found & (bounds[1:] > bounds[:-1])):
        found[row] = any(c.isalpha() for c in texts[int(row)].as_py())
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: float

    def predict(self, texts: pa.Array, ambiguous: float) -> pd.DataFrame:
        n = len(texts)
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * n, "score": np.zeros(n), "ambiguous": np.ones(n, bool)})
        strips = [texts.slice(at, PROFILE_ROWS) for at in range(0, n, PROFILE_ROWS)]
        products = [profiles(s, len(self.weights) - 1) @ self.weights[:-1] for s in strips]
        margins = (np.concatenate(products) + self.weights[-1]) * self.scale
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        likely = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / likely.sum(1)
        first = order[:, 0]
        rows = np.arange(n)
        close = np.zeros(n, bool)
        if len(self.languages) > 1:
            close = (loss[rows, order[:, 1]] - loss[rows, first]) / self.code.shape[1] < ambiguous
        known = has_letter(texts)
        return pd.DataFrame({
            "lang_pred": np.where(known, np.array(self.languages, dtype=object)[first], UNDETERMINED),
            "score": np.where(known, np.clip(score, 0, 1), 0.0),
            "ambiguous": close | ~known,
        })


def fit(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    max_rows: int = MAX_ROWS,
    features: int = FEATURES,
    ridge: float = RIDGE,
) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; only a sample's profiles reach the driver."""
    labelled = docs.where("lang is not null and doc_id is not null and text is not null").select(
        "text", "lang", F.xxhash64("doc_id", "text").alias("h")
    )
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    # hashes are even, so a share of them holds the lowest ``per_language`` with room to spare
    share = F.least(F.lit(1.0), (2.0 * per_language + 50) / F.col("n"))
    low = F.lit(-(2.0**63)) + share * (2.0**64)
    near = labelled.join(F.broadcast(counts), "lang").where(F.col("h") <= low).drop("n")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    sample = ranked.where(F.col("r") <= per_language).orderBy("r", "lang").limit(max_rows)

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                for at in range(0, part.num_rows, PROFILE_ROWS):
                    strip = part.slice(at, PROFILE_ROWS)
                    rows = profiles(strip.column("text"), features).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [strip.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())],
                        names=["lang", "profile"],
                    )

    rows = sorted(
        (r.lang, bytes(r.profile)) for r in sample.select("text", "lang").mapInArrow(run, "lang string, profile binary").collect()
    )
    languages = sorted({lang for lang, _ in rows})
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((features + 1, 1)), 1.0)
    x = np.array([np.frombuffer(p, dtype=np.float16) for _, p in rows], dtype=np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    own = np.array([languages.index(lang) for lang, _ in rows])
    share = np.sqrt(len(rows) / np.bincount(own)[own] / len(languages))[:, None]  # languages count alike
    y = code[own]
    kernel = (x * share) @ (x * share).T
    kernel[np.diag_indices(len(x))] += ridge * len(x)
    weights = (x * share).T @ np.linalg.solve(kernel, y * share)
    spread = np.abs(x @ weights).mean()
    return Model(languages, code, weights.astype(np.float32), float(3.0 / max(spread, 1e-6)))


def identify(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``; a map over the rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = tb.schema(kept.schema.fields, "lang_pred string, score double, ambiguous boolean")

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                found = held.value.predict(part.column("text"), ambiguous)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(found["lang_pred"], pa.string()),
                        pa.array(found["score"], pa.float64()),
                        pa.array(found["ambiguous"], pa.bool_()),
                    ],
                    names=[*part.schema.names, "lang_pred", "score", "ambiguous"],
                )

    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``docs`` without texts that have no letter or lie between two languages."""
    found = identify(tb.pack(docs), model, ambiguous)
    return tb.unpack(found.where(~F.col("ambiguous")), docs.columns)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The quarter of ids that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
