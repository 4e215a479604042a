"""Term rules as a table: all terms looked for in one pass over each text.

``rules(group_ord, target, kind, weight, term)``: a group applies to a text column (its
``target``) once, whatever number of its terms is there. A term is there if its FIRST
occurrence stands between characters other than a-z and 0-9. The terms of a table become an
automaton that reads a text once, however many terms there are; a table larger than
``part_bytes`` becomes several, each shipped for a pass of its own over the same rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings

SCHEMA = "group_ord int, target string, kind string, weight double, term string"
#: Bytes of an automaton for each byte of its terms, roughly.
_NODE_BYTES = 64
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def table(spark: SparkSession, groups: list[tuple[str, str, float, tuple[str, ...]]]) -> DataFrame:
    """A rule table from ``(target, kind, weight, terms)`` groups."""
    rows = [(n, target, kind, float(weight), term) for n, (target, kind, weight, terms) in enumerate(groups) for term in terms]
    return spark.createDataFrame(rows, SCHEMA)


class Automaton:
    """The terms of one target, each with the groups it belongs to."""

    def __init__(self, terms: list[tuple[str, int]]):
        groups: dict[str, set[int]] = {}
        for term, group in terms:
            if term:
                groups.setdefault(term, set()).add(group)
        self.groups = list(groups.values())
        self.size = list(map(len, groups))
        self.machine = ahocorasick.Automaton()
        for n, term in enumerate(groups):
            self.machine.add_word(term, n)
        if groups:
            self.machine.make_automaton()

    def find(self, text: str | None) -> set[int]:
        """The groups that are there."""
        found: set[int] = set()
        if not text or not self.groups:
            return found
        seen: set[int] = set()
        for end, n in self.machine.iter(text):
            if n not in seen:
                seen.add(n)
                start = end - self.size[n]  # the character before the term
                if (start < 0 or text[start] not in _PLAIN) and (end + 1 == len(text) or text[end + 1] not in _PLAIN):
                    found |= self.groups[n]
        return found


def find_groups(rows: DataFrame, rules: DataFrame, targets: list[str], name: str = "groups", part_bytes: int = settings.BROADCAST_BYTES) -> DataFrame:
    """``rows`` with ``name``, the sorted ``group_ord`` of all groups found in the columns
    ``targets``. Rules for other targets are left out."""
    spark = rows.sparkSession
    terms = rules.where(F.col("target").isin(*targets) & F.col("term").isNotNull())
    size = terms.agg(F.sum(F.octet_length("term") + 1)).first()[0] or 0
    parts = max(1, -(-size * _NODE_BYTES // part_bytes))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != name), T.StructField(name, T.ArrayType(T.IntegerType()))])
    out = rows.withColumn(name, F.array().cast("array<int>"))
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).select("target", "term", "group_ord").collect()
        held = spark.sparkContext.broadcast([(r.target, r.term, r.group_ord) for r in own])

        def run(batches, held=held):
            machines = [(t, Automaton([(term, g) for target, term, g in held.value if target == t])) for t in targets]
            for batch in batches:
                texts = [batch.column(t).to_pylist() for t, _ in machines]
                before = batch.column(name).to_pylist()
                found = [
                    sorted(set(old).union(*(machine.find(text) for (_, machine), text in zip(machines, row))))
                    for old, row in zip(before, zip(*texts))
                ]
                upto = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                groups = pa.ListArray.from_arrays(upto, pa.array([g for x in found for g in x], pa.int32()))
                names = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), groups], names=[*names, name])

        out = out.select(*[F.col(f"`{f.name}`") for f in schema.fields]).mapInArrow(run, schema)
    return out
