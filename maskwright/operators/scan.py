"""Running values along an order, without putting a whole key into one task.

A plain window hands every row of a key to one task, and a window without keys hands
the whole table to one. A large table is therefore cut into ranges of the order first:
each (key, range) is scanned on its own, the ranges of a key are summed up (one row per
range) and the carry is added back. The number of ranges follows the row count, so a
range keeps its size whatever the table's. A table small enough for one range takes the
plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.lineage import cut, cut_packed

_RANGE, _CARRY, _LOCAL = "__range", "__carry_", "__local_"


@dataclass(frozen=True)
class Ranges:
    """Quantiles of the leading order column and equal steps between them."""

    cuts: tuple = ()
    steps: int = 1

    def of(self, column: str) -> Column:
        """Range number of a value; it never decreases with the value."""
        value = F.col(column)
        marks = F.array(*[F.lit(c) for c in self.cuts])
        slot = F.size(F.filter(marks, lambda c: c <= value))
        if self.steps == 1:
            return slot.cast("bigint")
        low, high = F.get(marks, slot - 1), F.get(marks, slot)
        step = F.floor((value - low) * self.steps / F.when(high > low, high - low))
        inside = F.greatest(F.lit(0), F.least(F.lit(self.steps - 1), step))
        return (slot * self.steps + F.coalesce(inside, F.lit(0))).cast("bigint")


def _largest_key(df: DataFrame, keys: list[str]) -> int | None:
    if df.groupBy().count().first()[0] <= settings.SCAN_ROWS:
        return None
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def plan_ranges(df: DataFrame, column: str, rows: int | None = None, keys: list[str] | None = None) -> Ranges:
    """Ranges of about ``rows`` rows each. They shape the work, never the result.

    With ``keys`` and no ``rows``, a table of any size takes the plain window, which moves far
    less, as long as its largest key fits one range."""
    if rows is None and keys and (_largest_key(df, keys) or 0) <= settings.SCAN_ROWS:
        return Ranges()
    rows = rows or settings.SCAN_ROWS
    count = df.count()
    if count <= rows:
        return Ranges()
    wanted = -(-count // rows)
    quantiles = min(wanted, 64)
    fractions = [i / quantiles for i in range(quantiles + 1)]
    row = df.agg(F.percentile_approx(column, fractions, 1000).alias("q")).first()
    return Ranges(tuple(sorted(set(row["q"] or []))), -(-wanted // quantiles))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    inclusive: bool = True,
    ranges: Ranges | None = None,
) -> DataFrame:
    """Add running sums, last non-null values and maxima to every row.

    ``order`` must be unique within ``keys`` and its first column a number. With
    ``inclusive=False`` a row sees only the rows before it. Chained calls over the same
    rows should share one ``ranges``.
    """
    sums, lasts, maxes = sums or {}, lasts or {}, maxes or {}
    ranges = plan_ranges(df, order[0], keys=keys) if ranges is None else ranges
    inputs = {**sums, **lasts, **maxes}
    parts = list(keys)
    if ranges.cuts:
        df = df.withColumn(_RANGE, ranges.of(order[0]))
        parts.append(_RANGE)
    df = df.withColumns({_LOCAL + n: v for n, v in inputs.items()})
    window = (
        Window.partitionBy(*parts)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = {n: F.sum(_LOCAL + n).over(window) for n in sums}
    local |= {n: F.last(_LOCAL + n, ignorenulls=True).over(window) for n in lasts}
    local |= {n: F.max(_LOCAL + n).over(window) for n in maxes}
    helpers = [_LOCAL + n for n in inputs]
    zero = F.lit(0).cast("bigint")
    if not ranges.cuts:
        done = df.withColumns(local)
        return done.withColumns({n: F.coalesce(F.col(n), zero) for n in sums}).drop(*helpers)

    position = F.struct(*[F.col(c) for c in order])
    totals = [F.sum(_LOCAL + n).alias(_CARRY + n) for n in sums]
    totals += [
        F.max_by(_LOCAL + n, F.when(F.col(_LOCAL + n).isNotNull(), position)).alias(_CARRY + n)
        for n in lasts
    ]
    totals += [F.max(_LOCAL + n).alias(_CARRY + n) for n in maxes]
    summary = df.groupBy(*parts).agg(*totals)
    earlier = (
        Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *[F.col(k).alias("__k_" + k) for k in parts],
        *[F.sum(_CARRY + n).over(earlier).alias(_CARRY + n) for n in sums],
        *[F.last(_CARRY + n, ignorenulls=True).over(earlier).alias(_CARRY + n) for n in lasts],
        *[F.max(_CARRY + n).over(earlier).alias(_CARRY + n) for n in maxes],
    )
    on = F.lit(True)
    for k in parts:
        on = on & F.col(k).eqNullSafe(F.col("__k_" + k))
    joined = df.withColumns(local).join(carry, on, "left")
    merged = {n: F.coalesce(F.col(n), zero) + F.coalesce(_CARRY + n, zero) for n in sums}
    merged |= {n: F.coalesce(F.col(n), F.col(_CARRY + n)) for n in lasts}
    merged |= {n: F.greatest(F.col(n), F.col(_CARRY + n)) for n in maxes}
    helpers += [_RANGE, *["__k_" + k for k in parts], *[_CARRY + n for n in inputs]]
    return joined.withColumns(merged).drop(*helpers)


def group_heads(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of every stretch of equal ``keys``, and the end."""
    codes = [table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
    change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for code in codes:
        change |= code[1:] != code[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, table.num_rows]


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank 1, 2, ... of every row in its group, also for a group too large for one task.
    Keys are not null.

    Rows are range-partitioned by group and order and written once, ranked inside their
    partition. Only a group that crosses a border of partitions, one for each border at most,
    has its ranks shifted by the sizes of its earlier partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    fields = [T.StructField("__part", T.IntegerType()), T.StructField(name, T.LongType())]

    def count(batches):
        part, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch.select(keys)])
            if last is not None:
                own = pa.concat_tables([last, own])
            heads = group_heads(own, keys)
            rank = np.arange(own.num_rows) - np.repeat(heads[:-1], np.diff(heads)) + 1
            if last is not None:  # the row that goes on from the batch before
                rank[: heads[1]] += upto - 1
                rank = rank[1:]
            last, upto = own.slice(own.num_rows - 1), int(rank[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(rank), part, dtype=np.int32)), pa.array(rank.astype(np.int64))],
                names=[*batch.schema.names, "__part", name],
            )

    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut_packed(ordered.mapInArrow(count, T.StructType([*df.schema.fields, *fields])))
    key = F.struct(*keys)
    edges = placed.groupBy("__part").agg(F.array(F.min(key), F.max(key)).alias("ends"))
    crossing = edges.select(F.explode("ends").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    sizes = (
        placed.join(F.broadcast(crossing.select("k.*")), keys, "left_semi")
        .groupBy(*keys, "__part").agg(F.max(name).alias("__size"))
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # no more rows than twice the partitions and borders
    shift = cut(sizes.withColumn("__shift", F.sum("__size").over(before)).where("__shift is not null").drop("__size"))
    return (
        placed.join(F.broadcast(shift), [*keys, "__part"], "left")
        .withColumn(name, F.col(name) + F.coalesce("__shift", F.lit(0)))
        .select(*df.columns, name)
    )
