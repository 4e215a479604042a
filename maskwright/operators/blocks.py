"""Bounded tasks over the pairs of a group.

Rows of a group are hashed into blocks of at most about ``block_rows`` rows and every
pair of blocks becomes one task. Since a row is sent to as many tasks as there are blocks,
blocks of a group of more than ``FEW_BLOCKS`` of them grow to the default size first. A task sees two blocks and returns a few values per
row (a flag, a count, a link), never the pairs themselves, so neither a hot group nor
a pile of copies grows beyond one task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.lineage import cut, cut_packed, freeing_shuffles

LEFT, RIGHT, BLOCK = "__bi", "__bj", "__b"
#: Blocks of a group up to which a smaller size than the default is kept.
FEW_BLOCKS = 32


def with_group_size(df: DataFrame, keys: list[str], name: str = "__n") -> DataFrame:
    """Attach the row count of each group (counted map-side first)."""
    if not keys:
        return df.withColumn(name, F.lit(df.count()))
    sizes = df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = sizes.select(*[F.col(k).alias("__g_" + k) for k in keys], name)
    on = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col("__g_" + k))
        on = term if on is None else on & term
    return df.join(sizes, on, "left").drop(*["__g_" + k for k in keys])


def split_by_size(
    df: DataFrame, keys: list[str], limit: int, size: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit`` rows, and rows of larger groups or None; with ``size``
    those have their group's row count in a column of that name.

    Only the keys are read and counted (map-side first). Without a large group the input
    is handed back as it is; otherwise the few large keys are written once and joined.
    """
    with freeing_shuffles(df.sparkSession):
        large = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
        if large.isEmpty():
            return df, None
        large = cut_packed(large)
    found = df.join(large.withColumnRenamed("__n", size), keys) if size else df.join(large, keys, "left_semi")
    return df.join(large, keys, "left_anti"), found


#: Rows of one key and side that meet in one place, and result rows of one partition, of a dealt join.
MEET_ROWS, MEET_PAIRS = 2048, 4_000_000


def dealt_join(left: DataFrame, right: DataFrame, key: str, meet_rows: int = MEET_ROWS, meet_pairs: int = MEET_PAIRS) -> DataFrame:
    """The inner join on ``key``, dealt out by result rows instead of by key.

    A key of many rows on both sides has a result that grows with their product and would
    lie in one task. Both sides of such a key are hashed into parts of some ``meet_rows``
    rows and every two parts meet in a place of their own; the partitions follow the counted
    size of the result. All columns of a row are hashed, so rows should not be equal as a whole.
    """
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    sizes = count(left, "__l").join(count(right, "__r"), key)
    most = F.max(F.greatest("__l", "__r")).alias("rows")
    total = sizes.agg(F.sum(F.col("__l").cast("double") * F.col("__r")).alias("pairs"), most).first()
    if (total["pairs"] or 0) <= meet_pairs:
        return left.join(right, key)
    spark = left.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-total["pairs"] // meet_pairs)))
    parts = lambda c: F.ceil(F.col(c) / F.lit(meet_rows)).cast("bigint")
    # no more keys than rows / meet_rows
    crowded = cut(sizes.where(F.greatest("__l", "__r") > meet_rows).select(key, parts("__l").alias("__lp"), parts("__r").alias("__rp")))
    one, places = F.lit(1).cast("bigint"), [key, "__li", "__ri"]

    def deal(df: DataFrame, own: str, other: str, mine: str, yours: str) -> DataFrame:
        held = df.join(F.broadcast(crowded), key, "left")
        spread = F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, one) - 1)
        return (
            held.withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.coalesce(own, one)))
            .withColumn(yours, F.explode(spread))
            .drop("__lp", "__rp")
            .repartition(partitions, *places)
        )

    met = deal(left, "__lp", "__rp", "__li", "__ri").join(deal(right, "__rp", "__lp", "__ri", "__li"), places)
    return met.drop("__li", "__ri")


def pair_blocks(
    df: DataFrame, keys: list[str], order: str, block_rows: int = settings.BLOCK_ROWS
) -> DataFrame:
    """Replicate each row to the block pairs of its group that it belongs to. A column ``__n``
    of ``df`` is taken for the group's size, which is counted otherwise."""
    sized = df if "__n" in df.columns else with_group_size(df, keys)
    size = F.greatest(F.lit(block_rows), F.least(F.lit(settings.BLOCK_ROWS), F.ceil(F.col("__n") / F.lit(FEW_BLOCKS))))
    count = F.ceil(F.col("__n") / size).cast("bigint")
    block = F.pmod(F.xxhash64(order), count)
    return (
        sized.withColumn("__blocks", count)
        .withColumn(BLOCK, block)
        .withColumn("__j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)))
        .withColumn(LEFT, F.least(BLOCK, "__j"))
        .withColumn(RIGHT, F.greatest(BLOCK, "__j"))
        .drop("__n", "__blocks", "__j")
    )


# Pivots per large group, and how many large groups may be planned on the driver.
PIVOTS, PLANNED_GROUPS = 64, 256
# Angles of single-precision unit vectors are only known to about half this.
ANGLE_SLACK = 2e-3
_SUB = 1 << 20


def near_blocks(
    df: DataFrame,
    keys: list[str],
    order: str,
    vector: str,
    minimum: float,
    block_rows: int = settings.BLOCK_ROWS,
) -> DataFrame:
    """Like :func:`pair_blocks`, but only for block pairs that can reach ``minimum`` cosine.

    Groups of one block need no pairing. Rows of a larger group go to the cell of their
    nearest pivot; by the triangle inequality on angles two cells whose pivots are
    further apart than both radii and the threshold angle together hold no pair, so
    their blocks never meet. Cells of any size are hashed into bounded blocks.
    """
    small, large = split_by_size(df, keys, block_rows)
    zero = F.lit(0).cast("bigint")
    single = small.withColumns({BLOCK: zero, LEFT: zero, RIGHT: zero})
    if large is None:
        return single
    large = cut(large)
    return single.unionByName(_cells(large, keys, order, vector, minimum, block_rows))


def _cells(df, keys, order, vector, minimum, block_rows):
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(order), order)
    pivots = cut(
        df.select(*keys, order, vector)
        .withColumn("__p", F.row_number().over(first))
        .where(F.col("__p") <= PIVOTS)
    )
    if minimum <= 0 or pivots.select(*keys).distinct().count() > PLANNED_GROUPS:
        return pair_blocks(df, keys, order, block_rows)
    rows = pivots.orderBy("__p").select(*keys, vector).toArrow()
    labels = list(zip(*[rows[k].to_pylist() for k in keys]))
    units = unit_rows(matrix(rows[vector]))
    of_group = {
        g: units[[i for i, label in enumerate(labels) if label == g]] for g in dict.fromkeys(labels)
    }
    shared = df.sparkSession.sparkContext.broadcast(of_group)
    fields = [T.StructField("__cell", T.LongType()), T.StructField("__angle", T.DoubleType())]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = unit_rows(matrix(batch.column(vector)))
            owner = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            cell, angle = np.zeros(len(mine), np.int64), np.zeros(len(mine))
            for g in set(owner):
                at = np.array([i for i, o in enumerate(owner) if o == g])
                cosines = mine[at].astype(np.float64) @ shared.value[g].T.astype(np.float64)
                cell[at] = cosines.argmax(axis=1)
                angle[at] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            angle[~mine.any(axis=1)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(angle)],
                names=[*batch.schema.names, "__cell", "__angle"],
            )

    placed = cut(df.mapInArrow(assign, T.StructType([*df.schema.fields, *fields])))
    stats = placed.groupBy(*keys, "__cell").agg(F.count("*").alias("n"), F.max("__angle").alias("r"))
    cells: dict[tuple, dict] = {}
    for row in stats.collect():
        cells.setdefault(tuple(row[k] for k in keys), {})[row["__cell"]] = (row["n"], row["r"])
    for own in cells.values():
        size = max(block_rows, min(settings.BLOCK_ROWS, -(-sum(n for n, _ in own.values()) // FEW_BLOCKS)))
        own.update({c: (-(-n // size), r) for c, (n, r) in own.items()})
    reach = float(np.arccos(np.clip(minimum, -1, 1))) + ANGLE_SLACK
    plan = []
    for g, own in cells.items():
        p = of_group[g].astype(np.float64)
        apart = np.arccos(np.clip(p @ p.T, -1, 1))
        for c, (subs, r) in own.items():
            partners = [
                (d, other) for d, (other, q) in own.items() if apart[c, d] <= r + q + reach or c == d
            ]
            plan.append((*g, c, subs, partners))
    schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("__cell", T.LongType()),
            T.StructField("__subs", T.LongType()),
            T.StructField(
                "__partners",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("cell", T.LongType()), T.StructField("subs", T.LongType())]
                    )
                ),
            ),
        ]
    )
    planned = df.sparkSession.createDataFrame(plan, schema)
    # at most PLANNED_GROUPS * PIVOTS rows
    met = (
        placed.join(F.broadcast(planned), [*keys, "__cell"])
        .withColumn(BLOCK, F.col("__cell") * _SUB + F.pmod(F.xxhash64(order), F.col("__subs")))
        .withColumn("__partner", F.explode("__partners"))
        .withColumn(
            "__other",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__partner.subs") - 1)),
        )
        .withColumn("__other", F.col("__partner.cell") * _SUB + F.col("__other"))
        .withColumn(LEFT, F.least(BLOCK, "__other"))
        .withColumn(RIGHT, F.greatest(BLOCK, "__other"))
    )
    return met.select(*df.columns, BLOCK, LEFT, RIGHT)


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    """A list column of one width as a 2-d array, without a Python object per row.

    A null list or lists of different lengths are an error, never shifted rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    widths = pc.min_max(pc.list_value_length(column)).as_py() if rows else {"min": 0, "max": 0}
    if column.null_count or widths["min"] != widths["max"]:
        raise ValueError(f"vectors must share one width and none be null, found {widths} and {column.null_count} null")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=dtype).reshape(rows, -1 if rows else 0)


def list_column(values: np.ndarray, type_: pa.DataType = pa.float32()) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, max(width, 1), dtype=np.int32)[: rows + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), type=type_))


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products summed left to right in double precision."""
    total = np.zeros(max(len(a), len(b)))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length and rounded to float; zero rows stay zero."""
    norm = np.sqrt(exact_dots(v, v))
    inverse = np.where(norm == 0, 1.0, 1.0 / np.where(norm == 0, 1.0, norm))
    return (v.astype(np.float64) * inverse[:, None]).astype(np.float32)


# Single-precision products steer, double-precision sums decide: any pair within this
# distance of a bound is recomputed exactly.
SLACK = 1e-4


def strips(rows: int, columns: int, cells: int = 4_000_000) -> list[slice]:
    """Slices of ``rows`` whose products with ``columns`` fill at most about ``cells``."""
    step = max(1, cells // max(1, columns))
    return [slice(at, min(at + step, rows)) for at in range(0, rows, step)]


def same_width(a: np.ndarray, b: np.ndarray) -> None:
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of width {a.shape[1]} meet vectors of width {b.shape[1]}")


def pairs_at_least(a: np.ndarray, b: np.ndarray, bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs and exact scores of rows of ``a`` and ``b`` whose product reaches ``bound``.

    ``bound`` is a number or one value per row of ``b``. The score matrix is worked off in
    strips; the pairs returned are as many as there are, so a caller with many rows on
    both sides reduces them strip by strip (:func:`strips`).
    """
    bound = np.broadcast_to(np.asarray(bound, dtype=np.float64), (len(b),))
    strip = max(1, 2_000_000 // max(1, len(b)))
    found_i, found_j, found_s = [], [], []
    for start in range(0, len(a), strip):
        rough = a[start : start + strip] @ b.T
        i, j = np.nonzero(rough >= bound - SLACK)
        for cut in range(0, len(i), 50_000):
            ci, cj = i[cut : cut + 50_000] + start, j[cut : cut + 50_000]
            score = exact_dots(a[ci], b[cj])
            ok = score >= bound[cj]
            found_i.append(ci[ok]), found_j.append(cj[ok]), found_s.append(score[ok])
    if not found_i:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0)
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_s)
