"""First-come selection: keep a row unless it conflicts with an earlier kept row of its group.

Near-duplicate removal, non-maximum suppression, cross-pass merging and tile
deduplication are this one operator with different conflict tests. Group sizes are
counted first:

* groups up to ``group_rows`` lie whole in one partition, where small ones are compared all
  at once, row against later row, and larger ones one by one;
* boxes in such groups are compared as whole rows that a window has ranked: nothing is
  written or joined back;
* larger groups run in rounds of block-pair tasks, which lie in partitions likewise: a row with no earlier undecided
  conflict is kept, rows conflicting with a kept one leave. Only flags cross a
  shuffle, so a group of near copies costs its rows, not its pairs. Boxes of groups of many
  blocks only meet those they share a cell of a hierarchical grid with, block pair by block
  pair in a full cell.

All give the same, order-defined result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.functions import boxes
from maskwright.lineage import cut_packed, dealt, freeing_shuffles
from maskwright.operators import blocks, grid
from maskwright.operators.scan import group_heads, rank_in_group

# conflict(a, b) -> bool matrix [len(a), len(b)]
Conflict = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _conflict(matrix: Conflict, pairs: Conflict) -> Conflict:
    """``pairs`` is the same test row by row, for many small groups at once."""
    matrix.pairs = pairs
    return matrix


def cosine_conflict(minimum: float) -> Conflict:
    floats = lambda v: np.ascontiguousarray(v, dtype=np.float32)

    def conflict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), dtype=bool)
        i, j, _ = blocks.pairs_at_least(floats(a), floats(b), minimum)
        out[i, j] = True
        return out

    return _conflict(conflict, lambda a, b: blocks.exact_dots(floats(a), floats(b)) >= minimum)


def _box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boxes in the last axis; the others are broadcast."""
    wide = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    high = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = wide * high
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - inter
    hit = (wide > 0) & (high > 0) & (union > 0)
    return np.where(hit, inter / np.where(hit, union, 1.0), 0.0)


def _box_conflict(pairs: Conflict) -> Conflict:
    return _conflict(lambda a, b: pairs(a[:, None, :], b[None, :, :]), pairs)


def overlap_conflict(threshold: float) -> Conflict:
    return _box_conflict(lambda a, b: _box_iou(a, b) > threshold)


def same_face_conflict(threshold: float) -> Conflict:
    def inside(o, inner):
        x = inner[..., 0] + inner[..., 2] / 2
        y = inner[..., 1] + inner[..., 3] / 2
        return (x >= o[..., 0]) & (x <= o[..., 0] + o[..., 2]) & (y >= o[..., 1]) & (
            y <= o[..., 1] + o[..., 3]
        )

    return _box_conflict(lambda a, b: (_box_iou(a, b) > threshold) | inside(a, b) | inside(b, a))


#: Groups up to this many rows are worked off together, larger ones each on its own.
SMALL_ROWS = 64


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups, and the first row of each group and the end, from rows sorted
    by ``keys``."""
    held = []

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = pa.Table.from_batches([held[0].slice(held[0].num_rows - 1), batch.slice(batch.num_rows - 1)])
        if len(held) > 1 and len(group_heads(ends, keys)) == 2:
            continue  # one group so far
        table = pa.Table.from_batches(held)
        at = group_heads(table, keys)
        if len(at) > 2:
            yield table.slice(0, at[-2]).combine_chunks(), at[:-1]
        held = table.slice(at[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_heads(table, keys)


def _near_pairs(at: np.ndarray, small: np.ndarray, may: Conflict, features: np.ndarray, conflict: Conflict):
    """Conflicting pairs ``(i, j)``, i before j, inside the ``small`` groups that begin at ``at``;
    only those that ``may(i, j)`` lets through are tested."""
    size = np.diff(at)
    end = np.repeat(np.where(small, at[1:], at[:-1]), size)
    row = np.arange(at[-1])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, int(size[small].max(initial=1))):
        row = row[row + apart < end[row]]
        i, j = row, row + apart
        ok = may(i, j)
        i, j = i[ok], j[ok]
        hit = conflict.pairs(features[i], features[j])
        left.append(i[hit]), right.append(j[hit])
    return np.concatenate(left), np.concatenate(right)


def _keep_in_groups(at: np.ndarray, features: np.ndarray, fixed: np.ndarray, conflict: Conflict) -> np.ndarray:
    """Left-to-right selection of many groups, each in its order."""
    size = np.diff(at)
    small = (size <= SMALL_ROWS) & hasattr(conflict, "pairs")
    keep = np.ones(at[-1], dtype=bool)
    i, j = _near_pairs(at, small, lambda i, j: ~fixed[j], features, conflict)
    place = (np.arange(at[-1]) - np.repeat(at[:-1], size))[i]
    order = np.argsort(place, kind="stable")
    i, j, place = i[order], j[order], place[order]
    marks = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]
    for a, b in zip(marks[:-1], marks[1:]):  # blockers of one place are decided before it
        keep[j[a:b][keep[i[a:b]]]] = False
    for g in np.flatnonzero(~small):
        own = slice(at[g], at[g + 1])
        keep[own] = _keep_in_order(features[own], fixed[own], conflict)
    return keep


def _keep_in_order(features: np.ndarray, fixed: np.ndarray, conflict: Conflict) -> np.ndarray:
    """Left-to-right selection of one ordered group; fixed rows always stay."""
    keep = np.zeros(len(features), dtype=bool)
    strip = 512
    for start in range(0, len(features), strip):
        part = features[start : start + strip]
        blocked = np.zeros(len(part), dtype=bool)
        if keep[:start].any():
            blocked = conflict(features[:start][keep[:start]], part).any(axis=0)
        inner = conflict(part, part)
        for i in range(len(part)):
            row = start + i
            keep[row] = fixed[row] or not (blocked[i] or (inner[:i, i] & keep[start:row]).any())
    return keep


def _grouped(df: DataFrame, keys: list[str], conflict: Conflict) -> DataFrame:
    kept = T.StructType([*[df.schema[k] for k in keys], T.StructField("__ord", T.LongType())])

    def select(batches):
        for table, at in _whole_groups(batches, keys):
            features = blocks.matrix(table["__features"], np.float64)
            fixed = table["__fixed"].to_numpy().astype(bool)
            keep = _keep_in_groups(at, features, fixed, conflict)
            yield from table.select([*keys, "__ord"]).filter(pa.array(keep)).to_batches()

    rows = dealt(df.select(*keys, "__ord", "__features", "__fixed"), *keys)
    return rows.sortWithinPartitions(*keys, "__ord").mapInArrow(select, kept)


_CELL = ["__level", "__cx", "__cy"]
_CELL_PX = 32.0
#: Blocks of a group from which on its boxes are spread over the grid.
GRID_BLOCKS = 8


def _bounds(df: DataFrame) -> DataFrame:
    """The box of each row's features with sides that are not negative, as ``__box``."""
    f = F.col("__features")
    return df.withColumn("__box", boxes.box(
        F.least(f[0], f[0] + f[2]), F.least(f[1], f[1] + f[3]), F.abs(f[2]), F.abs(f[3])
    ))


def _levels(df: DataFrame) -> list[int] | None:
    """The grid levels that boxes take (one number for every doubling at most); None if a box
    has no end, which the grid cannot hold."""
    wild = F.exists("__features", lambda x: F.abs(x) == float("inf"))
    known = ~F.exists("__features", F.isnan)
    found = _bounds(df.where(known)).agg(
        F.collect_set(F.when(~wild, grid.grid_level("__box", _CELL_PX))).alias("levels"), F.max(wild).alias("wild")
    ).first()
    return None if found["wild"] else found["levels"]


def _in_cells(df: DataFrame, levels: list[int]) -> DataFrame:
    """Rows in the grid's cells; a box with a NaN number conflicts with none and is in none."""
    known = _bounds(df.where(~F.exists("__features", F.isnan)))
    return grid.grid_cells(known, levels, _CELL_PX, "__box").drop("__box", "__own")


def _pair_flag(df: DataFrame, keys: list[str], conflict: Conflict, block_rows: int, levels: list[int] | None = None) -> DataFrame:
    """Rows of role 'test' having an earlier conflicting row of role 'against' or 'test'.

    ``__against`` marks rows that may block, ``__test`` rows that may be blocked. With
    ``levels`` features are boxes, and only boxes of one grid cell meet.
    """
    spots = keys
    if levels is not None:
        df, spots = _in_cells(df.drop("__n"), levels), [*keys, *_CELL]
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("__ord", T.LongType())])
    spread = blocks.pair_blocks(df, spots, "__ord", block_rows)

    def flag_one(task: pa.Table, features: np.ndarray) -> np.ndarray:
        ords = task["__ord"].to_numpy()
        block = task[blocks.BLOCK].to_numpy()
        against, test = (task[c].to_numpy().astype(bool) for c in ("__against", "__test"))
        i_block = task[blocks.LEFT][0].as_py()
        same = i_block == task[blocks.RIGHT][0].as_py()
        hit = np.zeros(len(ords), dtype=bool)
        left = np.nonzero(block == i_block)[0]
        right = left if same else np.nonzero(block != i_block)[0]
        for a, b in ((left, right),) if same else ((left, right), (right, left)):
            a, b = a[against[a]], b[test[b]]
            for start in range(0, len(a), 1024):
                part = a[start : start + 1024]
                c = conflict(features[part], features[b]) & (ords[part][:, None] < ords[b][None, :])
                hit[b] |= c.any(axis=0)
        return hit

    tasks = [*spots, blocks.LEFT, blocks.RIGHT]

    def flag(batches):
        for table, at in _whole_groups(batches, tasks):
            features = blocks.matrix(table["__features"], np.float64)
            against, test = (table[c].to_numpy().astype(bool) for c in ("__against", "__test"))
            block, one = table[blocks.BLOCK].to_numpy(), table[blocks.LEFT].to_numpy() == table[blocks.RIGHT].to_numpy()
            small = (np.diff(at) <= SMALL_ROWS) & hasattr(conflict, "pairs")
            may = lambda i, j: against[i] & test[j] & (one[i] | (block[i] != block[j]))  # noqa: E731, B023
            hit = np.zeros(table.num_rows, dtype=bool)
            hit[_near_pairs(at, small, may, features, conflict)[1]] = True
            for g in np.flatnonzero(~small):
                own = slice(at[g], at[g + 1])
                hit[own] = flag_one(table.slice(at[g], at[g + 1] - at[g]), features[own])
            yield from table.select([*keys, "__ord"]).filter(pa.array(hit)).to_batches()

    columns = [*spots, "__ord", "__features", "__against", "__test", blocks.BLOCK, blocks.LEFT, blocks.RIGHT]
    rows = dealt(spread.select(*columns), *tasks).sortWithinPartitions(*tasks, "__ord")
    return rows.mapInArrow(flag, out).distinct()


def _rounds(df: DataFrame, keys: list[str], conflict: Conflict, block_rows: int, boxed: bool = False, fixed: bool = True) -> DataFrame:
    """``(keys, __ord)`` of the kept rows of ``df``, which has been written. What a round
    writes are ids of rows that wait or leave, and the few rows that stay open."""
    id_columns = [*keys, "__ord"]
    levels = _levels(df) if boxed else None
    role = lambda rows, against, test: rows.withColumn("__against", against).withColumn("__test", test)
    yes, no = F.lit(True), F.lit(False)
    kept, open_rows = [], df
    if fixed:
        kept, open_rows = [df.where("__fixed").select(*id_columns)], df.where("not __fixed")
        # Fixed rows block wherever they stand, so they act as earlier than everything.
        ahead = df.where("__fixed").withColumn("__ord", F.col("__ord") - F.lit(2**62))
        first = role(ahead, yes, no).unionByName(role(open_rows, no, yes))
        blocked = cut_packed(_pair_flag(first, keys, conflict, block_rows, levels))
        open_rows = cut_packed(open_rows.join(blocked, id_columns, "left_anti"))
    while open_rows.count():
        waiting = cut_packed(_pair_flag(role(open_rows, yes, yes), keys, conflict, block_rows, levels))
        kept.append(open_rows.select(*id_columns).join(waiting, id_columns, "left_anti"))
        waits = F.coalesce("__waits", no)
        state = role(open_rows.join(waiting.withColumn("__waits", yes), id_columns, "left"), ~waits, waits).drop("__waits")
        removed = cut_packed(_pair_flag(state, keys, conflict, block_rows, levels))
        left = waiting.join(removed, id_columns, "left_anti")
        # sizes are counted anew, as few rows are left
        open_rows = cut_packed(open_rows.drop("__n").join(left, id_columns, "left_semi"))
    return functools.reduce(DataFrame.unionByName, kept, df.limit(0).select(*id_columns))


def keep_first_come(
    df: DataFrame,
    keys: list[str],
    order: str,
    features: Column,
    conflict: Conflict,
    fixed: Column | None = None,
    group_rows: int = settings.GROUP_ROWS,
    block_rows: int = settings.BLOCK_ROWS,
) -> DataFrame:
    """``(keys, order)`` of the kept rows. ``order`` is an integer unique within a group;
    ``features`` an array the conflict test reads; ``fixed`` rows are kept whatever happens."""
    named = df.select(
        *keys,
        F.col(order).cast("bigint").alias("__ord"),
        features.alias("__features"),
        (F.lit(False) if fixed is None else fixed).alias("__fixed"),
    )
    small, large = blocks.split_by_size(named, keys, group_rows)
    kept = _grouped(small, keys, conflict)
    if large is not None:
        with freeing_shuffles(df.sparkSession):
            found = cut_packed(_rounds(cut_packed(large), keys, conflict, block_rows, fixed=fixed is not None))
        kept = kept.unionByName(found)
    return kept.withColumnRenamed("__ord", order)


def box_features(b: Column) -> Column:
    return F.array(b["x"], b["y"], b["width"], b["height"])


def _ranked_groups(batches):
    """Tables of whole groups, and the first row of each and the end, from rows that lie group
    by group, ranked from 1 in ``__rank``."""
    held = []
    for batch in batches:
        heads = np.flatnonzero(batch["__rank"].to_numpy() == 1)
        if held and len(heads):
            held.append(batch.slice(0, heads[-1]))
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, np.r_[np.flatnonzero(table["__rank"].to_numpy() == 1), table.num_rows]
            held = []
            batch = batch.slice(heads[-1])
        held.append(batch)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.r_[np.flatnonzero(table["__rank"].to_numpy() == 1), table.num_rows]


def fold_boxes(
    df: DataFrame, keys: list[str], order: list[Column], box: str, conflict: Conflict, fixed: Column | None = None
) -> DataFrame:
    """What ``keep_first_boxes`` gives, of groups that are known to be small."""
    data = list(df.columns)
    b, flag = F.col(box), F.lit(False) if fixed is None else fixed
    sides = ["x", "y", "width", "height"]
    # a box that is not complete meets no other
    parts = [F.when(boxes.complete(b), b[c]).otherwise(float("nan")).alias("__" + c) for c in sides]
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = df.select(
        *data, *parts, flag.alias("__fixed"),
        F.row_number().over(whole.orderBy(*order, *data)).alias("__rank"),
    )

    def select(batches):
        for table, at in _ranked_groups(batches):
            features = np.column_stack([table["__" + c].to_numpy() for c in sides])
            fixed = table["__fixed"].to_numpy().astype(bool)
            keep = _keep_in_groups(at, features, fixed, conflict)
            upto = np.cumsum(keep)
            ord_ = upto - np.repeat((upto - keep)[at[:-1]], np.diff(at))
            kept = table.select(data).append_column("kept_ord", pa.array(ord_.astype(np.int64)))
            yield from kept.filter(pa.array(keep)).to_batches()

    return ranked.mapInArrow(select, T.StructType([*df.schema.fields, T.StructField("kept_ord", T.LongType())]))


def keep_first_boxes(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    box: str,
    matrix_conflict: Conflict,
    fixed: Column | None = None,
    fold_rows: int = settings.FOLD_ROWS,
    group_rows: int = settings.GROUP_ROWS,
    block_rows: int = settings.BLOCK_ROWS,
) -> DataFrame:
    """The kept rows of ``df``, all columns, plus ``kept_ord``: their rank in the order.

    ``order`` is ascending and total within a group; ``fixed`` rows must come first.
    """
    data = list(df.columns)
    # groups that fit in a task need no ranks
    small, large = blocks.split_by_size(df, keys, max(fold_rows, group_rows), "__n")
    result = fold_boxes(small, keys, order, box, matrix_conflict, fixed)
    if large is None:
        return result
    with freeing_shuffles(df.sparkSession):
        ranked = rank_in_group(large, keys, [*order, *[F.col(c) for c in data]], "__ord")  # ties fall as in fold_boxes
        flag = F.lit(False) if fixed is None else fixed
        rows = ranked.select(*keys, "__ord", box_features(F.col(box)).alias("__features"), flag.alias("__fixed"), "__n")
        most = GRID_BLOCKS * block_rows  # a few blocks meet faster than many cells
        sizes = rows.agg(F.min("__n").alias("least"), F.max("__n").alias("most")).first()
        found = []
        if sizes["least"] <= most:
            found.append(_rounds(rows.where(F.col("__n") <= most), keys, matrix_conflict, block_rows, False, fixed is not None))
        if sizes["most"] > most:
            found.append(_rounds(rows.where(F.col("__n") > most), keys, matrix_conflict, block_rows, True, fixed is not None))
        kept = rank_in_group(functools.reduce(DataFrame.unionByName, found), keys, [F.col("__ord")], "kept_ord")
    survivors = ranked.join(kept, [*keys, "__ord"])
    return result.unionByName(survivors.select(*data, "kept_ord"))
