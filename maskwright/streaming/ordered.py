"""Streams whose result depends on order: rows wait for the watermark, then run in turn.

Rows of a key may arrive in any batch and, for two streams put together, in any mutual
order. Each is kept until the watermark has passed its time, so everything before it has
arrived, and is then folded into the key's state in order. What waits is bounded by the
watermark's delay; a key without rows for ``forget_ms`` loses its state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


_KINDS = {"long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "string": T.StringType}


def struct(fields: str) -> T.StructType:
    """``name kind, ...`` as a type, also in workers, which cannot ask Spark's parser."""
    return T.StructType([T.StructField(name, _KINDS[kind]()) for name, kind in map(str.split, fields.split(", "))])


class InOrder(StatefulProcessor):
    """Feeds ``fold(key, state, row) -> (state, output rows)`` with a key's rows by
    ``order``, whose first column is the time in milliseconds. States are JSON values."""

    def __init__(self, fold: Callable, order: list[str], schema: T.StructType, output: list[str], forget_ms: int):
        self.fold, self.order, self.schema, self.output, self.forget_ms = fold, order, schema, output, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("state", struct("json string, until long"))

    def _rows(self) -> list[dict]:
        held = self.waiting.get() if self.waiting.exists() else []
        return [dict(zip(self.schema.names, row)) for row in held]

    def _next_timer(self, rows: list[dict]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [min(r[self.order[0]] for r in rows)] if rows else []
        if self.state.exists():
            times.append(self.state.get()[1])
        if times:  # when the watermark is past it, so that whoever is woken has work
            self.handle.registerTimer(int(min(times)) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for part in rows:
            columns = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in self.schema.names]
            self.waiting.appendList([tuple(row) for row in zip(*columns)])
        self._next_timer(self._rows())
        yield self._drained(key, timer_values.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._drained(key, timerValues.getCurrentWatermarkInMs())

    def _drained(self, key, upto: int) -> pd.DataFrame:
        """Fold what the watermark has passed, and keep the rest."""
        time = self.order[0]
        rows = self._rows()
        due = sorted((r for r in rows if r[time] < upto), key=lambda r: [r[c] for c in self.order])
        state, until = (json.loads(self.state.get()[0]), self.state.get()[1]) if self.state.exists() else (None, None)
        out = []
        for row in due:
            if until is not None and row[time] >= until:  # forgotten meanwhile
                state = None
            state, produced = self.fold(key, state, row)
            until = row[time] + self.forget_ms
            out.extend(produced)
        if due:
            rows = [r for r in rows if r[time] >= upto]
            self.waiting.put([tuple(r[c] for c in self.schema.names) for r in rows]) if rows else self.waiting.clear()
        if until is not None and until < upto:
            self.state.clear()
        elif due:
            self.state.update((json.dumps(state), int(until)))
        self._next_timer(rows)
        return pd.DataFrame(out, columns=self.output, dtype=object)

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame, keys: list[str], order: list[str], fold: Callable, output: T.StructType, delay_ms: int, forget_ms: int
) -> DataFrame:
    """``fold`` over a stream's rows in order of ``order``; rows later than ``delay_ms``
    behind the latest are dropped by the watermark. Needs the RocksDB state store."""
    kept = T.StructType([f for f in rows.schema.fields if f.name not in keys])
    timed = rows.withColumn("__at", F.timestamp_millis(F.col(order[0]))).withWatermark("__at", f"{delay_ms} milliseconds")
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=InOrder(fold, order, kept, output.names, forget_ms),
        outputStructType=output, outputMode="Append", timeMode="EventTime",
    )
