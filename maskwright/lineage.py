"""Cutting lineage and small session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only a session without that
    setting (a local test) gets a folder of its own.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so a lost executor costs no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one compressed piece of ``cut_packed``.
PACKED_ROWS = 2048


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` in a fraction of the room: rows are written as compressed pieces of a few thousand."""

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(start, PACKED_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def unpack(batches):
        for batch in batches:
            for rows in batch.column("rows"):
                yield from pa.ipc.open_stream(rows.as_buffer())

    return cut(df.mapInArrow(pack, "rows binary")).mapInArrow(unpack, df.schema)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are equal in ``columns`` in one partition, for tasks that need them together.

    Spark leaves a repartition by columns out if its child, a join on them, say, is dealt by
    the same; adaptive execution, which sees no need then to keep equal rows together, may read that
    child's shuffle map by map, or in cut partitions. A hash of the columns is never the same."""
    return df.repartition(F.xxhash64(*columns))


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove the shuffle files of each execution when it ends, of tables built
    in here; results must be cut, and tables that are handed on be built outside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use every core for work that costs much per row: a source of fewer splits than
    cores is dealt out once; a large source, which has splits enough, is left alone. Where
    a row costs so much that a split makes a long task, ``rows`` bounds the rows of one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = cores if rows is None else max(cores, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
