"""The corpus pipeline: five stages over ``documents``, each a table the next one reads.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``. ``run`` writes what a stage returns as
Parquet in the shared folder of ``spark.checkpoint.dir`` and hands the reread table on,
so a lost executor costs a stage at most. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskwright.lineage import ensure_checkpoint_dir, table
from maskwright.llm import byte_bpe, decontaminate, language_id, line_dedup, simhash
from maskwright.llm.queries import default_tokenizer


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or lie between two languages."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark window: no coverage at all is allowed."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, per document."""
    held = default_tokenizer(spark)
    return byte_bpe.digests(byte_bpe.round_trip(docs.select("doc_id", "text"), held))


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("byte_bpe", tokens),
]

#: Output codes, suffix automata and BPE have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
