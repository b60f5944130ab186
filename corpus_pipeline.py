"""From raw documents to encoded training rows: language, boilerplate lines, near-duplicates, benchmark leaks, token ids.

Every stage reads all that its predecessor kept. The first four return the columns of documents, the last one
returns one row of token ids for each document that is left.

Python workers are given rows by BATCH_BYTES. A stage leaves that bound in the session, as its rows are read later;
`run`, which reads them all, puts the session's own bound back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sparkdlp
from sparkdlp.llm import bpe, decontaminate, lang_id, line_dedup, order_minhash
from sparkdlp.llm.common import temporary

cloudpickle.register_pickle_by_value(sparkdlp)  # workers get the functions with the plan


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not recognised."""
    return lang_id.keep_known(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share; n_chars follows the text."""
    return line_dedup.cleaned(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return order_minhash.keep_one(docs)


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is left."""
    return bpe.encode(docs).drop("body")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker is given at a time. Batches of 10,000 whole texts are tens of MB, held by the
#: executor and by the worker at once, and neither gives back all that it once took.
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Stage) -> Stage:
    """The stage under the bound on batches."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_small_batches(known_language)),
    ("line_dedup", in_small_batches(without_boilerplate)),
    ("minhash_near_dedup", in_small_batches(without_near_duplicates)),
    ("decontamination", in_small_batches(without_benchmark_leaks)),
    ("bpe_encoding", in_small_batches(encoded)),
]

#: Profiles, sketches, alignments and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    Every stage runs once: what it returns is saved, and the tables that it needed on the way are removed. At the
    end only the last stage's table is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_SETTING)
    try:
        with temporary(spark) as result:
            for name, stage in STAGES:
                with temporary(spark) as between:
                    keep = result if name == STAGES[-1][0] else between
                    docs = keep(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
