"""A training corpus from raw documents: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import decontaminate, jaccard, language, packing, toxicity
from tidecast.llm.common import stored, table

#: Bytes of a batch of texts on its way to Python, which an executor holds in the JVM and in
#: the worker, for each of its cores (Spark: 64 MB); units that a worker of the last stage remembers.
BATCH, UNITS = 2 << 20, 200_000


def _small_batches(spark: SparkSession) -> None:
    """Small batches for this session from now on, unless it sets a size itself: a stage runs
    only when its result is written."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score one half or more for toxicity."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents whose language is identified."""
    _small_batches(spark)
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, Jaccard 0.8 or more."""
    _small_batches(spark)
    return jaccard.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages to a twentieth of their words."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 token ids, one row per piece.  After the other stages the executors
    have little memory to spare."""
    _small_batches(spark)
    return packing.pack(docs, remembered=UNITS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The learned and tokenizing stages cannot be written in SQL; the tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
