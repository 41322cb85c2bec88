"""Toxic and poor documents, near copies and benchmark leaks go; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs.  All but the last return rows of their docs, with all columns, whatever their names; the last returns digests of the
coded texts.  An empty table gives no rows anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import bpe, decontamination, jaccard_join, quality_rules, toxicity
from treeloom.llm.pretokens import vocabulary_text
from treeloom.llm.storage import saved, table


#: Rows that go to a Python worker at once.  With texts of kilobytes Spark's default of 10,000 makes batches of tens of megabytes, which the
#: JVM and the worker hold several times over.  The stages lower the session's setting to this; run() gives the caller's back.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5.

    Null and empty texts share the least score and stay, repeated rows and null ids are judged each; without labels of both kinds the score is constant.
    """
    _small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of their language and source.

    Null, empty and blank texts have no words and go; null languages and sources form groups; repeated rows are judged, and counted, each.
    """
    _small_batches(spark)
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked ones.

    Texts without words link with nothing and stay, rows with a null doc_id too; of rows that share a doc_id one stays.
    """
    _small_batches(spark)
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and blank texts and null ids stay; repeated rows stay or go together; null and blank items match nothing.
    """
    _small_batches(spark)
    return decontamination.keep_free(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the coded texts; null texts count as empty, repeated rows and null ids are coded each."""
    _small_batches(spark)
    return bpe.coded_digests(docs, vocabulary_text(bpe.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the learned lexicon nor BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH)
    try:
        for i, (_, stage) in enumerate(STAGES):
            docs = saved(stage(spark, docs, sf_dir), f"stage-{i}")
    finally:
        spark.conf.set(_BATCH, before)
    return docs
