"""Bounded reads of files that may change meanwhile: what was read stands between two listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMAT = {"recursiveFileLookup": "true", "ignoreMissingFiles": "true"}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below ``root`` now: kept in the checkpoint folder, so that it doesn't follow later changes."""
    found = spark.read.format("binaryFile").options(**_FORMAT).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return found.checkpoint()


def contents(spark: SparkSession, root: str, limit: int) -> DataFrame:
    """(path, size, mtime, content) of the files of at most ``limit`` bytes; the filter on the length keeps others unread."""
    found = spark.read.format("binaryFile").options(**_FORMAT).load(root).where(F.col("length") <= limit)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").checkpoint()


def stable(before: DataFrame, read: DataFrame, after: DataFrame, limit: int) -> DataFrame:
    """(path, outcome, content) for each file of ``before``.

    ``oversized``: more than ``limit`` bytes, before or when read; ``unavailable``: gone; ``changed``: size, time or the number of bytes read differ between the three;
    ``ok``, and only then a content.  The three are joined by path.
    """
    first = before.select("path", F.col("size").alias("size_0"), F.col("mtime").alias("mtime_0"))
    held = read.select("path", F.col("size").alias("size_1"), F.col("mtime").alias("mtime_1"), "content")
    last = after.select("path", F.col("size").alias("size_2"), F.col("mtime").alias("mtime_2"))
    rows = first.join(held, "path", "left").join(last, "path", "left")
    same = (F.col("size_0") == F.col("size_1")) & (F.col("size_1") == F.col("size_2")) & (F.col("mtime_0") == F.col("mtime_1")) & (F.col("mtime_1") == F.col("mtime_2")) & (F.octet_length("content") == F.col("size_1"))
    outcome = (
        F.when(F.col("size_0") > limit, "oversized").when(F.col("size_2").isNull(), "unavailable").when(F.col("size_1").isNull() & (F.col("size_2") > limit), "oversized")
        .when(F.col("size_1").isNull(), "unavailable").when(F.octet_length("content") > limit, "oversized").when(same, "ok").otherwise("changed")
    )
    return rows.select("path", outcome.alias("outcome"), F.when(outcome == "ok", F.col("content")).alias("content"))


def stable_read(spark: SparkSession, root: str, limit: int) -> DataFrame:
    """Files below ``root`` that nobody changed while they were read."""
    before = listing(spark, root)
    return stable(before, contents(spark, root, limit), listing(spark, root), limit)
