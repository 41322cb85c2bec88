"""Contiguous shards of near equal bytes from global prefix sums (operator 6).

Rows take one global order: by a hash of the text, then doc_id, so equal texts stand together and a hot text still spreads over
range partitions.  Only ids, sizes and hashes are shuffled, never texts.  A row's global byte offset is its
partition's share of the totals before it plus a running sum inside the partition.  Cuts fall at equal byte targets.  A cut that
would split a group of equal texts moves to the group's nearer edge if the group is small beside a shard; the law stays
``bytes``, and larger groups are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.storage import saved, table

ORDER = ("h", "text_crc32", "size", "doc_id")


def byte_shards(docs: DataFrame, shards: int = 16, group_share: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs`` (doc_id, text).

    size is the UTF-8 bytes of the text plus 1 (null: 1).  Every row is placed, repeated rows and null ids too.  Groups
    of equal texts of up to 1/``group_share`` of a shard's target stay whole; null and empty texts are one group.  With fewer rows than shards, some
    shards are empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # Written once with its partition number: a lost executor can't bring other range bounds.
    ranged = saved(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside))
        .withColumn("nth", F.count(F.lit(1)).over(inside))
        .join(F.broadcast(starts), "part")  # a row for each partition
        .select("doc_id", "size", "text_crc32", "h", (F.col("bytes_before") + F.col("run") - F.col("size")).alias("at"), (F.col("rows_before") + F.col("nth") - 1).alias("index"))
    )
    placed = saved(placed, "placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    cuts = [total * k // shards for k in range(1, shards)]
    cuts = _off_groups(placed, cuts, total // shards // group_share)
    shard = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    found = placed.withColumn("shard", shard)
    firsts = found.groupBy("shard").agg(F.min("index").alias("first_index"))
    return found.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first_index")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _off_groups(placed: DataFrame, cuts: list[int], most: int) -> list[int]:
    """``cuts`` moved to the nearer edge of the group that each falls in, where that has at most ``most`` bytes."""
    if not cuts or most < 1:
        return cuts
    key = ["h", "text_crc32", "size"]
    marks = placed.sparkSession.createDataFrame([(c,) for c in cuts], "cut long")
    hit = F.broadcast(marks)  # a row for each cut
    groups = placed.join(hit, (placed.at < hit.cut) & (hit.cut <= placed.at + placed.size)).select(*key).distinct()
    spans = placed.join(F.broadcast(groups), key).groupBy(*key).agg(F.min("at").alias("low"), F.max(F.col("at") + F.col("size")).alias("high"))
    edges = [(r.low, r.high) for r in spans.collect()]  # at most a row for each cut
    out = []
    for c in cuts:
        low, high = next(((x, y) for x, y in edges if x < c < y), (c, c))
        out.append(c if high - low > most else low if c - low <= high - c else high)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_byte_sharding over the whole of ``documents``."""
    return byte_shards(table(spark, sf_dir, "documents"))
