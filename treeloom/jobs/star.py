"""The same shapes over the star-schema tables: top-k, latest row, prefix-sum budget, rollup, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.operators.ranking import top_k, winners, within_budget
from treeloom.sources.corpus import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(job):
        QUERIES[job.__name__], ORACLE[job.__name__] = job, sql
        return job

    return add


@query("SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def top_lines_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_k(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 3).select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "rank")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return winners(rows, ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, o_orderkey, used::BIGINT AS used FROM (SELECT o_custkey, o_orderkey, sum(round(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS used FROM orders) WHERE used <= 500000")
def order_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("price"))
    return within_budget(rows, ["o_custkey"], ["o_orderkey"], F.col("price"), 500_000).select("o_custkey", "o_orderkey", "used")


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS quantity, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus")
def line_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id FROM s GROUP BY user_id, session""")
def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with at most 30 minutes between them, as one burst."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id").withColumn("starts", F.when(gap.isNull() | (gap > 30 * 60 * 1_000_000), 1).otherwise(0))
    return rows.withColumn("session", F.sum("starts").over(order)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
