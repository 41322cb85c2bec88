"""Queries of hand-overs and of reads between listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.sources import stable as S
from treeloom.sources.corpus import table
from treeloom.streaming import handover as H

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


#: Whole texts as hand-overs: both line ends, mixed ones, other modes and heads, blank and long bodies; some with bytes that are no text.
_FRAMED = (
    f"concat(CASE CAST(doc_id % 13 AS INT) WHEN 0 THEN '{H.HEAD} ' WHEN 1 THEN concat(chr(10), '{H.HEAD}') ELSE '{H.HEAD}' END, CASE CAST(doc_id % 2 AS INT) WHEN 0 THEN chr(10) ELSE concat(chr(13), chr(10)) END, 'mode: ', CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'review' WHEN 1 THEN 'design' WHEN 2 THEN 'handoff' WHEN 3 THEN 'design' ELSE 'other' END, "
    "CASE CAST(doc_id % 2 AS INT) WHEN 0 THEN chr(10) ELSE concat(chr(13), chr(10)) END, CASE WHEN doc_id % 14 = 0 THEN concat(chr(13), chr(10)) WHEN doc_id % 2 = 0 THEN chr(10) ELSE concat(chr(13), chr(10)) END, CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN concat(' ', chr(10), chr(9)) WHEN 1 THEN repeat(text, 40) ELSE text END)"
)


@query(rf"""WITH f AS (SELECT doc_id, encode({_FRAMED}) || CASE WHEN doc_id % 17 = 3 THEN '\xFF'::BLOB ELSE ''::BLOB END AS data FROM documents), t AS (SELECT doc_id, octet_length(data) AS size, try(decode(data)) AS text, data IS NULL AS gone FROM f),
e AS (SELECT doc_id, size, text, gone, list_first(list_filter(list_transform(flatten(list_transform([chr(10), chr(13) || chr(10)], lambda n: list_transform(['review', 'design', 'handoff'], lambda m: '{H.HEAD}' || n || 'mode: ' || m || n || n))), lambda p: CASE WHEN starts_with(text, p) THEN p END), lambda p: p IS NOT NULL)) AS head FROM t),
b AS (SELECT *, substr(text, length(head) + 1) AS body FROM e),
r AS (SELECT doc_id, head, body, CASE WHEN gone THEN 'missing' WHEN size > {H.LIMIT} THEN 'too_large' WHEN text IS NULL THEN 'not_text' WHEN head IS NULL THEN 'framing' WHEN regexp_matches(body, '^[\s\p{{Z}}]*$') THEN 'empty' END AS error FROM b)
SELECT doc_id, CASE WHEN error IS NULL THEN regexp_extract(head, 'mode: ([a-z]+)', 1) END AS mode, CASE WHEN error IS NULL THEN body END AS body, error FROM r""")
def handoff_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and body of hand-overs, or why they are none."""
    data = F.concat(F.encode(F.expr(_FRAMED), "UTF-8"), F.when(F.col("doc_id") % 17 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", H.parsed(data).alias("h")).select("doc_id", "h.*")


_WHEN = "CAST(doc_id % 1000 AS BIGINT)"


@query(f"""WITH d AS (SELECT doc_id, 'f' || doc_id AS path, text, strlen(text) AS size, {_WHEN} AS t FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT path, size, t FROM d WHERE doc_id % 23 <> 1), b AS (SELECT path, CASE WHEN doc_id % 7 = 1 THEN text || '+' ELSE text END AS content, CASE WHEN doc_id % 7 = 1 THEN size + 1 ELSE size END AS size, t + CASE WHEN doc_id % 11 = 2 THEN 1 ELSE 0 END AS t FROM d WHERE doc_id % 19 <> 3),
c AS (SELECT path, CASE WHEN doc_id % 7 = 1 THEN size + 1 ELSE size END AS size, t + CASE WHEN doc_id % 11 = 2 THEN 1 WHEN doc_id % 13 = 5 THEN 9 ELSE 0 END AS t FROM d WHERE doc_id % 17 <> 4),
o AS (SELECT a.path, b.content, CASE WHEN a.size > {N.REVIEW_FILE_BYTES} THEN 'oversized' WHEN c.size IS NULL THEN 'unavailable' WHEN b.path IS NULL OR b.size > {N.REVIEW_FILE_BYTES} THEN CASE WHEN c.size > {N.REVIEW_FILE_BYTES} THEN 'oversized' ELSE 'unavailable' END
  WHEN strlen(b.content) > {N.REVIEW_FILE_BYTES} THEN 'oversized' WHEN a.size = b.size AND b.size = c.size AND a.t = b.t AND b.t = c.t AND strlen(b.content) = b.size THEN 'ok' ELSE 'changed' END AS outcome FROM a LEFT JOIN b USING (path) LEFT JOIN c USING (path))
SELECT path, outcome, CASE WHEN outcome = 'ok' THEN content END AS content FROM o""")
def stable_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of reads between two listings, of which some files change, grow or go."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text", F.octet_length("text").alias("size"), F.expr(_WHEN).alias("mtime"))
    grown = F.when(F.col("doc_id") % 7 == 1, 1).otherwise(0)
    touched = F.when(F.col("doc_id") % 11 == 2, 1)
    before = docs.where("doc_id % 23 <> 1").select("path", "size", "mtime")
    content = F.when(grown == 1, F.concat("text", F.lit("+"))).otherwise(F.col("text"))
    read = docs.where("doc_id % 19 <> 3").select("path", (F.col("size") + grown).alias("size"), (F.col("mtime") + touched.otherwise(0)).alias("mtime"), content.alias("content")).where(F.col("size") <= N.REVIEW_FILE_BYTES)
    after = docs.where("doc_id % 17 <> 4").select("path", (F.col("size") + grown).alias("size"), (F.col("mtime") + touched.when(F.col("doc_id") % 13 == 5, 9).otherwise(0)).alias("mtime"))
    return S.stable(before, read, after, N.REVIEW_FILE_BYTES)
