"""Views of the driver tables as a corpus of files, lines, selectors and snapshots; and of real directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of a file's place by doc_id; Spark and DuckDB both run it.
DIR_SQL = "CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 11 = 1 THEN 'docs' WHEN doc_id % 11 = 2 THEN 'deploy' WHEN doc_id % 11 = 3 THEN concat('public/', lang) ELSE concat('src/', source, '/', lang) END"
NAME_SQL = (
    "CASE WHEN doc_id % 50 = 0 THEN 'README.md' WHEN doc_id % 50 = 7 THEN '.env' WHEN doc_id % 50 = 9 THEN 'package.json' WHEN doc_id % 50 = 11 THEN 'Makefile' "
    "WHEN doc_id % 50 = 13 THEN 'id_rsa' WHEN doc_id % 50 = 17 THEN 'deploy.sh' WHEN doc_id % 50 = 19 THEN 'design-notes.md' WHEN doc_id % 50 = 23 THEN '.env.example' "
    "WHEN doc_id % 50 = 29 THEN 'test_case.py' WHEN doc_id % 50 = 31 THEN 'index.html' ELSE concat('f', CAST(doc_id AS varchar(20)), CASE doc_id % 7 WHEN 0 THEN '.go' WHEN 1 THEN '.py' "
    "WHEN 2 THEN '.png' WHEN 3 THEN '.jar' WHEN 4 THEN '.sql' WHEN 5 THEN '.ts' ELSE '' END) END"
)


def skipping(sql: str) -> str:
    """``sql`` for Spark, whose concat is null where a part is null; DuckDB's passes over such parts."""
    return sql.replace("concat(", "concat_ws('', ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, dir, name, path, ext, size, text) of ``documents``, and expressions over its columns; text is read only where it is used."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{skipping(DIR_SQL)} AS dir", f"{skipping(NAME_SQL)} AS name", *more)
    path = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    ext = F.regexp_extract("name", r"([.][^.]*)$", 1)
    return docs.select("doc_id", "dir", "name", path.alias("path"), ext.alias("ext"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text", *docs.columns[4:])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ln, line) of ``documents``: ln from 0, the empty string after a last newline is a line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).withColumn("ln", F.col("ln").cast("long"))


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, dir, size, mtime) of a real directory tree; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    prefix = root.rstrip("/") + "/"
    relative = F.expr(f"substring(path, locate('{prefix}', path) + {len(prefix)})")
    return found.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "size", "mtime"
    )
