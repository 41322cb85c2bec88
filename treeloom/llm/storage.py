"""Intermediate results that outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; on a cluster that is an error, since each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treeloom-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, keeps whole results."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/treeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that saved() returned, once all that reads them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._treeloom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
