"""Hand-overs: framed files that are read once and then gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeloom.operators.spans import trim

#: A hand-over's frame: this line, a line with its mode, an empty line; all three end in the same way.
HEAD, MODES, LIMIT = "HANDOFF-V1", ("review", "design", "handoff"), 64 << 10


def parsed(data: Column, limit: int = LIMIT) -> Column:
    """struct(mode, body, error) of a file's bytes; errors: ``missing``, ``too_large``, ``not_text``, ``framing``, ``empty``."""
    text = data.cast("string")
    frame = rf"(?s)\A{HEAD}(\r?\n)mode: ({'|'.join(MODES)})\1\1(.*)\z"
    mode, body = F.regexp_extract(text, frame, 2), F.regexp_extract(text, frame, 3)
    error = (
        F.when(data.isNull(), "missing").when(F.octet_length(data) > limit, "too_large").when(~F.is_valid_utf8(text), "not_text").when(mode == "", "framing").when(trim(body) == "", "empty")
    )
    return F.struct(F.when(error.isNull(), mode).alias("mode"), F.when(error.isNull(), body).alias("body"), error.alias("error"))


def handovers(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, mode, body, error) of the files that come into ``folder``; each is read in one batch and deleted once a later one is done.

    Rows with an error name the file, so that whoever sent it can be told.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(shape).option("cleanSource", "delete").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", parsed(F.col("content")).alias("h")).select("path", "h.*")


def consume(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what lies in ``folder`` now and appends it to ``out``; what is noted in ``checkpoint`` is never read again, by whatever start."""
    return handovers(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
