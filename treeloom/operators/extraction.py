"""From selectors to a bounded context: resolution, safety, anchors, spans, sections and their verdict, as one chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.operators import prompts as P
from treeloom.operators import selectors as L
from treeloom.operators import spans as S
from treeloom.operators.modules import verdict


def spans_of(wanted: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """(sel_path, type, pattern, section) for each different selector of ``wanted`` whose path is in ``files`` (path, kind, size, text).

    FILE takes the whole file, PREFIX and NEAR the span at the first line that begins with, or contains, the pattern; assets and binary files are told by a summary.
    A selector that many requests share is worked out once.
    """
    each = wanted.select("sel_path", "type", F.when(F.col("type") == "FILE", "").otherwise(F.col("pattern")).alias("pattern")).distinct()
    rows = each.join(files.select(F.col("path").alias("sel_path"), "kind", "size", F.coalesce("text", F.lit("")).alias("text")), "sel_path")
    summary = F.concat_ws("\n", F.concat(F.lit("Binary file: "), "sel_path"), F.concat(F.lit("Kind: "), "kind"), F.concat(F.lit("Size: "), C.size_label()))
    whole = rows.where("kind <> 'source' or type = 'FILE'").withColumn("content", F.when(F.col("kind") == "source", F.col("text")).otherwise(summary)).withColumn("full_file", F.lit(True))
    parts = rows.where("kind = 'source' and type <> 'FILE'").withColumn("lines", S.lines_of("text"))
    near, prefix = S.first_match(F.col("lines"), F.col("pattern"), near=True), S.first_match(F.col("lines"), F.col("pattern"), near=False)
    parts = parts.withColumn("at", F.when(F.col("type") == "NEAR", near).otherwise(prefix))
    parts = parts.withColumn("start", F.when(F.col("at") < 0, 0).otherwise(S.extend(F.col("lines"), F.col("at"))))
    names = ["sel_path", "type", "pattern", "full_file", "content"]
    # Generators keep each content and section in one place, where later steps would repeat their long expressions.
    once = lambda rows, column, keep: rows.select(*keep, F.explode(F.array(column)))
    held = lambda rows: once(rows, F.struct("content"), names[:-1]).select(*names[:-1], "col.content")
    both = held(whole).unionByName(held(S.cascade(parts)))
    return once(both, P.section(F.col("sel_path"), "content", F.col("full_file"), limit), names[:3]).withColumnRenamed("col", "section")


def context(selectors: DataFrame, files: DataFrame, head: Callable[[Column], Column], limit: int = N.PROMPT_BYTES, file_limit: int = N.FILE_BYTES) -> DataFrame:
    """(req_id, n_ok, n_failed, n_excluded, verdict, kept, dropped, size, prompt) of each request of ``selectors`` (req_id, seq, line).

    Lines that are no selectors are passed over; FILE replaces other selectors of its path, repeated ones count once.  Sensitive paths are excluded before
    anything is read; of the rest, paths that aren't in ``files`` fail.  Sections follow in the selectors' order, the last ones go until the prompt fits.  ``files``: a row for each path.
    """
    asked = L.supersede(L.parse(selectors).where("code = 'ok'").select("req_id", "seq", "type", "sel_path", "pattern"))
    named = asked.withColumn("path", F.col("sel_path")).withColumn("name", F.element_at(F.split("sel_path", "/"), -1)).withColumn("sensitive", C.is_sensitive())
    safe = named.where("not sensitive").select("req_id", "seq", "type", "sel_path", F.when(F.col("type") == "FILE", "").otherwise(F.col("pattern")).alias("pattern"))
    found = spans_of(safe, files, file_limit)
    keys = ["sel_path", "type", "pattern"]
    # Whether a path is there needs no contents: that side reads paths alone.
    there = safe.join(files.select(F.col("path").alias("sel_path"), F.lit(True).alias("hit")), "sel_path", "left")
    status = there.select("req_id", F.when(F.col("hit"), "ok").otherwise("failed").alias("status")).unionByName(named.where("sensitive").select("req_id", F.lit("excluded").alias("status")))
    prompts = P.fitted(safe.join(found, keys).select("req_id", "seq", "section"), "req_id", "seq", head, limit)
    return verdict(status, ["req_id"]).join(prompts, "req_id", "left")
