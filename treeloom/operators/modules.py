"""Modules of several languages side by side: markers, owners, rollups, their union, and resolution in module order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.operators.ranking import joined, top_k


def _in_ignored(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.isin(N.MARKER_IGNORED_DIRS))


def _above(column: str) -> Column:
    """A directory, all above it, and the root."""
    parts = F.split(column, "/")
    return F.when(F.col(column) == "", F.array(F.lit(""))).otherwise(F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.lit("")))


def detect_all(files: DataFrame) -> DataFrame:
    """(language, root, dir, path, name, size) of all detectors' files, each owned by the nearest directory above that holds a marker of its language.

    ``files``: a row for each path.  Markers and files under ignored directories don't count; markers may stand so deep only.  Of a language without markers
    the whole of a project (the first directory) is one module.  Files are tagged with their own language and the one that they mark in one pass; directories, a
    row each, are matched with the roots above them.
    """
    table = lambda at: F.create_map(*[F.lit(x) for d in N.DETECTORS for v in d[at] for x in (v, d[0])])
    parents = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    marks = F.try_element_at(table(1), F.lower("name"))
    reach = reduce(lambda found, d: found.when(marks == d[0], parents <= d[3] if d[3] is not None else F.lit(True)), N.DETECTORS[1:], F.when(marks == N.DETECTORS[0][0], parents <= N.DETECTORS[0][3]))
    tagged = files.where(~_in_ignored(F.col("path"))).select("dir", "path", "name", "size", F.try_element_at(table(2), F.col("ext")).alias("language"), F.when(reach, marks).alias("marks"))
    by_dir = tagged.groupBy("dir").agg(F.collect_set("language").alias("languages"), F.collect_set("marks").alias("marks"))  # at most one for each detector
    marked = [d[0] for d in N.DETECTORS if d[1]]
    roots = by_dir.select(F.explode("marks").alias("language"), F.col("dir").alias("root"))
    wanted = by_dir.select("dir", F.explode("languages").alias("language")).where(F.col("language").isin(marked)).select("language", "dir", F.explode(_above("dir")).alias("root"))
    nearest = wanted.join(roots, ["language", "root"]).groupBy("language", "dir").agg(F.max_by("root", F.length("root")).alias("root"))
    owned = tagged.where("language is not null").join(nearest, ["language", "dir"], "left")
    whole = F.when(~F.col("language").isin(marked), F.when(F.col("dir") == "", "").otherwise(F.split("dir", "/")[0]))
    return owned.withColumn("root", F.coalesce("root", whole)).where("root is not null").select("language", "root", "dir", "path", "name", "size")


def with_fallback(owned: DataFrame, files: DataFrame, omitted: Column) -> DataFrame:
    """``owned`` and, for projects (first directories) of ``files`` in which no detector found a file, one generic module of all files that aren't ``omitted``.

    A generic module's language is that of most of its files, of equal ones the first by name; Generic without any.
    """
    project = F.split("dir", "/")[0]
    found = owned.select(F.split("root", "/")[0].alias("root")).distinct()
    rest = files.where(~omitted & ~_in_ignored(F.col("path"))).withColumn("root", project).join(found, "root", "left_anti")
    said = languages(rest, ["root"]).select("root", "language")
    return owned.unionByName(rest.join(said, "root").select("language", "root", "dir", "path", "name", "size"))


def rollup(owned: DataFrame) -> DataFrame:
    """(language, root, n_packages, n_files, size, heaviest) of each module; of equal sizes the first path."""
    heavy = F.min_by("path", F.struct(-F.col("size"), F.col("path")))
    return owned.groupBy("language", "root").agg(F.count_distinct("dir").alias("n_packages"), F.count("*").alias("n_files"), F.sum("size").alias("size"), heavy.alias("heaviest"))


def packages(owned: DataFrame, k: int = N.PACKAGE_TOP) -> DataFrame:
    """(dir, ord, n_files, tops): packages of all modules in one list by path: counts added up, first places kept, top files merged.

    ord is the place of the first module, by root and language, that holds the package.
    """
    tops = top_k(owned, ["language", "root", "dir"], [F.desc("size"), F.asc("path")], k)
    merged = tops.select("dir", "path", "size").distinct().withColumn("by", F.struct(-F.col("size"), F.col("path")))
    names = merged.groupBy("dir").agg(joined("path", "by", ",").alias("tops"))  # at most k for each language
    counts = owned.groupBy("dir").agg(F.count("*").alias("n_files"), F.min(F.struct("root", "language")).alias("first"))
    return counts.join(names, "dir").select("dir", F.concat_ws("|", "first.root", "first.language").alias("first"), "n_files", "tops")


def by_name(owned: DataFrame) -> DataFrame:
    """(name, by_name): what a bare name stands for: in the first module (by root, language) whose heaviest file has that name, or else whose
    first source directory holds such a file."""
    heavy = rollup(owned).select("language", "root", F.element_at(F.split("heaviest", "/"), -1).alias("name"), F.lit(0).alias("probe"), F.lit("").alias("dir"), F.col("heaviest").alias("path"))
    held = owned.select("language", "root", "name", F.lit(1).alias("probe"), "dir", "path")
    return heavy.unionByName(held).groupBy("name").agg(F.min(F.struct("root", "language", "probe", "dir", "path"))["path"].alias("by_name"))


def external_keys(files: DataFrame) -> DataFrame:
    """(request, n, first): every string that names an external file (root, rel): its path under the root, its display path and the ends of that; how many files, and the first."""
    shown = files.select(F.concat_ws("/", "root", "rel").alias("display"), "rel").distinct()
    parts = F.split("display", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = shown.select("display", F.explode(F.array_distinct(F.array_append(ends, F.col("rel")))).alias("request"))
    return keys.groupBy("request").agg(F.count("*").alias("n"), F.min("display").alias("first"))


def languages(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, language, languages, n_files): the language of most files (of equal ones the first by name; Generic without any), and all of them."""
    table = F.create_map(*[F.lit(x) for pair in N.LANGUAGES.items() for x in pair])
    counted = files.withColumn("language", F.try_element_at(table, F.col("ext"))).groupBy(*keys, "language").agg(F.count("*").alias("n"))
    best = F.min_by("language", F.when(F.col("language").isNotNull(), F.struct(-F.col("n"), F.col("language"))))
    every = F.array_join(F.array_sort(F.collect_set("language")), ",")  # at most 13
    return counted.groupBy(*keys).agg(F.coalesce(best, F.lit("Generic")).alias("language"), every.alias("languages"), F.sum("n").alias("n_files"))


def verdict(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_ok, n_failed, n_excluded, verdict) of statuses ok, failed and excluded.

    Some and nothing else: ok; some and failures: proceed; none: failed, or no_safe_files where all were excluded.
    """
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "failed", "excluded")}
    counts = statuses.groupBy(*keys).agg(*(c.alias(f"n_{s}") for s, c in n.items()))
    says = F.when((F.col("n_ok") > 0) & (F.col("n_failed") + F.col("n_excluded") > 0), "proceed").when(F.col("n_ok") > 0, "ok").when(F.col("n_failed") > 0, "failed").when(F.col("n_excluded") > 0, "no_safe_files").otherwise("empty")
    return counts.withColumn("verdict", says)


def suppressed(lines: DataFrame, keys: list[str], order: list[str], over: str, header: int) -> DataFrame:
    """Adds suppressed: status lines (size: bytes with the line end) go from the tail until ``over`` bytes are saved; with the last line goes the header."""
    tail = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.sum("size").over(tail), F.lit(0))
    whole = F.sum("size").over(Window.partitionBy(*keys))
    fits = F.col(over) <= whole + header
    return lines.withColumn("suppressed", F.when(~fits, F.lit(None)).otherwise(saved < F.col(over)))
