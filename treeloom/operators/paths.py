"""Operators on paths and small text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """Without empty and '.' segments, '..' taking the segment before it away; the root is the empty string."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def is_within(path: Column, root: Column) -> Column:
    """Path is the root or below it; everything is below the empty root."""
    return (root == "") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(column: str) -> Column:
    """All proper ancestors of a directory, nearest last, the root left out."""
    parts = F.split(column, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def uncovered(roots: DataFrame, column: str = "dir") -> DataFrame:
    """Roots that no other root contains: an equi anti-join on exploded ancestors, not a prefix join."""
    above = roots.select(column, F.explode(ancestors(column)).alias("above"))
    covered = above.join(roots.select(F.col(column).alias("above")).distinct(), "above", "left_semi").select(column).distinct()
    return roots.join(covered, column, "left_anti")


def below_any(rows: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path is one of the roots or below one."""
    whole = rows.withColumn("above", F.explode(F.concat(ancestors(column), F.array(column))))
    return whole.join(roots.select(F.col("root").alias("above")).distinct(), "above", "left_semi").drop("above").distinct()


def source_role(column: str = "dir") -> Column:
    """Tests, commands, internals, packages or sources by the segments of a directory."""
    parts = F.split(F.lower(column), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.when(has("test", "tests", "testdata"), "Tests").when(has("cmd"), "Commands").when(has("internal"), "Internal").when(has("pkg"), "Packages").when(has("docs", "doc"), "Documentation").otherwise("Sources")


def script_paths(column: str) -> Column:
    """Path-like words of a command line: unquoted, no flags, assignments or operators."""
    words = F.transform(F.split(column, r"\s+"), lambda w: F.regexp_replace(w, "^[\"']|[\"']$", ""))
    return F.filter(words, lambda w: ~w.startswith("-") & ~w.contains("=") & w.rlike(r"^[\w.@/-]*(/|[.]\w+$)[\w./-]*$"))


def needs_quotes(path: Column) -> Column:
    return path.rlike(r"[^\p{L}\p{N}/.\-_~+]") | path.rlike(r"[.,;:)\]}]$")


def quoted(path: Column) -> Column:
    escaped = F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(needs_quotes(path), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(path)
