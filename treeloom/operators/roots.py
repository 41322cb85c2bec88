"""Source roots of Java modules, chosen one after another, and a walk whose caps take whole subtrees along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.operators.paths import is_within


def _related(a: Column, b: Column) -> Column:
    return is_within(a, b) | is_within(b, a)


def chosen_roots(candidates: Column) -> Column:
    """Of an array of struct(rank, rel), in order, those that neither hold nor lie in one chosen before."""
    step = lambda taken, c: F.when(F.exists(taken, lambda t: _related(t, c["rel"])), taken).otherwise(F.array_append(taken, c["rel"]))
    return F.aggregate(F.array_sort(candidates), F.array().cast("array<string>"), step)


def _places(root: str) -> Column:
    """Array of struct(rel, dir): where the parts of ``root`` stand in the parts ``_p`` of a path, before its name, and what is above."""
    n = root.count("/") + 1
    here = lambda i: (F.array_join(F.slice("_p", i + 1, n), "/") == root) & (i + n < F.size("_p"))
    found = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), here)
    return F.transform(found, lambda i: F.struct(F.lit(root).alias("rel"), F.array_join(F.slice("_p", 1, i), "/").alias("dir")))


def java_files(known: DataFrame, modules: DataFrame, roots: list[str] = N.JAVA_ROOTS) -> DataFrame:
    """(project, dir, rel, path, size): sources and resources of modules (project, dir) in each root ``rel`` that they may have.

    A file is dealt out to its own directories that end like a root, so modules are found by an equi-join; it belongs to the roots of all modules around it.
    """
    ext = F.lower(F.regexp_extract("path", r"([.][^./]*)$", 1))
    wanted = known.where(F.col("path").endswith(".java") | ext.isin(N.JAVA_RESOURCES))
    rows = wanted.withColumn("_p", F.split("path", "/")).withColumn("_at", F.explode(F.flatten(F.array(*map(_places, roots))))).select("project", "_at.dir", "_at.rel", "path", "size")
    return rows.join(modules.select("project", "dir").distinct(), ["project", "dir"], "left_semi")


def java_roots(known: DataFrame, modules: DataFrame, roots: list[str] = N.JAVA_ROOTS) -> tuple[DataFrame, DataFrame]:
    """Source roots (project, dir, root, role, n_files, n_packages) of Java modules, and their packages (project, dir, root, package, name, n_files, size).

    Roots are tried in a fixed order; one that holds no file, or overlaps one chosen before, is passed over.
    """
    rows = java_files(known, modules, roots)
    held = rows.select("project", "dir", "rel").distinct().groupBy("project", "dir").agg(F.collect_list(F.struct(F.array_position(F.lit(roots), F.col("rel")).alias("rank"), "rel")).alias("candidates"))  # at most the fixed roots
    taken = held.select("project", "dir", F.explode(chosen_roots(F.col("candidates"))).alias("rel"))
    own = rows.join(taken, ["project", "dir", "rel"])
    root = F.when(F.col("dir") == "", F.col("rel")).otherwise(F.concat("dir", F.lit("/"), "rel"))
    own = own.withColumn("root", root).withColumn("package", F.regexp_replace("path", "/[^/]*$", ""))
    inner = F.when(F.col("package") == F.col("root"), "default").otherwise(F.replace(F.expr("substring(package, length(root) + 2)"), F.lit("/"), F.lit(".")))
    packages = own.groupBy("project", "dir", "rel", "root", "package").agg(F.first(inner).alias("name"), F.count("*").alias("n_files"), F.sum("size").alias("size"))
    role = F.when(F.contains(F.col("rel"), F.lit("test")), "Test Source").otherwise("Main Source")
    sums = packages.groupBy("project", "dir", "rel", "root").agg(F.sum("n_files").alias("n_files"), F.count("*").alias("n_packages"))
    return sums.select("project", "dir", "root", role.alias("role"), "n_files", "n_packages"), packages.drop("rel")


def capped_walk(known: DataFrame, per_dir: int = N.DIR_FILES, total: int = N.SCAN_FILES, ignored: list[str] = N.IGNORED_DIRS) -> DataFrame:
    """(path, nth): the files that a walk in order of names gets to.

    Of a directory's entries, files and directories alike, the first ``per_dir`` by name count; a directory beyond them is not entered, nor is an ignored one, so
    all below it is lost.  Then the first ``total`` files of the walk stay.  Directories of more entries than ``per_dir`` are told by their last name that counts: what comes
    later is found by a join with those few, and taken off.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k - 1), "/").alias("above"), F.get(parts, k - 1).alias("entry")))
    rows = known.select("path").distinct()
    each = rows.select("path", F.explode(steps).alias("s")).select("path", "s.*")
    ranked = each.select("above", "entry").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("above").orderBy("entry"))).where(F.col("nth") <= per_dir)
    last = ranked.where(F.col("nth") == per_dir).select("above", F.col("entry").alias("last"))
    lost = each.join(last, "above").where(F.col("entry") > F.col("last")).select("path").distinct()
    seen = rows.where(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(ignored))).join(lost, "path", "left_anti")
    walk = seen.orderBy(F.split("path", "/")).limit(total)
    return walk.withColumn("nth", F.row_number().over(Window.orderBy(F.split("path", "/"))).cast("long"))  # ``total`` rows at most
