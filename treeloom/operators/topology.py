"""From files to packages, modules and the bounded map of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.operators.ranking import joined, top_k, winners


def candidates(files: DataFrame) -> DataFrame:
    """Shown files with kind, priority, language, module (first directory) and whether they are top files."""
    shown = files.withColumn("kind", C.kind()).where(~C.is_omitted())
    return shown.select(
        "doc_id", "dir", "name", "path", "size", "kind", C.priority().cast("long").alias("priority"), F.coalesce(C.language(), F.lit("Generic")).alias("language"),
        F.element_at(F.split("dir", "/"), 1).alias("module"), (F.col("kind") == "source").alias("in_top"),
    )


def depth(column: str = "dir") -> Column:
    return F.when(F.col(column) == "", 0).otherwise(F.size(F.split(column, "/"))).cast("long")


def dedupe(rows: DataFrame) -> DataFrame:
    """One file for each path: by priority, top file, size, package depth, then doc_id."""
    return winners(rows, ["path"], [F.desc("priority"), F.desc("in_top"), F.desc("size"), depth().desc(), F.asc("doc_id")])


def packages(rows: DataFrame) -> DataFrame:
    """(dir, file_count, total_bytes, lead_file, heaviest): lead by priority, size, path."""
    lead = F.max_by("path", F.struct(F.col("priority"), F.col("size"), F.col("doc_id")))
    heaviest = F.max_by("path", F.struct(F.col("size"), F.col("doc_id")))
    return rows.groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"), lead.alias("lead_file"), heaviest.alias("heaviest"))


def corrected(rows: DataFrame) -> DataFrame:
    """Packages' counts and bytes less the files that another package's copy won; empty packages go."""
    won = dedupe(rows).select("doc_id")
    lost = rows.join(won, "doc_id", "left_anti").groupBy("dir").agg(F.count("*").alias("lost"), F.sum("size").alias("lost_bytes"))
    both = packages(rows).join(lost, "dir", "left").fillna(0, ["lost", "lost_bytes"])
    fixed = both.select("dir", F.greatest(F.lit(0), F.col("file_count") - F.col("lost")).alias("file_count"), F.greatest(F.lit(0), F.col("total_bytes") - F.col("lost_bytes")).alias("total_bytes"))
    return fixed.where("file_count > 0")


def top_limit() -> Column:
    """10 at the root, 5 for documentation, operations and packages with Markdown, 10 for web files, else 3."""
    return (
        F.when(F.col("dir") == "", N.ROOT_TOP).when(F.split("dir", "/")[0].isin(N.STATIC_DIRS), N.GENERIC_TOP)
        .when(F.col("dir").isin("docs", "doc") | C.is_ops_dir() | F.col("has_md"), N.DOCS_TOP).otherwise(N.PACKAGE_TOP)
    )


def top_files(rows: DataFrame) -> DataFrame:
    limits = rows.groupBy("dir").agg(F.max(C.extension() == ".md").alias("has_md")).withColumn("top_limit", top_limit())
    # No limit is over ROOT_TOP, so that all but that many go before the shuffle.
    first = top_k(rows.where("in_top"), ["dir"], [F.desc("priority"), F.desc("size"), F.asc("path"), F.asc("doc_id")], N.ROOT_TOP)
    ranked = first.join(limits, "dir").where("rank <= top_limit")
    return ranked.select("dir", "rank", "path", "name", "size", "kind", "priority")


def aux_files(rows: DataFrame, k: int = N.PACKAGE_TOP) -> DataFrame:
    ranked = top_k(rows.where("not in_top"), ["dir"], [C.aux_rank().asc(), F.desc("size"), F.asc("path"), F.asc("doc_id")], k)
    return ranked.select("dir", "rank", "path", "name", "size", "kind")


def file_label() -> Column:
    """Path within the package, with its size and, unless it is source, its kind."""
    shown = F.when(F.col("dir") == "", F.col("path")).otherwise(F.col("name"))
    return F.concat(shown, F.lit(" ("), C.size_label(), F.when(F.col("kind") == "source", "").otherwise(F.concat(F.lit(", "), F.col("kind"))), F.lit(")"))


def package_lines(rows: DataFrame) -> DataFrame:
    """(dir, line): ``Pkg: dir [n files] -> Top: ...; Aux: ...`` of packages that show a file."""
    unique = dedupe(rows)
    label = lambda found: found.withColumn("label", file_label())
    top = label(top_files(unique)).groupBy("dir").agg(joined("label", "rank", ", ").alias("top"))
    aux = label(aux_files(unique)).groupBy("dir").agg(joined("label", "rank", ", ").alias("aux"))
    counts = unique.groupBy("dir").agg(F.count("*").alias("n"))
    both = counts.join(top, "dir", "left").join(aux, "dir", "left").where("top is not null or aux is not null")
    files = F.concat_ws("; ", F.concat(F.lit("Top: "), F.col("top")), F.concat(F.lit("Aux: "), F.col("aux")))
    return both.select("dir", F.concat(F.lit("Pkg: "), F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.lit(" ["), F.col("n").cast("string"), F.lit(" files] -> "), files).alias("line"))


def language_weights(rows: DataFrame) -> DataFrame:
    """(language, files, dominant): distinct source paths by language; the most, ties by name, is dominant."""
    counts = rows.where("in_top and language <> 'Generic'").groupBy("language").agg(F.countDistinct("path").alias("files"))
    best = counts.agg(F.max(F.struct("files")).alias("m"), F.min_by("language", F.struct(-F.col("files"), F.col("language"))).alias("best"))
    return counts.join(F.broadcast(best), how="cross").select("language", "files", (F.col("language") == F.col("best")).alias("dominant"))  # one row
