"""References to files, resolved in the project first and then in read-only roots beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.paths import ancestors, clean

#: Kinds of keys: a path in a root, and an absolute path.
_IN, _AT = "in", "at"


def joined_path(base: str, rel: Column) -> Column:
    """``base/rel``, cleaned; absolute."""
    return F.concat(F.lit("/"), clean(F.concat(F.lit(base + "/"), rel)))


def last_component(path: Column) -> Column:
    """The last component of a root's display path; null where it names no directory."""
    name = F.element_at(F.split(clean(path), "/"), -1)
    return F.when(~name.isin("", ".", ".."), name)


def usable(path: Column) -> Column:
    """The cleaned form of a path that may be looked up in a root; null if empty, absolute or upward."""
    whole, cleaned = F.trim(path), clean(F.trim(path))
    return F.when((whole != "") & ~F.startswith(whole, F.lit("/")) & (cleaned != "") & (cleaned != "..") & ~F.startswith(cleaned, F.lit("../")), cleaned)


def root_keys(outside: DataFrame) -> DataFrame:
    """(kind, prefix, rel, file): what each file of ``outside`` (display, root, rel) can be asked for by.

    The path in its root alone, behind the root's display path, behind that less leading dots and slashes, and behind its last component; and
    the absolute path.  Display paths and roots have no slash at their end.
    """
    file = F.concat_ws("/", "root", "rel")
    stripped = F.nullif(F.regexp_replace("display", r"^[./]+", ""), F.lit(""))
    prefixes = F.array_compact(F.array_distinct(F.array(F.lit(""), F.col("display"), stripped, last_component(F.col("display")))))
    inner = outside.select(F.lit(_IN).alias("kind"), F.explode(prefixes).alias("prefix"), "rel", file.alias("file"))
    return inner.unionByName(outside.select(F.lit(_AT).alias("kind"), F.lit("").alias("prefix"), file.alias("rel"), file.alias("file"))).distinct()


def _asked(ref: Column, project: str) -> Column:
    """What a reference may mean outside the project, as array of struct(kind, prefix, rel)."""
    key = lambda kind, prefix, rel: F.struct(F.lit(kind).alias("kind"), prefix.alias("prefix"), rel.alias("rel"))
    parts = F.split(ref, "/")
    cuts = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: key(_IN, F.array_join(F.slice(parts, 1, k), "/"), usable(F.array_join(F.slice(parts, k + 1, F.size(parts)), "/")))))
    upward = F.when(usable(ref).isNull(), joined_path(project, ref))
    every = F.concat(F.array(key(_IN, F.lit(""), usable(ref)), key(_AT, F.lit(""), upward)), F.coalesce(cuts, F.array().cast("array<struct<kind:string,prefix:string,rel:string>>")))
    return F.array_distinct(F.filter(every, lambda k: k["rel"].isNotNull() & ((k["prefix"] != "") | (k["kind"] == _AT) | (k["rel"] == usable(ref)))))


def resolve(refs: DataFrame, inside: DataFrame, outside: DataFrame, project: str) -> DataFrame:
    """(ref, status, path, source): what each different ``ref`` of ``refs`` stands for.

    ``inside`` (rel): files of the project, which lies at the absolute path ``project``; ``outside`` (display, root, rel): files of other roots that
    aren't left out.  A path in the project decides, be it a file (``local``) or a ``directory``; what isn't there, or leads out of the project, is
    looked for in all roots at once: one file found is ``external``, several are ``ambiguous``, none is ``missing`` or ``outside``.  Absolute paths are
    ``absolute``, those that clean up to nothing ``empty``.  One equi-join on (kind, prefix, path) serves all ways to name a file.
    """
    asked = refs.select("ref").where("ref is not null").distinct().withColumn("own", usable(F.col("ref")))
    dirs = inside.select(F.explode(ancestors("rel")).alias("own")).distinct().withColumn("is_dir", F.lit(True))
    here = inside.select(F.col("rel").alias("own")).distinct().withColumn("is_file", F.lit(True))
    known = asked.join(here, "own", "left").join(dirs, "own", "left")
    whole = F.trim("ref")
    first = (
        F.when(whole == "", "empty").when(F.startswith(whole, F.lit("/")), "absolute").when(clean(whole) == "", "empty").when(F.col("is_file"), "local").when(F.col("is_dir"), "directory")
        .when(F.col("own").isNull(), "outside").otherwise("missing")
    )
    known = known.select("ref", "own", first.alias("first"))
    keys = known.where("first in ('outside', 'missing')").select("ref", F.explode(_asked(F.col("ref"), project)).alias("k")).select("ref", "k.*")
    hits = keys.join(root_keys(outside), ["kind", "prefix", "rel"]).select("ref", "file").distinct().groupBy("ref").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    found = known.join(hits, "ref", "left")
    status = F.when(F.col("n") == 1, "external").when(F.col("n") > 1, "ambiguous").otherwise(F.col("first"))
    return found.select("ref", status.alias("status"), F.when(F.col("first") == "local", F.col("own")).when(F.col("n") == 1, F.col("ref")).alias("path"), F.when(F.col("n") == 1, F.col("file")).alias("source"))
