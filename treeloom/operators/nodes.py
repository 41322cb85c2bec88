"""Node projects: manifests of mixed shapes, workspaces, frameworks and the files that an overview shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.operators.paths import ancestors
from treeloom.operators.ranking import top_k
from treeloom.operators.spans import trim
from treeloom.operators.tagging import usable

_STRINGS, _MAPS = ("name", "main", "module", "types"), ("scripts", "dependencies", "devDependencies")


def _kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...>, ...; VOID for null and what isn't there."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _as_text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def with_manifest(rows: DataFrame, text: str) -> DataFrame:
    """Adds what a package manifest says: ok, name, main, module, types, bins, workspaces, scripts, dependencies, typescript, eligible.

    ``ok`` is false, and the rest empty, for malformed JSON and for fields of another type than theirs.  ``bin`` may be a path or a map, ``workspaces`` a list or
    an object with a list; entries that aren't strings are passed over.  A manifest that says nothing is not ``eligible``.
    """
    read = rows.withColumn("_v", F.try_parse_json(text))
    get = lambda path, kind="variant": F.try_variant_get("_v", f"$.{path}", kind)
    each = lambda path, shape: F.coalesce(get(path, shape), F.expr(f"cast(array() as {shape})") if shape.startswith("array") else F.expr(f"cast(map() as {shape})"))
    plain = reduce(lambda a, b: a & b, [_kind(get(f)).isin("STRING", "VOID") for f in _STRINGS])
    maps = reduce(lambda a, b: a & b, [(_kind(get(f)) == "VOID") | (F.startswith(_kind(get(f)), F.lit("OBJECT")) & F.forall(F.map_values(each(f, "map<string,variant>")), lambda x: _kind(x).isin("STRING", "VOID"))) for f in _MAPS])
    whole = F.col("_v").isNotNull() & (F.startswith(_kind(F.col("_v")), F.lit("OBJECT")) | (_kind(F.col("_v")) == "VOID"))
    read = read.withColumn("ok", F.coalesce(whole & plain & maps, F.lit(False)))
    strings = lambda values: F.filter(F.transform(values, _as_text), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    bins = F.when(_kind(get("bin")) == "STRING", F.array(get("bin", "string"))).when(F.startswith(_kind(get("bin")), F.lit("OBJECT")), strings(F.map_values(each("bin", "map<string,variant>")))).otherwise(none)
    listed = F.when(F.startswith(_kind(get("workspaces")), F.lit("ARRAY")), strings(each("workspaces", "array<variant>"))).when(F.startswith(_kind(get("workspaces.packages")), F.lit("ARRAY")), strings(each("workspaces.packages", "array<variant>"))).otherwise(none)
    values = lambda f: F.map_values(each(f, "map<string,string>"))
    keys = lambda f: F.map_keys(each(f, "map<string,variant>"))
    found = {
        **{f: F.coalesce(get(f, "string"), F.lit("")) for f in _STRINGS}, "bins": F.array_sort(bins), "workspaces": F.filter(F.transform(listed, trim), lambda x: x != ""), "scripts": F.array_sort(F.filter(values("scripts"), lambda x: x.isNotNull())),
        "dependencies": F.array_sort(F.array_distinct(F.concat(keys("dependencies"), keys("devDependencies")))),
    }
    says = (_kind(get("bin")) != "VOID") | (F.size(each("scripts", "map<string,variant>")) > 0)
    made = read.select("*", says.alias("_says"), *(F.when(F.col("ok"), c).otherwise(F.lit("") if name in _STRINGS else none).alias(name) for name, c in found.items()))
    said = reduce(lambda a, b: a | b, [F.col(f) != "" for f in _STRINGS]) | F.col("_says") | (F.size("workspaces") > 0) | (F.size("dependencies") > 0)
    return made.withColumns({"typescript": F.col("ok") & ((F.col("types") != "") | F.array_contains("dependencies", "typescript")), "eligible": F.col("ok") & said}).drop("_v", "_says")


def pnpm_patterns(text: str) -> Column:
    """Patterns of a workspace file: the items of its ``packages:`` list, up to the next key."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    start = F.array_position(lines, "packages:").cast("int")
    rest = F.when(start > 0, F.slice(lines, start + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))

    def items(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda x: F.endswith(x, F.lit(":")) & ~F.startswith(x, F.lit("-"))), True).cast("int")
        own = F.filter(F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest), lambda x: F.startswith(x, F.lit("-")))
        return F.filter(F.transform(own, lambda x: F.regexp_replace(trim(F.substring(x, 2, 1 << 30)), "^[\"']+|[\"']+$", "")), lambda x: x != "")

    return F.transform(F.array(rest), items)[0]


def workspace_roots(modules: DataFrame, known: DataFrame) -> DataFrame:
    """(project, dir, pattern, root): directories with a manifest that the ``patterns`` of a module (project, dir, patterns) name.

    A pattern is a path, or a path and ``/*`` for the directories right below it less ignored ones; others name nothing.  ``known``: (project, path).
    """
    below = lambda d, rel: F.when(d == "", rel).otherwise(F.concat(d, F.lit("/"), rel))
    asked = modules.select("project", "dir", F.explode("patterns").alias("pattern")).withColumn("rel", usable(F.col("pattern"))).where("rel is not null")
    stars = F.length("rel") - F.length(F.replace("rel", F.lit("*"), F.lit("")))
    asked = asked.withColumn("stars", stars).where((stars == 0) | ((stars == 1) & F.endswith("rel", F.lit("/*"))))
    base = F.when(F.col("stars") == 1, F.expr("substring(rel, 1, length(rel) - 2)")).otherwise(F.col("rel"))
    asked = asked.withColumn("base", below(F.col("dir"), base))
    held = known.where(F.col("path").endswith("/package.json")).select("project", F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct()
    named = asked.where("stars = 0").join(held.withColumn("base", F.col("root")), ["project", "base"])
    up, last = F.regexp_replace("root", "/?[^/]*$", ""), F.element_at(F.split("root", "/"), -1)
    children = asked.where("stars = 1").join(held.where(~last.isin(N.IGNORED_DIRS)).withColumn("base", up), ["project", "base"])
    return named.select("project", "dir", "pattern", "root").unionByName(children.select("project", "dir", "pattern", "root")).distinct()


def node_modules(marked: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The rows of ``marked`` (project, dir, ok, eligible, ...) that are modules: eligible manifests near the root outside of top operations directories, and what workspaces name."""
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    near = (F.size(parts) <= N.MARKER_DEPTH) & ~F.exists(parts, lambda x: x.isin(N.MARKER_IGNORED_DIRS)) & ~F.coalesce(F.get(parts, F.lit(0)).isin(N.OPS_DIRS), F.lit(False))
    named = workspaces.select("project", F.col("root").alias("dir")).distinct().withColumn("_named", F.lit(True))
    return marked.join(named, ["project", "dir"], "left").where("ok").where((F.col("eligible") & near) | F.col("_named")).drop("_named")


def _tails(path: Column) -> Column:
    """(dir, rel) for the last one and the last two parts of a path."""
    parts = F.split(path, "/")
    cut = lambda k: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("dir"), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/").alias("rel"))
    return F.when(F.size(parts) > 1, F.array(cut(F.lit(1)), cut(F.lit(2)))).otherwise(F.array(cut(F.lit(1))))


def with_found(modules: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``found``: which of the paths that prove a framework a module has, as files or directories."""
    probes = sorted({p for _, _, shown, more, *_ in N.FRAMEWORKS for p in [*shown, *more]})
    paths = known.select("project", "path").unionByName(known.select("project", F.explode(ancestors("path")).alias("path"))).distinct()
    hits = paths.select("project", F.explode(_tails(F.col("path"))).alias("t")).select("project", "t.dir", "t.rel").where(F.col("rel").isin(probes))
    found = hits.join(modules.select("project", "dir"), ["project", "dir"]).groupBy("project", "dir").agg(F.array_sort(F.collect_set("rel")).alias("found"))  # at most the fixed paths
    return modules.join(found, ["project", "dir"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def _proves(framework: tuple, overview: bool) -> Column:
    _, needs, shown, more, *_ = framework
    has = lambda column, values: F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)))
    return has("dependencies", needs) & has("found", [*shown, *(more if overview else [])])


def stacks(modules: DataFrame, known: DataFrame) -> DataFrame:
    """(project, stack): build systems by marker and frameworks by dependency and path, in a fixed order, outside ignored and top operations directories.

    ``modules``: every manifest that can be read, with ``found``.
    """
    parts = F.split("path", "/")
    seen = known.where(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(N.IGNORED_DIRS)) & ((F.size(parts) == 1) | ~parts[0].isin(N.OPS_DIRS)))
    name = F.element_at(parts, -1)
    builds = seen.groupBy("project").agg(F.array_compact(F.array(*(F.when(F.max(name.isin(names)), label) for label, names in N.BUILD_MARKERS))).alias("builds"))
    dirs = F.filter(F.split("dir", "/"), lambda x: x != "")
    used = modules.where(~F.exists(dirs, lambda x: x.isin(N.IGNORED_DIRS)) & ~F.coalesce(F.get(dirs, F.lit(0)).isin(N.OPS_DIRS), F.lit(False)))
    frames = used.groupBy("project").agg(F.array_compact(F.array(*(F.when(F.max(_proves(f, False)), f[0]) for f in N.FRAMEWORKS))).alias("frames"))
    return builds.join(frames, "project", "left").select("project", F.array_join(F.concat("builds", F.coalesce("frames", F.array().cast("array<string>"))), ", ").alias("stack"))


def script_tokens(script: Column) -> Column:
    """Words of a command line that look like paths: no flags, assignments or commands; quotes go."""
    words = F.transform(F.split(trim(script), r"\s+"), lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", ""))
    looks = lambda w: F.contains(w, F.lit("/")) | F.contains(w, F.lit("\\")) | F.lower(F.regexp_extract(w, r"([.][^./]*)$", 1)).isin(N.NODE_EXT)
    return F.filter(words, lambda w: (w != "") & ~F.startswith(w, F.lit("-")) & ~F.contains(w, F.lit("=")) & ~w.isin(N.NODE_COMMANDS) & looks(w))


def overview_rank(path: str = "path") -> Column:
    """Order of an overview's files by name, by name at the root, and by the beginning of their path."""
    base, root, col = F.lower(F.element_at(F.split(path, "/"), -1)), ~F.contains(F.col(path), F.lit("/")), F.col(path)
    found, rank = F.when(base.isin(N.OVERVIEW_NAMES[0]), 0), 0
    for names in N.OVERVIEW_NAMES[1:]:
        rank += 1
        found = found.when(base.isin(names), rank)
    for names in N.OVERVIEW_ROOT_NAMES:
        rank += 1
        found = found.when(root & base.isin(names), rank)
    for starts in N.OVERVIEW_STARTS:
        rank += 1
        found = found.when(reduce(lambda a, b: a | b, [F.startswith(col, F.lit(s)) for s in starts]), rank)
    return found.when(F.endswith(base, F.lit(".d.ts")), rank + 1).when(F.startswith(col, F.lit("src/")), rank + 2).otherwise(rank + 3)


def overviews(modules: DataFrame, known: DataFrame, k: int = N.ROOT_TOP) -> DataFrame:
    """(project, dir, nth, path, size, overview_rank): the files that tell of a module, k at most.

    Candidates are fixed names at its root, what the manifest names (entries, bins, words of scripts), and for each framework that it proves fixed names
    and the first source file in fixed directories, in the order of a walk; those that exist and aren't left out are ranked.  ``modules``: with manifest and
    ``found``; ``known``: (project, path, size).
    """
    dirs = sorted({d for f in N.FRAMEWORKS for d in f[5]})
    parts = F.split("path", "/")
    sources = known.where(F.lower(F.regexp_extract("path", r"([.][^./]*)$", 1)).isin([*N.NODE_EXT, ".vue"])).select("project", "path", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("above"), F.slice(parts, i + 1, F.size(parts) - i - 1).alias("between")))).alias("a"))
    sources = sources.where(~F.exists("a.between", lambda x: x.isin(N.IGNORED_DIRS))).select("project", "path", F.explode(_tails(F.col("a.above"))).alias("t")).select("project", "path", "t.dir", "t.rel").where(F.col("rel").isin(dirs))
    first = sources.join(modules.select("project", "dir"), ["project", "dir"]).groupBy("project", "dir", "rel").agg(F.min_by("path", F.split("path", "/")).alias("path"))
    first = first.groupBy("project", "dir").agg(F.map_from_entries(F.collect_list(F.struct("rel", "path"))).alias("firsts"))  # at most the fixed directories
    rows = modules.join(first, ["project", "dir"], "left")
    below = lambda rel: F.when(F.col("dir") == "", rel).otherwise(F.concat("dir", F.lit("/"), rel))
    fixed = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    named = F.concat(F.array("main", "module", "types"), "bins", F.flatten(F.transform("scripts", script_tokens)))
    named = F.transform(named, lambda x: usable(F.regexp_replace(trim(x), "^[\"']+|[\"']+$", "")))
    shown = [F.when(_proves(f, True), F.concat(F.transform(fixed(f[4]), below), F.transform(fixed(f[5]), lambda d: F.try_element_at("firsts", d)) if f[5] else fixed([]))).otherwise(fixed([])) for f in N.FRAMEWORKS]
    every = F.array_distinct(F.array_compact(F.concat(F.transform(fixed(N.NODE_ROOT_FILES), below), F.transform(named, below), *shown)))
    asked = rows.select("project", "dir", F.explode(every).alias("path"))
    found = asked.join(known, ["project", "path"]).withColumn("name", F.element_at(F.split("path", "/"), -1))
    left_out = C.is_sensitive() | F.lower("name").isin(N.NOISE) | C.lower("name").rlike("(" + "|".join(x.replace(".", "[.]") for x in N.COMPILED_EXT) + ")$")
    ranked = found.where(~left_out).withColumn("overview_rank", overview_rank())
    return top_k(ranked, ["project", "dir"], [F.asc("overview_rank"), F.desc("size"), F.asc("path")], k).select("project", "dir", F.col("rank").alias("nth"), "path", "size", F.col("overview_rank").cast("long").alias("overview_rank"))
