"""Classifiers of files as Column expressions over ``path``, ``name``, ``dir`` and, for content, ``text``.

All take the columns of the files frame and stay inside code generation; nulls count as empty strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions import names as N


def lower(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def extension(column: str = "name") -> Column:
    """The last dot and what follows, in lower case; names that begin with their only dot are all extension."""
    return F.regexp_extract(lower(column), r"([.][^.]*)$", 1)


def ends(column: Column, suffixes: list[str]) -> Column:
    return column.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")


def holds(column: Column, words: list[str]) -> Column:
    return column.rlike("|".join(map(re.escape, words)))


def kind_by_name() -> Column:
    """source, asset or binary; null where the name doesn't tell."""
    ext = extension()
    return F.when(ext.isin(N.SOURCE_EXT), "source").when(ext.isin(N.ASSET_EXT), "asset").when(ext.isin(N.BINARY_EXT), "binary").when(lower("name").isin(N.SOURCE_NAMES), "source")


def kind(text: str | None = None) -> Column:
    """Kind by name, else binary if the first 4096 bytes of ``text`` hold a NUL, else source."""
    known = kind_by_name()
    if text is None:
        return F.coalesce(known, F.lit("source"))
    binary = F.expr(f"position(X'00' in substring(encode(coalesce({text}, ''), 'UTF-8'), 1, 4096)) > 0")
    return F.coalesce(known, F.when(binary, "binary").otherwise("source"))


def is_sensitive() -> Column:
    base = lower("name")
    plain = base.isin(N.SENSITIVE_NAMES) | (base.startswith(".env.") & ~base.isin(N.ENV_EXAMPLES)) | ends(base, N.SENSITIVE_SUFFIXES)
    return plain | lower("path").rlike(N.SENSITIVE_PATHS)


def is_noise() -> Column:
    return lower("name").isin(N.NOISE)


def is_compiled() -> Column:
    return extension().isin(N.COMPILED_EXT)


def is_omitted() -> Column:
    """Sensitive, noise, compiled, or a binary without extension at the root (by name: none)."""
    bare = (extension() == "") & (F.col("dir") == "") & ~lower("name").isin(N.CONTROL_NAMES)
    return is_sensitive() | is_noise() | is_compiled() | (bare & F.coalesce(kind_by_name() == "binary", F.lit(False)))


def is_shallow_doc() -> Column:
    return ~lower("path").contains("/") | lower("path").rlike("^docs?/[^/]*$")


def doc_priority() -> Column:
    """92, 85 or 90 for shallow Markdown outside archives, else 0."""
    path, base = lower("path"), lower("name")
    fits = base.rlike("[.]md$") & ~path.contains("archive/") & ~path.endswith("archive") & is_shallow_doc()
    by_name = F.when(base.rlike("^(spec|architecture|design|ui-spec)"), 92).when(base.rlike("log|journal|^plan"), 85).otherwise(90)
    return F.when(fits, by_name).otherwise(0)


def is_static_web() -> Column:
    return lower("path").rlike("(^|/)(" + "|".join(N.STATIC_DIRS) + ")(/|$)")


def priority(kind_column: str = "kind") -> Column:
    """How early a file is shown in a map; the first rule that fits counts."""
    base, path = lower("name"), lower("path")
    return (
        F.when(base.isin(N.GUIDANCE), 100)
        .when(base.isin(N.MANIFESTS), 98)
        .when(base.isin(N.CONFIGS), 95)
        .when(doc_priority() > 0, doc_priority())
        .when((base == "index.html") & ~path.contains("/"), 82)
        .when(base.isin(N.ROOT_WEB), 80)
        .when(is_static_web(), 80)
        .when(extension().isin(N.SCRIPT_EXT), 70)
        .when(F.col(kind_column) == "asset", 35)
        .when(F.col(kind_column) == "binary", 30)
        .otherwise(60)
    )


def is_ops_dir() -> Column:
    """The file's directory is a top-level operations directory or .github/workflows."""
    directory = lower("dir")
    return directory.isin(N.OPS_DIRS) | (directory == ".github/workflows")


def is_root_ops() -> Column:
    base = lower("name")
    return base.isin(N.ENV_EXAMPLES) | base.isin(N.ROOT_OPS) | ends(base, N.ROOT_OPS_SUFFIXES)


def is_ops_context() -> Column:
    base = lower("name")
    named = base.isin(N.ENV_EXAMPLES) | base.isin(N.OPS_NAMES)
    return named | F.when(base.endswith(".md"), holds(base, N.OPS_DOC_WORDS)).otherwise(ends(base, N.OPS_SUFFIXES))


def ops_rank() -> Column:
    base = lower("name")
    return (
        F.when(base == "readme.md", 0)
        .when(base.isin(N.ENV_EXAMPLES), 1)
        .when(base.isin(N.ROOT_OPS) | base.isin(N.OPS_NAMES), 2)
        .when(base.endswith(".md") & holds(base, N.OPS_RUNBOOK_WORDS), 3)
        .when(holds(base, N.OPS_VERBS), 4)
        .when(is_ops_context(), 5)
        .otherwise(100)
    )


def is_ops_omitted() -> Column:
    base = lower("name")
    by_name = base.contains(".generated.") | base.contains(".gen.") | base.isin(N.OPS_REAL_ENV)
    return by_name | F.when(base.isin(N.ENV_EXAMPLES), is_noise() | is_compiled()).otherwise(is_omitted())


def under(dirs: list[str]) -> Column:
    """Some ancestor directory, in lower case, is in ``dirs``."""
    return F.arrays_overlap(F.split(lower("dir"), "/"), F.array(*[F.lit(d) for d in dirs]))


def review_priority() -> Column:
    """1 for recognised project files, 0 for auxiliary ones, null for those left out of reviews."""
    base, ext = lower("name"), extension()
    root = F.col("dir") == ""
    return (
        F.when(is_sensitive() | under(N.IGNORED_DIRS) | is_noise(), None)
        .when(base.isin(N.GUIDANCE + N.MANIFESTS + N.CONFIGS), 1)
        .when(doc_priority() > 0, 1)
        .when((base == "index.html") & root | root & base.isin(N.ROOT_WEB) | is_static_web(), 1)
        .when(base.isin(N.ROOT_WEB), 0)
        .when(ext.isin(N.CONFIG_EXT) | base.isin(N.CONTROL_NAMES) | ext.isin(N.RESOURCE_EXT), 1)
        .when(is_root_ops() | is_ops_context(), 1)
        .when(ext.isin(N.ASSET_EXT + N.BINARY_EXT), 0)
        .when(ext.isin(N.SCRIPT_EXT) | under(N.CATEGORY_DIRS) | ext.isin(N.SOURCE_EXT), 1)
        .otherwise(0)
    )


def kind_rank(column: str = "kind") -> Column:
    return F.when(F.col(column) == "asset", 1).when(F.col(column) == "binary", 2).otherwise(0)


def aux_rank(column: str = "kind") -> Column:
    return F.when(F.col(column) == "binary", 0).when(F.col(column) == "asset", 1).otherwise(2)


def generic_rank() -> Column:
    return F.when(lower("name").isin(N.CONTROL_NAMES) | extension().isin(N.CONFIG_EXT), 0).otherwise(1)


def python_rank() -> Column:
    base = lower("name")
    return F.when(base == "conftest.py", 0).when(base.rlike("^test_.*[.]py$") | base.endswith("_test.py"), 1).when(base == "__init__.py", 3).otherwise(2)


def language() -> Column:
    pairs = [F.lit(x) for pair in N.LANGUAGES.items() for x in pair]
    return F.create_map(*pairs)[extension()]


def size_label(column: str = "size") -> Column:
    return F.when(F.col(column) < 1024, F.concat(F.col(column).cast("string"), F.lit("B"))).otherwise(F.concat(F.expr(f"{column} div 1024").cast("string"), F.lit("KB")))
