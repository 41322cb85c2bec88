"""Queries of tagged references: found in texts, resolved in the project and in roots beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.jobs.context import _external_omitted, _list
from treeloom.operators import review as R
from treeloom.operators import tagging as T
from treeloom.sources.corpus import files, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


PROJECT = "/work/app"
#: Roots beside the project, a display path and a place for each source: some with one name, one inside another, one inside the project.
_DISPLAY = "CASE CAST(length(source) + doc_id % 4 AS INT) % 4 WHEN 0 THEN concat('../', source, '/docs') WHEN 1 THEN concat('../', source) WHEN 2 THEN concat('./vendor/', source) ELSE concat('/opt/', source) END"
_PLACE = f"CASE CAST(length(source) + doc_id % 4 AS INT) % 4 WHEN 0 THEN concat('/work/', source, '/docs') WHEN 1 THEN concat('/work/', source) WHEN 2 THEN concat('{PROJECT}/vendor/', source) ELSE concat('/opt/', source) END"
_REL = "concat(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat(lang, '/') ELSE 'docs/' END, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'README.md' WHEN 1 THEN '.env' WHEN 2 THEN 'go.sum' WHEN 3 THEN concat('spec', CAST(doc_id % 90 AS VARCHAR(9)), '.md') WHEN 4 THEN 'target/x.md' ELSE concat('n', CAST(doc_id AS VARCHAR(20)), '.md') END)"
#: A reference for each document: local files and directories, messy and upward spellings, all forms of names of roots, absolute and empty ones.
_REF = (
    "CASE CAST(doc_id % 16 AS INT) WHEN 0 THEN 'README.md' WHEN 1 THEN concat('src/', source, '/', lang) WHEN 2 THEN concat('./src//', source, '/', lang, '/../', lang, '/f', CAST(doc_id - doc_id % 7 AS VARCHAR(20)), '.go') WHEN 3 THEN 'docs/README.md' "
    f"WHEN 4 THEN concat('../', source, '/docs/', {_REL}) WHEN 5 THEN concat(source, '/docs/', {_REL}) WHEN 6 THEN concat('docs/', {_REL}) WHEN 7 THEN {_REL} WHEN 8 THEN concat('../', source, '/', {_REL}) WHEN 9 THEN concat(source, '/', {_REL}) "
    f"WHEN 10 THEN concat('vendor/', source, '/', {_REL}) WHEN 11 THEN concat('../../opt/', source, '/', {_REL}) WHEN 12 THEN concat('/opt/', source, '/', {_REL}) WHEN 13 THEN concat('docs/./', lang, '/../', {_REL}) WHEN 14 THEN concat('../app/vendor/', source, '/', {_REL}) ELSE './' END"
)
#: Whole texts with their reference behind a paragraph and another one in a fence.
_TEXT = f"concat(text, chr(10), 'see @\"', {_REF}, '\" and more', chr(10), '```', chr(10), '@fenced/x.md', chr(10), '```', chr(10), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '@\"open' ELSE '@docs/README.md.' END)"

_SEGMENTS = "list_transform(list_filter(string_split({0}, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s])"
_CLEAN = "array_to_string(list_reduce(list_prepend([]::VARCHAR[], " + _SEGMENTS + "), lambda a, b: CASE WHEN b = ['..'] AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/')"
_USABLE = "CASE WHEN trim({0}) <> '' AND NOT starts_with(trim({0}), '/') AND c <> '' AND c <> '..' AND NOT starts_with(c, '../') THEN c END"


@query(rf"""WITH {M.FILES}, e0 AS (SELECT DISTINCT {_DISPLAY} AS display, {_PLACE} AS root, {_REL} AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), e1 AS (SELECT *, string_split(path, '/')[-1] AS name FROM e0),
ext AS (SELECT display, root, path AS rel, root || '/' || path AS file FROM e1 WHERE NOT ({M._SENSITIVE}) AND NOT list_has_any(string_split(path, '/'), {list(N.IGNORED_DIRS)}) AND lower(name) NOT IN {_list(N.EXTERNAL_NOISE)} AND regexp_extract(lower(name), '([.][^.]*)$', 1) NOT IN {_list(N.COMPILED_EXT)}),
asked AS (SELECT DISTINCT ref FROM (SELECT {_REF} AS ref FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'docs/README.md') WHERE ref IS NOT NULL),
cleaned AS (SELECT ref, c, {_USABLE.format("ref")} AS own FROM (SELECT ref, {_CLEAN.format("ref")} AS c FROM asked)),
split AS (SELECT ref, array_to_string(p[1:k], '/') AS prefix, array_to_string(p[k + 1:], '/') AS rest FROM (SELECT ref, string_split(ref, '/') AS p, unnest(range(1, len(string_split(ref, '/')))) AS k FROM asked)),
rest AS (SELECT ref, prefix, {_USABLE.format("rest")} AS rel FROM (SELECT *, {_CLEAN.format("rest")} AS c FROM split)),
kinds AS (SELECT ref, own, CASE WHEN trim(ref) = '' THEN 'empty' WHEN starts_with(trim(ref), '/') THEN 'absolute' WHEN c = '' THEN 'empty' WHEN own IN (SELECT path FROM files) THEN 'local' WHEN EXISTS (SELECT 1 FROM files WHERE starts_with(path, own || '/')) THEN 'directory' WHEN own IS NULL THEN 'outside' ELSE 'missing' END AS first FROM cleaned),
hits AS (
  SELECT k.ref, file FROM kinds k JOIN ext ON ext.rel = k.own WHERE first IN ('outside', 'missing')
  UNION SELECT k.ref, file FROM kinds k JOIN rest USING (ref) JOIN ext ON ext.rel = rest.rel AND rest.prefix IN (display, regexp_replace(display, '^[./]+', ''), string_split(display, '/')[-1]) WHERE first IN ('outside', 'missing')
  UNION SELECT k.ref, file FROM kinds k JOIN ext ON file = '/' || {_CLEAN.format(f"('{PROJECT}/' || k.ref)")} WHERE first = 'outside'),
n AS (SELECT ref, count(*) AS n, min(file) AS file FROM hits GROUP BY ref),
r AS (SELECT ref, CASE WHEN n = 1 THEN 'external' WHEN n > 1 THEN 'ambiguous' ELSE first END AS status, CASE WHEN first = 'local' THEN own WHEN n = 1 THEN ref END AS path, CASE WHEN n = 1 THEN file END AS source FROM kinds LEFT JOIN n USING (ref)),
own AS (SELECT doc_id, 0::BIGINT AS pos, {_REF} AS ref FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1, 'docs/README.md' FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0)
SELECT doc_id, pos, ref, status, path, r.source FROM own LEFT JOIN r USING (ref)""")
def resolve_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of whole texts, each resolved in the project's files or in roots beside it; spelled in all ways that the roots allow."""
    docs = table(spark, sf_dir, "documents")
    outside = docs.where("source is not null and lang is not null").select(F.expr(_DISPLAY).alias("display"), F.expr(_PLACE).alias("root"), F.expr(_REL).alias("path")).distinct()
    outside = outside.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~_external_omitted()).select("display", "root", F.col("path").alias("rel"))
    texts = docs.where("text is not null").select("doc_id", F.expr(_TEXT).alias("text"))
    refs = R.references(texts).select("doc_id", "pos", "ref")
    found = T.resolve(refs, files(spark, sf_dir).select(F.col("path").alias("rel")), outside, PROJECT)
    return refs.join(found, "ref", "left").select("doc_id", "pos", "ref", "status", "path", "source")


@query("SELECT doc_id, 'missing closing quote' AS error FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0")
def reference_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a quoted reference that isn't closed."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(_TEXT).alias("text"))
    return R.open_references(texts).select("doc_id", F.lit("missing closing quote").alias("error"))
