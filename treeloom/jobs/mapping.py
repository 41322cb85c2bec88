"""Queries that map a corpus: classification, rollups, winners, top files, lines and the budgeted map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.operators import topology as T
from treeloom.operators.ranking import top_k
from treeloom.sources.corpus import DIR_SQL, NAME_SQL, files


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(values: list[str], test: str) -> str:
    return "(" + " OR ".join(test.format(v) for v in values) + ")"


# The same classifiers in DuckDB's SQL.
_BASE, _PATH, _EXT = "lower(name)", "lower(path)", "regexp_extract(lower(name), '([.][^.]*)$', 1)"
_KIND_BY_NAME = f"CASE WHEN {_EXT} IN {_list(N.SOURCE_EXT)} THEN 'source' WHEN {_EXT} IN {_list(N.ASSET_EXT)} THEN 'asset' WHEN {_EXT} IN {_list(N.BINARY_EXT)} THEN 'binary' WHEN {_BASE} IN {_list(N.SOURCE_NAMES)} THEN 'source' END"
_KIND = f"coalesce({_KIND_BY_NAME}, 'source')"
_SENSITIVE = f"({_BASE} IN {_list(N.SENSITIVE_NAMES)} OR (starts_with({_BASE}, '.env.') AND {_BASE} NOT IN {_list(N.ENV_EXAMPLES)}) OR {_any(N.SENSITIVE_SUFFIXES, f"ends_with({_BASE}, '{{}}')")} OR regexp_matches({_PATH}, '{N.SENSITIVE_PATHS}'))"
_NOISE, _COMPILED = f"({_BASE} IN {_list(N.NOISE)})", f"({_EXT} IN {_list(N.COMPILED_EXT)})"
_OMITTED = f"({_SENSITIVE} OR {_NOISE} OR {_COMPILED})"
_SHALLOW = f"(NOT contains({_PATH}, '/') OR regexp_matches({_PATH}, '^docs?/[^/]*$'))"
_DOC = f"CASE WHEN ends_with({_BASE}, '.md') AND NOT contains({_PATH}, 'archive/') AND NOT ends_with({_PATH}, 'archive') AND {_SHALLOW} THEN CASE WHEN regexp_matches({_BASE}, '^(spec|architecture|design|ui-spec)') THEN 92 WHEN regexp_matches({_BASE}, 'log|journal|^plan') THEN 85 ELSE 90 END ELSE 0 END"
_STATIC = f"regexp_matches({_PATH}, '(^|/)(public|static|assets)(/|$)')"
_PRIORITY = f"""CASE WHEN {_BASE} IN {_list(N.GUIDANCE)} THEN 100 WHEN {_BASE} IN {_list(N.MANIFESTS)} THEN 98 WHEN {_BASE} IN {_list(N.CONFIGS)} THEN 95 WHEN ({_DOC}) > 0 THEN {_DOC}
  WHEN {_BASE} = 'index.html' AND dir = '' THEN 82 WHEN {_BASE} IN {_list(N.ROOT_WEB)} OR {_STATIC} THEN 80 WHEN {_EXT} IN {_list(N.SCRIPT_EXT)} THEN 70 WHEN kind = 'asset' THEN 35 WHEN kind = 'binary' THEN 30 ELSE 60 END"""
_ROOT_OPS = f"({_BASE} IN {_list(N.ENV_EXAMPLES + N.ROOT_OPS)} OR {_any(N.ROOT_OPS_SUFFIXES, f"ends_with({_BASE}, '{{}}')")})"
_OPS_CONTEXT = f"({_BASE} IN {_list(N.ENV_EXAMPLES + N.OPS_NAMES)} OR CASE WHEN ends_with({_BASE}, '.md') THEN {_any(N.OPS_DOC_WORDS, f"contains({_BASE}, '{{}}')")} ELSE {_any(N.OPS_SUFFIXES, f"ends_with({_BASE}, '{{}}')")} END)"
_OPS_RANK = f"""CASE WHEN {_BASE} = 'readme.md' THEN 0 WHEN {_BASE} IN {_list(N.ENV_EXAMPLES)} THEN 1 WHEN {_BASE} IN {_list(N.ROOT_OPS + N.OPS_NAMES)} THEN 2
  WHEN ends_with({_BASE}, '.md') AND {_any(N.OPS_RUNBOOK_WORDS, f"contains({_BASE}, '{{}}')")} THEN 3 WHEN {_any(N.OPS_VERBS, f"contains({_BASE}, '{{}}')")} THEN 4 WHEN {_OPS_CONTEXT} THEN 5 ELSE 100 END"""
_OPS_DIR = f"(lower(dir) IN {_list(N.OPS_DIRS)} OR lower(dir) = '.github/workflows')"
_OPS_OMITTED = f"(contains({_BASE}, '.generated.') OR contains({_BASE}, '.gen.') OR {_BASE} IN {_list(N.OPS_REAL_ENV)} OR CASE WHEN {_BASE} IN {_list(N.ENV_EXAMPLES)} THEN {_NOISE} OR {_COMPILED} ELSE {_OMITTED} END)"
_UNDER = lambda dirs: f"list_has_any(string_split(lower(dir), '/'), [{_list(dirs)[1:-1]}])"
_LANGUAGE = "CASE " + _EXT + " " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in N.LANGUAGES.items()) + " END"

FILES = f"""files AS (SELECT doc_id, dir, name, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS path, regexp_extract(name, '([.][^.]*)$', 1) AS ext, coalesce(strlen(text), 0)::BIGINT AS size, text
  FROM (SELECT doc_id, text, {DIR_SQL} AS dir, {NAME_SQL} AS name FROM documents))"""
_CANDIDATES = f"""{FILES}, kinds AS (SELECT *, {_KIND} AS kind FROM files),
rows AS (SELECT doc_id, dir, name, path, size, kind, ({_PRIORITY})::BIGINT AS priority, coalesce({_LANGUAGE}, 'Generic') AS language, string_split(dir, '/')[1] AS module, kind = 'source' AS in_top FROM kinds WHERE NOT {_OMITTED})"""
_DEPTH = "CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END"
_UNIQUE = f"{_CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority DESC, in_top DESC, size DESC, {_DEPTH} DESC, doc_id) AS r FROM rows) WHERE r = 1)"
_LIMIT = f"CASE WHEN dir = '' THEN 10 WHEN string_split(dir, '/')[1] IN ('public', 'static', 'assets') THEN 10 WHEN dir IN ('docs', 'doc') OR {_OPS_DIR} OR has_md THEN 5 ELSE 3 END"
_TOP = f"""limits AS (SELECT dir, {_LIMIT} AS top_limit FROM (SELECT dir, bool_or(ends_with({_BASE}, '.md')) AS has_md FROM {{0}} GROUP BY dir)),
tops AS (SELECT dir, r::BIGINT AS rank, path, name, size, kind, priority FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY priority DESC, size DESC, path, doc_id) AS r FROM {{0}} WHERE in_top) x JOIN limits USING (dir) WHERE r <= top_limit),
auxs AS (SELECT dir, r::BIGINT AS rank, path, name, size, kind FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY CASE kind WHEN 'binary' THEN 0 WHEN 'asset' THEN 1 ELSE 2 END, size DESC, path, doc_id) AS r FROM {{0}} WHERE NOT in_top) WHERE r <= 3)"""
_LABEL = "CASE WHEN dir = '' THEN path ELSE name END || ' (' || CASE WHEN size < 1024 THEN size || 'B' ELSE (size // 1024) || 'KB' END || CASE WHEN kind = 'source' THEN '' ELSE ', ' || kind END || ')'"
_LINES = f"""{_UNIQUE.replace("best AS (SELECT *", "best AS (SELECT * EXCLUDE (r)", 1)}, {_TOP.format("best")},
lines AS (SELECT dir, 'Pkg: ' || CASE WHEN dir = '' THEN '.' ELSE dir END || ' [' || n || ' files] -> ' || concat_ws('; ', 'Top: ' || top, 'Aux: ' || aux) AS line
  FROM (SELECT dir, count(*) AS n FROM best GROUP BY dir) LEFT JOIN (SELECT dir, string_agg({_LABEL}, ', ' ORDER BY rank) AS top FROM tops GROUP BY dir) USING (dir)
  LEFT JOIN (SELECT dir, string_agg({_LABEL}, ', ' ORDER BY rank) AS aux FROM auxs GROUP BY dir) USING (dir) WHERE top IS NOT NULL OR aux IS NOT NULL)"""

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function (files frame) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = lambda spark, sf_dir: job(files(spark, sf_dir))
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


@query(f"WITH {FILES} SELECT doc_id, dir, name, path, ext, size, ({_DEPTH})::BIGINT AS depth FROM files")
def file_catalog(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "dir", "name", "path", "ext", "size", T.depth().alias("depth"))


@query(f"WITH {FILES} SELECT doc_id, path, coalesce({_KIND_BY_NAME}, CASE WHEN contains(substr(coalesce(text, ''), 1, 4096), chr(0)) THEN 'binary' ELSE 'source' END) AS kind FROM files")
def classify_kind(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "path", C.kind("text").alias("kind"))


@query(f"WITH {FILES} SELECT doc_id, path, {_SENSITIVE} AS sensitive, {_NOISE} AS noise, {_COMPILED} AS compiled, {_OMITTED} AS omitted FROM files")
def sensitive_filter(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "path", C.is_sensitive().alias("sensitive"), C.is_noise().alias("noise"), C.is_compiled().alias("compiled"), C.is_omitted().alias("omitted"))


@query(f"WITH {FILES}, kinds AS (SELECT *, {_KIND} AS kind FROM files) SELECT doc_id, path, ({_PRIORITY})::BIGINT AS priority, ({_DOC})::BIGINT AS doc_priority FROM kinds")
def priority_rank(f: DataFrame) -> DataFrame:
    return f.withColumn("kind", C.kind()).select("doc_id", "path", C.priority().cast("long").alias("priority"), C.doc_priority().cast("long").alias("doc_priority"))


@query(f"WITH {FILES} SELECT doc_id, path, {_OPS_DIR} AS ops_dir, {_ROOT_OPS} AS root_ops, {_OPS_CONTEXT} AS ops_context, ({_OPS_RANK})::BIGINT AS ops_rank, {_OPS_OMITTED} AS ops_omitted FROM files")
def ops_rank(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "path", C.is_ops_dir().alias("ops_dir"), C.is_root_ops().alias("root_ops"), C.is_ops_context().alias("ops_context"), C.ops_rank().cast("long").alias("ops_rank"), C.is_ops_omitted().alias("ops_omitted"))


@query(f"""WITH {FILES} SELECT doc_id, path, (CASE WHEN {_SENSITIVE} OR {_UNDER(N.IGNORED_DIRS)} OR {_NOISE} THEN NULL WHEN {_BASE} IN {_list(N.GUIDANCE + N.MANIFESTS + N.CONFIGS)} OR ({_DOC}) > 0 THEN 1
  WHEN dir = '' AND ({_BASE} = 'index.html' OR {_BASE} IN {_list(N.ROOT_WEB)}) OR {_STATIC} THEN 1 WHEN {_BASE} IN {_list(N.ROOT_WEB)} THEN 0 WHEN {_EXT} IN {_list(N.CONFIG_EXT + N.RESOURCE_EXT)} OR {_BASE} IN {_list(N.CONTROL_NAMES)} THEN 1
  WHEN {_ROOT_OPS} OR {_OPS_CONTEXT} THEN 1 WHEN {_EXT} IN {_list(N.ASSET_EXT + N.BINARY_EXT)} THEN 0 WHEN {_EXT} IN {_list(N.SCRIPT_EXT)} OR {_UNDER(N.CATEGORY_DIRS)} OR {_EXT} IN {_list(N.SOURCE_EXT)} THEN 1 ELSE 0 END)::BIGINT AS priority FROM files""")
def review_priority(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "path", C.review_priority().cast("long").alias("priority"))


@query(f"WITH {FILES} SELECT doc_id, path, ({_DEPTH})::BIGINT AS depth FROM files WHERE {_BASE} IN {_list(N.MANIFESTS)} AND {_DEPTH} < {N.MARKER_DEPTH} AND NOT {_UNDER(N.MARKER_IGNORED_DIRS)}")
def marker_discovery(f: DataFrame) -> DataFrame:
    return f.where(C.lower("name").isin(N.MANIFESTS) & (T.depth() < N.MARKER_DEPTH) & ~C.under(N.MARKER_IGNORED_DIRS)).select("doc_id", "path", T.depth().alias("depth"))


@query(f"WITH {_CANDIDATES} SELECT dir, count(*)::BIGINT AS file_count, sum(size)::BIGINT AS total_bytes, arg_max(path, struct_pack(a := priority, b := size, c := doc_id)) AS lead_file, arg_max(path, struct_pack(a := size, b := doc_id)) AS heaviest FROM rows GROUP BY dir")
def package_rollup(f: DataFrame) -> DataFrame:
    return T.packages(T.candidates(f))


@query(f"""WITH {_CANDIDATES}, p AS (SELECT module, language, dir, count(*) AS n, sum(size) AS b FROM rows GROUP BY ALL)
SELECT module, language, count(*)::BIGINT AS packages, sum(n)::BIGINT AS file_count, sum(b)::BIGINT AS total_bytes, string_agg(dir, ',' ORDER BY dir) AS roots FROM p GROUP BY module, language""")
def module_rollup(f: DataFrame) -> DataFrame:
    packages = T.candidates(f).groupBy("module", "language", "dir").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return packages.groupBy("module", "language").agg(F.count("*").alias("packages"), F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes"), F.array_join(F.array_sort(F.collect_list("dir")), ",").alias("roots"))


@query(f"WITH {_UNIQUE} SELECT path, doc_id, priority, size, kind FROM best")
def dedupe_winner(f: DataFrame) -> DataFrame:
    return T.dedupe(T.candidates(f)).select("path", "doc_id", "priority", "size", "kind")


@query(f"""WITH {_UNIQUE}, a AS (SELECT dir, count(*) AS n, sum(size) AS b FROM rows GROUP BY dir), l AS (SELECT dir, count(*) AS n, sum(size) AS b FROM rows WHERE doc_id NOT IN (SELECT doc_id FROM best) GROUP BY dir)
SELECT dir, (a.n - coalesce(l.n, 0))::BIGINT AS file_count, (a.b - coalesce(l.b, 0))::BIGINT AS total_bytes FROM a LEFT JOIN l USING (dir) WHERE a.n > coalesce(l.n, 0)""")
def ownership_correction(f: DataFrame) -> DataFrame:
    return T.corrected(T.candidates(f))


@query(f"WITH {_CANDIDATES}, {_TOP.format('rows')} SELECT dir, rank, path, size, kind, priority FROM tops")
def top_files(f: DataFrame) -> DataFrame:
    return T.top_files(T.candidates(f)).select("dir", "rank", "path", "size", "kind", "priority")


@query(f"WITH {_CANDIDATES}, {_TOP.format('rows')} SELECT dir, rank, path, size, kind FROM auxs")
def aux_files(f: DataFrame) -> DataFrame:
    return T.aux_files(T.candidates(f)).select("dir", "rank", "path", "size", "kind")


_PYTHON_RANK = f"CASE WHEN {_BASE} = 'conftest.py' THEN 0 WHEN regexp_matches({_BASE}, '^test_.*[.]py$') OR ends_with({_BASE}, '_test.py') THEN 1 WHEN {_BASE} = '__init__.py' THEN 3 ELSE 2 END"
_GENERIC_RANK = f"CASE WHEN {_BASE} IN {_list(N.CONTROL_NAMES)} OR {_EXT} IN {_list(N.CONFIG_EXT)} THEN 0 ELSE 1 END"
_KIND_RANK = "CASE kind WHEN 'asset' THEN 1 WHEN 'binary' THEN 2 ELSE 0 END"


@query(f"""WITH {_CANDIDATES}, r AS (
  SELECT 'generic' AS ranking, dir, path, row_number() OVER (PARTITION BY dir ORDER BY {_GENERIC_RANK}, {_KIND_RANK}, size DESC, path, doc_id) AS rank, 10 AS k FROM rows
  UNION ALL SELECT 'python', dir, path, row_number() OVER (PARTITION BY dir ORDER BY {_PYTHON_RANK}, size DESC, path, doc_id), 3 FROM rows WHERE {_EXT} = '.py'
  UNION ALL SELECT 'ops', dir, path, row_number() OVER (PARTITION BY dir ORDER BY {_OPS_RANK}, {_KIND_RANK}, size DESC, path, doc_id), 5 FROM rows WHERE {_OPS_CONTEXT})
SELECT ranking, dir, path, rank::BIGINT AS rank FROM r WHERE rank <= k""")
def generic_python_ops_topk(f: DataFrame) -> DataFrame:
    rows, tail = T.candidates(f), [F.desc("size"), F.asc("path"), F.asc("doc_id")]
    generic = top_k(rows, ["dir"], [C.generic_rank().asc(), C.kind_rank().asc(), *tail], N.GENERIC_TOP).withColumn("ranking", F.lit("generic"))
    python = top_k(rows.where(C.extension() == ".py"), ["dir"], [C.python_rank().asc(), *tail], N.PACKAGE_TOP).withColumn("ranking", F.lit("python"))
    ops = top_k(rows.where(C.is_ops_context()), ["dir"], [C.ops_rank().asc(), C.kind_rank().asc(), *tail], N.OPS_TOP).withColumn("ranking", F.lit("ops"))
    return generic.unionByName(python).unionByName(ops).select("ranking", "dir", "path", "rank")


@query(f"WITH {_CANDIDATES}, c AS (SELECT language, count(DISTINCT path) AS files FROM rows WHERE in_top AND language <> 'Generic' GROUP BY language) SELECT language, files::BIGINT AS files, row_number() OVER (ORDER BY files DESC, language) = 1 AS dominant FROM c")
def language_weights(f: DataFrame) -> DataFrame:
    return T.language_weights(T.candidates(f))


@query(f"WITH {FILES} SELECT dir, count(*)::BIGINT AS file_count, sum(size)::BIGINT AS total_bytes FROM files WHERE {_EXT} = '.md' AND dir IN ('', 'docs', 'doc') GROUP BY dir")
def docs_scan(f: DataFrame) -> DataFrame:
    return f.where((C.extension() == ".md") & F.col("dir").isin("", "docs", "doc")).groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))


@query(f"WITH {FILES} SELECT dir, count(*)::BIGINT AS file_count, sum(size)::BIGINT AS total_bytes FROM files WHERE ({_STATIC} OR dir = '' AND ({_BASE} IN {_list(N.ROOT_WEB)} OR {_BASE} = 'index.html')) AND NOT {_OMITTED} GROUP BY dir")
def web_scan(f: DataFrame) -> DataFrame:
    web = C.is_static_web() | ((F.col("dir") == "") & (C.lower("name").isin(N.ROOT_WEB) | (C.lower("name") == "index.html")))
    return f.where(web & ~C.is_omitted()).groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))


@query(f"WITH {FILES} SELECT dir, ({_OPS_RANK})::BIGINT AS ops_rank, count(*)::BIGINT AS file_count FROM files WHERE ({_OPS_DIR} AND {_OPS_CONTEXT} OR dir = '' AND {_ROOT_OPS}) AND NOT {_OPS_OMITTED} GROUP BY ALL")
def ops_scan(f: DataFrame) -> DataFrame:
    wanted = (C.is_ops_dir() & C.is_ops_context()) | ((F.col("dir") == "") & C.is_root_ops())
    return f.where(wanted & ~C.is_ops_omitted()).groupBy("dir", C.ops_rank().cast("long").alias("ops_rank")).agg(F.count("*").alias("file_count"))


_RESOURCE = f"({_EXT} IN {_list(N.RESOURCE_EXT)} OR string_split(lower(dir), '/')[1] IN {_list(N.EXAMPLE_DIRS)} AND ({_BASE} IN {_list(N.ENV_EXAMPLES)} OR {_EXT} IN ('.yaml', '.yml', '.json', '.toml', '.properties', '.xml'))) AND NOT {_OPS_DIR} AND dir NOT IN ('docs', 'doc') AND NOT {_STATIC} AND NOT {_OMITTED}"


def _resources(f: DataFrame) -> DataFrame:
    example = F.split(C.lower("dir"), "/")[0].isin(N.EXAMPLE_DIRS) & (C.lower("name").isin(N.ENV_EXAMPLES) | C.extension().isin(".yaml", ".yml", ".json", ".toml", ".properties", ".xml"))
    return f.where((C.extension().isin(N.RESOURCE_EXT) | example) & ~C.is_ops_dir() & ~F.col("dir").isin("docs", "doc") & ~C.is_static_web() & ~C.is_omitted())


@query(f"WITH {FILES} SELECT dir, count(*)::BIGINT AS file_count, sum(size)::BIGINT AS total_bytes FROM files WHERE {_RESOURCE} GROUP BY dir")
def resource_scan(f: DataFrame) -> DataFrame:
    return _resources(f).groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))


@query(f"""WITH {_CANDIDATES}, {_TOP.format("rows")}, res AS (SELECT * FROM files WHERE {_RESOURCE}), fresh AS (SELECT * FROM res WHERE path NOT IN (SELECT path FROM tops)),
owner AS (SELECT module FROM rows GROUP BY module ORDER BY module <> '', module LIMIT 1), u AS (SELECT dir, size FROM fresh UNION ALL SELECT dir, size FROM rows WHERE dir IN ('docs', 'doc'))
SELECT owner.module AS owner, dir, count(*)::BIGINT AS file_count, sum(size)::BIGINT AS total_bytes FROM u, owner GROUP BY ALL""")
def attach_resources(f: DataFrame) -> DataFrame:
    rows = T.candidates(f)
    fresh = _resources(f).join(T.top_files(rows).select("path").distinct(), "path", "left_anti")
    owner = rows.agg(F.min(F.struct((F.col("module") != "").alias("named"), F.col("module"))).alias("o")).select(F.col("o.module").alias("owner"))
    both = fresh.select("dir", "size").unionByName(rows.where(F.col("dir").isin("docs", "doc")).select("dir", "size"))
    merged = both.groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))
    return merged.join(F.broadcast(owner), how="cross").select("owner", "dir", "file_count", "total_bytes")  # one owner


@query(f"WITH {_LINES} SELECT dir, line FROM lines")
def package_lines(f: DataFrame) -> DataFrame:
    return T.package_lines(T.candidates(f))


def _budget(limit: int) -> str:
    return f"{_LINES}, kept AS (SELECT * FROM (SELECT dir, line, sum(strlen(line) + 1) OVER (ORDER BY dir ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY dir) AS ord FROM lines) WHERE used <= {limit} AND ord <= {N.MAX_PACKAGES})"


def _kept_lines(f: DataFrame, limit: int) -> DataFrame:
    """(dir, line, used, ord, kept) of the first lines, one more than can stay: whether any was left out shows there."""
    first = T.package_lines(T.candidates(f)).orderBy("dir").limit(N.MAX_PACKAGES + 1)
    whole = Window.orderBy("dir")  # MAX_PACKAGES + 1 rows at most
    used = F.sum(F.octet_length("line") + 1).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = first.withColumns({"used": used, "ord": F.row_number().over(whole).cast("long")})
    return ranked.withColumn("kept", (F.col("used") <= limit) & (F.col("ord") <= N.MAX_PACKAGES))


def _budget_sql(limit: int) -> str:
    return f"WITH {_budget(limit)} SELECT dir, line, used::BIGINT AS used, ord::BIGINT AS ord FROM kept"


@query(_budget_sql(N.MAP_BYTES))
def topology_budget(f: DataFrame, limit: int = N.MAP_BYTES) -> DataFrame:
    return _kept_lines(f, limit).where("kept").select("dir", "line", "used", "ord")


def _text_sql(limit: int) -> str:
    return f"WITH {_budget(limit)} SELECT '[SOURCE TREE]' || chr(10) || string_agg(line, chr(10) ORDER BY ord) || CASE WHEN (SELECT count(*) FROM lines) > count(*) THEN chr(10) || '... [shortened to fit] ...' ELSE '' END AS map FROM kept"


@query(_text_sql(N.MAP_BYTES))
def topology_text(f: DataFrame, limit: int = N.MAP_BYTES) -> DataFrame:
    shown = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("ord", "line"))))  # MAX_PACKAGES lines at most
    found = _kept_lines(f, limit).agg(shown.alias("shown"), F.count("*").alias("n"))
    more = F.when(F.col("n") > F.size("shown"), "\n... [shortened to fit] ...").otherwise("")
    return found.select(F.concat(F.lit("[SOURCE TREE]\n"), F.array_join(F.transform("shown", lambda x: x["line"]), "\n"), more).alias("map"))


def _dir_sql(limit: int) -> str:
    return f"WITH {FILES} SELECT dir, path, doc_id, r::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name, doc_id) AS r FROM files) WHERE r <= {limit}"


@query(_dir_sql(N.DIR_FILES))
def dir_scan_cap(f: DataFrame, limit: int = N.DIR_FILES) -> DataFrame:
    return top_k(f, ["dir"], [F.asc("name"), F.asc("doc_id")], limit, "nth").select("dir", "path", "doc_id", "nth")
