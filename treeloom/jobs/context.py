"""Queries of modules in several languages, resolution in order, verdicts, previews and budgets of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.jobs import review as V
from treeloom.jobs import selection as L
from treeloom.jobs import spans as P
from treeloom.operators import modules as O
from treeloom.operators import review as R
from treeloom.operators import selectors as S
from treeloom.operators.ranking import top_k
from treeloom.operators.spans import trim
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


# Documents as files of projects with modules in four languages, some nested, some under ignored directories.
_PROJECT_PATH = (
    "concat('p', CAST(doc_id % 37 AS VARCHAR(9)), '/', CASE CAST(doc_id % 13 AS INT) WHEN 0 THEN 'go.mod' WHEN 1 THEN 'main.go' WHEN 2 THEN concat('internal/', lang, '/f', CAST(doc_id AS VARCHAR(20)), '.go') WHEN 3 THEN 'svc/pom.xml' "
    "WHEN 4 THEN concat('svc/src/main/java/', source, '/F', CAST(doc_id AS VARCHAR(20)), '.java') WHEN 5 THEN 'web/package.json' WHEN 6 THEN concat('web/src/f', CAST(doc_id AS VARCHAR(20)), '.ts') WHEN 7 THEN 'internal/go.mod' "
    "WHEN 8 THEN concat('tools/', lang, '/f', CAST(doc_id AS VARCHAR(20)), '.py') WHEN 9 THEN concat('vendor/f', CAST(doc_id AS VARCHAR(20)), '.go') WHEN 10 THEN concat('web/app/f', CAST(doc_id % 3 AS VARCHAR(9)), '.js') WHEN 11 THEN 'web/app/package.json' ELSE 'README.md' END)"
)


def project_files(spark: SparkSession, sf_dir: str, path: str = _PROJECT_PATH) -> DataFrame:
    """(path, dir, name, ext, size), a row for each path."""
    paths = table(spark, sf_dir, "documents").select(F.expr(path).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    one = paths.where("path is not null").groupBy("path").agg(F.max("size").alias("size"))
    return one.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"([.][^./]*)$", 1).alias("ext"), "size")


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _detector_sql(language: str, markers: list[str], extensions: list[str], depth: int | None) -> str:
    if not markers:
        return f"SELECT '{language}' AS language, string_split(dir, '/')[1] AS root, dir, path, name, size FROM usable WHERE ext IN {_list(extensions)}"
    deep = f"AND len(string_split(m.dir, '/')) <= {depth}" if depth else ""
    return f"""SELECT '{language}' AS language, (SELECT max_by(m.dir, length(m.dir)) FROM (SELECT DISTINCT dir, name FROM usable) m WHERE lower(m.name) IN {_list(markers)} {deep} AND (u.dir = m.dir OR starts_with(u.dir, m.dir || '/'))) AS root, dir, path, name, size FROM usable u WHERE ext IN {_list(extensions)}"""


_OWNED = f"""proj AS (SELECT path, max(size) AS size FROM (SELECT {_PROJECT_PATH} AS path, coalesce(strlen(text), 0) AS size FROM documents) WHERE path IS NOT NULL GROUP BY path),
usable AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, string_split(path, '/')[-1] AS name, regexp_extract(path, '([.][^./]*)$', 1) AS ext, size FROM proj WHERE NOT list_has_any(string_split(path, '/'), {list(N.MARKER_IGNORED_DIRS)})),
owned AS (SELECT * FROM ({" UNION ALL ".join(_detector_sql(*d) for d in N.DETECTORS)}) WHERE root IS NOT NULL),
mods AS (SELECT language, root, count(DISTINCT dir) AS n_packages, count(*) AS n_files, sum(size) AS size, arg_min(path, (-size, path)) AS heaviest FROM owned GROUP BY language, root)"""


@query(f"WITH {_OWNED} SELECT language, root, n_packages::BIGINT AS n_packages, n_files::BIGINT AS n_files, size::BIGINT AS size, heaviest FROM mods")
def detected_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of four languages side by side, rolled up."""
    return O.rollup(O.detect_all(project_files(spark, sf_dir)))


#: The same files, less those of detectors in every third project: there only texts, images and other languages are left.
_SPARSE_PATH = f"CASE WHEN doc_id % 37 % 3 = 0 THEN concat('p', CAST(doc_id % 37 AS VARCHAR(9)), '/', CASE CAST(doc_id % 13 AS INT) WHEN 0 THEN 'x.rs' WHEN 1 THEN concat('lib/f', CAST(doc_id AS VARCHAR(20)), CASE CAST(doc_id % 37 AS INT) WHEN 6 THEN '.rb' ELSE '.rs' END) WHEN 2 THEN 'a.rb' WHEN 3 THEN '.env' WHEN 4 THEN concat('dist/f', CAST(doc_id AS VARCHAR(20)), '.rb') WHEN 5 THEN 'lib/q.jar' ELSE concat('docs/', lang, '.md') END) ELSE {_PROJECT_PATH} END"
_OMITTED_SQL = f"({M._SENSITIVE} OR lower(name) IN {_list(N.NOISE)} OR lower(ext) IN {_list(N.COMPILED_EXT)})"
_LANGUAGE_SQL = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in N.LANGUAGES.items()) + " END"


def _omitted() -> Column:
    return C.is_sensitive() | F.lower("name").isin(N.NOISE) | F.lower("ext").isin(N.COMPILED_EXT)


@query(f"""WITH {_OWNED.replace(_PROJECT_PATH, _SPARSE_PATH)}, lone AS (SELECT *, string_split(dir, '/')[1] AS root FROM usable WHERE NOT {_OMITTED_SQL} AND string_split(dir, '/')[1] NOT IN (SELECT string_split(root, '/')[1] FROM owned)),
said AS (SELECT root, coalesce(arg_min(l, struct_pack(n := -n, l := l)) FILTER (WHERE l IS NOT NULL), 'Generic') AS language FROM (SELECT root, {_LANGUAGE_SQL} AS l, count(*) AS n FROM lone GROUP BY ALL) GROUP BY root),
every AS (SELECT language, root, dir, path, size FROM owned UNION ALL SELECT language, root, dir, path, size FROM lone JOIN said USING (root))
SELECT language, root, count(DISTINCT dir)::BIGINT AS n_packages, count(*)::BIGINT AS n_files, sum(size)::BIGINT AS size, arg_min(path, (-size, path)) AS heaviest FROM every GROUP BY language, root""")
def scanned_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of all detectors; a project in which none finds any is one generic module."""
    known = project_files(spark, sf_dir, _SPARSE_PATH)
    return O.rollup(O.with_fallback(O.detect_all(known), known, _omitted()))


@query(f"""WITH {_OWNED}, k AS (SELECT dir, path, size FROM (SELECT *, row_number() OVER (PARTITION BY language, root, dir ORDER BY size DESC, path) AS r FROM owned) WHERE r <= {N.PACKAGE_TOP}),
t AS (SELECT dir, string_agg(path, ',' ORDER BY size DESC, path) AS tops FROM (SELECT DISTINCT * FROM k) GROUP BY dir)
SELECT o.dir, min(root || '|' || language) AS first, count(*)::BIGINT AS n_files, any_value(tops) AS tops FROM owned o JOIN t USING (dir) GROUP BY o.dir""")
def package_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of all modules in one list by path."""
    return O.packages(O.detect_all(project_files(spark, sf_dir)))


#: Requests for files: those of the projects by path, by name, absolute, upwards, and some that aren't there.
_REQUEST = f"CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN {_PROJECT_PATH} WHEN 1 THEN concat('x/f', CAST(doc_id % 3 AS VARCHAR(9)), '.js') WHEN 2 THEN concat('y/F', CAST(doc_id + 4 - doc_id % 13 AS VARCHAR(20)), '.java') WHEN 3 THEN concat('/abs/f', CAST(doc_id % 3 AS VARCHAR(9)), '.js') WHEN 4 THEN concat('../f', CAST(doc_id % 3 AS VARCHAR(9)), '.js') ELSE concat('none', CAST(doc_id AS VARCHAR(20)), '.go') END"


@query(f"""WITH {_OWNED}, r AS (SELECT doc_id, {_REQUEST} AS request FROM documents),
c AS (SELECT root, language, 0 AS probe, '' AS dir, string_split(heaviest, '/')[-1] AS name, heaviest AS path FROM mods UNION ALL SELECT root, language, 1, dir, name, path FROM owned),
b AS (SELECT name, path FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY root, language, probe, dir, path) = 1)
SELECT doc_id, request, CASE WHEN p.path IS NOT NULL THEN p.path WHEN NOT starts_with(request, '/') AND NOT starts_with(request, '..') THEN b.path END AS resolved, CASE WHEN p.path IS NOT NULL THEN 'exact' WHEN NOT starts_with(request, '/') AND NOT starts_with(request, '..') AND b.path IS NOT NULL THEN 'name' ELSE 'missing' END AS way
FROM r LEFT JOIN proj p ON p.path = request LEFT JOIN b ON b.name = string_split(request, '/')[-1]""")
def resolve_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact path, else the first module's file of that name; absolute and upward requests aren't guessed."""
    known = project_files(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select("doc_id", F.expr(_REQUEST).alias("request")).withColumn("name", F.element_at(F.split("request", "/"), -1))
    hit = asked.join(known.select(F.col("path").alias("request"), F.col("path").alias("exact")), "request", "left").join(O.by_name(O.detect_all(known)), "name", "left")
    guess = F.when(~F.col("request").startswith("/") & ~F.col("request").startswith(".."), F.col("by_name"))
    way = F.when(F.col("exact").isNotNull(), "exact").when(guess.isNotNull(), "name").otherwise("missing")
    return hit.select("doc_id", "request", F.coalesce("exact", guess).alias("resolved"), way.alias("way"))


_EXTERNAL = "concat(lang, '/', CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'README.md' WHEN 1 THEN concat('deep/f', CAST(doc_id % 50 AS VARCHAR(9)), '.go') WHEN 2 THEN concat('f', CAST(doc_id AS VARCHAR(20)), '.py') ELSE CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.env' WHEN 1 THEN 'go.sum' WHEN 2 THEN 'x.jar' WHEN 3 THEN 'target/a.go' ELSE '.gitignore' END END)"
_ASKED = f"CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN {_EXTERNAL} WHEN 1 THEN concat('ext/', source, '/', {_EXTERNAL}) WHEN 2 THEN concat('f', CAST(doc_id AS VARCHAR(20)), '.py') WHEN 3 THEN concat(source, '/', {_EXTERNAL}) ELSE concat('zz/', {_EXTERNAL}) END"


def _external_omitted() -> Column:
    return C.is_sensitive() | F.exists(F.split("path", "/"), lambda part: part.isin(N.IGNORED_DIRS)) | F.lower("name").isin(N.EXTERNAL_NOISE) | C.lower("name").rlike("(" + "|".join(x.replace(".", "[.]") for x in N.COMPILED_EXT) + ")$")


_EXTERNAL_FILES = f"""e0 AS (SELECT DISTINCT 'ext/' || source AS root, {_EXTERNAL} AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), e1 AS (SELECT *, string_split(path, '/')[-1] AS name FROM e0),
ef AS (SELECT root, path AS rel, root || '/' || path AS display FROM e1 WHERE NOT ({M._SENSITIVE}) AND NOT list_has_any(string_split(path, '/'), {list(N.IGNORED_DIRS)}) AND lower(name) NOT IN {_list(N.EXTERNAL_NOISE)} AND regexp_extract(lower(name), '([.][^.]*)$', 1) NOT IN {_list(N.COMPILED_EXT)})"""


@query(f"""WITH {_EXTERNAL_FILES}, r AS (SELECT DISTINCT {_ASKED} AS request FROM documents),
h AS (SELECT request, count(display) AS n, min(display) AS first FROM r LEFT JOIN ef ON request = rel OR request = display OR ends_with(display, '/' || request) GROUP BY request)
SELECT request, n::BIGINT AS n, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN first END AS path FROM h WHERE request IS NOT NULL""")
def resolve_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for files of read-only external roots, by path under the root, display path, or the end of it; several matches are ambiguous."""
    docs = table(spark, sf_dir, "documents")
    found = docs.where("source is not null and lang is not null").select(F.concat(F.lit("ext/"), "source").alias("root"), F.expr(_EXTERNAL).alias("path")).distinct().withColumn("name", F.element_at(F.split("path", "/"), -1))
    keys = O.external_keys(found.where(~_external_omitted()).select("root", F.col("path").alias("rel")))
    asked = docs.select(F.expr(_ASKED).alias("request")).where("request is not null").distinct()
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous")
    return asked.join(keys, "request", "left").select("request", n.alias("n"), status.alias("status"), F.when(n == 1, F.col("first")).alias("path"))


@query(f"""WITH {M.FILES}, {L._PARSED}, s AS (SELECT req_id // 4 AS grp, CASE WHEN {M._SENSITIVE} THEN 'excluded' WHEN path IN (SELECT path FROM files) THEN 'ok' ELSE 'failed' END AS status FROM (SELECT req_id, sel_path AS path, string_split(sel_path, '/')[-1] AS name FROM parsed WHERE code = 'ok')),
c AS (SELECT grp, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'excluded') AS n_excluded FROM s GROUP BY grp)
SELECT grp, n_ok::BIGINT AS n_ok, n_failed::BIGINT AS n_failed, n_excluded::BIGINT AS n_excluded, CASE WHEN n_ok > 0 AND n_failed + n_excluded > 0 THEN 'proceed' WHEN n_ok > 0 THEN 'ok' WHEN n_failed > 0 THEN 'failed' ELSE 'no_safe_files' END AS verdict FROM c""")
def extraction_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a request's selectors: sensitive paths are excluded, others found or not."""
    ok = S.parse(L.selector_lines(spark, sf_dir)).where("code = 'ok'").select(F.expr("req_id div 4").alias("grp"), "sel_path", F.col("sel_path").alias("path"), F.element_at(F.split("sel_path", "/"), -1).alias("name"))
    found = S.resolve_exact(ok, files(spark, sf_dir))
    status = F.when(C.is_sensitive(), "excluded").when(F.col("found"), "ok").otherwise("failed")
    return O.verdict(found.select("grp", status.alias("status")), ["grp"])


@query(f"""WITH {M.FILES}, x AS (SELECT string_split(path, '/')[1] AS root, {"".join(["CASE ext ", *[f"WHEN '{e}' THEN '{n}' " for e, n in N.LANGUAGES.items()], "END"])} AS language FROM files),
g AS (SELECT root, language, count(*) AS n FROM x GROUP BY ALL)
SELECT root, coalesce(arg_min(language, (-n, language)) FILTER (WHERE language IS NOT NULL), 'Generic') AS language, coalesce(string_agg(language, ',' ORDER BY language), '') AS languages, sum(n)::BIGINT AS n_files FROM g GROUP BY root""")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each root by its files' extensions, and all that occur."""
    return O.languages(files(spark, sf_dir).withColumn("root", F.split("path", "/")[0]), ["root"])


def _cut_sql(text: str, most: int) -> str:
    return f"coalesce({', '.join(f'try(decode(encode({text})[1:{most - i}]))' for i in range(4))})"


def first_bytes(text: Column, most: int) -> Column:
    """The longest start of whole code points within ``most`` bytes."""
    data = [F.substring(F.encode(text, "UTF-8"), 1, most - i).cast("string") for i in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(d), d) for d in data]))


@query(f"""WITH l AS (SELECT doc_id, {L._TRIM.format("x")} AS t, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
k AS (SELECT doc_id, i, '  ' || CASE WHEN strlen(t) > {N.GOAL_BYTES} THEN {_cut_sql("t", N.GOAL_BYTES)} || '...' ELSE t END AS line FROM l WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {N.GOAL_LINES})
SELECT d.doc_id, coalesce(any_value(p), '  (blank)') AS preview FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS p FROM k GROUP BY doc_id) USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def goal_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines that aren't blank, trimmed and cut to whole code points."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.slice(F.filter(F.transform(F.split("text", "\n"), trim), lambda x: x != ""), 1, N.GOAL_LINES)
    shown = F.transform(lines, lambda x: F.concat(F.lit("  "), first_bytes(x, N.GOAL_BYTES), F.when(F.octet_length(x) > N.GOAL_BYTES, "...").otherwise("")))
    return docs.select("doc_id", F.when(F.size(shown) == 0, "  (blank)").otherwise(F.array_join(shown, "\n")).alias("preview"))


@query("""WITH t AS (SELECT doc_id, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN encode(text) || '\\x00'::BLOB || encode(text) WHEN 1 THEN encode(text) || '\\xC3'::BLOB WHEN 2 THEN '\\xFF'::BLOB || encode(text) ELSE encode(text) END AS data, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, try(decode(data)) IS NOT NULL AND NOT regexp_matches(hex(data), '^(..)*00') AS is_text FROM t""")
def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file's bytes are text: valid UTF-8 without a zero."""
    extra = lambda code: F.unhex(F.lit(code))
    data, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 5
    bytes_ = F.when(kind == 0, F.concat(data, extra("00"), data)).when(kind == 1, F.concat(data, extra("C3"))).when(kind == 2, F.concat(extra("FF"), data)).otherwise(data)
    text = bytes_.cast("string")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00"))).alias("is_text"))


@query(f"""WITH {M.FILES}, s AS (SELECT dir, path, doc_id, strlen('- ' || path || ': budget') + 1 AS size, count(*) OVER (PARTITION BY dir) * 9 AS over FROM files),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY dir ORDER BY path DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved, sum(size) OVER (PARTITION BY dir) AS whole FROM s)
SELECT dir, path, doc_id, CASE WHEN over > whole + 23 THEN NULL ELSE saved < over END AS suppressed FROM w""")
def status_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of a directory's files that go, from the tail, to save nine bytes a file."""
    rows = files(spark, sf_dir).select("dir", "path", "doc_id", (F.octet_length(F.concat(F.lit("- "), "path", F.lit(": budget"))) + 1).alias("size"))
    over = rows.groupBy("dir").agg((F.count("*") * 9).alias("over"))
    return O.suppressed(rows.join(over, "dir"), ["dir"], ["path", "doc_id"], "over", 23).select("dir", "path", "doc_id", "suppressed")


def interactive_budget(limit: Column, overhead: int) -> Column:
    """Bytes for a review inside a prompt of ``limit`` bytes: less the frame, capped, and less a reserve for the map where that leaves any."""
    most = F.least(F.greatest(limit - overhead, F.lit(1)), F.lit(N.REVIEW_BYTES))
    return F.when(limit <= 0, N.REVIEW_BYTES).when(most > N.TOPOLOGY_RESERVE, most - N.TOPOLOGY_RESERVE).otherwise(most).cast("long")


@query(f"""WITH o AS (SELECT o_orderkey, (o_orderkey % 700 - 20) * 1024 AS most FROM orders), m AS (SELECT *, least(greatest(most - 1200, 1), {N.REVIEW_BYTES}) AS b FROM o)
SELECT o_orderkey, most::BIGINT AS most, (CASE WHEN most <= 0 THEN {N.REVIEW_BYTES} WHEN b > {N.TOPOLOGY_RESERVE} THEN b - {N.TOPOLOGY_RESERVE} ELSE b END)::BIGINT AS budget FROM m""")
def review_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.expr("(o_orderkey % 700 - 20) * 1024")
    return table(spark, sf_dir, "orders").select("o_orderkey", limit.cast("long").alias("most"), interactive_budget(limit, 1200).alias("budget"))


@query(f"""WITH {M.FILES}, c AS (SELECT DISTINCT dir, string_split(substr(path, CASE WHEN p = '' THEN 1 ELSE length(p) + 2 END), '/')[1] AS child, contains(substr(path, CASE WHEN p = '' THEN 1 ELSE length(p) + 2 END), '/') AS is_dir FROM (SELECT path, dir AS own, unnest(list_prepend('', list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/')))) AS p, p AS dir FROM files))
SELECT dir, child, is_dir, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY is_dir, child) AS r FROM c WHERE starts_with(lower(child), 'f') OR starts_with(lower(child), 's')) WHERE r <= 8""")
def directory_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each directory its children that begin with a prefix, in any case: files first, eight at most."""
    parts = F.split("path", "/")
    at = F.sequence(F.lit(1), F.size(parts))
    step = F.transform(at, lambda k: F.struct(F.array_join(F.slice(parts, 1, k - 1), "/").alias("dir"), F.get(parts, k - 1).alias("child"), (k < F.size(parts)).alias("is_dir")))
    rows = files(spark, sf_dir).select(F.explode(step).alias("s")).select("s.*").distinct()
    fits = F.lower("child").startswith("f") | F.lower("child").startswith("s")
    return top_k(rows.where(fits), ["dir"], [F.asc("is_dir"), F.asc("child")], 8).select("dir", "child", "is_dir", "rank")


_PROJECTS = f"""{_OWNED}, pl AS (SELECT string_split(root, '/')[1] AS project, language, count(*) AS n, count(DISTINCT root) AS roots FROM owned GROUP BY ALL),
pj AS (SELECT project, sum(n) AS n_files, sum(roots) AS n_modules, arg_min(language, (-n, language)) AS main, count(*) AS n_languages, string_agg(language, ', ' ORDER BY language) AS languages FROM pl GROUP BY project)"""


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, n_files, n_modules, main, n_languages, languages): the modules of each first directory taken together."""
    owned = O.detect_all(project_files(spark, sf_dir)).withColumn("project", F.split("root", "/")[0])
    by_language = owned.groupBy("project", "language").agg(F.count("*").alias("n"), F.count_distinct("root").alias("roots"))
    return by_language.groupBy("project").agg(
        F.sum("n").alias("n_files"), F.sum("roots").alias("n_modules"), F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("main"), F.count("*").alias("n_languages"),
        F.array_join(F.array_sort(F.collect_list("language")), ", ").alias("languages"),  # at most one for each detector
    )


@query(f"""WITH {_PROJECTS} SELECT project, n_files::BIGINT AS n_files, n_modules::BIGINT AS n_modules,
  '[PROJECT TOPOLOGY]' || chr(10) || 'Languages: ' || languages || chr(10) || CASE WHEN n_languages > 1 THEN 'Primary: ' || main || chr(10) ELSE '' END || 'Structure: ' || CASE WHEN n_modules > 1 THEN 'Multi-Module' ELSE 'Single Module' END || chr(10) AS header FROM pj""")
def topology_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total files, modules and the map's header of each project; the primary language is named where there are several."""
    primary = F.when(F.col("n_languages") > 1, F.concat(F.lit("Primary: "), "main", F.lit("\n"))).otherwise("")
    structure = F.when(F.col("n_modules") > 1, "Multi-Module").otherwise("Single Module")
    header = F.concat(F.lit("[PROJECT TOPOLOGY]\nLanguages: "), "languages", F.lit("\n"), primary, F.lit("Structure: "), structure, F.lit("\n"))
    return _projects(spark, sf_dir).select("project", "n_files", "n_modules", header.alias("header"))


@query(f"""WITH {_OWNED}, p AS (SELECT DISTINCT language, root, dir, CASE WHEN dir = root THEN '' ELSE substr(dir, length(root) + 2) END AS rel FROM owned)
SELECT language, root, dir, CASE WHEN language = 'Java' THEN CASE WHEN rel = '' THEN 'default' ELSE replace(rel, '/', '.') END WHEN rel = '' THEN 'root' ELSE string_split(rel, '/')[-1] END AS name FROM p""")
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packages are called: Java by dots below the module, others by their last directory."""
    packages = O.detect_all(project_files(spark, sf_dir)).select("language", "root", "dir").distinct()
    rel = F.when(F.col("dir") == F.col("root"), "").otherwise(F.expr("substring(dir, length(root) + 2)"))
    java = F.when(rel == "", "default").otherwise(F.replace(rel, F.lit("/"), F.lit(".")))
    other = F.when(rel == "", "root").otherwise(F.element_at(F.split(rel, "/"), -1))
    return packages.select("language", "root", "dir", F.when(F.col("language") == "Java", java).otherwise(other).alias("name"))


@query(f"""WITH {M.FILES}, web AS (SELECT DISTINCT dir FROM files WHERE string_split(dir, '/')[1] IN {_list(N.STATIC_DIRS)} OR dir = ''), known AS (SELECT DISTINCT dir FROM files WHERE doc_id % 4 = 0)
SELECT dir FROM web WHERE dir = '' OR dir NOT IN (SELECT dir FROM known)""")
def web_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of static files that a map doesn't show already (here: those of every fourth file); the root always stays."""
    rows = files(spark, sf_dir)
    web = rows.where(F.split("dir", "/")[0].isin(N.STATIC_DIRS) | (F.col("dir") == "")).select("dir").distinct()
    known = rows.where("doc_id % 4 = 0").select("dir").distinct()
    return web.where("dir <> ''").join(known, "dir", "left_anti").unionByName(web.where("dir = ''"))


_ODD_PATH = "concat(source, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN chr(9) WHEN 1 THEN '\"' WHEN 2 THEN chr(92) WHEN 3 THEN concat(chr(10), chr(13)) WHEN 4 THEN concat(chr(1), chr(31), chr(127)) ELSE ' é/' END, lang)"


def escaped(path: Column) -> Column:
    """A path on one line: backslashes, quotation marks and control characters written out."""
    named = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
    for sign, shown in named.items():
        path = F.replace(path, F.lit(sign), F.lit(shown))
    for code in (c for c in (*range(32), 127) if chr(c) not in named):
        path = F.replace(path, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return path


@query(f"""WITH p AS (SELECT doc_id, {_ODD_PATH} AS path FROM documents), c AS (SELECT doc_id, unnest(string_split(path, '')) AS x, unnest(range(0, length(path))) AS i FROM p)
SELECT doc_id, string_agg(CASE WHEN x = chr(92) THEN chr(92) || chr(92) WHEN x = '"' THEN chr(92) || '"' WHEN ord(x) BETWEEN 7 AND 13 THEN chr(92) || substr('abtnvfr', ord(x) - 6, 1) WHEN ord(x) < 32 OR ord(x) = 127 THEN chr(92) || printf('x%02x', ord(x)) ELSE x END, '' ORDER BY i) AS shown FROM c GROUP BY doc_id""")
def escape_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", escaped(F.expr(_ODD_PATH)).alias("shown"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, 'f' || (o_orderkey % 50) AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'old/' || (o_orderkey % 7) ELSE '' END AS previous FROM orders)
SELECT o_custkey, o_orderkey, path, previous, row_number() OVER (PARTITION BY o_custkey ORDER BY path, previous, o_orderkey)::BIGINT AS nth FROM c""")
def change_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each change in its set: by path, then by the path before."""
    previous = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("old/"), (F.col("o_orderkey") % 7).cast("string"))).otherwise("")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")).alias("path"), previous.alias("previous"))
    order = Window.partitionBy("o_custkey").orderBy("path", "previous", "o_orderkey")
    return rows.withColumn("nth", F.row_number().over(order).cast("long"))


@query(f"WITH {M.FILES} SELECT path, doc_id FROM files WHERE doc_id % 3 = 0 AND NOT {M._SENSITIVE}")
def safe_untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untracked files (here every third) less sensitive ones."""
    return files(spark, sf_dir).where((F.col("doc_id") % 3 == 0) & ~C.is_sensitive()).select("path", "doc_id")


@query(f"SELECT op, count(*)::BIGINT AS n, count(*) FILTER (WHERE error IS NOT NULL)::BIGINT AS n_errors FROM ({V.ORACLE['write_plan']}) GROUP BY op")
def apply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and deletions of all plans, and how many of them can't be done."""
    return V.write_plan(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


def _sections_sql(limit: int) -> str:
    half = limit // 2
    head, tail = (", ".join(f"try(decode(data[{cut.format(i=i)}]))" for i in range(4)) for cut in (f"1:{half} - {{i}}", f"size - {half} + 1 + {{i}}:size"))
    spans = P.ORACLE["span_cascade"]
    with_ = "WITH RECURSIVE" if spans.startswith("WITH RECURSIVE") else "WITH"
    return f"""{with_} s AS ({spans}), d AS (SELECT doc_id, full_file, content, encode(content) AS data, strlen(content) AS size FROM s), h AS (SELECT *, coalesce({head}) AS head, coalesce({tail}) AS tail FROM d),
t AS (SELECT doc_id, full_file, size > {limit} AS cut, CASE WHEN size <= {limit} THEN content ELSE head || chr(10) || '... [cut ' || (size - strlen(head) - strlen(tail)) || ' bytes] ...' || chr(10) || tail END AS content FROM h)
SELECT doc_id, '--- File: doc-' || doc_id || ' (' || CASE WHEN full_file THEN 'Full File' ELSE 'Extracted Span' END || CASE WHEN cut THEN ', Truncated' ELSE '' END || ') ---' || chr(10) || content || chr(10) || CASE WHEN cut THEN '--- End File (TRUNCATED) ---' ELSE '--- End File ---' END || chr(10) AS section FROM t"""


@query(_sections_sql(N.FILE_BYTES))
def context_sections(spark: SparkSession, sf_dir: str, limit: int = N.FILE_BYTES) -> DataFrame:
    """Labelled sections of the extracted spans; of contents beyond ``limit`` bytes both ends stay, cut to whole code points."""
    rows = P.span_cascade(spark, sf_dir).withColumn("cut", F.octet_length("content") > limit)
    label = F.concat(F.when(F.col("full_file"), "Full File").otherwise("Extracted Span"), F.when(F.col("cut"), ", Truncated").otherwise(""))
    end = F.when(F.col("cut"), "\n--- End File (TRUNCATED) ---\n").otherwise("\n--- End File ---\n")
    return rows.select("doc_id", F.concat(F.lit("--- File: doc-"), F.col("doc_id").cast("string"), F.lit(" ("), label, F.lit(") ---\n"), R.trimmed("content", limit), end).alias("section"))
