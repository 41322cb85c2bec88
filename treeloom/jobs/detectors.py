"""Queries of Java and Node projects, and of the capped walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.jobs.context import _list
from treeloom.jobs.tagging import _CLEAN, _USABLE
from treeloom.operators import nodes as O
from treeloom.operators import roots as R
from treeloom.sources.corpus import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


# Documents as files of Java projects: modules in one another, roots of all kinds that overlap, tests, resources, secrets.
_JAVA_PATH = (
    "concat(CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'api/' WHEN 2 THEN concat('mods/', lang, '/') ELSE 'api/src/main/java/inner/' END, CASE CAST((doc_id * 7 + length(source)) % 12 AS INT) WHEN 0 THEN 'pom.xml' WHEN 1 THEN concat('src/main/java/com/', source, '/A', CAST(doc_id AS VARCHAR(20)), '.java') "
    "WHEN 2 THEN concat('src/test/java/com/T', CAST(doc_id AS VARCHAR(20)), '.java') WHEN 3 THEN concat('src/main/resources/r', CAST(doc_id % 9 AS VARCHAR(9)), '.YAML') WHEN 4 THEN concat('src/java/J', CAST(doc_id % 9 AS VARCHAR(9)), '.java') WHEN 5 THEN concat('src/S', CAST(doc_id % 9 AS VARCHAR(9)), '.java') WHEN 6 THEN 'build.gradle' "
    "WHEN 7 THEN 'src/main/java/.env.properties' WHEN 8 THEN 'target/src/G.java' WHEN 9 THEN concat('src/main/M', CAST(doc_id % 9 AS VARCHAR(9)), '.sql') WHEN 10 THEN 'src/main/java/id_rsa' ELSE concat('docs/', lang, '.md') END)"
)
_PROJECT = "concat('j', CAST(doc_id % 23 AS VARCHAR(9)))"


def _known(spark: SparkSession, sf_dir: str, project: str, path: str, where: str = "true") -> DataFrame:
    """(project, path, size), a row for each file."""
    rows = table(spark, sf_dir, "documents").where(where).select(F.expr(project).alias("project"), F.expr(path).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return rows.where("path is not null and project is not null").groupBy("project", "path").agg(F.max("size").alias("size"))


def _java(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = _known(spark, sf_dir, _PROJECT, _JAVA_PATH)
    parts = F.split("path", "/")
    marked = known.where(F.element_at(parts, -1).isin("pom.xml", "build.gradle", "build.gradle.kts") & ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(N.IGNORED_DIRS)))
    modules = marked.select("project", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct()
    safe = known.withColumn("name", F.element_at(parts, -1)).where(~C.is_sensitive()).drop("name")
    return R.java_roots(safe, modules)


_JAVA = f"""k AS (SELECT project, path, max(size) AS size FROM (SELECT {_PROJECT} AS project, {_JAVA_PATH} AS path, coalesce(strlen(text), 0) AS size FROM documents) WHERE path IS NOT NULL GROUP BY ALL), kn AS (SELECT *, string_split(path, '/')[-1] AS name FROM k),
mods AS (SELECT DISTINCT project, regexp_replace(path, '/?[^/]*$', '') AS dir FROM kn WHERE name IN ('pom.xml', 'build.gradle', 'build.gradle.kts') AND NOT list_has_any(string_split(path, '/')[:-2], {list(N.IGNORED_DIRS)})),
t AS (SELECT unnest({N.JAVA_ROOTS}) AS rel, unnest(range(1, {len(N.JAVA_ROOTS) + 1})) AS rank), c AS (SELECT project, dir, rel, rank, CASE WHEN dir = '' THEN rel ELSE dir || '/' || rel END AS root FROM mods, t),
f AS (SELECT c.*, kn.path, kn.size FROM c JOIN kn ON kn.project = c.project AND starts_with(kn.path, c.root || '/') WHERE (ends_with(kn.path, '.java') OR lower(regexp_extract(kn.name, '([.][^./]*)$', 1)) IN {_list(N.JAVA_RESOURCES)}) AND NOT ({M._SENSITIVE.replace("name", "kn.name").replace("(path", "(kn.path")})),
h AS (SELECT project, dir, list(DISTINCT rank) AS has FROM f GROUP BY ALL),
s(project, dir, rank, taken) AS (SELECT project, dir, 0, []::VARCHAR[] FROM h UNION ALL SELECT s.project, s.dir, s.rank + 1, CASE WHEN list_contains(h.has, t.rank) AND len(list_filter(s.taken, lambda x: x = t.rel OR starts_with(x, t.rel || '/') OR starts_with(t.rel, x || '/'))) = 0 THEN list_append(s.taken, t.rel) ELSE s.taken END FROM s JOIN h USING (project, dir) JOIN t ON t.rank = s.rank + 1),
p AS (SELECT f.project, f.dir, f.rel, f.root, regexp_replace(path, '/[^/]*$', '') AS package, count(*) AS n_files, sum(size) AS size FROM f JOIN s ON s.project = f.project AND s.dir = f.dir AND s.rank = {len(N.JAVA_ROOTS)} AND list_contains(s.taken, f.rel) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_JAVA} SELECT project, dir, root, CASE WHEN contains(rel, 'test') THEN 'Test Source' ELSE 'Main Source' END AS role, sum(n_files)::BIGINT AS n_files, count(*)::BIGINT AS n_packages FROM p GROUP BY ALL")
def java_source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source roots of Java modules, none within another, with the files and packages in them."""
    return _java(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_JAVA} SELECT project, dir, root, package, CASE WHEN package = root THEN 'default' ELSE replace(substr(package, length(root) + 2), '/', '.') END AS name, n_files::BIGINT AS n_files, size::BIGINT AS size FROM p")
def java_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of Java modules by their chosen source roots."""
    return _java(spark, sf_dir)[1]


#: A wide directory of directories, deep ones, ignored ones, and files beside them.
_WALK = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('wide/d', CAST(doc_id AS VARCHAR(20)), '/x/f.go') WHEN 1 THEN concat('wide/d', CAST(doc_id - 1 AS VARCHAR(20)), '/g.go') WHEN 2 THEN concat('wide/e', CAST(doc_id AS VARCHAR(20)), '.go') WHEN 3 THEN concat('deep/', source, '/', lang, '/build/h', CAST(doc_id AS VARCHAR(20))) ELSE concat('deep/', lang, '/k', CAST(doc_id AS VARCHAR(20))) END"


@query(f"""WITH RECURSIVE k AS (SELECT DISTINCT {_WALK} AS path FROM documents WHERE {_WALK} IS NOT NULL), e0 AS (SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS above, p[i] AS entry, i < len(p) AS is_dir FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM k)),
e AS (SELECT above, entry, bool_or(is_dir) AS is_dir, row_number() OVER (PARTITION BY above ORDER BY entry) AS nth FROM e0 GROUP BY above, entry),
w(path, is_dir, parts) AS (SELECT '', true, []::VARCHAR[] UNION ALL SELECT CASE WHEN w.path = '' THEN entry ELSE w.path || '/' || entry END, e.is_dir, list_append(w.parts, entry) FROM w JOIN e ON e.above = w.path WHERE w.is_dir AND nth <= {N.DIR_FILES} AND NOT (e.is_dir AND entry IN {_list(N.IGNORED_DIRS)}))
SELECT path, nth FROM (SELECT path, row_number() OVER (ORDER BY parts) AS nth FROM w WHERE path IN (SELECT path FROM k)) WHERE nth <= {N.SCAN_FILES}""")
def capped_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a walk with caps on a directory's entries and on all files gets to."""
    return R.capped_walk(table(spark, sf_dir, "documents").select(F.expr(_WALK).alias("path")).where("path is not null"))


# Documents as files of Node projects, forty for each; one in five isn't there.
_NODE_PATHS = (
    "package.json tsconfig.json server.js index.html src/App.tsx src/main.ts components/Nav.tsx hooks/useX.ts pages/index.tsx next.config.js vite.config.ts bin/cli.js lib/index.js types/index.d.ts packages/a/package.json packages/a/src/index.ts packages/b/package.json packages/b/main.js "
    "packages/node_modules/package.json apps/api/package.json apps/api/src/main.ts apps/api/nest-cli.json libs/core/util.ts tools/gen/package.json scripts/build.mjs pom.xml svc/build.gradle go.mod deploy/package.json deploy/x.js src/components/Box.vue src/hooks/a.ts app/page.tsx .env jsconfig.json main.ts "
    "docs/readme.md packages/c/readme.md apps/web/package.json apps/web/index.html"
).split()
_MANIFESTS = [
    '{"name": "full", "main": "./lib/index.js", "bin": "bin/cli.js", "workspaces": ["packages/*", "tools/gen"], "scripts": {"build": "node scripts/build.mjs --x=1", "dev": "vite"}, "dependencies": {"react": "18", "next": "14"}, "devDependencies": {"typescript": "5", "vite": "5"}}',
    '{"name": "nest", "bin": {"a": "./bin/cli.js", "b": 7}, "workspaces": {"packages": ["packages/*", "apps/*", " ", 3]}, "dependencies": {"@nestjs/core": "10"}}',
    '{"types": "types/index.d.ts", "module": "lib/index.js"}', "{}", '{"name": ', '{"name": 5}', '{"scripts": {"start": "tsx server.js", "x": 3}}', '{"workspaces": ["*", "../x", "/abs", "packages/**", "packages/a", "./apps//api/", "packages/*/x"]}', "[]",
    '{"dependencies": {"vue": "3", "vite": "5", "react": "18"}, "scripts": null}', '{"name": "", "main": "../out.js", "bin": null, "scripts": {"s": "\\"./scripts/build.mjs\\" && node ./server.js", "t": "cross-env A=1 jest tests/ bin/cli.js"}}', "null", '{"workspaces": {"packages": "x"}, "bin": ["y"]}',
]
_NODE_PROJECT = "concat('n', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS VARCHAR(20)))"
_NODE_PATH = "CASE CAST(doc_id % 40 AS INT) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_NODE_PATHS)) + " END"
_NODE_TEXT = "CASE CAST((floor(doc_id / 40) + doc_id % 40 * 3) % 13 AS INT) " + " ".join(f"WHEN {i} THEN '{{}}'" for i in range(len(_MANIFESTS))) + " END"
_NODE_THERE = "(doc_id * 7 + floor(doc_id / 40)) % 5 <> 0 AND doc_id IS NOT NULL"
_quoted = lambda slash: [m.replace("\\", slash) for m in _MANIFESTS]


def _node(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(project, path, size) of all files, and (project, dir, manifest...) of the manifests."""
    known = _known(spark, sf_dir, _NODE_PROJECT, _NODE_PATH, _NODE_THERE)
    texts = table(spark, sf_dir, "documents").where(_NODE_THERE).where(f"{_NODE_PATH} like '%package.json'")
    marked = texts.select(F.expr(_NODE_PROJECT).alias("project"), F.regexp_replace(F.expr(_NODE_PATH), "/?[^/]*$", "").alias("dir"), F.expr(_NODE_TEXT.format(*_quoted("\\\\"))).alias("manifest"))
    return known, O.with_manifest(marked.groupBy("project", "dir").agg(F.max("manifest").alias("manifest")), "manifest")


def _modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known, marked = _node(spark, sf_dir)
    roots = O.workspace_roots(marked.where("ok and eligible").withColumn("patterns", F.col("workspaces")), known)
    return known, marked, O.node_modules(marked, roots)


_KEYS = "list_transform(json_keys(j, '$.{0}'), lambda q: json_type(j, '$.{0}.\"' || q || '\"'))"
_MAP_OK = "(coalesce(json_type(j, '$.{0}'), 'NULL') = 'NULL' OR json_type(j, '$.{0}') = 'OBJECT' AND len(list_filter(" + _KEYS + ", lambda q: q NOT IN ('VARCHAR', 'NULL'))) = 0)"
_STR_OK = "coalesce(json_type(j, '$.{0}'), 'NULL') IN ('VARCHAR', 'NULL')"
_STRINGS_OF = "list_filter(list_transform(range(0, coalesce(json_array_length(j, '$.{0}')::BIGINT, 0)), lambda q: CASE WHEN json_type(j, '$.{0}[' || q || ']') = 'VARCHAR' THEN j->>('$.{0}[' || q || ']') END), lambda q: q IS NOT NULL)"
_NODE = f"""k AS (SELECT project, path, max(size) AS size FROM (SELECT {_NODE_PROJECT} AS project, {_NODE_PATH} AS path, coalesce(strlen(text), 0) AS size FROM documents WHERE {_NODE_THERE}) GROUP BY ALL),
t AS (SELECT project, dir, max(manifest) AS manifest FROM (SELECT {_NODE_PROJECT} AS project, regexp_replace({_NODE_PATH}, '/?[^/]*$', '') AS dir, {_NODE_TEXT.format(*_quoted(chr(92)))} AS manifest FROM documents WHERE {_NODE_THERE} AND {_NODE_PATH} LIKE '%package.json') GROUP BY ALL),
v AS (SELECT *, CASE WHEN json_valid(manifest) THEN json(manifest) END AS j FROM t),
o AS (SELECT *, coalesce(json_type(j) IN ('OBJECT', 'NULL') AND {" AND ".join(_STR_OK.format(x) for x in O._STRINGS)} AND {" AND ".join(_MAP_OK.format(x) for x in O._MAPS)}, false) AS ok FROM v),
m0 AS (SELECT project, dir, ok, {", ".join(f"CASE WHEN ok THEN coalesce(j->>'$.{x}', '') ELSE '' END AS {x}" for x in O._STRINGS)},
  CASE WHEN NOT ok THEN [] WHEN json_type(j, '$.bin') = 'VARCHAR' THEN [j->>'$.bin'] WHEN json_type(j, '$.bin') = 'OBJECT' THEN list_sort(list_filter(list_transform(json_keys(j, '$.bin'), lambda q: CASE WHEN json_type(j, '$.bin.' || q) = 'VARCHAR' THEN j->>('$.bin.' || q) END), lambda q: q IS NOT NULL)) ELSE [] END AS bins,
  CASE WHEN NOT ok THEN [] ELSE list_filter(list_transform(CASE WHEN json_type(j, '$.workspaces') = 'ARRAY' THEN {_STRINGS_OF.format("workspaces")} WHEN json_type(j, '$.workspaces.packages') = 'ARRAY' THEN {_STRINGS_OF.format("workspaces.packages")} ELSE [] END, lambda q: trim(q)), lambda q: q <> '') END AS workspaces,
  CASE WHEN ok AND json_type(j, '$.scripts') = 'OBJECT' THEN list_sort(list_filter(list_transform(json_keys(j, '$.scripts'), lambda q: j->>('$.scripts.' || q)), lambda q: q IS NOT NULL)) ELSE [] END AS scripts,
  CASE WHEN ok THEN list_sort(list_distinct(coalesce(json_keys(j, '$.dependencies'), []) || coalesce(json_keys(j, '$.devDependencies'), []))) ELSE [] END AS dependencies, coalesce(json_type(j, '$.bin'), 'NULL') <> 'NULL' AS has_bin FROM o),
m AS (SELECT *, ok AND (types <> '' OR list_contains(dependencies, 'typescript')) AS typescript, ok AND (name <> '' OR main <> '' OR module <> '' OR types <> '' OR has_bin OR len(scripts) > 0 OR len(workspaces) > 0 OR len(dependencies) > 0) AS eligible FROM m0),
pk AS (SELECT project, regexp_replace(path, '/[^/]*$', '') AS root FROM k WHERE path LIKE '%/package.json'),
wp AS (SELECT project, dir, pattern, {_USABLE.format("pattern")} AS rel FROM (SELECT *, {_CLEAN.format("pattern")} AS c FROM (SELECT project, dir, unnest(workspaces) AS pattern FROM m WHERE eligible))),
ws AS (SELECT DISTINCT wp.project, dir, pattern, root FROM wp JOIN pk ON pk.project = wp.project AND (NOT contains(rel, '*') AND root = CASE WHEN dir = '' THEN rel ELSE dir || '/' || rel END
  OR length(rel) - length(replace(rel, '*', '')) = 1 AND ends_with(rel, '/*') AND regexp_replace(root, '/?[^/]*$', '') = CASE WHEN dir = '' THEN '' ELSE dir || '/' END || rel[1:-3] AND string_split(root, '/')[-1] NOT IN {_list(N.IGNORED_DIRS)}) WHERE rel IS NOT NULL),
nm AS (SELECT * FROM m WHERE ok AND (eligible AND len(list_filter(string_split(dir, '/'), lambda x: x <> '')) <= {N.MARKER_DEPTH} AND NOT list_has_any(string_split(dir, '/'), {N.MARKER_IGNORED_DIRS}) AND string_split(dir, '/')[1] NOT IN {_list(N.OPS_DIRS)} OR EXISTS (SELECT 1 FROM ws WHERE ws.project = m.project AND ws.root = m.dir)))"""


@query(f"WITH {_NODE} SELECT project, dir, ok, name, main, module, types, array_to_string(bins, ' ') AS bins, array_to_string(workspaces, ' ') AS workspaces, array_to_string(scripts, chr(10)) AS scripts, array_to_string(dependencies, ' ') AS dependencies, typescript, eligible FROM m")
def node_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What package manifests of all shapes say, malformed and mistyped ones among them."""
    marked = _node(spark, sf_dir)[1]
    texts = [F.array_join(c, "\n" if c == "scripts" else " ").alias(c) for c in ("bins", "workspaces", "scripts", "dependencies")]
    return marked.select("project", "dir", "ok", "name", "main", "module", "types", *texts, "typescript", "eligible")


@query(f"WITH {_NODE} SELECT project, dir, pattern, root FROM ws")
def node_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that workspace patterns name."""
    known, marked = _node(spark, sf_dir)
    return O.workspace_roots(marked.where("ok and eligible").withColumn("patterns", F.col("workspaces")), known)


_EXISTS = "(EXISTS (SELECT 1 FROM k WHERE k.project = {0}.project AND (k.path = CASE WHEN {0}.dir = '' THEN {1} ELSE {0}.dir || '/' || {1} END OR starts_with(k.path, CASE WHEN {0}.dir = '' THEN {1} ELSE {0}.dir || '/' || {1} END || '/'))))"


def _proof_sql(framework: tuple, overview: bool) -> str:
    _, needs, shown, more, *_ = framework
    paths = [*shown, *(more if overview else [])]
    return f"(list_has_any(dependencies, {needs}) AND (" + " OR ".join(_EXISTS.format("x", f"'{p}'") for p in paths) + "))"


@query(f"""WITH {_NODE}, seen AS (SELECT project, string_split(path, '/')[-1] AS name FROM k WHERE NOT list_has_any(string_split(path, '/')[:-2], {N.IGNORED_DIRS}) AND (NOT contains(path, '/') OR string_split(path, '/')[1] NOT IN {_list(N.OPS_DIRS)})),
found AS ({" UNION ".join(f"SELECT project, {i} AS i, '{label}' AS label FROM seen WHERE name IN {_list(names)}" for i, (label, names) in enumerate(N.BUILD_MARKERS))} UNION
{" UNION ".join(f"SELECT project, {10 + i}, '{f[0]}' FROM m x WHERE NOT list_has_any(string_split(dir, '/'), {N.IGNORED_DIRS}) AND string_split(dir, '/')[1] NOT IN {_list(N.OPS_DIRS)} AND {_proof_sql(f, False)}" for i, f in enumerate(N.FRAMEWORKS))})
SELECT p.project, coalesce((SELECT string_agg(label, ', ' ORDER BY i) FROM found WHERE found.project = p.project), '') AS stack FROM (SELECT DISTINCT project FROM seen) p""")
def project_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build systems and frameworks of each project."""
    known, marked = _node(spark, sf_dir)
    return O.stacks(O.with_found(marked, known), known)


def _overview_sql() -> str:
    below = "CASE WHEN x.dir = '' THEN {0} ELSE x.dir || '/' || {0} END"
    parts = [f"SELECT x.project, x.dir, {below.format('r')} AS path FROM nm x, (SELECT unnest({N.NODE_ROOT_FILES}) AS r)"]
    for f in N.FRAMEWORKS:
        proof = _proof_sql(f, True)
        parts.append(f"SELECT x.project, x.dir, {below.format('r')} FROM nm x, (SELECT unnest({f[4]}) AS r) WHERE {proof}")
        for d in f[5]:
            start = below.format(f"'{d}/'")
            parts.append(f"""SELECT x.project, x.dir, (SELECT arg_min(k.path, string_split(k.path, '/')) FROM k WHERE k.project = x.project AND starts_with(k.path, {start}) AND NOT list_has_any(string_split(substr(k.path, length({start}) + 1), '/')[:-2], {N.IGNORED_DIRS})
  AND lower(regexp_extract(k.path, '([.][^./]*)$', 1)) IN {_list([*N.NODE_EXT, ".vue"])}) FROM nm x WHERE {proof}""")
    named = f"""SELECT project, dir, CASE WHEN dir = '' THEN rel ELSE dir || '/' || rel END FROM (SELECT project, dir, {_USABLE.format("s")} AS rel FROM (SELECT *, {_CLEAN.format("s")} AS c FROM (SELECT project, dir, trim(regexp_replace(trim(w), '^["'']+|["'']+$', '', 'g')) AS s FROM words)))"""
    base = "lower(string_split(path, '/')[-1])"
    ranks = [f"WHEN {base} IN {_list(n)} THEN {i}" for i, n in enumerate(N.OVERVIEW_NAMES)]
    ranks += [f"WHEN NOT contains(path, '/') AND {base} IN {_list(n)} THEN {3 + i}" for i, n in enumerate(N.OVERVIEW_ROOT_NAMES)]
    ranks += ["WHEN " + " OR ".join(f"starts_with(path, '{s}')" for s in n) + f" THEN {8 + i}" for i, n in enumerate(N.OVERVIEW_STARTS)]
    return rf"""WITH {_NODE}, tokens AS (SELECT project, dir, regexp_replace(unnest(regexp_split_to_array(trim(s), '\s+')), '^["'']+|["'']+$', '', 'g') AS w FROM (SELECT project, dir, unnest(scripts) AS s FROM nm)),
words AS (SELECT project, dir, unnest([main, module, types] || bins) AS w FROM nm UNION ALL SELECT project, dir, w FROM tokens WHERE w <> '' AND NOT starts_with(w, '-') AND NOT contains(w, '=') AND w NOT IN {_list(N.NODE_COMMANDS)} AND (contains(w, '/') OR contains(w, '\') OR lower(regexp_extract(w, '([.][^./]*)$', 1)) IN {_list(N.NODE_EXT)})),
cand AS ({" UNION ".join(parts)} UNION {named}), ex AS (SELECT DISTINCT cand.project, cand.dir, cand.path, k.size, string_split(cand.path, '/')[-1] AS name FROM cand JOIN k ON k.project = cand.project AND k.path = cand.path),
rk AS (SELECT project, dir, path, size, CASE {" ".join(ranks)} WHEN ends_with({base}, '.d.ts') THEN 14 WHEN starts_with(path, 'src/') THEN 15 ELSE 16 END AS overview_rank FROM ex WHERE NOT ({M._SENSITIVE}) AND lower(name) NOT IN {_list(N.NOISE)} AND regexp_extract(lower(name), '([.][^.]*)$', 1) NOT IN {_list(N.COMPILED_EXT)})
SELECT project, dir, nth, path, size::BIGINT AS size, overview_rank::BIGINT AS overview_rank FROM (SELECT *, row_number() OVER (PARTITION BY project, dir ORDER BY overview_rank, size DESC, path) AS nth FROM rk) WHERE nth <= {N.ROOT_TOP}"""


@query(_overview_sql())
def node_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files that tell most of each Node module."""
    known, _, modules = _modules(spark, sf_dir)
    return O.overviews(O.with_found(modules, known), known)


_PNPM = "concat('# ', lang, chr(10), CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('catalog:', chr(10), '  - no', chr(10)) ELSE '' END, CASE CAST(doc_id % 4 AS INT) WHEN 3 THEN 'package:' ELSE 'packages:' END, chr(10), '  - ''', source, '/*''', chr(10), '  # - x', chr(10), chr(10), '  -  \"apps/', lang, '\"', chr(10), 'odd line', chr(10), '  -', chr(10), CASE CAST(doc_id % 2 AS INT) WHEN 0 THEN concat('overrides:', chr(10)) ELSE '' END, '  - last:', chr(10), '  - end')"


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split({_PNPM}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS l FROM documents),
w(doc_id, i, state, found) AS (SELECT doc_id, 0, 0, []::VARCHAR[] FROM l UNION ALL SELECT w.doc_id, w.i + 1, CASE WHEN state = 0 AND l[w.i + 1] = 'packages:' THEN 1 WHEN state = 1 AND ends_with(l[w.i + 1], ':') AND NOT starts_with(l[w.i + 1], '-') THEN 2 ELSE state END,
  CASE WHEN state = 1 AND starts_with(l[w.i + 1], '-') AND regexp_replace(trim(substr(l[w.i + 1], 2)), '^["'']+|["'']+$', '', 'g') <> '' THEN list_append(found, regexp_replace(trim(substr(l[w.i + 1], 2)), '^["'']+|["'']+$', '', 'g')) ELSE found END FROM w JOIN l USING (doc_id) WHERE w.i < len(l))
SELECT doc_id, array_to_string(arg_max(found, i), ' ') AS patterns FROM w GROUP BY doc_id""")
def pnpm_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of workspace files: list items of one key, with comments, other keys and odd lines around them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PNPM).alias("text")).select("doc_id", F.array_join(O.pnpm_patterns("text"), " ").alias("patterns"))
