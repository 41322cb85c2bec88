"""Queries on changes, references, fences, plans, indentation, manifests, headers and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.operators import review as R
from treeloom.operators.ranking import joined, top_k
from treeloom.sources.corpus import files, lines, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus by doc_id: one third only before, one third after, some changed."""
    rows = files(spark, sf_dir).select("doc_id", F.concat(F.col("path"), F.lit("~"), F.col("doc_id").cast("string")).alias("path"), "size")
    before = rows.where("doc_id % 5 <> 1").select("path", "size", F.lit(0).alias("mark"))
    after = rows.where("doc_id % 5 <> 2").select("path", (F.col("size") + F.expr("case when doc_id % 5 = 3 then 7 else 0 end")).alias("size"), F.expr("case when doc_id % 5 = 3 then 1 else 0 end").alias("mark"))
    return before, after


_DIFF = f"""{M.FILES}, named AS (SELECT doc_id, path || '~' || doc_id AS path, size FROM files), o AS (SELECT path, size FROM named WHERE doc_id % 5 <> 1), n AS (SELECT path, size + CASE WHEN doc_id % 5 = 3 THEN 7 ELSE 0 END AS size, doc_id % 5 = 3 AS changed FROM named WHERE doc_id % 5 <> 2),
changes AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.size::BIGINT AS old_size, n.size::BIGINT AS new_size FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR changed)"""


@query(f"WITH {_DIFF} SELECT * FROM changes")
def changeset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_DIFF}, s AS (SELECT DISTINCT path || '~' || doc_id AS path FROM files WHERE doc_id % 4 = 0) SELECT s.path, coalesce(change, 'stale') AS change FROM s LEFT JOIN changes USING (path)")
def selected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = files(spark, sf_dir).where("doc_id % 4 = 0").select(F.concat(F.col("path"), F.lit("~"), F.col("doc_id").cast("string")).alias("path")).distinct()
    return chosen.join(R.diff(*_snapshots(spark, sf_dir)), "path", "left").select("path", F.coalesce("change", F.lit("stale")).alias("change"))


def _review_sql(limit: int) -> str:
    return f"""WITH {M.FILES}, k AS (SELECT *, {M._KIND} AS kind, CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change FROM files),
s AS (SELECT dir, path, doc_id, size, CASE WHEN kind = 'binary' THEN 'binary' WHEN {M._SENSITIVE} THEN 'sensitive' WHEN change IN ('added', 'deleted') THEN change ELSE 'pending' END AS status FROM k),
u AS (SELECT *, sum(CASE WHEN status = 'pending' THEN size ELSE 0 END) OVER (PARTITION BY dir ORDER BY path, doc_id) AS used FROM s),
v AS (SELECT *, bool_or(status = 'pending' AND used > {limit}) OVER (PARTITION BY dir ORDER BY path, doc_id) AS over FROM u)
SELECT dir, path, doc_id, status, used::BIGINT AS used, CASE WHEN status <> 'pending' THEN status WHEN over THEN 'budget' ELSE 'included' END AS verdict FROM v"""


@query(_review_sql(N.REVIEW_BYTES))
def review_budget(spark: SparkSession, sf_dir: str, limit: int = N.REVIEW_BYTES) -> DataFrame:
    change = F.expr("case doc_id % 4 when 0 then 'added' when 1 then 'deleted' else 'modified' end")
    rows = files(spark, sf_dir).withColumn("kind", C.kind()).withColumn("change", change).withColumn("status", R.context_status())
    return R.greedy(rows, ["dir"], ["path", "doc_id"], limit, F.expr("substring(path, 1, length(dir) + 5)")).select("dir", "path", "doc_id", "status", "used", "verdict")


_PATCH = "CASE (doc_id + ln) % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '+++' WHEN 3 THEN '---' ELSE ' ' END"
_DOC_LINES = "lines AS (SELECT doc_id, i - 1 AS ln, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


@query(f"WITH {_DOC_LINES}, p AS (SELECT doc_id, {_PATCH} || ' ' || line AS line FROM lines) SELECT doc_id, count(*) FILTER (WHERE line LIKE '+%' AND line NOT LIKE '+++%')::BIGINT AS added, count(*) FILTER (WHERE line LIKE '-%' AND line NOT LIKE '---%')::BIGINT AS removed FROM p GROUP BY doc_id")
def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = lines(spark, sf_dir).withColumn("line", F.concat(F.expr(_PATCH), F.lit(" "), F.col("line")))
    starts = lambda c: F.count_if(F.col("line").startswith(c) & ~F.col("line").startswith(c * 3))
    return patch.groupBy("doc_id").agg(starts("+").alias("added"), starts("-").alias("removed"))


_NUMSTAT = "CASE WHEN doc_id % 6 = 0 THEN concat('-', chr(9), '-', chr(9), source) ELSE concat(CAST(doc_id % 90 AS varchar(9)), chr(9), CAST(doc_id % 7 AS varchar(9)), chr(9), source) END"


@query(f"WITH n AS (SELECT string_split({_NUMSTAT}, chr(9)) AS f FROM documents) SELECT f[3] AS path, count(*)::BIGINT AS files, count(*) FILTER (WHERE f[1] = '-' AND f[2] = '-')::BIGINT AS binary_files, coalesce(sum(try_cast(f[1] AS BIGINT)), 0)::BIGINT AS added, coalesce(sum(try_cast(f[2] AS BIGINT)), 0)::BIGINT AS removed FROM n GROUP BY f[3]")
def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.split(F.expr(_NUMSTAT), "\t").alias("f"))
    number = lambda i: F.coalesce(F.sum(F.when(F.col("f")[i].rlike("^[0-9]+$"), F.col("f")[i].try_cast("long"))), F.lit(0))
    return rows.groupBy(F.col("f")[2].alias("path")).agg(F.count("*").alias("files"), F.count_if((F.col("f")[0] == "-") & (F.col("f")[1] == "-")).alias("binary_files"), number(0).alias("added"), number(1).alias("removed"))


_REVIEW_SQL = M.ORACLE["review_priority"].removeprefix("WITH ")


@query(f"""WITH p AS (WITH {_REVIEW_SQL}), f AS (SELECT p.doc_id, p.path, p.priority, p.doc_id * 37 % 1000 AS mtime, p.doc_id % 9 AS grp FROM p WHERE priority IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY priority DESC, mtime DESC, path, doc_id) AS nth, count(*) OVER (PARTITION BY grp) AS n FROM f)
SELECT grp, path, doc_id, nth::BIGINT AS nth, greatest(n - {N.UNTRACKED}, 0)::BIGINT AS omitted FROM r WHERE nth <= {N.UNTRACKED}""")
def untracked_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("priority", C.review_priority()).where("priority is not null")
    rows = rows.select("doc_id", "path", "priority", F.expr("doc_id * 37 % 1000").alias("mtime"), F.expr("doc_id % 9").alias("grp"))
    return R.untracked(rows, ["grp"]).select("grp", "path", "doc_id", "nth", "omitted")


def _blocks_sql(lines: str) -> str:
    """blocks(doc_id, a, b) of the fenced lines of ``lines`` (doc_id, i, line), one mark after another."""
    return rf"""fm AS (SELECT doc_id, i, regexp_extract(regexp_replace(line, '\r$', ''), '(?s)^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS run, regexp_extract(regexp_replace(line, '\r$', ''), '(?s)^ {{0,3}}(?:`{{3,}}|~{{3,}})(.*)$', 1) AS rest FROM {lines}),
fk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM fm WHERE run <> ''),
fr(doc_id, k, spot, mark, a, b) AS (SELECT DISTINCT doc_id, 0::BIGINT, NULL::BIGINT, '', NULL::BIGINT, NULL::BIGINT FROM fk UNION ALL
  SELECT r.doc_id, f.k, CASE WHEN shut THEN NULL WHEN opens THEN f.i ELSE r.spot END, CASE WHEN shut THEN '' WHEN opens THEN f.run ELSE r.mark END, CASE WHEN shut THEN r.spot END, CASE WHEN shut THEN f.i END
  FROM fr r JOIN fk f ON f.doc_id = r.doc_id AND f.k = r.k + 1, LATERAL (SELECT r.spot IS NOT NULL AND starts_with(f.run, r.mark) AND regexp_matches(f.rest, '^[ \t]*$') AS shut, r.spot IS NULL AND (starts_with(f.run, '~') OR NOT contains(f.rest, '`')) AS opens)),
blocks AS (SELECT doc_id, a, b FROM fr WHERE a IS NOT NULL UNION ALL SELECT doc_id, arg_max(spot, k), 1000000000 FROM (SELECT doc_id, k, coalesce(spot, -1) AS spot FROM fr) GROUP BY doc_id HAVING arg_max(spot, k) >= 0)"""


#: Texts with references of all forms, in fences of several lengths and signs, some unclosed.
_REF_TEXT = (
    "concat(text, ' see @', source, '/', lang, '.md, and mail@', lang, '.org @', source, ').@é/', lang, '.', chr(10), repeat(CASE CAST(doc_id % 2 AS INT) WHEN 0 THEN '`' ELSE '~' END, CAST(2 + doc_id % 4 AS INT)), CASE CAST(doc_id % 7 AS INT) WHEN 3 THEN 'go `x' WHEN 4 THEN ' md' ELSE '' END, chr(10), "
    "'in @', lang, '.go', chr(10), repeat('`', CAST(2 + doc_id % 3 AS INT)), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN ' no' WHEN 1 THEN chr(13) ELSE '' END, chr(10), 'out @\"a ', source, ' ', chr(92), '\"b', chr(92), chr(92), '.md\"@x/', lang, '. @', chr(10), repeat('~', CAST(3 + doc_id % 3 AS INT)), chr(10), '@\"\" @z', CASE WHEN doc_id % 6 = 0 THEN ' @\"open ' ELSE '' END)"
)


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, {{text}} AS text FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM t), {_blocks_sql("l")},
u AS (SELECT doc_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM blocks WHERE blocks.doc_id = l.doc_id AND i BETWEEN a AND b) THEN '' ELSE line END, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id),
m AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([\pL\p{{{{Nd}}}}_])@', '\1' || chr(3), 'g'), '(?s)@("(?:[^"\\]|\\.)*"|[\pL\p{{{{Nd}}}}/.\-_~+]*[\pL\p{{{{Nd}}}}/\-_~+])', 1) AS found FROM u),
r AS (SELECT doc_id, unnest(range(0, len(found))) AS pos, replace(unnest(found), chr(3), '@') AS x FROM m)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN starts_with(x, '"') THEN regexp_replace(x[2:-2], '\\(["\\])', '\1', 'g') ELSE x END AS ref, starts_with(x, '"') AS quoted FROM r""".replace("{{text}}", "{text}").replace("{{{{Nd}}}}", "{Nd}").replace("{{Nd}}", "{Nd}").replace("{text}", _REF_TEXT))
def tagged_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return R.references(docs.select("doc_id", F.expr(_REF_TEXT).alias("text"))).select("doc_id", "pos", "ref", "quoted")


_FENCED = (
    "CASE CAST((doc_id + {i}) % 17 AS INT) WHEN 1 THEN '```' WHEN 3 THEN '~~~~' WHEN 4 THEN '  ```go' WHEN 6 THEN '````' WHEN 7 THEN '~~~' WHEN 9 THEN '```a`b' WHEN 10 THEN '    ```' WHEN 11 THEN concat('```', chr(13)) "
    "WHEN 12 THEN '~~~~~  ' WHEN 13 THEN '~~~ `x' WHEN 15 THEN '   ````` ' ELSE x END"
)


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {_FENCED.format(i="(i - 1)")}) AS l FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM t), {_blocks_sql("l")}
SELECT doc_id, i::BIGINT AS ln, EXISTS (SELECT 1 FROM blocks WHERE blocks.doc_id = l.doc_id AND i BETWEEN a AND b) AS fenced FROM l""")
def fence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "transform(split(text, '\n'), (x, i) -> " + _FENCED.format(i="i") + ")"
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(made).alias("lines"))
    return R.fence_mask(docs).select("doc_id", "ln", "fenced")


_TICKS = "concat(text, repeat('`', CAST(doc_id % 7 AS int)), source, repeat('`', CAST(doc_id % 5 AS int)))"


@query(f"SELECT doc_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all({_TICKS}, '`+'), lambda x: length(x))), 0) + 1)::BIGINT AS fence FROM documents")
def fence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TICKS).alias("text")).select("doc_id", R.fence_length().alias("fence"))


#: Prefixes that are completed; the last one fits nothing.
_PREFIXES = ["f1", "do", "RE", "s", "pub", "src", ".e", "deploy", "in", "md", "zz"]
_LOCAL_SQL = "SELECT DISTINCT array_to_string(p[1:k], '/') AS path, k - 1 AS depth, k < len(p) AS is_dir FROM (SELECT p, unnest(range(1, least(len(p), 2) + 1)) AS k FROM (SELECT string_split({0}, '/') AS p FROM {1}))"


@query(f"""WITH {M.FILES}, ext AS (SELECT DISTINCT source, lang || '/' || name AS rel FROM (SELECT d.source, d.lang, f.name FROM documents d JOIN files f USING (doc_id)) WHERE source IS NOT NULL AND lang IS NOT NULL),
a AS ({_LOCAL_SQL.format("path", "files")}), e AS (SELECT DISTINCT 'ext/' || source || '/' || x.path AS path, x.depth, x.is_dir FROM (SELECT source, array_to_string(p[1:k], '/') AS path, k - 1 AS depth, k < len(p) AS is_dir FROM (SELECT source, p, unnest(range(1, least(len(p), 2) + 1)) AS k FROM (SELECT source, string_split(rel, '/') AS p FROM ext))) x WHERE x.path NOT IN (SELECT path FROM a)),
c AS (SELECT *, false AS external FROM a UNION ALL SELECT *, true FROM e), w AS (SELECT unnest({_PREFIXES}) AS prefix),
s AS (SELECT prefix, c.*, CASE WHEN depth = 0 AND starts_with(lower(path), lower(prefix)) AND NOT external THEN 0 WHEN depth = 0 AND starts_with(lower(string_split(path, '/')[-1]), lower(prefix)) THEN 0 WHEN depth = 1 AND starts_with(lower(string_split(path, '/')[-1]), lower(prefix)) THEN 1 WHEN starts_with(lower(path), lower(prefix)) THEN 2
  WHEN len(list_filter(list_concat(string_split(lower(path), '/'), regexp_split_to_array(lower(path), '[/.\\-_+]')), lambda x: starts_with(x, lower(prefix)))) > 0 THEN 3 END + CASE WHEN is_dir THEN 4 ELSE 0 END AS score FROM c, w)
SELECT prefix, path, is_dir, external, score::BIGINT AS score, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score, external, is_dir, path) AS r FROM s WHERE score IS NOT NULL) WHERE r <= 8""")
def completion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of some prefixes: by score, local before external, files before directories, path."""
    rows = files(spark, sf_dir)
    local = R.shallow(rows.select("path"))
    outside = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").where("source is not null and lang is not null").join(rows.select("doc_id", "name"), "doc_id").select("source", F.concat_ws("/", "lang", "name").alias("path")).distinct()
    shown = outside.groupBy("path").agg(F.collect_set("source").alias("sources"))
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(2))), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k - 1).alias("depth"), (k < F.size(parts)).alias("is_dir")))
    steps = shown.select("sources", F.explode(steps).alias("s")).select("sources", "s.*").join(local.select("path"), "path", "left_anti")
    external = steps.select(F.explode("sources").alias("source"), "path", "depth", "is_dir").distinct().select(F.concat_ws("/", F.lit("ext"), "source", "path").alias("path"), "depth", "is_dir")
    both = local.withColumn("external", F.lit(False)).unionByName(external.withColumn("external", F.lit(True)))
    wanted = both.select("*", F.explode(F.array(*map(F.lit, _PREFIXES))).alias("prefix"))
    scored = wanted.withColumn("score", R.completion_score(F.col("prefix")).cast("long")).where("score is not null")
    return top_k(scored, ["prefix"], [F.asc("score"), F.asc("external"), F.asc("is_dir"), F.asc("path")], 8).select("prefix", "path", "is_dir", "external", "score", "rank")


#: A response for each document: one file written, one deleted, one bad path, for some a block without an end.
_RESPONSE = "concat('Note', chr(10), '--- File: src/', source, '.md ---', chr(10), text, chr(10), '--- End File ---', chr(10), '--- Delete File: old/', lang, ' ---', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('--- File: ../up ---', chr(10), 'x', chr(10), '--- End File ---') ELSE '--- File: tail.txt ---' END)"


def _plan_sql(response: str) -> str:
    return rf"""WITH d AS (SELECT doc_id, string_split({response}, chr(10)) AS l FROM documents), x AS (SELECT doc_id, i - 1 AS ln, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
m AS (SELECT *, nullif(regexp_extract(line, '^--- File: (.+) ---$', 1), '') AS w, nullif(regexp_extract(line, '^--- Delete File: (.+) ---$', 1), '') AS r FROM x), b AS (SELECT *, count(coalesce(w, r)) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM m),
g AS (SELECT doc_id, block, max(CASE WHEN w IS NOT NULL THEN 'write' WHEN r IS NOT NULL THEN 'delete' END) AS op, max(coalesce(w, r)) AS target, min(ln) FILTER (WHERE line = '--- End File ---') AS e, min(ln) FILTER (WHERE coalesce(w, r) IS NOT NULL) AS s FROM b WHERE block > 0 GROUP BY ALL)
SELECT doc_id, block::BIGINT AS block, op, target, CASE WHEN op = 'write' AND e IS NOT NULL THEN coalesce((SELECT string_agg(line, chr(10) ORDER BY ln) FROM x WHERE x.doc_id = g.doc_id AND x.ln > g.s AND x.ln < g.e), '') WHEN op = 'write' THEN '' END AS content,
  CASE WHEN op = 'write' AND e IS NULL THEN 'unterminated' WHEN regexp_matches(target, '(^|[/\\])[.][.]([/\\]|$)') THEN 'outside' END AS error FROM g"""


def _plans(spark: SparkSession, sf_dir: str, response: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.expr(response), "\n")).alias("ln", "line"))
    return R.write_plan(rows, ["doc_id"]).select("doc_id", "block", "op", "target", "content", "error")


@query(_plan_sql(_RESPONSE))
def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir, _RESPONSE)


_INDENTED = "CASE WHEN (doc_id + ln) % 4 = 0 THEN concat(chr(9), line) WHEN (doc_id + ln) % 4 = 1 THEN concat(repeat(' ', CAST(2 + doc_id % 2 * 2 AS int)), line) WHEN (doc_id + ln) % 4 = 2 THEN concat('    ', line) ELSE line END"


@query(f"""WITH {_DOC_LINES}, t AS (SELECT doc_id, ln, {_INDENTED} AS line FROM lines), d AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS nth FROM t WHERE regexp_matches(line, '^[ \t]')),
v AS (SELECT doc_id, CASE WHEN NOT starts_with(line, chr(9)) THEN length(regexp_extract(line, '^ +')) END AS width, count(*) AS n FROM d WHERE nth <= 200 GROUP BY ALL)
SELECT doc_id, coalesce(sum(n) FILTER (WHERE width IS NULL), 0) >= coalesce(sum(n) FILTER (WHERE width IS NOT NULL), 0) AS tabs, (arg_min(width, struct_pack(a := -n, b := width)) FILTER (WHERE width IS NOT NULL))::BIGINT AS width FROM v GROUP BY doc_id""")
def indent_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.indent_style(lines(spark, sf_dir).withColumn("line", F.expr(_INDENTED)), ["doc_id"])


@query(f"""WITH {_DOC_LINES}, t AS (SELECT doc_id, ln, {_INDENTED} AS line FROM lines), e AS (SELECT doc_id, ln, replace(regexp_extract(line, '^[ \t]*'), chr(9), '    ') AS lead, regexp_replace(line, '^[ \t]*', '') AS body FROM t)
SELECT doc_id, ln::BIGINT AS ln, CASE WHEN trim(body) = '' THEN '' ELSE repeat(chr(9), (length(lead) // 4)::INT) || repeat(' ', (length(lead) % 4)::INT) || body END AS line FROM e""")
def normalise_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("line", F.expr(_INDENTED))
    width = F.length(F.replace(F.regexp_extract("line", r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))
    body = F.regexp_replace("line", r"^[ \t]*", "")
    fixed = F.concat(F.repeat(F.lit("\t"), F.floor(width / 4).cast("int")), F.repeat(F.lit(" "), width % 4), body)
    return rows.select("doc_id", "ln", F.when(F.trim(body) == "", "").otherwise(fixed).alias("line"))


@query(r"SELECT doc_id, (CASE WHEN t = '' THEN 0 ELSE len(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) END)::BIGINT AS n FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\r\n]+\z', '') AS t FROM documents)")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.line_count().alias("n"))


_MANIFEST = """concat('{"name": "', source, '", "dependencies": {', CASE WHEN doc_id % 3 = 0 THEN '"react": "18", ' ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '"typescript": "5", ' ELSE '' END, '"lodash": "4"}', CASE WHEN doc_id % 5 = 0 THEN ', "types": "index.d.ts"' ELSE '' END, '}')"""


@query(f"""WITH m AS (SELECT doc_id, json({_MANIFEST}) AS j FROM documents) SELECT doc_id, j->>'name' AS name, json_exists(j, '$.dependencies.react') AS react, json_exists(j, '$.types') OR json_exists(j, '$.dependencies.typescript') AS typescript, len(json_keys(j, '$.dependencies'))::BIGINT AS n FROM m""")
def manifest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "name string, types string, dependencies map<string, string>"
    read = table(spark, sf_dir, "documents").select("doc_id", F.from_json(F.expr(_MANIFEST), shape).alias("m"))
    deps = F.col("m.dependencies")
    typed = F.col("m.types").isNotNull() | F.map_contains_key(deps, "typescript")
    return read.select("doc_id", F.col("m.name").alias("name"), F.map_contains_key(deps, "react").alias("react"), typed.alias("typescript"), F.size(deps).cast("long").alias("n"))


@query("SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM (SELECT event_id, event_type, json(props) AS props FROM events)")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


def _le(value: str, n: int) -> str:
    """Hex digits of a number's ``n`` bytes, the least first; SQL of both engines."""
    return "concat(" + ", ".join(f"lpad(hex(CAST(floor({value} / {256**k}) AS BIGINT) % 256), 2, '0')" for k in range(n)) + ")"


_W, _H = "(1 + vec_id * 13 % 4000)", "(1 + vec_id * 7 % 3000)"
_BE = lambda value, n: f"lpad(hex(CAST({value} AS BIGINT)), {2 * n}, '0')"
#: First bytes of images of five formats, some broken or of other kinds, as hex digits.
_IMAGE = f"""CASE CAST(vec_id % 9 AS INT) WHEN 0 THEN concat('89504E470D0A1A0A0000000D49484452', {_BE(_W, 4)}, {_BE(_H, 4)}, '08', CASE WHEN vec_id % 2 = 0 THEN '06' ELSE '02' END)
  WHEN 1 THEN concat('474946383961', {_le(_W, 2)}, {_le(_H, 2)}, '0000') WHEN 2 THEN concat('524946460000000057454250565038580A000000', CASE WHEN vec_id % 4 < 2 THEN '10' ELSE '02' END, '000000', {_le(f"({_W} - 1)", 3)}, {_le(f"({_H} - 1)", 3)})
  WHEN 3 THEN concat('000001000100', {_le(f"(vec_id % 3 * 128)", 1)}, {_le(_H, 1)}, '0000010020000000000016000000') WHEN 4 THEN concat('FFD8FFE000104A46494600010100000100010000FFDB000500', '0000', 'FFC', CAST(vec_id % 3 AS VARCHAR(1)), '001108', {_BE(_H, 2)}, {_BE(_W, 2)}, '03')
  WHEN 5 THEN 'FFD8FFE000104A464946000101' WHEN 6 THEN concat('524946460000000057454250565038200A000000', '000000000000000000000000') WHEN 7 THEN '000001000000AABBCCDDEEFF00112233445566778899' ELSE '89504E47' END"""


@query(f"""WITH RECURSIVE d AS (SELECT vec_id, {_IMAGE} AS x FROM embeddings), b AS (SELECT vec_id, x, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) AS v FROM d),
j(vec_id, p, w, h) AS (SELECT vec_id, 3::BIGINT, NULL::BIGINT, NULL::BIGINT FROM b WHERE starts_with(x, 'FFD8') UNION ALL SELECT j.vec_id, p + 2 + v[p + 2] * 256 + v[p + 3], CASE WHEN v[p + 1] BETWEEN 192 AND 194 THEN v[p + 7] * 256 + v[p + 8] END, CASE WHEN v[p + 1] BETWEEN 192 AND 194 THEN v[p + 5] * 256 + v[p + 6] END FROM j JOIN b USING (vec_id) WHERE w IS NULL AND v[p] = 255 AND len(v) >= p + 3),
r AS (SELECT vec_id, CASE WHEN len(v) < 12 THEN NULL WHEN starts_with(x, 'FFD8') THEN 'JPEG' WHEN starts_with(x, '89504E47') AND len(v) >= 26 THEN 'PNG' WHEN starts_with(x, '474946') THEN 'GIF' WHEN starts_with(x, '52494646') AND x[17:32] = '5745425056503858' AND len(v) >= 30 THEN 'WebP' WHEN starts_with(x, '00000100') AND len(v) >= 22 AND v[5] + v[6] > 0 THEN 'ICO' END AS f, v FROM b),
o AS (SELECT r.vec_id, f, v, CASE f WHEN 'JPEG' THEN (SELECT max(w) FROM j WHERE j.vec_id = r.vec_id) WHEN 'PNG' THEN ((v[17] * 256 + v[18]) * 256 + v[19]) * 256 + v[20] WHEN 'GIF' THEN v[7] + 256 * v[8] WHEN 'WebP' THEN v[25] + 256 * v[26] + 65536 * v[27] + 1 WHEN 'ICO' THEN CASE v[7] WHEN 0 THEN 256 ELSE v[7] END END AS w,
  CASE f WHEN 'JPEG' THEN (SELECT max(h) FROM j WHERE j.vec_id = r.vec_id) WHEN 'PNG' THEN ((v[21] * 256 + v[22]) * 256 + v[23]) * 256 + v[24] WHEN 'GIF' THEN v[9] + 256 * v[10] WHEN 'WebP' THEN v[28] + 256 * v[29] + 65536 * v[30] + 1 WHEN 'ICO' THEN CASE v[8] WHEN 0 THEN 256 ELSE v[8] END END AS h FROM r)
SELECT vec_id, CASE WHEN w IS NOT NULL THEN f END AS format, w::BIGINT AS width, h::BIGINT AS height, CASE WHEN w > 0 AND h > 0 THEN (w // gcd(w, h)) || ':' || (h // gcd(w, h)) WHEN w IS NOT NULL THEN '' END AS aspect, CASE WHEN w IS NOT NULL THEN CASE f WHEN 'PNG' THEN v[26] IN (4, 6) WHEN 'WebP' THEN v[21] & 16 > 0 ELSE false END END AS alpha FROM o""")
def image_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, size, aspect and alpha read from header bytes (made from each row's id)."""
    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.expr(_IMAGE)).alias("data"))
    read = raw.select("vec_id", R.image_header().alias("m")).select("vec_id", "m.*")
    return read.withColumn("aspect", R.aspect_ratio("width", "height"))


_SESSION = """concat('{"tokens": {"input": ', CAST(l_quantity * 100 AS bigint), ', "output": ', l_linenumber, ', "reasoning": ', l_partkey, ', "cache": {"read": ', l_suppkey, ', "write": 0}}, "time": {"created": ', l_orderkey, ', "updated": ', l_orderkey + l_partkey, '}, "summary": {"files": ', l_linenumber % 3, '}}')"""


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, json({_SESSION}) AS j FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, (j->>'$.tokens.input')::BIGINT AS i, (j->>'$.tokens.output')::BIGINT AS o, (j->>'$.tokens.reasoning')::BIGINT AS r, (j->>'$.tokens.cache.read')::BIGINT + (j->>'$.tokens.cache.write')::BIGINT AS c, (j->>'$.summary.files')::BIGINT AS f, (j->>'$.time.updated')::BIGINT - (j->>'$.time.created')::BIGINT AS ms FROM s)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, i + o + r AS active, c AS cached, i + o + r + c AS total, CASE WHEN f > 0 THEN (i + o + r) // f END AS per_file, ms FROM n""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>, time struct<created: bigint, updated: bigint>, summary struct<files: bigint>"
    read = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.from_json(F.expr(_SESSION), shape).alias("s"))
    active, cached = F.expr("s.tokens.input + s.tokens.output + s.tokens.reasoning"), F.expr("s.tokens.cache.read + s.tokens.cache.write")
    per_file = F.expr("case when s.summary.files > 0 then (s.tokens.input + s.tokens.output + s.tokens.reasoning) div s.summary.files end")
    return read.select("l_orderkey", "l_linenumber", active.alias("active"), cached.alias("cached"), (active + cached).alias("total"), per_file.alias("per_file"), F.expr("s.time.updated - s.time.created").alias("ms"))


_TAGS = "concat(lang, ', ', source, ' ,, ', lang)"


@query(f"SELECT doc_id, array_to_string(list_distinct_first, ',') AS tags FROM (SELECT doc_id, list_filter([lang, source], lambda x: x <> '') AS list_distinct_first FROM documents WHERE contains(lower(text), 'the') AND list_contains([lang, source], 'en'))")
def note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.filter(F.transform(F.split(F.expr(_TAGS), ","), lambda x: F.trim(x)), lambda x: x != ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", tags.alias("tags"))
    return rows.where(F.lower("text").contains("the") & F.array_contains("tags", "en")).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def tag_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.filter(F.transform(F.split(F.expr(_TAGS), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf_dir, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority || ' #' || (o_custkey % 40) || CASE WHEN o_orderkey % 3 = 0 THEN ' fixes #' || (o_custkey % 7) ELSE '' END AS subject, o_orderkey % 5 = 0 AS plain FROM orders),
g AS (SELECT o_orderkey, CASE WHEN plain THEN 'Other' ELSE regexp_extract(subject, '.*#([0-9]+)', 1) END AS issue FROM c) SELECT issue, count(*)::BIGINT AS n, min(o_orderkey)::BIGINT AS first FROM g GROUP BY issue""")
def release_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects grouped by the last issue number they name, else Other."""
    subject = F.expr("concat(o_orderpriority, ' #', o_custkey % 40, case when o_orderkey % 3 = 0 then concat(' fixes #', o_custkey % 7) else '' end)")
    issue = F.when(F.col("o_orderkey") % 5 == 0, "Other").otherwise(F.regexp_extract(subject, ".*#([0-9]+)", 1))
    return table(spark, sf_dir, "orders").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


_PROMPT_SQL = "SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role || ': ' || {0}, chr(10) ORDER BY turn) AS prompt, sum(strlen(text))::BIGINT AS size FROM conversations GROUP BY conv_id"


def _prompts(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.concat("role", F.lit(": "), text))
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), joined("part", "turn", "\n").alias("prompt"), F.sum(F.octet_length("text")).alias("size"))


@query(_PROMPT_SQL.format("text"))
def assemble_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's whole turns joined in order."""
    return _prompts(spark, sf_dir, F.col("text"))
