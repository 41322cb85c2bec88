"""Queries of change records and workspace files, with malformed ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators import changes as C
from treeloom.operators.ranking import joined
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


#: Change sets of forty documents: renames, copies, binary files, tabs and blanks in paths; the last record of some sets lacks its end.
_SET = "CAST(floor(doc_id / 40) AS BIGINT)"
_OLD, _NEW = "concat('old/', source, ' ', CAST(doc_id AS VARCHAR(20)))", "concat(lang, '/', CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('a', chr(9), 'b') ELSE 'f' END, CAST(doc_id AS VARCHAR(20)))"
_STATUS = f"CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN concat('R', CAST(50 + doc_id % 50 AS VARCHAR(9)), chr(0), {_OLD}, chr(0), {_NEW}) WHEN 1 THEN concat('A', chr(0), {_NEW}) WHEN 2 THEN concat('D', chr(0), {_NEW}) WHEN 3 THEN concat('T', chr(0), {_NEW}) ELSE concat('M', chr(0), {_NEW}) END"
_COUNTS = f"concat(CASE CAST(doc_id % 4 AS INT) WHEN 1 THEN concat('-', chr(9), '-') ELSE concat(CAST(length(text) AS VARCHAR(20)), chr(9), CAST(doc_id % 13 AS VARCHAR(9))) END, chr(9), CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN concat(chr(0), {_OLD}, chr(0), {_NEW}) ELSE {_NEW} END)"
#: What stands behind the records of a set: an end, none, a status alone, half a rename, a field of no record.
_TAILS = "CASE CAST({0} % 7 AS INT) WHEN 1 THEN '' WHEN 2 THEN concat(chr(0), 'M') WHEN 3 THEN concat(chr(0), 'R90', chr(0), 'x') WHEN 4 THEN concat(chr(0), chr(0), 'A', chr(0), 'late') ELSE chr(0) END"
_COUNT_TAILS = "CASE CAST({0} % 7 AS INT) WHEN 1 THEN '' WHEN 2 THEN concat(chr(0), 'no tabs') WHEN 3 THEN concat(chr(0), '1', chr(9), '2', chr(9), chr(0), 'x') WHEN 4 THEN concat(chr(0), chr(0), '1', chr(9), '1', chr(9), 'late') ELSE chr(0) END"


def _sets(spark: SparkSession, sf_dir: str, record: str, tail: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.expr(_SET).alias("set"), "doc_id", F.expr(record).alias("record")).where("record is not null")
    return rows.groupBy("set").agg(joined("record", "doc_id", "\x00").alias("body")).select("set", F.concat("body", F.expr(tail.format("`set`"))).alias("text"))  # forty records at most


def _set_sql(record: str, tail: str) -> str:
    return f"o AS (SELECT set, body || {tail.format('set')} AS text FROM (SELECT {_SET} AS set, string_agg({record}, chr(0) ORDER BY doc_id) AS body FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)), f AS (SELECT set, string_split(text, chr(0)) AS f FROM o)"


@query(f"""WITH RECURSIVE {_set_sql(_STATUS, _TAILS)}, w(set, i, n, state, status, kind, previous, path) AS (SELECT set, 0, 0, 'status', '', NULL::VARCHAR, '', NULL::VARCHAR FROM f UNION ALL
  SELECT w.set, i + 1, CASE WHEN state = 'path' THEN n + 1 ELSE n END, CASE state WHEN 'status' THEN CASE WHEN x = '' THEN 'end' WHEN x[1] = 'R' THEN 'old' ELSE 'path' END WHEN 'old' THEN 'path' ELSE 'status' END, CASE WHEN state = 'status' THEN x ELSE status END,
    CASE WHEN state = 'path' THEN CASE status[1] WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END END, CASE state WHEN 'status' THEN '' WHEN 'old' THEN x ELSE w.previous END, CASE WHEN state = 'path' THEN x END
  FROM w JOIN f USING (set), LATERAL (SELECT f.f[i + 1] AS x) WHERE i < len(f.f) AND state <> 'end'),
e AS (SELECT set, arg_max(state, i) NOT IN ('status', 'end') AS bad FROM w GROUP BY set)
SELECT e.set, CASE WHEN bad THEN 'incomplete' END AS error, (n - 1)::BIGINT AS nth, kind, path, previous FROM e LEFT JOIN w ON w.set = e.set AND kind IS NOT NULL AND NOT bad""")
def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of sets from their status records; of incomplete ones the error alone."""
    read = _sets(spark, sf_dir, _STATUS, _TAILS).select("set", C.name_status(F.col("text")).alias("r"))
    return read.select("set", F.col("r.error").alias("error"), F.posexplode_outer("r.changes").alias("nth", "c")).select("set", "error", F.col("nth").cast("long").alias("nth"), "c.kind", "c.path", "c.previous")


@query(rf"""WITH RECURSIVE {_set_sql(_COUNTS, _COUNT_TAILS)}, w(set, i, n, state, record, path) AS (SELECT set, 0, 0, 'record', '', NULL::VARCHAR FROM f UNION ALL
  SELECT w.set, i + 1, CASE WHEN state = 'new' OR state = 'record' AND good AND tail <> '' THEN n + 1 ELSE n END, CASE state WHEN 'record' THEN CASE WHEN x = '' THEN 'end' WHEN NOT good THEN 'bad' WHEN tail = '' THEN 'old' ELSE 'record' END WHEN 'old' THEN 'new' ELSE 'record' END,
    CASE WHEN state = 'record' THEN x ELSE record END, CASE WHEN state = 'new' THEN x WHEN state = 'record' AND good AND tail <> '' THEN tail END
  FROM w JOIN f USING (set), LATERAL (SELECT f.f[i + 1] AS x, len(string_split(f.f[i + 1], chr(9))) >= 3 AS good, array_to_string(string_split(f.f[i + 1], chr(9))[3:], chr(9)) AS tail) WHERE i < len(f.f) AND state NOT IN ('end', 'bad')),
e AS (SELECT set, arg_max(state, i) NOT IN ('record', 'end') AS bad FROM w GROUP BY set),
p AS (SELECT set, n, path, string_split(record, chr(9))[1] AS a, string_split(record, chr(9))[2] AS r FROM w WHERE path IS NOT NULL)
SELECT e.set, CASE WHEN bad THEN 'incomplete' END AS error, (n - 1)::BIGINT AS nth, path, a = '-' AND r = '-' AS "binary", CASE WHEN regexp_matches(a, '^[0-9]+$') THEN a::BIGINT END AS added, CASE WHEN regexp_matches(r, '^[0-9]+$') THEN r::BIGINT END AS removed FROM e LEFT JOIN p ON p.set = e.set AND NOT bad""")
def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of sets from their count records, with renames and binary files; of incomplete ones the error alone."""
    read = _sets(spark, sf_dir, _COUNTS, _COUNT_TAILS).select("set", C.numstat(F.col("text")).alias("r"))
    return read.select("set", F.col("r.error").alias("error"), F.posexplode_outer("r.counts").alias("nth", "c")).select("set", "error", F.col("nth").cast("long").alias("nth"), "c.path", "c.binary", "c.added", "c.removed")


#: Workspace files: lines of a text among directives, single and in blocks, with comments and odd ends.
_WORK = "CASE CAST((doc_id * 3 + {i} * 7) % 14 AS INT) WHEN 0 THEN 'use (' WHEN 1 THEN ')' WHEN 2 THEN concat('use ./', source, ' // ', x) WHEN 3 THEN concat(chr(9), './', lang, ' note') WHEN 4 THEN '// use ./no' WHEN 5 THEN concat('use ( \"./', source, '\"') WHEN 6 THEN concat('  ./', lang, '/z )') WHEN 7 THEN 'go 1.22' WHEN 8 THEN concat('use (./one', CAST({i} AS VARCHAR(9)), ')') WHEN 9 THEN '' WHEN 10 THEN 'replace x => ./y' WHEN 11 THEN 'use' ELSE concat('// ', x) END"
_WORD = "regexp_replace(regexp_extract({0}, '^\\s*(\\S+)', 1), '^[\"'']+|[\"'']+$', '', 'g')"


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: trim(regexp_replace(regexp_replace({_WORK.format(i="(i - 1)")}, '(?s)//.*', ''), '^[ \t]+|[ \t]+$', '', 'g'))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
w(doc_id, i, inside, found) AS (SELECT doc_id, 0, false, []::VARCHAR[] FROM t UNION ALL
  SELECT w.doc_id, i + 1, CASE WHEN inside THEN NOT ends_with(x, ')') WHEN starts_with(x, 'use') THEN starts_with(rest, '(') AND NOT ends_with(x, ')') ELSE false END, CASE WHEN word <> '' THEN list_append(found, word) ELSE found END
  FROM w JOIN t USING (doc_id), LATERAL (SELECT t.l[i + 1] AS x, trim(substr(t.l[i + 1], 4)) AS rest), LATERAL (SELECT CASE WHEN inside THEN CASE WHEN x = ')' THEN '' ELSE {_WORD.format("regexp_replace(x, '\\)$', '')")} END
    WHEN starts_with(x, 'use') THEN {_WORD.format("regexp_replace(regexp_replace(rest, '^\\(', ''), '\\)$', '')")} ELSE '' END AS word) WHERE i < len(t.l))
SELECT doc_id, array_to_string(arg_max(found, i), ' ') AS members FROM w GROUP BY doc_id""")
def workspace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of workspace files, with directives and blocks in any order."""
    made = "array_join(transform(split(text, '\\n'), (x, i) -> " + _WORK.format(i="i") + "), '\\n')"
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(made).alias("work"))
    return docs.select("doc_id", F.array_join(C.workspace_members(F.col("work")), " ").alias("members"))
