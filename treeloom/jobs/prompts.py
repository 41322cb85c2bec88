"""Queries of prompts within byte budgets: contexts, continuations and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.operators import prompts as O
from treeloom.sources.corpus import files

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


_SUMMARY = f"'Binary file: ' || path || chr(10) || 'Kind: ' || {M._KIND} || chr(10) || 'Size: ' || CASE WHEN size < 1024 THEN size || 'B' ELSE (size // 1024) || 'KB' END"


def _sections(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """(project, doc_id, section): source files in whole, others by a summary; a project for each language."""
    summary = F.concat_ws("\n", F.concat(F.lit("Binary file: "), "path"), F.concat(F.lit("Kind: "), "kind"), F.concat(F.lit("Size: "), C.size_label()))
    rows = files(spark, sf_dir, "lang AS project").withColumn("kind", C.kind()).withColumn("content", F.when(F.col("kind") == "source", F.coalesce("text", F.lit(""))).otherwise(summary))
    return rows.select("project", "doc_id", O.section(F.col("path"), "content", F.col("doc_id") % 2 == 0, limit).alias("section"))


def _sections_sql(limit: int) -> str:
    half = limit // 2
    head, tail = ", ".join(f"try(decode(data[1:{half - i}]))" for i in range(4)), ", ".join(f"try(decode(data[bytes - {half} + {1 + i}:bytes]))" for i in range(4))
    return f"""{M.FILES}, c AS (SELECT doc_id, path, CASE WHEN {M._KIND} = 'source' THEN coalesce(text, '') ELSE {_SUMMARY} END AS content FROM (SELECT files.*, d.text FROM files JOIN documents d USING (doc_id))),
b AS (SELECT *, encode(content) AS data, strlen(content) AS bytes FROM c), t AS (SELECT *, coalesce({head}) AS head, coalesce({tail}) AS tail FROM b),
s AS (SELECT d.lang AS project, t.doc_id, '--- File: ' || path || ' (' || CASE WHEN starts_with(content, 'Binary file: ') THEN 'Binary Summary' WHEN t.doc_id % 2 = 0 THEN 'Full File' ELSE 'Extracted Span' END || CASE WHEN bytes > {limit} THEN ', Truncated' ELSE '' END || ') ---' || chr(10)
  || CASE WHEN bytes <= {limit} THEN content ELSE head || chr(10) || '... [cut ' || (bytes - strlen(head) - strlen(tail)) || ' bytes] ...' || chr(10) || tail END || chr(10) || '--- End File ---' || chr(10) AS section FROM t JOIN documents d USING (doc_id))"""


def fitted_ctes(head: str, limit: int) -> str:
    """p(project, n, kept, prompt) from s(project, doc_id, section)."""
    return f"""k AS (SELECT project, section, row_number() OVER w AS k, sum(strlen(section)) OVER w AS upto FROM s WINDOW w AS (PARTITION BY project ORDER BY doc_id)),
m AS (SELECT project, count(*) AS n, coalesce(max(k) FILTER (WHERE upto + strlen({head.format("k")}) <= {limit}), 0) AS kept FROM k GROUP BY project),
p AS (SELECT m.project, n, kept, {head.format("kept")} || coalesce((SELECT string_agg(section, '' ORDER BY k) FROM k WHERE k.project IS NOT DISTINCT FROM m.project AND k.k <= m.kept), '') AS prompt FROM m)"""


def _fitted_sql(head: str, limit: int, trim: int) -> str:
    return f"""WITH {_sections_sql(trim)}, {fitted_ctes(head, limit)}
SELECT project, kept::BIGINT AS kept, (n - kept)::BIGINT AS dropped, strlen(prompt)::BIGINT AS size, prompt FROM p"""


_TASK = "[TASK]\nAnswer from the files below.\n\n[CONTEXT]\n"
_CONTINUED = "[REVIEW, CONTINUED]\nFiles that were asked for follow; they may be newer than those of the review.\n\n[CONTEXT]\n"
_HEAD_SQL = f"('[PROJECT]' || chr(10) || 'Files shown: ' || {{0}} || chr(10) || '{_TASK}')"


def _head(k: Column) -> Column:
    return F.concat(F.lit("[PROJECT]\nFiles shown: "), k.cast("string"), F.lit("\n" + _TASK))


@query(_fitted_sql(_HEAD_SQL, N.PROMPT_BYTES, N.FILE_BYTES))
def context_prompt(spark: SparkSession, sf_dir: str, limit: int = N.PROMPT_BYTES, trim: int = N.FILE_BYTES) -> DataFrame:
    """The context prompt of each project: its head tells how many files follow, the last files go until the whole fits."""
    return O.fitted(_sections(spark, sf_dir, trim), "project", "doc_id", _head, limit)


@query(_fitted_sql(f"'{_CONTINUED}'", N.PROMPT_BYTES, N.FILE_BYTES))
def continuation_prompt(spark: SparkSession, sf_dir: str, limit: int = N.PROMPT_BYTES, trim: int = N.FILE_BYTES) -> DataFrame:
    """Files that a review asked for, behind a head of fixed wording, without map, task and changes."""
    return O.fitted(_sections(spark, sf_dir, trim), "project", "doc_id", lambda _: F.lit(_CONTINUED), limit)


_GROUP = 400
_CHANGE = "CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' WHEN 3 THEN 'copied' ELSE 'modified' END"
_PATCH = "concat('@@ ', CAST(n_chars AS VARCHAR(20)), chr(10), '-', repeat('`', CAST(doc_id % 6 AS INT)), lang, chr(10), '+', source, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN chr(10) ELSE '' END)"
_TEXT = "CASE CAST(doc_id % 37 AS INT) WHEN 5 THEN NULL WHEN 6 THEN concat(text, chr(0), 'x') WHEN 7 THEN concat(text, '````', lang) ELSE text END"
_LIMITS = [N.REVIEW_BYTES - N.TOPOLOGY_RESERVE, N.REVIEW_BYTES]


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = files(spark, sf_dir, f"{_PATCH} AS patch", f"{_CHANGE} AS change", f"{_TEXT} AS content", "doc_id % 19 = 3 AS untracked").withColumn("kind", C.kind()).withColumn("sensitive", C.is_sensitive())
    rows = rows.select(
        F.expr(f"doc_id div {_GROUP}").alias("set"), F.col("doc_id").alias("nth"), F.concat("path", F.lit("~"), F.col("doc_id").cast("string")).alias("path"), "untracked",
        O.initial_status(F.col("kind") == "binary", F.col("sensitive")).alias("status"), F.when(~F.col("untracked"), F.coalesce("patch", F.lit(""))).alias("patch"), "content",
    )
    return O.review(rows, "set", _LIMITS)


_REASON = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.REASONS.items()) + f" WHEN 'oversized' THEN 'file exceeds {N.REVIEW_FILE_BYTES // 1024} KiB' END"
_TICKS = "greatest(3, coalesce(list_max(list_transform(regexp_extract_all({0}, '`+'), lambda x: length(x))), 0) + 1)::INT"
_FENCED = "repeat('`', " + _TICKS + ") || '{1}' || chr(10) || {0} || CASE WHEN ends_with({0}, chr(10)) THEN '' ELSE chr(10) END || repeat('`', " + _TICKS + ")"
_LINE = "'- ' || path || CASE WHEN untracked THEN ', path only: ' ELSE ', diff only: ' END || {0} || chr(10)"

_REVIEWED = f"""{M.FILES}, r0 AS (SELECT f.doc_id // {_GROUP} AS set, f.doc_id AS nth, f.path || '~' || f.doc_id AS path, f.doc_id % 19 = 3 AS untracked, kind, sensitive,
  {_CHANGE.replace("doc_id", "f.doc_id")} AS change, {_PATCH.replace("doc_id", "f.doc_id")} AS patch, {_TEXT.replace("doc_id", "f.doc_id")} AS content FROM (SELECT doc_id, path, {M._KIND} AS kind, {M._SENSITIVE} AS sensitive FROM files) f JOIN documents d USING (doc_id)),
r1 AS (SELECT *, CASE WHEN NOT untracked AND kind = 'binary' THEN 'binary' WHEN sensitive THEN 'sensitive' WHEN untracked THEN NULL WHEN change IN ('added', 'deleted') THEN change WHEN change NOT IN ('modified', 'renamed') THEN 'unavailable' END AS first FROM r0),
r2 AS (SELECT *, first IS NULL AS pending, coalesce(first, CASE WHEN content IS NULL THEN 'unavailable' WHEN strlen(content) > {N.REVIEW_FILE_BYTES} THEN 'oversized' WHEN untracked AND contains(content, chr(0)) THEN 'binary' ELSE 'included' END) AS status FROM r1 WHERE NOT (untracked AND sensitive)),
r AS (SELECT *, {_LINE.format(_REASON.format("status"))} AS line, {_LINE.format("'" + O.REASONS["budget"] + "'")} AS spent_line, CASE WHEN status = 'included' THEN CASE WHEN untracked THEN chr(10) || '[UNTRACKED FILE]' ELSE chr(10) || '[CHANGED FILE]' END || chr(10) || 'Path: ' || path || chr(10) || {_FENCED.format("content", "text")} || chr(10) END AS block FROM r2),
g AS (SELECT set, string_agg(patch, chr(10) || chr(10) ORDER BY nth) FILTER (WHERE NOT untracked) AS diff, string_agg('- ' || path || chr(10), '' ORDER BY nth) FILTER (WHERE untracked) AS others FROM r GROUP BY set),
b0 AS (SELECT set, coalesce(chr(10) || 'Diff:' || chr(10) || {_FENCED.format("diff", "diff")} || chr(10), '') || coalesce(chr(10) || '[UNTRACKED PATHS]' || chr(10) || others, '') AS body FROM g),
b AS (SELECT set, body, strlen(body) AS base, CASE {" ".join(f"WHEN strlen(body) - 1 <= {x} THEN {x}" for x in _LIMITS)} END AS lim FROM b0),
f AS (SELECT r.set, nth, strlen(line) AS n, row_number() OVER w AS i, sum(strlen(line)) OVER w AS upto, sum(strlen(line)) OVER (PARTITION BY r.set) AS whole FROM r WHERE NOT pending WINDOW w AS (PARTITION BY r.set ORDER BY nth)),
kept AS (SELECT b.set, coalesce(max(i) FILTER (WHERE base + upto + {len(O.STATUS_HEAD)} <= lim), 0) AS lines, coalesce(max(upto) FILTER (WHERE base + upto + {len(O.STATUS_HEAD)} <= lim), 0) AS size FROM b LEFT JOIN f USING (set) GROUP BY b.set),
o AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY nth) AS i FROM r),
w(set, i, seen, lines, size, blocks, spent, nth, mark) AS (
  SELECT b.set, 0::BIGINT, 0::BIGINT, lines::BIGINT, size::BIGINT, 0::BIGINT, false, NULL::BIGINT, NULL::VARCHAR FROM b JOIN kept USING (set) WHERE lim IS NOT NULL
  UNION ALL
  SELECT w.set, o.i, seen + CASE WHEN pending THEN 0 ELSE 1 END, CASE WHEN m IN ('B') OR m = 'S' AND pending THEN w.lines + 1 ELSE w.lines END, w.size + CASE WHEN m = 'B' THEN strlen(spent_line) WHEN m = 'S' AND pending THEN strlen(line) ELSE 0 END, w.blocks + CASE WHEN m = 'I' THEN strlen(block) ELSE 0 END,
    w.spent OR m IN ('B', 'b') OR m = 's' AND pending, o.nth, m
  FROM w JOIN o ON o.set = w.set AND o.i = w.i + 1 JOIN b ON b.set = w.set JOIN kept k ON k.set = w.set, LATERAL (SELECT base + w.blocks + w.size + strlen(spent_line) + {len(O.STATUS_HEAD)} <= lim AS fits_spent, base + w.blocks + w.size + coalesce(strlen(line), 0) + {len(O.STATUS_HEAD)} <= lim AS fits_line,
    base + w.blocks + coalesce(strlen(block), 0) + CASE WHEN w.lines > 0 THEN w.size + {len(O.STATUS_HEAD)} ELSE -1 END <= lim AS fits_block), LATERAL (SELECT CASE WHEN NOT pending THEN CASE WHEN w.seen < k.lines THEN 'S' ELSE 's' END WHEN w.spent OR (block IS NOT NULL AND NOT fits_block) THEN CASE WHEN fits_spent THEN 'B' ELSE 'b' END WHEN block IS NOT NULL THEN 'I' WHEN fits_line THEN 'S' ELSE 's' END AS m)),
v AS (SELECT r.*, mark, CASE WHEN mark IN ('B', 'b') THEN 'budget' ELSE status END AS final, mark IN ('B', 'S') AS shown FROM r JOIN w ON w.set = r.set AND w.nth = r.nth)"""


@query(f"WITH RECURSIVE {_REVIEWED} SELECT set, nth, path, final AS status, shown FROM v")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review shows of each changed or untracked file, and whether a line says so."""
    return _review(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {_REVIEWED}, p AS (SELECT b.set, lim, CASE WHEN lim IS NOT NULL THEN regexp_replace(coalesce('{O.STATUS_HEAD.strip()}' || chr(10) || (SELECT string_agg(CASE WHEN mark = 'B' THEN spent_line ELSE line END, '' ORDER BY nth) FROM v WHERE v.set = b.set AND shown), '') || body || coalesce((SELECT string_agg(block, '' ORDER BY nth) FROM v WHERE v.set = b.set AND mark = 'I'), ''), '\\A\\n', '') END AS prompt FROM b)
SELECT set, CASE WHEN lim IS NULL THEN 'overflow' END AS failure, strlen(prompt)::BIGINT AS size, prompt FROM p""")
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of change sets within the budget: status lines, patches, untracked paths and the files that fit, in whole."""
    return _review(spark, sf_dir)[1]
