"""The query of the whole extraction: requests for parts of files, answered within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.jobs import prompts as P
from treeloom.jobs.selection import _RE, _TRIM
from treeloom.jobs.spans import _BRACE, _DECLARATION, _INDENT
from treeloom.operators import extraction as E
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


_GROUP = 250
#: A line of a request for each document: its own file in whole, by a line's start, by a part of a line, by what isn't there; paths of no file, prose, bad forms, repeats.
_LINE = (
    "CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN concat('FILE: ', path) WHEN 1 THEN concat('prefix:', path, ' # ', {word}) WHEN 2 THEN concat('Near: ', path, '#', {part}) WHEN 3 THEN concat('PREFIX: ', path) WHEN 4 THEN concat('NEAR: ', path, ' # not in any file') WHEN 5 THEN concat('FILE: none/', path) "
    "WHEN 6 THEN concat('file: ', path, ' # ignored') WHEN 7 THEN concat('PREFIX: ', path, '#', {word}) WHEN 8 THEN concat('See FILE ', path) ELSE 'FILE: README.md' END"
)
_SPARK_LINE = _LINE.format(word="substring_index(trim(element_at(split(text, '\\n'), cast((size(split(text, '\\n')) + 1) div 2 as int))), ' ', 2)", part="substring_index(trim(element_at(split(text, '\\n'), cast((size(split(text, '\\n')) + 2) div 3 as int))), ' ', -1)")
_SQL_LINE = _LINE.format(word="array_to_string(string_split(trim(string_split(text, chr(10))[(len(string_split(text, chr(10))) + 1) // 2]), ' ')[1:2], ' ')", part="string_split(trim(string_split(text, chr(10))[(len(string_split(text, chr(10))) + 2) // 3]), ' ')[-1]")
#: The lines of source files as code: whole texts, some lines with braces, comments and definitions in front.
_CODE_LINE = "CASE CAST((doc_id + {i} * 5) % 9 AS INT) WHEN 1 THEN concat(x, ' {{') WHEN 3 THEN concat('    ', x) WHEN 4 THEN concat('}} // ', x) WHEN 6 THEN concat('# ', x) WHEN 7 THEN concat('  ', x, ' =') ELSE x END"
_SPARK_CODE = "array_join(transform(split(text, '\\n'), (x, i) -> " + _CODE_LINE.format(i="i") + "), '\\n')"
_SQL_CODE = f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_CODE_LINE.format(i='(i - 1)')}), chr(10))"


@query(rf"""WITH RECURSIVE {M.FILES}, f0 AS (SELECT *, {M._KIND} AS kind FROM files), f1 AS (SELECT f0.*, d.text FROM f0 JOIN documents d USING (doc_id)), f AS (SELECT path, arg_min(kind, doc_id) AS kind, min(doc_id) AS first FROM f1 WHERE text IS NOT NULL GROUP BY path),
known AS (SELECT f.path, f.kind, f.doc_id, strlen({_SQL_CODE}) AS size, {_SQL_CODE} AS text FROM (SELECT f.path, f.kind, d.doc_id, d.text FROM f JOIN documents d ON d.doc_id = f.first) f),
sel AS (SELECT doc_id // {_GROUP} AS req_id, doc_id AS seq, {_SQL_LINE.replace("text", "code")} AS line FROM (SELECT f1.doc_id, f1.path, {_SQL_CODE.replace("doc_id", "f1.doc_id")} AS code FROM f1 WHERE text IS NOT NULL)),
raw AS (SELECT *, upper(regexp_extract(line, '{_RE}', 1)) AS type, {_TRIM.format(f"regexp_extract(line, '{_RE}', 2)")} AS sel_path, {_TRIM.format(f"regexp_extract(line, '{_RE}', 3)")} AS pattern FROM sel),
g0 AS (SELECT req_id, seq, type, sel_path, CASE WHEN type = 'FILE' THEN '' ELSE pattern END AS pattern FROM raw WHERE type <> '' AND sel_path <> '' AND (type = 'FILE' OR pattern <> '')),
g1 AS (SELECT * FROM (SELECT *, bool_or(type = 'FILE') OVER (PARTITION BY req_id, sel_path) AS whole FROM g0) WHERE type = 'FILE' OR NOT whole),
g AS (SELECT req_id, min(seq) AS seq, type, sel_path, pattern, string_split(sel_path, '/')[-1] AS name, sel_path AS path FROM g1 GROUP BY ALL), h AS (SELECT *, {M._SENSITIVE} AS sensitive FROM g),
sd AS (SELECT *, row_number() OVER () AS doc_id FROM (SELECT DISTINCT type, sel_path, pattern FROM h WHERE NOT sensitive)),
kd AS (SELECT sd.*, known.kind, known.size, known.text FROM sd JOIN known ON known.path = sd.sel_path),
x0 AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM kd WHERE kind = 'source' AND type <> 'FILE'),
x AS (SELECT doc_id, i, line, {_TRIM.format("line")} AS t, length(replace(regexp_extract(line, '^[ \t]*'), chr(9), '    ')) AS depth FROM x0),
xs AS (SELECT *, t = '' AS blank, regexp_matches(t, '^(//|/\*|\*|#)') AS comment, regexp_matches(t, '^(//|/\*|\*|#|@)') AS att, regexp_matches(t, '(?s)^(def|class|async def) .*:$') AS intro FROM x),
anc AS (SELECT xs.doc_id, coalesce(min(i) FILTER (WHERE CASE type WHEN 'NEAR' THEN contains(t, pattern) ELSE starts_with(t, pattern) END), -1) AS spot, max(i) + 1 AS n FROM xs JOIN kd USING (doc_id) GROUP BY xs.doc_id),
st AS (SELECT anc.doc_id, spot, n, CASE WHEN spot < 0 THEN 0 WHEN bool_or(att) FILTER (WHERE i = spot) THEN coalesce(max(i) FILTER (WHERE i < spot AND NOT att), -1) + 1 ELSE spot END AS start FROM anc JOIN xs USING (doc_id) GROUP BY anc.doc_id, spot, n),
{_BRACE}, {_INDENT}, {_DECLARATION},
e AS (SELECT st.*, unnest([1, 2, 3]) AS k, unnest(['brace', 'indent', 'declaration']) AS method, unnest([brace::BIGINT, indent::BIGINT, declaration::BIGINT]) AS last FROM st LEFT JOIN brace USING (doc_id) LEFT JOIN ind USING (doc_id) LEFT JOIN decl USING (doc_id)),
u AS (SELECT e.doc_id, min_by(method, k) AS method, min_by(last, k) AS last FROM e WHERE spot >= 0 AND EXISTS (SELECT 1 FROM xs WHERE xs.doc_id = e.doc_id AND i BETWEEN start AND last AND NOT blank AND NOT comment) GROUP BY e.doc_id),
q0 AS (SELECT st.doc_id, method, method IS NULL AND n <= {N.SMALL_LINES} AND kd.size <= {N.SMALL_BYTES} AS full_file, last, n, greatest(spot, 0) AS spot, start FROM st JOIN kd USING (doc_id) LEFT JOIN u USING (doc_id)),
q AS (SELECT doc_id, full_file, CASE WHEN method IS NOT NULL THEN start WHEN full_file THEN 0 ELSE greatest(spot - {N.LINES_BEFORE}, 0) END AS first_line, CASE WHEN method IS NOT NULL THEN last WHEN full_file THEN n - 1 ELSE least(spot + {N.LINES_AFTER}, n - 1) END AS last_line FROM q0),
c AS (SELECT q.doc_id, full_file, string_agg(line, chr(10) ORDER BY i) || CASE WHEN full_file THEN '' ELSE chr(10) END AS content FROM q JOIN xs USING (doc_id) WHERE i BETWEEN first_line AND last_line GROUP BY q.doc_id, full_file
  UNION ALL SELECT doc_id, true, CASE WHEN kind = 'source' THEN text ELSE 'Binary file: ' || sel_path || chr(10) || 'Kind: ' || kind || chr(10) || 'Size: ' || CASE WHEN size < 1024 THEN size || 'B' ELSE (size // 1024) || 'KB' END END FROM kd WHERE kind <> 'source' OR type = 'FILE'),
sec AS (SELECT sd.type, sd.sel_path, sd.pattern, '--- File: ' || sd.sel_path || ' (' || CASE WHEN starts_with(content, 'Binary file: ') THEN 'Binary Summary' WHEN full_file THEN 'Full File' ELSE 'Extracted Span' END || CASE WHEN strlen(content) > {N.FILE_BYTES} THEN ', Truncated' ELSE '' END || ') ---' || chr(10) || {{trimmed}} || chr(10) || '--- End File ---' || chr(10) AS section FROM c JOIN sd USING (doc_id)),
held AS (SELECT h.req_id, h.seq, section FROM h LEFT JOIN sec USING (type, sel_path, pattern) WHERE NOT sensitive), s AS (SELECT req_id AS project, seq AS doc_id, section FROM held WHERE section IS NOT NULL), {P.fitted_ctes(P._HEAD_SQL, N.PROMPT_BYTES)},
v AS (SELECT req_id, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'excluded') AS n_excluded FROM (SELECT req_id, CASE WHEN section IS NULL THEN 'failed' ELSE 'ok' END AS status FROM held UNION ALL SELECT req_id, 'excluded' FROM h WHERE sensitive) GROUP BY req_id)
SELECT req_id, n_ok::BIGINT AS n_ok, n_failed::BIGINT AS n_failed, n_excluded::BIGINT AS n_excluded, CASE WHEN n_ok > 0 AND n_failed + n_excluded > 0 THEN 'proceed' WHEN n_ok > 0 THEN 'ok' WHEN n_failed > 0 THEN 'failed' ELSE 'no_safe_files' END AS verdict,
  kept::BIGINT AS kept, (n - kept)::BIGINT AS dropped, strlen(prompt)::BIGINT AS size, prompt FROM v LEFT JOIN p ON p.project = v.req_id""".replace("{trimmed}", "CASE WHEN strlen(content) <= {0} THEN content ELSE coalesce({1}) || chr(10) || '... [cut ' || (strlen(content) - strlen(coalesce({1})) - strlen(coalesce({2}))) || ' bytes] ...' || chr(10) || coalesce({2}) END".format(
    N.FILE_BYTES, ", ".join(f"try(decode(encode(content)[1:{N.FILE_BYTES // 2 - i}]))" for i in range(4)), ", ".join(f"try(decode(encode(content)[strlen(content) - {N.FILE_BYTES // 2} + {1 + i}:strlen(content)]))" for i in range(4)))))
def extraction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of selectors to their verdict and prompt: parsed, made unique, resolved, checked, carved, rendered and cut to the budget."""
    rows = files(spark, sf_dir, f"{_SPARK_CODE} AS code").where("text is not null").withColumn("text", F.col("code"))
    selectors = rows.select(F.expr(f"doc_id div {_GROUP}").alias("req_id"), F.col("doc_id").alias("seq"), F.explode(F.array(F.expr(_SPARK_LINE))).alias("line"))
    known = rows.withColumn("kind", C.kind()).groupBy("path").agg(F.min_by(F.struct("kind", F.octet_length("text").alias("size"), "text"), "doc_id").alias("f")).select("path", "f.*")
    return E.context(selectors, known, P._head)
