"""Queries of replies: their updates, their text, and the white space of files that they take the place of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.jobs.selection import _TRIM
from treeloom.operators import replies as R
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


#: Lines of a text as those of a reply: marks of all kinds among them, nested, unclosed, of forbidden paths and in fences.
_LINE = (
    "CASE CAST((doc_id * 5 + {i} * 3 + length(x)) % 29 AS INT) WHEN 0 THEN concat('--- File: src/', source, '.go ---') WHEN 1 THEN '--- End File ---' WHEN 2 THEN '  --- End File --- ' WHEN 3 THEN '```' WHEN 4 THEN '  ```go' WHEN 5 THEN concat('--- File: docs/', lang, '.MD ---') "
    "WHEN 6 THEN '--- Delete File: old/a.txt ---' WHEN 7 THEN '--- File: ../out.go ---' WHEN 8 THEN '--- File: <path> ---' WHEN 9 THEN '--- Delete File: /etc/x ---' WHEN 10 THEN concat(chr(9), x, chr(13)) WHEN 11 THEN '--- File: a.go (Extracted Block) ---' WHEN 12 THEN '' WHEN 13 THEN ' --- File: b.mkd ---' "
    "WHEN 14 THEN '--- End File ---' WHEN 15 THEN '--- File: x*.go ---' WHEN 16 THEN '--- End File ---' WHEN 17 THEN concat('--- File: ', x) WHEN 18 THEN '--- File: c.d/plain ---' WHEN 19 THEN '--- Delete File:  ---' ELSE concat('    ', x) END"
)
_REPLY = "array_join(transform(split(text, '\\n'), (x, i) -> " + _LINE.format(i="i") + "), '\\n')"
_REPLY_SQL = f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_LINE.format(i='(i - 1)')}), chr(10))"
_ERROR = r"CASE WHEN {0} = '' THEN 'empty' WHEN regexp_matches({0}, '^([/\\]|[A-Za-z]:)') THEN 'absolute' WHEN regexp_matches({0}, '[*?\[\]]') THEN 'pattern' WHEN regexp_matches({0}, '[<>]') THEN 'placeholder' WHEN regexp_matches({0}, '(^|[/\\])[.][.]([/\\]|$)') THEN 'outside' WHEN {0} = '.' THEN 'root' END"

_EVENTS = rf"""d0 AS (SELECT doc_id, string_split({_REPLY_SQL}, chr(10)) AS l FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM d0),
x AS (SELECT doc_id, i, regexp_replace(line, '\r$', '') AS line, {_TRIM.format(r"regexp_replace(line, '\r$', '')")} AS t FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM d)),
k0 AS (SELECT *, CASE WHEN t = '--- End File ---' THEN 'end' WHEN starts_with(t, '--- File: ') AND ends_with(t, ' ---') THEN 'write' WHEN starts_with(t, '--- Delete File: ') AND ends_with(t, ' ---') THEN 'delete' WHEN starts_with(t, '```') THEN 'fence' END AS kind FROM x),
k1 AS (SELECT *, regexp_replace(regexp_replace(t, '^(--- File: |--- Delete File: )', ''), ' ---$', '') AS target, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k0 WHERE kind IS NOT NULL),
k AS (SELECT *, {_ERROR.format(_TRIM.format("target"))} AS error, regexp_matches(target, '[<>]') OR contains(target, '(Extracted Block)') AS example, lower(regexp_extract(target, '([.][^./]*)$', 1)) IN ('.md', '.markdown', '.mdown', '.mkd') AS markdown FROM k1),
w(doc_id, n, spot, md, fenced, path, kind, target, error, a, b) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, -1::BIGINT, false, false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM x
  UNION ALL
  SELECT w.doc_id, k.n, CASE WHEN closes THEN -1 WHEN opens THEN k.i ELSE w.spot END, CASE WHEN opens THEN k.markdown ELSE w.md AND NOT closes END, CASE WHEN closes OR opens THEN false WHEN w.spot >= 0 AND w.md AND k.kind = 'fence' THEN NOT w.fenced ELSE w.fenced END, CASE WHEN opens THEN k.target ELSE w.path END,
    CASE WHEN closes THEN 'write' WHEN fails THEN 'error' WHEN gone THEN 'delete' END, CASE WHEN closes THEN w.path WHEN fails OR gone THEN k.target END, CASE WHEN fails THEN k.error END, CASE WHEN closes THEN w.spot ELSE k.i END, k.i
  FROM w JOIN k ON k.doc_id = w.doc_id AND k.n = w.n + 1, LATERAL (SELECT w.spot >= 0 AND k.kind = 'end' AND NOT (w.md AND w.fenced) AS closes, w.spot < 0 AND k.kind IN ('write', 'delete') AND NOT k.example AND k.error IS NOT NULL AS fails,
    w.spot < 0 AND k.kind = 'delete' AND NOT k.example AND k.error IS NULL AS gone, w.spot < 0 AND k.kind = 'write' AND NOT k.example AND k.error IS NULL AS opens)),
final AS (SELECT doc_id, arg_max(spot, n) AS spot, arg_max(path, n) AS path FROM w GROUP BY doc_id),
events AS (SELECT doc_id, kind, target, error, a, b FROM w WHERE kind IS NOT NULL UNION ALL SELECT doc_id, 'open', path, 'no end', spot, 1000000000 FROM final WHERE spot >= 0)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return R.with_events(docs.select("doc_id", R.reply_lines(F.expr(_REPLY)).alias("lines")))


@query(f"""WITH RECURSIVE {_EVENTS} SELECT e.doc_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY a) - 1 AS nth, e.kind, target, CASE WHEN e.kind = 'write' THEN coalesce((SELECT string_agg(line || chr(10), '' ORDER BY i) FROM x WHERE x.doc_id = e.doc_id AND i > a AND i < b), '') END AS content, error FROM events e""")
def reply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that whole replies write or delete, paths that may not be used, and blocks without an end."""
    return R.updates(_replies(spark, sf_dir)).select("doc_id", "nth", "kind", "target", "content", "error")


@query(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM x WHERE NOT starts_with(t, '```') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.doc_id = x.doc_id AND i BETWEEN a AND b) GROUP BY doc_id)
SELECT d.doc_id, {_TRIM.format("coalesce(o.text, '')")} AS text FROM d LEFT JOIN o USING (doc_id)""")
def reply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies say outside their blocks."""
    return _replies(spark, sf_dir).select("doc_id", R.text_outside().alias("text"))


#: Two versions of a text's lines, indented in different ways; every seventh file is new.
_NEW = "CASE CAST((doc_id + {i}) % 7 AS INT) WHEN 0 THEN concat(repeat(' ', CAST(2 + doc_id % 3 AS INT)), x) WHEN 1 THEN concat(repeat(' ', CAST(5 + doc_id % 4 AS INT)), x) WHEN 2 THEN concat(chr(9), CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' ' ELSE '' END, x) WHEN 3 THEN concat(repeat(' ', CAST(2 + doc_id % 3 AS INT)), '.') WHEN 4 THEN '    ' WHEN 5 THEN concat('  ', chr(9), x) ELSE x END"
_OLD = "CASE CAST((doc_id + {i}) % 5 AS INT) WHEN 0 THEN concat(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN chr(9) WHEN 1 THEN '  ' ELSE '   ' END, x) WHEN 1 THEN concat(CASE CAST(doc_id % 2 AS INT) WHEN 0 THEN chr(9) ELSE '    ' END, x) WHEN 2 THEN CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' ' ELSE '' END ELSE x END"
_VOTES = "(SELECT doc_id, l, list_filter(l, lambda x: regexp_matches(x, '^[ \t]'))[1:200] AS v FROM {0})"
_STYLE = "SELECT doc_id, 2 * len(list_filter(v, lambda x: starts_with(x, chr(9)))) >= len(v) AS tabs, list_transform(list_filter(v, lambda x: starts_with(x, ' ')), lambda x: length(regexp_extract(x, '^ +'))) AS widths FROM {0}"
_WIDTH = "SELECT doc_id, tabs, (SELECT arg_min(u, struct_pack(a := -c, b := u)) FROM (SELECT u, count(*) AS c FROM (SELECT unnest(widths) AS u) GROUP BY u)) AS width FROM ({0})"


@query(rf"""WITH a AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {_NEW.format(i="(i - 1)")}) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {_OLD.format(i="(i - 1)")}) AS l FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0),
s AS ({_WIDTH.format(_STYLE.format(_VOTES.format("a")))}), g AS ({_WIDTH.format(_STYLE.format(_VOTES.format("b")))}),
r AS (SELECT doc_id, i, x, regexp_extract(x, '^[ \t]*') AS lead, regexp_replace(x, '^[ \t]+', '') AS rest, length(regexp_extract(x, '^\t*')) AS t, length(regexp_extract(x, '^ *')) AS n FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM a)),
m AS (SELECT unnest(['exact', 'smart', 'ignore']) AS mode),
q AS (SELECT r.doc_id, mode, i, x, rest, g.tabs, g.width, CASE WHEN mode = 'ignore' THEN length(lead) // u WHEN t > 0 THEN t ELSE n // u END AS depth, CASE WHEN mode = 'ignore' OR t > 0 THEN 0 ELSE n % u END AS odd, g.doc_id IS NULL OR mode = 'exact' AS same
  FROM (SELECT r.*, CASE WHEN s.tabs THEN 1 ELSE s.width END AS u FROM r JOIN s USING (doc_id)) r CROSS JOIN m LEFT JOIN (SELECT g.* FROM g JOIN b USING (doc_id) WHERE array_to_string(b.l, chr(10)) <> '') g ON g.doc_id = r.doc_id)
SELECT doc_id, mode, string_agg(CASE WHEN same THEN x WHEN rest = '' THEN '' WHEN tabs THEN repeat(chr(9), depth::INT) || repeat(' ', odd::INT) || rest ELSE repeat(' ', (depth * width + odd)::INT) || rest END, chr(10) ORDER BY i) AS content FROM q GROUP BY doc_id, mode""")
def reindent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole new texts in the indentation of the files that they take the place of, in each mode; the two versions are joined by file."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    made = lambda lines: F.expr("array_join(transform(split(text, '\\n'), (x, i) -> " + lines.format(i="i") + "), '\\n')")
    incoming, existing = docs.select("doc_id", made(_NEW).alias("incoming")), docs.where("doc_id % 7 <> 0").select("doc_id", made(_OLD).alias("existing"))
    both = incoming.join(existing, "doc_id", "left")
    modes = F.map_from_arrays(F.array(*map(F.lit, ("exact", "smart", "ignore"))), F.array(*(R.reindented(F.col("incoming"), F.col("existing"), m) for m in ("exact", "smart", "ignore"))))
    return both.select("doc_id", F.explode(modes).alias("mode", "content"))
