"""Queries of text spans: first matches, comments above them, braces, bodies, declarations and the cascade of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.operators import spans as S
from treeloom.sources.corpus import table

QUERIES, ORACLE = {}, {}

_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_DOC_LINES = "lines AS (SELECT doc_id, i - 1 AS ln, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lines, pattern) of ``documents``; the pattern, eight characters from the middle, is null where it would match anything or no line."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", S.lines_of().alias("lines"), F.expr("substring(text, length(text) div 2, 8)").alias("pattern"))
    return docs.withColumn("pattern", F.when((F.instr("pattern", "\n") == 0) & (F.trim("pattern") != ""), F.col("pattern")))


_WANTED = "wanted AS (SELECT doc_id, pattern FROM (SELECT doc_id, substring(text, greatest(length(text) // 2, 1), CASE WHEN length(text) // 2 = 0 THEN 8 ELSE 8 END) AS pattern FROM documents) WHERE NOT contains(pattern, chr(10)) AND trim(pattern) <> '')"


@query(f"WITH {_DOC_LINES}, {_WANTED} SELECT doc_id, min(ln)::BIGINT AS anchor FROM lines JOIN wanted USING (doc_id) WHERE contains({_TRIM.format('line')}, pattern) GROUP BY doc_id")
def near_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", S.first_match(F.col("lines"), F.col("pattern"), near=True).alias("anchor"))
    return found.where("anchor >= 0")


@query(f"WITH {_DOC_LINES}, w AS (SELECT doc_id, substring(line, 1, 4) AS pattern FROM lines WHERE ln = 1 AND trim(line) <> '') SELECT doc_id, min(ln)::BIGINT AS anchor FROM lines JOIN w USING (doc_id) WHERE starts_with({_TRIM.format('line')}, pattern) GROUP BY doc_id")
def prefix_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("second", F.get("lines", F.lit(1)))
    pattern = F.when(F.trim("second") != "", F.substring("second", 1, 4))
    return docs.select("doc_id", S.first_match(F.col("lines"), pattern, near=False).alias("anchor")).where("anchor >= 0")


_MARKED = "marked AS (SELECT doc_id, ln, CASE WHEN (doc_id + ln) % 3 <> 0 THEN '# ' || line ELSE line END AS line FROM lines)"


@query(rf"""WITH {_DOC_LINES}, {_MARKED}, a AS (SELECT doc_id, max(ln) // 2 AS anchor FROM marked GROUP BY doc_id), c AS (SELECT m.doc_id, anchor, ln, regexp_matches(line, '^\s*(#|//|/\*|\*|@)') AS comment FROM marked m JOIN a USING (doc_id) WHERE ln <= anchor)
SELECT doc_id, anchor::BIGINT AS anchor, (CASE WHEN arg_max(comment, ln) THEN coalesce(max(ln) FILTER (WHERE NOT comment), -1) + 1 ELSE anchor END)::BIGINT AS start FROM c GROUP BY doc_id, anchor""")
def anchor_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    marked = F.transform("lines", lambda x, i: F.when((F.col("doc_id") + i) % 3 != 0, F.concat(F.lit("# "), x)).otherwise(x))
    anchor = F.expr("cast((size(lines) - 1) div 2 as long)")
    return docs.select("doc_id", anchor.alias("anchor"), marked.alias("lines")).select("doc_id", "anchor", S.extend(F.col("lines"), F.col("anchor")).alias("start"))


_SIZES = "sizes AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, strlen(text) AS size FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_DOC_LINES}, {_WANTED}, {_SIZES}, a AS (SELECT doc_id, min(ln) AS anchor FROM lines JOIN wanted USING (doc_id) WHERE contains({_TRIM.format("line")}, pattern) GROUP BY doc_id),
p AS (SELECT doc_id, n_lines <= {N.SMALL_LINES} AND size <= {N.SMALL_BYTES} AS full_file, n_lines, coalesce(anchor, 0) AS anchor FROM sizes LEFT JOIN a USING (doc_id)),
q AS (SELECT doc_id, full_file, CASE WHEN full_file THEN 0 ELSE greatest(anchor - 3, 0) END AS first_line, CASE WHEN full_file THEN n_lines - 1 ELSE least(anchor + 6, n_lines - 1) END AS last_line FROM p)
SELECT doc_id, full_file, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, string_agg(line, chr(10) ORDER BY ln) AS content FROM q JOIN lines USING (doc_id) WHERE ln BETWEEN first_line AND last_line GROUP BY ALL""")
def fallback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("anchor", F.coalesce(S.first_match(F.col("lines"), F.col("pattern"), near=True), F.lit(0)))
    whole, (low, high) = S.small_file(F.col("lines"), F.octet_length("text")), S.window(F.col("lines"), F.col("anchor"))
    last = (F.size("lines") - 1).cast("long")
    docs = docs.select("doc_id", "lines", whole.alias("full_file"), F.when(whole, 0).otherwise(low).cast("long").alias("first_line"), F.when(whole, last).otherwise(high).alias("last_line"))
    return docs.select("doc_id", "full_file", "first_line", "last_line", S.joined(F.col("lines"), F.col("first_line"), F.col("last_line")).alias("content"))


# Code-like lines: documents with definitions, comments, annotations, declarations and braces between; pages with a line
# for each tag, brace and semicolon.
_CODE_LINE = (
    "CASE CAST((doc_id + {i} * 7) % 11 AS INT) WHEN 0 THEN concat('def ', x, ':') WHEN 1 THEN '' WHEN 2 THEN concat('    # ', x) WHEN 3 THEN concat('@', x) WHEN 4 THEN concat('# ', x) WHEN 5 THEN concat('    ', x) "
    "WHEN 6 THEN concat(chr(9), x, ';') WHEN 7 THEN concat('const ', x, ' =') WHEN 8 THEN concat('  var s = ''it {{'' + \"', lang, ' }} \"', ' // {{ ', x) WHEN 9 THEN concat('}} // ', x) ELSE concat(x, ' {{') END"
)


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines, size, at, start): pages have negative ids; the anchor is a third down, or the first line with a brace after that."""
    made = "transform(split(text, '\n'), (x, i) -> " + _CODE_LINE.format(i="i") + ")"
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(made).alias("lines"))
    pages = table(spark, sf_dir, "pages").where("html is not null").select((-1 - F.col("page_id")).alias("doc_id"), F.split(F.regexp_replace("html", "([;{>])", "$1\n"), "\n").alias("lines"))
    rows = docs.unionByName(pages).withColumn("third", F.expr("cast(size(lines) div 3 as long)"))
    brace = F.array_position(F.transform(F.slice("lines", F.col("third").cast("int") + 1, F.size("lines")), lambda x: F.contains(x, F.lit("{"))), True)
    at = F.when((F.col("doc_id") % 3 == 0) & (brace > 0), F.col("third") + brace - 1).otherwise(F.col("third"))
    rows = rows.select("doc_id", "lines", F.octet_length(F.array_join("lines", "\n")).alias("size"), at.alias("at"))
    return rows.withColumn("start", S.extend(F.col("lines"), F.col("at")))


_CODE = rf"""d0 AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {_CODE_LINE.format(i="(i - 1)")}) AS l FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT -1 - page_id, string_split(regexp_replace(html, '([;{{>])', '\1' || chr(10), 'g'), chr(10)) FROM pages WHERE html IS NOT NULL),
x0 AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line, len(l) // 3 AS third FROM d0),
x AS (SELECT doc_id, i, line, third, {_TRIM.format("line")} AS t, length(replace(regexp_extract(line, '^[ \t]*'), chr(9), '    ')) AS depth FROM x0),
xs AS (SELECT *, t = '' AS blank, regexp_matches(t, '^(//|/\*|\*|#)') AS comment, regexp_matches(t, '^(//|/\*|\*|#|@)') AS att, regexp_matches(t, '(?s)^(def|class|async def) .*:$') AS intro FROM x),
anc AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(min(i) FILTER (WHERE i >= third AND contains(line, '{{')), any_value(third)) ELSE any_value(third) END AS spot, max(i) + 1 AS n FROM xs GROUP BY doc_id),
st AS (SELECT anc.doc_id, spot, n, CASE WHEN bool_or(att) FILTER (WHERE i = spot) THEN coalesce(max(i) FILTER (WHERE i < spot AND NOT att), -1) + 1 ELSE spot END AS start FROM anc JOIN xs USING (doc_id) GROUP BY anc.doc_id, spot, n)"""

_TOKEN_SQL = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|#[^\n]*|''(?:[^''\\]|\\.)*(?:\\?\z|'')|"(?:[^"\\]|\\.)*(?:\\?\z|")|`(?:[^`\\]|\\.)*(?:\\?\z|`)|[{};\n]"""


def _tokens(name: str, most: int, line: str) -> str:
    """{name}_w: tokens of the slice from ``start`` on with line and running counts; a last line end closes the slice."""
    return f"""{name}_s AS (SELECT st.doc_id, start, regexp_extract_all(string_agg({line}, chr(10) ORDER BY i), '{_TOKEN_SQL}') AS tokens FROM st JOIN xs USING (doc_id) WHERE i >= start AND i < start + {most} GROUP BY ALL),
{name}_t AS (SELECT doc_id, start, unnest(list_append(tokens, chr(10))) AS tok, unnest(range(0, len(tokens) + 1)) AS k FROM {name}_s),
{name}_n AS (SELECT *, length(tok) - length(replace(tok, chr(10), '')) AS nl FROM {name}_t),
{name}_w AS (SELECT *, start + coalesce(sum(nl) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i, sum((tok = '{{')::INT) OVER (PARTITION BY doc_id ORDER BY k) AS opens, sum((tok = '{{')::INT - (tok = '}}')::INT) OVER (PARTITION BY doc_id ORDER BY k) AS depth FROM {name}_n)"""


_BRACE = f"""{_tokens("b", N.BRACE_LINES, "line")}, brace AS (SELECT doc_id, min(i) FILTER (WHERE nl > 0 AND opens > 0 AND depth <= 0) AS brace FROM b_w GROUP BY doc_id)"""
_INDENT = f"""i_a AS (SELECT st.doc_id, n, min(i) AS a FROM st JOIN xs USING (doc_id) WHERE i >= start AND i < start + {N.INDENT_LINES} AND NOT blank AND NOT att GROUP BY ALL),
i_b AS (SELECT i_a.doc_id, n, a, depth AS base FROM i_a JOIN xs ON xs.doc_id = i_a.doc_id AND i = a WHERE intro),
i_c AS (SELECT i_b.doc_id, n, a, base, coalesce(min(i) FILTER (WHERE i > a AND NOT blank AND depth <= base), n) AS stop FROM i_b JOIN xs USING (doc_id) GROUP BY i_b.doc_id, n, a, base),
ind AS (SELECT i_c.doc_id, CASE WHEN count(*) FILTER (WHERE i > a AND i < stop AND NOT blank AND NOT comment) > 0 THEN stop - 1 ELSE coalesce(max(i) FILTER (WHERE i > a AND i < stop AND comment), a) END AS indent FROM i_c JOIN xs USING (doc_id) GROUP BY i_c.doc_id, a, stop)"""
_DECLARES = "(?s)=>|->|[=(){}\\[\\]<>;]|^(const|let|var|func|type|interface|class|export|public|private|protected|static|package|import|return|if|for|switch|case|async|def) "
_DECLARATION = f"""{_tokens("c", N.DECLARATION_LINES, "CASE WHEN att THEN '' ELSE line END")},
c_m AS (SELECT doc_id, i, count(*) FILTER (WHERE tok = '{{') AS opens, count(*) FILTER (WHERE tok = ';') AS semis FROM c_w GROUP BY doc_id, i),
c_0 AS (SELECT st.doc_id, start, depth AS base FROM st JOIN xs ON xs.doc_id = st.doc_id AND i = start),
c_f AS (SELECT xs.doc_id, xs.i - start AS i, blank, att, intro, depth > base AS deeper, regexp_matches(t, '{_DECLARES}') AS declares, regexp_matches(t, '[,.+\\-*/=(\\[{{\\\\:]$') AS goes_on, coalesce(opens, 0) AS opens, coalesce(semis, 0) AS semis,
  coalesce(lead(NOT blank AND depth > base) OVER (PARTITION BY xs.doc_id ORDER BY xs.i), false) AS deeper_next FROM c_0 JOIN xs USING (doc_id) LEFT JOIN c_m ON c_m.doc_id = xs.doc_id AND c_m.i = xs.i WHERE xs.i >= start AND xs.i < start + {N.DECLARATION_LINES}),
c_r(doc_id, i, seen, e, state) AS (SELECT doc_id, -1::BIGINT, false, -1::BIGINT, 'on' FROM st UNION ALL SELECT r.doc_id, f.i, r.seen OR (NOT blank AND NOT att AND NOT bad AND NOT quits),
    CASE WHEN blank OR bad OR quits AND NOT att THEN r.e WHEN att AND r.seen AND NOT deeper THEN r.e ELSE f.i END,
    CASE WHEN blank THEN CASE WHEN r.seen THEN 'over' ELSE 'on' END WHEN att THEN CASE WHEN r.seen AND NOT deeper THEN 'over' ELSE 'on' END WHEN bad THEN 'failed' WHEN quits THEN 'over' WHEN semis > 0 OR NOT (goes_on OR deeper_next) THEN 'over' ELSE 'on' END
  FROM c_r r JOIN c_f f ON f.doc_id = r.doc_id AND f.i = r.i + 1, LATERAL (SELECT NOT blank AND NOT att AND (intro OR NOT r.seen AND NOT declares OR (declares OR goes_on) AND opens > 0) AS bad, NOT blank AND NOT att AND r.seen AND NOT declares AND NOT goes_on AS quits) WHERE r.state = 'on'),
decl AS (SELECT st.doc_id, CASE WHEN arg_max(state, i) <> 'failed' AND arg_max(e, i) >= 0 THEN any_value(start) + arg_max(e, i) END AS declaration FROM c_r JOIN st USING (doc_id) GROUP BY st.doc_id)"""


@query(f"WITH {_CODE}, {_BRACE} SELECT doc_id, start::BIGINT AS anchor, brace::BIGINT AS end_ln FROM st LEFT JOIN brace USING (doc_id)")
def brace_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_brace_end(_code(spark, sf_dir), "end_ln").select("doc_id", F.col("start").alias("anchor"), F.col("end_ln").cast("long").alias("end_ln"))


@query(f"WITH {_CODE}, {_INDENT} SELECT doc_id, start::BIGINT AS anchor, indent::BIGINT AS end_ln FROM st LEFT JOIN ind USING (doc_id)")
def indent_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_indent_end(_code(spark, sf_dir), "end_ln").select("doc_id", F.col("start").alias("anchor"), F.col("end_ln").cast("long").alias("end_ln"))


@query(f"WITH RECURSIVE {_CODE}, {_DECLARATION} SELECT doc_id, start::BIGINT AS anchor, declaration::BIGINT AS end_ln FROM st LEFT JOIN decl USING (doc_id)")
def declaration_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_declaration_end(_code(spark, sf_dir), "end_ln").select("doc_id", F.col("start").alias("anchor"), F.col("end_ln").cast("long").alias("end_ln"))


@query(f"""WITH RECURSIVE {_CODE}, {_BRACE}, {_INDENT}, {_DECLARATION},
e AS (SELECT st.*, unnest([1, 2, 3]) AS k, unnest(['brace', 'indent', 'declaration']) AS method, unnest([brace::BIGINT, indent::BIGINT, declaration::BIGINT]) AS last FROM st LEFT JOIN brace USING (doc_id) LEFT JOIN ind USING (doc_id) LEFT JOIN decl USING (doc_id)),
u AS (SELECT e.doc_id, min_by(method, k) AS method, min_by(last, k) AS last FROM e WHERE EXISTS (SELECT 1 FROM xs WHERE xs.doc_id = e.doc_id AND i BETWEEN start AND last AND NOT blank AND NOT comment) GROUP BY e.doc_id),
z AS (SELECT doc_id, sum(strlen(line) + 1) - 1 AS size FROM xs GROUP BY doc_id),
p AS (SELECT st.doc_id, coalesce(method, 'window') AS method, method IS NULL AND n <= {N.SMALL_LINES} AND size <= {N.SMALL_BYTES} AS full_file, last, n, spot, start FROM st JOIN z USING (doc_id) LEFT JOIN u USING (doc_id)),
q AS (SELECT doc_id, method, full_file, CASE WHEN method <> 'window' THEN start WHEN full_file THEN 0 ELSE greatest(spot - {N.LINES_BEFORE}, 0) END AS first_line, CASE WHEN method <> 'window' THEN last WHEN full_file THEN n - 1 ELSE least(spot + {N.LINES_AFTER}, n - 1) END AS last_line FROM p)
SELECT doc_id, method, full_file, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, string_agg(line, chr(10) ORDER BY i) || CASE WHEN full_file THEN '' ELSE chr(10) END AS content FROM q JOIN xs USING (doc_id) WHERE i BETWEEN first_line AND last_line GROUP BY doc_id, method, full_file, first_line, last_line""")
def span_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first useful span of braces, body and declaration, else the lines around the anchor or the whole of a small file."""
    return S.cascade(_code(spark, sf_dir)).select("doc_id", "method", "full_file", "first_line", "last_line", "content")
