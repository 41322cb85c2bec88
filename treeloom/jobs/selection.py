"""Queries of the selector language: parsing, resolving, anchoring, spans and prompt budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import names as N
from treeloom.jobs.mapping import FILES
from treeloom.operators import selectors as S
from treeloom.operators.review import trimmed
from treeloom.sources.corpus import DIR_SQL, NAME_SQL, files, skipping, table

QUERIES, ORACLE = {}, {}

_PATH_SQL = f"(CASE WHEN {DIR_SQL} = '' THEN {NAME_SQL} ELSE concat({DIR_SQL}, '/', {NAME_SQL}) END)".replace("doc_id", "(conv_id * 3 + turn)").replace("source", "'src1'").replace("lang", "'en'")
#: A selector line for each turn: FILE, PREFIX, NEAR, malformed or plain prose.
_LINE_SQL = (
    f"CASE turn % 5 WHEN 0 THEN concat('FILE: ', {_PATH_SQL}) WHEN 1 THEN concat('prefix:', {_PATH_SQL}, ' # ', substring(text, 1, 12), ' ') "
    f"WHEN 2 THEN concat('Near: ', {_PATH_SQL}, '#', substring(text, 5, 6)) WHEN 3 THEN concat('PREFIX: ', {_PATH_SQL}) ELSE concat('FILE :', substring(text, 1, 20)) END"
)


def selector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_id, seq, role, line) of ``conversations``."""
    turns = table(spark, sf_dir, "conversations")
    # A generator keeps the long expression in one place, where filters would repeat it in generated code.
    return turns.select(F.col("conv_id").alias("req_id"), F.col("turn").alias("seq"), "role", F.explode(F.array(F.expr(skipping(_LINE_SQL)))).alias("line"))


_LINES = f"sel AS (SELECT conv_id AS req_id, turn AS seq, role, {_LINE_SQL} AS line FROM conversations)"
_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_RE = "(?i)^(FILE|PREFIX|NEAR):([^#]*)(?:#(.*))?$"
_PARSED = rf"""{_LINES}, raw AS (SELECT *, upper(regexp_extract(line, '{_RE}', 1)) AS type, {_TRIM.format(f"regexp_extract(line, '{_RE}', 2)")} AS sel_path, {_TRIM.format(f"regexp_extract(line, '{_RE}', 3)")} AS pattern FROM sel),
parsed AS (SELECT *, CASE WHEN {_TRIM.format("line")} = '' THEN 'blank' WHEN type = '' THEN 'not_a_selector' WHEN sel_path = '' THEN 'no_path' WHEN type <> 'FILE' AND pattern = '' THEN 'no_pattern' ELSE 'ok' END AS code FROM raw)"""


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLE[job.__name__] = sql
        return job

    return add


@query(f"WITH {_PARSED} SELECT req_id, seq, type, sel_path, pattern, code FROM parsed")
def parse_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse(selector_lines(spark, sf_dir)).select("req_id", "seq", "type", "sel_path", "pattern", "code")


@query(f"WITH {_PARSED} SELECT req_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE code = 'ok')::BIGINT AS n_ok, bool_and(code IN ('ok', 'blank')) AS accepted FROM parsed WHERE role <> 'system' GROUP BY req_id")
def strict_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = S.parse(selector_lines(spark, sf_dir).where("role <> 'system'"))
    return parsed.groupBy("req_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("code") == "ok").alias("n_ok"), F.bool_and(F.col("code").isin("ok", "blank")).alias("accepted"))


_EMBEDDED_LINE = "concat(text, ' FILE: ', source, '/a.go, and file:', lang, '/b.py); xFILE:no', CASE WHEN doc_id % 2 = 0 THEN ' (FILE:c.ts]' ELSE '' END)"


def _embedded_sql(line: str) -> str:
    return rf"""WITH l AS (SELECT doc_id, {line} AS line FROM documents), m AS (SELECT doc_id, regexp_replace(line, '(?i)(^|[^\pL\p{{Nd}}_])FILE:', '\1' || chr(1), 'g') AS line FROM l),
p AS (SELECT doc_id, list_filter(list_transform(string_split(line, chr(1))[2:], lambda x: regexp_replace(regexp_replace(x, '^[ \t]+', ''), '[ \t\r\n.,;:)\]}}]+$', '')), lambda x: x <> '') AS paths, len(string_split(line, chr(1))) AS n FROM m)
SELECT doc_id, pos::BIGINT - 1 AS pos, paths[pos] AS sel_path FROM (SELECT doc_id, paths, unnest(range(1, len(paths) + 1)) AS pos FROM p WHERE n >= 3)""".replace("([^\\pL", "([^\\pL")


def _embedded(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    return S.embedded(table(spark, sf_dir, "documents").select("doc_id", F.expr(line).alias("line"))).select("doc_id", "pos", "sel_path")


@query(_embedded_sql(_EMBEDDED_LINE))
def embedded_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir, _EMBEDDED_LINE)


@query(f"WITH {FILES}, {_PARSED} SELECT req_id, seq, sel_path, sel_path IN (SELECT path FROM files) AS found FROM parsed WHERE code = 'ok'")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = S.parse(selector_lines(spark, sf_dir)).where("code = 'ok'")
    return S.resolve_exact(ok, files(spark, sf_dir)).select("req_id", "seq", "sel_path", "found")


@query(f"""WITH {FILES}, {_PARSED}, b AS (SELECT name, min(path) AS first FROM files GROUP BY name)
SELECT req_id, seq, sel_path, CASE WHEN sel_path IN (SELECT path FROM files) THEN sel_path ELSE b.first END AS resolved FROM parsed LEFT JOIN b ON b.name = string_split(sel_path, '/')[-1] WHERE code = 'ok'""")
def resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = S.parse(selector_lines(spark, sf_dir)).where("code = 'ok'")
    return S.resolve_fuzzy(ok, files(spark, sf_dir)).select("req_id", "seq", "sel_path", "resolved")


@query(f"""WITH {FILES}, {_PARSED}, r AS (SELECT DISTINCT string_split(sel_path, '/')[-1] AS request FROM parsed WHERE code = 'ok'), p AS (SELECT DISTINCT path FROM files),
h AS (SELECT request, count(path) AS n, min(path) AS first FROM r LEFT JOIN p ON path = request OR ends_with(path, '/' || request) GROUP BY request)
SELECT request, n::BIGINT AS n, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN first END AS path FROM h""")
def resolve_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = S.parse(selector_lines(spark, sf_dir)).where("code = 'ok'")
    return S.resolve_suffix(ok.select(F.element_at(F.split("sel_path", "/"), -1).alias("sel_path")), files(spark, sf_dir))


@query(f"""WITH {_PARSED}, g AS (SELECT req_id // 4 AS req_id, req_id % 4 * 100 + seq AS seq, type, string_split(sel_path, '/')[1] AS sel_path, pattern FROM parsed WHERE code = 'ok'),
m AS (SELECT *, bool_or(type = 'FILE') OVER (PARTITION BY req_id, sel_path) AS whole FROM g)
SELECT req_id, seq, type, sel_path, pattern FROM (SELECT *, row_number() OVER (PARTITION BY req_id, sel_path, type, CASE WHEN type = 'FILE' THEN '' ELSE pattern END ORDER BY seq) AS r FROM m WHERE type = 'FILE' OR NOT whole) WHERE r = 1""")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = S.parse(selector_lines(spark, sf_dir)).where("code = 'ok'")
    grouped = ok.select(F.expr("req_id div 4").alias("req_id"), F.expr("req_id % 4 * 100 + seq").alias("seq"), "type", F.split("sel_path", "/")[0].alias("sel_path"), "pattern")
    return S.supersede(grouped).select("req_id", "seq", "type", "sel_path", "pattern")


def _trim_sql(limit: int) -> str:
    half = limit // 2
    head = ", ".join(f"try(decode(data[1:{half - i}]))" for i in range(4))
    tail = ", ".join(f"try(decode(data[size - {half} + {1 + i}:size]))" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, text, encode(text) AS data, strlen(text) AS size FROM documents), h AS (SELECT *, coalesce({head}) AS head, coalesce({tail}) AS tail FROM d)
SELECT doc_id, CASE WHEN size <= {limit} THEN text ELSE head || chr(10) || '... [cut ' || (size - strlen(head) - strlen(tail)) || ' bytes] ...' || chr(10) || tail END AS content FROM h"""


@query(_trim_sql(N.FILE_BYTES))
def trim_content(spark: SparkSession, sf_dir: str, limit: int = N.FILE_BYTES) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", trimmed("text", limit).alias("content"))


def _prompt_sql(limit: int, trim: int) -> str:
    return f"""WITH s AS (SELECT source, doc_id, least(strlen(text), {trim}) + 40 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY doc_id) + 100 + length(k::VARCHAR) AS total FROM s), m AS (SELECT source, max(k) AS keep FROM u WHERE total <= {limit} GROUP BY source)
SELECT source, doc_id, k::BIGINT AS k, total::BIGINT AS total FROM u JOIN m USING (source) WHERE k <= keep"""


@query(_prompt_sql(N.PROMPT_BYTES, N.FILE_BYTES))
def prompt_budget(spark: SparkSession, sf_dir: str, limit: int = N.PROMPT_BYTES, trim: int = N.FILE_BYTES) -> DataFrame:
    """As many documents of a source as fit, the header holding their number; size(k) is explicit, so no re-rendering."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", (F.least(F.octet_length("text"), F.lit(trim)) + 40).alias("size"))
    # A document takes 40 bytes at least: what stands later can't fit, and is dropped before the shuffle.
    docs = docs.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("nth") <= limit // 40 + 1)
    order = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = docs.withColumn("k", F.count("*").over(order)).withColumn("total", F.sum("size").over(order) + 100 + F.length(F.col("k").cast("string")))
    keep = F.max(F.when(F.col("total") <= limit, F.col("k"))).over(Window.partitionBy("source"))
    return ranked.withColumn("keep", keep).where("k <= keep").select("source", "doc_id", "k", F.col("total").cast("long").alias("total"))
