"""Queries on paths, roots, small formats and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import classify as C
from treeloom.functions import names as N
from treeloom.jobs import mapping as M
from treeloom.operators import paths as P
from treeloom.operators.ranking import top_k
from treeloom.sources.corpus import files, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(job):
        QUERIES[job.__name__], ORACLE[job.__name__] = job, sql
        return job

    return add


@query(f"WITH {M.FILES} SELECT doc_id, path AS cleaned FROM files")
def path_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy spellings of every path clean up to the path."""
    messy = F.expr("concat('./', dir, '//x/y/../../', case when doc_id % 2 = 0 then './' else '' end, name, case when doc_id % 3 = 0 then '/' else '' end)")
    return files(spark, sf_dir).select("doc_id", P.clean(messy).alias("cleaned"))


@query(f"WITH {M.FILES} SELECT doc_id, path, (path = 'src/src1' OR starts_with(path, 'src/src1/')) AS inside FROM files")
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", P.is_within(F.col("path"), F.lit("src/src1")).alias("inside"))


_ROOTS = "SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN concat('src/', source) ELSE concat('src/', source, '/', lang) END AS dir FROM documents WHERE doc_id % 9 <> 5 OR source = 'src3'"


@query(f"WITH r AS ({_ROOTS}) SELECT dir FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE starts_with(r.dir, s.dir || '/'))")
def root_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("treeloom_documents")
    return P.uncovered(spark.sql(_ROOTS.replace("FROM documents", "FROM treeloom_documents")))


@query(f"WITH {M.FILES}, x AS (SELECT DISTINCT 'src/' || source AS root FROM documents WHERE source < 'src12'), b AS (SELECT DISTINCT path FROM files, x WHERE path = root OR starts_with(path, root || '/')) SELECT doc_id, path, path IN (SELECT path FROM b) AS rejected FROM files")
def external_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned writes that fall inside roots outside the project."""
    rows = files(spark, sf_dir).select("doc_id", "path")
    roots = table(spark, sf_dir, "documents").where("source < 'src12'").select(F.concat(F.lit("src/"), "source").alias("root")).distinct()
    bad = P.below_any(rows.select("path").distinct(), roots).withColumn("bad", F.lit(True))
    return rows.join(bad, "path", "left").select("doc_id", "path", F.coalesce("bad", F.lit(False)).alias("rejected"))


@query(f"""WITH {M.FILES}, p AS (SELECT DISTINCT regexp_replace(dir, '/[^/]*$', '') AS parent FROM files WHERE dir LIKE 'src/%'), d AS (SELECT DISTINCT dir FROM files WHERE name = 'package.json' AND contains(dir, '/'))
SELECT parent || '/*' AS pattern, dir FROM p JOIN d ON regexp_replace(dir, '/[^/]*$', '') = parent""")
def workspace_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parent/*`` patterns to the directories right below that hold a manifest: an equi-join on the parent."""
    rows, up = files(spark, sf_dir), F.regexp_replace("dir", "/[^/]*$", "")
    patterns = rows.where(F.col("dir").startswith("src/")).select(F.concat(up, F.lit("/*")).alias("pattern")).distinct()
    holders = rows.where((F.col("name") == "package.json") & F.col("dir").contains("/")).select("dir", F.concat(up, F.lit("/*")).alias("pattern")).distinct()
    return patterns.join(holders, "pattern").select("pattern", "dir")


@query(f"""WITH {M.FILES}, c AS (SELECT DISTINCT string_split(path, '/')[1] AS root, string_split(path, '/')[2] AS child, len(string_split(path, '/')) > 2 AS is_dir FROM files WHERE contains(path, '/') AND NOT {M._OMITTED})
SELECT root, child, is_dir, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY is_dir, child) AS r FROM c) WHERE r <= 8""")
def summarize_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct children of each root: files, then directories, eight at most."""
    parts = F.split("path", "/")
    children = files(spark, sf_dir).where(F.col("path").contains("/") & ~C.is_omitted()).select(parts[0].alias("root"), parts[1].alias("child"), (F.size(parts) > 2).alias("is_dir")).distinct()
    return top_k(children, ["root"], [F.asc("is_dir"), F.asc("child")], 8).select("root", "child", "is_dir", "rank")


def _scan_sql(limit: int) -> str:
    return f"WITH {M.FILES} SELECT path, doc_id FROM files ORDER BY string_split(path, '/'), doc_id LIMIT {limit}"


@query(_scan_sql(N.SCAN_FILES))
def scan_cap(spark: SparkSession, sf_dir: str, limit: int = N.SCAN_FILES) -> DataFrame:
    """The first files in walk order, which compares segment by segment (the limit is the feature)."""
    return files(spark, sf_dir).orderBy(F.split("path", "/"), "doc_id").limit(limit).select("path", "doc_id")


_ROLE_DIR = "concat(CASE doc_id % 6 WHEN 0 THEN 'cmd' WHEN 1 THEN 'internal' WHEN 2 THEN 'pkg' WHEN 3 THEN 'Tests' WHEN 4 THEN 'docs' ELSE 'lib' END, '/', source)"


@query(f"SELECT role, count(*)::BIGINT AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'Commands' WHEN 1 THEN 'Internal' WHEN 2 THEN 'Packages' WHEN 3 THEN 'Tests' WHEN 4 THEN 'Documentation' ELSE 'Sources' END AS role FROM documents) GROUP BY role")
def source_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = table(spark, sf_dir, "documents").select(F.expr(_ROLE_DIR).alias("dir"))
    return dirs.groupBy(P.source_role().alias("role")).agg(F.count("*").alias("n"))


_SCRIPT = "concat('node --flag A=', source, ' ./scripts/', lang, '.js \"lib/', source, '.ts\" && rm -rf ', lang)"


@query("SELECT doc_id, './scripts/' || lang || '.js,lib/' || source || '.ts' AS paths FROM documents")
def script_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_SCRIPT).alias("s")).select("doc_id", F.array_join(P.script_paths("s"), ",").alias("paths"))


_STATUS = "CASE doc_id % 5 WHEN 0 THEN concat('R100', chr(1), 'old/', source, chr(1), 'new/', lang) WHEN 1 THEN concat('A', chr(1), source) WHEN 2 THEN concat('D', chr(1), source) ELSE concat('M', chr(1), source) END"


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'renamed' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'modified' END AS change, CASE WHEN doc_id % 5 = 0 THEN 'new/' || lang ELSE source END AS path, CASE WHEN doc_id % 5 = 0 THEN 'old/' || source ELSE '' END AS previous_path FROM documents")
def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from delimited status records; renames carry the path before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(F.expr(_STATUS), "\x01").alias("f"))
    letter = F.substring(F.col("f")[0], 1, 1)
    change = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
    renamed = letter == "R"
    return rows.select("doc_id", change.alias("change"), F.when(renamed, F.get("f", F.lit(2))).otherwise(F.col("f")[1]).alias("path"), F.when(renamed, F.col("f")[1]).otherwise("").alias("previous_path"))


@query("SELECT doc_id, regexp_replace(text, '(?i)the', '<repository>', 'g') AS text FROM documents")
def redact_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "(?i)\\Qthe\\E", "<repository>").alias("text"))


@query("SELECT doc_id, strlen(text) > 16384 OR len(string_split(text, chr(10))) > 40 AS large_paste, strlen(text) > 131072 AS large_prompt FROM documents")
def size_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", ((size > 16384) | (F.size(F.split("text", "\n")) > 40)).alias("large_paste"), (size > 131072).alias("large_prompt"))


@query("SELECT o_orderkey, try_cast(CASE WHEN regexp_matches(p, '^[0-9]+$') THEN p END AS BIGINT) AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN substring(o_orderpriority, 1, 1) ELSE o_orderpriority END AS p FROM orders)")
def strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.substring("o_orderpriority", 1, 1)).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).alias("value"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[^\p{L}\p{N}/.\-_~+]') OR regexp_matches(url, '[.,;:)\]}]$') THEN '"' || replace(replace(url, '\', '\\'), '"', '\"') || '"' ELSE url END AS quoted FROM pages""")
def quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.quoted(F.col("url")).alias("quoted"))


@query(f"WITH {M.FILES} SELECT doc_id, 'Binary file: ' || path || chr(10) || 'Kind: ' || {M._KIND} || chr(10) || 'Size: ' || CASE WHEN size < 1024 THEN size || 'B' ELSE (size // 1024) || 'KB' END AS summary FROM files WHERE {M._KIND} <> 'source'")
def asset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("kind", C.kind()).where("kind <> 'source'")
    return rows.select("doc_id", F.concat_ws("\n", F.concat(F.lit("Binary file: "), "path"), F.concat(F.lit("Kind: "), "kind"), F.concat(F.lit("Size: "), C.size_label())).alias("summary"))


def _limit_label(limit: int) -> str:
    return f"{limit // 1024} KiB" if limit % 1024 == 0 else f"{limit} bytes"


@query(f"""WITH {M.FILES}, s AS (SELECT doc_id, CASE WHEN {M._KIND} = 'binary' THEN 'binary' WHEN {M._SENSITIVE} THEN 'sensitive' WHEN size > {N.REVIEW_FILE_BYTES} THEN 'oversized' ELSE 'included' END AS status FROM files)
SELECT doc_id, status, CASE status WHEN 'binary' THEN 'binary content' WHEN 'sensitive' THEN 'sensitive path' WHEN 'oversized' THEN 'over {_limit_label(N.REVIEW_FILE_BYTES)}' END AS reason FROM s""")
def status_reasons(spark: SparkSession, sf_dir: str, limit: int = N.REVIEW_FILE_BYTES) -> DataFrame:
    """What a review shows of each file and why; files of more than ``limit`` bytes are oversized, and the reason names the limit."""
    status = F.when(C.kind() == "binary", "binary").when(C.is_sensitive(), "sensitive").when(F.col("size") > limit, "oversized").otherwise("included")
    rows = files(spark, sf_dir).select("doc_id", status.alias("status"))
    return rows.select("doc_id", "status", F.when(F.col("status") == "binary", "binary content").when(F.col("status") == "sensitive", "sensitive path").when(F.col("status") == "oversized", f"over {_limit_label(limit)}").alias("reason"))


_WORK = "concat('go 1.2', chr(10), 'use (', chr(10), chr(9), './', source, chr(10), chr(9), './', lang, ' // note', chr(10), ')', chr(10), 'use ./tail')"


@query("SELECT doc_id, source || ',' || lang || ',tail' AS members FROM documents")
def workspace_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a workspace file's ``use`` lines, single or in a block, without comments."""
    found = F.regexp_extract_all(F.expr(_WORK), F.lit(r"(?m)^(?:use )?\s*[.]/([^\s]+)"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("members"))


def _handoffs(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    mode = F.expr("case turn % 3 when 0 then 'review' when 1 then 'design' else 'other' end")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("--- Handoff: "), mode, F.lit(" ---\n"), text).alias("h"))
    pattern = r"(?s)^--- Handoff: (review|design|handoff) ---\n(.*)$"
    fits = F.col("h").rlike(pattern)
    return rows.select("conv_id", "turn", F.when(fits, F.regexp_extract("h", pattern, 1)).alias("mode"), F.when(fits, F.regexp_extract("h", pattern, 2)).alias("body"))


_HANDOFF = """WITH t AS (SELECT conv_id, turn, '--- Handoff: ' || CASE turn % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'design' ELSE 'other' END || ' ---' || chr(10) || {0} AS h FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'design' END AS mode, CASE WHEN turn % 3 < 2 THEN substring(h, strpos(h, chr(10)) + 1) END AS body FROM t"""


@query(_HANDOFF.format("text"))
def handoff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and body of framed hand-overs; unknown modes give nulls."""
    return _handoffs(spark, sf_dir, F.col("text"))
