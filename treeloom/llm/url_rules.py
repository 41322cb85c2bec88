"""URL filtering by rules given and rules mined (operator 4): DataFrame and SQL functions only.

A given rule (host suffix and path prefix) decides where one fits; the longest wins.  Other URLs get the verdict of
association rules: FP-growth mines token combinations of labelled URLs together with the label, rules "these tokens, so bad" are pruned by support,
confidence and lift and where a part of their tokens is as sure, and an inverted index on each rule's rarest token matches them.
Tokens that stand in the very same labelled URLs are mined as one (closed sets), so a template's constant parts don't multiply.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.storage import saved, table

# The given rules as (host suffix, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A combination counts from this share of the labelled URLs on, and from this many; a rule blocks from this confidence on,
#: if the lower end of the confidence's 95 % interval (Wilson's) is LIFT times the share of bad URLs at least.
SUPPORT, LEAST_COUNT, CONFIDENCE, LIFT, Z = 0.002, 5, 0.6, 1.2, 1.96
#: Bytes of token sets that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host, path and tail (what follows the path) of ``url``; empty where it is null or has no ``://``."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    raw = F.regexp_extract(F.col("rest"), "^[^/?#]*", 0)
    return (
        urls.withColumn("rest", rest)
        .withColumn("host", raw)
        .withColumn("rest", F.expr("substring(rest, length(host) + 1)"))
        .withColumn("host", F.translate("host", _UPPER, _LOWER))
        .withColumn("path", F.regexp_extract("rest", "^[^?#]*", 0))
        .withColumn("tail", F.expr("substring(rest, length(path) + 1)"))
        .drop("rest")
    )


def tokens() -> Column:
    """Distinct, sorted tokens of host, path and tail: host labels, path words with digits as one sign, query keys, the fragment."""
    host = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.split(F.regexp_replace("path", "[0-9]+", "#"), r"[/.]"), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.split(F.regexp_extract("tail", r"^\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    fragment = F.array(F.concat(F.lit("f:"), F.regexp_extract("tail", "#(.*)$", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(host, path, query, fragment), lambda x: F.length(x) > 2)))


def given_rule() -> tuple[Column, Column]:
    """(rule, verdict) by RULES for host and path; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, prefix, says in sorted(RULES, key=lambda r: len(r[0]) + len(r[1])):  # the longest comes last and stays
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, host + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _lower_end(bad: str, seen: str) -> str:
    """SQL of the lower end of Wilson's interval for bad / seen."""
    p = f"(CAST({bad} AS DOUBLE) / {seen})"
    return f"(({p} + {Z * Z / 2} / {seen} - {Z} * sqrt(({p} * (1 - {p}) + {Z * Z / 4} / {seen}) / {seen})) / (1 + {Z * Z} / {seen}))"


def token_groups(labelled: DataFrame, least: int) -> DataFrame:
    """(token, members): tokens of ``labelled`` (id, tokens) that stand in ``least`` rows at least, one for each group that stands in the very same rows."""
    own = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("id").alias("mark"))
    # Count and two sums of the rows' marks tell sets of rows apart.
    kinds = own.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("mark").alias("x"), F.sum(F.expr("mark div 65536")).alias("y")).where(F.col("n") >= least)
    return kinds.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("members")).select("token", "members")


def mine_rules(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, seen, bad) of the pruned rules from ``labelled`` (tokens: distinct, bad: boolean).

    A rule's tokens, with those that always come along, are seen in ``seen`` URLs and ``bad`` of these are bad.  Rows without tokens or label are left out; without enough rows there are no rules.
    """
    known = saved(labelled.where("size(tokens) > 0 and bad is not null").select(F.monotonically_increasing_id().alias("id"), "tokens", "bad"), "labelled")
    n, n_bad = known.agg(F.count("*"), F.count_if("bad")).first()
    count = max(least, -(-int(n * support * 1_000_000) // 1_000_000), 1)
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, seen long, bad long")
    if n < count:
        return empty
    groups = saved(token_groups(known, count), "token-groups")
    kept = known.select("id", F.explode("tokens").alias("token")).join(groups.select("token"), "token", "left_semi").groupBy("id").agg(F.collect_list("token").alias("items"))
    baskets = known.select("id", "bad").join(kept, "id").select(F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items"))
    baskets = saved(baskets, "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (count - 0.5) / max(baskets.count(), 1)), minConfidence=0.0).fit(baskets)
    sets = saved(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("bad"))
    alone = sets.where(~F.array_contains("items", BAD)).select(F.col("items").alias("tokens"), F.col("freq").alias("seen"))
    sure = F.expr(f"{_lower_end('bad', 'seen')} >= {LIFT * n_bad / n!r}")
    rules = saved(with_bad.join(alone, "tokens").where((F.col("bad") >= confidence * F.col("seen")) & sure), "rules")
    # A longer rule goes where leaving out one of its tokens leaves a rule that is as sure.
    parts = rules.select("tokens", "seen", "bad", F.explode("tokens").alias("token")).select("tokens", "seen", "bad", F.array_remove("tokens", F.col("token")).alias("part"))
    short = rules.select(F.col("tokens").alias("part"), F.col("seen").alias("part_seen"), F.col("bad").alias("part_bad"))
    needless = parts.join(short, "part").where("part_bad * seen >= bad * part_seen").select("tokens").distinct()
    pruned = rules.join(needless, "tokens", "left_anti").select("tokens", "seen", "bad", F.explode("tokens").alias("token")).join(groups, "token")
    whole = pruned.groupBy("tokens", "seen", "bad").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("all"))
    return saved(whole.select(F.col("all").alias("tokens"), "seen", "bad"), "pruned-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, n_rules, bad, seen) of each distinct set of ``urls`` (tokens) that a rule matches; bad of seen is the surest rule's."""
    distinct = saved(urls.select("tokens").distinct(), "token-sets")
    common = distinct.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keyed = rules.select("tokens", "seen", "bad", F.explode("tokens").alias("token")).join(common, "token")
    rarest = keyed.groupBy("tokens", "seen", "bad").agg(F.min(F.struct("n", "token")).alias("key"))
    index = rarest.select(F.col("key.token").alias("token"), F.col("tokens").alias("rule_tokens"), "seen", "bad")
    posted = distinct.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    surest = F.max(F.struct((F.col("bad") / F.col("seen")).alias("confidence"), F.col("seen").alias("seen"), F.col("bad").alias("bad")))
    return posted.groupBy("tokens").agg(F.count("*").alias("n_rules"), surest.alias("best")).select("tokens", "n_rules", "best.bad", "best.seen")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_rules, rule_bad, rule_seen) of each row of ``pages`` (page_id, url).

    labels (doc_id, quality, toxic) covers some pages by id: bad is quality 0 or toxic 1; an id's repeated labels count
    once, bad if any says so.  URLs that no rule fits are allowed, null, empty and malformed ones too.  Repeated rows
    and null ids are judged each; an empty table gives no rows.
    """
    parts = with_parts(pages.select("page_id", "url")).withColumn("tokens", tokens())
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 0, false) or coalesce(toxic = 1, false)")).alias("bad"))
    rules = mine_rules(parts.join(bad, parts.page_id == bad.doc_id).select("tokens", "bad"))
    found = saved(matches(parts, rules), "matches")
    # A row's bytes: its tokens, a word for each, and its fields.
    size = found.agg(F.sum(F.octet_length(F.array_join("tokens", "")) + 16 * F.size("tokens") + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    rule, verdict = given_rule()
    mined = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return parts.join(found, "tokens", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.col("bad").cast("long").alias("rule_bad"), F.col("seen").cast("long").alias("rule_seen"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_url_rules over the whole of ``pages``."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    pick = lambda k: " ".join(f"WHEN {fits(r[0], r[1])} THEN '{r[0] + r[1] if k == 0 else r[2]}'" for r in ordered)
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT r, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, substr(rest, length(raw) + 1) AS more FROM b),
d AS (SELECT r, page_id, host, path, substr(more, length(path) + 1) AS tail FROM c),
e AS (SELECT r, page_id, host, path, list_sort(list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
    list_transform(string_split_regex(regexp_replace(path, '[0-9]+', '#', 'g'), '[/.]'), lambda x: 'p:' || x),
    list_transform(string_split(regexp_extract(tail, '^\?([^#]*)', 1), '&'), lambda x: 'q:' || string_split(x, '=')[1]), ['f:' || regexp_extract(tail, '#(.*)$', 1)]), lambda x: length(x) > 2))) AS t FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m0 AS (SELECT r, t, bad FROM e JOIN l ON page_id = doc_id WHERE len(t) > 0),
k AS (SELECT greatest({LEAST_COUNT}, ceil(count(*) * {SUPPORT}::DECIMAL(9, 6))) AS least, count(*) FILTER (WHERE bad) AS n_bad, count(*) AS n FROM m0),
v AS (SELECT w, list(r ORDER BY r) AS rs FROM (SELECT r, unnest(t) AS w FROM m0) GROUP BY w),
y AS (SELECT min(w) AS w, list(w ORDER BY w) AS members FROM v, k WHERE len(rs) >= least GROUP BY rs),
m AS (SELECT list(w ORDER BY w) AS t, any_value(bad) AS bad FROM (SELECT r, unnest(t) AS w, bad FROM m0) JOIN y USING (w) GROUP BY r),
s AS (SELECT list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS tokens, bad FROM (SELECT t, bad, unnest(range(1, (1 << len(t))::BIGINT)) AS mask FROM m)),
f AS (SELECT tokens, count(*) AS seen, count(*) FILTER (WHERE bad) AS bad FROM s GROUP BY tokens),
g AS (SELECT tokens, seen, bad FROM f, k WHERE bad >= least AND bad >= {CONFIDENCE}::DECIMAL(3, 2) * seen AND {_lower_end('bad', 'seen')} >= {LIFT}::DOUBLE * n_bad / n),
u0 AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE len(h.tokens) = len(g.tokens) - 1 AND list_has_all(g.tokens, h.tokens) AND h.bad * g.seen >= g.bad * h.seen)),
u AS (SELECT seen, bad, list(w ORDER BY w) AS tokens FROM (SELECT seen, bad, key, unnest(members) AS w FROM (SELECT seen, bad, tokens AS key, unnest(tokens) AS w FROM u0) JOIN y USING (w)) GROUP BY key, seen, bad),
x AS (SELECT r, count(*) AS n_rules, max(struct_pack(c := u.bad / u.seen, s := u.seen, b := u.bad)) AS best FROM e JOIN u ON list_has_all(e.t, u.tokens) GROUP BY r)
SELECT page_id, host, path, CASE {pick(0)} END AS rule, CASE {pick(1)} WHEN n_rules > 0 THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n_rules, 0)::BIGINT AS n_rules, best.b::BIGINT AS rule_bad, best.s::BIGINT AS rule_seen
FROM e LEFT JOIN x USING (r)
"""


ORACLE_SQL = _oracle()
