"""Quality rules with adaptive thresholds (operator 2).

Every document is measured once.  For each language and source, each measure has a mergeable quantile sketch: counts in
log-linear bins (exact up to 63, then within 1/32), kept as rows.  Sketches of sparse groups are merged with
those of their language, or of all documents.  Quantiles of a group's upper half give its upper limits and those of the
lower half the lower limit of word length; the measures joined with the limits give the verdict.  All arithmetic is on integers, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from treeloom.llm.resident import vacate
from treeloom.llm.storage import columns, saved, table
from treeloom.llm.words import chunks, hash_words, shingle_keys

WINDOW = 5
#: Measure -> the least spread that it is given; rates are per 1000, word length in thousandths of a letter.
MEASURES = {"symbol_rate": 5, "upper_rate": 25, "dup_line_rate": 100, "repeat_rate": 45, "word_length": 200}
#: Measures that also have a lower limit.
LOW = ("word_length",)
#: A value is an outlier beyond the 75th percentile + REACH spreads.  The spread is the 90th percentile less the median, but the
#: least one at least, and WIDE times the 75th's distance from the median (or the least spread) at most: a tenth of junk can't lift it freely.
#: Lower limits mirror that with the 25th and 10th percentile.
REACH, WIDE = 4, 3
#: Limits of at most this many groups are broadcast.
FEW_GROUPS, SALTS = 100_000, 32
#: Sketches of fewer documents are merged with the next wider group's.
LEAST_DOCS = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#[*$%&|<>]")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _in_spans(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[ends] - sums[starts]


def measure_texts(texts: list[bytes]) -> list[np.ndarray]:
    """The counts of _COUNTS for each text."""
    words = hash_words(texts)
    n, count = len(texts), words.counts()
    keys, bounds = shingle_keys(words, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(k), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    at = words.first[owner[at]] + at - bounds[owner[at]]  # windows to words
    cover = np.zeros(len(words.keys) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    lead = (words.buffer & 0xC0) != 0x80
    text_end = np.cumsum([len(t) + 1 for t in texts]) if n else np.zeros(0, dtype=np.int64)
    text_start = np.concatenate([[0], text_end[:-1]]) if n else text_end
    per_word = np.concatenate([[0], np.cumsum(_in_spans(lead, words.starts, words.ends))])
    lines, repeats = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        real = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines[i], repeats[i] = len(real), len(real) - len(set(real))
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    spread = lambda sums: sums[words.first[1:]] - sums[words.first[:-1]]
    return [count, spread(per_word), _in_spans(_SYMBOL[words.buffer], text_start, text_end), repeats, spread(covered), lines, _in_spans(_UPPER[words.buffer], text_start, text_end)]


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and its counts; names in ``docs`` can't clash with the counts'."""
    packed = docs.select(F.struct(*columns(docs)).alias("row"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for at, texts in chunks(s.as_py() for s in batch.column(1)):
                counts = [pa.array(np.asarray(x, dtype=np.int64)) for x in measure_texts(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *counts], ["row", *_COUNTS])

    return packed.mapInArrow(run, StructType([packed.schema["row"], *(StructField(c, LongType()) for c in _COUNTS)]))


def rates(frame: DataFrame) -> DataFrame:
    """Adds the measures of MEASURES and base_failed."""
    per = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return frame.withColumns({
        "symbol_rate": per("n_symbols", "n_words"), "upper_rate": per("n_upper", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"),
        "base_failed": F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"),
    })


def sketch_bin(value: Column) -> Column:
    """Log-linear bin of a count: itself up to 63, then 32 bins for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (32 * shift + F.call_function("shiftright", value, shift)).cast("long")


def bin_value(b: Column) -> Column:
    """The least value of a bin."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - 32 * shift, shift)


def thresholds(frame: DataFrame) -> DataFrame:
    """(lang, source, <measure>_most ...) from lang, source and the measures; null lang or source is a group as ''."""
    stack = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = frame.selectExpr("coalesce(lang, '') as lang", "coalesce(source, '') as source", f"stack({len(MEASURES)}, {stack}) as (measure, value)")
    own = saved(long.groupBy("lang", "source", "measure", sketch_bin(F.col("value")).alias("bin")).agg(F.count("*").alias("n")), "sketches")
    lang = own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    whole = lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    sizes = own.where(f"measure = '{next(iter(MEASURES))}'").groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    lang_sizes = sizes.groupBy("lang").agg(F.sum("docs").alias("lang_docs"))
    level = sizes.join(lang_sizes, "lang").select("lang", "source", F.expr(f"case when docs >= {LEAST_DOCS} then 0 when lang_docs >= {LEAST_DOCS} then 1 else 2 end").alias("level"))
    # Quantiles once for each level's own groups; a group then takes the one row of limits of its level.
    parts = [
        level.where("level = 0").join(_limits(own, ["lang", "source"]), ["lang", "source"]),
        level.where("level = 1").join(_limits(lang, ["lang"]), "lang"),
        level.where("level = 2").join(F.broadcast(_limits(whole, []).withColumn("level", F.lit(2))), "level"),  # one row
    ]
    names = ["lang", "source", *(f"{m}_most" for m in MEASURES), *(f"{m}_least" for m in LOW)]
    return parts[0].select(names).unionByName(parts[1].select(names)).unionByName(parts[2].select(names))


def _limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, <measure>_most ..., <measure>_least ...) from a sketch (keys, measure, bin, n)."""
    group = Window.partitionBy(*keys, "measure")  # the bins of one sketch, some hundred rows
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    quantiles = ranked.groupBy(*keys, "measure").agg(*(bin_value(F.min(F.when(F.expr(f"100 * upto >= {q} * total"), F.col("bin")))).alias(f"q{q}") for q in (10, 25, 50, 75, 90)))
    limits = quantiles.withColumn("floor", F.create_map(*[F.lit(x) for m in MEASURES.items() for x in m])[F.col("measure")]).selectExpr(
        *keys, "measure", f"q75 + {REACH} * greatest(floor, least(q90 - q50, {WIDE} * greatest(q75 - q50, floor))) as most", f"q25 - {REACH} * greatest(floor, least(q50 - q10, {WIDE} * greatest(q50 - q25, floor))) as least"
    )
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
    return limits.groupBy(*keys).agg(*(pick(m, "most") for m in MEASURES), *(pick(m, "least") for m in LOW))


def judged(frame: DataFrame, limits: DataFrame) -> DataFrame:
    """``frame`` (lang, source, counts and rates) with kept.  limits: written already; few rows are broadcast, more are joined by salted keys."""
    few = limits.count() <= FEW_GROUPS
    limits = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    same = (F.coalesce(F.col("lang"), F.lit("")) == F.col("limit_lang")) & (F.coalesce(F.col("source"), F.lit("")) == F.col("limit_source"))
    fits = F.expr(" and ".join([*(f"{m} <= {m}_most" for m in MEASURES), *(f"{m} >= {m}_least" for m in LOW)]))
    if few:
        found = frame.join(F.broadcast(limits), same, "left")
    else:
        frame = frame.withColumn("salt", F.pmod(F.xxhash64(*_COUNTS), F.lit(SALTS)))
        limits = limits.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("limit_salt"))
        found = frame.join(limits, same & (F.col("salt") == F.col("limit_salt")), "left").drop("salt", "limit_salt")
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, rates, thresholds and verdict of each row of ``docs`` (doc_id, text, lang, source).

    A null or empty text has no words and fails the base rule.  Null languages and sources form groups of their own.
    Repeated rows are judged, and counted, each.  An empty table gives no rows.
    """
    flat = rates(measured(docs)).select("row.doc_id", "row.lang", "row.source", *_COUNTS, *MEASURES, "base_failed")
    flat = saved(flat, "measures")
    out = judged(flat, saved(thresholds(flat), "thresholds"))
    return out.select("doc_id", *_COUNTS[:5], "base_failed", "kept", *MEASURES, *[f"{m}_most" for m in MEASURES], *[f"{m}_least" for m in LOW])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns (names of any kind); nulls, repeated rows and empty tables as in quality().

    Texts are measured twice: that costs less than to write them with their measures in between.
    """
    frame = rates(measured(docs))
    limits = saved(thresholds(frame.select("row.lang", "row.source", *MEASURES)), "thresholds")
    flat = frame.select("row", "row.lang", "row.source", *_COUNTS, *MEASURES, "base_failed")
    return judged(flat, limits).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_quality_rules over the whole of ``documents``."""
    return quality(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    bins = "greatest(length(bin(value)) - 6, 0)"
    value = "(({b} - 32 * greatest({b} // 32 - 1, 0)) << greatest({b} // 32 - 1, 0))"
    floor = " ".join(f"WHEN '{m}' THEN {x}" for m, x in MEASURES.items())
    quantiles = (10, 25, 50, 75, 90)
    names = [*(f"{m}_most" for m in MEASURES), *(f"{m}_least" for m in LOW)]
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM d) GROUP BY r),
m AS (SELECT t.r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(x, '[^#\[*$%&|<>\]]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper
  FROM t LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
v AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_upper // greatest(word_chars, 1) AS upper_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 1000 * word_chars // greatest(n_words, 1) AS word_length,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
u AS (SELECT lang, source, measure, 32 * {bins} + (value >> {bins}) AS b FROM (UNPIVOT (SELECT lang, source, {", ".join(f"{m}::BIGINT AS {m}" for m in MEASURES)} FROM v) ON {", ".join(MEASURES)} INTO NAME measure VALUE value)),
k AS (SELECT *, sum(docs) OVER (PARTITION BY lang) AS lang_docs FROM (SELECT lang, source, count(*) AS docs FROM v GROUP BY lang, source)),
a AS (SELECT k.lang, k.source, u.measure, u.b FROM k JOIN u ON CASE WHEN docs >= {LEAST_DOCS} THEN k.lang = u.lang AND k.source = u.source WHEN lang_docs >= {LEAST_DOCS} THEN k.lang = u.lang ELSE true END),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM (SELECT lang, source, measure, b, count(*) AS n FROM a GROUP BY lang, source, measure, b)),
q AS (SELECT lang, source, measure, CASE measure {floor} END AS floor, {", ".join(f"min(b) FILTER (WHERE 100 * upto >= {k} * total) AS b{k}" for k in quantiles)} FROM c GROUP BY lang, source, measure),
y AS (SELECT lang, source, measure, floor, {", ".join(f"{value.format(b=f'b{k}')} AS q{k}" for k in quantiles)} FROM q),
z AS (SELECT lang, source, measure, q75 + {REACH} * greatest(floor, least(q90 - q50, {WIDE} * greatest(q75 - q50, floor))) AS most, q25 - {REACH} * greatest(floor, least(q50 - q10, {WIDE} * greatest(q50 - q25, floor))) AS least FROM y),
h AS (SELECT lang, source, {", ".join(f"max({n.rsplit('_', 1)[1]}) FILTER (WHERE measure = '{n.rsplit('_', 1)[0]}')::BIGINT AS {n}" for n in names)} FROM z GROUP BY lang, source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join([*(f"{m} <= {m}_most" for m in MEASURES), *(f"{m} >= {m}_least" for m in LOW)])} AS kept, {", ".join(f"{m}::BIGINT AS {m}" for m in MEASURES)}, {", ".join(names)}
FROM v JOIN h USING (lang, source)
"""


ORACLE_SQL = _oracle()
