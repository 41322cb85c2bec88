"""Stupid-backoff language-model scores from count tables partitioned by hash (operator 3).

Every word gets S(w | history) from the counts of all *other* documents: the relative frequency of the longest n-gram, up to three words, that
they contain, times ALPHA for each word of history given up.  Log scores are summed per document.

A corpus has about as many different n-grams as words, so the rows of the count tables and of the exploded n-grams travel in
blocks: sorted keys as steps, compressed by byte plane.

1. A part (some megabytes of one scan split) explodes its texts and sends its distinct n-gram keys with counts, one block for each
   hash bucket: pre-aggregated before the shuffle.
2. Each bucket adds its blocks up to its piece of the count table, and joins the table back to the keys of each block.
3. Each part explodes its texts again (they come as compressed pieces), joins the n-grams to the totals that came back, takes the
   document's own counts off, and sums up.

Keys have all 64 bits, zero included, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from treeloom.llm.resident import vacate
from treeloom.llm.storage import saved, table
from treeloom.llm.words import chunks, hash_words, shingle_keys

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a part, of text in a piece of it, and of keys in a bucket, about.
PART_BYTES, PIECE_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20, 32 << 20
_TEXT, _KEYS = pa.Codec("zstd", 6), pa.Codec("zstd", 1)


def _explode(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n, keys of the n-grams and the words that they end at (none where a document's start is nearer), and words before each document."""
    runs, counts, before = [[] for _ in range(ORDER)], [np.zeros(1, dtype=np.int64)], 0
    for _, run in chunks(texts):
        words = hash_words(run, lower=True)
        counts.append(words.counts())
        for n in range(1, ORDER + 1):
            keys, bounds = (words.keys, words.first) if n == 1 else shingle_keys(words, n)
            per = np.diff(bounds)
            at = np.repeat(words.first[:-1] + n - 1 - bounds[:-1], per) + np.arange(len(keys))
            runs[n - 1].append((keys, (at + before).astype(np.int32)))
        before += len(words.keys)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    out = []
    while runs:  # what is joined goes, so that not all is held twice
        out.append(tuple(map(np.concatenate, zip(none, *runs.pop(0), strict=True))))
    return out, np.cumsum(np.concatenate(counts))


def _pack(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(keys, bytes a step, data): sorted distinct keys as steps of the fewest whole bytes, compressed byte by byte."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return len(keys), width, _KEYS.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T), asbytes=True)


def _unpack(n: int, width: int, data: bytes) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(_KEYS.decompress(data, n * width), dtype=np.uint8).reshape(width, -1).T
    return np.cumsum(steps.view(np.uint64).reshape(-1))


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte each, and the counts from 255 on as they are."""
    return _KEYS.compress(np.minimum(counts, 255).astype(np.uint8), asbytes=True), counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(n: int, small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(_KEYS.decompress(small, n), dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, dtype=np.int64)
    return out


_BLOCK = "part long, n int, bucket long, size int, width int, keys binary, small binary, large binary"
_BLOCK_NAMES = ["part", "n", "bucket", "size", "width", "keys", "small", "large"]


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _BLOCK_NAMES)


def _pieces(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[tuple[int, list, bytes, bytes]]:
    """(part, ids, text sizes, compressed texts) of about PIECE_BYTES each from rows (part, text) or, with ``ids``, (part, text, doc_id)."""
    open_: dict[int, tuple[list, list[bytes]]] = {}
    held: dict[int, int] = {}

    def close(part: int) -> tuple[int, list, bytes, bytes]:
        own, texts = open_.pop(part)
        del held[part]
        return part, own, np.array([len(t) for t in texts], dtype=np.int64).tobytes(), _TEXT.compress(b"".join(texts), asbytes=True)

    for batch in batches:
        names = batch.column(2).to_pylist() if ids else [None] * batch.num_rows
        for part, name, text in zip(batch.column(0).to_pylist(), names, batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            own, texts = open_.setdefault(part, ([], []))
            own.append(name)
            texts.append(data)
            held[part] = held.get(part, 0) + len(data)
            if held[part] >= PIECE_BYTES:
                yield close(part)
    for part in list(open_):
        yield close(part)


def _texts(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, dtype=np.int64)).tolist()
    whole = _TEXT.decompress(data, ends[-1], asbytes=True)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905  the last start has no end


def _requests(buckets: int):
    """mapInArrow function (part, text) -> blocks of distinct keys."""

    def blocks(part: int, texts: list[bytes]) -> Iterator[tuple]:
        grams = _explode(texts)[0]
        for n in range(1, ORDER + 1):
            keys, counts = np.unique(grams.pop(0)[0], return_counts=True)
            lows = [np.uint64((b << 64) // buckets) for b in range(buckets)]
            edges = np.searchsorted(keys, lows[1:])
            for b, (lo, hi) in enumerate(zip([0, *edges], [*edges, len(keys)], strict=True)):
                if hi > lo:  # keys count from the bucket's least, so that the first step is no wider than others
                    yield (part, n, b, *_pack(keys[lo:hi] - lows[b]), *_pack_counts(counts[lo:hi]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        held: dict[int, list[tuple[bytes, bytes]]] = {}  # compressed until their part's turn comes
        for part, _, sizes, data in _pieces(batches, ids=False):
            held.setdefault(part, []).append((sizes, data))
        for part in list(held):
            rows = list(blocks(part, [t for piece in held.pop(part) for t in _texts(*piece)]))
            if rows:
                yield from _table(rows).to_batches()

    return run


def _senders(id_type: pa.DataType):
    """mapInArrow function (part, text, doc_id) -> pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, sizes, data in _pieces(batches, ids=True):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([own], pa.list_(id_type)), pa.array([sizes], pa.binary()), pa.array([data], pa.binary())], ["part", "ids", "sizes", "texts"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Blocks of one bucket -> the same blocks with the counts of all; only keys that more than one block or count has are kept as such."""
    rows = table.to_pylist()
    keys = [_unpack(r["size"], r["width"], r["keys"]) for r in rows]
    counts = np.concatenate([_unpack_counts(r["size"], r["small"], r["large"]) for r in rows])
    order = np.argsort(np.concatenate(keys), kind="stable")
    line = np.concatenate(keys)[order]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    sums = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.append(starts, len(line))))
    total = np.empty_like(sums)
    total[order] = sums
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return _table([(r["part"], r["n"], r["bucket"], r["size"], 0, b"", *_pack_counts(t)) for r, t in zip(rows, np.split(total, cuts), strict=True)])


def _scores(texts: list[bytes], totals: list[np.ndarray], corpus_words: int) -> list[np.ndarray]:
    """For each text: words, sum of log scores, and words scored at each level (3 words, 2, 1, unseen)."""
    grams, first = _explode(texts)
    size = int(first[-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    others = []
    while grams:
        (keys, ends), counts = grams.pop(0), totals.pop(0)
        distinct, at = np.unique(keys, return_inverse=True)
        if len(distinct) != len(counts):
            raise ValueError("a part was read in two ways")
        total = counts[at]
        # The document's own count, where the total leaves room for others.
        own, use = np.ones(len(total), dtype=np.int64), np.flatnonzero(total > 1)
        _, back, times = np.unique(owner[ends[use]] * np.int64(max(len(distinct), 1)) + at[use], return_inverse=True, return_counts=True)
        own[use] = times[back]
        other = np.zeros(size, dtype=np.int64)
        other[ends] = total - own
        others.append(other)
    one, two, three = others
    before = lambda x: np.concatenate([np.zeros(min(1, size), dtype=np.int64), x[:-1]])
    reach = np.minimum(np.arange(size) - first[owner], ORDER - 1)  # words of history
    rest = np.maximum(corpus_words - np.diff(first), 1)[owner]
    level = np.select([(three > 0), (two > 0), (one > 0)], [0, 1, 2], 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.select([level == 0, level == 1, level == 2], [three / before(two), two / before(one), one / rest], 1 / (rest + 1))
    given_up = np.maximum(reach - np.array([2, 1, 0, -1])[level], 0)
    logs = np.log(share) + given_up * np.log(ALPHA)
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    levels = [np.bincount(owner[level == k], minlength=len(texts)) for k in range(4)]
    return [np.diff(first), sums[first[1:]] - sums[first[:-1]], *levels]


def _split_of(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(rows, columns): what names the scan split of a row, the file and its block, and its number in the file.

    Frames that aren't Parquet scans are written first: they needn't give the same rows twice.
    """
    try:
        return docs, [docs["_metadata.file_path"], docs["_metadata.file_block_start"], docs["_metadata.row_index"]]
    except Exception:  # noqa: BLE001  the analyzer's error class differs by frame
        return _split_of(saved(docs.select("doc_id", "text"), "lm-texts"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_trigrams, n_bigrams, n_unigrams, n_unseen) of each row of ``docs`` (doc_id, text).

    A null, empty or blank text has no words: sum 0, mean null.  The first words of a text have shorter histories and lose
    nothing for it.  A word that no other document has counts as 1 / (other words + 1) at the unigram's level, less one ALPHA more.
    Repeated rows are documents of their own; an empty table gives no rows.
    """
    docs, (*split, number) = _split_of(docs)
    corpus_words, largest = _size(docs.select("text"))
    buckets = max(4, -(-corpus_words * 8 // BUCKET_BYTES))
    # Parts of the largest task's real bytes; rows of one id, or one text, are dealt out by their number too.
    parts = max(1, -(-largest // PART_BYTES))
    rows = docs.select(F.xxhash64(*split, F.pmod(F.xxhash64("doc_id", "text", number), F.lit(parts))).alias("part"), "doc_id", "text")
    asked = rows.select("part", "text").mapInArrow(_requests(buckets), _BLOCK)
    answered = asked.groupBy("n", "bucket").applyInArrow(_totals, _BLOCK)
    id_type = docs.schema["doc_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = sorted(right.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
        totals = [np.concatenate([np.zeros(0, dtype=np.int64), *[_unpack_counts(r["size"], r["small"], r["large"]) for r in answers if r["n"] == n]]) for n in range(1, ORDER + 1)]
        pieces = left.to_pylist()
        ids = pa.array([i for p in pieces for i in p["ids"]], arrow_type)
        count, logs, *levels = _scores([t for p in pieces for t in _texts(p["sizes"], p["texts"])], totals, corpus_words)
        return pa.table([ids, pa.array(count), pa.array(logs), *[pa.array(x.astype(np.int64)) for x in levels]], ["doc_id", "n_words", "log_score", "n_trigrams", "n_bigrams", "n_unigrams", "n_unseen"])

    sent = rows.select("part", "text", "doc_id").mapInArrow(_senders(arrow_type), f"part long, ids array<{id_type.simpleString()}>, sizes binary, texts binary")
    out = sent.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(score, f"doc_id {id_type.simpleString()}, n_words long, log_score double, n_trigrams long, n_bigrams long, n_unigrams long, n_unseen long")
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log_score"), "n_trigrams", "n_bigrams", "n_unigrams", "n_unseen")


def _size(texts: DataFrame) -> tuple[int, int]:
    """Words of all texts, and bytes of the task with most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = size = 0
        for batch in batches:
            for _, part in chunks(s.as_py() for s in batch.column(0)):
                words += len(hash_words(part).keys)
                size += sum(map(len, part))
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([size], pa.int64())], ["words", "size"])

    found = texts.mapInArrow(run, "words long, size long").agg(F.sum("words"), F.max("size")).first()
    return found[0] or 0, found[1] or 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_lm_scoring over the whole of ``documents``."""
    return lm_scores(table(spark, sf_dir, "documents"))


#: Count tables, joins to the exploded n-grams, sums.
ORACLE_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, len(w) AS size, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3, w[i - 1] AS h1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS h2
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
a AS (SELECT *, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS c1,
    CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) END AS c2, CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) END AS c3,
    (SELECT count(*) FROM p) - size AS rest FROM p),
b AS (SELECT a.*, lag(c1) OVER (PARTITION BY r ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS b2 FROM a),
s AS (SELECT r, CASE WHEN c3 > 0 THEN 0 WHEN c2 > 0 THEN 1 WHEN c1 > 0 THEN 2 ELSE 3 END AS level, least(i - 1, 2) AS history, c1, c2, c3, b1, b2, rest FROM b),
x AS (SELECT r, level, ln(CASE level WHEN 0 THEN c3 / b2 WHEN 1 THEN c2 / b1 WHEN 2 THEN c1 / rest ELSE 1 / (rest + 1) END) + greatest(history - (2 - level), 0) * ln(0.4) AS v FROM s),
y AS (SELECT r, sum(v) AS v, count(*) FILTER (WHERE level = 0) AS n3, count(*) FILTER (WHERE level = 1) AS n2, count(*) FILTER (WHERE level = 2) AS n1, count(*) FILTER (WHERE level = 3) AS n0 FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(v / len(w), 6) END AS mean_log_score,
  coalesce(n3, 0)::BIGINT AS n_trigrams, coalesce(n2, 0)::BIGINT AS n_bigrams, coalesce(n1, 0)::BIGINT AS n_unigrams, coalesce(n0, 0)::BIGINT AS n_unseen
FROM w LEFT JOIN y USING (r)
"""
