"""Benchmark decontamination with SimHash over item-sized windows (operator 1).

Items are grouped by length into classes, each with a window a little shorter than its items.  Windows of that size move
over every document in short strides; an item's windows are taken at all offsets, so a copied item always holds a document
window that stands like one of its own.  Fingerprints have 64 bits over words and word pairs.  They are cut into four blocks of 16
bits: two fingerprints within RADIUS bits agree in some block within RADIUS // 4 bits.  An item's window stands in a block's table
under all values within that distance; where such tables would be large, under those within half of it, and a document's window asks for
all values within the other half: they meet.  Every hit is verified: the item-sized stretch of the document around it
is compared with the item by weighted 5-word shingles (a shingle's weight is its count): sum of minima over sum of maxima.

Documents are read once, without a shuffle.  The benchmark goes to the workers in blocks of checked size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from treeloom.llm.resident import resident
from treeloom.llm.storage import columns, table
from treeloom.llm.words import chunks, hash_words, mix64, shingle_keys

SHINGLE, RADIUS, CLASS_RATIO = 5, 11, 1.3
#: Items and characters of a block of the benchmark.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 8 << 20
#: Items whose shingles a worker keeps for verification.
KEPT_ITEMS = 2_000
#: Pairs of like shingles of a text and an item that are written out at once.
PAIRS = 1 << 20


def _within(bits: int) -> np.ndarray:
    """All 16-bit values with at most ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(16), n)], dtype=np.int64)


#: (bits in the table, bits in the questions) of what a block may differ by: the first way whose tables fit TABLE_BYTES, else the last.
_WAYS = [(RADIUS // 4, 0), (RADIUS // 4 - RADIUS // 8, RADIUS // 8)]
TABLE_BYTES = 64 << 20


def _bit_sums(keys: np.ndarray, lane: type) -> np.ndarray:
    """Prefix sums, by bit, of the features at each word: the word itself and the pair that it begins.

    Several bits' sums stand side by side in one word of 64 bits, a ``lane`` each.  Lanes may run over into the next, but a difference of two
    such words is right as long as each bit's own difference fits a lane.
    """
    pairs = keys.copy()
    pairs[:-1] = mix64(keys[:-1] * np.uint64(3) + keys[1:])
    bits = np.unpackbits(keys.view(np.uint8).reshape(-1, 8), axis=1)
    bits += np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    packed = bits.astype(lane).view(np.uint64)
    sums = np.zeros((len(keys) + 1, packed.shape[1]), dtype=np.uint64)
    np.cumsum(packed, axis=0, out=sums[1:])
    return sums


def _lane(longest: int) -> type:
    """The narrowest lane for windows of up to ``longest`` words: a word adds two features."""
    return np.uint16 if 2 * longest < 1 << 16 else np.uint32


def _fingerprints(sums: np.ndarray, at: np.ndarray, size: int, lane: type) -> np.ndarray:
    """SimHash of the ``size``-word windows at ``at``; the last word's pair would leave the window and isn't counted, nor is the word."""
    over = (sums[at + size - 1] - sums[at]).view(lane) > size - 1
    return np.packbits(over, axis=1).view(np.uint64).reshape(-1)


@dataclass
class _Class:
    size: int
    stride: int
    prints: np.ndarray  # fingerprint of each item window
    item: np.ndarray
    offset: np.ndarray
    table: list[tuple[np.ndarray, np.ndarray]]  # for each block: first index by value, item windows
    asking: np.ndarray  # what a document's value is changed by

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) within RADIUS bits, all of them."""
        rows, hits = [], []
        for block, (first, windows) in enumerate(self.table):
            value = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            value = (value[:, None] ^ self.asking[None, :]).ravel()
            low = first[value].astype(np.int64)
            count = first[value + 1] - low
            row = np.repeat(np.repeat(np.arange(len(prints)), len(self.asking)), count)
            if not len(row):
                continue
            ends = np.cumsum(count)
            hit = windows[np.repeat(low - ends + count, count) + np.arange(ends[-1])]
            close = np.bitwise_count(prints[row] ^ self.prints[hit]) <= RADIUS
            rows.append(row[close])
            hits.append(hit[close])
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(hits)


def class_sizes(longest: int) -> list[tuple[int, int]]:
    """(window, stride) of each class; an item belongs to the last class with window + stride - 1 words at most."""
    out, size = [(2, 1)], 3
    while size <= longest:
        out.append((size, max(1, size // 3)))
        size = max(size + 1, int(size * CLASS_RATIO))
    return out


class Index:
    """The benchmark's windows by class, and the items' shingles for verification."""

    def __init__(self, items: list[tuple[int, str]]):
        words = hash_words([t.encode("utf-8", "surrogatepass") for _, t in items], lower=True)
        self.ids = [i for i, _ in items]
        self.words = [words.keys[words.first[i] : words.first[i + 1]] for i in range(len(items))]
        self.known: dict[int, _Item] = {}
        self.classes: list[_Class] = []
        grid = class_sizes(max([0, *map(len, self.words)]))
        self.lane = _lane(grid[-1][0])
        members: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            fits = [k for k, (size, stride) in enumerate(grid) if size + stride - 1 <= len(w)]
            if fits:
                members.setdefault(fits[-1], []).append(i)
        windows = sum(len(self.words[i]) - grid[k][0] + 1 for k, owned in members.items() for i in owned)
        way = next((w for w in _WAYS if 16 * windows * len(_within(w[0])) <= TABLE_BYTES), _WAYS[-1])
        stored, asking = map(_within, way)
        for k, owned in sorted(members.items()):
            size, stride = grid[k]
            prints, item, offset = [], [], []
            for i in owned:
                at = np.arange(len(self.words[i]) - size + 1)
                prints.append(_fingerprints(_bit_sums(self.words[i], self.lane), at, size, self.lane))
                item.append(np.full(len(at), i))
                offset.append(at)
            prints = np.concatenate(prints)
            tables = []
            for block in range(4):
                value = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
                values = (value[:, None] ^ stored[None, :]).astype(np.uint16).ravel()
                order = np.argsort(values, kind="stable")
                first = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << 16))]).astype(np.int32)
                tables.append((first, (order // len(stored)).astype(np.int32)))
            self.classes.append(_Class(size, stride, prints, np.concatenate(item), np.concatenate(offset), tables, asking))

    def item(self, i: int) -> _Item:
        found = self.known.get(i)
        if found is None:
            if len(self.known) >= KEPT_ITEMS:
                self.known.clear()
            found = self.known[i] = _Item.of(self.words[i])
        return found

    def search(self, keys: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(document, item, start word, similarity): the best stretch of each document for each item that it holds."""
        if len(keys) < 2:
            return []
        sums = _bit_sums(keys, self.lane)
        tries = []
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for c in self.classes:
            at = np.arange(0, len(keys) - c.size + 1)
            # Strides count from each document's first word; windows don't cross documents.
            at = at[((at - first[owner[at]]) % c.stride == 0) & (owner[at] == owner[at + c.size - 1])]
            if not len(at):
                continue
            row, hit = c.near(_fingerprints(sums, at, c.size, self.lane))
            tries.append(np.stack([owner[at[row]], c.item[hit], at[row] - c.offset[hit]], axis=1))
        out = []
        for doc, i, starts in _grouped(tries):
            low, high, size = int(first[doc]), int(first[doc + 1]), len(self.words[i])
            best = None
            # Stretches of three item lengths around the starts, those that meet taken as one.
            cuts = np.flatnonzero(np.diff(starts) > 3 * size) + 1
            for near in np.split(starts, cuts):
                begin, end = max(low, int(near[0]) - 2 * size), min(high, int(near[-1]) + 3 * size)
                found = _best_stretch(keys[begin:end], self.item(i), size, begin == low, end == high, threshold)
                if found and (best is None or found[0] > best[0]):
                    best = found[0], found[1] + begin - low
            if best:
                out.append((doc, self.ids[i], best[1], best[0]))
        return out


@dataclass
class _Item:
    """Shingles of an item: the different ones, their counts, where each one's places begin in ``places``."""

    shingles: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> _Item:
        keys = _shingles(words)
        order = np.argsort(keys, kind="stable")
        shingles, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
        return cls(shingles, counts, first, order)


def _grouped(tries: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, item, different starts in order)."""
    rows = np.unique(np.concatenate(tries), axis=0) if tries else np.zeros((0, 3), dtype=np.int64)
    if len(rows):
        for part in np.split(rows, np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0), axis=1)) + 1):
            yield int(part[0, 0]), int(part[0, 1]), part[:, 2]


def _best_stretch(words: np.ndarray, item: _Item, size: int, at_start: bool, at_end: bool, threshold: float) -> tuple[float, int] | None:
    """(similarity, first word) of the first best item-sized stretch in which a shingle stands as in the item; linear in ``words``.

    Stretches don't reach over the document's ends: one that would stands at the end.
    """
    keys = _shingles(words)
    kind = np.minimum(np.searchsorted(item.shingles, keys), len(item.shingles) - 1)
    at = np.flatnonzero(item.shingles[kind] == keys)
    if not len(at):
        return None
    kind = kind[at]
    last = max(0, len(words) - size)
    width = min(size, len(words)) - min(SHINGLE, size, len(words)) + 1
    # A shingle counts in the stretches that hold fewer of its kind before it than the item has: those that begin behind the place that
    # is so many of its kind back.
    order = np.argsort(kind, kind="stable")
    place, k = at[order], kind[order]
    nth = np.arange(len(k)) - np.searchsorted(k, k)
    back = np.arange(len(k)) - item.counts[k]
    low = np.maximum(place - width + 1, np.where(nth >= item.counts[k], place[np.maximum(back, 0)] + 1, 0))
    steps = np.bincount(np.maximum(low, 0), minlength=len(keys) + 2) - np.bincount(place + 1, minlength=len(keys) + 2)
    shared = np.cumsum(steps)[: last + 1]
    value = shared / np.maximum(1, width + len(item.places) - shared)
    starts = _aligned(place, k, item, len(words))
    inside = ((starts >= 0) | at_start) & ((starts <= last) | at_end)
    starts = np.unique(np.clip(starts[inside], 0, last))
    starts = starts[value[starts] >= threshold]
    if not len(starts):
        return None
    best = starts[np.argmax(value[starts])]
    return float(value[best]), int(best)


def _aligned(place: np.ndarray, kind: np.ndarray, item: _Item, n: int) -> np.ndarray:
    """All differences between a shingle's places in a text of ``n`` words and in the item; both sorted by kind."""
    counts = item.counts[kind]
    if counts.sum() <= PAIRS:
        ends = np.cumsum(counts)
        at = np.repeat(item.first[kind] - ends + counts, counts) + np.arange(ends[-1])
        return np.repeat(place, counts) - item.places[at]
    out = []
    size = 1 << int(n + len(item.places)).bit_length()
    for at in np.split(np.arange(len(kind)), np.flatnonzero(np.diff(kind)) + 1):
        mine, its = place[at], item.places[item.first[kind[at[0]]] :][: counts[at[0]]]
        if len(mine) * len(its) <= 64 * size:
            out.append(np.unique(mine[:, None] - its[None, :]))
        else:  # a shingle that repeats on both sides: its differences by correlation
            marks = np.zeros((2, size))
            marks[0, mine] = marks[1, its] = 1
            a, b = np.fft.rfft(marks)
            found = np.flatnonzero(np.fft.irfft(a * b.conj(), size) > 0.5)
            out.append(np.where(found >= n, found - size, found))
    return np.unique(np.concatenate(out))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Keys of 5-word shingles; of fewer words, the whole sequence is one."""
    n = min(SHINGLE, len(words))
    acc = np.zeros(max(len(words) - n + 1, 0) if n else 0, dtype=np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return acc


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts that are each small enough to send to the workers."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_CHARS))
    return [items.where(F.expr(f"pmod(xxhash64(item_id, text), {parts}) = {k}")) if parts > 1 else items for k in range(parts)]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(row, item_id, start_word, similarity) for each row of ``docs`` and item of ``benchmark`` that it holds.

    ``row`` is a struct of all columns of ``docs`` (doc_id, text among them); the similarity is that of the best stretch.  Items of one word, null or
    blank items and texts match nothing.  Repeated rows and items are reported each; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*columns(docs)).alias("row"), docs["text"].alias("text"))
    found_type = StructType([packed.schema["row"], benchmark.schema["item_id"], StructField("start_word", LongType()), StructField("similarity", DoubleType())])
    found = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])  # of checked size

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = resident(("benchmark", key), lambda: Index(shared.value))
            for batch in batches:
                for at, texts in chunks((s.as_py() for s in batch.column(1)), 1 << 18):
                    words = hash_words(texts, lower=True)
                    hits = index.search(words.keys, words.first, threshold)
                    if hits:
                        rows = batch.column(0).take(pa.array([at + h[0] for h in hits]))
                        yield pa.RecordBatch.from_arrays([rows, pa.array([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.float64())], ["row", "item_id", "start_word", "similarity"])

        part = packed.mapInArrow(run, found_type)
        found = part if found is None else found.unionByName(part)
    return found


def keep_free(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns (names of any kind); the same single pass over the texts.

    Null and blank texts and null ids stay, repeated rows stay or go together; an empty benchmark leaves all rows.
    """
    spark, kept = docs.sparkSession, docs
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])  # of checked size
        packed = kept.select(F.struct(*columns(kept)).alias("row"), kept["text"].alias("text"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = resident(("benchmark", key), lambda: Index(shared.value))
            for batch in batches:
                leaking: set[int] = set()
                for at, texts in chunks((s.as_py() for s in batch.column(1)), 1 << 18):
                    words = hash_words(texts, lower=True)
                    leaking.update(at + h[0] for h in index.search(words.keys, words.first, threshold))
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[list(leaking)] = False
                yield batch.select([0]).filter(pa.array(keep))

        kept = packed.mapInArrow(run, StructType([packed.schema["row"]])).select("row.*")
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_decontamination: all of ``documents`` against all of ``benchmark``."""
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "item_id", "start_word", F.round("similarity", 6).alias("similarity"))


#: Every stretch of an item's length in every document, compared in full.
ORACLE_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x20\x09-\x0D]+') AS w FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(text, a, b), '[^\x20\x09-\x0D]+') AS w FROM benchmark, low WHERE text IS NOT NULL),
ds AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
s AS (SELECT item_id, q, array_to_string(w[q:q + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS q FROM i)),
c AS (SELECT DISTINCT ds.doc_id, s.item_id, least(greatest(p - q + 1, 1), greatest(1, len(d.w) - len(i.w) + 1)) AS start FROM ds JOIN s USING (s) JOIN d USING (doc_id) JOIN i USING (item_id)),
x AS (SELECT c.doc_id, c.item_id, start, ds.s, count(*) AS n FROM c JOIN i USING (item_id) JOIN ds ON ds.doc_id = c.doc_id AND ds.p >= start AND ds.p <= start + len(i.w) - 5 GROUP BY ALL),
y AS (SELECT item_id, s, count(*) AS n FROM s GROUP BY ALL),
joint AS (SELECT x.doc_id, x.item_id, start, sum(least(x.n, y.n)) AS common FROM x JOIN y USING (item_id, s) GROUP BY ALL),
size AS (SELECT x.doc_id, x.item_id, start, sum(n) AS n FROM x GROUP BY ALL),
z AS (SELECT doc_id, item_id, start, common / (size.n + len(i.w) - 4 - common) AS similarity FROM joint JOIN size USING (doc_id, item_id, start) JOIN i USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM z WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::BIGINT - 1 AS start_word, round(similarity, 6) AS similarity FROM best WHERE r = 1
"""
