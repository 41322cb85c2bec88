"""N-gram Jaccard join by vertical partitioning (operator 10).

The distinct 4-word shingles of a document are its set.  All shingles have one global order, that of their 64-bit
keys, and the order is cut into fragments:

1. *Candidates.*  Two sets of similarity t differ in at most ``(1-t)/t * m`` shingles, m being the smaller size.  For
   each size class the order is cut into more fragments than that, so that two similar sets agree wholly on at least
   one fragment that isn't empty.  With m differences at most, a document sends keys for its m + 1 largest segments only:
   similar sets agree on all but m of their segments, and the largest of those is among the m + 1 largest of both.  Segments of
   one or two shingles, which unrelated texts share by chance, so stay at home.  A document so lumpy
   that agreement cannot be promised also sends its shingles of a prefix filter.  Frequent shingles do no harm: whole
   segments must agree.  Sketches (size and hash of each of 64 fragments or more, of about 8 shingles at most) bound the
   differences of a pair from below and drop hopeless pairs before any set is moved.
2. *Overlaps.*  The order is cut into a few coarse fragments.  For each candidate pair the overlap is counted in each
   fragment separately (joins on set and fragment) and summed per pair; the sum decides.

Equal sets hang on their smallest id, outside the graph of links, and are never paired.  Within a bucket of equal segments, members are first
compared with one hub; only members that the links found so far leave in different components are then compared with each
other: pair by pair in buckets of bounded size, so that large texts that share a segment by chance meet no others, and block of documents by
block in larger ones (there a task takes a pair of blocks, fragment after fragment), so a group of near copies costs its size.  No link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.graph import connected_components
from treeloom.llm.resident import vacate
from treeloom.llm.storage import columns, discard, saved, table
from treeloom.llm.words import chunks, hash_words, mix64, sequence_key, shingle_keys

SIZE_RATIO = 1.6
#: Fragments of a size class for each difference: the more, the more of the small ones need not be sent, but the smaller all are.
SPARE_FRAGMENTS = 1.3
COARSE_FRAGMENTS = 8
#: Least fragments of a sketch, and shingles that a fragment holds on average at most; the number of fragments is doubled until that holds.
SKETCH, SKETCH_SHINGLES = 64, 8
#: Members of a bucket that are compared pair by pair at most.
BUCKET_PAIRS = 16
#: Orders that are tried for a document whose shingles fall too unevenly, before a prefix filter.
ORDERS = 4
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 4 << 20
#: Documents and shingles that are multiplied out at once.
TILE = 512
#: One document in so many is looked at for hot segments: those of at least so many of them, and of one in so many of them.
HUB_SAMPLE, HUB_LEAST, HUB_SHARE = 64, 16, 2_000
#: Ids of at most this many bytes are broadcast when texts are looked up again; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


@lru_cache(maxsize=8)
def size_classes(num: int, den: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, most differences, fragments) of each size class for similarity num/den.

    The fragments outnumber the differences and the empty fragments that a document of the class's least size may expect.
    """
    first, most, cut, low = [], [], [], 1
    while low < top:
        nxt = int(low * SIZE_RATIO) + 1
        differ = (den - num) * (nxt - 1) // num
        parts = math.ceil(SPARE_FRAGMENTS * differ) + 1
        while differ and parts < 2 * differ and parts - differ <= (e := parts * math.exp(-low / parts)) + 1.3 * math.sqrt(e):
            parts += 1 + differ // 500
        first.append(low)
        most.append(differ)
        cut.append(parts)
        low = nxt
    return np.array(first), np.array(most), np.array(cut)


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key) of each distinct shingle, sorted by owner and key, and the set sizes."""
    words = hash_words(texts, lower=True)
    keys, bounds = shingle_keys(words, n)
    count = words.counts()
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    short = [i for i in np.flatnonzero((count > 0) & (count < n)).tolist()]
    if short:
        extra = [sequence_key(words.keys[words.first[i] : words.first[i + 1]]) for i in short]
        keys, owner = np.concatenate([keys, np.array(extra, dtype=np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh].astype(np.int64)
    return owner, keys, np.bincount(owner, minlength=len(texts))


def _set_ids(owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit identity of each set, as two longs."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(sizes), dtype=np.uint64)
        if len(keys):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[starts]] = np.add.reduceat(mix64(keys ^ np.uint64(salt)), starts)
        out.append((sums + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _segment_keys(owner, keys, sizes, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of the segments that a document offers for candidates: of each order its largest ones, one more than its differences.

    Equal segments have equal sizes and keys, so all documents drop by one order, and the largest segment that two similar sets share is sent by both.
    """
    first, most, cut = size_classes(num, den)
    own = np.searchsorted(first, sizes, side="right") - 1
    owners, out = [], []
    for back in (0, 1):
        cls = np.maximum(own - back, 0)
        # One class down only where a partner of that class can be similar.
        use = (sizes > 0) & (own >= back)
        if back:
            use &= den * (first[own] - 1) >= num * sizes
        # The smaller of two similar sets bounds their differences, and is of this class.
        differ = np.minimum(most[cls], (den - num) * sizes // num)
        for order in range(ORDERS):
            pick = use[owner]
            o, k = owner[pick], keys[pick]
            if not len(o):
                break
            if order:
                k = mix64(k ^ np.uint64(order))
                by = np.lexsort((k, o))
                o, k = o[by], k[by]
            part = ((k >> np.uint64(32)) * cut[cls][o].astype(np.uint64)) >> np.uint64(32)
            edge = np.ones(len(o), dtype=bool)
            edge[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(edge)
            label = mix64(part[at] * np.uint64(4099) + (cls[o[at]] * ORDERS + order).astype(np.uint64) + np.uint64(1))
            segment, own_at = mix64(np.add.reduceat(mix64(k), at) ^ label), o[at]
            filled = np.bincount(own_at, minlength=len(sizes))
            by = np.lexsort((segment, -np.diff(at, append=len(o)), own_at))
            rank = np.arange(len(by)) - np.repeat(np.cumsum(filled) - filled, filled)
            by = by[rank <= differ[own_at]]
            owners.append(own_at[by])
            out.append(segment[by])
            # Where too many fragments are empty, two similar sets may agree on empty ones only; both then come here.
            use &= filled <= differ
            use &= differ > 0
        for i in np.flatnonzero(use).tolist():
            lo, hi = np.searchsorted(owner, [i, i + 1])
            prefix = keys[lo : lo + (hi - lo) - -(-(hi - lo) * num // den) + 1]
            owners.append(np.full(len(prefix), i))
            out.append(mix64(prefix ^ np.uint64(0xA4093822299F31D0 + int(cls[i]))))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(out)


def _over_texts(emit: Callable[[list, list[bytes]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function over (doc_id, text): calls ``emit`` with the ids and texts of about a megabyte at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in chunks(s.as_py() for s in batch.column(1)):
                if (out := emit(ids[at : at + len(texts)], texts)) is not None and out.num_rows:
                    yield out

    return run


def describe_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, hi, lo) of each row of ``docs``."""

    def emit(ids, texts):
        owner, keys, sizes = sets_of(texts, n)
        hi, lo = _set_ids(owner, keys, sizes)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(hi), pa.array(lo)], ["doc_id", "size", "hi", "lo"])

    return docs.mapInArrow(_over_texts(emit), "doc_id long, size long, hi long, lo long")


def segments(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(segment, doc_id) for candidates."""

    def emit(ids, texts):
        owner, keys = _segment_keys(*sets_of(texts, n), num, den)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.array(ids, dtype=np.int64)[owner])], ["segment", "doc_id"])

    return docs.where("doc_id is not null").mapInArrow(_over_texts(emit), "segment long, doc_id long")


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, hi, lo, sketch): size and 16 bits of hash of each of SKETCH or more fine fragments, for lower bounds of differences.

    Both are sums (the hash modulo 2**16), so that two neighbours of a fine sketch add up to one of the next coarser sketch.
    """

    def emit(ids, texts):
        owner, keys, sizes = sets_of(texts, n)
        hi, lo = _set_ids(owner, keys, sizes)
        steps = np.ceil(np.log2(np.maximum(sizes / (SKETCH * SKETCH_SHINGLES), 1))).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(SKETCH << steps)])
        shift = (64 - SKETCH.bit_length() + 1 - steps).astype(np.uint64)
        part = first[owner] + (keys >> shift[owner]).astype(np.int64)
        count = np.bincount(part, minlength=first[-1])
        mark = np.zeros(first[-1], dtype=np.uint64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        if len(at):
            mark[part[at]] = np.add.reduceat(mix64(keys), at) & np.uint64(0xFFFF)
        both = np.stack([np.minimum(count, 65535).astype(np.uint16), mark.astype(np.uint16)], axis=1)
        data = pa.array([both[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi), pa.array(lo), data], ["doc_id", "hi", "lo", "sketch"])

    return docs.mapInArrow(_over_texts(emit), "doc_id long, hi long, lo long, sketch binary")


def _read_sketches(data: list[bytes], parts: int) -> np.ndarray:
    """(sketch, fragment, size and hash) of sketches of one length, in ``parts`` fragments."""
    whole = np.frombuffer(b"".join(data), dtype=np.uint16).astype(np.int64).reshape(len(data), parts, -1, 2).sum(axis=2)
    whole[..., 1] &= 0xFFFF
    return whole


def _may_link(left: np.ndarray, right: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sketches (.., fragments, 2) allow a link: unlike fragments differ by their sizes' difference, and by 2 if those are equal."""
    apart = np.abs(left[..., 0].astype(np.int64) - right[..., 0])
    least = np.where(left[..., 1] == right[..., 1], apart, np.where(apart == 0, 2, apart)).sum(axis=-1)
    return den * (a_size + b_size - least) >= num * (a_size + b_size + least)


def coarse_segments(docs: DataFrame, n: int) -> DataFrame:
    """(hi, lo, fragments) of each row's set: its shingles cut into COARSE_FRAGMENTS runs of the global order, empty ones among them."""

    def emit(ids, texts):
        owner, keys, sizes = sets_of(texts, n)
        hi, lo = _set_ids(owner, keys, sizes)
        own = np.flatnonzero(sizes)
        if not len(own):
            return None
        part = (keys >> np.uint64(64 - COARSE_FRAGMENTS.bit_length() + 1)).astype(np.int64)
        cuts = np.searchsorted(owner * COARSE_FRAGMENTS + part, (own[:, None] * COARSE_FRAGMENTS + np.arange(COARSE_FRAGMENTS)[None, :]).ravel())
        runs = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(keys)).astype(np.int32)), pa.array(keys.view(np.int64)))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * COARSE_FRAGMENTS).astype(np.int32)), runs)
        return pa.RecordBatch.from_arrays([pa.array(hi[own]), pa.array(lo[own]), lists], ["hi", "lo", "fragments"])

    return docs.mapInArrow(_over_texts(emit), "hi long, lo long, fragments array<array<long>>")


def _pieces(docs: DataFrame, ids: DataFrame, n: int, unique: bool) -> DataFrame:
    """coarse_segments() of the texts of ``ids``, each set once."""
    found = coarse_segments(_only(docs, ids), n)
    return saved(found if unique else found.dropDuplicates(["hi", "lo"]), "pieces")


def _promising(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes and sketches allow a link, with sizes and identities.  sets: (doc_id, size, hi, lo, sketch)."""
    side = lambda x: sets.select(*(F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "size", "hi", "lo", "sketch")))
    both = pairs.join(side("a"), F.col("a") == F.col("a_doc_id")).join(side("b"), F.col("b") == F.col("b_doc_id"))
    alike = f"{den} * least(a_size, b_size) >= {num} * greatest(a_size, b_size) and not (a_hi = b_hi and a_lo = b_lo)"
    names = ["a", "b", "a_size", "b_size", "a_hi", "a_lo", "b_hi", "b_lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("a_sketch", "b_sketch"))
            a_size, b_size = (batch.column(c).to_numpy() for c in ("a_size", "b_size"))
            parts = np.array([(len(a) // 4, len(b) // 4) for a, b in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
            keep = np.zeros(len(parts), dtype=bool)
            for lengths in np.unique(parts, axis=0):
                alike = np.flatnonzero((parts == lengths).all(axis=1))
                for low in range(0, len(alike), TILE):
                    at = alike[low : low + TILE]
                    a, b = (_read_sketches(side[at].tolist(), int(lengths.min())) for side in (left, right))
                    keep[at] = _may_link(a, b, a_size[at], b_size[at], num, den)
            yield batch.select(names).filter(pa.array(keep))

    return both.where(alike).select(*names, "a_sketch", "b_sketch").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _similar(pairs: DataFrame, pieces: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` (of _promising) whose sets are similar: overlaps by pair and fragment, summed by pair.

    Sets and pairs are dealt out by fragment too, so the fragments of a set that is in many pairs are different tasks' work.
    """
    # Both sides take the fragments dealt out by the same key, so that they are shuffled once.
    fragments = pieces.select("hi", "lo", F.posexplode("fragments").alias("fragment", "keys")).where("size(keys) > 0")
    left = fragments.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), "fragment", F.col("keys").alias("left"))
    right = fragments.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), "fragment", F.col("keys").alias("right"))
    asked = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(COARSE_FRAGMENTS - 1))))
    both = asked.join(left, ["a_hi", "a_lo", "fragment"]).join(right, ["b_hi", "b_lo", "fragment"])
    partial = both.select(*pairs.columns, F.size(F.array_intersect("left", "right")).cast("long").alias("shared"))
    total = partial.groupBy(*pairs.columns).agg(F.sum("shared").alias("shared"))
    return total.where(f"{den} * shared >= {num} * (a_size + b_size - shared)").select("a", "b").distinct()


def _with_hubs(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(segment, doc_id, hub): segments of more than one document, less each one's hub, its least doc_id.

    Segments that are in a large share of a sample of the documents take their hub from a pre-aggregated minimum, and their rows are dealt
    out by document.  The sample only decides which way a segment goes; the rows are the same.
    """
    sample = docs.where(F.expr(f"pmod(xxhash64(doc_id), {HUB_SAMPLE}) = 0"))
    least = max(HUB_LEAST, sample.count() // HUB_SHARE)
    # At most HUB_SHARE times a document's segments.
    hot = saved(segments(sample, n, num, den).groupBy("segment").count().where(F.col("count") >= least).select("segment"), "hot-segments")
    rows = segments(docs, n, num, den)
    if not hot.limit(1).count():
        first = F.first("doc_id").over(Window.partitionBy("segment").orderBy("doc_id"))
        return rows.withColumn("hub", first).where("hub <> doc_id")
    tops = saved(rows.join(F.broadcast(hot), "segment", "left_semi").groupBy("segment").agg(F.min("doc_id").alias("top")), "hot-hubs")
    rows = rows.join(F.broadcast(tops), "segment", "left").withColumn("deal", F.when(F.col("top").isNull(), 0).otherwise(F.xxhash64("doc_id")))
    first = F.first("doc_id").over(Window.partitionBy("segment", "deal").orderBy("doc_id"))
    return rows.withColumn("hub", F.coalesce("top", first)).where("hub <> doc_id").select("segment", "doc_id", "hub")


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): two members of a bucket in different components, less the pairs with the bucket's hub, which are compared already."""
    side = lambda x: rows.select("segment", "hub", F.col("doc_id").alias(x), F.col("component").alias(f"{x}_component"))
    both = side("a").join(side("b").drop("hub"), "segment").where("a < b and a <> hub and a_component <> b_component")
    return both.select("a", "b").distinct()


def _blocks(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(block, doc_id, component, size, hi, lo, sketch): members of buckets in blocks of bounded size, neighbours of like size together."""
    # The least hub of the buckets' least hubs: what shares buckets mostly shares a family.
    own = rows.groupBy("doc_id").agg(F.min("hub").alias("family"), F.min("component").alias("component"))
    wide = rows.select("segment", "doc_id").join(own.select("doc_id", "family"), "doc_id").groupBy("segment").agg(F.min("family").alias("family"))
    family = rows.select("segment", "doc_id").join(wide, "segment").groupBy("doc_id").agg(F.min("family").alias("family"))
    docs = own.drop("family").join(family, "doc_id").join(sets, "doc_id").withColumn("step", F.floor(F.log("size") / math.log(den / num)))
    parts = F.greatest(F.expr(f"ceil(count(*) / {BLOCK_DOCS})"), F.expr(f"ceil(sum(size) / {BLOCK_SHINGLES})"))
    families = docs.groupBy("family", "step").agg(parts.alias("parts"))
    # Salted by the set: a family of any size falls into blocks of about the bound.
    block = F.xxhash64("family", "step", F.expr("pmod(xxhash64(hi, lo), parts)"))
    return docs.join(families, ["family", "step"]).select(block.alias("block"), "doc_id", "component", "size", "hi", "lo", "sketch")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, within one fragment."""
    n, both = len(left), [*left, *right]
    out = np.zeros((n, len(right)), dtype=np.float32)
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    for low in range(0, len(values), TILE):
        use = (column >= low) & (column < low + TILE)
        hot = np.zeros((len(both), min(TILE, len(values) - low)), dtype=np.float32)
        hot[row[use], column[use] - low] = 1
        out += hot[:n] @ hot[n:].T
    return out


def _block_pairs(rows: DataFrame, blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): blocks whose documents share a bucket, are of like size, and aren't all of one component."""
    seen = rows.select("segment", "doc_id").join(blocks.select("doc_id", "block").distinct(), "doc_id").select("segment", "block").distinct()
    pairs = seen.select("segment", F.col("block").alias("x")).join(seen.select("segment", F.col("block").alias("y")), "segment").where("x <= y").select("x", "y").distinct()
    span = blocks.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("component").alias("first"), F.max("component").alias("last"))
    side = lambda c: span.select(F.col("block").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("low", "high", "first", "last")))
    fits = f"{den} * x_high >= {num} * y_low and {den} * y_high >= {num} * x_low and not (x_first = x_last and y_first = y_last and x_first = y_first)"
    return saved(pairs.join(side("x"), "x").join(side("y"), "y").where(fits).select("x", "y"), "block-pairs")


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select("x", "y", F.col("x").alias("block")).unionByName(pairs.where("x <> y").select("x", "y", F.col("y").alias("block")))


def _likely(blocks: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, doc_id): documents with a partner of another component that sketches allow, by pair of blocks."""

    def pick(key: tuple, table: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        block, doc, component, size = (table.column(c).to_numpy() for c in ("block", "doc_id", "component", "size"))
        data = np.array([*table.column("sketch").to_pylist(), b""], dtype=object)[:-1]
        parts = np.array([len(d) // 4 for d in data], dtype=np.int64)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out: set[int] = set()
        for fine in np.unique(parts[right]).tolist():
            some = right[parts[right] == fine]
            read: dict[int, np.ndarray] = {}
            for i in left.tolist():
                # Of two sketches the finer one is read as one of the other's length.
                least = min(fine, int(parts[i]))
                near = (component[some] != component[i]) & (den * np.minimum(size[some], size[i]) >= num * np.maximum(size[some], size[i]))
                if not near.any():
                    continue
                if least not in read:
                    read[least] = _read_sketches(data[some].tolist(), least)
                near = np.flatnonzero(near)
                near = some[near[_may_link(_read_sketches([data[i]], least), read[least][near], size[i], size[some[near]], num, den)]]
                if len(near):
                    out.add(i)
                    out.update(near.tolist())
        at = np.array(sorted(out), dtype=np.int64)
        return pa.table({"x": pa.array(np.full(len(at), x)), "y": pa.array(np.full(len(at), y)), "doc_id": pa.array(doc[at])})

    loaded = _sides(pairs).join(blocks.select("block", "doc_id", "component", "size", "sketch"), "block")
    return saved(loaded.groupBy("x", "y").applyInArrow(pick, "x long, y long, doc_id long").distinct(), "likely")


def _block_links(likely: DataFrame, blocks: DataFrame, pieces: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of similar sets in different components, one for each two components of a pair of blocks."""
    loaded = likely.join(blocks.select("block", "doc_id", "component", "size", "hi", "lo"), "doc_id").where("block = x or block = y")
    loaded = loaded.join(pieces, ["hi", "lo"]).select("x", "y", "block", "doc_id", "component", "size", "hi", "fragments")

    def link(key: tuple, table: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        held: dict[int, dict[tuple, list[np.ndarray]]] = {x: {}, y: {}}
        columns = (table.column(c).to_pylist() for c in ("block", "doc_id", "component", "size", "hi"))
        for block, *doc, fragments in zip(*columns, table.column("fragments"), strict=True):
            held[block][tuple(doc)] = [f.values.to_numpy() for f in fragments]
        left, right = list(held[x]), list(held[y])
        size = lambda docs: np.array([d[2] for d in docs], dtype=np.int64)
        component = lambda docs: np.array([d[1] for d in docs], dtype=np.int64)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for at in range(0, len(left), TILE):
            some = left[at : at + TILE]
            shared = np.zeros((len(some), len(right)), dtype=np.int64)
            for f in range(COARSE_FRAGMENTS):  # each fragment by itself, summed for each pair
                shared += _overlaps([held[x][d][f] for d in some], [held[y][d][f] for d in right]).astype(np.int64)
            near = den * shared >= num * (size(some)[:, None] + size(right)[None, :] - shared)
            for i, j in zip(*np.nonzero(near & (component(some)[:, None] != component(right)[None, :])), strict=True):
                found.setdefault((some[i][1], right[j][1]), (some[i][0], right[j][0]))
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.int64()), "b": pa.array([b for _, b in found.values()], pa.int64())})

    return saved(loaded.groupBy("x", "y").applyInArrow(link, "a long, b long"), "block-links")


def _is_small(ids: DataFrame) -> bool:
    return ids.count() * 16 <= BROADCAST_BYTES


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``: broadcast if the ids are few, else a shuffled semi-join."""
    return docs.join(F.broadcast(ids) if _is_small(ids) else ids, "doc_id", "left_semi")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    Documents link when ``den * intersection >= num * union`` of their distinct lower-cased (A-Z) n-word shingles; a text
    of fewer words is one shingle, a null, empty or blank text has an empty set and links with nothing.  component_id is
    the smallest doc_id reachable over links.  Repeated rows give repeated rows.  Rows that share a doc_id are one
    document: a link of any of their texts counts.  A null doc_id links with nothing and has a null component_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = saved(describe_sets(docs, n), "sets")
    real = sets.where("size > 0 and doc_id is not null").distinct()
    reps = real.groupBy("hi", "lo", "size").agg(F.min("doc_id").alias("doc_id"))
    copies = real.join(reps.select("hi", "lo", F.col("doc_id").alias("b")), ["hi", "lo"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    reps = saved(reps, "representatives")
    copies = saved(copies, "copies")
    # Sets are in one row each unless ids repeat.
    unique = not sets.groupBy("doc_id").count().where("count > 1").limit(1).count()
    spare = copies.select(F.col("a").alias("doc_id"))
    if not unique:
        spare = spare.join(reps.select("doc_id"), "doc_id", "left_anti").distinct()
    # Copies would stand in all buckets of their representative.
    once = docs.join(F.broadcast(spare) if _is_small(spare) else spare, "doc_id", "left_anti")
    # A document of one text that is a copy hangs on its representative alone: no link of the graph.
    leaves = copies if unique else copies.join(real.groupBy("doc_id").count().where("count = 1").select(F.col("doc_id").alias("a")), "a", "left_semi")
    inner = copies.limit(0) if unique else copies.join(leaves.select("a"), "a", "left_anti")

    hubs = _with_hubs(once, n, num, den)
    # Representatives alone lose nothing; a hub is always one.
    members = saved(hubs.join(reps.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "members")
    starred = members.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    ids = saved(members.select("doc_id").unionByName(members.select(F.col("hub").alias("doc_id"))).distinct(), "ids")
    drawn = sketches(_only(docs, ids), n).join(reps.select("hi", "lo", "size"), ["hi", "lo"]).select("doc_id", "size", "hi", "lo", "sketch")
    drawn = saved(drawn.dropDuplicates(["doc_id", "hi", "lo"]), "sketches")
    pairs = saved(_promising(starred, drawn, num, den), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = saved(wanted, "wanted")
    pieces = _pieces(docs, wanted, n, unique)
    near = saved(_similar(pairs, pieces, num, den), "near")
    discard(pieces, wanted, pairs, ids)
    first = connected_components(inner.unionByName(near))

    # Members of one bucket that are still in different components: compared pair by pair, or block by block in large buckets.
    rows = members.select("segment", "doc_id", "hub").unionByName(members.select("segment", F.col("hub").alias("doc_id"), "hub").distinct())
    rows = rows.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = rows.groupBy("segment").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
    # Two members are the hub and one that was compared with it.
    rows = saved(rows.join(split.where("x <> y and members > 2").select("segment", "members"), "segment"), "split")
    discard(members)
    large = rows.where(F.col("members") > BUCKET_PAIRS)
    pairs = saved(_promising(_bucket_pairs(rows.where(F.col("members") <= BUCKET_PAIRS)), drawn, num, den), "pairs")
    blocks = saved(_blocks(large, drawn, num, den), "blocks")
    block_pairs = _block_pairs(large, blocks, num, den)
    discard(rows, drawn)
    likely = _likely(blocks, block_pairs, num, den)
    wanted = likely.select("doc_id").unionByName(pairs.select(F.col("a").alias("doc_id"))).unionByName(pairs.select(F.col("b").alias("doc_id")))
    wanted = saved(wanted.distinct(), "wanted")
    pieces = _pieces(docs, wanted, n, unique)
    close = saved(_similar(pairs, pieces, num, den), "close")
    more = _block_links(likely, blocks, pieces, num, den)
    discard(pieces, wanted, likely, blocks, block_pairs, pairs)
    last = connected_components(more.unionByName(close).unionByName(first.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    discard(more, close, near, reps)

    hanging = leaves.join(last, leaves.b == last.id, "left").select(leaves.a.alias("id"), F.coalesce("component", "b").alias("component"))
    last = last.unionByName(hanging)
    out = sets.join(last, sets.doc_id == last.id, "left")
    return out.select(sets.doc_id, F.col("size").alias("n_shingles"), F.coalesce("component", sets.doc_id).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of ``docs`` less all but the smallest doc_id of each group of linked documents.

    Of rows that share a doc_id one stays; documents without words and rows with a null doc_id stay.  All columns stay, whatever their names.
    """
    found = saved(jaccard_components(docs, n, num, den).select("doc_id", "component_id"), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    whole = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = whole.join(F.broadcast(gone) if _is_small(gone) else gone, "doc_id", "left_anti")
    twice = saved(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not twice.limit(1).count():
        return kept.select("row.*")
    shared = F.broadcast(twice) if _is_small(twice) else twice
    one = kept.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("row").alias("row"))
    return kept.join(shared, "doc_id", "left_anti").select("row.*").unionByName(one.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_ngram_jaccard_join over the whole of ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Plain self-join on shingles; components by a recursive walk over links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
