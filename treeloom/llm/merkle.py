"""Merkle manifest of a data set, with a proof for every row (operator 11).

Rows are leaves; those of a source, by doc_id, form a tree in which runs of three nodes become one, and the sources' subroots form
one more tree of the same kind, whose root stands for the data set.

Checkpoint and recompute: of all levels only every ``HEIGHT``-th is written, as aligned blocks of 3 ** HEIGHT nodes, a row for each
block.  A block's task works out its levels in memory and keeps the top one.  Proofs go down again from the root: a block's
task regenerates its interior nodes from the stored ones, emits each node's siblings below those of the block, and drops the rest.
So a lost executor costs one level, blocks are bounded whatever a source holds, and texts are read once and never shuffled.

Places within a source are global: rows are range partitioned by source, doc_id and leaf and written with their number in the
partition; the counts before come from a row for each source and partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.resident import vacate
from treeloom.llm.storage import discard, saved, table

FANOUT, HEIGHT = 3, 4
#: Rows that a task sends at once.
_BATCH = 4096
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """Digest (binary) of values as "-" for null, else UTF-8 bytes of the value, ":", the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def node_hash(children: list[bytes]) -> bytes:
    """Digest of a run of nodes: their hex texts, joined."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def levels_of(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """A block's nodes and those above, ``height`` levels of them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([node_hash(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def _height(nodes: int) -> int:
    """Levels from a block up to the next stored level: HEIGHT, or what a whole tree of so many nodes needs."""
    n, found = nodes, 0
    while n > 1 and found < HEIGHT:
        n, found = -(-n // FANOUT), found + 1
    return found


def path_of(levels: list[list[bytes]], at: int) -> bytes:
    """Siblings of node ``at``, a level after the other: place in the run, number of siblings, their digests."""
    out = bytearray()
    for level in levels[:-1]:
        first = at - at % FANOUT
        others = level[first:at] + level[at + 1 : first + FANOUT]
        out += bytes((at - first, len(others)))
        for s in others:
            out += s
        at //= FANOUT
    return bytes(out)


def _steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for place, others in _steps(path):
        leaf = node_hash([*others[:place], leaf, *others[place:]])
    return leaf


def proof_hash(path: bytes) -> str:
    """Hex digest of all siblings, from the leaf's level to the root's."""
    return sha256("".join(s.hex() for _, others in _steps(path) for s in others).encode()).hexdigest()


def _placed(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (tree, ...) with their place ``idx`` in their tree and its size ``nodes``, trees and rows by ``order``; and the written table that this reads.

    Rows that are equal in ``order`` are dealt out by a random number, so that they don't share a task.
    """
    dealt = rows.withColumn("_deal", F.rand(11))
    # monotonically_increasing_id: partition in the upper bits, row number in the lower 33.  Written at once, so it holds for all that reads it.
    ranged = saved(dealt.repartitionByRange("tree", *order, "_deal").sortWithinPartitions("tree", *order, "_deal").drop("_deal").withColumn("_at", F.monotonically_increasing_id()), name)
    part, nth = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy("tree", part.alias("_part")).agg(F.min(nth).alias("_least"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("tree")  # a row for each partition that the tree reaches into
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "_part", (before - F.col("_least")).alias("_start"), F.sum("_rows").over(whole).alias("nodes"))
    return ranged.withColumn("_part", part).join(starts, ["tree", "_part"]).withColumn("idx", F.col("_start") + nth).drop("_part", "_start", "_at"), ranged


def _blocks(nodes: DataFrame, payload: list[str], name: str) -> DataFrame:
    """A stored level: (tree, block, nodes, items), items being the block's (idx, node, payload...) in order.

    A block has at most FANOUT ** HEIGHT items and always the same key, so groups are bounded.
    """
    items = F.sort_array(F.collect_list(F.struct("idx", "node", *payload)))
    return saved(nodes.groupBy("tree", F.expr(f"idx div {FANOUT**HEIGHT}").alias("block")).agg(F.max("nodes").alias("nodes"), items.alias("items")), name)


def _tops(blocks: DataFrame) -> DataFrame:
    """(tree, idx, node, nodes) of the next stored level: the top of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            tops = [levels_of(nodes.as_py(), _height(n.as_py()))[-1][0] for n, nodes in zip(batch.column(2), batch.column(3), strict=True)]
            above = [-(-n.as_py() // FANOUT**HEIGHT) for n in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tops, pa.binary()), pa.array(above, pa.int64())], ["tree", "idx", "node", "nodes"])

    return blocks.select("tree", "block", "nodes", "items.node").mapInArrow(run, "tree string, idx long, node binary, nodes long")


def _climb(nodes: DataFrame, payload: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels of a forest, from its leaves on, and (tree, node) of the roots."""
    stored = [_blocks(nodes, payload, f"{name}-0")]
    while stored[-1].where("block > 0").limit(1).count():
        stored.append(_blocks(_tops(stored[-1]), [], f"{name}-{len(stored)}"))
    return stored, _tops(stored[-1]).select("tree", "node")


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, idx, path) of the nodes of a stored level that isn't the leaves'; ``above``: (tree, idx, path) of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["tree", "idx", "path"])

        held: list[tuple[str, int, bytes]] = []
        for batch in batches:
            for tree, block, n, nodes, path in zip(*(batch.column(i) for i in range(5)), strict=True):
                levels, name, first, upper = levels_of(nodes.as_py(), _height(n.as_py())), tree.as_py(), block.as_py() * FANOUT**HEIGHT, path.as_py()
                held += ((name, first + i, path_of(levels, i) + upper) for i in range(len(levels[0])))
                if len(held) >= _BATCH:
                    yield sent()
                    held = []
        if held:
            yield sent()

    joined = blocks.join(above.withColumnRenamed("idx", "block"), ["tree", "block"]).select("tree", "block", "nodes", "items.node", "path")
    return joined.mapInArrow(run, "tree string, idx long, path binary")


def _descend(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, path) for the blocks of the leaves' level; ``above``: (tree, path) of the roots."""
    paths = above.withColumn("idx", F.lit(0).cast("long"))
    for blocks in reversed(stored[1:]):
        paths = _paths(blocks, paths)
    return paths.withColumnRenamed("idx", "block")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs`` (FIELDS).

    Null sources form a tree of their own, the first; null doc_ids come first in theirs, and have nothing to be tampered with.  Rows of
    one doc_id and source stand by their leaf; equal rows have equal leaves and places of their own.  Null and empty texts are different leaves.
    An empty table gives no rows.  Tampering deletes the line ends of texts whose doc_id has an even CRC-32.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [F.col(f) for f in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = leaf_hash([*fields[:-1], F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))])
    # "" sorts before all other names: the null source
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_hash(fields).alias("node"), F.when(even & F.contains("text", F.lit("\n")), changed).alias("tampered"))
    placed, written = _placed(leaves, ["doc_id", "node"], "merkle-leaves")
    stored, roots = _climb(placed, ["doc_id", "tampered"], "merkle")
    discard(written)
    subroots = saved(roots, "merkle-subroots")
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    ranked, written = _placed(top, ["source"], "merkle-sources")
    top_stored, root = _climb(ranked, ["source"], "merkle-top")
    discard(written)
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    one = root.select("node").first()
    if one is None:
        return docs.sparkSession.createDataFrame([], schema)
    goal = bytes(one.node)
    above = _leaf_paths(top_stored[0], _descend(top_stored, docs.sparkSession.createDataFrame([("", bytearray())], "tree string, path binary")))
    # A row for each source and block.
    blocks = stored[0].join(_descend(stored, above.select("tree", "path")), ["tree", "block"]).join(subroots.select("tree", F.col("node").alias("subroot")), "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, zip(*held, strict=True))], schema_names)

        ids, held = [], []
        for batch in batches:
            for n, items, path, subroot in zip(*(batch.column(i) for i in range(4)), strict=True):
                nodes, tampered = items.values.field("node").to_pylist(), items.values.field("tampered").to_pylist()
                levels, upper, sub = levels_of(nodes, _height(n.as_py())), path.as_py(), subroot.as_py().hex()
                ids.append(items.values.field("doc_id"))
                for i, leaf in enumerate(nodes):
                    way = path_of(levels, i) + upper
                    folded = fold(tampered[i] or leaf, way)
                    held.append((leaf.hex(), sub, goal.hex(), proof_hash(way), folded.hex(), folded == goal))
                if len(held) >= _BATCH:
                    yield sent()
                    ids, held = [], []
        if held:
            yield sent()

    schema_names = [part.split()[0] for part in schema.split(", ")]
    return blocks.select("nodes", "items", "path", "subroot").mapInArrow(run, schema)


def _leaf_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, path) of each source: the way of its subroot to the root."""
    nodes = _paths(blocks.select("tree", "block", "nodes", "items"), above.withColumnRenamed("block", "idx"))
    names = blocks.select(F.explode("items").alias("item")).select(F.col("item.idx").alias("idx"), F.col("item.source").alias("source"))
    return nodes.join(names, "idx").select(F.col("source").alias("tree"), "path")


#: Levels by recursion; siblings of all levels by the leaf's run; the fold by recursion over them.
ORACLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT *, row_number() OVER () AS r,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(doc_id::VARCHAR)),
      lambda i: list_transform(range(8), lambda b: (ascii(substr(doc_id::VARCHAR, i + 1, 1)) >> b) & 1)))),
      lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc
  FROM documents),
fields AS (
  SELECT *, CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered_text FROM base),
hashed AS (
  SELECT doc_id, source, r, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(tampered_text))::VARCHAR || ':' || tampered_text, '-')) AS tampered
  FROM (SELECT *, coalesce(length(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
    || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-') || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-')
    || coalesce(length(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM fields)),
leaves AS (
  SELECT *, coalesce('+' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS nodes FROM hashed),
low(tree, level, idx, h, nodes) AS (
  SELECT tree, 0, idx, leaf, nodes FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (max(nodes) + 2) // 3 FROM low WHERE nodes > 1 GROUP BY tree, level, idx // 3),
subroots AS (
  SELECT tree, level AS height, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS nodes FROM low WHERE nodes = 1),
high(level, idx, h, nodes) AS (
  SELECT 0, idx, h, nodes FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (max(nodes) + 2) // 3 FROM high WHERE nodes > 1 GROUP BY level, idx // 3),
root AS (SELECT h, level AS height FROM high WHERE nodes = 1),
steps AS (
  SELECT l.r, x.level, l.idx // (3 ** x.level)::BIGINT AS at, string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < l.idx // (3 ** x.level)::BIGINT) AS before,
    string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > l.idx // (3 ** x.level)::BIGINT) AS after
  FROM leaves l JOIN low x ON x.tree = l.tree AND x.nodes > 1 AND x.idx // 3 = l.idx // (3 ** (x.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l.r, s.height + x.level, s.idx // (3 ** x.level)::BIGINT, string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < s.idx // (3 ** x.level)::BIGINT),
    string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > s.idx // (3 ** x.level)::BIGINT)
  FROM leaves l JOIN subroots s USING (tree) JOIN high x ON x.nodes > 1 AND x.idx // 3 = s.idx // (3 ** (x.level + 1))::BIGINT GROUP BY ALL),
proofs AS (SELECT r, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY level) AS siblings FROM steps GROUP BY r),
folded(r, level, h) AS (
  SELECT r, 0, tampered FROM leaves
  UNION ALL
  SELECT f.r, f.level + 1, sha256(coalesce(s.before, '') || f.h || coalesce(s.after, '')) FROM folded f JOIN steps s ON s.r = f.r AND s.level = f.level)
SELECT l.doc_id, l.leaf, s.h AS subroot, root.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN root LEFT JOIN proofs p ON p.r = l.r JOIN folded f ON f.r = l.r AND f.level = s.height + root.height
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_merkle_manifest over the whole of ``documents``."""
    return manifest(table(spark, sf_dir, "documents"))
