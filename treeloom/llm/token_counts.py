"""Token counts by a map-side two-tier lookup (operator 7).

Tier one is a broadcast table of the lengths, in tokens, of the most frequent pre-tokens of the corpus; tier two is a
bounded cache in each worker, whose misses the tokenizer encodes.  Pre-tokens are never shuffled: to find the frequent
ones, each task keeps a bounded count of its own and sends its leaders only.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.pretokens import BYTE_PATTERN, splitter, vocabulary_text
from treeloom.llm.resident import resident
from treeloom.llm.storage import table

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens in the broadcast table, sent by a task, and counted by a task at once; entries of a worker's cache, and letters of those in it.
FREQUENT, LEADERS, COUNTED, CACHED, CACHED_LETTERS = 32_768, 4_096, 200_000, 400_000, 64


def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary)


def _worker(vocabulary: str) -> tuple:
    """The library's tokenizer and the cache of lengths, kept by the worker until another operator runs there."""
    return resident(("token-counts", hashlib.sha256(vocabulary.encode()).hexdigest()), lambda: (_tokenizer(vocabulary), {}))


def _lengths(tokenizer, pretokens: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]


def _specials(vocabulary: str):
    """A function text -> (pieces between special strings, number of special strings), as the library splits."""
    import json
    import re

    added = [x["content"] for x in json.loads(vocabulary)["added_tokens"]]
    found = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def split(text: str) -> tuple[list[str], int]:
        if found is None or "<" not in text:
            return [text], 0
        pieces = found.split(text)
        return pieces, len(pieces) - 1

    return split


def frequent_pretokens(texts: DataFrame, size: int = FREQUENT) -> list[str]:
    """Frequent pre-tokens of all of ``texts`` (text), at most ``size``: the leaders of the tasks' bounded counts."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = splitter(BYTE_PATTERN), Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(split(text.as_py() or ""))
                if len(count) > COUNTED:
                    count = Counter(dict(count.most_common(COUNTED // 4)))
        top = count.most_common(LEADERS)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    leaders = texts.select("text").mapInArrow(lead, "pretoken string, n long")
    top = leaders.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(size)
    return [r.pretoken for r in top.collect()]  # at most ``size`` rows


def _counter(vocabulary: Broadcast, frequent: Broadcast):
    """mapInArrow function (doc_id, text) -> counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split, special = frequent.value, splitter(BYTE_PATTERN), _specials(vocabulary.value)
        (tokenizer, cache), get = _worker(vocabulary.value), known.get
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                pieces, total = special(text)
                for piece in pieces:
                    found = split(piece)
                    lengths = list(map(get, found))
                    if None in lengths:
                        missed = [t for t, n in zip(found, lengths, strict=True) if n is None]
                        new = [t for t in set(missed) if t not in cache]
                        if len(cache) + len(new) > CACHED:
                            cache.clear()
                            new = list(set(missed))
                        sizes_of = dict(zip(new, _lengths(tokenizer, new), strict=True)) if new else {}
                        cache.update((t, n) for t, n in sizes_of.items() if len(t) <= CACHED_LETTERS)
                        total += sum(sizes_of[t] if t in sizes_of else cache[t] for t in missed) + sum(n for n in lengths if n)
                    else:
                        total += sum(lengths)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                counts.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, over: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text).

    Counts are the library's for the whole text, special strings being one token.  Null texts count as empty: 0
    tokens.  Repeated rows and null ids are counted each; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    known = frequent_pretokens(docs)
    lengths = _lengths(_tokenizer(vocabulary), known) if known else []
    shared, sent = context.broadcast(vocabulary), context.broadcast(dict(zip(known, lengths, strict=True)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(_counter(shared, sent), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_token_counts over the whole of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_text(VOCABULARY))
