"""Exact BPE by backtracking over longest matches, and decoding by an offset table (operator 8).

An Aho-Corasick automaton gives the longest token at every position of a pre-token.  The encoder takes the longest token,
checks it against the token before by the pair-compatibility table (would the merges have joined anything across the border
first?), falls back to shorter tokens and then to the token before; positions that have failed are not tried again.
What comes out is what applying the merges in order gives.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeloom.llm.pretokens import WORD_PATTERN, is_odd, splitter, vocabulary_text
from treeloom.llm.resident import resident
from treeloom.llm.storage import table

VOCABULARY = "word_bpe_49k.json"
#: Entries of a worker's cache of pre-tokens, letters of those in it, and entries of its table of pairs.
CACHED, CACHED_LETTERS, PAIRS = 200_000, 40, 500_000
_END = "\x00"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class OffsetTable:
    """All strings of a list in one byte array; runs of ids are joined by one gather."""

    def __init__(self, strings: list[str]):
        data = [s.encode() for s in strings]
        self.sizes = np.array([len(x) for x in data], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(data), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


class Bpe:
    """A byte-level vocabulary with word ends, from the JSON of its file."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        ended = lambda s: s.removesuffix(suffix) + _END if suffix and s.endswith(suffix) and s != suffix else s
        by_text = {ended(s): i for s, i in ids.items()}
        self.length = [0] * len(self.names)
        self.left, self.right = list(range(len(self.names))), list(range(len(self.names)))
        # A token's age: letters are oldest (-1), others as old as the merge that makes them.
        self.age = [-1] * len(self.names)
        self.merged: dict[tuple[int, int], int] = {}
        for age, (a, b) in enumerate(map(tuple, model["merges"])):
            x, y, made = ids[a], ids[b], ids[a + b]
            self.merged[x, y] = made
            self.left[made], self.right[made], self.age[made] = x, y, age
        self.trie = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.names)
        for text, i in by_text.items():
            self.length[i] = len(text)
            self.trie.add_word(text, i)
            self.shorter[i] = next((by_text[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in by_text), -1)
        self.trie.make_automaton()
        self.letters = byte_letters()
        self.split = splitter(WORD_PATTERN)
        self.normalize = Tokenizer.from_str(vocabulary).normalizer.normalize_str
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b where they stand side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # Take the two apart again, youngest merge first.  A merge across the border that is older than the one taken
        # apart last would have come before it.  Of equals the left one came first.
        age, limit, last_left = self.age, len(self.names) + 1, True
        while True:
            made = self.merged.get((a, b))
            if made is not None and (age[made] < limit or not last_left and age[made] == limit):
                return False
            if age[a] < 0 and age[b] < 0:
                return True
            if age[a] > age[b]:
                limit, last_left, a = age[a], True, self.right[a]
            else:
                limit, last_left, b = age[b], False, self.left[b]

    def encode_word(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        word = "".join(map(self.letters.__getitem__, text.encode("utf-8", "surrogatepass"))) + _END
        size, length, shorter = len(word), self.length, self.shorter
        longest = [-1] * size
        for end, i in self.trie.iter(word):
            start = end + 1 - length[i]
            if longest[start] < 0 or length[longest[start]] < length[i]:
                longest[start] = i
        open_ = [True] * (size + 1)
        open_[size - 1] = False  # the end mark is part of the last letter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + length[token] if token >= 0 else -1
            if token >= 0 and open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif token >= 0 and shorter[token] >= 0:
                token = shorter[token]
            elif out:
                open_[at] = False
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError(f"no tokens for {text!r}")
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        at = 0
        for hit in [*self.find_special.finditer(text), None] if "<" in text else [None]:
            piece = text[at : hit.start()] if hit else text[at:]
            if piece:
                # Latin texts are composed already; the file's own normaliser serves others (its Unicode tables may be newer).
                piece = self.normalize(piece) if is_odd(piece) else piece.lower()
                cache = self.cache
                for word in self.split(piece):
                    ids = cache.get(word)
                    if ids is None:
                        if len(cache) >= CACHED:
                            cache.clear()
                        ids = self.encode_word(word)
                        if len(word) <= CACHED_LETTERS:
                            cache[word] = ids
                    out += ids
            if hit:
                out.append(self.special[hit.group()])
                at = hit.end()
        return out

    @cached_property
    def tables(self) -> tuple[OffsetTable, OffsetTable]:
        """Names, and decimal ids, each with a space behind."""
        return OffsetTable([f"{s} " for s in self.names]), OffsetTable([f"{i} " for i in range(len(self.names))])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The library's text for ids: without a decoder in the file, token names with spaces between."""
        return self.tables[0].join(np.asarray(ids, dtype=np.int64))[:-1].decode()


def bpe(vocabulary: str) -> Bpe:
    """The tables of a vocabulary, kept by the worker until another operator runs there."""
    return resident(("bpe", hashlib.sha256(vocabulary.encode()).hexdigest()), lambda: Bpe(vocabulary))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text); null texts are empty: no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.encode(s.as_py() or "") for s in part.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of each row of ``coded`` (doc_id, ids); null ids give the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(s.as_py() or []) for s in batch.column(1)], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def _digester(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(shared.value)
        names, numbers = model.tables
        digest = lambda data: hashlib.sha256(data[:-1]).hexdigest()
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1):
                ids = np.array(model.encode(text.as_py() or ""), dtype=np.int64)
                n.append(len(ids))
                coded.append(digest(numbers.join(ids)))
                decoded.append(digest(names.join(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def coded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs`` (doc_id, text): encoded, then decoded.

    Null texts count as empty and give the digest of nothing.  Repeated rows and null ids are coded each; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(_digester(shared), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_bpe_coding over the whole of ``documents``."""
    return coded_digests(table(spark, sf_dir, "documents"), vocabulary_text(VOCABULARY))
