"""Vectorised word and shingle hashing of many texts at once.

A *word* is a maximal run of code points other than space and U+0009..U+000D.  Texts are handled as one UTF-8
buffer: a polynomial prefix sum (mod 2**64) gives every word a 64-bit key without a Python loop over words, and
word keys combine into shingle keys the same way.  Keys are the same on every machine and in every process.

Null texts count as empty.  Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_MASK = (1 << 64) - 1
#: Odd multipliers; any odd numbers would do.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_CHUNK_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random-looking 64-bit value for each byte value.
_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


class Words:
    """The words of a run of texts: keys, byte spans in ``buffer``, and each text's range of words."""

    __slots__ = ("buffer", "keys", "starts", "ends", "first")

    def __init__(self, buffer, keys, starts, ends, first):
        self.buffer, self.keys, self.starts, self.ends, self.first = buffer, keys, starts, ends, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def hash_words(texts: list[bytes], lower: bool = False) -> Words:
    """Words of ``texts`` (UTF-8); ``first[i]:first[i+1]`` are those of text i.  ``lower`` folds A-Z only."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_start = np.concatenate([[0], np.cumsum(lengths)])
    if not len(buffer):
        none = np.zeros(0, dtype=np.int64)
        return Words(buffer, none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    inside = ~_SPACE[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the buffer ends in a newline, so the edges pair up
    power = _power_table(_BYTE_BASE, len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_KEYS[buffer] * power[: len(buffer)], out=sums[1:])
    # Shift every word to exponent 0 by the inverse power, so that equal words have equal keys.
    inverse = _power_table(pow(_BYTE_BASE, -1, 1 << 64), len(buffer) + 1)
    keys = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(buffer, keys, starts, ends, np.searchsorted(starts, text_start))


def shingle_keys(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-word windows within texts, and each text's range of them.

    A text of fewer than n words has none.
    """
    keys, first = words.keys, words.first
    total = len(keys)
    per = np.maximum(np.diff(first) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(per)])
    if total < n or not bounds[-1]:
        return np.zeros(0, dtype=np.uint64), bounds
    acc = np.zeros(total - n + 1, dtype=np.uint64)
    for i in range(n):
        acc = acc * np.uint64(_WORD_BASE) + keys[i : total - n + 1 + i]
    at = np.repeat(first[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    return mix64(acc[at]), bounds


def sequence_key(keys: np.ndarray) -> int:
    """Key of a whole word sequence, for texts that have too few words for a window."""
    acc = 0
    for k in keys.tolist():
        acc = (acc * _WORD_BASE + k) & _MASK
    return int(mix64(np.array([(acc + len(keys)) & _MASK], dtype=np.uint64))[0])


def chunks(texts: Iterable[str | bytes | None], size: int = _CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in runs of about ``size`` bytes, to bound the arrays' memory (some 40 times that)."""
    at, held, run = 0, 0, []
    for i, text in enumerate(texts):
        data = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if run and held + len(data) > size:
            yield at, run
            at, held, run = i, 0, []
        run.append(data)
        held += len(data)
    if run:
        yield at, run
