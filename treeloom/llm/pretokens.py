"""Splitting text into pre-tokens as the public BPE vocabularies' patterns do."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Code points for which the letter and number classes below are complete: ASCII without control characters other than
#: white space, Latin letters and signs up to U+024F, and dashes, quotes and currency signs.
_PLAIN = re.compile("[^\t-\r -~¡-ɏ‐-‧‰-⁞₠-₿]")
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = " \t-\r"
# The split patterns of the two vocabulary files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{L0}{N0}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{S}{L0}{N0}]+"


def is_odd(text: str) -> bool:
    """Whether ``text`` has code points beyond the plain ones."""
    return _PLAIN.search(text) is not None or "İ" in text


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that splits a text by ``pattern``; the faster engine serves texts of plain code points."""
    fast = re.compile(pattern.format(L=f"[{_L}]", N=f"[{_N}]", L0=_L, N0=_N, S=_S))
    full = regex.compile(pattern.format(L=r"\p{L}", N=r"\p{N}", L0=r"\p{L}", N0=r"\p{N}", S=r"\p{White_Space}"))
    find_fast, find_full, odd = fast.findall, full.findall, _PLAIN.search

    def split(text: str) -> list[str]:
        return find_full(text) if odd(text) else find_fast(text)

    return split


def vocabulary_text(name: str, folder: str | None = None) -> str:
    """The JSON of a public tokenizer file, read on the driver; ``folder`` overrides where the files lie."""
    if folder:
        path = f"{folder.rstrip('/')}/{name}"
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        return file.read()
