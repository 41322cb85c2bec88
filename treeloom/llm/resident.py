"""What a Python worker keeps between tasks: one large object at a time, whichever operator ran last."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: list[tuple[Hashable, Any]] = []


def vacate() -> None:
    """Drop what is kept, and hand freed memory back to the machine; for operators that keep nothing."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object of ``key``, built at its first use; it takes the place of another one."""
    if not _kept or _kept[0][0] != key:
        vacate()
        _kept.append((key, build()))
    return _kept[0][1]
