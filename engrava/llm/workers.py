"""Memory of Python workers, which Spark keeps from one task to the next and which share an executor's memory with its JVM."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # a C library without it
    _trim = None


def give_back() -> None:
    """Hand memory that is free but held by allocators back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(batches: Iterable, tokenizing: bool = False) -> Iterator:
    """``batches``, with what was made of one given back before the next. A worker that turns to anything but ``tokenizing`` drops its tokenizers."""
    tokens = sys.modules.get("engrava.llm.tokens")
    if tokens and not tokenizing:
        tokens.word_tokenizer.cache_clear()
    for batch in batches:
        yield batch
        del batch
        give_back()
