"""What Python workers hold between tasks: Spark keeps them, and each serves tasks of any step in turn."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Memory that is free within the worker goes back to the machine; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def lean(step: Step, encodes: bool = False) -> Step:
    """``step`` for mapInArrow, giving memory back when a task ends. Encoders with their words stay from task to task of
    steps that encode (``encodes``); a task of any other step drops them first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("zonemill.llm.tokens")
        if tokens is not None and not encodes and tokens.encoder.cache_info().currsize:
            tokens.encoder.cache_clear()
            give_back()
        yield from step(batches)
        give_back()
    return run
