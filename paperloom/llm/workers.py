"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return what Arrow and numpy have freed to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; after its last batch the worker returns the memory it no longer uses.

    Spark keeps a worker for later tasks, and a process keeps what it has freed: without this, every
    worker of an executor stays at the size of its largest task.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
