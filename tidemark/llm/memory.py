"""Gives memory that a Python worker has freed back to the machine.

Workers live on between tasks, beside the executor's JVM, and the allocator keeps freed arrays for later; over the
stages of a job that adds up to hundreds of megabytes an executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy_batches(run: Callable) -> Callable:
    """For mapInArrow: memory goes back when a task's rows are through."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """For applyInArrow: memory goes back after each group."""

    def tidied(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        trim()
        return out

    return tidied


def tidy_pair(run: Callable) -> Callable:
    """The same for two tables of a group."""

    def tidied(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        trim()
        return out

    return tidied
