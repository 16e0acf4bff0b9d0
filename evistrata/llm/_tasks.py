"""Helpers of functions that run inside tasks on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def key_chunks(batches: Iterator[pa.RecordBatch], rows: int, column: int = 0) -> Iterator[pa.Table]:
    """Regroup batches sorted by an integer column into tables of about ``rows`` rows that never split a key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut == 0 and held[:-1] and held[-2].column(column)[-1].as_py() == keys[-1]:
            continue  # the last key fills this batch and began before it
        done = [*held[:-1], batch.slice(0, cut)]
        held, count = [batch.slice(cut)], batch.num_rows - cut
        if sum(x.num_rows for x in done):
            yield pa.Table.from_batches(done)
    if count:
        yield pa.Table.from_batches(held)


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, after which a task gives spare memory back to the system, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def give_back() -> None:
    """What Arrow's pool and, where the C library can, its heap hold without use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def record(**cols: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+counts[0]-1, then starts[1] .., as one array."""
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
