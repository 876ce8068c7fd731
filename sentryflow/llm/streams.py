"""Reading sorted partitions group by group, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[dict]:
    """Groups of equal ``keys`` (non-null longs) of a partition sorted by them; groups of under ``least`` rows are skipped.

    A group is a dict of column name to numpy array, or list for binary columns.
    Memory is one batch and one group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and _key(rest[-1], keys, -1) == _key(batch, keys, -1) == _key(batch, keys, 0):
            rest.append(batch)
            continue
        whole = pa.Table.from_batches([*rest, batch]).combine_chunks()
        whole = whole.to_batches()[0]
        starts = _starts(whole, keys)
        yield from _cut(whole, starts, least)
        rest = [whole.slice(int(starts[-1]))]
    if rest:
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        yield from _cut(whole, np.array([0, whole.num_rows]), least)


def _key(batch: pa.RecordBatch, keys: list[str], at: int) -> tuple:
    at = at % batch.num_rows
    return tuple(batch.column(k)[at].as_py() for k in keys)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.nonzero(new)[0]


def _cut(batch: pa.RecordBatch, starts: np.ndarray, least: int) -> Iterator[dict]:
    """The groups between successive starts; what follows the last start is not yet complete."""
    sizes = np.diff(starts)
    for i in np.nonzero(sizes >= least)[0]:
        part = batch.slice(int(starts[i]), int(sizes[i]))
        yield {
            name: part.column(j).to_pylist() if pa.types.is_binary(part.schema.types[j]) or pa.types.is_string(part.schema.types[j]) else part.column(j).to_numpy(zero_copy_only=False)
            for j, name in enumerate(part.schema.names)
        }
