"""Vectors of a table as numpy matrices, and packed into bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are handled together, in several Arrow batches where these are smaller.
ROWS = 16_384


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows, their vectors as doubles) of an Arrow list column,
    without null vectors and those with a null or non-finite component.
    Vectors of different lengths have no defined result and raise."""
    at = np.flatnonzero(np.asarray(column.is_valid()))
    lists = column.drop_null()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(lists.value_lengths(), np.int64)
    if not len(at):
        return at, np.empty((0, 0))
    if sizes.min() != sizes.max():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.zeros(len(sizes), bool)
        bad[owner[~np.isfinite(flat)]] = True
        if len(set(sizes[~bad].tolist())) > 1:
            raise ValueError("vectors of different lengths")
        flat, at, sizes = flat[~bad[owner]], at[~bad], sizes[~bad]
        if not len(at):
            return at, np.empty((0, 0))
    matrix = flat.reshape(len(at), int(sizes[0]))
    good = np.isfinite(matrix).all(axis=1)
    return at[good], matrix[good]


def floors(matrix: np.ndarray, times: int) -> np.ndarray:
    """``floor(times * x)`` of every component as whole numbers."""
    low = np.floor(matrix * times)
    if low.size and np.abs(low).max() >= 2.0 ** 62:
        raise OverflowError("a component is beyond 64-bit whole numbers")
    return low.astype(np.int64)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of whole numbers as bytes, in the narrowest type that holds
    it, so that equal rows are equal bytes."""
    if not rows.size:
        return pa.array([b""] * len(rows), pa.binary())
    most = np.maximum(rows.max(axis=1), -(rows.min(axis=1) + 1))
    kinds = np.digitize(most, [1 << 15, 1 << 31])
    out = np.empty(len(rows), object)
    for k, kind in enumerate((np.int16, np.int32, np.int64)):
        own = np.flatnonzero(kinds == k)
        raw, width = rows[own].astype(kind).tobytes(), rows.shape[1] * np.dtype(kind).itemsize
        out[own] = [raw[i * width:(i + 1) * width] for i in range(len(own))]
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers of :func:`packed` rows of ``dim`` components."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]) if len(column) else np.empty(0, np.int32)
    out = np.zeros((len(column), dim), np.int64)
    if dim:
        values = column.to_pylist()
        for kind in (np.int16, np.int32, np.int64):
            own = np.flatnonzero(sizes == dim * np.dtype(kind).itemsize)
            if len(own):
                out[own] = np.frombuffer(b"".join([values[i] for i in own]), kind).reshape(len(own), dim)
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield _one(held)
            held = []
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
