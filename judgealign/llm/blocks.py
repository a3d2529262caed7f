"""Views of Arrow batches as numpy arrays, in slices of bounded size. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"


def body_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without copying, and the offsets of its rows (one more than rows)."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    size = len(column)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + size + 1] if size else np.zeros(1, np.int32)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes in ``column`` (a longer row comes alone)."""
    _, offsets = body_of(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(rows, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def owner_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(offsets, positions, side="right") - 1


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the given schema from arrays."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a run of equal keys, from sorted batches.

    A table is larger only where one run is; what is held is one batch and the run that it left open.
    """
    held: list[pa.RecordBatch] = []

    def pieces(whole: pa.Table, last: bool) -> Iterator[pa.Table]:
        change = np.zeros(max(0, whole.num_rows - 1), bool)
        for name in key:
            values = whole.column(name).to_numpy()
            change |= values[1:] != values[:-1]
        bounds = np.r_[np.flatnonzero(change) + 1, [whole.num_rows] if last else []].astype(np.int64)
        start = 0
        while len(bounds) and start < bounds[-1]:
            end = int(bounds[min(np.searchsorted(bounds, start + rows), len(bounds) - 1)])
            yield whole.slice(start, end - start).combine_chunks()
            start = end
        held[:] = whole.slice(start).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from pieces(pa.Table.from_batches(held).combine_chunks(), False)
    if held:
        yield from pieces(pa.Table.from_batches(held).combine_chunks(), True)


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after
