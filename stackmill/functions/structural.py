"""Structural indexing of text columns: numpy masks over the bytes of a whole Arrow batch.

The bytes of all values of a batch lie in one buffer. Delimiters, line ends and nesting are found
for all values at once with masks and prefix sums; no loop runs over characters or rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
UPPER_OR_DIGIT = UPPER.copy()
UPPER_OR_DIGIT[48:58] = True


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices ``data[starts[i]:ends[i]]`` as a string array."""
    lengths = np.maximum(ends - starts, 0)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    picked = np.ascontiguousarray(data[index]) if len(index) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(picked))


def trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices without the white space around them; an all-blank slice becomes empty."""
    n = len(data)
    solid = np.flatnonzero(~SPACE[data])
    if len(solid) == 0 or n == 0:
        return starts, starts.copy()
    after = np.searchsorted(solid, starts, "left")
    first = np.where(after < len(solid), solid[np.minimum(after, len(solid) - 1)], n)
    before = np.searchsorted(solid, ends, "left") - 1
    last = np.where(before >= 0, solid[np.maximum(before, 0)], -1) + 1
    first, last = np.minimum(first, ends), np.maximum(last, starts)
    return first, np.where(last < first, first, last)


def rtrim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the slices without white space at the end."""
    solid = np.flatnonzero(~SPACE[data])
    before = np.searchsorted(solid, ends, "left") - 1
    last = np.where(before >= 0, solid[np.maximum(before, 0)], -1) + 1 if len(solid) else starts
    return np.maximum(last, starts)


def line_index(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record number, start and end of every line that is not blank, trailing white space cut off.

    A line ends at LF, CR or the end of its record.
    """
    breaks = np.flatnonzero((data == 10) | (data == 13))
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    if len(starts) == 0:
        return starts, starts, starts
    record = np.searchsorted(offsets, starts, "right") - 1
    next_break = np.searchsorted(breaks, starts, "left")
    to_break = np.where(next_break < len(breaks), breaks[np.minimum(next_break, max(len(breaks) - 1, 0))] if len(breaks) else len(data), len(data))
    ends = rtrim(data, starts, np.minimum(to_break, offsets[record + 1]))
    kept = ends > starts
    return record[kept], starts[kept], ends[kept]
