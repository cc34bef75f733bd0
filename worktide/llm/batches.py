"""Arrow columns of text inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once inside a task.
SLICE_BYTES = 4 << 20


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``limit`` bytes, or of one longer value."""
    if not len(array):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(array):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield array.slice(start, stop - start)
        start = stop


def raw(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; a null is empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its values; a null is empty."""
    values = pc.fill_null(array.cast(pa.large_binary()), b"")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = values.buffers()
    offsets = np.frombuffer(ends, np.int64, len(values) + 1, values.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, some of them at a time, so that memory does not follow
    the length of a text."""
    start, end = 0, len(text)
    while start < end:
        stop = start + size
        if stop < end:
            gap = _next_space(text, stop)
            stop = end if gap < 0 else gap
        words = text[start:stop].split()
        if words:
            yield words
        start = stop


def _next_space(text: bytes, start: int) -> int:
    step = 1 << 12
    while start < len(text):
        part = np.frombuffer(text, np.uint8, min(step, len(text) - start), start)
        found = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        if len(found):
            return start + int(found[0])
        start += step
    return -1


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """One array of the results of all slices."""
    if not parts:
        return pa.array([], kind)
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
