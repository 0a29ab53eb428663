"""Words of whole batches of texts at once, and lists of ascending numbers as bytes.

A word is a longest run of 0-9, a-z and characters beyond ASCII, after A-Z have been lower-cased; other letters keep
their case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A byte of UTF-8 as a byte of a word, or a space. All bytes of a character beyond ASCII are 128 or more.
_LOWERED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of an array of strings: the number of each word in order, the distinct words by number, and how many each text has.

    A null is a text without words.
    """
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer((b" " + b" ".join(raw) + b" ").translate(_LOWERED), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = flat.dictionary_encode()
    text_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def cut_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_bytes of the column; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // most_bytes
        at = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows])) if batch.num_rows else np.array([0])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers >= 0 in seven bits a byte, the last byte of each below 128, and where in these bytes each list begins.

    starts: the places in values where lists begin, and the end.
    """
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >> (7 * k) > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - size
    for k in range(int(size.max(initial=0))):
        have = size > k if k else slice(None)
        rest = values[have] >> (7 * k)
        out[first[have] + k] = (rest & 127) | ((size[have] > k + 1).astype(np.int64) << 7)
    return out, np.concatenate((first, ends[-1:] if len(ends) else [0]))[starts]


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What packed() made: the numbers and, for each, where its last byte is."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    size = last - first + 1
    values = (data[first] & 127).astype(np.int64)
    for k in range(1, int(size.max(initial=1))):
        have = size > k
        values[have] |= (data[first[have] + k] & 127).astype(np.int64) << (7 * k)
    return values, last


def gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each number of the ascending lists less the one before it; the first of a list as it is."""
    out = np.diff(values, prepend=0)
    begin = starts[:-1][starts[:-1] < starts[1:]]
    out[begin] = values[begin]
    return out


def summed(deltas: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What gaps() was made of."""
    total = np.cumsum(deltas)
    before = np.concatenate(([0], total))[starts[:-1]]
    return total - np.repeat(before, np.diff(starts))


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of the bytes as an array of binaries."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binaries without nulls, one after another, and where each begins, and the end."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
