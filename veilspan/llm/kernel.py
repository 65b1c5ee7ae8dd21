"""Vectorised word work on Arrow string columns: no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows on end, and where each row begins (one more entry than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of ``column`` (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, at = bytes_of(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < n:
        end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
        end = min(n, max(end, begin + 1))
        yield batch.slice(begin, end - begin)
        begin = end


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each word and, by row, the index of its first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    w = data != 32 if is_word is None else is_word
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = w[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = w[edge]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1 - begins, np.searchsorted(begins, at)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers (in place where it can)."""
    x = x ^ (x >> np.uint64(32))
    x *= _P1
    x ^= x >> np.uint64(29)
    x *= _P2
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = eight[begins] & _MASK[np.minimum(lengths, 8)]
    h ^= lengths.astype(np.uint64) * _P2
    h *= _P1
    h ^= h >> np.uint64(32)
    rest, k = np.flatnonzero(lengths > 8), 8
    while len(rest):
        left = lengths[rest] - k
        block = eight[begins[rest] + k] & _MASK[np.minimum(left, 8)]
        part = (h[rest] ^ block) * _P1
        h[rest] = part ^ (part >> np.uint64(32))
        rest, k = rest[left > 8], k + 8
    return mix(h)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows on end, and where each row's begin. Words are parted by single spaces."""
    data, at = bytes_of(column)
    begins, lengths, rows = word_spans(data, at)
    return word_hashes(data, begins, lengths), rows


def hash_of(word: str) -> int:
    """The same hash for one word."""
    return int(hashed_words(pa.array([word]))[0][0])
