"""Whole-batch text kernels: words, word hashes and word n-grams with numpy.

A batch of strings is one buffer of UTF-8 bytes; words are found and hashed
for all documents of a slice at once, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULT = U(0x9E3779B97F4A7C15)
_LONG = 1 << 12
_RUN = 1 << 19
_POWERS = np.cumprod(np.concatenate([[U(1)], np.full(_LONG - 1, _MULT | U(1), U)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def trim() -> None:
    """Give freed memory back, where the C library can: workers live on after
    a task, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of about ``most`` bytes; a longer document is alone."""
    offs = offsets(texts)
    a, n = 0, len(texts)
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n, a + 60_000)
        yield a, b
        a = b


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)


def words(texts: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of documents [a, b), and for each white-space separated word its
    first byte, its end, and the number of its document (0 = a). Null is empty."""
    offs = offsets(texts)[a : b + 1].astype(np.int64)
    if not len(texts) or texts.buffers()[2] is None or offs[-1] == offs[0]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs -= offs[0]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin = ~space
    begin[1:] &= space[:-1] | edge[1:-1]
    end = ~space
    end[:-1] &= space[1:] | edge[1:-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, first, side="right") - 1
    return data, first, last, doc


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out in runs of about a
    megabyte, so that memory doesn't follow the length of the text."""
    if not len(first):
        return np.zeros(0, U)
    out = np.empty(len(first), U)
    ends = np.cumsum(last - first)
    a = 0
    while a < len(first):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + _RUN, side="right")))
        out[a:b] = _run_hashes(data, first[a:b], last[a:b])
        a = b
    return out


def _run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    at = np.arange(int(size.sum()), dtype=np.int64)
    inner = at - np.repeat(np.cumsum(size) - size, size)
    letters = data[inner + np.repeat(first, size)].astype(U) + U(1)
    if size.max() <= _LONG:
        letters *= _POWERS[inner]
    else:
        powers = np.cumprod(np.concatenate([[U(1)], np.full(int(size.max()) - 1, _MULT | U(1), U)]))
        letters *= powers[inner]
    total = np.concatenate([[U(0)], np.cumsum(letters)])
    ends = np.cumsum(size)
    return mix(total[ends] - total[ends - size] + size.astype(U) * U(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, over all documents: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out *= U(0xD1342543DE82EF95)
        out += h[k : k + len(out)]
    return mix(out)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty strings."""
    c = column(batch, name)
    return c.fill_null("") if c.null_count else c
