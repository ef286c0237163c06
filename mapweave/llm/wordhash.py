"""Vectorised words, word hashes and shingles of a batch of texts.

All kernels work on the UTF-8 bytes of an Arrow string column, with one pass of
numpy for each step; none loops over characters or words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: bounds the memory of a worker.
CHUNK = 1 << 19
#: Called at the end of every task, to let go of what a worker remembers between batches.
forget: list[Callable[[], None]] = []

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=_U) | _U(1)
_powers: dict[str, np.ndarray] = {}
forget.append(_powers.clear)


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(kernel: Kernel) -> Kernel:
    """The kernel of a mapInArrow() that gives its memory back to the system at the end of a task.

    Spark keeps workers for later tasks, whose stages would find the memory of
    all earlier ones still held.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return rows


def release() -> None:
    """Frees what the worker remembers and what its allocators hold in reserve."""
    for drop in forget:
        drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_table(word: callable) -> np.ndarray:
    """256 booleans: which byte values belong to words."""
    return np.array([bool(word(b)) for b in range(256)])


#: Lower-cases A-Z; other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words are runs of anything but the six ASCII white-space characters.
SPACED = byte_table(lambda b: b not in (0x20, 9, 10, 11, 12, 13))
#: Words are runs of ASCII digits, letters and anything outside ASCII.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, in a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 entries)."""
    inside = table[data]
    edge = at[1:-1]
    edge = edge[edge < len(data)]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of the (lower-cased) bytes: sums of powers, from one running sum."""
    n = len(data) + 1
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    total = np.zeros(n, _U)
    np.cumsum(_BYTE[data] * _powers["up"][: n - 1], out=total[1:])
    out = mix((total[ends] - total[starts]) * _powers["down"][starts] + (ends - starts).astype(_U))
    if n > 4 * CHUNK:
        _powers.clear()
    return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive entries."""
    out = np.zeros(max(0, len(h) - n + 1), _U)
    for k in range(n):
        out += h[k : k + len(out)] * _STEP[k]
    return mix(out + _U(n))


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = 5, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles.

    A text of fewer words gives the hash of its whole sequence, one without
    words an empty set.
    """
    low = LOWER[data]
    starts, ends, first = words(low, at, table)
    h = hashes(low, starts, ends)
    full = runs(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield runs(h[a:b], b - a)
        else:
            yield np.zeros(0, _U)
