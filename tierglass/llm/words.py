"""Words of Arrow text columns as numpy arrays: bounds and hashes, without a Python loop.

A word is a maximal run of bytes other than blank and 0x09-0x0D. UTF-8 never uses those bytes inside
a longer character, so bytes and characters split alike.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUES = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_MULTIPLIER))
_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept and doubled as needed."""
    if not _tables or len(_tables[0]) < n:
        size = max(2 * SLICE_BYTES, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _tables[:] = [
            np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
            for b in (_BASE, inverse)
        ]
    return _tables[0][:n], _tables[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[first:last] if data and last > first else np.zeros(0, np.uint8)), offsets - first


def slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about this many text bytes, so memory stays bounded."""
    _, offsets = buffers(batch.column(name))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of each word, and the n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[offsets < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range, the same wherever the range lies."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive word hashes of one array; it runs over text ends too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


Learned = tuple[np.ndarray, np.ndarray, np.ndarray]


class ChunkCache:
    """Token ids of chunks by their hash.

    When more than ``limit`` chunks are known, those that were not met again since the last time are
    forgotten, so frequent chunks stay and memory is bounded. What is forgotten is learned anew.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.known: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.used = 0
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes, self.hits = (np.zeros(0, np.int64) for _ in range(3))

    def ids(self, h: np.ndarray, learn: Callable[[np.ndarray], Learned]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row and the n + 1 offsets of the chunks.

        ``learn`` gets the places of unknown chunks and returns ids in any order, and for each chunk
        where its ids start and how many they are.
        """
        if len(self.known) > self.limit:
            self.prune(self.limit // 2)
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        entry = np.fromiter(map(self.known.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = entry < 0
        self.hits[entry[~new]] += 1
        if new.any():
            flat, starts, sizes = learn(at[new])
            n = len(self.known)
            entry[new] = np.arange(n, n + len(starts))
            self.known.update(zip(distinct[new].tolist(), range(n, n + len(starts))))
            self.flat = _grown(self.flat, self.used, flat.astype(np.uint32))
            self.keys = _grown(self.keys, n, distinct[new])
            self.starts = _grown(self.starts, n, self.used + starts)
            self.sizes = _grown(self.sizes, n, sizes)
            self.hits = _grown(self.hits, n, np.zeros(len(starts), np.int64))
            self.used += len(flat)
        entry = entry[back]
        sizes = self.sizes[entry]
        out = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[entry] - out[:-1], sizes) + np.arange(out[-1])], out

    def prune(self, keep: int) -> None:
        """Forget all but at most ``keep`` chunks that were met again."""
        n = len(self.known)
        best = np.argsort(-self.hits[:n], kind="stable")[:keep]
        best = best[self.hits[best] > 0]
        starts, sizes = self.starts[best], self.sizes[best]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.used = len(self.flat)
        self.keys, self.starts, self.sizes = self.keys[best], ends - sizes, sizes
        self.hits = np.zeros(len(best), np.int64)
        self.known = dict(zip(self.keys.tolist(), range(len(best))))


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with values put behind the used ones; space doubles as needed."""
    need = used + len(more)
    if need > len(array):
        array = np.concatenate([array[:used], np.zeros(max(need, 2 * used) - used, array.dtype)])
    array[used:need] = more
    return array


Batches = Iterator[pa.RecordBatch]


def task(run: Callable[[Batches], Batches], clear: Callable[[], None] | None = None) -> Callable[[Batches], Batches]:
    """``run`` over the batches of a task, and then its freed memory given back to the system.

    Worker processes outlive their tasks and share the executor's memory with whatever runs next.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
