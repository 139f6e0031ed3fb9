"""Words and shingles of many texts at once, as 64-bit hashes over UTF-8 bytes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed in one go; only a single longer text makes a larger piece.
CHUNK = 1 << 19
#: Bytes over which prefix sums run at once.
SLICE = 1 << 18
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUE = mix(_FOLD.astype(U) * U(_STEP) + U(_STEP))
_PLACE = mix(np.arange(1, 65, dtype=U) * U(_ODD))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64; they grow with the longest word."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)


_POWERS = _Powers()


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (from 0) of runs of rows; a null text is empty."""
    if not len(col):
        return
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the first word of each row (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(space[data], out=inside[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return begins, ends, np.searchsorted(begins, offsets)


def _sums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span sum(value(byte) * base**place in the span)."""
    out = np.empty(len(begins), U)
    i, n = 0, len(begins)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + SLICE, "right")))
        a, b = begins[i], ends[i:j].max()
        _POWERS.need(int(b - a) + 1)
        run = np.zeros(b - a + 1, U)
        np.cumsum(_VALUE[data[a:b]] * _POWERS.up[: b - a], out=run[1:])
        out[i:j] = (run[ends[i:j] - a] - run[begins[i:j] - a]) * _POWERS.down[begins[i:j] - a]
        i = j
    return out


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A-Z counts as a-z."""
    return mix(_sums(data, begins, ends))


def shingles(words: np.ndarray, first: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `size` words, and the first of each row; fewer words: one run of all."""
    n = len(words)
    per = np.diff(first)
    count = np.where(per >= size, per - size + 1, (per > 0).astype(per.dtype))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(at[-1], U)
    if n >= size:
        run = words[: n - size + 1] * _PLACE[0]
        for t in range(1, size):
            run = run + words[t : n - size + 1 + t] * _PLACE[t]
        ok = np.ones(len(run), bool)
        for t in range(1, size):
            x = first[1:] - t
            ok[x[(x >= 0) & (x < len(run))]] = False
        out[np.repeat(per >= size, count)] = run[ok]
    for r in np.flatnonzero((per > 0) & (per < size)):
        out[at[r]] = np.append(words[first[r] : first[r + 1]] * _PLACE[: per[r]], U(int(per[r]) * _STEP & (1 << 64) - 1)).sum()
    return mix(out), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, ascending, and the first of each row."""
    begins, ends, first = spans(data, offsets)
    out, at = shingles(word_hashes(data, begins, ends), first, size)
    for a, b in zip(at[:-1], at[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][at[:-1] < len(out)]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return out[new], total[at]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; at a task's end the worker, which later tasks use again, gives back free memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task
