"""Vectorised text primitives: words, lines and hashes of many texts at once.

Everything works on the UTF-8 bytes of an Arrow string column. Words are runs of bytes other than
space and 0x09-0x0D; as no multi-byte character holds such a byte, this is the same as splitting
the characters. Hashes are polynomial over the bytes (modulo 2**64), then mixed, so they depend on
the content alone: not on the process, the batch or the position.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 19  # texts handled at once; one longer text is handled alone, whole

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        table = np.full(size, U(BASE if which == "up" else INVERSE))
        table[0] = 1
        have = np.multiply.accumulate(table)
        if size <= 4 * SLICE_BYTES:
            _powers[which] = have
    return have[:n]


def give_back() -> None:
    """Returns this process's free memory to the system."""
    for which in [k for k, v in _powers.items() if len(v) > 2 * SLICE_BYTES]:
        del _powers[which]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """scan, with give_back when it ends: workers live on for the next stage, beside the executor."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def in_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts of about `limit` bytes together."""
    raw, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


class Hasher:
    """Hashes of any spans of one byte array."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * _power_table("up", n), out=self.sums[1:])
        self.down = _power_table("down", n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def starts_of(at: np.ndarray, n: int) -> np.ndarray:
    """A mark on each byte with which a text begins."""
    marks = np.zeros(n + 1, bool)
    marks[at] = True
    return marks


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (one more than texts)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~space[raw]
    marks = starts_of(at, n)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | marks[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | marks[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, at)


def lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each \\n-split line (an empty text is one empty line), and lines before each text."""
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.empty_like(start)
    if len(start):
        last = np.append(owner[1:] != owner[:-1], True)
        end[:-1] = start[1:] - 1
        end[last] = at[owner[last] + 1]
    return start, end, np.searchsorted(owner, np.arange(len(at)))


def windows(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k values that lies within one text, and the index of its first value."""
    n = len(values)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(n - k + 1, U)
    for j in range(k):
        out *= U(BASE)
        out += values[j : n - k + 1 + j]
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # values from here to the text's end
    first = np.flatnonzero(left[: n - k + 1] >= k)
    return mix(out[first]), first


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every k-word shingle; a text of 1 to k-1 words has one shingle of all its words."""
    values, first = windows(hashes, bounds, k)
    owner = np.searchsorted(bounds, first, "right") - 1
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return values, owner
    more = counts[short].astype(U)
    for j in range(k - 1):
        has = counts[short] > j
        more[has] = more[has] * U(BASE) + hashes[bounds[short[has]] + j]
    return np.concatenate([values, mix(more)]), np.concatenate([owner, short])
