"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

A batch's column already is one byte buffer with offsets, so words are found and
hashed for many documents at once. Separators are ASCII, and no byte of a
multi-byte UTF-8 character is ASCII, so bytes give the same words as code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
#: Bytes handled at once: large enough for numpy, small enough for the caches.
BLOCK = 1 << 19
#: Numbers that ``mix`` handles at once.
MIXED = 1 << 14

#: Lower-case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None


def give_back() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run: Callable) -> Callable:
    """A generator over batches that gives what it has freed back to the system at its end, as workers outlive their tasks."""

    @wraps(run)
    def out(*args, **kwargs):
        try:
            yield from run(*args, **kwargs)
        finally:
            give_back()

    return out


def word_table(*separators: tuple[int, int]) -> np.ndarray:
    """True for each byte that belongs to a word; ranges of separators are inclusive."""
    out = np.ones(256, bool)
    for a, b in separators:
        out[a : b + 1] = False
    return out


#: Words between blanks, and words of lower-case letters, digits and all beyond ASCII.
BY_SPACE = word_table((0x20, 0x20), (0x09, 0x0D))
BY_ALNUM = word_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), 2**64))])
    return out[:n]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK
    while size < n:
        size *= 2
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = (_powers(_STEP, size + 1), _powers(_BACK, size + 1))
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one; by parts that stay in the caches, in place."""
    x = np.asarray(x, np.uint64)
    out = np.empty(x.shape, np.uint64)
    flat, from_, part = out.reshape(-1), x.reshape(-1), np.empty(min(x.size, MIXED), np.uint64)
    for i in range(0, x.size, MIXED):
        own = flat[i : i + MIXED]
        shifted = part[: len(own)]
        np.right_shift(from_[i : i + MIXED], U(30), out=own)
        own ^= from_[i : i + MIXED]
        own *= U(0xBF58476D1CE4E5B9)
        own ^= np.right_shift(own, U(27), out=shifted)
        own *= U(0x94D049BB133111EB)
        own ^= np.right_shift(own, U(31), out=shifted)
    return out


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def find_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hasher(raw: np.ndarray):
    """A function from starts and ends of spans to their 64-bit hashes, the same wherever a span lies."""
    up, down = powers(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def same_spans(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each span of ``one`` has the very bytes of its span of ``two``; no span is empty."""
    same = ends - starts == to - from_
    a, b, n = starts[same], from_[same], (ends - starts)[same]
    if len(n):
        at = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(at, n)
        same[same] = np.logical_and.reduceat(one[np.repeat(a, n) + place] == two[np.repeat(b, n) + place], at)
    return same


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(raw)(starts, ends)


def hash_runs(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive code points; shorter by k - 1."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes))
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix(codes.astype(np.uint64) + U(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; shorter by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _MIX[0]
    for j in range(1, k):
        out += words[j : j + n] * _MIX[j % 64] if j < 64 else mix(words[j : j + n] + U(j))
    return mix(out + U(k))


def hash_windows_rows(rows: np.ndarray) -> np.ndarray:
    """``hash_windows`` of each row of a matrix of word hashes."""
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out += rows[:, j] * _MIX[j]
    return mix(out + U(rows.shape[1]))


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int, table: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of each row, and bounds by row; fewer words make one shingle."""
    low = LOWER[raw]
    starts, ends, first = find_words(low, offsets, table)
    words = hash_spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(bounds[-1], np.uint64)
    whole = hash_windows(words, k)
    long_rows = counts >= k
    if long_rows.any():
        size, to, at = many[long_rows], bounds[:-1][long_rows], first[:-1][long_rows]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = whole[np.repeat(at, size) + step]
    for row in np.flatnonzero((counts > 0) & ~long_rows):
        out[bounds[row]] = hash_windows(words[first[row] : first[row + 1]], int(counts[row]))[0]
    return out, bounds


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    out = values[bounds[0] : bounds[-1]].copy()
    ends = (bounds - bounds[0]).tolist()
    for i, j in zip(ends[:-1], ends[1:]):
        out[i:j].sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    at = bounds[:-1] - bounds[0]
    new[at[at < bounds[1:] - bounds[0]]] = True
    before = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
    return out[new], before[bounds - bounds[0]]


def min_hashes(values: np.ndarray, bounds: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` MinHashes of each row that has values, as (count, rows); rows without get 0."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((count, len(bounds) - 1), np.uint64)
    if len(full):
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 2**63, count, dtype=np.uint64) | U(1)
        b = rng.integers(1, 2**63, count, dtype=np.uint64)
        at = bounds[:-1][full]
        for i in range(count):
            out[i, full] = np.minimum.reduceat((values ^ b[i]) * a[i], at)
    return out


def sketches(values: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the parity of how many of its distinct values fall on each of 64 * ``words`` bits, 64 to a word.

    The exclusive or of two sketches is that of the values in one of the two rows only.
    """
    rows, bits = len(bounds) - 1, 64 * words
    out = np.zeros((rows, words), np.uint64)
    step = max(1, (1 << 21) // bits)
    for i in range(0, rows, step):
        j = min(rows, i + step)
        own = values[bounds[i] : bounds[j]]
        at = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1])) * bits + ((own >> U(21)) % U(bits)).astype(np.int64)
        odd = (np.bincount(at, minlength=(j - i) * bits) & 1).astype(np.uint8)
        out[i:j] = np.packbits(odd).view(np.uint64).reshape(j - i, words)
    return [np.ascontiguousarray(out[:, w]) for w in range(words)]


def set_ids(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each row's set of distinct values."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    one, two = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    if len(full):
        at = bounds[:-1][full]
        one[full] = np.add.reduceat(mix(values), at)
        two[full] = np.add.reduceat(mix(values ^ _MIX[9]), at)
    return one, two


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values.view(np.int64), pa.int64()))
