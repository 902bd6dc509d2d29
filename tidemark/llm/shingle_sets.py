"""Word-shingle sets of whole texts, computed on the bytes of Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np

SLICE_BYTES = 400_000
_U = np.uint64


@cache
def _tables(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte after lower-casing A-Z, whether it parts words, and factors for the words of a shingle."""
    random = np.random.default_rng(seed)
    value = random.integers(0, 2**64, 256, dtype=np.uint64)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    parts = np.zeros(256, bool)
    parts[[0x20, *range(0x09, 0x0E)]] = True
    return value, parts, random.integers(0, 2**64, 64, dtype=np.uint64) | _U(1)


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i below n, modulo 2 ** 64; kept by the worker."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and where each text's words begin."""
    value, parts, _ = _tables()
    n = len(data)
    bounds = offsets - offsets[0]
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    in_word = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1] | edge[1:n]
    ends = in_word
    ends[:-1] &= ~in_word[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * _powers(_BASE, n)[:n], out=sums[1:])
    words = (sums[last] - sums[first]) * _powers(_BASE_INVERSE, n)[first]
    words = mix(words + (last - first).astype(np.uint64))
    return words, np.searchsorted(first, bounds)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle count as one, none as empty."""
    factors = _tables()[2]
    hashes, at = word_hashes(data, offsets)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        rolled += hashes[k : n - words + 1 + k] * factors[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            one = np.sort(rolled[a : b - words + 1])
            keep = np.ones(len(one), bool)
            keep[1:] = one[1:] != one[:-1]
            out.append(one[keep])
        elif b > a:
            short = (hashes[a:b] * factors[8 : 8 + b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sets_of_batch(column, words: int = 5):
    """Yields (row, set) for an Arrow string column, in slices of bounded bytes; a null has an empty set."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        yield from enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1], words), a)
        a = b
