"""Word-shingle hashes of a whole Arrow column at once, with numpy.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z lowered. A word's hash is a
polynomial over its bytes taken from running sums, a shingle's hash combines its words' hashes in
order; 64 bits each. A text of fewer words than a shingle has one shingle, of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE_BYTES

_random = np.random.default_rng(20240501)
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = int(_random.integers(1, 2**62)) * 4 + 3
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEP = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only those of a usual part are remembered."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    out = []
    for name, base in (("up", _BASE), ("down", _UNBASE)):
        p = np.full(max(n, _PART + 1), base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
        if n <= _PART + 1:
            _powers[name] = out[-1]
    return out[0], out[1]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string or binary column, nulls as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def parts_of(bounds: np.ndarray, most: int = _PART) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes, or of one row."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b
        a = b


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of these rows, and the number of words before each row's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:n]
    end[:-1] &= ~ink[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, bounds)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, cut at white space so that little more than its words is held."""
    out, at = [], 0
    while at < len(data):
        end = at + _PART
        while end < len(data) and not _SPACE[data[end : end + _PART]].any():
            end += _PART
        end = min(end, len(data))
        end += int(_SPACE[data[end : end + _PART]].argmax()) if end < len(data) else 0
        out.append(_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def shingle_hashes(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes of a run of rows in text order, number of shingles of each row)."""
    data, bounds = texts_of(column)
    for a, b in parts_of(bounds):
        own = bounds[a : b + 1] - bounds[a]
        if b - a == 1 and own[1] > 2 * _PART:
            words = _long_words(data[bounds[a] : bounds[b]])
            before = np.array([0, len(words)])
        else:
            words, before = _words(data[bounds[a] : bounds[b]], own)
        n = np.diff(before)
        if len(words) >= size:
            m = len(words) - size + 1
            whole = words[:m] * _STEP[0]
            for k in range(1, size):
                whole += words[k : k + m] * _STEP[k]
            whole = mix(whole)
        else:
            whole = np.zeros(0, np.uint64)
        counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        out = np.empty(int(counts.sum()), np.uint64)
        to = np.concatenate([[0], np.cumsum(counts)])
        full = np.flatnonzero(n >= size)
        if len(full):
            lengths = counts[full]
            shift = np.repeat(before[full] - to[full], lengths)
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(to[full], lengths)
            out[place] = whole[place + shift]
        for row in np.flatnonzero((n > 0) & (n < size)):
            part = words[before[row] : before[row + 1]]
            total = np.sum(part * _STEP[: len(part)], dtype=np.uint64, keepdims=True)
            out[to[row]] = mix(total + _STEP[8:9] * np.uint64(len(part)))[0]
        yield a, out, counts
