"""Whole texts as byte arrays: tokens and their hashes without a Python object per word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: One value per byte.
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
#: The same with A-Z as a-z.
LETTERS = EXACT.copy()
LETTERS[65:91] = EXACT[97:123]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE)
        for key, base in (("up", _STEP), ("down", _BACK)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[key] = np.cumprod(run, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def classes(word: bytes = b"", single: bytes = b"", high: int = 1) -> np.ndarray:
    """Class of each byte: 0 separates, 1 belongs to a word, 2 is a token by itself."""
    out = np.zeros(256, np.uint8)
    out[128:] = high
    out[list(word)] = 1
    out[list(single)] = 2
    return out


ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BLANK = b" \t\n\r\x0b\x0c"
#: Words of letters, digits and everything beyond ASCII.
WORDS = classes(ALNUM)
#: Words are whatever stands between ASCII blanks.
SPACED = classes(bytes(b for b in range(128) if b not in BLANK))
#: As WORDS, and each other visible ASCII character is a token.
PUNCTUATED = classes(ALNUM, bytes(b for b in range(33, 127) if b not in ALNUM))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: (first, after last, bytes, offsets); a longer text stands alone."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, last, data[off[first]:off[last]], off[first:last + 1] - off[first]
        first = last


def tokens(data: np.ndarray, off: np.ndarray, kinds: np.ndarray, hashed: bool = True, letters: np.ndarray = LETTERS):
    """(starts, ends, hashes, bounds): tokens in byte positions; text d has those from bounds[d] to bounds[d + 1]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    kind = kinds[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == 2
    edge[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(edge)
    after = np.append(at[1:], n)
    keep = kind[at] > 0
    starts, ends = at[keep], after[keep]
    hashes = np.zeros(0, np.uint64)
    if hashed:
        up, down = _power(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[data] * up, out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
    return starts, ends, hashes, np.searchsorted(starts, off)


def runs(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` tokens that stay inside a text, and their bounds per text."""
    size = np.diff(bounds)
    made = np.maximum(size - n + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), out_bounds
    h = hashes[:total - n + 1].copy()
    for k in range(1, n):
        h = h * _STEP + hashes[k:total - n + 1 + k]
    owner = np.repeat(np.arange(len(size)), made)
    where = np.arange(out_bounds[-1]) - out_bounds[owner] + bounds[owner]
    return mix(h[where]), out_bounds
