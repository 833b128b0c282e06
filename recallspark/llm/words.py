"""Words of texts and hashes of word windows, over whole Arrow columns in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SLICE_BYTES, _HASHED_BYTES = 1 << 20, 1 << 18
_U = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        z = values + _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64 for k up to n at least; base is odd."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[base]


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the range lies."""
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


@lru_cache(maxsize=4)
def _byte_values(lower: bool, seed: int) -> np.ndarray:
    values = mix(np.arange(256, dtype=np.uint64) + _U(1000 * seed))
    if lower:
        values[65:91] = values[97:123]
    return values


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BASE, _WINDOW_BASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: their bytes, bounds, text numbers and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        self.data, self.lower = data, lower
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        bounds = offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(data))]
        first[bounds] = inside[bounds]
        last[bounds - 1] = inside[bounds - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.text_starts = np.searchsorted(self.starts, offsets)
        self.texts = len(offsets) - 1
        self.counts = np.diff(self.text_starts)
        self.text = np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A hash of each word, some hundred kilobytes of text at a time."""
        values = _byte_values(self.lower, seed)
        out = np.zeros(len(self.starts), np.uint64)
        first = 0
        while first < len(out):
            low = self.starts[first]
            last = max(int(np.searchsorted(self.ends, low + _HASHED_BYTES, "right")), first + 1)
            starts, ends = self.starts[first:last] - low, self.ends[first:last] - low
            sums = range_sums(values[self.data[low : low + ends[-1]]], starts, ends, _WORD_BASE)
            out[first:last] = mix(sums ^ (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))
            first = last
        return out

    def windows(self, words: np.ndarray, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Hashes of `width` words from each start; the caller keeps them inside a text."""
        return mix(range_sums(words, starts, starts + width, _WINDOW_BASE))

    def text_bytes(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """The kept words of a text joined by one space."""
        a, b = self.text_starts[text], self.text_starts[text + 1]
        if keep is None:
            low = self.starts[a] if b > a else 0
            high = self.ends[b - 1] if b > a else 0
            return b" ".join(self.data[low:high].tobytes().split())
        pieces = zip(self.starts[a:b][keep], self.ends[a:b][keep], strict=True)
        return b" ".join(self.data[s:e].tobytes() for s, e in pieces)


def text_slices(column: pa.Array, lower: bool) -> Iterator[tuple[int, Words]]:
    """Words of a column's texts, some megabytes at a time, with each slice's first row."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + _SLICE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        low, high = offsets[row], offsets[stop]
        yield row, Words(data[low:high], offsets[row : stop + 1] - low, lower)
        row = stop


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
