"""Words of whole Arrow batches as numpy arrays.

Texts stay in Arrow's UTF-8 buffer: words are found with one table look-up a byte, and each word or window of
words gets a 64-bit fingerprint from differences of running sums. No Python object is made for a word. Two
different words of a corpus share a fingerprint with a chance of about n * n / 2**65 for n distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; works on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def series(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, made as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_BYTE, _WORD = _Powers(0x2545F4914F6CDD1D), _Powers(0x9E3779B97F4A7C15)
_BYTE_VALUES = series(1, 256)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]

NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANKS)] = False
#: After lower-casing A-Z: digits, a-z and every byte of a character beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Fingerprints of byte spans; lower: A-Z count as a-z."""
    up, down = _BYTE.to(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Fingerprints of size values of h from each start; the caller keeps windows within h."""
    up, down = _WORD.to(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * up[: len(h)], out=sums[1:])
    sizes = np.asarray(size, np.uint64)
    return mix((sums[starts + size] - sums[starts]) * down[starts] + sizes * np.uint64(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of some texts: data is their UTF-8, text i is data[bounds[i]:bounds[i+1]], its words are first[i]:first[i+1]."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends, lower)

    def windows(self, size: int) -> np.ndarray:
        """Word numbers at which a window of that size starts and stays within its text."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.starts))
        return at[at + size <= last]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows of about that many bytes; a longer text is a run of its own."""
    data, bounds = buffers(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1))
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def split_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = NOT_BLANK) -> Words:
    """Maximal runs of bytes of the table inside; none goes over a text's end."""
    n = len(data)
    held = inside[data]
    begins, closes = held.copy(), held.copy()
    if n:
        begins[1:] &= ~held[:-1]
        closes[:-1] &= ~held[1:]
        cuts = bounds[:-1][bounds[:-1] < n]
        begins[cuts] = held[cuts]
        cuts = bounds[1:][bounds[1:] > 0] - 1
        closes[cuts] = held[cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over bounds[i]:bounds[i+1]; 0 for empty runs."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
