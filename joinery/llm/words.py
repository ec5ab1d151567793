"""Vectorised words of whole UTF-8 texts: positions and 64-bit hashes of words and of word runs.

Both kinds of words in use are runs of bytes of a class, since every byte over
0x7F belongs to a word: so the bytes of many texts are classified at once, and
hashes are differences of prefix sums of a polynomial modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE, _RUN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_byte = np.arange(256)
_upper = (_byte >= 0x41) & (_byte <= 0x5A)
_lower = np.where(_upper, _byte + 32, _byte)

#: Bytes of a word: all but space and 0x09 to 0x0D.
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Bytes of a word once A-Z are lower case: digits, letters and all over 0x7F.
PLAIN = ((_byte >= 0x30) & (_byte <= 0x39)) | _upper | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = (np.full(size, b, _U) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        got = _powers[base] = np.cumprod(up), np.cumprod(down)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each value's offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Words of consecutive texts; text i has the words first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def of(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word that starts n words of one text: its index, and the run's hash."""
        return run_hashes(self.hashes, self.first, n)


def run_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = len(hashes)
    if total < n:
        return np.empty(0, np.int64), np.empty(0, _U)
    up, down = _power(_RUN, total + 1)
    sums = np.zeros(total + 1, _U)
    np.cumsum(hashes * up[:total], out=sums[1:])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)  # words from here to the end of the text
    at = np.flatnonzero(left >= n)
    return at, mix((sums[at + n] - sums[at]) * down[at] + _U(n))


def bounds(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word crosses from one text to the next."""
    n = len(data)
    mask = kind[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:]
    inner = offs[(offs > 0) & (offs < n)]
    begins[inner] = mask[inner]
    stops[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + sizes[i]], side by side; places are worked out for about ``step`` values at a time."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    i = 0
    while i < len(starts):
        base = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, base + step, side="right")))
        if j == i + 1:
            out[base : ends[i]] = flat[starts[i] : starts[i] + sizes[i]]
        else:
            at = np.repeat(starts[i:j] - (ends[i:j] - sizes[i:j] - base), sizes[i:j])
            at += np.arange(len(at))
            out[base : ends[j - 1]] = flat[at]
        i = j
    return out


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word: equal words, and no others, have equal numbers."""
    sizes = ends - starts
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(gather(data, starts, sizes))])
    return own.dictionary_encode().indices.to_numpy()


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    n = len(data)
    starts, ends = bounds(data, offs, kind)
    up, down = _power(_BASE, n + 1)
    values = (_lower if lower else _byte).astype(_U)[data] + _U(1)
    values *= up[:n]
    sums = np.zeros(n + 1, _U)
    np.cumsum(values, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return Words(starts, ends, hashes, np.searchsorted(starts, offs))


#: Bytes of text worked on at once (about 50 times as many of working memory), just under a power of two, as tables of powers are.
SLICE = (1 << 20) - 64


def parts(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The column in slices of about ``most`` bytes (one text at least): from, to, bytes, offsets."""
    data, offs = text_bytes(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
