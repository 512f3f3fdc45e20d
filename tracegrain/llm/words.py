"""Words and shingles of Arrow text columns, hashed without a Python object per word.

A word is a run of bytes outside space and 0x09-0x0D, so words of the UTF-8 bytes are the
words of the text. The hash of a word of up to LONG_WORD bytes is a polynomial over its bytes modulo 2**64, taken from
prefix sums of a whole piece of the buffer; pieces end at white space, so a text of any
length is hashed in bounded memory beside 8 bytes a word. Of longer words, where such polynomials have well known equal
values, it is 64 bits of BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
LONG_WORD = 64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 21

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n; they are kept for a worker's next batches up to PIECE."""
    size = 1 << max(10, (n - 1).bit_length())
    if (base, size) not in _tables:
        made = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        if size > 2 * PIECE:
            return made
        _tables[base, size] = made
    return _tables[base, size]


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; offsets (of documents, from 0) end words too."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_white(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    out, table, i = np.empty(len(start), np.uint64), _LOWER if lower else _BYTE, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        low, high = int(start[i]), int(end[j - 1])
        up, down = _power_tables(_BASE, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:])
        out[i:j] = (sums[end[i:j] - low] - sums[start[i:j] - low]) * down[start[i:j] - low]
        i = j
    out = mix(out)
    for i in np.flatnonzero(end - start > LONG_WORD):
        word = data[start[i] : end[i]]
        word = np.where((word >= 65) & (word <= 90), word + 32, word).astype(np.uint8) if lower else word
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for i in range(k):
        out += words[i : i + n] * _U(power)
        power = power * _WORD_BASE % (1 << 64)
    return mix(out)


class Chunk:
    """Some rows of a batch with their words: row is the first row, of words bound[i]:bound[i + 1] are row i's."""

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.row, self.data, self.offsets, self.n = row, data, offsets, len(offsets) - 1
        self.start, self.end = word_bounds(data, offsets)
        self.hash = word_hashes(data, self.start, self.end, lower)
        self.bound = np.searchsorted(self.start, offsets)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(self.n):
            yield self.row + i, self.hash[self.bound[i] : self.bound[i + 1]]


def chunks(column: pa.Array, lower: bool = False, wanted: np.ndarray | None = None) -> Iterator[Chunk]:
    """The rows of a string column in order, null as empty; rows that aren't wanted as empty too."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if wanted is not None:
        column = pa.compute.if_else(pa.array(wanted), column, pa.scalar("", pa.large_string()))
    column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
