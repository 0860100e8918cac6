"""Words of whole texts as numpy arrays, a block of rows at a time.

Texts stay in Arrow's UTF-8 buffers. A byte table says which bytes belong to words, so a word
is a run of such bytes inside one row, and a polynomial hash of every word comes from one
running sum over the block. No Python object is made per word. A hash has 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def byte_table(breaks: bytes) -> np.ndarray:
    """True for every byte that is part of a word: all but ``breaks``."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(breaks, dtype=np.uint8)] = False
    return table


#: ``[^\\x20\\x09-\\x0D]+``
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
LETTERS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray, spent: bool = False) -> np.ndarray:
    """Sorted distinct values, by sorting (numpy's own default hashes, which is slower here); an array that
    is ``spent`` is sorted where it is."""
    if spent:
        x.sort()
    else:
        x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_STEP = 1 << 10


def _row(base: int, n: int) -> np.ndarray:
    """The powers 0 .. n-1 of ``base``, modulo 2**64."""
    row = np.full(n, base, dtype=np.uint64)
    row[:1] = 1
    return np.cumprod(row)


class Powers:
    """Powers of a number modulo 2**64 from two short tables, of the low and the high part of the exponent."""

    def __init__(self, base: int):
        self.low, self.step = _row(base, _STEP), pow(base, _STEP, 1 << 64)
        self.high = _row(self.step, 4 * BLOCK_BYTES // _STEP)

    def _upto(self, n: int) -> np.ndarray:
        need = n // _STEP + 1
        return self.high if len(self.high) >= need else _row(self.step, need)  # of one huge text: not kept

    def at(self, places: np.ndarray) -> np.ndarray:
        high = self._upto(int(places.max(initial=0)))
        return self.low[places & (_STEP - 1)] * high[places >> 10]

    def scale(self, x: np.ndarray) -> None:
        """Multiply every ``x[i]`` by the power ``i``, in place."""
        high, whole = self._upto(len(x)), len(x) // _STEP
        rows, rest = x[: whole * _STEP].reshape(whole, _STEP), x[whole * _STEP :]
        rows *= self.low
        rows *= high[:whole, None]
        rest *= self.low[: len(rest)]
        rest *= high[whole]


UP, DOWN = Powers(_BASE), Powers(_INVERSE)


def running_sums(values: np.ndarray) -> np.ndarray:
    """Sums of (``values[i]`` + 1) * base**i over the first 0 .. n of them; needs no other array of that size."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    own = sums[1:]
    own[:] = values
    own += _U(1)
    UP.scale(own)
    np.cumsum(own, out=own)
    return sums


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = running_sums(data)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * DOWN.at(start))


@dataclass
class Words:
    """Words of rows ``lo`` .. ``hi``-1 of a batch; ``doc`` counts from ``lo``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashed: RangeHash

    @cached_property
    def hash(self) -> np.ndarray:
        """A hash of every word."""
        return self.hashed(self.start, self.end)

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def first(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.rows))])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of n words of one row, and a hash of each run."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        total = np.zeros(count, dtype=np.uint64)
        for k in range(n):  # Horner's rule over neighbouring word hashes
            total = total * _U(_BASE) + self.hash[k : k + count]
        return at, mix(total[at])


def marked(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` of a table of 256 flags, without an index of 8 bytes for each byte."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), dtype=bool)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of True that does not cross a row's boundary."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def blocks(texts: pa.Array, table: np.ndarray, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Words]:
    """Whole rows of a batch in blocks of about ``limit`` bytes; a longer text is a block alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        own = offsets[lo : hi + 1] - offsets[lo]
        data = body[offsets[lo] : offsets[hi]]
        if lower:
            data = np.frombuffer(data.tobytes().translate(_LOWER), dtype=np.uint8)
        doc, start, end = runs(marked(data, table), own)
        yield Words(lo, hi, data, own, doc, start, end, RangeHash(data))
        lo = hi


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's range of positions."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
