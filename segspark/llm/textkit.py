"""Whole-batch word splitting and hashing with numpy: no loop over words.

A batch of texts is one UTF-8 byte array plus offsets.  Word classes are byte tables, so both word
patterns of this package (which treat every non-ASCII character alike) work on raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64

#: Bytes of text handled at once; one longer text is handled alone, whole.
SLICE_BYTES = 2 << 20


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = ~byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 2 + 1))


def odd_base(seed: int) -> int:
    return int(mix(np.array([seed + 77], U))[0]) | 1


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length()) if n else 1024
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a range of texts. ``first[d] : first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray  # folded bytes of the range
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    keep: np.ndarray  # which bytes belong to words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 1) -> np.ndarray:
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, U)
        at = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        values = byte_values(seed)[self.data[self.keep]] * powers(odd_base(seed), int(lens.max()))[inside]
        return mix(np.add.reduceat(values, at) + lens.astype(U))


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, kind: np.ndarray, lower: bool) -> Words:
    """Words of texts ``i .. j - 1``."""
    lo, hi = int(offsets[i]), int(offsets[j])
    part = data[lo:hi]
    if lower:
        part = LOWER[part]
    begin = offsets[i : j + 1] - lo
    keep = kind[part]
    edge = np.zeros(hi - lo + 1, bool)
    edge[begin] = True
    n = hi - lo
    if not n:
        none = np.zeros(0, np.int64)
        return Words(part, none, none, np.zeros(j - i + 1, np.int64), keep)
    first = keep.copy()
    first[1:] &= ~keep[:-1] | edge[1:n]
    last = keep.copy()
    last[:-1] &= ~keep[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(part, starts, ends, np.searchsorted(starts, begin), keep)


def rolling(hashes: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hashes of all ``k`` consecutive words; entry ``p`` covers words ``p .. p + k - 1``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    base = odd_base(seed)
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inverse, n))


def positions(first: np.ndarray, span: int) -> np.ndarray:
    """All positions at which ``span`` words stay within one text."""
    room = np.maximum(np.diff(first) - span + 1, 0)
    return np.repeat(first[:-1], room) + (np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room))
