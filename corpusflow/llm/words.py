"""Words and word hashes of Arrow text columns, in numpy.

A batch's bytes are cut into slices of bounded size (one document is never cut, so
a slice is at least a whole text). Inside a slice every step is a vector operation
on the UTF-8 bytes; no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
U = np.uint64


def times(n: int, x: np.uint64) -> np.uint64:
    """n * x modulo 2**64."""
    return U(int(n) * int(x) & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= _B
    x ^= x >> U(27)
    x *= _C
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """The words of documents lo to hi of a batch."""

    lo: int
    hi: int
    buf: np.ndarray  # bytes of all these documents
    starts: np.ndarray  # of each word, in buf
    ends: np.ndarray
    first: np.ndarray  # for each document its first word, then the number of words
    hashes: np.ndarray  # uint64 for each word


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def slices(off: np.ndarray, budget: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about budget bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a time."""
    length = (ends - starts).astype(np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    h = mix(length.astype(U) + U((seed * 0x5851F42D4C957F2D + 0x2545F4914F6CDD1D) & (2**64 - 1)))
    at, left, which = starts, length, None
    while len(at):
        block = eight[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            h = mix((h ^ block) * _A)
        else:
            h[which] = mix((h[which] ^ block) * _A)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def spans(buf: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a slice; o: the documents' offsets in it."""
    n = len(buf)
    within = inside(buf)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = within[:-1], within[1:]
    before[o[:-1][o[:-1] < n]] = False
    after[o[1:][o[1:] > 0] - 1] = False
    return np.flatnonzero(within & ~before), np.flatnonzero(within & ~after) + 1


def inside(buf: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to a word."""
    return ~_SPACE[buf]


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[buf]


def each(column: pa.Array, lower: bool, budget: int = SLICE) -> Iterator[Words]:
    """The words of a text column, slice after slice. lower: with A-Z in lower case."""
    data, off = texts(column)
    for lo, hi in slices(off, budget):
        buf, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if lower:
            buf = lowered(buf)
        starts, ends = spans(buf, o)
        yield Words(lo, hi, buf, starts, ends, np.searchsorted(starts, o), hash_spans(buf, starts, ends))


def shingles(w: Words, n: int = 5) -> np.ndarray:
    """A hash of every n consecutive words of the slice; the last n-1 of a document
    reach into the next one and must be left out by the caller."""
    m = max(0, len(w.hashes) - n + 1)
    out = np.zeros(m, U)
    for j in range(n):
        out += mix(w.hashes[j : j + m] + times(j + 1, _A)) * (_C + U(2 * j))
    return mix(out)
