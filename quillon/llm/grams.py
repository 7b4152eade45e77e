"""Words and n-grams of Arrow string columns as numpy arrays, without a Python object for each word.

A slice of rows becomes one byte buffer in which a blank stands before each text and after the last. A range of bytes is
hashed in blocks of eight, each mixed in by a function that is one to one, so ranges of up to eight bytes never collide
with others of their length; ranges beyond LONG bytes go through BLAKE2b. Where equality itself is asked for, `same` and
`word_ids` decide it by the bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LONG = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def tidy(run: Callable) -> Callable:
    """A task's function that gives the memory it no longer needs back to the system at its end; Spark reuses its workers."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Texts:
    """One slice: buffer, blanks, words and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None, blank: np.ndarray = BLANK):
        self.n = len(offsets) - 1
        self.seps = offsets + np.arange(self.n + 1)  # of the blank before each text, and of the last
        self.buf = np.full(len(data) + self.n + 1, 32, np.uint8)
        inside = np.ones(len(self.buf), bool)
        inside[self.seps] = False
        self.buf[inside] = data if fold is None else fold[data]
        self.word = ~blank[self.buf]
        if fold is None and blank is BLANK:
            self.word[self.seps] = False
        edges = np.flatnonzero(self.word[1:] != self.word[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.seps)  # of each text's first word; the last: all words
        self._eights = None

    @property
    def eights(self) -> np.ndarray:
        """The eight bytes from each place of the buffer as one number."""
        if self._eights is None:
            held = np.concatenate([self.buf, np.zeros(8, np.uint8)])
            self._eights = np.ndarray(len(self.buf) + 1, "<u8", held.data, strides=(1,))
        return self._eights

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix(size.astype(np.uint64) + _GOLD)
        out = mix(out ^ (self.eights[starts] & _LOW[np.minimum(size, 8)]))
        live, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(live):
            at = starts[live] + k
            out[live] = mix((out[live] + _GOLD) ^ (self.eights[at] & _LOW[np.minimum(ends[live] - at, 8)]))
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out

    def same(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether the ranges (starts, ends) of a and b hold equal bytes, pair by pair."""
        size = a[1] - a[0]
        out = size == b[1] - b[0]
        live, k = np.flatnonzero(out), 0
        live = live[a[0][live] != b[0][live]]
        while len(live) and k < LONG:
            mask = _LOW[np.minimum(size[live] - k, 8)]
            equal = ((self.eights[a[0][live] + k] ^ self.eights[b[0][live] + k]) & mask) == 0
            out[live] = equal
            k += 8
            live = live[equal & (size[live] > k)]
        for i in live.tolist():
            out[i] = np.array_equal(self.buf[a[0][i] + k : a[1][i]], self.buf[b[0][i] + k : b[1][i]])
        return out

    def ids(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the ranges, equal where their bytes are."""
        _, one, which = np.unique(self.hashes(starts, ends), return_index=True, return_inverse=True)
        if not self.same((starts, ends), (starts[one[which]], ends[one[which]])).all():  # unlike ranges of one hash
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(self.buf[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return which

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.seps[1:]] - total[self.seps[:-1]]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))


def windows(ids: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, equal where the words are, of all windows of `size` words that lie in one text, and where each begins.

    Neighbouring pairs are numbered, then pairs of such pairs: no hash decides.
    """
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    room = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= room)
    out, span = ids.astype(np.int64), 1
    while span < size:
        step = min(span, size - span)
        out = np.unique(out[:-step] * (int(out.max()) + 1) + out[step:], return_inverse=True)[1]
        span += step
    return out[at], at


_STEPS = mix(np.arange(1, 129, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words that lie in one text, and the place of each one's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.repeat(first[1:], np.diff(first))[:n]  # where each word's text ends
    at = np.flatnonzero(np.arange(n) + size <= room)
    if len(at) < 0.5 * n:
        total = np.zeros(len(at), np.uint64)
        for j in range(size):
            total += words[at + j] * _STEPS[j]
        return mix(total), at
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j : j + n] * _STEPS[j]
    return mix(total)[at], at
