"""Words, lines and shingles of Arrow text columns as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; all are single
bytes in UTF-8, so a text is cut without decoding it. Words and lines are known by 64-bit hashes: a polynomial over
random values of the bytes, read off running sums, so that hashing costs a few operations a byte whatever the words are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about so many bytes (a longer text makes a run of its own).
RUN_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUES = np.random.Generator(np.random.PCG64(20_240)).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES_LOWER = _VALUES.copy()
_VALUES_LOWER[65:91] = _VALUES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Hands memory that is no longer used back to the machine: workers live on after a large batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: it has its own ways
        return


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):  # tasks make their own
        return _Powers, ()

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, RUN_BYTES + 1)
            kept = []
            for base in (_BASE, _BASE_INVERSE):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                kept.append(np.multiply.accumulate(powers))
            if n > 4 * RUN_BYTES:  # an unusually long text: not worth keeping
                return kept[0], kept[1]
            self.up, self.down = kept
        return self.up, self.down


_POWERS = _Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Run:
    """Some rows of a column. Positions count bytes from the run's first."""

    first: int  # row of the column that is the run's row 0
    data: np.ndarray
    offsets: np.ndarray  # of the rows, one more than rows
    start: np.ndarray  # of each word
    end: np.ndarray
    row: np.ndarray  # of each word

    def _sums(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        up, down = _POWERS.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_VALUES_LOWER if lower else _VALUES)[self.data] * up[: len(self.data)], out=sums[1:])
        return sums, down

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of spans; lower: A-Z count as a-z."""
        sums, down = self._sums(lower)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def words(self, lower: bool = False) -> np.ndarray:
        return self.hashes(self.start, self.end, lower)

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.bincount(self.row, minlength=len(self.offsets) - 1)


def runs(column: pa.Array) -> Iterator[Run]:
    """The column in runs of rows, with the words of each."""
    data, offsets = text_buffers(column)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        part = data[offsets[first] : offsets[last]]
        own = offsets[first : last + 1] - offsets[first]
        inside = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)  # a row begins here
        edge[own] = True
        before = np.zeros(len(part), bool)
        if len(part):
            before[1:] = inside[:-1]
        begins = inside & ~(before & ~edge[:-1])
        after = np.zeros(len(part), bool)
        if len(part):
            after[:-1] = inside[1:]
        ends = inside & ~(after & ~edge[1:])
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(own, start, "right") - 1
        yield Run(first, part, own, start, end, row)
        first = last
    release()


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the runs of size words inside each row; a row of fewer words has all of them as one shingle."""
    count = np.bincount(row, minlength=rows)
    total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        total = total * _STEP + words[k : k + len(total)]
    whole = row[: len(total)] == row[size - 1 :] if len(total) else np.zeros(0, bool)
    long, long_row = mix(total[whole]), row[: len(total)][whole]
    few = np.flatnonzero((count > 0) & (count < size))
    if not len(few):
        return long, long_row
    first = np.cumsum(count) - count
    short = np.zeros(len(few), np.uint64)
    for k in range(size - 1):
        more = count[few] > k
        short[more] = short[more] * _STEP + words[first[few[more]] + k]
    short = mix(short + count[few].astype(np.uint64))
    rows_of = np.concatenate([long_row, few])
    order = np.argsort(rows_of, kind="stable")
    return np.concatenate([long, short])[order], rows_of[order]
