"""Whole-text scans in numpy: words, 64-bit word hashes and rolling n-gram hashes of many texts at once.

A group of texts is one UTF-8 buffer with offsets.  Words are runs of bytes other than space and
0x09-0x0D, which are the runs of code points of the same definition, for UTF-8 never holds those bytes
inside a longer code point.  Groups hold about ``GROUP_BYTES``; a longer text is a group by itself, so memory follows
the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    ups, downs = np.full(size, _BASE, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


_table = _powers(1)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` powers or more of the base and of its inverse modulo 2**64: one table, which grows with the longest text."""
    global _table
    if len(_table[0]) < size:
        _table = _powers(1 << int(size - 1).bit_length())
    return _table


@dataclass
class Group:
    """Texts ``first`` to ``first + len(offsets) - 1`` of a batch, and their words."""

    first: int
    data: np.ndarray  # the bytes, as given
    offsets: np.ndarray  # one more than texts
    starts: np.ndarray  # byte position of each word
    ends: np.ndarray
    doc: np.ndarray  # text of each word, from 0

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def words_per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.size).astype(np.int64)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``lower`` maps A-Z first."""
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        data = _LOWER[self.data] if lower else self.data
        ups, downs = powers(len(data) + 1)
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * ups[: len(data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * downs[self.starts])


def groups(column: pa.Array, limit: int = GROUP_BYTES, breaks: np.ndarray = _SPACE) -> Iterator[Group]:
    """The texts of an Arrow string column without nulls, group by group; ``breaks`` says which bytes part words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield _scan(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], breaks)
        first = last


def _scan(first: int, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> Group:
    inside = ~breaks[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Group(first, data, offsets, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each run of ``n`` words that lies in one text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero(doc[: count] == doc[n - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):  # Horner's rule over the window
        total = total * _BASE + hashes[at + k]
    return mix(total + np.uint64(n)), at


def repeated(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry, whether its (text, key) occurs twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.lexsort((keys, doc))
        same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def later_copy(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry, whether an earlier entry has the same (text, key)."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.lexsort((np.arange(len(keys)), keys, doc))
        same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out[order[1:][same]] = True
    return out


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a run of ``n`` that begins at one of ``at``."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0
