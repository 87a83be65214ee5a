"""Words of Arrow text columns as 64-bit hashes, by whole-array operations.

Separators are ASCII bytes, so words are found in the UTF-8 bytes: no byte of a longer character is ASCII.
A word's hash is a polynomial of its bytes with an odd base, mixed with its length; two of n different
words share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
LOT_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Separators: white space, or every ASCII character that is neither a digit nor a lower-case letter.
WHITE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
NOT_ALNUM = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
LOWERED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype("u1")
AS_IS = _BYTES.astype("u1")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, "u8")
    out[1:] = BASE
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[starts[i]:ends[i]], in lots of bounded size."""
    out = np.empty(len(starts), "u8")
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + LOT_BYTES)))
        s, e = starts[at:to], ends[at:to]
        longest = int((e - s).max())
        powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
        lo, hi = int(s[0]), int(e[-1])
        value = data[lo:hi].astype("u8") + np.uint64(1)
        place = np.arange(hi - lo, dtype="i8") - np.repeat(s - lo, np.diff(np.append(s, hi)))
        inside = place < np.repeat(e - s, np.diff(np.append(s, hi)))
        value *= powers[np.where(inside, place, 0)]
        value[~inside] = 0
        total = np.add.reduceat(value, s - lo)
        out[at:to] = mix(total + (e - s).astype("u8") * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


@dataclass
class Lot:
    """Words of some texts: hashes, byte places in ``data``, the first word and the first byte of every text."""

    rows: slice
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k]:self.bounds[k + 1]]


def lots(column: pa.Array, separators: np.ndarray, letters: np.ndarray = AS_IS, lot_bytes: int = LOT_BYTES) -> Iterator[Lot]:
    """Consecutive texts of a string column in lots of about ``lot_bytes``; a longer text is a lot of its own.

    Nulls have no words.
    """
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], "i8" if wide else "i4")[column.offset:column.offset + n + 1].astype("i8")
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, "u1") if raw else np.empty(0, "u1")
    row = 0
    while row < n:
        to = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + lot_bytes))))
        data = letters[raw[offsets[row]:offsets[to]]]
        texts = offsets[row:to + 1] - offsets[row]
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        # a word ends with its text
        edges = texts[(texts > 0) & (texts < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Lot(slice(row, to), data, _hashes(data, starts, stops), starts, stops, np.searchsorted(starts, texts), texts)
        row = to


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; empty where there are fewer."""
    if len(words) < n:
        return np.empty(0, "u8")
    count = len(words) - n + 1
    total = np.zeros(count, "u8")
    for k in range(n):
        total = total * BASE + words[k:k + count]
    return mix(total + np.uint64(n))
