"""Vectorised reading of Arrow text columns: words, word hashes and n-gram hashes of a whole batch at once.

A word is a maximal run of bytes outside ASCII white space (0x20, 0x09 to 0x0D); null texts read as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = (~SPACE).astype(np.uint8)
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: Letters, digits and bytes above ASCII are one kind, other printable characters another.
SPLIT = WORD * 2
SPLIT[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SPLIT[_a:_b] = 1
SLICE = 1 << 19  # bytes hashed at a time

_rng = np.random.Generator(np.random.PCG64(20240229))
_POS = _rng.integers(1, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)
_FAR = _rng.integers(1, 2**64, 1 << 12, dtype=np.uint64) | np.uint64(1)
GRAM = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = col.buffers()
    off = np.frombuffer(raw[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def row_slices(off: np.ndarray, limit: int):
    """(first, end) row ranges of at most `limit` bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, off: np.ndarray, kinds: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the offset of its first word (n + 1 entries).

    A word is a run of bytes of one kind other than 0, inside a row.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = kinds[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    first = (kind != 0) & edge[:-1]
    last = (kind != 0) & edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit multilinear hash of each word, after `fold` is applied to its bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lens = ends[i:j] - starts[i:j]
        first = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
        byte = fold[data[pos + np.repeat(starts[i:j], lens)]].astype(np.uint64) + np.uint64(1)
        if int(lens.max()) > len(_POS):
            byte *= _FAR[(pos >> 16) & 0xFFF]
            pos &= 0xFFFF
        byte *= _POS[pos]
        out[i:j] = np.add.reduceat(byte, first) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        i = j
    return mix(out)


def grams(words: np.ndarray, first: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles inside rows, and the row of each.

    `first` holds each row's first word (rows + 1 entries). With `whole_if_short` a row of 1 to n - 1 words gives one
    shingle of all its words.
    """
    count = np.diff(first)
    at = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    ok = np.ones(len(words), bool)
    for back in range(1, n):  # a shingle may not start in the last n - 1 words of a row
        tail = first[1:] - back
        ok[tail[tail >= first[:-1]]] = False
    start = np.flatnonzero(ok)
    h = np.full(len(start), np.uint64(n), np.uint64)
    for k in range(n):
        h += words[start + k] * GRAM[k]
    h = mix(h)
    if whole_if_short and (short := np.flatnonzero((count > 0) & (count < n))).size:
        extra = count[short].astype(np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] += words[first[short[has]] + k] * GRAM[k]
        h, at = np.concatenate([h, mix(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark longs with the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
