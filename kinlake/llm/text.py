"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Everything works on the UTF-8
bytes of whole texts; a null text counts as empty. Texts are taken in chunks of about a
megabyte, so the arrays stay small however many rows a batch has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
LONG_WORD = 1 << 16
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_N = CHUNK_BYTES + LONG_WORD + 1
_POW = np.full(_N, _P, np.uint64)
_POW[0] = 1
_POW = np.cumprod(_POW)
_INV = np.full(_N, pow(_P, -1, 1 << 64), np.uint64)
_INV[0] = 1
_INV = np.cumprod(_INV)


def large_strings(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each row's text in them) for runs of whole texts."""
    column = large_strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (and the total)."""
    word = ~_BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower folds A-Z first."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    if lower:
        data = _LOWER[data]
    long = ends - starts > LONG_WORD
    first = 0
    while first < len(starts):
        stop = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_BYTES)))
        keep = ~long[first:stop]
        if keep.any():
            s, e = starts[first:stop][keep], ends[first:stop][keep]
            base, last = s[0], e[-1]  # a long word ends its group, so what is left spans at most _N bytes
            run = np.zeros(last - base + 1, np.uint64)
            np.cumsum(_CHAR[data[base:last]] * _POW[: last - base], out=run[1:])
            value = (run[e - base] - run[s - base]) * _INV[s - base]
            out[first:stop][keep] = mix(value + (e - s).astype(np.uint64) * np.uint64(_P))
        first = stop
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive values, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc, acc_len, cur, cur_len, bits = None, 0, values, 1, k
    while bits:
        if bits & 1:
            if acc is None:
                acc, acc_len = cur, cur_len
            else:
                m = len(values) - acc_len - cur_len + 1
                acc = acc[:m] + np.uint64(pow(_P, acc_len, 1 << 64)) * cur[acc_len : acc_len + m]
                acc_len += cur_len
        bits >>= 1
        if bits:
            m = len(values) - 2 * cur_len + 1
            cur = cur[:m] + np.uint64(pow(_P, cur_len, 1 << 64)) * cur[cur_len : cur_len + m]
            cur_len *= 2
    return mix(acc[:n] + np.uint64(k * _P & _M64))


def text_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Which starts of k consecutive words lie within one text, by word index."""
    total = int(first[-1])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[: total - k + 1] == doc[k - 1 :] if total >= k else np.zeros(0, bool)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
