"""Vectorised text kernels shared by the duplicate-finding operators.

All of them work on one batch of whole texts at a time: the texts are laid end to end as UTF-8 in one
numpy byte array, and words, hashes and windows are computed for the batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], U64)


def lay_out(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (an Arrow string array or strings), each followed by one space and the
    whole by padding; and the offset at which each text begins (one more than there are texts). Null
    counts as an empty text."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    joined = pc.binary_join_element_wise(column, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    n = len(joined)
    if not n:
        return np.full(8, 0x20, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[at[0] : at[-1]]
    data = np.concatenate([data, np.full(8, 0x20, np.uint8)])
    return (_LOWER[data] if lower else data), at - at[0]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (one more than texts)."""
    body = data[: at[-1]]
    gap = _SPACE[body]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1 if len(gap) else np.zeros(0, np.int64)
    if len(gap) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche permutation of 64-bit values (in place)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes and the length of each word, eight bytes at a time."""
    lanes = np.lib.stride_tricks.as_strided(data.view(), (max(len(data) - 7, 0), 8), (1, 1), writeable=False)
    size = ends - starts
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    live, pos, left = np.arange(len(starts)), starts, size
    while len(live):
        lane = np.ascontiguousarray(lanes[pos]).view(U64).ravel() & _MASKS[np.minimum(left, 8)]
        part = mix((h[live] if len(live) < len(h) else h) ^ lane)
        part += U64(0x9E3779B97F4A7C15)
        if len(live) < len(h):
            h[live] = part
        else:
            h = part
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


def window_hashes(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values of h (shorter by size - 1), with the odd multiplier base."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= U64(base)
        out += h[k : k + n]
    return mix(out)


BASE_A, BASE_B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words at which a window of `size` words of one text starts."""
    n = int(first[-1])
    ok = np.ones(max(n, 0), bool)
    for back in range(1, size):
        ends = first[1:] - back
        ok[ends[ends >= first[:-1]]] = False
    return np.flatnonzero(ok)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of `size` items that begins at one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0
