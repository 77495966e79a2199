"""Vectorised hashing over the UTF-8 buffers of Arrow string columns.

No function here makes a Python object per word: words, lines and k-mers are
found with numpy over bytes, and are hashed as multilinear sums modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at a time; bounds the working memory, never the result.
BLOCK = 1 << 20

_BYTE = np.arange(256)
#: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = (
    ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
)
NOT_SPACE = ~np.isin(_BYTE, [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values; seeds give independent hashes."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_KEY = mix(np.arange(256, dtype=U64), 11)
_POS_KEY = mix(np.arange(4096, dtype=U64), 12) | U64(1)


def _position_keys(pos: np.ndarray) -> np.ndarray:
    if len(pos) == 0 or pos.max() < len(_POS_KEY):
        return _POS_KEY[pos]
    return mix(pos.astype(U64), 12) | U64(1)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _cuts(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of about BLOCK that break no token: they end at a row's end, or where ``inside`` is false."""
    ends, out, at, n = offs[1:], [], 0, int(offs[-1])
    while at < n:
        to = min(at + BLOCK, n)
        if to < n:
            k = int(np.searchsorted(ends, to, side="right")) - 1
            if k >= 0 and ends[k] > at:
                to = int(ends[k])
            else:
                limit = int(ends[k + 1])
                while to < limit:
                    gap = np.flatnonzero(~inside[data[to : to + BLOCK]])
                    if len(gap):
                        to = min(to + int(gap[0]), limit)
                        break
                    to = min(to + BLOCK, limit)
        out.append((at, to))
        at = to
    return out


def tokens(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every maximal run of bytes for which ``inside`` holds, in order."""
    return tokens_at(data, offs, inside)[:2]


def tokens_at(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place of the first byte), as tokens()."""
    hashes, rows, places = [], [], []
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    for a, b in _cuts(data, offs, inside):
        part = data[a:b]
        on = inside[part]
        start = on.copy()
        start[1:] &= ~on[:-1]
        lo, hi = np.searchsorted(firsts, [a, b])
        start[firsts[lo:hi] - a] = on[firsts[lo:hi] - a]
        at = np.flatnonzero(on)
        if not len(at):
            continue
        head = start[at]
        begin = np.flatnonzero(head)
        pos = at - at[begin][np.cumsum(head) - 1]
        hashes.append(mix(np.add.reduceat(_BYTE_KEY[part[at]] * _position_keys(pos), begin)))
        places.append(at[begin] + a)
        rows.append(np.searchsorted(offs, places[-1], side="right") - 1)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)


def lower(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    return pc.utf8_lower(column)


def groups(sorted_rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of rows 0..n-1 in an ascending array of row numbers."""
    return np.searchsorted(sorted_rows, np.arange(n + 1))


def list_array(values: pa.Array | np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
