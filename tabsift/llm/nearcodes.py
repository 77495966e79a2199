"""All pairs of 128-bit codes that differ in at most 20 bits, searched in buckets.

Search is exact. A code is a ring of 7 segments of 18 or 19 bits. Were each to differ
in 3 bits, that would be 21, so a pair within 20 has a segment from which on every
chain of l consecutive segments differs in at most 3 * l - 1 bits (the pigeonring, by
the cycle lemma): the segment itself in 2 bits, and it with the next three in 11.
* Two bits break two of the three parts of 6 or 7 bits of that segment at most, so
  codes are routed by each part of each segment, 21 rows a code, and meet there.
* In a bucket, codes are put into cells by bits of the rest of the segment, as many as
  leave some FILL codes a cell, those that split the bucket best. A cell is compared
  with the cells that differ from it in at most 2 of these bits.
* Such a comparison is one block: an exclusive or and a count over the next three
  segments, in 64 bits. What stays within the chain's budget there, which few
  unrelated codes do, is compared in full.
A bucket emits a spanning star per component, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa

from tabsift.llm import kernels as K

DISTANCE = 20
_WIDTHS = (19, 18, 18, 18, 19, 18, 18)
_STARTS = np.concatenate(([0], np.cumsum(_WIDTHS)))
#: (segment, first bit, bits) of each part; kinds of buckets are its indices.
PARTS = [(s, int(_STARTS[s]) + a, b) for s, w in enumerate(_WIDTHS) for a, b in ((0, w - 12), (w - 12, 6), (w - 6, 6))]
VALUES = 128
#: None changes any result.
FILL, _ROW, _CELLS, _HITS = 12, 1 << 12, 1 << 16, 1 << 16


def as_bytes(raw: pa.Array) -> np.ndarray:
    """Codes of a column as an array of n x 16 bytes."""
    return K.buffers(raw.cast(pa.binary()).view(pa.string()))[0].reshape(-1, 16)


def words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of n x 16 bytes as their first and last 64 bits."""
    both = np.ascontiguousarray(code).view(">u8").astype(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _from(hi: np.ndarray, lo: np.ndarray, at: int, bits: int) -> np.ndarray:
    """Some bits, 64 at most, of the ring from one on."""
    if at % 128 >= 64:
        hi, lo = lo, hi
    at %= 64
    if at:
        hi = (hi << np.uint64(at)) | (lo >> np.uint64(64 - at))
    return hi >> np.uint64(64 - bits)


def buckets(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The bucket of each part of each code, kind * VALUES + value."""
    return np.stack([(k * VALUES + _from(hi, lo, at, bits)).astype(np.int32) for k, (_, at, bits) in enumerate(PARTS)], axis=1)


def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, code): each code under the bucket of each of its parts."""
    for b in batches:
        bucket = buckets(*words(as_bytes(b.column(0))))
        again = np.repeat(np.arange(len(bucket)), len(PARTS))
        yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1)), b.column(0).take(pa.array(again))], ["bucket", "code"])


def _cells(hi: np.ndarray, lo: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each code, masks by which cells that must be compared differ)."""
    segment, start = PARTS[kind][0], int(_STARTS[PARTS[kind][0]])
    part = [k for k, p in enumerate(PARTS) if p[0] == segment for _ in range(p[2])]
    free = np.array([start + i for i, k in enumerate(part) if k != kind])
    take = min(max(0, (len(hi) // FILL).bit_length() - 1), len(free))
    bits = [_from(hi, lo, b, 1) for b in free]
    used = np.argsort([abs(2 * float(x.mean()) - 1) for x in bits], kind="stable")[:take] if take else []
    cell, members = np.zeros(len(hi), np.int64), {}
    for i, b in enumerate(used):
        cell |= bits[b].astype(np.int64) << i
        k = part[free[b] - start]
        members[k] = members.get(k, 0) | 1 << i
    masks = [sum(1 << i for i in c) for size in range(3) for c in combinations(range(take), size)]
    # where an earlier part is equal too, the pair meets in that part's bucket
    for k, m in members.items():
        if k < kind and m.bit_count() == PARTS[k][2]:
            masks = [x for x in masks if x & m]
    return cell, np.array(masks, np.int64)


def pairs(code: np.ndarray, kind: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within DISTANCE of a bucket of this kind, each once, in bounded blocks.

    Pairs whose chain of segments starts elsewhere, or that meet in the bucket of an
    earlier part, may be left to the other bucket. With labels, which may change in
    between, pairs of equal labels are left out.
    """
    if not len(code):
        return
    hi, lo = words(code)
    segment = PARTS[kind][0]
    cell, masks = _cells(hi, lo, kind)
    by = np.argsort(cell, kind="stable")
    chain = sum(_WIDTHS[(segment + k) % 7] for k in (1, 2, 3))
    after = _from(hi, lo, int(_STARTS[segment + 1]), chain)[by]
    count = np.bincount(cell, minlength=1 << max(int(x.max()).bit_length() for x in (cell, masks) if len(x)))
    first = np.cumsum(count) - count
    budget = (3 * 4 - 1 - np.bitwise_count(masks)).astype(np.uint8)
    x, bits, on = np.empty(_CELLS, np.uint64), np.empty(_CELLS, np.uint8), np.zeros(_CELLS, bool)
    found, size = [], 0
    for u in np.flatnonzero(count):
        v = u ^ masks
        some = np.flatnonzero((v >= u) & (count[v] > 0))
        if not len(some):
            continue
        v = v[some]
        n, begin = count[v], first[v]
        ends = np.cumsum(n)
        near = np.concatenate([after[p:q] for p, q in zip(begin.tolist(), (begin + n).tolist())])
        most = np.repeat(budget[some], n)
        a, b = int(first[u]), int(first[u] + count[u])
        for c in range(0, len(near), _ROW):
            row, within = near[c : c + _ROW], most[c : c + _ROW]
            m = len(row)
            step = _CELLS // m
            for r in range(a, b, step):
                rows = min(step, b - r)
                k, shape = rows * m, (rows, m)
                np.bitwise_xor(after[r : r + rows, None], row, out=x[:k].reshape(shape))
                np.bitwise_count(x[:k], out=bits[:k])
                np.less_equal(bits[:k].reshape(shape), within, out=on[:k].reshape(shape))
                on[k : k + -k % 8] = False
                hit = np.flatnonzero(on[: k + -k % 8].view(np.uint64))  # eight at a time, as few are on
                if len(hit):
                    hit = (8 * hit[:, None] + np.arange(8)).reshape(-1)
                    i, j = np.divmod(hit[on[hit]], m)
                    t = np.searchsorted(ends, c + j, side="right")
                    i, j = r + i, begin[t] + c + j - (ends[t] - n[t])
                    ok = i < j
                    found.append((i[ok], j[ok]))
                    size += len(found[-1][0])
            if size >= _HITS:
                yield _full(found, hi, lo, by, label)
                found, size = [], 0
    if size:
        yield _full(found, hi, lo, by, label)


def _full(found: list[tuple[np.ndarray, np.ndarray]], hi: np.ndarray, lo: np.ndarray, by: np.ndarray, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    i, j = (by[np.concatenate(k)] for k in zip(*found))
    if label is not None:
        ok = label[i] != label[j]
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(hi[i] ^ hi[j]) + np.bitwise_count(lo[i] ^ lo[j]) <= DISTANCE
    i, j = i[ok], j[ok]
    return np.minimum(i, j), np.maximum(i, j)


def star(key: tuple, table: pa.Table) -> pa.Table:
    """(a, b): a spanning star of each component among the codes of a bucket."""
    raw = table.column("code").combine_chunks()
    code = as_bytes(raw)
    label = np.arange(len(code))
    for i, j in pairs(code, key[0].as_py() // VALUES, label):
        while True:
            a, b = label[i], label[j]
            ok = a != b
            if not ok.any():
                break
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
    moved = np.flatnonzero(label != np.arange(len(code)))
    return pa.table({"a": raw.take(pa.array(moved)), "b": raw.take(pa.array(label[moved]))}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))
