"""SimHash near-duplicates, found exactly among all codes.

A document's 128-bit code sums, over its distinct lower-cased words weighted by
the square root of their count, one pseudo-random sign vector per word. Two
documents are near duplicates when their codes differ in at most 20 bits.

Search is exact; nearcodes has it.

Groups are the connected components of the pairs. A bucket emits a spanning
star per component, never its pairs, so that copies by the thousand stay linear
in rows; components are then closed by alternating large-star and small-star
steps over written tables.

Defined results:
* null, empty and word-less texts have no code: they are in no group and stay;
* documents with equal words and counts have equal codes and are one group;
* the least document of a group (by id, null first, then text hash) is kept;
* rows that repeat both id and text are one document in the result, and the
  filter keeps a single row of them if they have a code;
* very long texts are summed in blocks; every word counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tabsift.llm import kernels as K
from tabsift.llm import nearcodes
from tabsift.llm.common import col, free_name, key_type, shared_dir, stash

BITS, SEGMENTS, MAX_DISTANCE, CHAIN = 128, 8, nearcodes.DISTANCE, 3
#: Each choice of a half from both bytes of a segment; kinds of buckets are the bytes, then halves of the first 5 segments.
_HALVES = [(0xF0, 0xF0), (0xF0, 0x0F), (0x0F, 0xF0), (0x0F, 0x0F)]
_WHOLE = [(s, h) for s in range(5) for h in range(4)]
_KINDS = 16 + len(_WHOLE)
_ROWS, _PAIRS, _CELLS = 1 << 15, 1 << 20, 1 << 15
#: Neither changes any result.
DENSE, FEW = 1024, 16


def codes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as an array of n x 16 bytes, whether the row has any word)."""
    data, offs = K.buffers(K.lower(texts))
    n = len(offs) - 1
    out, has = np.zeros((n, 16), np.uint8), np.zeros(n, bool)
    words, rows = K.tokens(data, offs)
    at = K.groups(rows, n)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + (1 << 18), side="right")) - 1)
        a, b = at[first], at[last]
        if a < b:
            _sum(words[a:b], rows[a:b] - first, out[first:last], has[first:last])
        first = last
    return out, has


def _sum(words: np.ndarray, rows: np.ndarray, out: np.ndarray, has: np.ndarray) -> None:
    shift = np.uint64(44)
    key = np.sort((rows.astype(np.uint64) << shift) | (words >> np.uint64(20)))
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = np.rint(16 * np.sqrt(np.diff(np.append(begin, len(key))))).astype(np.int32)
    key = key[begin]
    row, feature = (key >> shift).astype(np.int64), key & np.uint64((1 << 44) - 1)
    ones, total = np.zeros((len(out), BITS), np.int64), np.zeros(len(out), np.int64)
    for a in range(0, len(key), _ROWS):
        f, w, r = feature[a : a + _ROWS], weight[a : a + _ROWS], row[a : a + _ROWS]
        bits = np.unpackbits(np.stack([K.mix(f, 21), K.mix(f, 22)], 1).view(np.uint8), axis=1)
        heads = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        np.add.at(ones, r[heads], np.add.reduceat(bits * w[:, None], heads, axis=0))
        np.add.at(total, r[heads], np.add.reduceat(w, heads))
    out[:] = np.packbits(2 * ones > total[:, None], axis=1)
    has[:] = total > 0


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code, has = codes(b.column(2))
        keep = pa.array(has)
        whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(has), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), whole], ["doc_id", "th", "code"]).filter(keep)


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, code): one row per document row that has a word; th is the text's 64-bit hash."""
    picked = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_coded, f"doc_id {key_type(picked, 'doc_id')}, th bigint, code binary")


# The search below, from _half to pairs_in_bucket, is the one before nearcodes. No query
# uses it; it stays as a second exact search, by other routes, that tests compare with.
#
# Search is exact. Of the 16 bytes of two codes within 20 bits, call one that
# differs in both its halves of 4 bits broken; it takes 2 bits at least.
# * Two bytes or more agree: the pair meets in the bucket of the first of them,
#   (byte, value of the byte), at the value of the second.
# * One byte agrees: the other 15 differ, so 5 are broken at most. They break 5 of
#   the 7 pairs of bytes (segments) elsewhere, so of any 6 one is whole: it has an
#   equal half in both of its bytes, and these halves are looked up in the bucket.
# * None agrees: 4 bytes are broken at most, so of any 6 segments two are whole.
#   Codes are routed by the halves of the first 5 segments as well, and in such a
#   bucket the halves of a later one among the first 6 are looked up.
# A bucket's codes are compared in blocks, all with all: a cell of a block is an
# exclusive or and a count of bits over contiguous arrays, some tenth of what it costs
# to form a single pair. Only a bucket that is large for its number of look-ups (DENSE
# codes for each) is split by them, and then its groups are blocks. What meets in groups
# of FEW codes or less is formed singly and pruned by the pigeonring: on the ring of 8
# segments of 16 bits, a pair within 20 bits has a segment from which on every chain of
# l consecutive segments differs in at most l * 20 / 8 bits, so that chains of one, two
# and three segments must stay within 2, 5 and 7 bits from a common start. Few unrelated
# pairs do, and only what does gets the full Hamming check. (Chains can't do the routing
# too at this distance: they start at segments that differ in up to 2 bits, which 0.017
# of all pairs have.)


def _half(code: np.ndarray, segment: int, h: int) -> np.ndarray:
    """One half of both bytes of a segment, as a byte."""
    a, b = _HALVES[h]
    x, y = code[:, 2 * segment] & np.uint8(a), code[:, 2 * segment + 1] & np.uint8(b)
    return (x if a == 0xF0 else x << np.uint8(4)) | (y if b == 0x0F else y >> np.uint8(4))


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each code 36 times, under the bucket of each of its bytes and of the halves of its first segments."""
    for b in batches:
        code = nearcodes.as_bytes(b.column(0))
        n = len(code)
        kinds = np.hstack([code, *(_half(code, s, h)[:, None] for s, h in _WHOLE)])
        bucket = (np.arange(_KINDS, dtype=np.int32)[None, :] * 256 + kinds).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0).take(pa.array(np.repeat(np.arange(n), _KINDS)))], ["bucket", "code"])


def _equal(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal keys, each pair once, in bounded blocks."""
    n = len(key)
    by = np.argsort(key, kind="stable")
    size = np.searchsorted(key[by], key[by], side="right") - np.arange(n) - 1  # later ones of the same key
    ends = np.cumsum(size)
    total = int(ends[-1]) if n else 0
    for start in range(0, total, _PAIRS):
        stop = min(start + _PAIRS, total)
        p, q = np.searchsorted(ends, [start, stop - 1], side="right")
        k = np.repeat(np.arange(p, q + 1), np.minimum(ends[p : q + 1], stop) - np.maximum(ends[p : q + 1] - size[p : q + 1], start))
        yield by[k], by[k + 1 + np.arange(start, stop) - (ends[k] - size[k])]


_LANES = [(1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF)]


def _ring(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which differences of codes have a chain of segments within its budgets, CHAIN of them."""
    parts = []
    for x in (hi, lo):
        for shift, mask in _LANES:  # bits counted within each segment
            x = (x & np.uint64(mask)) + ((x >> np.uint64(shift)) & np.uint64(mask))
        parts.append(x.view("<u2").reshape(-1, SEGMENTS // 2).astype(np.uint8))
    segment = np.hstack(parts)
    total, ok = np.zeros_like(segment), np.ones(segment.shape, bool)
    for l in range(CHAIN):
        total = total + np.roll(segment, -l, axis=1)
        ok &= total <= (l + 1) * MAX_DISTANCE // SEGMENTS
    return ok.any(axis=1)


def _near(hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within MAX_DISTANCE, each once, by blocks of some _CELLS comparisons."""
    n, a = len(hi), 0
    while a < n - 1:
        m = n - a
        b = min(n, a + max(1, _CELLS // m))
        x = np.bitwise_count(hi[a:b, None] ^ hi[None, a:])
        x += np.bitwise_count(lo[a:b, None] ^ lo[None, a:])
        i, j = np.divmod(np.flatnonzero(x <= MAX_DISTANCE), m)
        ok = i < j
        yield a + i[ok], a + j[ok]
        a = b


def _met(key: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within MAX_DISTANCE of equal 8-bit keys, each once."""
    by = np.argsort(key, kind="stable")
    size = np.bincount(key, minlength=256)
    h, l, ends = hi[by], lo[by], np.cumsum(size)
    for k in np.flatnonzero(size > FEW):
        group = slice(ends[k] - size[k], ends[k])
        for i, j in _near(h[group], l[group]):
            yield by[group][i], by[group][j]
    rest = np.flatnonzero(size[key] <= FEW)
    for i, j in _equal(key[rest]):
        i, j = rest[i], rest[j]
        x, y = hi[i] ^ hi[j], lo[i] ^ lo[j]
        ok = _ring(x, y)
        i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        ok = np.bitwise_count(x) + np.bitwise_count(y) <= MAX_DISTANCE
        yield i[ok], j[ok]


def pairs_in_bucket(code: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within MAX_DISTANCE that a bucket of this kind must find, in bounded blocks; some come more than once."""
    if kind < 16:
        later = range(kind + 1, 16)
        halves = [(s, h) for s in [s for s in range(SEGMENTS) if s != kind // 2][:6] for h in range(4)]
    else:
        later = range(0)
        halves = [(s, h) for s in range(_WHOLE[kind - 16][0] + 1, 6) for h in range(4)]
    both = np.ascontiguousarray(code).view(np.uint64)
    hi, lo = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    if len(code) <= DENSE * (len(later) + len(halves)):
        found = _near(hi, lo)
    else:
        keys = chain((code[:, c] for c in later), (_half(code, s, h) for s, h in halves))
        found = chain.from_iterable(_met(key, hi, lo) for key in keys)
    parts, size = [], 0
    for i, j in found:
        if len(i):
            parts.append((np.minimum(i, j), np.maximum(i, j)))
            size += len(i)
        if size >= _PAIRS // 16:
            yield tuple(map(np.concatenate, zip(*parts)))
            parts, size = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of an edge list with b, the least node of its component; b itself isn't listed.

    Alternating large-star and small-star; every step is a written table. It
    ends when a step changes nothing, which is a star per component.
    """
    spark, seen = edges.sparkSession, None
    edges = stash(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        stat = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if stat["n"] == 0 or (stat["n"], stat["s"]) == seen:
            return edges
        seen = (stat["n"], stat["s"])
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        large = least.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = least.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stash(small.filter(F.col("a") != F.col("b")).distinct(), shared_dir(spark))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, keep_id, keep_th) for each document in a group of two or more, with the document that stays."""
    code = stash(coded(docs, id_col, text_col))
    unique = code.select("code").distinct()
    edges = unique.mapInArrow(nearcodes.routes, "bucket int, code binary").groupBy("bucket").applyInArrow(nearcodes.star, "a binary, b binary")
    labels = components(edges)
    named = code.distinct().join(labels, F.col("code") == F.col("a"), "left").select("doc_id", "th", F.coalesce("b", "code").alias("c"))
    keeper = named.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th")).alias("k")).filter("n > 1")
    return named.join(keeper, "c").select("doc_id", "th", F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, duplicate_of): every document that goes, with the one of its group that stays."""
    g = grouped(docs, id_col, text_col)
    gone = ~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th")))
    return g.filter(gone).select("doc_id", F.col("keep_id").alias("duplicate_of"))


def _orderable(kind: DataType) -> bool:
    """Whether rows can be sorted by values of this type; maps have no order, wherever they are inside."""
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    return kind.typeName() not in ("map", "variant")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one document of each group; of rows that repeat id and text one stays."""
    g = grouped(docs, id_col, text_col)
    k1, k2, nth, gone_1, gone_2 = (free_name(docs, n) for n in ("__k1", "__k2", "__nth", "__gone_1", "__gone_2"))
    # two hashes of id and text, 128 bits in all, by which rows are exchanged once for the join and for the row numbers
    both = lambda i, th: (F.xxhash64(i, th), F.xxhash64(th, i, F.lit(1)))
    gone = g.filter(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))))
    one, two = both(F.col("doc_id"), F.col("th"))
    gone = gone.select(one.alias(gone_1), two.alias(gone_2))
    one, two = both(col(id_col), F.xxhash64(col(text_col)))
    left = docs.withColumns({k1: one, k2: two}).join(gone, (col(k1) == col(gone_1)) & (col(k2) == col(gone_2)), "left_anti")
    order = Window.partitionBy(col(k1), col(k2)).orderBy(*[col(f.name) for f in docs.schema if f.name not in (id_col, text_col) and _orderable(f.dataType)] or [col(k1)])
    has_word = col(text_col).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    return left.withColumn(nth, F.row_number().over(order)).filter((col(nth) == 1) | ~F.coalesce(has_word, F.lit(False))).drop(k1, k2, nth)
