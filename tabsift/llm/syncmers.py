"""Document fingerprints: closed syncmers as anchors for positional matching.

A k-mer is k consecutive code points. It is a closed syncmer when the least of
its inner s-mers, by hash, stands at its first or its last place. Whether a
k-mer is chosen depends on its own characters alone, so a shared passage gives
the same anchors in every document, whatever stands around it; and of any k - s
+ 1 consecutive k-mers one is chosen at least, so no passage of 2 * k - s
characters goes without an anchor.

Defined results:
* null and empty texts, and texts shorter than k, have no anchors (empty lists);
* if several s-mers of a k-mer tie for the least hash, an edge among them counts;
* every row gives one row, repeated rows and null ids too;
* long texts are handled in overlapping blocks, with the same anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm import kernels as K
from tabsift.llm.common import col, key_type

K_LEN, S_LEN = 47, 16
_BASE = 0x9E3779B97F4A7C15 | 1


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each n consecutive values, by doubling."""
    power, have, out, used = _BASE, x, None, 0
    size, mask = 1, 0xFFFFFFFFFFFFFFFF
    while size <= n:
        if n & size:
            if out is None:
                out, used = have, size
            else:
                m = len(x) - used - size + 1
                out = out[:m] * K.U64(power) + have[used : used + m]
                used += size
        m = len(have) - size
        have = have[: max(m, 0)] * K.U64(power) + have[size:] if m > 0 else have[:0]
        power = power * power & mask
        size *= 2
    return out[: len(x) - n + 1]


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values, by doubling."""
    size, have = 1, x
    while size * 2 <= n:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return have if size == n else np.minimum(have[: len(x) - n + 1], have[n - size :])


def anchors(points: np.ndarray, k: int = K_LEN, s: int = S_LEN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of an array of code points."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    x = K.mix(points.astype(K.U64), 31)
    small = K.mix(_rolling(x, s), 32)
    w = k - s + 1
    least = _window_min(small, w)
    at = np.flatnonzero((small[: len(least)] == least) | (small[w - 1 :] == least))
    # k-mers are hashed only where chosen: as the hashes of s-mers that cover them
    h = np.zeros(len(at), K.U64)
    for d in [*range(0, k - s, s), k - s]:
        h = K.mix(h ^ small[at + d], 33)
    return at, h


def _points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def fingerprint(texts: pa.Array, k: int = K_LEN, s: int = S_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by row, positions, hashes) over a column of texts."""
    data, offs = K.buffers(texts)
    n = len(offs) - 1
    counts, positions, hashes = np.zeros(n, np.int64), [], []
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + K.BLOCK, side="right")) - 1)
        points = _points(data[offs[first] : offs[last]])
        heads = np.flatnonzero((data[offs[first] : offs[last]] & 0xC0) != 0x80)
        starts = np.searchsorted(heads, offs[first : last + 1] - offs[first])
        for a in range(0, max(len(points) - k + 1, 0), K.BLOCK):
            at, h = anchors(points[a : a + K.BLOCK + k - 1], k, s)
            at = at + a
            row = np.searchsorted(starts, at, side="right") - 1
            ok = at + k <= starts[row + 1]
            at, h, row = at[ok], h[ok], row[ok]
            np.add.at(counts, row + first, 1)
            positions.append((at - starts[row]).astype(np.int32))
            hashes.append(h)
        first = last
    offs = np.concatenate(([0], np.cumsum(counts)))
    empty = not positions
    return offs, np.zeros(0, np.int32) if empty else np.concatenate(positions), np.zeros(0, K.U64) if empty else np.concatenate(hashes)


def _slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most 16 MB of text or one row each, so that lists stay below their limits."""
    _, offs = K.buffers(b.column(text))
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + (16 << 20), side="right")) - 1)
        yield b.slice(first, last - first)
        first = last


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_LEN, s: int = S_LEN) -> DataFrame:
    """(doc_id, n_kmers, positions, hashes): the anchors of every row, in order of position.

    Two documents match at (i, j) where hashes[i] = hashes[j]; equal differences
    of positions line the matches up. k and s are lengths in code points.
    """
    if not 0 < s < k:
        raise ValueError("s must be from 1 to k - 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 2):
                offs, at, h = fingerprint(b.column(2), k, s)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), K.list_array(at, offs), K.list_array(K.as_long(h), offs)], ["doc_id", "n_kmers", "positions", "hashes"])

    picked = docs.select(col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.length(col(text_col)), F.lit(0)) - F.lit(k - 1), F.lit(0)).alias("n_kmers"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {key_type(picked, 'doc_id')}, n_kmers int, positions array<int>, hashes array<bigint>")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, diagonal, anchors): how many anchors two sets of fingerprints share at each shift of position."""

    def flat(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("doc_id").alias(f"{side}_id"), F.explode(F.arrays_zip("positions", "hashes")).alias("z")).select(f"{side}_id", F.col("z.positions").alias(f"{side}_at"), F.col("z.hashes").alias("h"))

    hits = flat(left, "left").join(flat(right, "right"), "h")
    return hits.groupBy("left_id", "right_id", (F.col("left_at") - F.col("right_at")).alias("diagonal")).agg(F.count("*").alias("anchors"))
