"""Language-model scoring: interpolated modified Kneser-Ney n-grams of order 2 or 3.

Spark counts; workers look up. A map side reduces the trigrams of millions of
words to sorted arrays before anything is shuffled. Trigrams (u, v, w) go to
shards by their middle word: a shard has all that precedes and all that follows
(v, w) and (u, v), so it counts the trigrams, the distinct predecessors of each
bigram (v, w), which are its count at the order below, and the followers of each
context (u, v), in one exchange. What is known of single words adds up over
shards and goes on to parts of words. Each shard writes its n-grams as sorted
arrays of 64-bit hashes, which workers map into memory, so that all of a
machine's workers share one copy in the page cache. A task takes the shards of a
part one after the other and adds their arrays to the part's files: shards are as
many as memory asks for, and parts as few as look-ups in all of them ask for.

p(w | u v) = max(c(u v w) - D3(c), 0) / c(u v .) + g(u v) * p(w | v), with
p(w | v) the same over distinct predecessors a(v w), and p(w) over those of w,
interpolated with one part in V + 1 for each of V known words and for an unknown
one. D has three values by count at each order, estimated from the numbers of
n-grams counted once to four times; where one of these numbers is 0, D falls back
to 0.5, 1 and 1.5. An unseen context leaves all to the order below. At order 2,
bigrams have their own counts and there is nothing above them.

Words are lower-cased runs of letters and digits, as 48-bit hashes; a text is
framed by as many marks for its start as a context has words, and one for its
end, which is predicted too. On disk a hash is cut to the bits that tell it from
the others of its shard, 32 beyond an index of some 8 entries a slot; n-grams
counted once, the most, have no count beside them, and contexts that were there
once aren't listed at all: they are the bigrams that have no numbers as contexts.

Frequent middle words are spread over some shards by the word that follows; their
contexts' sums are put together in a second step. Which words these are comes from
a bounded sample, as do the short codes that frequent words have in the exchange;
both decide only where a count is made and in how many bytes.

Defined results:
* null, empty and word-less texts count nowhere; their perplexity is null;
* every row counts and is scored, repeated rows and null ids too;
* texts are scored whole, in blocks that change no sum's terms;
* a model of an empty table gives null for all texts without a word and the
  unknown word's probability, 1, to others.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm import kernels as K
from tabsift.llm.common import col, key_type, local_path, shared_dir

U64 = np.uint64
START, END = U64(1), U64(2)
ORDER, FLUSH, SCORE, PARTS = 3, 1_000_000, 500_000, 64
#: Bounds of the sample; a text counts with its first SAMPLE_CHARS characters there.
SAMPLE_ROWS, SAMPLE_CHARS, CODES = 2000, 20_000, 65_535
WORD_DT = np.dtype([("cont", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8"), ("total", "<u8")])
STAT_DT = np.dtype([("total", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])
_NONE = np.zeros(0, U64)


def events(texts: pa.Array, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, w, row) of all trigrams of a column, in parts of whole rows; at order 2 u is 0."""
    data, offs = K.buffers(K.lower(texts))
    n, first = len(offs) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + 8 * SCORE, side="right")) - 1)
        h, row = K.tokens(data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        if len(h):
            h = h >> U64(16)
            ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(h))
            w = np.insert(h, ends, END)  # an end after each text's last word
            row = np.insert(row, ends, row[ends - 1])
            new = np.concatenate(([True], row[1:] != row[:-1]))
            v = np.concatenate(([START], w[:-1]))
            v[new] = START
            u = np.zeros(len(w), U64)
            if order > 2:
                u[1:] = v[:-1]
                u[new] = START
            yield u, v, w, row + first
        first = last


def mid_shard(v: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Where trigrams with this middle and last word are counted; ``spread``: over how many shards a frequent middle word goes."""
    s = K.mix(v, 51) >> U64(20)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        s = np.where(hot[at] == v, s + (K.mix(w, 52) >> U64(20)) % spread[at].astype(U64), s)
    return (s % U64(shards)).astype(np.int32)


def key_shard(k: np.ndarray, shards: int) -> np.ndarray:
    return ((K.mix(k, 55) >> U64(20)) % U64(shards)).astype(np.int32)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(w ^ K.mix(v, 53), 54)


#: The context of a text's first word, which is no bigram.
_FIRST = pair_key(np.array([START]), np.array([START]))[0]


def triple_key(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of (u, v), by its pair_key, and w."""
    return K.mix(w ^ K.mix(pair, 56), 57)


# arrays in the exchange


def _six(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(U64)


def _small(x: np.ndarray) -> list[np.ndarray]:
    """Numbers in one byte each, those from 255 on apart."""
    big = x >= 255
    return [np.where(big, 255, x).astype(np.uint8), x[big].astype("<u8")]


def _coded(x: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """Words as two bytes where they have a code, others as CODES and six bytes apart."""
    at = np.minimum(np.searchsorted(codes, x), max(len(codes) - 1, 0))
    known = codes[at] == x if len(codes) else np.zeros(len(x), bool)
    return [np.where(known, at, CODES).astype("<u2"), _six(x[~known])]


def _join(parts: list[np.ndarray]) -> bytes:
    raw = [np.ascontiguousarray(p).tobytes() for p in parts]
    return np.array([len(raw), *map(len, raw)], "<u8").tobytes() + b"".join(raw)


def _split(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(blob, "<u8", n, 8)]).astype(int)
    return [np.frombuffer(blob, np.uint8, b - a, a) for a, b in zip(ends, ends[1:])]


def _numbers(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[low == 255] = np.frombuffer(high.tobytes(), "<u8").astype(np.int64)
    return out


def _words(code: np.ndarray, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.frombuffer(code.tobytes(), "<u2")
    out = codes[np.minimum(at, max(len(codes) - 1, 0))].astype(U64) if len(codes) else np.zeros(len(at), U64)
    out[at == CODES] = _from_six(rest)
    return out


def _merge(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair_key of v and w, u, v, w, count) of distinct trigrams, those of a middle word and of a pair together."""
    pair = pair_key(v, w)
    order = np.lexsort((u, pair, v))
    pair, u, c = pair[order], u[order], c[order]
    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (u[1:] != u[:-1]))))
    return pair[new], u[new], v[order][new], w[order][new], np.add.reduceat(c, new)


def pack_all(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, pair: np.ndarray, codes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Trigrams of _merge() in shards that begin at ``at``: a middle word once, then its pairs' last words, then their first words."""
    head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    run, vs = np.diff(np.append(head, len(pair))), v[head]
    at_head = np.searchsorted(head, at)
    new = np.concatenate(([True], vs[1:] != vs[:-1]))
    new[at_head[at_head < len(vs)]] = True
    top = np.flatnonzero(new)
    at_top = np.searchsorted(top, at_head)
    fields, cuts = [], []
    for x, cut, coded in ((vs[top], at_top, True), (np.diff(np.append(top, len(vs))), at_top, False), (w[head], at_head, True), (run, at_head, False), (u, at, True), (c, at, False)):
        first, rest = _coded(x, codes) if coded else _small(x)
        apart = np.append(0, np.cumsum(first == CODES if coded else x >= 255))
        fields += [first, rest]
        cuts += [np.append(cut, len(first)), np.append(apart[cut], apart[-1]) * (6 if coded else 1)]
    return [_join([f[b[k] : b[k + 1]] for f, b in zip(fields, cuts)]) for k in range(len(at))]


def pack(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, pair: np.ndarray, codes: np.ndarray) -> bytes:
    return pack_all(u, v, w, c, pair, codes, np.zeros(1, np.int64))[0]


def unpack(blob: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpack_all([blob], codes)


def unpack_all(blobs: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p = [np.concatenate(x) for x in zip(*map(_split, blobs))]
    run = _numbers(p[6], p[7])
    v = np.repeat(_words(p[0], p[1], codes), _numbers(p[2], p[3]))
    return _words(p[8], p[9], codes), np.repeat(v, run), np.repeat(_words(p[4], p[5], codes), run), _numbers(p[10], p[11])


@dataclass(frozen=True)
class Plan:
    """How n-grams are placed and coded; of a bounded sample."""

    order: int
    shards: int
    hot: np.ndarray
    spread: np.ndarray
    codes: np.ndarray

    @property
    def parts(self) -> int:
        """Files by which shards are looked up, shard s in s % parts; these grow with the root of the input only, as every block of words meets all of them."""
        return min(self.shards, max(PARTS, 4 * math.isqrt(self.shards)))

    def shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return mid_shard(v, w, self.shards, self.hot, self.spread)

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(v), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)] == v


def plan(texts: list[str | None], shards: int, order: int = ORDER) -> Plan:
    """Middle words of more than a shard's share of the sample are spread, over as many shards as they fill and one more."""
    seen = [e[1] for e in events(pa.array(texts, pa.string()), order)]
    v, c = np.unique(np.concatenate(seen or [_NONE]), return_counts=True)
    share = c * shards / max(c.sum(), 1000)
    often = share > 1
    most = np.argsort(-c, kind="stable")[:CODES]
    return Plan(order, shards, v[often], np.minimum(np.ceil(share[often]) + 1, shards).astype(np.int64), np.sort(v[most]))


def _count(p: Plan):
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        u, v, w = (np.concatenate([x[i] for x in parts]) for i in range(3))
        pair, u, v, w, c = _merge(u, v, w, np.ones(len(v), np.int64))
        s = p.shard(v, w)
        order = np.argsort(s, kind="stable")
        s = s[order]
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        blobs = pack_all(u[order], v[order], w[order], c[order], pair[order], p.codes, at)
        yield pa.RecordBatch.from_arrays([pa.array(s[at], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for u, v, w, _ in events(b.column(0), p.order):
                parts.append((u, v, w))
                size += len(v)
                if size >= FLUSH:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


# arrays on disk


class Files:
    """Files of a folder that arrays are added to; each appears whole or not at all, so that a repeated task does no harm."""

    def __init__(self, folder: str):
        self.folder, self.mark, self.open, self.rows = folder, uuid.uuid4().hex, {}, {}

    def add(self, name: str, array: np.ndarray) -> None:
        if name not in self.open:
            self.open[name] = open(self.part(name), "wb")
        array.tofile(self.open[name])

    def part(self, name: str) -> str:
        return os.path.join(self.folder, f".{name}-{self.mark}")

    def close(self) -> None:
        for name, f in self.open.items():
            f.close()
            os.replace(self.part(name), os.path.join(self.folder, name))
        self.open = {}

    def __enter__(self) -> Files:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        for name, f in self.open.items():
            f.close()
            os.unlink(self.part(name))


def _into(to: str | Files):
    return Files(to) if isinstance(to, str) else nullcontext(to)


def _slots(n: int) -> int:
    return max(int(n // 8).bit_length(), 1)


def _save_keys(to: Files, name: str, keys: np.ndarray, sub: int) -> tuple[np.ndarray, int]:
    """A sorted array of hashes: 32 bits each below an index by their first bits. Returns the order, and how many keys of subs before there are."""
    order = np.argsort(keys)
    keys, bits = keys[order], _slots(len(keys))
    top = (keys >> U64(64 - bits)).astype(np.int64)
    to.add(f"{name}.subs", np.array([sub, len(keys)], "<u8"))
    to.add(f"{name}.index", np.searchsorted(top, np.arange((1 << bits) + 1)).astype("<u4"))
    to.add(f"{name}.low", ((keys >> U64(32 - bits)) & U64(0xFFFFFFFF)).astype("<u4"))
    before = to.rows.get(name, 0)
    to.rows[name] = before + len(keys)
    return order, before


def _save_numbers(to: Files, name: str, x: np.ndarray, before: int) -> None:
    low, high = _small(x)
    to.add(f"{name}.byte", low)
    to.add(f"{name}.at", (np.flatnonzero(x >= 255) + before).astype("<u8"))
    to.add(f"{name}.big", high)


def _save_counts(to: str | Files, name: str, keys: np.ndarray, c: np.ndarray, sub: int = 0) -> None:
    """Those counted once as keys alone, others with their counts."""
    one = c == 1
    with _into(to) as files:
        _save_keys(files, f"{name}1", keys[one], sub)
        order, before = _save_keys(files, f"{name}2", keys[~one], sub)
        _save_numbers(files, f"{name}2", c[~one][order], before)


def _save_stats(to: str | Files, name: str, keys: np.ndarray, stats: np.ndarray, sub: int = 0) -> None:
    """Contexts with their numbers, but for those that were there once: these are the bigrams that aren't listed here."""
    keep = (stats["total"] > 1) | (keys == _FIRST)
    with _into(to) as files:
        order, before = _save_keys(files, f"{name}2", keys[keep], sub)
        for k in STAT_DT.names:
            _save_numbers(files, f"{name}2{k}", stats[k][keep][order].astype(np.int64), before)


@lru_cache(65536)
def _mapped(file: str, dtype: str) -> np.ndarray:
    """A file of the model, mapped into memory; missing and empty ones are empty arrays."""
    if not os.path.exists(file) or os.path.getsize(file) == 0:
        return np.zeros(0, dtype)
    return np.memmap(file, dtype, "r")


@lru_cache(65536)
def _subs(file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a file of _save_keys(), by sub: number of keys, bits of its index, and where its keys and its index begin."""
    sub, n = _mapped(f"{file}.subs", "<u8").reshape(-1, 2).astype(np.int64).T
    bits = np.array([_slots(x) for x in n.tolist()], np.int64)
    out = np.zeros((4, sub.max() + 1), np.int64)
    out[1] = 1
    out[:, sub] = n, bits, np.cumsum(n) - n, np.cumsum((1 << bits) + 1) - (1 << bits) - 1
    return tuple(out)


def _search(file: str, keys: np.ndarray, sub: np.ndarray | int = 0) -> np.ndarray:
    """Where each key is among those of its sub in a file of _save_keys(); -1 where it isn't."""
    low, index = _mapped(f"{file}.low", "<u4"), _mapped(f"{file}.index", "<u4")
    out = np.full(len(keys), -1, np.int64)
    if not len(low):
        return out
    n, bits, first, begin = _subs(file)
    k = np.minimum(sub, len(n) - 1)
    live = (k == sub) & (n[k] > 0)
    bit = bits[k].astype(U64)
    top = (keys >> (U64(64) - bit)).astype(np.int64) + begin[k]
    want = ((keys >> (U64(32) - bit)) & U64(0xFFFFFFFF)).astype(np.int64)
    a = np.where(live, index[np.where(live, top, 0)].astype(np.int64) + first[k], 0)
    b = np.where(live, index[np.where(live, top + 1, 0)].astype(np.int64) + first[k], 0)
    end = b.copy()
    open_ = np.flatnonzero(a < b)
    while len(open_):
        mid = (a[open_] + b[open_]) // 2
        less = low[mid] < want[open_]
        a[open_] = np.where(less, mid + 1, a[open_])
        b[open_] = np.where(less, b[open_], mid)
        open_ = open_[a[open_] < b[open_]]
    hit = a < end
    hit[hit] = low[a[hit]] == want[hit]
    out[hit] = a[hit]
    return out


def _numbers_at(file: str, at: np.ndarray) -> np.ndarray:
    x = _mapped(f"{file}.byte", "u1")[at].astype(np.int64)
    big = np.flatnonzero(x == 255)
    if len(big):
        x[big] = _mapped(f"{file}.big", "<u8")[np.searchsorted(_mapped(f"{file}.at", "<u8"), at[big])].astype(np.int64)
    return x


def _count_of(file: str, keys: np.ndarray, sub: np.ndarray | int = 0) -> np.ndarray:
    """Counts by key of _save_counts(); 0 for unknown keys."""
    out = np.zeros(len(keys), np.int64)
    sub = np.broadcast_to(sub, len(keys))
    at = _search(f"{file}2", keys, sub)
    known = at >= 0
    out[known] = _numbers_at(f"{file}2", at[known])
    alone = np.flatnonzero(~known)
    out[alone[_search(f"{file}1", keys[alone], sub[alone]) >= 0]] = 1
    return out


def _stats_of(file: str, keys: np.ndarray, sub: np.ndarray | int = 0) -> np.ndarray:
    """Numbers by key of _save_stats(); 0 for those that it doesn't list."""
    out = np.zeros(len(keys), STAT_DT)
    at = _search(f"{file}2", keys, sub)
    known = np.flatnonzero(at >= 0)
    for name in STAT_DT.names:
        out[name][known] = _numbers_at(f"{file}2{name}", at[known])
    return out


def _by_count(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _sums(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their STAT_DT): sums of counts, and how many are 1, 2 and more."""
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    out = np.zeros(len(new), STAT_DT)
    if len(new):
        for name, x in (("total", c), ("n1", c == 1), ("n2", c == 2), ("n3", c >= 3)):
            out[name] = np.add.reduceat(x.astype(np.int64), new)
    return key[new], out


def _add(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal keys added up."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    out = np.zeros(len(new), rows.dtype)
    if len(new):
        for name in rows.dtype.names:
            out[name] = np.add.reduceat(rows[name], new)
    return keys[new], out


def _pack_rows(keys: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    out = [_six(keys) if rows.dtype == WORD_DT else keys.astype("<u8")]
    for name in rows.dtype.names:
        out += _small(rows[name].astype(np.int64))
    return out


def _unpack_rows(parts: list[np.ndarray], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    keys = _from_six(parts[0]) if dtype == WORD_DT else np.frombuffer(parts[0].tobytes(), "<u8").astype(U64)
    rows = np.zeros(len(keys), dtype)
    for i, name in enumerate(dtype.names):
        rows[name] = _numbers(parts[1 + 2 * i], parts[2 + 2 * i])
    return keys, rows


_COUNTS = ["t1", "t2", "t3", "t4", "b1", "b2", "b3", "b4"]


def _grams(folder: str, p: Plan):
    """A part, shard by shard: writes trigrams and what follows from them, and passes on what other parts add to."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
        shard, blobs = -1, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if k != shard and blobs:
                    yield shard, blobs
                    blobs = []
                shard = k
                blobs.append(blob.as_py())
        if blobs:
            yield shard, blobs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Files(folder) as files:
            for shard, blobs in shards(batches):
                yield one(files, *divmod(shard, p.parts), blobs)

    def one(files: Files, sub: int, part: int, blobs: list[bytes]) -> pa.RecordBatch:
        pair, u, v, w, c = _merge(*unpack_all(blobs, p.codes))
        head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        bv, bw = v[head], w[head]
        count = np.add.reduceat(c, head) if p.order == 2 else np.diff(np.append(head, len(pair)))
        _save_counts(files, f"b{part}", pair[head], count, sub)
        hot_keys, hot_rows = _NONE, np.zeros(0, STAT_DT)
        by3 = [0, 0, 0, 0]
        if p.order > 2:
            context = pair_key(u, v)
            _save_counts(files, f"t{part}", triple_key(context, w), c, sub)
            by3 = _by_count(c)
            hot = p.is_hot(v)
            _save_stats(files, f"c{part}", *_sums(context[~hot], c[~hot]), sub)
            hot_keys, hot_rows = _sums(context[hot], c[hot])
        words, sums = _sums(bv, count)
        last, n = np.unique(bw, return_counts=True)
        rows = np.zeros(len(words) + len(last), WORD_DT)
        for name in STAT_DT.names:
            rows[name][: len(words)] = sums[name]
        rows["cont"][len(words) :] = n
        words = np.concatenate((words, last))
        to_word, to_hot = key_shard(words, p.parts), key_shard(hot_keys, p.parts)
        on = np.unique(np.concatenate((to_word, to_hot)))
        blobs = [_join(_pack_rows(words[to_word == k], rows[to_word == k]) + _pack_rows(hot_keys[to_hot == k], hot_rows[to_hot == k])) for k in on]
        known = np.zeros((8, len(on)), np.int64)
        known[:, 0] = by3 + _by_count(count)
        return pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(blobs, pa.binary()), *map(pa.array, known)], ["shard", "blob", *_COUNTS])

    return run


_WORD_SUMS = ["w1", "w2", "w3", "w4", "w3up", "pairs", "known"]


def _finish(folder: str):
    """A part of words and of frequent contexts: writes the sums, and returns what the model needs of all shards."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_split(x.as_py()) for x in table.column("blob")]
        k = 1 + 2 * len(WORD_DT.names)
        both = []
        for dtype, cut in ((WORD_DT, slice(None, k)), (STAT_DT, slice(k, None))):
            got = [_unpack_rows(x[cut], dtype) for x in parts]
            both.append(_add(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])))
        (words, rows), (contexts, stats) = both
        shard = key[0].as_py()
        with Files(folder) as files:
            files.add(f"w{shard}.key", words.astype("<u8"))
            files.add(f"w{shard}.val", rows)
            _save_stats(files, f"h{shard}", contexts, stats)
        cont = rows["cont"].astype(np.int64)
        sums = [int(pa.compute.sum(table.column(n)).as_py()) for n in _COUNTS]
        mine = [*_by_count(cont), int((cont >= 3).sum()), int(cont.sum()), int((cont > 0).sum())]
        return pa.table([pa.array([x]) for x in sums + mine], _COUNTS + _WORD_SUMS)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that belong to the whole corpus."""

    folder: str
    plan: Plan
    d3: tuple[float, float, float]
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    g1: float  # weight of the uniform part
    pairs: int  # distinct bigrams
    known: int  # words that were ever predicted
    path: str = field(default="", compare=False)

    @property
    def unknown(self) -> float:
        return self.g1 / (self.known + 1)


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None, order: int = ORDER) -> Model:
    """Count all of docs. ``shards`` is by default twice spark.sql.shuffle.partitions, which should follow the input's size."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark)
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(col(text_col).cast("string").alias("text"))
    # taken by the driver, which reads no more partitions than it needs
    p = plan([r.text for r in texts.select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).take(SAMPLE_ROWS)], shards, order)
    counted = texts.mapInArrow(_count(p), "shard int, blob binary")
    parted = counted.repartitionById(p.parts, F.col("shard") % p.parts).sortWithinPartitions("shard")
    second = parted.mapInArrow(_grams(folder, p), "shard int, blob binary, " + ", ".join(f"{n} bigint" for n in _COUNTS))
    names = _COUNTS + _WORD_SUMS
    last = second.groupBy("shard").applyInArrow(_finish(folder), ", ".join(f"{n} bigint" for n in names))
    s = last.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    d3, d2, d1 = (discounts(*(s[f"{x}{k}"] for k in (1, 2, 3, 4))) for x in "tbw")
    g1 = (d1[0] * s.w1 + d1[1] * s.w2 + d1[2] * s.w3up) / s.pairs if s.pairs else 1.0
    return Model(folder, p, d3, d2, d1, g1, s.pairs, s.known, path)


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, which are there)."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(s))):
        yield int(s[a]), order[a:b]


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def _mixed(c: np.ndarray, stats: np.ndarray, d: tuple[float, float, float], below: np.ndarray) -> np.ndarray:
    """The discounted share of c, and what is left to the order below; all of it where the context is unknown."""
    total = stats["total"].astype(float)
    seen = total > 0
    left = d[0] * stats["n1"] + d[1] * stats["n2"] + d[2] * stats["n3"]
    return np.where(seen, (_less(c, d) + left * below) / np.where(seen, total, 1.0), below)


def probabilities(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """p(w | u v) of word hashes; at order 2 u has no say."""
    p, at = model.plan, lambda name: os.path.join(model.folder, name)
    words, where = np.unique(np.concatenate((v, w)), return_inverse=True)
    rows = np.zeros(len(words), WORD_DT)
    for s, pick in _groups(key_shard(words, p.parts)):
        have = _mapped(at(f"w{s}.key"), "<u8")
        if len(have):
            k = np.minimum(np.searchsorted(have, words[pick]), len(have) - 1)
            ok = have[k] == words[pick]
            rows[pick[ok]] = _mapped(at(f"w{s}.val"), WORD_DT)[k[ok]]
    a, b = where[: len(v)], where[len(v) :]
    p1 = _less(rows["cont"].astype(np.int64), model.d1)[b] / max(model.pairs, 1) + model.unknown
    pair, shard = pair_key(v, w), p.shard(v, w)
    n2, n3 = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    context, stats, hot = pair_key(u, v), np.zeros(len(v), STAT_DT), p.is_hot(v)
    triple = triple_key(context, w)
    subs = shard // p.parts
    for s, pick in _groups(shard % p.parts):
        n2[pick] = _count_of(at(f"b{s}"), pair[pick], subs[pick])
        if p.order > 2:
            n3[pick] = _count_of(at(f"t{s}"), triple[pick], subs[pick])
            cold = pick[~hot[pick]]
            stats[cold] = _stats_of(at(f"c{s}"), context[cold], subs[cold])
    p2 = _mixed(n2, rows[a], model.d2, p1)
    if p.order == 2:
        return p2
    some = np.flatnonzero(hot)
    for s, pick in _groups(key_shard(context[some], p.parts)):
        stats[some[pick]] = _stats_of(at(f"h{s}"), context[some[pick]])
    some = np.flatnonzero(stats["total"] == 0)
    shard = p.shard(u[some], v[some])
    for s, pick in _groups(shard % p.parts):
        once = some[pick[_count_of(at(f"b{s}"), context[some[pick]], shard[pick] // p.parts) > 0]]
        stats["total"][once] = stats["n1"][once] = 1
    return _mixed(n3, stats, model.d3, p2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row; the end mark counts as one more prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for u, v, w, row in events(b.column(1), model.plan.order):
                n += np.bincount(row, minlength=b.num_rows)
                for a in range(0, len(v), SCORE):
                    part = slice(a, a + SCORE)
                    total += np.bincount(row[part], np.log(probabilities(model, u[part], v[part], w[part])), b.num_rows)
            none = n == 0
            ppl = np.exp(-total / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.maximum(n - 1, 0)), pa.array(total, mask=none), pa.array(ppl, mask=none)], ["doc_id", "n_words", "log_prob", "perplexity"])

    picked = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {key_type(picked, 'doc_id')}, n_words bigint, log_prob double, perplexity double")
