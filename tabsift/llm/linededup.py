"""Line deduplication: winnowing over line hashes.

A line here is a logical one: wherever line feeds stand, a line ends with a word
that ends in a full stop, an exclamation or question mark, whose hash is 0 modulo
MARK, or that was said twice. A passage that was reflowed or set into running text so has the same
lines as before. A line's hash covers the LEAD words from its start on.

Winnowing slides a window of MIN_WORDS words over these hashes and selects the
least of the lines that begin in it, after its second word and LEAD words or more
before its end. A selected line is a fingerprint, emitted once with its position, whatever the
number of windows that select it. Equal windows select equal fingerprints, so
every repeated run of MIN_WORDS words is found: the positions that share a
fingerprint are joined, and all others are done with. (Windows in which no line
begins, in long lines of few distinct words, are fingerprints themselves.)

A joined position is extended both ways: first over its neighbourhood, the run of
all windows that select it. A neighbourhood equal to an earlier one goes as it is,
so that a passage in thousands of documents costs one row in each of them. Among
those that differ, which have the ends of a match or an edited word inside, each
window is looked up by itself, which extends matches word by word. The first
place in corpus order stays, all later ones go, against whichever earlier
document they agree with: no partner is preferred and none is left out.

So a word goes if, and only if, it lies in a run of MIN_WORDS words that stands
at an earlier place as well (up to 64-bit hash collisions).

Defined results:
* corpus order is id (null first), then text hash, then position in the text;
* words are runs of other than ASCII white space, compared as they stand;
* within one text, the earlier place must not overlap the later one; a text that
  repeats one word or line keeps its first MIN_WORDS words;
* null and empty texts, and those of fewer words, stay as they are;
* rows that repeat both id and text are one document, changed alike;
* a document that loses all its words goes; n_chars, if there, follows the text;
* white space after a word that goes goes with it; a line feed stays between the
  rests of two lines; a text whose end goes loses the white space before it too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsift.llm import kernels as K
from tabsift.llm.common import col, free_name, key_type, stash

MIN_WORDS, LEAD, MARK = 50, 12, 12
_BASE = K.U64(0x9E3779B97F4A7C15)
_INVERSE = K.U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])
#: Bytes of text handled at a time, in whole rows; bounds the working memory, never the result.
SLICE = 2 << 20


@dataclass(frozen=True)
class Words:
    """The words of some texts, one after the other; offsets of texts are in words."""

    offs: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    begins: np.ndarray  # whether the word before ends a line
    sums: np.ndarray
    down: np.ndarray

    def run(self, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
        """Hash of the words from a to b, which doesn't depend on where they stand."""
        return K.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(K.U64), seed)


def words_of(texts: pa.Array) -> Words:
    data, at = K.buffers(texts)
    h, row = K.tokens(data, at, K.NOT_SPACE)
    n = len(at) - 1
    offs = np.searchsorted(row, np.arange(n + 1))
    on = K.NOT_SPACE[data]
    last = on.copy()
    last[:-1] &= ~on[1:]
    edge = at[1:][at[1:] > at[:-1]] - 1
    last[edge] = on[edge]
    end = np.flatnonzero(last)
    new = np.ones(len(h), bool)
    new[1:] = row[1:] != row[:-1]
    begins = ~new
    said_twice = np.zeros(len(h), bool)
    said_twice[2:] = (h[1:-1] == h[:-2]) & (h[2:] != h[1:-1])
    begins[1:] &= _END[data[end[:-1]]] | (K.mix(h[:-1], 43) % K.U64(MARK) == 0) | said_twice[1:]
    power = np.cumprod(np.concatenate(([K.U64(1)], np.full(len(h), _BASE))))
    down = np.cumprod(np.concatenate(([K.U64(1)], np.full(len(h), _INVERSE))))
    sums = np.concatenate(([K.U64(0)], np.cumsum(K.mix(h, 44) * power[:-1])))
    return Words(offs, row, h, begins, sums, down)


def _least(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first place of the least value in each half-open range, none empty, by a sparse table."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    table = [rank]
    while (1 << len(table)) <= int((end - start).max()):
        half, prev = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(prev[:-half], prev[half:]))
    level = np.frexp((end - start).astype(float))[1] - 1
    out = np.empty(len(start), np.int64)
    for l in np.unique(level):
        m = level == l
        out[m] = np.minimum(table[l][start[m]], table[l][end[m] - (1 << l)])
    return order[out]


def fingerprints(w: Words, min_words: int = MIN_WORDS, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, hash of its neighbourhood, first, last window that selects it) of each selected position."""
    n = len(w.hash)
    place = np.arange(n)
    start = place[place + min_words <= w.offs[w.row + 1]]
    line = place[w.begins & (place + lead <= w.offs[w.row + 1])]
    value = w.run(line, line + lead, 45)
    before = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=n))))
    # whether a line begins follows from the two words before, which have to be in the window
    a, b = before[np.minimum(start + 2, n)], before[start + min_words - lead + 1]
    some = b > a
    rest, start, at = start[~some], start[some], _least(value, a[some], b[some])
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    lo, hi, at = start[new], start[np.append(new[1:], True)] if len(start) else start, at[new]
    own = w.run(rest, rest + min_words, 46)
    # equal windows one after the other, of one word only: the first min_words of them overlap, and so do no others with the first
    new = np.ones(len(rest), bool)
    new[1:] = (own[1:] != own[:-1]) | (rest[1:] != rest[:-1] + 1)
    nth = np.arange(len(rest)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    new |= nth == min_words
    first, last, own = rest[new], rest[np.append(new[1:], True)] if len(rest) else rest, own[new]
    return (
        np.concatenate((value[at], own)),
        np.concatenate((w.run(lo, hi + min_words, 47), own)),
        np.concatenate((lo, first)),
        np.concatenate((hi, last)),
    )


def _slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    size = np.concatenate(([0], np.cumsum(np.diff(K.buffers(b.column(text))[1]))))
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(size, size[first] + SLICE, side="right")) - 1)
        yield b.slice(first, last - first)
        first = last


def _emit(b: pa.RecordBatch, w: Words, keys: dict[str, np.ndarray], **places: np.ndarray) -> pa.RecordBatch:
    """Rows of windows, with where they are in their text."""
    row = w.row[places["lo"]]
    pick = pa.array(row)
    out = {"doc_id": b.column(0).take(pick), "th": b.column(1).take(pick)} | {k: pa.array(K.as_long(x)) for k, x in keys.items()}
    return pa.RecordBatch.from_pydict(out | {k: pa.array((x - w.offs[row]).astype(np.int32)) for k, x in places.items()})


def _fingerprinted(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 2):
                w = words_of(b.column(2))
                h, nk, lo, hi = fingerprints(w, min_words, min(LEAD, min_words))
                if len(h):
                    yield _emit(b, w, {"h": h, "nk": nk}, lo=lo, hi=hi)

    return run


def _windows(min_words: int):
    """Every window of the given neighbourhoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 2):
                w = words_of(b.column(2))
                at = b.column(3)
                row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
                pairs = at.flatten()
                lo, hi = (pairs.field(k).to_numpy() + w.offs[row] for k in (0, 1))
                mark = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(mark, lo, 1)
                np.add.at(mark, hi + 1, -1)
                start = np.flatnonzero(np.cumsum(mark)[:-1])
                if len(start):
                    yield _emit(b, w, {"key": w.run(start, start + min_words, 46)}, lo=start)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs as one."""
    for b in batches:
        runs = b.column(2)
        row = np.repeat(np.arange(b.num_rows), np.diff(runs.offsets.to_numpy()))
        lo, stop = (runs.flatten().field(k).to_numpy() for k in (0, 1))
        order = np.lexsort((lo, row))
        row, lo, stop = row[order], lo[order], stop[order]
        reach = np.maximum.accumulate(stop + (row << 32))  # a later row is always beyond
        new = np.ones(len(row), bool)
        new[1:] = lo[1:] + (row[1:] << 32) > reach[:-1]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1
        out = pa.StructArray.from_arrays([pa.array(lo[head]), pa.array((reach[tail] - (row[tail] << 32)).astype(np.int32))], ["lo", "stop"])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), K.list_array(out, np.searchsorted(row[head], np.arange(b.num_rows + 1)))], ["doc_id", "th", "runs"])


def _keyed(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with its texts' hashes, and their column's name; one definition, so that what is exchanged of it for two joins can be exchanged once."""
    th = free_name(docs, "__th")
    return docs.withColumn(th, F.xxhash64(col(text_col).cast("string"))), th


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): what goes, for documents that lose any word; th is the text's hash, a run is (lo, stop) in words from 0."""
    t = col(text_col).cast("string")
    keyed, th = _keyed(docs, text_col)
    named = [col(id_col).alias("doc_id"), col(th).alias("th"), t.alias("text")]
    picked = keyed.filter(t.isNotNull()).select(*named)
    id_type = key_type(picked, "doc_id")
    found = picked.mapInArrow(_fingerprinted(min_words), f"doc_id {id_type}, th bigint, h bigint, nk bigint, lo int, hi int")
    # one exchange by fingerprint serves all three; the second window's rows are clustered by the first already
    shared, kind = Window.partitionBy("h"), Window.partitionBy("h", "nk")
    joined = found.withColumns({"n": F.count("*").over(shared), "mixed": F.min("nk").over(shared) < F.max("nk").over(shared)}).filter("n > 1")
    joined = joined.withColumn("f", F.min(F.struct("doc_id", "th", "lo")).over(kind))
    later = ~_same() | (F.col("lo") >= F.col("f.lo") + min_words)
    held = stash(joined.select("doc_id", "th", "lo", "hi", "mixed", later.alias("later")).filter("later OR mixed"))
    gone = held.filter("later").select("doc_id", "th", F.struct("lo", (F.col("hi") + min_words).alias("stop")).alias("run"))
    apart = held.filter("NOT later").groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))
    a_id, a_th, at = (free_name(keyed, n) for n in ("__a_id", "__a_th", "__at"))
    apart = apart.withColumnsRenamed({"doc_id": a_id, "th": a_th, "at": at})
    opened = keyed.join(apart, col(id_col).eqNullSafe(col(a_id)) & (col(th) == col(a_th))).select(*named, col(at).alias("at"))
    windows = opened.mapInArrow(_windows(min_words), f"doc_id {id_type}, th bigint, key bigint, lo int")
    # each kind of neighbourhood is there once, so that few rows share a key
    first = windows.withColumn("f", F.min(F.struct("doc_id", "th", "lo")).over(Window.partitionBy("key")))
    parts = first.filter(later).select("doc_id", "th", F.struct("lo", (F.col("lo") + min_words).alias("stop")).alias("run"))
    runs = gone.unionAll(parts).groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))
    return runs.mapInArrow(_merged, f"doc_id {id_type}, th bigint, runs array<struct<lo:int,stop:int>>")


_SPACE = r" \t\n\x0B\f\r"


def _without(t: Column, runs: Column) -> Column:
    """A text without its runs, from its words and the white space after each."""

    def build(words: Column) -> Column:
        def part(r: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(runs, i - 1)["stop"]).otherwise(F.lit(0))
            starts_line = (r["lo"] == 0) | F.contains(F.get(words, r["lo"] - 1), F.lit("\n"))
            parts_lines = F.exists(F.slice(words, r["lo"] + 1, r["stop"] - r["lo"]), lambda x: F.contains(x, F.lit("\n")))
            feed = F.when(~starts_line & parts_lines & (r["stop"] < F.size(words)), F.lit("\n")).otherwise(F.lit(""))
            return F.concat(F.array_join(F.slice(words, begin + 1, r["lo"] - begin), ""), feed)

        end = F.element_at(runs, -1)["stop"]
        left = F.concat(F.regexp_extract(t, f"^[{_SPACE}]*", 0), F.array_join(F.transform(runs, part), ""), F.array_join(F.slice(words, end + 1, F.size(words)), ""))
        return F.when(end < F.size(words), left).otherwise(F.regexp_replace(left, f"[{_SPACE}]+$", ""))

    words = F.regexp_extract_all(t, F.lit(f"[^{_SPACE}]+[{_SPACE}]*"), F.lit(0))
    return F.element_at(F.transform(F.array(words), build), 1)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed: str | None = None, least_left: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, without later repeated runs; ``removed`` names a column for the runs that went, as (lo, stop) in words.

    A document of whose words a smaller share than ``least_left`` is left goes as a whole.
    """
    keyed, th = _keyed(docs, text_col)
    left, gone_id, gone_th, lost = (free_name(keyed, n) for n in ("__left", "__gone_id", "__gone_th", "__gone"))
    gone = repeated_runs(docs, id_col, text_col, min_words).select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th), F.col("runs").alias(lost))
    t = col(text_col).cast("string")
    joined = keyed.join(gone, col(id_col).eqNullSafe(col(gone_id)) & (col(th) == col(gone_th)), "left")
    changed = col(lost).isNotNull()
    if least_left > 0:
        n = F.aggregate(col(lost), F.lit(0), lambda k, r: k + r["stop"] - r["lo"])
        joined = joined.filter(~changed | (n <= (1 - least_left) * F.regexp_count(t, F.lit(f"[^{_SPACE}]+"))))
    # a generated value is computed once, and not again for the filter
    joined = joined.withColumn(left, F.explode(F.array(F.when(changed, _without(t, col(lost)))))).filter(~changed | col(left).rlike(f"[^{_SPACE}]"))
    text = F.when(changed, col(left)).otherwise(t)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(col(c)).alias(c))
        else:
            out.append(col(c))
    if removed:
        out.append(F.coalesce(col(lost), F.array().cast("array<struct<lo:int,stop:int>>")).alias(removed))
    return joined.select(*out)
