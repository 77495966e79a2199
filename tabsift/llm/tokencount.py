"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic
programming over its places carries the best score and the number of pieces on
the way there, and never the pieces. The rules are those of the ``tokenizers``
library's Unigram model behind its Metaspace splitter:

* a space becomes U+2581; one is put before the text if it doesn't begin so;
  each U+2581 begins a new word, and no piece crosses words;
* among ways to a place the higher score wins; of equal scores the one whose
  last piece begins first;
* a character that is no piece itself may be taken as unknown, at 10 below the
  vocabulary's least score; with byte fallback it counts one piece per UTF-8
  byte, else a run of unknown characters counts one.

A word also ends at a line feed where no piece holds one and scores are whole
numbers below 2**31, for then sums are exact and the best ways through the parts
add up. Counts of words are kept per worker, in a cache that is emptied when it
grows large; this changes no count.

The vocabulary comes from a public file, which is a parameter. The installed
files hold no unigram model, so by default the pieces and stored scores of the
32k sentencepiece file are read as one; nothing is trained.

Defined results: null and empty texts have 0 tokens; every row gives one row,
repeated rows and null ids too; texts of any length are counted whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsift.llm.common import col, key_type

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, PENALTY, CACHE = "▁", 10.0, 400_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """((piece, score) by id, whether it has byte fallback) of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], all(f"<0x{i:02X}>" == sp.id_to_piece(sp.piece_to_id(f"<0x{i:02X}>")) for i in range(256))


class Counter(dict):
    """Pieces by word, without the U+2581 that begins it; words are counted when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        best = dict(vocabulary)  # of equal pieces the last counts, as in the library
        self.byte_fallback = byte_fallback
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        whole = all(s == int(s) and abs(s) < 2**31 for s in best.values())
        self.lines = whole and not any("\n" in p for p in best)
        self.feed = self.count("\n")[1]
        self.rest: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if self.lines and "\n" in word:
            first, *rest = word.split("\n")
            return self[first] + sum(self.feed + self._inner(w) for w in rest)
        n = self[word] = self.count(SPACE + word)[1]
        return n

    def _inner(self, part: str) -> int:
        """Pieces of a part of a word that follows a line feed."""
        n = self.rest.get(part)
        if n is None:
            n = self.rest[part] = self.count(part)[1]
        return n

    def count(self, word: str) -> tuple[float, int]:
        """(best score, pieces) of a string that is matched as it stands."""
        size = len(word)
        score: list = [None] * (size + 1)
        pieces, unknown, begin = [0] * (size + 1), [False] * (size + 1), [0] * (size + 1)
        score[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for end in range(size):
            to, single, top = end + 1, False, None
            for length, s in ends[end]:
                a = to - length
                single |= length == 1
                new = score[a] + s
                if top is None or new > top or (new == top and a < begin[to]):
                    top, begin[to] = new, a
            if not single and (top is None or score[end] + self.unknown > top):
                score[to], begin[to], unknown[to] = score[end] + self.unknown, end, True
                pieces[to] = pieces[end] + (len(word[end].encode()) if self.byte_fallback else int(not unknown[end]))
            else:
                score[to], pieces[to] = top, pieces[begin[to]] + 1
        return score[size], pieces[size]

    def text(self, text: str | None) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        if len(self) > CACHE or len(self.rest) > CACHE:
            self.clear()
            self.rest.clear()
        text = text.replace(SPACE, " ")
        return sum(map(self.__getitem__, (text[1:] if text[0] == " " else text).split(" ")))


@lru_cache(4)
def counter(path: str) -> Counter:
    """One per worker process and file."""
    return Counter(*read_vocabulary(os.path.realpath(path)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; the vocabulary file must be at the same path on all machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).text
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    picked = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {key_type(picked, 'doc_id')}, n_tokens bigint")
