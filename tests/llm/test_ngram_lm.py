import math
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabsift.llm import kernels as K
from tabsift.llm import ngram_lm as L


class Brute:
    """The model by its formulas, over words as strings."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            w = self.framed(t)
            top.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):  # distinct predecessors
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.total, self.kinds = defaultdict(int), defaultdict(lambda: [0, 0, 0, 0])
        self.d = {}
        for n, grams in self.counts.items():
            self.d[n] = L.discounts(*(sum(c == k for c in grams.values()) for k in (1, 2, 3, 4)))
            for g, c in grams.items():
                self.total[g[:-1]] += c
                self.kinds[g[:-1]][min(c, 3)] += 1

    def framed(self, t):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        return [*["<s>"] * (self.order - 1), *w, "</s>"] if w else []

    def p(self, gram):
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        n, below = len(gram), self.p(gram[1:])
        context = gram[:-1]
        if not self.total[context]:
            return below
        c, d = self.counts[n][gram], self.d[n]
        g = sum(d[k - 1] * self.kinds[context][k] for k in (1, 2, 3)) / self.total[context]
        return (max(c - d[min(c, 3) - 1], 0) / self.total[context] if c else 0) + g * below

    def log_prob(self, t):
        w = self.framed(t)
        return sum(math.log(self.p(tuple(w[i : i + self.order]))) for i in range(len(w) - self.order + 1)) if w else None


@pytest.mark.parametrize("order, shards", [(2, 1), (2, 7), (3, 1), (3, 7)])
def test_against_formulas(spark, sf, order, shards):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: r for r in L.score(docs, L.train(docs, shards=shards, order=order)).collect()}
    model = Brute([r.text for r in rows], order)
    for r in rows:
        assert got[r.doc_id].log_prob == pytest.approx(model.log_prob(r.text), rel=1e-9)
        n = len(model.framed(r.text)) - order + 1
        assert got[r.doc_id].n_words == n - 1 and got[r.doc_id].perplexity == pytest.approx(math.exp(-model.log_prob(r.text) / n), rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_unseen_text_and_sum_to_one(spark, order):
    docs = spark.createDataFrame([(1, "a b a c a b"), (2, "b b c a"), (3, "c a b b a d e")], "doc_id long, text string")
    model, brute = L.train(docs, shards=3, order=order), Brute([r.text for r in docs.collect()], order)
    new = spark.createDataFrame([(9, "a zz b unknown words a b")], "doc_id long, text string")
    assert L.score(new, model).first().log_prob == pytest.approx(brute.log_prob("a zz b unknown words a b"), rel=1e-9)
    h = lambda w: {"</s>": L.END, "<s>": L.START}.get(w) or K.tokens(*K.buffers(pa.array([w])))[0][0] >> np.uint64(16)
    words = np.array([h(w) for w in ("a", "b", "c", "d", "e", "</s>", "never")], np.uint64)
    for u, v in (("a", "b"), ("b", "a"), ("<s>", "<s>"), ("never", "e"), ("e", "never"), ("d", "d")):
        assert L.probabilities(model, np.full(len(words), h(u)), np.full(len(words), h(v)), words).sum() == pytest.approx(1)


def test_a_third_word_helps_on_held_out_texts(spark):
    """Words that follow from the two before them, of which either alone tells little."""
    rng = np.random.default_rng(0)

    def text():
        w = list(rng.integers(0, 8, 2))
        for _ in range(200):
            w.append((3 * w[-1] + 5 * w[-2] + rng.integers(0, 2)) % 8)
        return " ".join(f"w{x}" for x in w)

    train = spark.createDataFrame([(i, text()) for i in range(40)], "doc_id long, text string")
    held = spark.createDataFrame([(i, text()) for i in range(10)], "doc_id long, text string")
    ppl = {k: np.mean([r.perplexity for r in L.score(held, L.train(train, shards=4, order=k)).collect()]) for k in (2, 3)}
    assert ppl[3] < 3 < 6 < ppl[2]


def test_frequent_words_change_placement_only(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    p = L.plan(texts, 50)
    assert len(p.hot) and p.is_hot(p.hot).all() and not p.is_hot(np.array([5], np.uint64)).any()
    w = np.arange(100).astype(np.uint64)
    assert len(set(p.shard(np.full(100, p.hot[0]), w))) == p.spread[0] and len(set(p.shard(np.full(100, 7, np.uint64), w))) == 1


def test_many_shards_in_few_files(spark, sf, monkeypatch):
    """Shards follow the input's size; files, and look-ups of a block of words, follow its root."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150).cache()
    rows, shards = docs.collect(), 700
    model = L.train(docs, shards=shards)
    brute, got = Brute([r.text for r in rows], 3), {r.doc_id: r.log_prob for r in L.score(docs, model).collect()}
    for r in rows:
        assert got[r.doc_id] == pytest.approx(brute.log_prob(r.text), rel=1e-9)
    calls, search = [], L._search
    monkeypatch.setattr(L, "_search", lambda *a: calls.append(1) or search(*a))
    u, v, w, _ = next(L.events(pa.array([r.text for r in rows])))
    assert len(set(model.plan.shard(v, w).tolist())) > 600
    L.probabilities(model, u, v, w)
    assert len(calls) < 8 * 110 and len({f.name.split(".")[0] for f in os.scandir(model.folder) if f.name.startswith("t")}) <= 2 * 110
    assert not [f.name for f in os.scandir(model.folder) if f.name.startswith(".t")]


def test_counting_costs_little_more_with_many_shards():
    words = np.random.default_rng(0).zipf(1.3, 100_000) % 30_000
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{x}" for x in words)])], ["text"])
    took, rows = {}, {}
    for shards in (50, 3000):
        p = L.plan([batch.column(0)[0].as_py()[:20_000]], shards)
        for _ in range(3):
            began = time.process_time()
            got = list(L._count(p)([batch]))
            took[shards] = min(took.get(shards, 9e9), time.process_time() - began)
        blobs = {k: x for b in got for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        parts = [L.unpack(x, p.codes) for x in blobs.values()]
        for k, x in zip(blobs, parts):
            assert (p.shard(x[1], x[2]) == k).all()
        both = L.unpack_all(list(blobs.values()), p.codes)
        for i in range(4):
            assert (both[i] == np.concatenate([x[i] for x in parts])).all()
        rows[shards] = sorted(zip(*(x.tolist() for x in both)))
    assert rows[50] == rows[3000] and sum(r[3] for r in rows[50]) == 100_001
    assert took[3000] < 3 * took[50]


def test_packing():
    rng = np.random.default_rng(0)
    u, v, w = (rng.integers(0, n, 5000).astype(np.uint64) << np.uint64(20) for n in (30, 50, 300))
    pair, u, v, w, c = L._merge(u, v, w, rng.integers(1, 400, 5000))
    assert len({*zip(u.tolist(), v.tolist(), w.tolist())}) == len(u)
    for codes in (np.zeros(0, np.uint64), np.unique(v)[:20], np.unique(np.concatenate((u, v, w)))):
        for a, b in zip(L.unpack(L.pack(u, v, w, c, pair, codes), codes), (u, v, w, c)):
            assert (a == b).all()


def test_arrays_of_several_subs(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    sub, c = rng.choice([0, 3, 4], len(keys)), rng.choice([1, 2, 700], len(keys))
    with L.Files(str(tmp_path)) as files:
        for k in (0, 1, 3, 4):  # the second is empty, the third isn't there
            L._save_counts(files, "x", keys[sub == k], c[sub == k], k)
    assert (L._count_of(f"{tmp_path}/x", keys, sub) == c).all()
    for other in ((sub == 0) * 3, np.full(len(keys), 1), np.full(len(keys), 2), np.full(len(keys), 9)):
        assert not L._count_of(f"{tmp_path}/x", keys, other).any()


@pytest.mark.parametrize("n", [0, 1, 9, 5000])
def test_arrays_on_disk(tmp_path, n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    c = np.where(rng.random(len(keys)) < 0.5, 1, rng.integers(1, 1 << 40, len(keys)))
    L._save_counts(str(tmp_path), "x", keys, c)
    assert (L._count_of(f"{tmp_path}/x", keys) == c).all() and not L._count_of(f"{tmp_path}/x", keys + np.uint64(1 << 40)).any()
    stats = np.zeros(len(keys), L.STAT_DT)
    stats["total"], stats["n1"], stats["n2"] = c, 300, 7
    L._save_stats(str(tmp_path), "y", keys, stats)
    got = L._stats_of(f"{tmp_path}/y", keys)
    assert (got[c > 1] == stats[c > 1]).all() and not got["total"][c == 1].any()


def test_edge_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (3, "a b", 1.0), (3, "a b", 1.0), (4, "long word " * 60_000, 1.0), (5, "... !", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, perplexity double")
    got = L.score(df, L.train(df)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert all(by[k].perplexity is None and by[k].log_prob is None and by[k].n_words == 0 for k in (1, 2, 5))
    assert by[4].n_words == 120_000 and by[None].log_prob == by[3].log_prob
    empty = L.train(df.limit(0))
    assert L.score(df.limit(0), empty).count() == 0
    assert L.score(df.filter("doc_id = 3"), empty).first().log_prob == 0
    with pytest.raises(ValueError):
        L.train(df, order=4)
