import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.llm import packing as P


def fewest_bins(size, capacity):
    """Least number of bins, by trying every assignment."""
    best = len(size)

    def put(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(size):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + size[i] <= capacity:
                loads[k] += size[i]
                put(i + 1, loads)
                loads[k] -= size[i]
        put(i + 1, loads + [size[i]])

    put(0, [])
    return best


def evolve(size, capacity, seed=0):
    rng = np.random.default_rng(seed)
    return P.evolve(P.seeds(size, capacity, rng), size, capacity, rng)


def valid(bins, size, capacity):
    assert sorted(itertools.chain(*bins)) == list(range(len(size)))
    assert all(0 < sum(size[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_as_few_bins_as_possible(seed):
    rng = np.random.default_rng(seed)
    size = sorted(rng.integers(1, 10, 11).tolist(), reverse=True)
    best = evolve(size, 12, seed)[0]
    valid(best, size, 12)
    assert len(best) == fewest_bins(size, 12)


def shipped(size, capacity):
    """(bins of best-fit decreasing, bins of all islands and epochs as they are shipped)."""
    decreasing, islands = [], None
    P.best_fit(decreasing, [], list(range(len(size))), size, capacity)
    for epoch in range(P.EPOCHS):
        rngs = [np.random.default_rng([P.SEED, 0, k, epoch]) for k in range(P.ISLANDS)]
        islands = [P.evolve(islands[k] + islands[k - 1][: P.ELITE] if islands else P.seeds(size, capacity, rng), size, capacity, rng) for k, rng in enumerate(rngs)]
    best = max((x[0] for x in islands), key=lambda x: P.fitness(x, size, capacity))
    valid(best, size, capacity)
    return len(decreasing), len(best)


def triplets(rng, n):
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        out += [a, b, 1000 - a - b]
    return out


@pytest.mark.parametrize("kind, gain", [("triplets", 6), ("quarters", 6), ("uniform", 1)])
def test_the_search_needs_fewer_bins_than_best_fit_decreasing(kind, gain):
    rng = np.random.default_rng(0)
    size, capacity = {"triplets": (triplets(rng, 60), 1000), "quarters": (rng.integers(400, 900, 500), 2048), "uniform": (rng.integers(20, 101, 500), 150)}[kind]
    size = sorted(map(int, size), reverse=True)
    decreasing, found = shipped(size, capacity)
    assert P.least_bins(size, capacity) <= found <= decreasing - gain


@pytest.mark.parametrize("seed", range(8))
def test_no_packing_goes_under_the_bound(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        size = rng.integers(1, 13, int(rng.integers(1, 9))).tolist()
        assert P.least_bins(size, 12) <= fewest_bins(size, 12)


def test_operators_keep_packings_valid_and_the_best():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 300).tolist()
    population = P.seeds(size, 100, rng)
    for _ in range(20):
        a, b = rng.integers(0, len(population), 2)
        child = P.mutate(P.crossover(population[a], population[b], size, 100, rng), size, 100, rng)
        valid(child, size, 100)
        assert sorted(map(sorted, P._decode(P._encode(child, len(size))))) == sorted(map(sorted, child))
    out = P.evolve(population, size, 100, rng, 5)
    assert P.fitness(out[0], size, 100) >= max(P.fitness(p, size, 100) for p in population)


def test_crossover_injects_whole_bins():
    a, b = [[0, 1], [2, 3], [4]], [[0, 3], [1, 2], [4]]
    child = P.crossover(a, b, [5, 5, 5, 5, 5], 10, np.random.default_rng(0))
    valid(child, [5] * 5, 10)
    assert any(sorted(x) in ([0, 3], [1, 2]) for x in child)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.pack_documents(docs, capacity=500).cache()
    load = got.groupBy("bin_id").agg(F.sum("n_words").alias("w"))
    assert load.agg(F.max("w")).first()[0] <= 500
    words = {r[0]: r[1] for r in docs.select("doc_id", F.regexp_count("text", F.lit(r"\S+"))).collect()}
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append((r.start_word, r.n_words, r.piece))
    assert pieces.keys() == {k for k, n in words.items() if n}
    for k, p in pieces.items():
        p.sort()
        assert [x[2] for x in p] == list(range(len(p))) and sum(x[1] for x in p) == words[k]
        assert all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[0][0] == 0
    total = sum(words.values())
    assert load.count() <= 1.02 * -(-total // 500)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.pack_documents(docs.repartition(3), capacity=500).collect()))


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b c", 0), (3, "a b c", 0), (3, "a b c", 0), (4, "w " * 25, 0), (5, "w " * 20, 0), (6, " \n ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin_id int")
    got = P.pack_documents(df, capacity=10).collect()
    assert sorted((str(r.doc_id), r.start_word, r.n_words) for r in got) == [("3", 0, 3), ("3", 0, 3), ("4", 0, 10), ("4", 10, 10), ("4", 20, 5), ("5", 0, 10), ("5", 10, 10), ("None", 0, 3)]
    loads = {}
    for r in got:
        loads[r.bin_id] = loads.get(r.bin_id, 0) + r.n_words
    assert max(loads.values()) <= 10 and len(loads) == 6
    assert P.pack_documents(df.limit(0)).count() == 0 and P.pack_documents(df.filter("doc_id = 2")).count() == 0
