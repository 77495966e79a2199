"""Best-fit packing of documents into sequences, by a grouping genetic algorithm.

Documents are dealt to blocks of about BLOCK items by hash, so that the number
of blocks grows with the input and the work of one doesn't. A block is evolved on
ISLANDS islands at once. An individual is a packing of the block's items into
bins. Crossover injects a run of the other parent's best filled bins, removes the
bins that hold any of their items, and puts what that displaces into the remaining
bins; mutation dissolves the worst filled bins in the same way. A displaced item
first takes the place of one or two smaller ones wherever that fills a bin further,
largest first; what is left over then is best-fitted. The first individual is
best-fit decreasing, so the result is never worse. Fitness is the mean squared
fill. After every epoch the elite of each island moves on to the next one in the
ring, which is the only shuffle: a population is a few kilobytes. An island stops
once its best individual has as few bins as the sizes allow (least_bins).

Sizes are counts of words. A document of more than the capacity is cut: its full
pieces fill bins of their own, and the rest is packed.

Defined results:
* null, empty and blank texts have no words and get no row;
* every row of docs is an item: repeated rows, and rows with equal or null ids,
  are packed separately;
* items are ordered by size, text hash and id; rows equal in all three are
  interchangeable, so the packing doesn't depend on the order of the input;
* every piece is in one bin, pieces of a document cover it without overlap, and
  no bin holds more than the capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import col, key_type, stash

CAPACITY, BLOCK, ISLANDS, POPULATION, ELITE = 2048, 2048, 3, 6, 2
EPOCHS, GENERATIONS, OFFSPRING, SEED = 3, 12, 4, 11
#: Rows that one task evolves at most, as long as there are more rows than tasks at once.
ROWS_PER_TASK = 8

Bins = list[list[int]]


def best_fit(bins: Bins, free: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Put items, in the given order, each into the fullest bin that has room, or a new one."""
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in items:
        k = bisect_left(room, (size[i], -1))
        if k < len(room):
            f, b = room.pop(k)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[b] = f - size[i]
        if free[b]:
            insort(room, (free[b], b))


def _free(bins: Bins, size: list[int], capacity: int) -> list[int]:
    return [capacity - sum(size[i] for i in b) for b in bins]


def fitness(bins: Bins, size: list[int], capacity: int) -> float:
    return sum(((capacity - f) / capacity) ** 2 for f in _free(bins, size, capacity)) / len(bins)


def replace(bins: Bins, free: list[int], items: list[int], size: list[int]) -> list[int]:
    """Swap items for one or two smaller ones of a bin that this fills further; returns what is left over, largest first.

    Every swap makes the items outside smaller, so it ends.
    """
    if not bins:
        return items
    one = np.array([i for b in bins for i in b])
    owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    pairs = [(i, j, k) for k, b in enumerate(bins) if free[k] and 1 < len(b) < 7 for n, i in enumerate(b) for j in b[n + 1 :]]
    two, with_, pair_owner = np.array(pairs, np.int64).reshape(-1, 3).T
    weight, slack = np.array(size), np.array(free)
    s1, s2 = weight[one], weight[two] + weight[with_]
    c1, c2 = s1 + slack[owner], s2 + slack[pair_owner]
    alive1, alive2 = slack[owner] > 0, np.ones(len(two), bool)
    heap = [(-size[i], i) for i in items]
    heapify(heap)
    out: list[int] = []
    while heap:
        i = heappop(heap)[1]
        s = size[i]
        # the swap that leaves the least room; of equals, the one that puts out least
        best, found = (1 << 40, 0), None
        for kind, (have, cap, ok) in enumerate(((s1, c1, alive1), (s2, c2, alive2))):
            good = np.flatnonzero((have < s) & (cap >= s) & ok)
            if len(good):
                k = good[np.lexsort((have[good], cap[good]))[0]]
                if (cap[k] - s, have[k]) < best:
                    best, found = (cap[k] - s, have[k]), (kind, int(k))
        if found is None:
            out.append(i)
            continue
        kind, k = found
        b = int(owner[k] if kind == 0 else pair_owner[k])
        gone = [int(one[k])] if kind == 0 else [int(two[k]), int(with_[k])]
        bins[b] = [x for x in bins[b] if x not in gone] + [i]
        free[b] -= s - sum(size[x] for x in gone)
        alive1[owner == b], alive2[pair_owner == b] = False, False  # a bin is changed once at most
        for x in gone:
            heappush(heap, (-size[x], x))
    return out


def settle(bins: Bins, items: list[int], size: list[int], capacity: int) -> Bins:
    """Put displaced items, in the given order, into some bins and new ones."""
    free = _free(bins, size, capacity)
    best_fit(bins, free, replace(bins, free, items, size), size, capacity)
    return bins


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A child of a, with a run of b's best filled bins."""
    ranked = sorted(range(len(b)), key=lambda k: (sum(size[i] for i in b[k]), -k), reverse=True)
    top = ranked[: max(1, len(ranked) // 2)]
    n = int(rng.integers(1, max(2, len(top) // 2 + 1)))
    start = int(rng.integers(0, len(top) - n + 1)) if n < len(top) else 0
    new = [list(b[k]) for k in top[start : start + n]]
    have = {i for x in new for i in x}
    displaced: list[int] = []
    for x in a:
        if have.isdisjoint(x):
            new.append(list(x))
        else:
            displaced += [i for i in x if i not in have]
    displaced.sort(key=lambda i: (-size[i], i))
    return settle(new, displaced, size, capacity)


def mutate(a: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Dissolve the worst filled bins, and a few others, and pack their items again."""
    free = _free(a, size, capacity)
    order = sorted(range(len(a)), key=lambda k: (-free[k], k))
    drop = set(order[: int(rng.integers(1, max(2, len(a) // 10 + 1)))])
    drop.update(int(k) for k in rng.integers(0, len(a), max(1, len(a) // 50)))
    kept = [list(x) for k, x in enumerate(a) if k not in drop]
    items = [i for k in sorted(drop) for i in a[k]]
    items.sort(key=lambda i: (-size[i] + int(rng.integers(0, 1 + size[i] // 4)), i))
    return settle(kept, items, size, capacity)


def _encode(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _decode(genome: np.ndarray) -> Bins:
    order = np.argsort(genome, kind="stable")
    at = np.searchsorted(genome[order], np.arange(int(genome.max()) + 2))
    return [order[a:b].tolist() for a, b in zip(at, at[1:])]


def seeds(size: list[int], capacity: int, rng: np.random.Generator) -> list[Bins]:
    """Best-fit decreasing, and best fit in disturbed orders."""
    out = []
    for k in range(POPULATION):
        noise = rng.random(len(size)) * 0.5 * (k > 0)
        order = np.lexsort((np.arange(len(size)), -np.array(size) * (1 - noise))).tolist()
        bins: Bins = []
        best_fit(bins, [], order, size, capacity)
        out.append(bins)
    return out


def least_bins(size: list[int], capacity: int) -> int:
    """A bound that no packing goes under: over all a up to half the capacity, bins for items too large to share one, and for what of the items from a on has no room beside them."""
    x = np.sort(np.array(size, np.int64))
    sums = np.concatenate(([0], np.cumsum(x)))
    half = np.searchsorted(x, capacity // 2, side="right")
    a = np.concatenate(([0], np.unique(x[:half])))
    first, fits = np.searchsorted(x, a), np.searchsorted(x, capacity - a, side="right")
    fits = np.maximum(fits, half)
    room = (fits - half) * capacity - (sums[fits] - sums[half])
    beyond = np.maximum(sums[half] - sums[np.minimum(first, half)] - room, 0)
    return int((len(x) - half + -(-beyond // capacity)).max())


def evolve(population: list[Bins], size: list[int], capacity: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[Bins]:
    """The best POPULATION individuals after some generations, best first; the best never gets lost."""
    scored = sorted(((fitness(p, size, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))[:POPULATION]
    least = least_bins(size, capacity)
    for _ in range(generations):
        if len(scored[0][2]) == least:
            break
        for _ in range(OFFSPRING):
            # of two drawn at random the better one, twice
            a, b = (min(rng.integers(0, len(scored), 2)) for _ in range(2))
            child = crossover(scored[a][2], scored[b][2], size, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, size, capacity, rng)
            scored.append((fitness(child, size, capacity), len(scored), child))
        scored = [(f, k, p) for k, (f, _, p) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION])]
    return [p for _, _, p in scored]


_STATE = "block bigint, island int, moved int, sizes binary, genomes binary"


def _rows(block: int, island: int, size: np.ndarray, population: list[Bins]) -> list[tuple]:
    """An island's population, and its elite under the next island's number."""
    pack = lambda some: b"".join(_encode(p, len(size)).tobytes() for p in some)
    return [(block, island, 0, size.tobytes(), pack(population)), (block, (island + 1) % ISLANDS, 1, b"", pack(population[:ELITE]))]


def _table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("moved", pa.int32()), ("sizes", pa.binary()), ("genomes", pa.binary())])
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _arrange(table: pa.Table, capacity: int) -> tuple[pa.Table, np.ndarray]:
    """(the items of a block in their order, sizes of what is packed: the part beyond full pieces)."""
    table = table.append_column("rest", pc.subtract(table.column("n"), pc.multiply(pc.divide(table.column("n"), capacity), capacity)))
    table = table.take(pc.sort_indices(table, [("rest", "descending"), ("n", "descending"), ("th", "ascending"), ("doc_id", "ascending")]))
    return table, table.column("rest").to_numpy().astype("<i4")


def _settle(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, rest = _arrange(table, capacity)
        rest = rest[rest > 0]
        if not len(rest):
            return _table([])
        return _table([(key[0].as_py(), k, 0, rest.tobytes(), b"") for k in range(ISLANDS)])

    return run


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, island = key[0].as_py(), key[1].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: r["moved"])
        size = np.frombuffer(rows[0]["sizes"], "<i4")
        rng = np.random.default_rng([SEED, block, island, epoch])
        population = [_decode(g) for r in rows for g in np.frombuffer(r["genomes"], "<i4").reshape(-1, len(size))]
        population = population or seeds(size.tolist(), capacity, rng)
        return _table(_rows(block, island, size, evolve(population, size.tolist(), capacity, rng)))

    return run


def _best(capacity: int):
    def run(key: tuple, items: pa.Table, states: pa.Table) -> pa.Table:
        table, rest = _arrange(items, capacity)
        packed = int((rest > 0).sum())
        at = np.zeros(len(rest), np.int64)
        bins = 0
        if packed:
            own = sorted((r for r in states.to_pylist() if r["moved"] == 0), key=lambda r: r["island"])
            firsts = [np.frombuffer(r["genomes"], "<i4")[:packed] for r in own]
            best = max(firsts, key=lambda g: fitness(_decode(g), rest[:packed].tolist(), capacity))
            at[:packed], bins = best, int(best.max()) + 1
        full = table.column("n").to_numpy() // capacity
        whole = np.repeat(np.arange(len(rest)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        row = np.concatenate((whole, np.arange(packed)))
        bin_no = np.concatenate((bins + np.arange(len(whole)), at[:packed]))
        number = np.concatenate((piece, full[:packed]))
        words = np.concatenate((np.full(len(whole), capacity), rest[:packed]))
        block = key[0].as_py()
        return pa.table([pa.array(block * 2**32 + bin_no, pa.int64()), table.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(number * capacity, pa.int64()), pa.array(words, pa.int32())], ["bin_id", "doc_id", "piece", "start_word", "n_words"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, doc_id, piece, start_word, n_words): the bin of every piece of every document."""
    t = col(text_col).cast("string")
    sized = docs.select(col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), F.regexp_count(t, F.lit(r"\S+")).cast("bigint").alias("n")).filter("n > 0")
    sized = stash(sized)
    blocks = max(1, -(-sized.count() // BLOCK))
    items = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "th", "n"), F.lit(blocks)))
    state = items.groupBy("block").applyInArrow(_settle(capacity), _STATE)
    # the rows are few and small but take long, so their partitions are stated and not left to their bytes
    at_once = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(blocks * ISLANDS, 4 * at_once), -(-blocks * ISLANDS // ROWS_PER_TASK))
    for epoch in range(EPOCHS):
        state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInArrow(_epoch(capacity, epoch), _STATE)
    out = f"bin_id bigint, doc_id {key_type(sized, 'doc_id')}, piece int, start_word bigint, n_words int"
    return items.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_best(capacity), out)
