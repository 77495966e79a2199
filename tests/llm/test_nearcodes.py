import time

import numpy as np
import pyarrow as pa
import pytest

from tabsift.llm import nearcodes, simhash


def leaning(n, seed, families=0):
    """Codes whose bits lean, as those of texts in few languages, some in families within and about the distance."""
    rng = np.random.default_rng(seed)
    lean = np.clip(rng.normal(0.5, 0.15, 128), 0.15, 0.85)
    bits = rng.random((n, 128)) < lean
    for k in range(families):
        bits[4 * k + 1 : 4 * k + 4] = bits[4 * k] ^ (rng.random((3, 128)) < rng.uniform(0.02, 0.12))
    return np.unique(np.packbits(bits, axis=1), axis=0)


def all_pairs(code):
    hi, lo = code.view(np.uint64).T.copy()
    near = [np.flatnonzero(np.bitwise_count(hi[k] ^ hi) + np.bitwise_count(lo[k] ^ lo) <= 20) for k in range(len(code))]
    return {(k, j) for k, x in enumerate(near) for j in x.tolist() if k < j}


def searched(code):
    got, where = set(), nearcodes.buckets(*nearcodes.words(code))
    for kind in range(len(nearcodes.PARTS)):
        for bucket in np.unique(where[:, kind]):
            pick = np.flatnonzero(where[:, kind] == bucket)
            assert bucket // nearcodes.VALUES == kind
            for i, j in nearcodes.pairs(code[pick], kind):
                assert (i < j).all()
                got |= set(zip(pick[i].tolist(), pick[j].tolist()))
    return got


@pytest.mark.parametrize("fill", [1, 12, 10**6])
@pytest.mark.parametrize("cells", [1 << 12, 1 << 16])
def test_search_finds_exactly_all_pairs(monkeypatch, fill, cells):
    code = leaning(4000, fill % 7, families=400)
    monkeypatch.setattr(nearcodes, "FILL", fill)
    monkeypatch.setattr(nearcodes, "_CELLS", cells)
    monkeypatch.setattr(nearcodes, "_HITS", 50)
    want = all_pairs(code)
    assert searched(code) == want and len(want) > 500


def test_pairs_that_use_up_every_budget():
    """20 bits, 3 in each segment but one with 2, in each choice of segment, and its two bits in any two parts."""
    rng, out = np.random.default_rng(1), []
    for k in range(210):
        flip = np.zeros(128, np.uint8)
        for s, w in enumerate(nearcodes._WIDTHS):
            flip[nearcodes._STARTS[s] + rng.choice(w, 2 if s == k % 7 else 3, replace=False)] = 1
        a = rng.integers(0, 256, 16).astype(np.uint8)
        out += [a, a ^ np.packbits(flip)]
    code = np.unique(np.array(out), axis=0)
    want = all_pairs(code)
    assert searched(code) == want and len(want) >= 210


def test_few_or_no_codes():
    for n in (0, 1, 2):
        code = np.zeros((n, 16), np.uint8)
        code[1:, 15] = 1
        assert [(i.tolist(), j.tolist()) for i, j in nearcodes.pairs(code, 0)] == [([0], [1])] * (n == 2)


def test_stars_join_what_pairs_join():
    code = leaning(600, 3, families=100)
    raw = [x.tobytes() for x in code]
    edges = set()
    (b,) = nearcodes.routes([pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["code"])])
    assert b.num_rows == 21 * len(code)
    bucket = b.column(0).to_numpy()
    for k in np.unique(bucket):
        t = nearcodes.star((pa.scalar(int(k)),), pa.table({"code": b.column(1).take(pa.array(np.flatnonzero(bucket == k)))}))
        edges |= set(zip(t["a"].to_pylist(), t["b"].to_pylist()))

    def groups(pairs):
        label = {x: x for x in raw}
        for _ in raw:
            before = dict(label)
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
            if before == label:
                return label

    assert groups(edges) == groups([(raw[i], raw[j]) for i, j in all_pairs(code)]) and edges


def test_pairs_compared_are_far_fewer_than_before():
    """Most buckets of the older search, in which 0.33 of all pairs of real texts met, were compared all with all."""
    code = leaning(400_000, 2)
    old = [code[:, k] for k in range(16)] + [simhash._half(code, s, h) for s, h in simhash._WHOLE]
    sizes = np.array([np.bincount(c, minlength=256) for c in old])
    assert sizes.max() < 24 * simhash.DENSE  # none was split
    before, now = int((sizes**2).sum()), 0
    new = nearcodes.buckets(*nearcodes.words(code))
    for kind in range(len(nearcodes.PARTS)):
        for value in range(kind % 4, nearcodes.VALUES, 4):
            cell, masks = nearcodes._cells(*nearcodes.words(code[new[:, kind] == kind * nearcodes.VALUES + value]), kind)
            count = np.bincount(cell, minlength=1 << 13)
            now += 4 * sum(int((count * count[np.arange(1 << 13) ^ m]).sum()) for m in masks)
    assert now < before / 4


def test_a_bucket_costs_less_than_the_older_search():
    code = leaning(24_000, 4, families=100)
    code[:, :2] = 7
    code = np.unique(code, axis=0)

    def took(f):
        began = time.process_time()
        n = sum(len(i) for i, _ in f(code, 0))
        return n, time.process_time() - began

    assert min(took(nearcodes.pairs)[1] for _ in range(2)) < took(simhash.pairs_in_bucket)[1]
