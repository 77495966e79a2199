import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tabsift.llm import kernels as K
from tabsift.llm import simhash


def distances(code):
    bits = np.unpackbits(code, axis=1).astype(int)
    return (bits[:, None, :] != bits[None, :, :]).sum(2)


def random_codes(n, seed, flips=20):
    """Codes in families whose members differ in up to ``flips`` bits."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 8):
        base = rng.integers(0, 2, 128)
        for _ in range(8):
            x = base.copy()
            x[rng.choice(128, rng.integers(0, flips), replace=False)] ^= 1
            out.append(x)
    return np.packbits(np.array(out, np.uint8), axis=1)


@pytest.mark.parametrize("seed", range(4))
def test_buckets_find_exactly_the_pairs_within_the_distance(seed):
    code = np.unique(random_codes(160, seed), axis=0)
    want = {(i, j) for i, j in itertools.combinations(range(len(code)), 2) if distances(code)[i, j] <= simhash.MAX_DISTANCE}
    got = set()
    for byte in range(16):
        for value in np.unique(code[:, byte]):
            pick = np.flatnonzero(code[:, byte] == value)
            for i, j in simhash.pairs_in_bucket(code[pick], byte):
                got |= set(zip(pick[i].tolist(), pick[j].tolist()))
    assert got == want and len(want) > 20


def test_routes_find_pairs_without_an_equal_byte():
    rng, out = np.random.default_rng(7), []
    for k in range(60):  # pairs of exactly 20 bits, with one bit of each byte or of each but one
        a, flip = rng.integers(0, 256, 16).astype(np.uint8), np.zeros((16, 8), np.uint8)
        flip[np.arange(16), rng.integers(0, 8, 16)] = 1
        flip[rng.integers(0, 16)] *= k % 2
        free = np.flatnonzero((flip.sum(1) > 0).repeat(8) & (flip.reshape(-1) == 0))
        flip.reshape(-1)[rng.choice(free, 20 - flip.sum(), replace=False)] = 1
        out += [a, a ^ np.packbits(flip, axis=1)[:, 0]]
    code = np.array(out)
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in code], pa.binary())], ["code"])
    where = {}
    for b in simhash._routes([batch]):
        for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            where.setdefault(bucket, []).append(np.frombuffer(x, np.uint8))
    got = {frozenset((c[x].tobytes(), c[y].tobytes())) for k, v in where.items() for c in [np.array(v)] for i, j in simhash.pairs_in_bucket(c, k // 256) for x, y in zip(i, j)}
    d = distances(code)
    assert got == {frozenset((code[i].tobytes(), code[j].tobytes())) for i, j in itertools.combinations(range(len(code)), 2) if d[i, j] <= 20} and len(got) >= 60


def timed(f):
    took = []
    for _ in range(3):
        began = time.process_time()
        out = f()
        took.append(time.process_time() - began)
    return out, min(took)


def pairs_of(code, kind):
    return {x for i, j in simhash.pairs_in_bucket(code, kind) for x in zip(i.tolist(), j.tolist())}


def test_comparing_a_bucket_costs_little_more_than_counting_bits():
    """Bits that lean to one side, as those of texts in one language, make many candidates."""
    code = np.packbits(np.random.default_rng(1).random((6000, 128)) < 0.25, axis=1)
    code[:, 0], code[3000:3100] = 7, code[:100]
    code[3000:3100, 5] ^= 3
    hi, lo = code.view(np.uint64).T.copy()

    def plain():
        near = [np.flatnonzero(np.bitwise_count(hi[k] ^ hi) + np.bitwise_count(lo[k] ^ lo) <= simhash.MAX_DISTANCE) for k in range(len(code))]
        return {(k, j) for k, x in enumerate(near) for j in x.tolist() if k < j}

    (want, least), (got, took) = timed(plain), timed(lambda: pairs_of(code, 0))
    assert got == want and len(want) >= 100
    assert took < 2 * least


@pytest.mark.parametrize("kind", [0, 9, 15, 16, 26, 35])
def test_large_buckets_are_split_without_a_loss(monkeypatch, kind):
    rng = np.random.default_rng(kind)
    code = np.unique(random_codes(1600, kind), axis=0)[:, rng.permutation(16)]
    if kind < 16:
        code[:, kind] = 7
    else:  # equal halves, and none of a segment before
        s, h = simhash._WHOLE[kind - 16]
        for x, mask in zip((2 * s, 2 * s + 1), simhash._HALVES[h]):
            code[:, x] = code[:, x] & ~np.uint8(mask) | np.uint8(0x55 & mask)
    code = np.unique(code, axis=0)
    monkeypatch.setattr(simhash, "DENSE", 10**9)
    monkeypatch.setattr(simhash, "_CELLS", 1 << 12)
    whole = pairs_of(code, kind)
    x = np.bitwise_count(code[:, None] ^ code[None]).sum(2)
    assert whole == {(i, j) for i, j in zip(*(v.tolist() for v in np.nonzero(x <= simhash.MAX_DISTANCE))) if i < j} and len(whole) > 200
    if kind >= 16:  # only pairs with a whole segment among the first 6 after this one must meet here
        later = [(t, g) for t in range(simhash._WHOLE[kind - 16][0] + 1, 6) for g in range(4)]
        whole = {(i, j) for i, j in whole if any(len(set(simhash._half(code[[i, j]], t, g).tolist())) == 1 for t, g in later)}
    for few in (0, 2, 16):  # blocks alone, both, pairs formed singly
        monkeypatch.setattr(simhash, "DENSE", 0)
        monkeypatch.setattr(simhash, "FEW", few)
        got = pairs_of(code, kind)
        assert got == whole


def test_chains_keep_all_pairs_within_the_distance_and_few_others():
    rng = np.random.default_rng(3)
    near = np.zeros((20_000, 128), np.uint8)
    for x in near:  # differences of up to 20 bits, spread out or close together
        at = rng.integers(0, 128) + rng.choice(int(rng.choice([24, 60, 128])), int(rng.integers(0, 21)), replace=False)
        x[at % 128] = 1
    far = rng.integers(0, 2, (20_000, 128)).astype(np.uint8)
    kept = [simhash._ring(*(np.ascontiguousarray(np.packbits(x, axis=1)).view(np.uint64).T.copy())) for x in (near, far)]
    assert kept[0].all() and kept[1].mean() < 0.05
    # by the definition: a start from which chains of one, two and three segments stay within their budgets
    for x, k in zip(far[:500], kept[1]):
        b = x.reshape(8, 16).sum(1).tolist() * 2
        assert k == any(b[i] <= 2 and sum(b[i : i + 2]) <= 5 and sum(b[i : i + 3]) <= 7 for i in range(8))


def test_recall_of_edited_short_texts():
    rng, pairs = random.Random(5), 300
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    texts = []
    for _ in range(pairs):
        w = [rng.choice(words) for _ in range(80)]
        texts += [" ".join(w), " ".join(rng.choice(words) if k % 13 == 0 else x for k, x in enumerate(w))]
    code, _ = simhash.codes(pa.array(texts))
    near = (np.unpackbits(code[::2] ^ code[1::2], axis=1).sum(1) <= simhash.MAX_DISTANCE).mean()
    assert near > 0.75  # 15 bits give less than 0.6


def test_code_is_the_sign_of_weighted_sums():
    text = "The cat, the dog; the bird. Über naïve x1"
    words, _ = K.tokens(*K.buffers(K.lower(pa.array([text]))))
    total = np.zeros(128)
    for h in set(words.tolist()):
        f = np.array([h >> 20], np.uint64)
        bits = np.unpackbits(np.stack([K.mix(f, 21), K.mix(f, 22)], 1).view(np.uint8))
        total += round(16 * (words == np.uint64(h)).sum() ** 0.5) * (2 * bits.astype(int) - 1)
    code, has = simhash.codes(pa.array([None, text, "", "...", text.upper()]))
    assert has.tolist() == [False, True, False, False, True]
    assert (code[1] == np.packbits(total > 0)).all() and (code[4] == code[1]).all()


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = pa.array([" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n)) for n in (0, 1, 500, 30, 2000)])
    one = simhash.codes(texts)
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(simhash, "_ROWS", 7)
    two = simhash.codes(texts)
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_groups_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    code, has = simhash.codes(pa.array([r.text for r in rows]))
    d = distances(code)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if d[i, j] <= simhash.MAX_DISTANCE and has[i] and has[j]]
    label = components(len(rows), pairs)
    want = {(rows[i].doc_id, rows[label[i]].doc_id) for i in range(len(rows)) if label[i] != i}
    assert {(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(docs).collect()} == want and want
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {r.doc_id for r in rows} - {a for a, _ in want}


def test_long_chains_become_one_component(spark):
    n = 40
    edges = spark.createDataFrame([(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(n)] + [(b"\xff\x01", b"\xff\x00")], "a binary, b binary")
    got = {(bytes(r.a), bytes(r.b)) for r in simhash.components(edges).collect()}
    assert got == {(i.to_bytes(2, "big"), b"\0\0") for i in range(1, n + 1)} | {(b"\xff\x01", b"\xff\x00")}
    assert simhash.components(edges.limit(0)).count() == 0


def test_edge_rows(spark):
    same = "some words that are the same in both of these texts " * 3
    rows = [(5, same, "x", 1), (3, same.upper(), "y", 2), (3, same.upper(), "y", 2), (1, None, None, 3), (1, None, None, 3), (2, "", "", 4), (None, same, "z", 5), (9, "other " * 20_000, "q", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, code string, th int")
    assert {(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(df).collect()} == {(5, None), (3, None)}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "9", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "quite another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [1, 2]


def test_columns_that_have_no_order(spark):
    text = "some words of a text"
    rows = [(1, text, {"a": 1}, (2, {"b": 3}), [{"c": 4}])] * 2 + [(2, text, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, s struct<x:int, y:map<string,int>>, l array<map<string,int>>")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [1]
