import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsift.llm import kernels as K
from tabsift.llm import syncmers


def brute(text, k, s):
    """Closed syncmers by definition, from hashes of the s-mers alone."""
    x = K.mix(np.array([ord(c) for c in text], K.U64), 31)
    base, out = syncmers._BASE, []
    hashes = []
    for i in range(len(x) - s + 1):
        h = 0
        for v in x[i : i + s]:
            h = (h * base + int(v)) % 2**64
        hashes.append(int(K.mix(np.array([h], K.U64), 32)[0]))
    for i in range(len(x) - k + 1):
        inner = hashes[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é😀\n", max_size=60)), max_size=6), st.sampled_from([(5, 2), (7, 3), (4, 1), (9, 8)]))
def test_against_definition(texts, ks):
    k, s = ks
    offs, at, h = syncmers.fingerprint(pa.array(texts, pa.string()), k, s)
    assert len(offs) == len(texts) + 1
    seen = {}
    for i, t in enumerate(texts):
        mine = at[offs[i] : offs[i + 1]].tolist()
        assert mine == brute(t or "", k, s)
        for p, v in zip(mine, h[offs[i] : offs[i + 1]].tolist()):
            assert seen.setdefault(t[p : p + k], v) == v
    assert len(set(seen.values())) == len(seen)


def test_every_passage_has_an_anchor():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh "), 5000))
    _, at, _ = syncmers.fingerprint(pa.array([text]))
    assert np.diff(np.concatenate(([0], at, [len(text) - syncmers.K_LEN]))).max() <= syncmers.K_LEN - syncmers.S_LEN + 1


def test_long_text_in_blocks(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdé "), 3000))
    one = syncmers.fingerprint(pa.array([text, "x", text]))
    monkeypatch.setattr(K, "BLOCK", 100)
    two = syncmers.fingerprint(pa.array([text, "x", text]))
    assert all((a == b).all() for a, b in zip(one, two))


def test_edge_rows(spark):
    long = "word " * 40
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (None, "short", None), (2, None, "b"), (3, "", "c")], "doc_id long, text string, positions string")
    got = syncmers.fingerprints(df).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[2].positions == [] and by[3].hashes == [] and by[None].n_kmers == 0
    assert by[1].n_kmers == len(long) - syncmers.K_LEN + 1 and len(by[1].positions) > 0
    assert syncmers.fingerprints(df.limit(0)).count() == 0


def test_matches_find_a_shared_passage(spark):
    rng = np.random.default_rng(2)
    make = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = make(300)
    df = spark.createDataFrame([(1, make(50) + passage + make(20)), (2, make(200) + passage)], "doc_id long, text string")
    f = syncmers.fingerprints(df)
    hit = syncmers.matches(f.filter("doc_id = 1"), f.filter("doc_id = 2")).orderBy("anchors", ascending=False).first()
    assert (hit.left_id, hit.right_id, hit.diagonal) == (1, 2, -150) and hit.anchors > 5
