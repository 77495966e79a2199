import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tabsift.llm import linededup

SPACE = r"[ \t\n\v\f\r]+"


def spans(text):
    return [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", text or "")]


def brute(texts, least):
    """Words that go, of texts in corpus order: all runs of ``least`` words against all earlier places, without a hash."""
    docs = [[t[a:b] for a, b in spans(t)] for t in texts]
    seen, gone = {}, []
    for i, words in enumerate(docs):
        mine = set()
        for p in range(len(words) - least + 1):
            places = seen.setdefault(tuple(words[p : p + least]), [])
            if any(k != i or q + least <= p for k, q in places):
                mine |= set(range(p, p + least))
            places.append((i, p))
        gone.append(mine)
    return gone


def runs_of(df, least):
    return {r.doc_id: {w for run in r.runs for w in range(run.lo, run.stop)} for r in linededup.repeated_runs(df, min_words=least).collect()}


def check(spark, texts, least):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: g for i, g in enumerate(brute(texts, least)) if g}
    assert runs_of(df, least) == want
    return want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    """Few distinct words, in lines and sentences: many partners, overlaps with itself, windows without a line."""
    rng = np.random.default_rng(seed)
    words = ["a", "b", "a.", "c\n"][: 2 + seed]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(25)]
    assert check(spark, texts, 6)


@pytest.mark.parametrize("seed", range(2))
def test_passages_set_into_other_text(spark, seed):
    """Passages that begin and end anywhere, some longer than others, reflowed and with edited words."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" + rng.choice(["", "", "", ".", "\n"]) for x in rng.integers(0, 5000, n)]
    passages = [word(int(n)) for n in rng.integers(20, 200, 12)]
    texts = []
    for _ in range(60):
        parts = word(int(rng.integers(0, 80)))
        for k in rng.integers(0, len(passages), 2):
            p = list(passages[k][: int(rng.integers(10, 220))])
            if rng.random() < 0.5:
                p = [x.strip() for x in p]
            if rng.random() < 0.3:
                p[len(p) // 2] = "edited"
            parts += p + word(int(rng.integers(0, 80)))
        texts.append(" ".join(parts))
    assert check(spark, texts, 50)


def test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert check(spark, [r.text for r in rows], linededup.MIN_WORDS)


def test_a_tail_that_only_a_later_document_shares(spark):
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(10))
    texts = [f"{p}\nx one", f"{p}\n{q}\ny two", f"{p}\n{q}\nz three"]
    assert check(spark, texts, 50)[2] == set(range(70))


def test_selects_few_positions_and_each_window_its_least():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" + "." * int(x % 9 == 0) for x in rng.integers(0, 10_000, n)) for n in (3000, 40, 700)]
    w = linededup.words_of(pa.array(texts))
    h, _, lo, hi = linededup.fingerprints(w)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert len(covered) == len(set(covered.tolist())) == 3000 + 700 - 2 * 49  # each window selects one position
    lines = np.flatnonzero(w.begins & (np.arange(len(w.hash)) + linededup.LEAD <= w.offs[w.row + 1]))
    value = w.run(lines, lines + linededup.LEAD, 45)
    for v, a, b in zip(h, lo, hi):
        for s in {a, b}:
            inside = value[(lines > s + 1) & (lines + linededup.LEAD <= s + 50)]
            assert v == (inside.min() if len(inside) else v)
    per_window = len(lines) / len(w.hash) * (50 - linededup.LEAD - 1)
    assert len(h) < 1.3 * len(lines) * 2 / (per_window + 1)  # the density of winnowing


def test_texts_that_repeat_themselves_take_linear_time(spark):
    rows = [(0, "\n".join(["same line"] * 100_000)), (1, "w " * 200_000), (2, "\n".join(f"line {i % 40} of many." for i in range(100_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(df, removed="gone").collect()}
    assert time.time() - began < 60
    assert got[0].text == "\n".join(["same line"] * 25) and got[1].text == " ".join("w" * 50)
    assert len(got[2].text.split()) == 160 and [tuple(x) for x in got[2].gone] == [(160, 400_000)]


@pytest.mark.parametrize("seed", range(2))
def test_what_stays_of_a_text(spark, seed):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(["é", "b", "c"]) + rng.choice([" ", "\n", " \n\t", "  "]) for _ in range(rng.integers(0, 50))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(df, min_words=5).collect()}
    for i, gone in enumerate(brute(texts, 5)):
        words = [texts[i][a:b] for a, b in spans(texts[i])]
        kept = [x for k, x in enumerate(words) if k not in gone]
        assert (got.get(i, "").split() == kept) and (i in got) == bool(kept or not gone)
        if not gone:
            assert got[i] == texts[i]
        elif kept:
            lines = [[] for _ in range(texts[i].count("\n") + 1)]
            for k, (a, b) in enumerate(spans(texts[i])):
                if k not in gone:
                    lines[texts[i].count("\n", 0, a)].append(texts[i][a:b])
            assert [x.split() for x in got[i].split("\n") if x.split()] == [x for x in lines if x]


def test_edge_rows(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(2, f"intro\n{passage}\nend", 7, "k"), (1, passage, 8, "k"), (3, None, None, None), (4, "", 0, ""), (5, passage, 9, "z"), (6, f"x\n{passage}", 1, "r"), (6, f"x\n{passage}", 1, "r"), (7, "w " * 49, 2, "l"), (None, f"{passage}\nnull id", 3, "n"), (8, f"in {passage} running text", 4, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string").withColumnsRenamed({"key": "runs"})
    got = linededup.drop_repeated_lines(df, removed="gone")
    by = {r.doc_id: r for r in got.collect()}
    assert got.columns == [*df.columns, "gone"]
    assert by[None].gone == [] and by[2].text == "intro\nend" and by[2].n_chars == 9 and [tuple(x) for x in by[2].gone] == [(1, 61)]
    assert 1 not in by and 5 not in by and by[3].text is None and by[4].text == "" and by[3].n_chars is None
    assert [r.text for r in got.filter("doc_id = 6").collect()] == ["x", "x"]
    assert by[7].gone == [] and by[8].text == "in running text" and got.count() == 8
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0
    half = linededup.drop_repeated_lines(df.unionByName(spark.createDataFrame([(9, f"{passage} {'more ' * 60}", 5, "h")], df.schema)), least_left=0.5)
    assert sorted(r.doc_id or 0 for r in half.collect()) == [0, 3, 4, 7, 9]
