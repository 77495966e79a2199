import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsift.llm import mixing as M


def test_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("pmod(doc_id, 3) > 0")
    model = M.fit_labels(docs, train)
    held = docs.join(labels.filter("pmod(doc_id, 3) = 0"), "doc_id")
    got = M.memberships(held, model).join(labels.select("doc_id", M.domain_of(F.col("quality"), F.col("toxic")).alias("y")), "doc_id").collect()
    p, y = np.array([r.p for r in got]), np.array([r.y for r in got])
    right = p.argmax(1) == y
    assert right.mean() > 0.94 > (y == 0).mean() + 0.08 and right[y == 0].mean() > 0.99  # on some 2600 labelled rows
    assert right[y == 1].mean() > 0.65 and right[y == 2].mean() > 0.85
    assert np.abs(p.mean(0) - np.bincount(y, minlength=3) / len(y)).max() < 0.04  # posteriors near the frequencies


def test_few_telling_words_mark_a_document():
    """A word that only one domain has counts for it in long texts of many common words too."""
    rng = np.random.default_rng(2)
    rows, label = [], []
    for i in range(600):
        toxic = i % 10 == 0
        words = rng.choice(3000, int(rng.integers(20, 400)))
        rows.append(np.unique(np.concatenate((words, [100_000 + rng.integers(0, 3)] if toxic else words[:0]))).astype(np.int64))
        label.append(int(toxic))
    model = M.fit(rows[:400], np.array(label[:400]))
    offs = np.concatenate(([0], np.cumsum([len(r) for r in rows[400:]])))
    p = model.posterior(offs, np.concatenate(rows[400:]))[:, 1]
    y = np.array(label[400:]) == 1
    assert p[y].min() > 0.5 > p[~y].max() and {100_000, 100_001, 100_002} <= set(model.which.tolist())


def members(spark, p, words):
    return spark.createDataFrame([(i, int(w), [float(x) for x in q]) for i, (q, w) in enumerate(zip(p, words))], "doc_id long, n_words bigint, p array<double>")


def test_rates_meet_the_targets_and_match_numpy(spark):
    rng = np.random.default_rng(0)
    p, words = rng.dirichlet([4, 1, 1], 400), rng.integers(1, 500, 400)
    mix = M.solve(members(spark, p, words).repartition(4), {"good": 0.75, "toxic": 0.1, "poor": 0.15})
    r = mix.rate(p)
    got = (p * (r * words)[:, None]).sum(0) / words.sum()
    assert (r >= 0).all() and np.abs(got - mix.targets).max() < 2 * M.TOLERANCE and got == pytest.approx(mix.totals, abs=1e-9)
    # the same steps without Spark, over cells
    key = np.round(p[:, 1:] * M.CELLS) @ [1000, 1]
    _, cell = np.unique(key, return_inverse=True)
    words_of = np.bincount(cell, words)
    p = np.stack([np.bincount(cell, words * p[:, k]) / words_of for k in range(3)], 1)
    words, r = words_of, mix.rate(p)
    x = before = y = np.ones(len(p))
    for k in range(len(mix.gradients)):
        g = (p * (y * words)[:, None]).sum(0) / words.sum() - mix.targets
        assert g == pytest.approx(mix.gradients[k], abs=1e-9)
        before, x = x, np.maximum(y - mix.step * (p @ g), 0)
        y = np.maximum(x + k / (k + 3) * (x - before), 0)
    assert x == pytest.approx(M.rates(p, mix.gradients, mix.step))


@pytest.mark.parametrize("targets", [M.TARGETS, corpus_pipeline.TARGETS])
def test_production_targets_are_met(spark, targets):
    rng = np.random.default_rng(1)
    p, words = rng.dirichlet([4, 1, 1], 4000), rng.integers(1, 500, 4000)
    mix = M.solve(members(spark, p, words).repartition(4), targets)
    got = (p * (mix.rate(p) * words)[:, None]).sum(0) / words.sum()
    assert (mix.rate(p) >= 0).all() and np.abs(got - mix.targets).max() <= M.TOLERANCE and got == pytest.approx(mix.totals, abs=1e-9)


@pytest.mark.parametrize("most", [1.5, 4.0])
def test_bounded_rates_are_the_least_squares_solution(spark, most):
    """At the optimum no rate inside its bounds has a slope, none at 0 wants to rise, and none at the greatest to rise less."""
    rng = np.random.default_rng(3)
    p, words = rng.dirichlet([4, 1, 1], 2000), rng.integers(1, 500, 2000)
    with pytest.warns(RuntimeWarning, match="mixing reaches"):
        mix = M.solve(members(spark, p, words).repartition(4), corpus_pipeline.TARGETS, most=most)
    r = mix.rate(p)
    gap = (p * (r * words)[:, None]).sum(0) / words.sum() - mix.targets
    slope = p @ gap
    assert r.min() >= 0 and r.max() == most and gap + mix.targets == pytest.approx(mix.totals, abs=1e-9)
    inside = (r > 1e-6) & (r < most - 1e-6)
    assert np.abs(slope[inside]).max(initial=0) < 2e-3 and slope[r <= 1e-6].min(initial=0) > -2e-3 and slope[r >= most - 1e-6].max(initial=0) < 2e-3


def test_a_miss_is_reported_and_is_the_least_squares_solution(spark):
    p = np.array([[0.8, 0.1, 0.1], [0.5, 0.3, 0.2]])
    with pytest.warns(RuntimeWarning, match="mixing reaches"):
        mix = M.solve(members(spark, p, [10, 30]), {"good": 0.97, "toxic": 0.02, "poor": 0.01})
    share = p * np.array([0.25, 0.75])[:, None]
    best = min((np.square(np.array([a, b]) @ share - mix.targets).sum(), a, b) for a in np.linspace(0, 8, 801) for b in np.linspace(0, 2, 21))
    assert np.square(mix.totals - mix.targets).sum() <= best[0] + 1e-5 and mix.miss > M.TOLERANCE


def test_targets_out_of_reach(spark):
    mix = M.solve(members(spark, [[1, 0, 0], [0.5, 0.5, 0]], [10, 10]), {"poor": 1.0}, steps=40)
    assert (mix.rate(np.array([[1, 0, 0], [0.5, 0.5, 0]])) < 0.05).all()
    with pytest.raises(ValueError):
        M.solve(members(spark, [[1, 0, 0]], [1]), {"good": 0.0})


def of_documents(spark, folder, targets):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = M.document_rates(docs, labels, targets).collect()
    p = np.array([[r.p_good, r.p_toxic, r.p_poor] for r in rows])
    words, rate = (np.array([getattr(r, k) for r in rows], float) for k in ("n_words", "rate"))
    share = p * (words / words.sum())[:, None]
    want = np.array([targets[d] for d in M.DOMAINS])
    return p, words, rate, (share * rate[:, None]).sum(0) - want


@pytest.mark.parametrize("targets", [M.TARGETS, corpus_pipeline.TARGETS])
def test_documents_meet_the_production_targets_or_come_as_near_as_can_be(spark, sf, targets):
    big = sf.replace("0.001", "0.01")
    _, _, rate, gap = of_documents(spark, big, targets)
    assert (rate >= 0).all() and np.abs(gap).max() <= M.TOLERANCE
    # few documents: at the least-squares optimum no rate above 0 has a gradient, and none at 0 wants to rise
    p, words, rate, gap = of_documents(spark, sf, targets)
    slope = p @ gap
    assert (rate >= 0).all() and (np.abs(gap).max() <= M.TOLERANCE or (slope.min() > -2e-3 and (words / words.sum() * rate * np.abs(slope)).sum() < 2e-3))


def test_a_text_is_read_once(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = M.resample(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


LABELS = "doc_id long, quality int, toxic int"


def test_resample_follows_rates(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rate = {r.doc_id: r.rate for r in M.document_rates(docs, labels).collect()}
    got = M.resample(docs, labels)
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert got.columns == docs.columns
    assert all(int(r) <= n.get(k, 0) <= int(r) + 1 for k, r in rate.items())
    assert sum(n.values()) == pytest.approx(sum(rate.values()), rel=0.2)


def test_edge_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "some words", 1.0), (3, "good words here", 1.0), (3, "good words here", 1.0), (4, "w " * 100_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (4, 0, 0), (None, 1, 0), (99, 1, 0)], LABELS)
    got = M.document_rates(df, labels).collect()
    assert len(got) == 6 and all(r.rate >= 0 and abs(r.p_good + r.p_toxic + r.p_poor - 1) < 1e-9 for r in got)
    assert {r.doc_id: r.n_words for r in got}[4] == 100_000
    none = M.document_rates(df, labels.limit(0)).collect()
    assert all(r.p_good == pytest.approx(1 / 3) for r in none)
    assert M.document_rates(df.limit(0), labels).count() == 0 and M.resample(df.limit(0), labels).count() == 0
    assert M.resample(df, labels).columns == df.columns
