import inspect
import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from tabsift.llm import mixing, packing, quality, simhash
from tabsift.llm.common import stash
from tests.llm.test_linededup import brute, spans
from tests.llm.test_simhash import distances


def near_duplicates(rows):
    """Ids that go, by all pairs of codes and their components."""
    code, has = simhash.codes(pa.array([r.text for r in rows], pa.string()))
    near = distances(code) <= simhash.MAX_DISTANCE
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            if has[i]:
                group[i] = min(group[j] for j in np.flatnonzero(near[i]) if has[j])
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(group[i], []).append(r.doc_id)
    return {i for ids in least.values() for i in ids if i != min(ids)}


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    # quality rules: the same condition by DuckDB
    good = stash(stages["quality_rules"](spark, docs, sf))
    want = duckdb.sql(f"SELECT doc_id FROM '{sf}/documents.parquet' WHERE {quality.keep_sql()}").fetchall()
    assert sorted(r.doc_id for r in good.collect()) == sorted(x[0] for x in want)
    # line dedup: every run of 50 words against all earlier places
    rows = good.orderBy("doc_id").collect()
    left = {}
    for r, gone in zip(rows, brute([r.text for r in rows], 50)):
        words = [r.text[a:b] for k, (a, b) in enumerate(spans(r.text)) if k not in gone]
        if len(words) >= len(gone):
            left[r.doc_id] = words
    lines = stash(stages["line_dedup"](spark, good, sf))
    assert {r.doc_id: [r.text[a:b] for a, b in spans(r.text)] for r in lines.collect()} == left and any(len(left.get(r.doc_id, [])) < len(spans(r.text)) for r in rows)
    # near-dedup: all pairs of codes
    rows = lines.orderBy("doc_id").collect()
    gone = near_duplicates(rows)
    apart = stash(stages["near_dedup"](spark, lines, sf))
    assert sorted(r.doc_id for r in apart.collect()) == sorted({r.doc_id for r in rows} - gone) and gone
    # mixing: each document as often as its rate says, with the same draw
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rates = mixing.document_rates(apart, labels, P.TARGETS, most=P.MOST_TIMES)
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = {r.doc_id: math.floor(r.rate + r.draw) for r in apart.join(rates.select("doc_id", "rate"), "doc_id").select("doc_id", "rate", draw.alias("draw")).collect()}
    assert max(times.values()) <= P.MOST_TIMES + 1
    mixed = stash(stages["mix_sources"](spark, apart, sf))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in times.items() if n})
    # packing: every word of every row once, no bin over its capacity, and as few bins as the sizes allow, but for one in fifty
    packed = stages["best_fit_packing"](spark, mixed, sf).collect()
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    got, load = Counter(), Counter()
    for r in packed:
        got[r.doc_id] += r.n_words
        load[r.bin_id] += r.n_words
    assert got == Counter({k: n for k, n in words.items() if n}) and max(load.values()) <= packing.CAPACITY
    assert len(load) <= 1.02 * math.ceil(sum(words.values()) / packing.CAPACITY) + 1


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    for name, stage in P.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = stash(stage(spark, docs, sf))
        assert docs.columns == columns
        now = docs.count()
        assert now < before if name != "mix_sources" else now > 0
        before = now
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, packed.collect()))


def test_edge_rows_pass_all_stages(spark, tmp_path):
    long = " ".join(f"word{i} of this text" for i in range(300))
    rows = [(1, None, None), (2, "", "en"), (None, long, "en"), (3, long, None), (3, long, None), (4, "short text", "de")]
    df = spark.createDataFrame([(*r, "s", None, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, bin_id string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    # null and empty texts are rejected; equal texts are one document, that of the null id; a short text has words enough
    assert {r.doc_id for r in got} <= {None, 4} and None in {r.doc_id for r in got}
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
