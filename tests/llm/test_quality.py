import duckdb
import pytest
from pyspark.sql import functions as F

from tabsift.llm import quality as Q

CASES = {
    "no_letters": ["", "123 456 !", None],
    "symbols": ["good%%% text*** with### marks&&&"],
    "capitals": ["THIS TEXT SHOUTS AT ITS READERS ALL DAY"],
    "few_distinct_words": ["ab cd " * 20],
    "stutter": ["one " * 5 + "two " * 5 + "three " * 5 + "four five six seven eight nine ten eleven twelve thirteen"],
    "repeated_lines": ["same line\n" * 9 + "other"],
    "word_length": ["a b c d e f g", "x" * 400 + " y z w v"],
}
GOOD = "This is a plain sentence of ordinary words.\nAnd here is another one, which differs from it."


def by_sql(texts):
    c = duckdb.connect()
    c.execute("create table t(i int, text varchar)")
    c.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    return {i for (i,) in c.sql(f"select i from t where {Q.keep_sql()}").fetchall()}


def test_each_rule(spark):
    texts = [GOOD] + [t for ts in CASES.values() for t in ts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for rule in Q.RULES:
        hit = {r.text for r in df.filter(Q.holds(rule, F.col("text"))).collect()}
        assert set(CASES[rule.name]) <= hit and GOOD not in hit
    assert {r.i for r in Q.keep_good(df).collect()} == by_sql(texts) == {0}


def test_order_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda rules: {r.doc_id for r in docs.filter(Q.cascade(F.col("text"), rules)).select("doc_id").collect()}
    assert ids(Q.RULES) == ids(Q.RULES[::-1]) == {r.doc_id for r in Q.keep_good(docs).collect()}


def test_order_is_by_rejection_for_cost(spark):
    df = spark.createDataFrame([(i, f"text {'x' * (i % 10)}") for i in range(2000)], "i int, text string")
    often = Q.Rule("often", lambda t: ~t.contains("xxxxxxxx"), "")
    never = Q.Rule("never", lambda t: t.contains("zzz"), "")
    ranked = Q.order(df, [never, often])
    assert [r.name for r, _, _ in ranked] == ["often", "never"]
    assert ranked[0][2] == pytest.approx(0.8, abs=0.15) and all(c > 0 for _, c, _ in ranked)


def test_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    kept = Q.keep_good(docs).select("doc_id").withColumn("kept", F.lit(1)).join(labels, "doc_id", "right").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0)))).collect()
    share = dict(map(tuple, kept))
    assert share[1] > 0.999 and share[0] < 0.02


def test_edge_rows(spark):
    rows = [(1, None, None), (None, GOOD, "a"), (2, GOOD, "b"), (2, GOOD, "b"), (3, "", "c"), (4, GOOD * 3000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, r0 string")
    got = Q.keep_good(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "2", "None"]  # the long one repeats its words
    assert Q.keep_good(df.limit(0)).count() == 0
