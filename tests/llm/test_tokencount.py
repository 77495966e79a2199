import pytest
import sentencepiece  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tabsift.llm import tokencount


def library(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


SMALL = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("▁a", -5.0), ("▁ab", -7.0), ("é", -2.5), ("aab", -5.5)]


@pytest.fixture(scope="module")
def real():
    vocabulary, fallback = tokencount.read_vocabulary(tokencount.VOCABULARY)
    return tokencount.Counter(vocabulary, fallback), library(vocabulary, fallback)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é▁\nxy", max_size=30))
def test_small_vocabulary_with_ties(text):
    for fallback in (False,):
        assert tokencount.Counter(SMALL, fallback).text(text) == library(SMALL, fallback)(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(real, text):
    assert real[0].text(text) == real[1](text)


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.sampled_from(["the", "Über", "naïve", "\n", "  ", "x=1;", "日本", "▁", "<s>", "<0x0A>", "é"]), max_size=30))
def test_mixed_words(real, words):
    text = " ".join(words)
    assert real[0].text(text) == real[1](text)


def test_documents(spark, sf, real):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id] == real[1](r.text) for r in rows)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "the " * 50_000, 0), (2, "the " * 50_000, 0)], "doc_id long, text string, n_tokens int")
    n = library(*tokencount.read_vocabulary(tokencount.VOCABULARY))("the " * 50_000)
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokencount.token_counts(df).collect())
    assert got == [("1", 0), ("2", n), ("2", n), ("None", 0)]
    assert tokencount.token_counts(df.limit(0)).count() == 0
