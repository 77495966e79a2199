import html
import math
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsift.llm import htmlpaths as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a><li><a>More</a></ul></nav>
<!-- ad --><article><h1>Heading</h1><p>The first paragraph is long enough, and it has commas, stops, and so on; it is text &amp; content.<br>More of it, here.<p>A second paragraph, also long, with <b>bold words, too</b>, and an end. It goes on for a while.</p>
<p>Third one: shorter, but still text, with marks.</p></article><footer>Imprint</footer></body></html>"""


def test_page():
    text, nodes, kept = H.extract(PAGE)
    assert "The first paragraph" in text and "text & content." in text
    assert "bold words, too" in text and "Third one" in text and "Home" not in text and "News" not in text and "</p>" not in text
    assert 0 < kept < nodes


def brute(paths, texts):
    """Selection by the definition, in plain loops."""
    of = lambda f: {p: sum(f(t) for q, t in zip(paths, texts) if q == p) / paths.count(p) for p in paths}
    size, marks = of(len), of(lambda t: len(H._PUNCT.findall(t)))
    weight = [math.exp(-(k**2) / (2 * H.SIGMA**2)) for k in range(-H.RADIUS, H.RADIUS + 1)]
    at = lambda i: paths[min(max(i, 0), len(paths) - 1)]
    smooth = lambda r, i: sum(w * r[at(i + k)] for w, k in zip(weight, range(-H.RADIUS, H.RADIUS + 1))) / sum(weight)
    fused = [math.sqrt(smooth(size, i) * smooth(marks, i)) for i in range(len(paths))]
    mean = sum(fused) / len(fused)
    limit = H.THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    score = {p: sum(x for q, x in zip(paths, fused) if q == p) / paths.count(p) for p in paths}
    return [score[p] >= limit for p in paths] if any(score[p] >= limit for p in paths) else [score[p] == max(score.values()) for p in paths]


def test_selection_by_definition():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(2, 30)
        paths = [rng.randint(0, 4) for _ in range(n)]
        texts = ["".join(rng.choice("ab c,.") for _ in range(rng.choice([2, 5, 80]) * (1 + p))) + "x" for p in paths]
        got = H.content(paths, texts).tolist()
        assert got == brute(paths, texts)
    paths, texts, _ = H.text_nodes("<div><p>aaaa, bbbb.</p><p>cc.</p></div><i>x</i>")
    assert texts == ["aaaa, bbbb.", "cc.", "x"] and paths[0] == paths[1] != paths[2]


def test_accuracy(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet")
    truth = {r.page_id: re.search(r"(?s)<article[^>]*>(.*?)</article>", r.html)[1] for r in pages.collect() if "<article" in r.html}
    scores = []
    for r in H.extract_pages(pages).collect():
        if r.page_id not in truth:
            continue
        want, got = Counter(html.unescape(re.sub("<[^>]+>", " ", truth[r.page_id])).split()), Counter(r.text.split())
        both = sum((want & got).values())
        scores.append(2 * both / (sum(want.values()) + sum(got.values())))
    assert len(scores) > 300 and sum(scores) / len(scores) > 0.93


def test_markup_that_is_not_well_formed():
    for page, want in (("a < b", "a < b"), ("<p>x", "x"), ("</div>y", "y"), ("<script>never ends", ""), ("<!-- never ends", ""), ("<a title='q>t", "t"), ("x <a href='y", "x <a href='y"), ('<i a=">">b</i>', "b"), ("<a b=' c>d<a e='>f", "f"), ("&#99999999999;", "\ufffd"), ("<p/>z", "z"), ("&lt;b&gt;", "<b>")):
        assert H.extract(page)[0] == want
    deep = "<div>" * 50_000 + "text, here." + "</div>" * 50_000
    assert H.extract(deep)[0] == "text, here."


@pytest.mark.parametrize(
    "unit, before, after",
    [("<a", "", ""), ('<a "', "", ""), ("<a<", "", ">"), ('<a ">"', "", '"'), ("<a '>", "", ""), ("<!--", "", ""), ("<b>", "<p><foo>", "<div></div>" * 20_000), ("<b>", "<ul><p>", "<li></li>" * 20_000), ("</script ", "<script>", ""), ("&#", "", ""), ("9", "&#", ";"), ("<title>", "", "")],
)
def test_time_is_proportional_to_the_page(unit, before, after):
    began = time.perf_counter()
    H.extract(before + unit * 100_000 + after)
    assert time.perf_counter() - began < 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-\"' abp&;=", max_size=60))
def test_never_fails(page):
    text, nodes, kept = H.extract(page)
    assert (text == "") == (nodes == 0) and 0 <= kept <= nodes


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, PAGE, "x"), (3, PAGE, "x"), (3, PAGE, "x"), (4, f"<p>{'long text, ' * 50_000}</p>", "x")], "page_id long, html string, text string")
    got = H.extract_pages(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text is None and by[2].text == "" and by[None].text == by[3].text and len(by[4].text) > 500_000
    assert H.extract_pages(df.limit(0)).count() == 0
