"""Main text extraction: cuts against all labellings, pages of several makes, awkward rows."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segspark.llm import html_text as m

PRIOR = m.scores(m.PRIOR)
LONG = "This sentence has quite a few words, so that it reads like prose and ends with a mark. " * 3


def cost(lean, edges, side):
    own = sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(lean, side, strict=True))
    return own + sum(c for u, v, c in edges if side[u] != side[v])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_minimum_cut(seed):
    r = random.Random(seed)
    n = r.randrange(1, 9)
    lean = [r.randrange(-9, 10) for _ in range(n)]
    edges = [(*sorted(r.sample(range(n), 2)), r.randrange(0, 8)) for _ in range(r.randrange(0, 2 * n))] if n > 1 else []
    least = min(cost(lean, edges, side) for side in itertools.product([False, True], repeat=n))
    assert cost(lean, edges, m.minimum_cut(lean, edges)) == least
    assert cost(lean, edges, m.flow(lean, edges)) == least


def text(page):
    return m.main_text(page, PRIOR)


def test_states():
    page = f"""<!DOCTYPE html><html class="sidebar"><head><title>T</title><style>p{{x}}</style><script>"</p>"; a < b</script></head><body>
    <header><h1>Site</h1><nav><a href="/">Home</a></nav></header><div class="cookie-notice"><p>{LONG}</p></div>
    <div id="left-sidebar"><p>{LONG} side</p></div><article class="post"><h1>Title &amp; more</h1><p>One<br>two&nbsp;three <b>bold</b>ly.<p>Of.
    <div class="ad">Buy</div><ul><li>item</ul><form><label>Name</label><input></form><!-- <p>gone</p> --><section id="comments"><article><p>{LONG}</p></article></section></article>
    <aside><p>{LONG}</p></aside><div hidden><p>{LONG}</p></div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Title & more\nOne two three boldly.\nOf.\nitem"


def test_without_statements():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6))
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(4)) + "<p>Short one.</p>" + f"<p>{LONG} end</p>"
    got = text(f"<body><ul>{links}</ul><div><h2>A title</h2>{body}</div><ul>{links}</ul>")
    assert got.startswith("A title\n") and got.count("\n") == 6 and "Short one." in got and "Link" not in got


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<", "<"), ("<article>1 < 2 <3 &lt;b&gt; &am &#x41;</article>", "1 < 2 <3 <b> &am A"), ("<article>a<script>x", "a"), ("<article>a<p b='", "a"), ("<article>a</b></div></article>", "a"), ("<article><td>a<td>b</article>", "a\nb")])
def test_awkward_pages(page, want):
    score = dict.fromkeys(PRIOR, 1.0)
    assert m.main_text(page, score) == want


def test_long_pages():
    for page, n in ((f"<article>{'<p>a b.' * 30000}</article>", 30000), ("<div>" * 20000 + "<article>x</article>", 1), ("<a " * 50000, 0), ("<p>" + "word " * 300000, 1), ("".join(f"<p>{LONG if i % 3 else 'no'}" for i in range(20000)), None)):
        got = text(page)
        assert n is None or len(got.split("\n")) == max(1, n)


def test_classifier_learns():
    counts = {s: ((0.0, 900.0) if s[0] == 0 else (900.0, 0.0)) for s in np.ndindex(*m.SIZES)}
    score = m.scores(m.fitted(counts))
    assert all((score[s] > 0) == (s[0] == 0) for s in score)
    assert (m.fitted({}) == m.PRIOR).all()


def test_extract(spark):
    schema = "page_id long, url string, html string, text string, h long"
    article = "<nav><a>menu</a></nav><article><p>Body text here.</p></article><footer>end</footer>"
    rows = [(1, "u", article, "x", 1), (1, "u", article, "x", 1), (2, None, None, None, None), (None, "v", "", "x", 1), (3, "w", f"<article>{LONG * 2000}</article>", "x", 1)]
    out = m.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(tuple("" if v is None else v for v in r[:2]) + (r.text[:20], r.n_chars) for r in out.collect() if r.page_id)
    long = len((LONG * 2000).strip())
    assert got == [(1, "u", "Body text here.", 15), (1, "u", "Body text here.", 15), (2, "", "", 0), (3, "w", LONG[:20], long)]
    assert m.extract(spark.createDataFrame([], schema)).count() == 0
    assert m.extract(spark.createDataFrame([("a", 5, article)], "page_id string, url int, html string")).first()["page_id"] == "a"
